"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset and all runs on one machine (tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexiloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/lexiloom/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and what ran once never runs again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes staged tables that no result reads any more, so that disk holds only what is in use."""
    for df in tables:
        spark = df.sparkSession
        for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if "/lexiloom/" in path:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cleanup(spark: SparkSession) -> None:
    """Deletes every stored intermediate of the shared folder, those of results that may still be read included."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lexiloom")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_prefix(names: Iterable[str], wanted: str) -> str:
    """A prefix that none of the names begins with, whatever their case."""
    prefix, low = f"{wanted}_", [n.lower() for n in names]
    while any(n.startswith(prefix) for n in low):
        prefix = f"_{prefix}"
    return prefix


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hex_unit(text: Column) -> Column:
    """A draw in (0, 1) from the md5 of the text: its first 48 bits, and half a step. The same in any SQL."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
