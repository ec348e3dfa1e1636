"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.shared import forget, staged


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), root being the least node that it is connected with.

    Every pass links each node's greater neighbours to its least one (large star), then each node's lesser
    neighbours and itself to the least (small star); the links become stars around the roots in a number of passes
    that grows with the logarithm of the number of nodes. Least neighbours are pre-aggregated, so a node may have
    any number of links. Passes are stored, nothing is collected but a count and a checksum.
    """
    now = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("of")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), "m")
        small = large.join(least, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = staged(small.unionByName(least.select(F.col("of").alias("u"), F.col("m").alias("v"))).distinct(), "links")
        forget(now, large)
        now = after
        last, mark = mark, now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
