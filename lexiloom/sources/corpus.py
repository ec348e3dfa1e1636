"""Reading a corpus: manifest, digests, sources, facts and questions; and storing what was built from it.

Small descriptions (a manifest, a vocabulary) are parsed on the driver; files are read by Spark, so they may lie in any
store that it reads. Checks report everything that is wrong, not the first thing.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DOCUMENT = "doc_id string, title string, publisher string, year int, tier string, provenance string, filename string, sha256 string, rights string"
FACT = "fact_id string, question string, phrasing string, expected_value string, chunk_ids array<string>, tolerance double"
_SLUG = re.compile(r"^[a-z0-9]+(?:-[a-z0-9]+)*$")


class CorpusError(ValueError):
    """Everything that is wrong with an input, one line each."""


def whole_text(spark: SparkSession, path: str) -> str:
    """One small file as text, through Spark."""
    return spark.read.text(path, wholetext=True).first()["value"]


def parse_manifest(text: str) -> dict:
    """A manifest of version 1: corpus_id and documents of known fields with distinct ids and tiers A or B."""
    import yaml

    found = yaml.safe_load(text)
    if not isinstance(found, dict) or found.get("manifest_version") != 1 or not isinstance(found.get("documents"), list):
        raise CorpusError("the manifest needs manifest_version 1 and a list of documents")
    names, wrong = [c.split()[0] for c in DOCUMENT.split(", ")], []
    for i, d in enumerate(found["documents"]):
        wrong += [f"document {i}: {n} is missing" for n in names if n not in d] + [f"document {i}: {n} is not known" for n in d if n not in names]
        if d.get("tier") not in ("A", "B"):
            wrong.append(f"document {i}: tier is neither A nor B")
    ids = [d.get("doc_id") for d in found["documents"]]
    wrong += [f"{x} is there more than once" for x in sorted({x for x in ids if ids.count(x) > 1}, key=str)]
    if wrong:
        raise CorpusError("\n".join(wrong))
    return found


def corpus_hash(manifest: dict) -> str:
    """sha256 of the manifest as canonical JSON, documents by id."""
    ordered = {**manifest, "documents": sorted(manifest["documents"], key=lambda d: d["doc_id"])}
    return hashlib.sha256(json.dumps(ordered, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def manifest_table(spark: SparkSession, manifest: dict) -> DataFrame:
    names = [c.split()[0] for c in DOCUMENT.split(", ")]
    return spark.createDataFrame([tuple(d[n] for n in names) for d in manifest["documents"]], DOCUMENT)


def _folder(spark: SparkSession, folder: str) -> tuple[object, object]:
    """A folder's qualified path, and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(path), system


def _files(spark: SparkSession, sources: str) -> DataFrame:
    """(_file, content) of all files below a folder, by their path from there."""
    start = len(_folder(spark, sources)[0].toString()) + 2
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(sources).select(F.substr("path", F.lit(start)).alias("_file"), "content")


def verify_digests(documents: DataFrame, sources: str) -> DataFrame:
    """(doc_id, filename, problem) of every document whose file is missing or of another sha256; none if all is well. File
    names are paths from the folder of sources."""
    files = _files(documents.sparkSession, sources).select("_file", F.sha2("content", 256).alias("_digest"))
    joined = documents.join(files, F.col("filename") == F.col("_file"), "left")
    problem = F.when(F.col("_digest").isNull(), "missing").when(F.col("_digest") != F.col("sha256"), "mismatch")
    return joined.select("doc_id", "filename", problem.alias("problem")).where("problem is not null")


def source_texts(documents: DataFrame, sources: str) -> DataFrame:
    """documents with the text of their files."""
    files = _files(documents.sparkSession, sources).select("_file", F.col("content").cast("string").alias("text"))
    return documents.join(files, F.col("filename") == F.col("_file")).drop("_file")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw): the lines of text files, numbered from 1 in each, whatever their size. Lines of each block of a file are
    counted where they are read, and the counts of the blocks before are added; only line feeds end a line."""
    read = spark.read.option("lineSep", "\n").text(path).select("_metadata.file_path", "_metadata.file_block_start", F.col("value").alias("raw"), F.monotonically_increasing_id().alias("_id"))
    blocks = read.groupBy(F.col("file_path").alias("_file"), F.col("file_block_start").alias("_start")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1))
    offsets = blocks.select("_file", "_start", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("file_path", "file_block_start").orderBy("_id"))
    return read.withColumn("_own", own).join(offsets, (F.col("file_path") == F.col("_file")) & (F.col("file_block_start") == F.col("_start"))).select(F.col("file_path").alias("file"), (F.col("_before") + F.col("_own")).alias("line"), "raw")


def _parsed(lines: DataFrame, fields: str) -> DataFrame:
    return lines.withColumn("row", F.from_json("raw", fields + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))


def _again(rows: DataFrame, key: str) -> DataFrame:
    """rows with ``again``: whether an earlier line has the same key, null being a key like any other."""
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct("file", "line")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    return rows.join(first.drop("_n"), F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("again", F.coalesce(F.struct("file", "line") > F.col("_first"), F.lit(False)))


def fact_problems(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, place, problem): all that is wrong with the lines of a fact set, however many; place orders a line's problems."""
    rows = _parsed(numbered_lines(spark, path), FACT)
    blank = F.col("raw").rlike(r"^\s*$")
    malformed = F.col("row").isNull() | F.col("row._corrupt").isNotNull() | (F.coalesce("row.question", F.lit("")) == "") | F.col("row.expected_value").isNull()
    whole = _again(rows.where(~blank & ~malformed).select("file", "line", "row.*"), "fact_id")
    ids = F.col("chunk_ids")
    each = F.array(
        F.when(~F.coalesce(F.col("fact_id").rlike(_SLUG.pattern), F.lit(False)), "fact_id is not a slug"),
        F.when(F.col("again"), F.concat(F.lit("fact_id "), F.coalesce("fact_id", F.lit("None")), F.lit(" again"))),
        F.when(~F.coalesce(F.col("phrasing").isin("keyword", "natural"), F.lit(False)), "phrasing"),
        F.when(ids.isNull() | (F.size(ids) == 0) | (F.size(F.array_distinct(ids)) < F.size(ids)), "chunk_ids"),
        F.when(F.col("tolerance") <= 0, "tolerance"),
    )
    broken = rows.where(blank | malformed).select("file", "line", F.lit(0).alias("place"), F.when(blank, "blank").otherwise("malformed").alias("problem"))
    return broken.unionByName(whole.select("file", "line", F.posexplode(each).alias("place", "problem")).where("problem is not null"))


def question_problems(spark: SparkSession, path: str) -> DataFrame:
    """The same for questions, whose blank lines are passed over."""
    rows = _parsed(numbered_lines(spark, path).where(~F.col("raw").rlike(r"^\s*$")), _QUESTION)
    malformed = F.col("row").isNull() | F.col("row._corrupt").isNotNull() | F.col("row.question_id").isNull() | F.col("row.question").isNull()
    broken = rows.where(malformed).select("file", "line", F.lit(0).alias("place"), F.lit("malformed").alias("problem"))
    again = _again(rows.where(~malformed).select("file", "line", "row.question_id"), "question_id").where("again")
    return broken.unionByName(again.select("file", "line", F.lit(1).alias("place"), F.concat(F.lit("question_id "), F.col("question_id"), F.lit(" again")).alias("problem")))


#: Problems that an error spells out; the tables of problems have them all.
TOLD = 1_000
_QUESTION = "question_id string, question string, why string"


def _refuse(problems: DataFrame) -> None:
    """An error that names the first problems, if there are any."""
    first = problems.orderBy("file", "line", "place").head(TOLD + 1)
    if first:
        files = len({r["file"] for r in first})
        told = [(f"{r['file']}: " if files > 1 else "") + f"line {r['line']}: {r['problem']}" for r in first[:TOLD]]
        raise CorpusError("\n".join(told + (["and more"] if len(first) > TOLD else [])))


def load_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts of a JSON-lines file. A blank line, a malformed one, a fact id that isn't a slug or is there twice, no or
    repeated chunk ids, a tolerance that isn't positive, or an empty file is an error that names its line; ``fact_problems`` is
    the table of these."""
    _refuse(fact_problems(spark, path))
    facts = _parsed(spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "raw"), FACT).select("row.*").drop("_corrupt")
    if facts.isEmpty():
        raise CorpusError("no facts")
    return facts


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions (question_id, question, why) of a JSON-lines file; blank lines are passed over, malformed ones and ids that come
    again are errors."""
    _refuse(question_problems(spark, path))
    return _parsed(spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", "raw").where(~F.col("raw").rlike(r"^\s*$")), _QUESTION).select("row.question_id", "row.question", "row.why")


def load_vocabulary(text: str) -> list[dict]:
    """Terms of a vocabulary: a list of term, canonical and notes, terms distinct."""
    import yaml

    found = yaml.safe_load(text)
    found = found.get("terms") if isinstance(found, dict) else found
    if not isinstance(found, list) or not found or any(not isinstance(t, dict) or not t.get("term") or not t.get("canonical") for t in found):
        raise CorpusError("a vocabulary is a list of terms with a term and its canonical form")
    terms = [t["term"] for t in found]
    if len(set(terms)) < len(terms):
        raise CorpusError("a term is there more than once")
    return found


class Artifact:
    """Tables built together. A build writes to a folder of its own and becomes the current one by a last, one-row table, so
    that readers see the old tables or the new ones, never some of each."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, tables: dict[str, DataFrame], meta: dict[str, str]) -> str:
        name = uuid.uuid4().hex
        for table, df in tables.items():
            df.write.parquet(f"{self.folder}/{name}/{table}")
        pointer = self.spark.createDataFrame([(name, json.dumps(meta, sort_keys=True))], "build string, meta string")
        pointer.withColumn("built_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.folder}/CURRENT")
        return name

    def has(self, name: str) -> bool:
        """Whether the folder, or something of that name in it, is there."""
        path, system = _folder(self.spark, f"{self.folder}/{name}")
        return system.exists(path)

    def verified(self, expected: dict[str, object]) -> dict[str, str]:
        """The current build's meta if it holds what is expected, value by value; else an error that names all that differ. What
        is expected to be null is not looked at."""
        if not self.has("CURRENT"):
            raise CorpusError(f"nothing was ever built in {self.folder}")
        meta = self.current()[1]
        wrong = [f"{k}: built with {meta.get(k)}, expected {v}" for k, v in expected.items() if v is not None and meta.get(k) != v]
        if wrong:
            raise CorpusError("\n".join(wrong))
        return meta

    def current(self) -> tuple[str, dict[str, str]]:
        row = self.spark.read.parquet(f"{self.folder}/CURRENT").orderBy(F.desc("built_at"), F.desc("build")).first()
        return row["build"], json.loads(row["meta"])

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.current()[0]}/{name}")


def violations(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(rule, n): how often the constraints of an artifact's tables are broken: distinct ids, known tiers and kinds, chunks
    of known documents, gapless ordinals."""
    kinds = chunks.agg(F.count_if(~F.col("kind").isin("spec", "procedure", "prose")).alias("n")).withColumn("rule", F.lit("kind"))
    tiers = documents.agg(F.count_if(~F.col("tier").isin("A", "B")).alias("n")).withColumn("rule", F.lit("tier"))
    same = chunks.groupBy("chunk_id").count().where("count > 1").agg(F.count("*").alias("n")).withColumn("rule", F.lit("chunk_id"))
    lost = chunks.join(documents, "doc_id", "left_anti").agg(F.count("*").alias("n")).withColumn("rule", F.lit("doc_id"))
    gaps = chunks.groupBy("doc_id").agg(F.max("ordinal").alias("m"), F.count("*").alias("c")).where("m + 1 <> c").agg(F.count("*").alias("n")).withColumn("rule", F.lit("ordinal"))
    return kinds.unionByName(tiers).unionByName(same).unionByName(lost).unionByName(gaps).select("rule", "n")
