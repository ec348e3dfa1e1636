"""A training-data pipeline: language, near duplicates, secrets, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is stored and read again as the next one's docs.
All but the last return the columns of ``documents``: doc_id, text, lang, source, n_chars; further columns of docs,
whatever their names, end with the first stage. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import jaccard, language, mixing, packing, secrets
from lexiloom.llm.shared import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates: shingles of five words, a similarity of 0.8 or more.
RULE = jaccard.Rule(words=5, num=80, den=100)
#: The id that ends a document in the packed sequences, and the vocabulary file.
END_ID, VOCABULARY = 1, "byte_bpe_50k.json"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language: null texts, texts without letters, and those no more like a language than chance.

    Prototypes are learned from the labelled documents that aren't held out, and so is which lengths can be judged:
    shorter texts stay. A null lang gets the prediction if that is better than chance; with no labelled document at all there is nothing to reject by, and every text with a letter stays, its lang as it was.
    """
    docs = docs.select(*COLUMNS)
    learned = docs.where(~language.held_out(F.col("doc_id")))
    prototypes = language.learn(learned)
    if not prototypes:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.identify(docs, prototypes)
    can_judge = language.judged(language.identify(learned.where("lang is not null"), prototypes, carry=[]), len(prototypes))
    alike = F.col("lang_score") >= language.chance_score(len(prototypes))
    kept = found.where((F.col("lang_pred") != "und") & (alike | ~can_judge(F.col("lang_size"))))
    return kept.withColumn("lang", F.coalesce("lang", F.when(alike, F.col("lang_pred")))).select(*COLUMNS)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one of the least doc_id.

    Rows of equal doc_id and text count once; rows of equal doc_id and other texts are documents of their own, of which the
    one of the least text hash has the doc_id as its key. A row without doc_id stands behind those that have one. Documents
    without words are linked with nothing and stay.
    """
    surrogate = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    keyed = docs.select(*COLUMNS, F.coalesce("doc_id", surrogate).alias("_row"))
    texts = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.xxhash64("text")).alias("_least"), F.max(F.xxhash64("text")).alias("_most"))
    shared = staged(texts.where("_least <> _most").select("_id", "_least"), "shared_ids")
    repeated = not shared.isEmpty()
    if repeated:
        other = F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 61))
        keyed = keyed.join(shared, F.col("doc_id") == F.col("_id"), "left").withColumn("_row", F.when(F.xxhash64("text") != F.col("_least"), other).otherwise(F.col("_row"))).drop("_id", "_least")
    groups = staged(jaccard.near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text"), RULE), "duplicates")
    if repeated:
        # the least doc_id of a group isn't always its least key
        ids = keyed.select(F.col("_row").alias("_key"), F.col("doc_id").alias("_id")).distinct()
        named = groups.join(ids, F.col("doc_id") == F.col("_key")).select("doc_id", "component_id", "_id")
        first = named.groupBy(F.col("component_id").alias("_group")).agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "doc_id"))["doc_id"].alias("_first"))
        groups = staged(groups.join(first, F.col("component_id") == F.col("_group")).select("doc_id", F.col("_first").alias("component_id")), "groups")
    gone = staged(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    kept = keyed.join(gone, F.col("_row") == F.col("_gone"), "left_anti")
    if not groups.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_row", "text"])
    return kept.select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in a text by its kind; n_chars follows. No document goes."""
    return secrets.redact(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of the sources does: not at all, once or twice."""
    return mixing.mix(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of 2048: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(VOCABULARY), END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("near_duplicates", duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL expresses none of it: profiles, links, trades and token ids are tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each but the last is stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
