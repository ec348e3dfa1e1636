"""Strategies behind one interface: retrieve(questions) gives (qid, position, chunk_id, score, components)."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiloom.functions.embedding import Embedder, embed
from lexiloom.functions.metrics import fused
from lexiloom.operators import dense, lexical
from lexiloom.sources.stored import cut


class Retriever(Protocol):
    name: str

    def retrieve(self, questions: DataFrame, k: int = 10, tiers: tuple[str, ...] | None = None) -> DataFrame: ...


def _tiered(chunks: DataFrame, tiers: tuple[str, ...] | None) -> DataFrame:
    if tiers is None:
        return chunks
    if not tiers or set(tiers) - {"A", "B"}:
        raise ValueError("tiers are A, B or both")
    return chunks.where(F.col("tier").isin(*tiers))


def _components(names: list[str]) -> Column:
    return F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))]).alias("components")


class Lexical:
    """Full text and trigrams; may find nothing."""

    name = "lexical"

    def __init__(self, chunks: DataFrame) -> None:
        self.chunks = chunks

    def retrieve(self, questions: DataFrame, k: int = 10, tiers: tuple[str, ...] | None = None) -> DataFrame:
        return self._named(lexical.retrieve(questions, self.chunks, k, tiers))

    def ranked(self, questions: DataFrame, k: int = 10, tiers: tuple[str, ...] | None = None) -> DataFrame:
        """The same without the similarities that rank nothing."""
        return self._named(lexical.ranked(questions, self.chunks, k, tiers))

    @staticmethod
    def _named(found: DataFrame) -> DataFrame:
        return found.select("qid", "position", "chunk_id", "score", _components(["lexical", "trigram", "lexical_rank", "trigram_rank"]))


class Dense:
    """Cosine over stored vectors of one model (chunk_id, model_key, embedding); always finds k where there are k."""

    name = "dense"

    def __init__(self, chunks: DataFrame, embeddings: DataFrame, embedder: Embedder) -> None:
        self.chunks, self.embeddings, self.embedder = chunks, embeddings, embedder

    def retrieve(self, questions: DataFrame, k: int = 10, tiers: tuple[str, ...] | None = None) -> DataFrame:
        own = self.embeddings.where(F.col("model_key") == self.embedder.model_key)
        # ids are hashed beside the vectors, which are neither sorted nor, where they lie by chunk_id, shuffled
        rows = _tiered(self.chunks, tiers).select("chunk_id").hint("shuffle_hash").join(own, "chunk_id").select("chunk_id", F.xxhash64("chunk_id").alias("id"), F.col("embedding").alias("vector"))
        asked = questions.select("qid", F.xxhash64(F.col("qid").cast("string"), F.lit("question")).alias("id"), embed(F.coalesce("question", F.lit("")), self.embedder, query=True).alias("vector"))
        found = lexical.sized(cut(dense.top_dense(rows.select("id", "vector"), asked.select("id", "vector"), k, keep_self=True)))
        keyed = found.withColumnRenamed("qid", "_asked").join(rows.select("id", "chunk_id"), "id").join(asked.select(F.col("id").alias("_asked"), "qid"), "_asked")
        order = W.partitionBy("qid").orderBy(F.desc("cosine"), "chunk_id")
        return keyed.withColumnRenamed("rank", "dense_rank").withColumn("position", F.row_number().over(order)).select("qid", "position", "chunk_id", F.col("cosine").alias("score"), _components(["cosine", "dense_rank"]))


class Hybrid:
    """Reciprocal ranks of three signals, full text, trigrams and cosine: an extension, fused by rank because cosines are
    far larger than the other two."""

    name = "hybrid"
    WEIGHTS = {"lexical_rank": 0.4, "trigram_rank": 0.2, "dense_rank": 0.4}

    def __init__(self, one: Lexical, other: Dense, pool: int = 50) -> None:
        self.one, self.other, self.pool = one, other, pool

    def retrieve(self, questions: DataFrame, k: int = 10, tiers: tuple[str, ...] | None = None) -> DataFrame:
        a = self.one.ranked(questions, self.pool, tiers).select("qid", "chunk_id", F.col("components").alias("a"))
        b = self.other.retrieve(questions, self.pool, tiers).select("qid", "chunk_id", F.col("components").alias("b"))
        both = a.join(b, ["qid", "chunk_id"], "full")
        ranks = {n: F.coalesce(F.try_element_at("a", F.lit(n)), F.try_element_at("b", F.lit(n))) for n in self.WEIGHTS}
        score = F.lit(0.0)
        for n, w in self.WEIGHTS.items():
            score = score + fused(w, ranks[n])
        scored = both.select("qid", "chunk_id", F.round(score, 12).alias("score"), *[r.alias(n) for n, r in ranks.items()])
        placed = scored.withColumn("position", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "chunk_id"))).where(F.col("position") <= dense.clamped(k))
        return placed.select("qid", "position", "chunk_id", "score", _components(list(self.WEIGHTS)))


def available(chunks: DataFrame, embeddings: DataFrame | None = None, embedder: Embedder | None = None) -> dict[str, Retriever]:
    """Strategies in the order of reports: lexical always, dense and hybrid with an embedder and its vectors."""
    found: dict[str, Retriever] = {"lexical": Lexical(chunks)}
    if embedder is not None and embeddings is not None:
        found["dense"] = Dense(chunks, embeddings, embedder)
        found["hybrid"] = Hybrid(found["lexical"], found["dense"])
    return found
