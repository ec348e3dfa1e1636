"""Recorded draws: questions answered several times by each strategy, stored, checked and looked up.

The generator is passed in: a function of a question and its numbered context that gives (payload, tokens_in, tokens_out).
Rankings are made once for all questions of a strategy; only the generator is called question by question, on the driver by
``draw``, which suits a service that allows one caller, or in tasks by ``draw_in_tasks``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiloom.functions.text import normalize_question
from lexiloom.operators import answers
from lexiloom.operators.retrievers import Retriever

Generate = Callable[[str, str], tuple[str, int, int]]
DRAWS = "strategy string, qid string, question string, sample int, context array<string>, payload string, tokens_in long, tokens_out long, retrieve_ms double, generate_ms double"
#: Fields of source text: these don't go into a record.
TEXT_FIELDS = ("text", "section", "prompt")


def draw(retrievers: dict[str, Retriever], questions: DataFrame, chunks: DataFrame, generate: Generate, n: int = 3, k: int = 10, wait: float = 0.0) -> DataFrame:
    """n draws of every question by every strategy. A question for which nothing is retrieved is not asked: it abstains at no
    cost. A generator that raises leaves a null payload."""
    spark, rows = questions.sparkSession, []
    asked = {str(r["qid"]): r["question"] for r in questions.select("qid", "question").collect()}
    for name, retriever in retrievers.items():
        began = time.monotonic()
        ranked = retriever.retrieve(questions, k).join(chunks, "chunk_id")
        contexts = {str(r["qid"]): (r["context"], r["prompt"]) for r in answers.numbered_context(ranked).collect()}
        spent = (time.monotonic() - began) * 1000 / max(1, len(asked))
        for qid, question in asked.items():
            context, prompt = contexts.get(qid, ([], ""))
            for sample in range(n):
                payload, t_in, t_out, took = '{"abstained": true, "claims": []}', 0, 0, None
                if context:
                    began = time.monotonic()
                    try:
                        payload, t_in, t_out = generate(question, prompt)
                    except Exception:  # the answer degrades, the record goes on
                        payload = None
                    took = (time.monotonic() - began) * 1000
                    time.sleep(wait)
                rows.append((name, qid, question, sample, list(context), payload, t_in, t_out, spent, took))
    return spark.createDataFrame(rows, DRAWS)


def draw_in_tasks(retrievers: dict[str, Retriever], questions: DataFrame, chunks: DataFrame, generate: Generate, n: int = 3, k: int = 10, tasks: int = 8, wait: float = 0.0) -> DataFrame:
    """The same rows, except that retrieve_ms is null, with the generator called in ``tasks`` tasks: nothing passes through the driver.
    The generator travels to the tasks, each of which waits between its own calls; a draw that is made again after a
    task was lost calls it again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                payload, t_in, t_out, took = '{"abstained": true, "claims": []}', 0, 0, None
                context = list(r.context) if r.context is not None else []
                if context:
                    began = time.monotonic()
                    try:
                        payload, t_in, t_out = generate(r.question, r.prompt)
                    except Exception:  # the answer degrades, the record goes on
                        payload = None
                    took = (time.monotonic() - began) * 1000
                    time.sleep(wait)
                out.append((r.strategy, r.qid, r.question, r.sample, context, payload, t_in, t_out, None, took))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DRAWS.split(", ")]).astype({"sample": "int32", "retrieve_ms": "float64", "generate_ms": "float64"})

    parts: DataFrame | None = None
    for name, retriever in retrievers.items():
        context = answers.numbered_context(retriever.retrieve(questions, k).join(chunks, "chunk_id")).select(F.col("qid").alias("_qid"), "context", "prompt")
        one = questions.join(context, F.col("qid") == F.col("_qid"), "left").select(F.lit(name).alias("strategy"), F.col("qid").cast("string").alias("qid"), "question", "context", "prompt")
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        return questions.sparkSession.createDataFrame([], DRAWS)
    asked = parts.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return asked.repartition(tasks, "strategy", "qid", "sample").mapInPandas(run, DRAWS)


def precomputed(records: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (question, strategy, k, tiers, contract, corpus_hash) with the newest record of the same axes, or null: the
    question in its normal form, tiers in any order, and the corpus as it is now."""
    axes = ["strategy", "k", "contract", "corpus_hash"]
    keyed = lambda df: df.withColumn("_q", normalize_question(F.col("question"))).withColumn("_t", F.sort_array("tiers"))
    newest = W.partitionBy("_q", "_t", *axes).orderBy(F.desc("recorded_at"), F.desc("record_id"))
    one = keyed(records).withColumn("_n", F.row_number().over(newest)).where("_n = 1").select("_q", "_t", *axes, "record_id")
    return keyed(asked).join(one, ["_q", "_t", *axes], "left").drop("_q", "_t")


def diverges(record: dict[str, object], identity: dict[str, object]) -> list[str]:
    """The axes of identity in which a record differs from the artifact that is served."""
    return [k for k in ("corpus_hash", "ingest_version", "analyzer_version", "embedder") if record.get(k) != identity.get(k)]


def for_record(df: DataFrame) -> DataFrame:
    """df without the fields that hold source text."""
    return df.drop(*TEXT_FIELDS)
