"""A whole measurement as a record: every strategy over a fact set; its promotion to a baseline, and the gate against one.

Records and baselines are nested dictionaries of as many rows as there are strategies, metrics and facts, the stated set of
questions. The comparison itself is ``evaluation.compare``.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.embedding import Embedder
from lexiloom.operators import evaluation, runs
from lexiloom.operators.retrievers import available
from lexiloom.sources import corpus

RUN_FIELDS = frozenset({"record_version", "run_id", "provenance", "sample_count", "facts_digest", "arms"})
BASELINE_FIELDS = RUN_FIELDS - {"provenance"} | {"tolerance", "noise_floor"}


def identity(embedder: Embedder | None, corpus_hash: str | None = None) -> dict[str, object]:
    """What an artifact must have been built with to be measured or served: corpus, rules, and the embedder if one is asked for."""
    of = {"model_key": embedder.model_key, "embedder": embedder.fingerprint, "dimension": embedder.dimension} if embedder else {}
    return {"corpus_hash": corpus_hash, "analyzer_version": runs.ANALYZER_VERSION, **of}


def wrong_dimensions(embeddings: DataFrame, dimension: int) -> list[str]:
    """The chunks whose vectors aren't of that many numbers, null ones included."""
    bad = embeddings.where(F.coalesce(F.size("embedding") != dimension, F.lit(True)))
    return [f"{r['chunk_id']}: {r['n']} numbers, not {dimension}" for r in bad.select("chunk_id", F.size("embedding").alias("n")).orderBy("chunk_id").collect()]


def measured_run(spark: SparkSession, artifact: corpus.Artifact, facts_path: str, embedder: Embedder | None, now: dt.datetime, corpus_hash: str | None = None, k: int = 10) -> dict[str, object]:
    """The record of a run. First the artifact is checked, then that it holds every chunk that the facts name, then each strategy
    ranks all facts in one job. An error names everything that is wrong."""
    meta = artifact.verified(identity(embedder, corpus_hash))
    facts = corpus.load_facts(spark, facts_path).select(F.col("fact_id").alias("qid"), "question", "phrasing", "expected_value", "tolerance", F.col("chunk_ids").alias("relevant"))
    chunks = artifact.table("chunks")
    lost = facts.select(F.explode("relevant").alias("chunk_id")).join(chunks, "chunk_id", "left_anti").distinct().collect()
    if lost:
        raise corpus.CorpusError("chunks that aren't stored: " + ", ".join(sorted(r["chunk_id"] for r in lost)))
    arms = []
    for name, retriever in available(chunks, artifact.table("embeddings") if embedder else None, embedder).items():
        ranking = retriever.retrieve(facts.select("qid", "question"), k).select("qid", "position", F.col("chunk_id").alias("id"))
        items = evaluation.with_value_match(evaluation.per_question(evaluation.ranked_lists(ranking, facts), k), chunks.select(F.col("chunk_id").alias("id"), "text")).persist()
        per_item = [r.asDict() for r in items.select("qid", "hit_rank", "rr", "ndcg", "value_matched", "ranked").orderBy("qid").collect()]
        metrics = {r["metric"]: r["value"] for r in evaluation.measured(items, k).collect()}
        items.unpersist()
        configuration = {"strategy": name, "k": k, "tiers": ["A", "B"], "embedder": embedder.fingerprint if embedder and name != "lexical" else None}
        arms.append({"configuration": configuration, "metrics": metrics, "per_item": per_item})
    digest = hashlib.sha256(corpus.whole_text(spark, facts_path).encode()).hexdigest()
    return {"run_id": runs.compact(now), "provenance": runs.provenance(spark, meta, now), "sample_count": len(arms[0]["per_item"]), "facts_digest": digest, "arms": arms}


def promoted(record: dict[str, object], previous: dict[str, object] | None, tolerance: float = 0.014, noise_floor: float = 0.0) -> dict[str, object]:
    """A baseline of a run: its gates, tolerance and noise floor carry over from the previous baseline; an arm that it doesn't
    have gates nothing. A metric that was gated and isn't measured is an error."""
    gates = {a["configuration"]["strategy"]: a["gated_metrics"] for a in previous["arms"]} if previous else {}
    arms = []
    for a in record["arms"]:
        name = a["configuration"]["strategy"]
        gone = sorted(set(gates.get(name, ())) - set(a["metrics"]))
        if gone:
            raise corpus.CorpusError(f"{name}: gated and not measured: {', '.join(gone)}")
        arms.append({"configuration": a["configuration"], "metrics": a["metrics"], "gated_metrics": sorted(gates.get(name, ()))})
    policy = {k: previous[k] for k in ("tolerance", "noise_floor")} if previous else {"tolerance": tolerance, "noise_floor": noise_floor}
    return {"run_id": record["run_id"], "sample_count": record["sample_count"], "facts_digest": record["facts_digest"], "arms": arms, **policy}


def findings(spark: SparkSession, baseline: dict[str, object], record: dict[str, object], before: dict[str, object] | None = None) -> DataFrame:
    """``evaluation.compare`` of a baseline and a record; before: the record that the baseline was promoted from."""

    def arms(of: dict) -> DataFrame:
        rows = [(a["configuration"]["strategy"], i, runs.canonical(a["configuration"]), of["facts_digest"], of["sample_count"]) for i, a in enumerate(of["arms"])]
        return spark.createDataFrame(rows, "strategy string, position int, configuration string, facts_digest string, sample_count int")

    def values(of: dict) -> DataFrame:
        rows = [(a["configuration"]["strategy"], m, float(v), m in a.get("gated_metrics", ())) for a in of["arms"] for m, v in a["metrics"].items()]
        return spark.createDataFrame(rows, "strategy string, metric string, value double, gated boolean")

    def hits(of: dict) -> DataFrame:
        rows = [(a["configuration"]["strategy"], i["qid"], i["hit_rank"]) for a in of["arms"] for i in a["per_item"]]
        return spark.createDataFrame(rows, "strategy string, qid string, hit_rank int")

    moved = (hits(before), hits(record)) if before else (None, None)
    return evaluation.compare(arms(baseline), arms(record), values(baseline), values(record), baseline["tolerance"], baseline["noise_floor"], *moved)


def gate_problems(spark: SparkSession, record: dict[str, object], runs_folder: str, baselines_folder: str) -> tuple[list[str], list[str]]:
    """(failures, notes) of a run against the newest baseline; besides, the run that the baseline names must be stored, and the
    newest stored run must be what is measured now."""
    baseline = runs.read_record(spark, baselines_folder, fields=BASELINE_FIELDS)
    failures, notes, before, newest = [], [], None, None
    try:
        before = runs.read_record(spark, runs_folder, baseline["run_id"], RUN_FIELDS)
        newest = runs.read_record(spark, runs_folder, fields=RUN_FIELDS)
    except LookupError as missing:
        failures.append(f"the baseline's run: {missing}")
    for r in findings(spark, baseline, record, before).orderBy("strategy", "finding", "subject").collect():
        line = f"{r['strategy'] or 'run'}: {r['finding']} {r['subject'] or ''} {r['before']} -> {r['after']}"
        (failures if r["fails"] else notes).append(line)
    if newest is not None and runs.canonical(runs.measurement(newest)) != runs.canonical(runs.measurement({"record_version": runs.RECORD_VERSION, **record})):
        failures.append(f"the newest stored run, {newest['run_id']}, is not what is measured now")
    notes += [f"{a['configuration']['strategy']}: gates nothing" for a in baseline["arms"] if not a["gated_metrics"]]
    return failures, notes
