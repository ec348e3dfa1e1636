"""Runs as records: what made them, their canonical bytes, the rules they keep, and the cascade that answers a request."""

from __future__ import annotations

import datetime as dt
import json
import platform
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiloom.functions.analysis import ANALYZER_VERSION

RECORD_VERSION = 2
_FENCE = re.compile(r"(<!-- begin (\w[\w-]*) -->\n).*?(<!-- end \2 -->)", re.S)


def iso(moment: dt.datetime) -> str:
    return moment.astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def compact(moment: dt.datetime) -> str:
    return moment.astimezone(dt.UTC).strftime("%Y%m%dT%H%M%SZ")


def provenance(spark: SparkSession, meta: dict[str, object], now: dt.datetime) -> dict[str, object]:
    """What a run ran on, and the identity of the artifact it read."""
    return {**meta, "analyzer_version": ANALYZER_VERSION, "engine": f"spark {spark.version}", "python": platform.python_version(), "machine": platform.machine(), "at": iso(now)}


#: What need not be the same when a measurement is repeated.
VARIES = frozenset({"at", "python", "machine", "engine", "run_id"})


def measurement(record: dict[str, object]) -> dict[str, object]:
    """The part of a record that has to come out again."""
    return {k: {n: v for n, v in x.items() if n not in VARIES} if isinstance(x, dict) else x for k, x in record.items() if k not in VARIES}


def canonical(record: object) -> str:
    """Sorted keys, two blanks of indent, a line feed at the end."""
    return json.dumps(record, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def write_record(spark: SparkSession, folder: str, run_id: str, record: dict[str, object]) -> None:
    """One record under its id; ids are compact times, so that the greatest is the latest."""
    spark.createDataFrame([(run_id, canonical({"record_version": RECORD_VERSION, **record}))], "run_id string, record string").coalesce(1).write.mode("append").parquet(folder)


def read_record(spark: SparkSession, folder: str, run_id: str | None = None, fields: frozenset[str] | None = None) -> dict[str, object]:
    """The record of that id, or the latest. A record of another version is an error, and so is one of other fields than those
    that are asked for."""
    rows = spark.read.parquet(folder)
    row = (rows.where(F.col("run_id") == run_id) if run_id else rows.orderBy(F.desc("run_id"))).first()
    if row is None:
        raise LookupError(f"no record {run_id or 'at all'}")
    found = json.loads(row["record"])
    if found.get("record_version") != RECORD_VERSION:
        raise ValueError(f"record {row['run_id']} is of version {found.get('record_version')}")
    if fields is not None and set(found) != fields:
        raise ValueError(f"record {row['run_id']}: fields that are missing or not known: {', '.join(sorted(set(found) ^ fields))}")
    return found


def rewritten(document: str, name: str, block: str) -> str:
    """A Markdown document with the fenced block between the named marks replaced; without such marks an error."""
    out, n = _FENCE.subn(lambda m: f"{m[1]}```json\n{block.rstrip()}\n```\n{m[3]}" if m[2] == name else m[0], document)
    if not n or f"<!-- begin {name} -->" not in document:
        raise LookupError(f"no marks of {name}")
    return out


def broken_rules(arms: Iterable[dict]) -> list[str]:
    """What a run's arms break: one arm for each strategy, gated metrics measured, samples numbered from 0, spreads of as many
    values as samples, a displayed sample that is there."""
    wrong, seen = [], set()
    for a in arms:
        name = a["strategy"]
        if name in seen:
            wrong.append(f"{name}: more than one arm")
        seen.add(name)
        wrong += [f"{name}: {m} is gated and not measured" for m in a.get("gated", ()) if m not in a.get("metrics", {})]
        samples = a.get("samples", [])
        if [s.get("index") for s in samples] != list(range(len(samples))):
            wrong.append(f"{name}: samples aren't numbered from 0")
        wrong += [f"{name}: spread of {m} has {len(v)} values for {len(samples)} samples" for m, v in a.get("spreads", {}).items() if len(v) != len(samples)]
        if samples and not 0 <= a.get("displayed", 0) < len(samples):
            wrong.append(f"{name}: no displayed sample")
    return wrong


def rule_violations(arms: DataFrame, verbatim_limit: int = 25) -> DataFrame:
    """(record_id, strategy, rule) for each rule that an arm of recorded runs breaks.

    Arms are (record_id, strategy, gated, metrics: arrays of names; samples: array of indexes; spread_sizes: array;
    displayed; chunk_ids: array; worst_verbatim). A record has one arm for each strategy and as many samples in each; gated
    metrics are measured; samples are numbered from 0, every spread has as many values, the displayed one is there; the
    chunks of an arm are distinct; no claim repeats more than the limit of a source.
    """
    record = W.partitionBy("record_id")
    n = F.size("samples")
    seen = arms.withColumn("_same", F.count(F.lit(1)).over(W.partitionBy("record_id", "strategy"))).withColumn("_least", F.min(n).over(record)).withColumn("_most", F.max(n).over(record))
    numbered = F.transform("samples", lambda _, i: i)
    rules = {
        "more than one arm": F.col("_same") > 1,
        "gated and not measured": F.size(F.array_except("gated", "metrics")) > 0,
        "samples not numbered from 0": ~(F.col("samples") == numbered),
        "spread of another size": F.exists("spread_sizes", lambda s: s != n),
        "no displayed sample": (n > 0) & ~F.coalesce(F.col("displayed").between(0, n - 1), F.lit(False)),
        "arms of different samples": F.col("_least") != F.col("_most"),
        "chunk more than once": F.size(F.array_distinct("chunk_ids")) < F.size("chunk_ids"),
        "source repeated": F.col("worst_verbatim") > verbatim_limit,
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(name)) for name, v in rules.items()]), lambda r: r.isNotNull())
    return seen.select("record_id", "strategy", F.explode(broken).alias("rule")).distinct()


def sample_metrics(draws: DataFrame) -> DataFrame:
    """(strategy, qid, sample, metric, value) of validated draws: counts of claims, unsupported ones and invalid citations,
    tokens, cost and times; null where a draw has none."""
    wide = draws.select("strategy", "qid", "sample", *[F.col(c).cast("double").alias(c) for c in ("tokens_in", "tokens_out", "cost_usd", "invalid_citations", "unsupported_claims", "retrieve_ms", "generate_ms")], F.size("claims").cast("double").alias("claims"))
    metrics = [c for c in wide.columns if c not in ("strategy", "qid", "sample")]
    return wide.unpivot(["strategy", "qid", "sample"], metrics, "metric", "value")


def served(allowed: Column, recorded: Column, cached: Column, budget: Column, rerun: Column, degraded: Column) -> Column:
    """How a request is served: refused (429) by the rate limit; from a record or the cache unless it asks to run again; live
    while the budget lasts, degraded if the generator failed; without an answer when the budget is spent."""
    stored = F.when(recorded, "precomputed").when(cached, "cache")
    return F.when(~allowed, "refused").otherwise(F.coalesce(F.when(~rerun, stored), F.when(budget, F.when(degraded, "live_degraded").otherwise("live")), stored, F.lit("live_degraded")))


def first_duration(spans: DataFrame, name: str) -> DataFrame:
    """(trace_id, duration) of the first span of that name in each trace, depth first."""
    return spans.where(F.col("name") == name).groupBy("trace_id").agg(F.min_by(F.col("ended") - F.col("started"), F.struct("started", "span_id")).alias("duration"))
