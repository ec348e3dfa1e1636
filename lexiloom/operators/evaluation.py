"""Ranking quality of many questions at once, and the gate that compares two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiloom.functions import metrics as M
from lexiloom.functions.text import value_matches

CUTS = (1, 5, 10)


def ranked_lists(ranking: DataFrame, facts: DataFrame) -> DataFrame:
    """facts (qid, relevant, ...) with ``ranked``, the ids of ranking (qid, id, position) in order. A question without any
    result keeps an empty list."""
    lists = ranking.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("position", "id"))).alias("_all")).select("qid", F.col("_all.id").alias("ranked"))
    kind = ranking.schema["id"].dataType.simpleString()
    return facts.join(lists, "qid", "left").withColumn("ranked", F.coalesce("ranked", F.array().cast(f"array<{kind}>")))


def per_question(lists: DataFrame, k: int = 10) -> DataFrame:
    """The metrics of each question (ranked, relevant): recalls, reciprocal rank, ndcg, hit rank, precision, candidates."""
    r, w = F.col("ranked"), F.col("relevant")
    recalls = [M.recall_at(r, w, c).alias(f"recall_{c}") for c in CUTS]
    rest = [F.round(M.reciprocal_rank(r, w, k), 6).alias("rr"), F.round(M.ndcg_at(r, w, k), 6).alias("ndcg"), M.hit_rank(r, w, k).alias("hit_rank"), M.precision_at(r, w, k).alias("precision"), F.size(F.slice(r, 1, k)).alias("candidates")]
    return lists.select("*", *recalls, *rest)


def per_flagged(ranking: DataFrame, facts: DataFrame, k: int = 10) -> DataFrame:
    """The same metrics for facts (qid, n_relevant, ...) of which only the number of relevant ids is known, from a ranking (qid, id,
    position, hit) of which each row says whether its id is relevant: no list of all that is relevant is made. A question without
    any result keeps an empty ``ranked``."""
    lists = ranking.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("position", "id", "hit"))).alias("_all")).select(F.col("qid").alias("_qid"), F.col("_all.id").alias("ranked"), F.transform("_all", lambda x: F.coalesce(x["hit"], F.lit(False))).alias("_hits"))
    kind = ranking.schema["id"].dataType.simpleString()
    joined = facts.join(lists, F.col("qid") == F.col("_qid"), "left").drop("_qid").withColumn("ranked", F.coalesce("ranked", F.array().cast(f"array<{kind}>"))).withColumn("_hits", F.coalesce("_hits", F.array().cast("array<boolean>")))
    places = F.filter(F.transform(F.slice("_hits", 1, k), lambda h, i: F.when(h, i + 1)), lambda p: p.isNotNull())
    n = F.col("n_relevant")
    gain = lambda p: 1.0 / F.log2(p.cast("double") + 1.0)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, p: a + gain(p))
    ideal = total(F.when(n > 0, F.sequence(F.lit(1), F.least(n, F.lit(k)).cast("int"))).otherwise(F.array().cast("array<int>")))
    within = lambda c: lambda p: p <= c
    recalls = [F.try_divide(F.size(F.filter("_places", within(c))).cast("double"), n).alias(f"recall_{c}") for c in CUTS]
    rest = [
        F.round(F.coalesce(1.0 / F.array_min("_places"), F.lit(0.0)), 6).alias("rr"),
        F.round(F.when(ideal > 0, total(F.col("_places")) / ideal).otherwise(0.0), 6).alias("ndcg"),
        F.array_min("_places").alias("hit_rank"),
        (F.size("_places") / F.lit(float(k))).alias("precision"),
        F.size(F.slice("ranked", 1, k)).alias("candidates"),
    ]
    return joined.withColumn("_places", places).select("*", *recalls, *rest).drop("_hits", "_places")


def with_value_match(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """items (ranked, expected_value, tolerance) with ``value_matched``: whether the text of the first result, and of no other,
    states the expected value. A question without results, or whose first one is not in chunks (id, text), does not match."""
    texts = chunks.select(F.col("id").alias("_first"), F.col("text").alias("_stated"))
    first = items.withColumn("_first", F.get("ranked", F.lit(0))).join(texts, "_first", "left")
    return first.withColumn("value_matched", F.coalesce(value_matches(F.col("expected_value"), F.col("_stated"), F.col("tolerance")), F.lit(False))).drop("_first", "_stated")


def _means(items: DataFrame) -> list[Column]:
    mean = lambda c, name: F.round(F.avg(c) + 1e-9, 6).alias(name)  # noqa: E731  of rounded values: halves go up
    valued = [mean(F.col("value_matched").cast("double"), "value_match_at_1")] if "value_matched" in items.columns else []
    return [mean(f"recall_{c}", f"recall_at_{c}") for c in CUTS] + [mean("rr", "mrr"), mean("ndcg", "ndcg_at_k"), mean("precision", "precision_at_k"), mean("candidates", "candidates_at_k"), *valued]


def aggregate(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over questions, of 6 decimals, misses counting as 0; for each group of ``by`` if given. The share of value matches
    is among them where ``with_value_match`` has been asked."""
    return items.groupBy(*(by or [])).agg(F.count("*").alias("questions"), *_means(items))


def measured(items: DataFrame, k: int = 10) -> DataFrame:
    """(metric, value) of a run, under the names that a baseline has: the means over all questions, and recall at k for each
    ``phrasing`` that occurs. Both come from one pass; no questions give no rows."""
    names = {f"recall_at_{c}": f"recall@{c}" for c in CUTS} | {"mrr": f"mrr@{k}", "ndcg_at_k": f"ndcg@{k}", "precision_at_k": f"precision@{k}", "candidates_at_k": f"candidates@{k}", "value_match_at_1": "value_match@1"}
    sets = items.groupingSets([[], ["phrasing"]], "phrasing").agg(F.grouping("phrasing").alias("_all"), *_means(items))
    pair = lambda name, c: F.struct(name.alias("metric"), F.col(c).alias("value"))
    whole = F.array(*[pair(F.lit(n), c) for c, n in names.items() if c in sets.columns])
    part = F.array(pair(F.concat(F.lit(f"recall@{k}:"), F.col("phrasing")), f"recall_at_{k}"))
    return sets.where("_all = 1 OR phrasing IS NOT NULL").select(F.explode(F.when(F.col("_all") == 1, whole).otherwise(part)).alias("m")).select("m.metric", "m.value")


def histogram(items: DataFrame) -> DataFrame:
    """(hit_rank, questions): how often the first hit stands where; ``miss`` for none."""
    return items.groupBy(F.coalesce(F.col("hit_rank").cast("string"), F.lit("miss")).alias("hit_rank")).agg(F.count("*").alias("questions"))


def gate(baseline: DataFrame, run: DataFrame, tolerance: float, noise: float = 0.0) -> DataFrame:
    """Compares (strategy, metric, value, gated) with (strategy, metric, value): a row for each metric of either, with its
    delta and a verdict: ``missing`` (gated and not measured), ``failed`` (gated and below by more than the tolerance),
    ``improved`` (above by more than the noise), ``new`` (not in the baseline), ``ok``."""
    old = baseline.select("strategy", "metric", F.col("value").alias("promoted"), "gated")
    both = old.join(run.select("strategy", "metric", F.col("value").alias("measured")), ["strategy", "metric"], "full")
    delta = F.round(F.col("measured") - F.col("promoted"), 6)
    gated = F.coalesce("gated", F.lit(False))
    verdict: Column = (
        F.when(F.col("promoted").isNull(), "new")
        .when(F.col("measured").isNull(), F.when(gated, "missing").otherwise("ok"))
        .when(gated & (-delta > tolerance), "failed")
        .when(delta > noise, "improved")
        .otherwise("ok")
    )
    return both.select("strategy", "metric", "promoted", "measured", delta.alias("delta"), F.when(gated, F.round(F.col("promoted") - tolerance, 6)).alias("floor"), verdict.alias("verdict"))


def moved(before: DataFrame, after: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Questions (qid, hit_rank) whose first hit moved; a miss is null and equal to a miss. ``on``: what names a question."""
    on = on or ["qid"]
    b, a = before.select(*on, F.col("hit_rank").alias("before")), after.select(*on, F.col("hit_rank").alias("after"))
    return b.join(a, on).where(~F.col("before").eqNullSafe(F.col("after")))


def compare(baseline_arms: DataFrame, run_arms: DataFrame, baseline: DataFrame, run: DataFrame, tolerance: float, noise: float = 0.0, before: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
    """All that a gate finds: (strategy, finding, subject, before, after, fails).

    Arms are (strategy, position, configuration, facts_digest, sample_count); metrics as in ``gate``; before and after, if given,
    (strategy, qid, hit_rank) of both runs. Failures: ``facts_changed`` and ``questions_lost`` (no strategy), ``missing_arm``,
    ``configuration_changed``, and for gated metrics ``missing`` and ``failed``. Notes: ``improved``, ``moved`` (by question)
    and ``new_arm``. An arm's metrics and questions are compared only while nothing fails: neither the whole runs, nor
    the arm itself, nor an arm of an earlier position. Arms are as many as strategies: they may share one task.
    """
    old = baseline_arms.select("strategy", "position", F.col("configuration").alias("before"), F.col("facts_digest").alias("old_digest"), F.col("sample_count").alias("old_count"))
    new = run_arms.select("strategy", F.col("configuration").alias("after"), F.col("facts_digest").alias("new_digest"), F.col("sample_count").alias("new_count"), F.lit(True).alias("measured"))
    verdicts = gate(baseline, run, tolerance, noise).where("floor IS NOT NULL")
    worst = verdicts.groupBy("strategy").agg(F.bool_or(F.col("verdict").isin("missing", "failed")).alias("worse"))
    every, earlier = W.partitionBy(), W.partitionBy().orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    state = old.join(new, "strategy", "full").join(worst, "strategy", "left")
    for c in ("old_digest", "old_count", "new_digest", "new_count"):
        state = state.withColumn(c, F.min(c).over(every))
    own = F.when(F.col("position").isNull(), "new_arm").when(F.col("measured").isNull(), "missing_arm").when(~F.col("before").eqNullSafe(F.col("after")), "configuration_changed")
    state = state.withColumn("finding", own).withColumn("_digest", ~F.col("old_digest").eqNullSafe(F.col("new_digest"))).withColumn("_lost", F.coalesce(F.col("new_count") < F.col("old_count"), F.lit(False)))
    bad = F.col("position").isNotNull() & (F.col("finding").isNotNull() | F.coalesce("worse", F.lit(False)))
    state = state.withColumn("_stopped", F.coalesce(F.bool_or(bad).over(earlier), F.lit(False)) | F.col("_digest") | F.col("_lost"))
    none = F.lit(None).cast("string")

    def found(df: DataFrame, strategy: Column, finding: Column, subject: Column, was: Column, now: Column, fails: Column) -> DataFrame:
        return df.select(strategy.alias("strategy"), finding.alias("finding"), subject.alias("subject"), was.cast("string").alias("before"), now.cast("string").alias("after"), fails.alias("fails"))

    heads = state.select("_digest", "_lost", "old_digest", "new_digest", "old_count", "new_count").distinct()
    parts = [
        found(heads.where("_digest"), none, F.lit("facts_changed"), none, F.col("old_digest"), F.col("new_digest"), F.lit(True)),
        found(heads.where("_lost"), none, F.lit("questions_lost"), none, F.col("old_count"), F.col("new_count"), F.lit(True)),
        found(state.where("finding IS NOT NULL"), F.col("strategy"), F.col("finding"), none, F.col("before"), F.col("after"), F.col("finding") != "new_arm"),
    ]
    compared = state.where("finding IS NULL AND NOT _stopped").select("strategy")
    number = lambda c: F.format_string("%.6f", c)
    changed = verdicts.where("verdict IN ('missing', 'failed', 'improved')").join(compared, "strategy")
    now = F.when(F.col("measured").isNotNull(), number("measured"))
    parts.append(found(changed, F.col("strategy"), F.col("verdict"), F.col("metric"), number("promoted"), now, F.col("verdict") != "improved"))
    if before is not None and after is not None:
        both = moved(before, after, ["strategy", "qid"]).join(compared, "strategy")
        parts.append(found(both, F.col("strategy"), F.lit("moved"), F.col("qid").cast("string"), F.col("before"), F.col("after"), F.lit(False)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def promoted(run: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """A baseline (strategy, metric, value, gated) of a run: gates carry over from the previous one, new arms are ungated."""
    if previous is None:
        return run.select("strategy", "metric", "value", F.lit(False).alias("gated"))
    return run.join(previous.select("strategy", "metric", "gated"), ["strategy", "metric"], "left").select("strategy", "metric", "value", F.coalesce("gated", F.lit(False)).alias("gated"))
