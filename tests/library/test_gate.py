"""The whole comparison of two runs, metrics by phrasing, value matches, and the rules of records."""

import pytest

from lexiloom.operators import evaluation, records, runs
from lexiloom.streaming import policies

METRICS = {"recall@1": 0.9, "mrr@10": 0.95}


def _arms(spark, *arms, digest="a", count=40):
    rows = [(s, i, c, digest, count) for i, (s, c) in enumerate(arms)]
    return spark.createDataFrame(rows, "strategy string, position int, configuration string, facts_digest string, sample_count int")


def _values(spark, **arms):
    rows = [(s, m, v, True) for s, values in arms.items() for m, v in values.items()]
    return spark.createDataFrame(rows, "strategy string, metric string, value double, gated boolean")


def _found(df):
    return {(r["strategy"], r["finding"], r["subject"]): r["fails"] for r in df.collect()}


LEXICAL = ("lexical", "k=10")


@pytest.mark.parametrize(
    "now, want",
    [
        (METRICS, {}),
        ({"recall@1": 0.89, "mrr@10": 0.95}, {}),
        ({"recall@1": 0.87, "mrr@10": 0.95}, {("lexical", "failed", "recall@1"): True}),
        ({"recall@1": 0.94, "mrr@10": 0.95}, {("lexical", "improved", "recall@1"): False}),
        ({"recall@1": 0.905, "mrr@10": 0.95}, {}),
        ({"recall@1": 0.9}, {("lexical", "missing", "mrr@10"): True}),
    ],
)
def test_metrics_of_an_arm(spark, now, want):
    arms = _arms(spark, LEXICAL)
    assert _found(evaluation.compare(arms, arms, _values(spark, lexical=METRICS), _values(spark, lexical=now), 0.01, 0.01)) == want


def test_runs_that_are_not_comparable(spark):
    base, better = _values(spark, lexical=METRICS), _values(spark, lexical={"recall@1": 1.0, "mrr@10": 1.0})
    compare = lambda a, b: _found(evaluation.compare(a, b, base, better, 0.01))
    assert compare(_arms(spark, LEXICAL), _arms(spark, ("lexical", "k=5"))) == {("lexical", "configuration_changed", None): True}
    assert compare(_arms(spark, LEXICAL), _arms(spark, LEXICAL, digest="b")) == {(None, "facts_changed", None): True}
    assert compare(_arms(spark, LEXICAL), _arms(spark, LEXICAL, count=30)) == {(None, "questions_lost", None): True}
    assert compare(_arms(spark, LEXICAL), _arms(spark, LEXICAL, count=41)) == {("lexical", "improved", m): False for m in METRICS}


def test_arms_come_and_go_and_an_earlier_failure_stops_the_later(spark):
    two = _arms(spark, LEXICAL, ("dense", "k=10"))
    worse = {"recall@1": 0.5, "mrr@10": 0.95}
    base = _values(spark, lexical=METRICS, dense=METRICS)
    assert _found(evaluation.compare(two, _arms(spark, LEXICAL), base, _values(spark, lexical=METRICS), 0.01))[("dense", "missing_arm", None)] is True
    assert _found(evaluation.compare(_arms(spark, LEXICAL), two, _values(spark, lexical=METRICS), base, 0.01)) == {("dense", "new_arm", None): False}
    assert _found(evaluation.compare(two, two, base, _values(spark, lexical=METRICS, dense=worse), 0.01)) == {("dense", "failed", "recall@1"): True}
    assert _found(evaluation.compare(two, two, base, _values(spark, lexical=worse, dense=worse), 0.01)) == {("lexical", "failed", "recall@1"): True}


def test_moved_questions_are_named(spark):
    arms, values = _arms(spark, LEXICAL), _values(spark, lexical=METRICS)
    items = lambda *r: spark.createDataFrame([("lexical", q, h) for q, h in r], "strategy string, qid string, hit_rank int")
    got = evaluation.compare(arms, arms, values, values, 0.01, 0.0, items(("a", 1), ("b", 2), ("c", None)), items(("a", None), ("b", 7), ("c", None))).collect()
    assert {(r["subject"], r["before"], r["after"]) for r in got} == {("a", "1", None), ("b", "2", "7")}


def test_value_match_of_the_first_result_only_and_recall_by_phrasing(spark):
    facts = spark.createDataFrame([(1, ["y"], "keyword", "2,5", 0.1), (2, ["x"], "keyword", "Fácil", None), (3, ["z"], "natural", "9", None)], "qid int, relevant array<string>, phrasing string, expected_value string, tolerance double")
    ranking = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "x", 1)], "qid int, id string, position int")
    chunks = spark.createDataFrame([("x", "é facil: 7 mm"), ("y", "2.45 mm")], "id string, text string")
    items = evaluation.with_value_match(evaluation.per_question(evaluation.ranked_lists(ranking, facts)), chunks)
    assert {r["qid"]: r["value_matched"] for r in items.collect()} == {1: False, 2: True, 3: False}
    got = {r["metric"]: r["value"] for r in evaluation.measured(items).collect()}
    assert got["value_match@1"] == got["recall@1"] == 0.333333 and got["recall@10:keyword"] == 1.0 and got["recall@10:natural"] == 0.0
    assert set(got) == {"recall@1", "recall@5", "recall@10", "mrr@10", "ndcg@10", "value_match@1", "precision@10", "candidates@10", "recall@10:keyword", "recall@10:natural"}
    assert evaluation.measured(items.where("false")).count() == 0


def test_recorded_arm_keeps_its_places(spark):
    recorded = spark.createDataFrame([("r", 1, "b"), ("r", 2, "gone"), ("r", 3, "a")], "record_id string, position int, chunk_id string")
    arm = records.recorded_arm(recorded, spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "chunk_id string, text string"))
    assert [(r["text"], r["absent"]) for r in arm.orderBy("position").collect()] == [("B", False), (None, True), ("A", False)]
    assert records.absent_chunks(arm).first()["absent"] == ["gone"]


def test_rules_of_an_arm_that_keeps_them_all(spark):
    schema = "record_id int, strategy string, gated array<string>, metrics array<string>, samples array<int>, spread_sizes array<int>, displayed int, chunk_ids array<string>, worst_verbatim int"
    good = (1, "s", ["mrr"], ["mrr"], [0, 1], [2], 1, ["a", "b"], 25)
    assert runs.rule_violations(spark.createDataFrame([good, (1, "t", *good[2:])], schema)).count() == 0
    bad = (2, "s", ["mrr"], [], [1], [2], None, ["a", "a"], 26)
    assert runs.rule_violations(spark.createDataFrame([bad, bad], schema)).count() == 7


def test_folds_in_order_keep_one_state_however_rows_are_batched(spark):
    rows = [(i, None if i % 3 == 0 else f"c{i % 3}", float(i * 7 % 40)) for i in range(50)]
    events = spark.createDataFrame(rows, "event_id long, key string, at double")
    whole = {r["event_id"]: r["hit"] for r in policies.cached(events, 11.0).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {r["event_id"]: r["hit"] for r in policies.cached(events, 11.0).collect()} == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for key in {k for _, k, _ in rows}:
        stored = None
        for i, _, at in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            want[i] = stored is not None and at - stored < 11.0
            stored = stored if want[i] else at
    assert whole == want
