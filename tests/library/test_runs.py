"""Records, rules and the cascade."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import runs


def test_records_round_trip(spark, tmp_path):
    now = dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.UTC)
    assert (runs.iso(now), runs.compact(now)) == ("2024-01-02T03:04:05Z", "20240102T030405Z")
    folder = str(tmp_path / "runs")
    one = {"provenance": runs.provenance(spark, {"corpus_hash": "h"}, now), "arms": []}
    other = {"provenance": runs.provenance(spark, {"corpus_hash": "h"}, now + dt.timedelta(1)), "arms": []}
    runs.write_record(spark, folder, "20240102T000000Z", one)
    runs.write_record(spark, folder, "20240103T000000Z", other)
    assert runs.read_record(spark, folder)["provenance"]["at"].startswith("2024-01-03")
    assert runs.measurement(one) == runs.measurement(other) != runs.measurement({"provenance": {"corpus_hash": "x"}, "arms": []})
    with pytest.raises(LookupError):
        runs.read_record(spark, folder, "none")


def test_rewritten():
    doc = "a\n<!-- begin x -->\nold\n<!-- end x -->\nb"
    assert runs.rewritten(doc, "x", "{}") == "a\n<!-- begin x -->\n```json\n{}\n```\n<!-- end x -->\nb"
    with pytest.raises(LookupError):
        runs.rewritten(doc, "y", "{}")


def test_broken_rules():
    good = {"strategy": "s", "gated": ["mrr"], "metrics": {"mrr": 1}, "samples": [{"index": 0}], "spreads": {"t": [1]}, "displayed": 0}
    assert runs.broken_rules([good]) == []
    assert len(runs.broken_rules([good, good | {"gated": ["x"], "samples": [{"index": 1}], "spreads": {"t": []}, "displayed": 4}])) == 5


@pytest.mark.parametrize(
    "state, want",
    [((False, True, True, True, False, False), "refused"), ((True, True, True, True, False, False), "precomputed"), ((True, False, True, True, False, False), "cache"), ((True, True, True, True, True, False), "live"), ((True, True, False, False, True, False), "precomputed"), ((True, False, False, True, False, True), "live_degraded"), ((True, False, False, False, False, False), "live_degraded")],
)
def test_cascade(spark, state, want):
    assert spark.range(1).select(runs.served(*map(F.lit, state))).first()[0] == want


def test_sample_metrics_and_durations(spark):
    draws = spark.createDataFrame([("s", "q", 0, 5, 2, None, 0, 1, 1.0, None, ["c"])], "strategy string, qid string, sample int, tokens_in int, tokens_out int, cost_usd double, invalid_citations int, unsupported_claims int, retrieve_ms double, generate_ms double, claims array<string>")
    got = {r["metric"]: r["value"] for r in runs.sample_metrics(draws).collect()}
    assert got["claims"] == 1.0 and got["cost_usd"] is None and len(got) == 8
    spans = spark.createDataFrame([("t", "a", "x", 0, 9), ("t", "b", "g", 3, 5), ("t", "c", "g", 6, 9)], "trace_id string, span_id string, name string, started long, ended long")
    assert runs.first_duration(spans, "g").first()["duration"] == 2
