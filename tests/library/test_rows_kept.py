"""What a step reads or makes more than it needs."""

import pyarrow as pa
from pyspark.sql import functions as F

from lexiloom.functions import analysis
from lexiloom.functions import text as X
from lexiloom.operators import terms


def test_ascii_is_lower_cased_and_not_translated(spark):
    texts = ["", "Plain ASCII\n", "Ünïcode ß", "\x7f~", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.fold_full(F.col("t")).alias("a"), X.fold_exact(F.col("t")).alias("b"))
    assert all(r["a"] == r["b"] for r in df.collect())
    assert "octet_length" in df._jdf.queryExecution().optimizedPlan().toString()


def test_only_terms_are_put_together_again(spark):
    chunks = spark.createDataFrame([(1, "the valve is a valve"), (2, "none here"), (3, None), (4, "-valve")], "chunk_id int, text string")
    df = terms.used_terms(chunks, spark.createDataFrame([("valve", 1)], "term string, position int"), "chunk_id")
    assert {r["chunk_id"]: r["terms"] for r in df.collect()} == {1: ["valve"], 2: [], 3: [], 4: ["valve"]}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("isnotnull(folded") or plan.index("Aggregate") < plan.index("< 0")


def test_lexemes_are_made_a_piece_at_a_time(monkeypatch):
    monkeypatch.setattr(analysis, "PIECE", 2)
    texts = ["Casas velhas", None, "", "a motor", "x1"]
    got = analysis.analyze.func(pa.array(texts))
    assert [[(w["lexeme"], w["pos"]) for w in row] for row in got.to_pylist()] == [analysis.analyzed(t) if t else [] for t in texts]
    assert isinstance(got, pa.ListArray)
