"""Functions against their definitions in plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import metrics as M
from lexiloom.functions import text as X
from lexiloom.functions.analysis import analyzed, cover_density, stem
from lexiloom.functions.similarity import common_run, common_subsequence, trigrams, word_similarity


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_fold_and_normalize(spark):
    df = spark.createDataFrame([("Cabeçote  Ação\tÉ", "  A\n b ")], "a string, b string")
    assert df.select(X.fold(F.col("a")), X.fold_exact("a"), X.normalize_question(F.col("b"))).first()[:] == ("cabecote  acao\te", "cabecote  acao\te", "a b")
    assert df.select(X.tokens(F.col("a"))).first()[0] == ["cabecote", "acao", "e"]


@pytest.mark.parametrize(
    "expected, text, tolerance, want",
    [("41", "Torque: 41,3 N", 0.5, True), ("41", "Torque: 42", 0.5, False), ("41", "none", 0.5, False), ("Ação", "uma ACAO boa", None, True), ("x", "y", None, False)],
)
def test_value_matches(spark, expected, text, tolerance, want):
    assert one(spark, X.value_matches(F.lit(expected), F.lit(text), F.lit(tolerance).cast("double")))[0] is want


def test_cache_key_changes_with_every_axis(spark):
    axes = {"strategy": "dense", "k": 10, "embedder": None}
    key = lambda q, a: one(spark, X.cache_key(F.lit(q), **{k: F.lit(v).cast("string") for k, v in a.items()}))[0]
    base = key("What  torque", axes)
    assert key("what torque ", axes) == base
    assert len({base, key("other", axes), *(key("What torque", axes | {k: "new"}) for k in axes)}) == 5


def test_client_address(spark):
    f, p = F.lit(" 1.1.1.1 , 2.2.2.2"), F.lit("9.9.9.9")
    row = one(spark, X.client_address(f, p, True), X.client_address(f, p, False), X.client_address(F.lit(None).cast("string"), F.lit(None).cast("string"), True))
    assert row[:] == ("2.2.2.2", "9.9.9.9", "unknown")


def test_detect_terms(spark):
    found = one(spark, X.detect_terms(F.lit("O Cabeçote do swap 250-S na mesada"), ["mesa", "swap", "swap 250-S", "cabecote"]))[0]
    assert found == ["swap 250-S", "cabecote"]


def test_metrics(spark):
    ranked, relevant = F.array(*map(F.lit, [5, 3, 9, 1])), F.array(*map(F.lit, [3, 1, 7]))
    none = F.array(F.lit(2))
    row = one(spark, M.recall_at(ranked, relevant, 2), M.recall_at(ranked, relevant, 10), M.reciprocal_rank(ranked, relevant, 10), M.reciprocal_rank(ranked, none, 10), M.hit_rank(ranked, none, 10), M.ndcg_at(ranked, relevant, 10), M.precision_at(ranked, relevant, 10))
    gain = lambda p: 1 / np.log2(p + 1)
    assert row[:] == (pytest.approx(1 / 3), pytest.approx(2 / 3), 0.5, 0.0, None, pytest.approx((gain(2) + gain(4)) / (gain(1) + gain(2) + gain(3))), pytest.approx(0.2))


def test_stems_and_positions():
    assert [stem(w) for w in ("torques", "torque", "parafusos", "apertar", "aperto", "rapidamente", "motores")] == ["torqu", "torqu", "parafus", "apert", "apert", "rapid", "motor"]
    assert analyzed("O torque do cabeçote, the torque 41") == [("torqu", 2), ("cabecot", 4), ("torqu", 6), ("41", 7)]
    assert analyzed("what is the de para com") == []


def test_cover_density(spark):
    df = spark.createDataFrame([([[1, 9], [2]],), ([[1, 5, 8]],), ([[1], []],), ([[1], [4]],)], "p array<array<int>>")
    got = [r[0] for r in df.select(cover_density("p")).collect()]
    assert got == pytest.approx([0.1 + 0.1 / 7, 0.3, 0.0, 0.1 / 3])


def test_word_similarity_against_all_extents():
    def brute(query, text):
        q, t, best = set(trigrams(query)), trigrams(text), 0.0
        for i in range(len(t)):
            e = set()
            for x in t[i:]:
                e.add(x)
                best = max(best, len(q & e) / len(q | e))
        return best

    r, words = random.Random(5), ["casa", "carro", "motor", "oleo", "mesa", "car", "or"]
    for _ in range(300):
        q, t = (" ".join(r.choice(words) for _ in range(n)) for n in (r.randint(1, 4), r.randint(0, 14)))
        want = brute(q, t)
        assert word_similarity(q, t) == pytest.approx(want)
        assert word_similarity(q, t, 0.6) == pytest.approx(want if want >= 0.6 else 0.0)


def test_common_runs_against_tables():
    r = random.Random(2)
    for _ in range(100):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        run, sub = np.zeros((len(a) + 1, len(b) + 1), int), np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                run[i, j] = run[i - 1, j - 1] + 1 if x == y else 0
                sub[i, j] = sub[i - 1, j - 1] + 1 if x == y else max(sub[i - 1, j], sub[i, j - 1])
        assert (common_run(a, b), common_subsequence(a, b)) == (run.max(), sub[-1, -1])


def test_exact_question_and_tolerance_on_words(spark):
    df = spark.createDataFrame([("  C\u0327a\u00a0STRASSE \u00df ", "x 3"), (None, "y")], "a string, b string")
    assert [r[0] for r in df.select(X.normalize_question_exact("a")).collect()] == ["\u00e7a strasse ss", None]
    with pytest.raises(Exception, match="a tolerance needs a number"):
        df.select(X.value_matches(F.lit("three"), F.col("b"), F.lit(0.5))).collect()


def test_full_fold_on_all_code_points(spark):
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = ["".join(map(chr, codes[i : i + 500])) for i in range(0, len(codes), 500)] + ["", "Straße ﬁn 각각 e\u0301 İ", None]
    df = spark.createDataFrame([(t,) for t in rows], "t string").select("t", X.fold_full(F.col("t")).alias("f"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r["f"] for r in df.collect()] == [r[0] for r in df.select(X.fold_exact("t")).collect()]
