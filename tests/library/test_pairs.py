"""Pairs of questions and chunks: counted as a product of tables, and bounded before they are compared."""

import random

import pandas as pd
import pyarrow as pa
import pytest

from lexiloom.functions import similarity
from lexiloom.functions.similarity import trigrams, word_similarity
from lexiloom.operators import lexical

WORDS = ["casa", "carro", "motor", "óleo", "mesa", "car", "or", "x1", "Velho", "válvula", "de", "a"]


def sentences(seed, n, most):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_candidates_are_counted_exactly_over_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUESTIONS", 3)
    monkeypatch.setattr(lexical, "SLICE_BYTES", 500)
    chunks, asked = [*enumerate(sentences(21, 50, 20)), (90, None)], [*enumerate(sentences(22, 10, 6)), (91, None)]
    got = lexical.trigram_candidates(spark.createDataFrame(asked, "qid int, question string"), spark.createDataFrame(chunks, "chunk_id int, text string"), 0.6)
    grams = lambda t: set(trigrams(t or ""))
    want = {(q, c): n for q, t in asked for c, u in chunks if (n := len(grams(t) & grams(u))) and n >= 0.6 * len(grams(t)) - 1e-9}
    assert {(r["qid"], r["chunk_id"]): r["held"] for r in got.collect()} == want and want


@pytest.mark.parametrize("stride, strip", [(1, 1), (3, 2), (32, 64)])
@pytest.mark.parametrize("floor", [0.3, 0.6, 0.9])
def test_bounds_lose_no_run_of_a_long_text(monkeypatch, stride, strip, floor):
    monkeypatch.setattr(similarity, "STRIDE", stride)
    monkeypatch.setattr(similarity, "STRIP", strip)
    monkeypatch.setattr(similarity, "CELLS", 500)
    texts, asked = [*sentences(23, 12, 60), ""], sentences(24, 12, 7)
    found = similarity.meeting(floor, True)(pa.table({"chunk_id": range(len(texts)), "text": texts}), pa.table({"qid": range(len(asked)), "question": asked}))
    want = {(q, c): s for q, t in enumerate(asked) for c, u in enumerate(texts) if (s := word_similarity(t, u)) >= floor - 1e-9}
    assert {(r["qid"], r["chunk_id"]): pytest.approx(r["trigram"], abs=1e-6) for r in found.to_pylist()} == want and want


def test_only_strict_matches_have_lists(spark):
    rows = [(1, "a", [1, 4]), (1, "b", [2]), (2, "a", [1]), (3, "c", [5, 6, 7])]
    asked = spark.createDataFrame([(7, "a"), (7, "b"), (8, "c"), (8, "z")], "qid int, lexeme string")
    got = lexical.matches(asked, spark.createDataFrame(rows, "chunk_id int, lexeme string, positions array<int>")).collect()
    assert {(r["qid"], r["chunk_id"]): (r["held"], r["total"], r["strict"], r["lists"] and sorted(r["lists"])) for r in got} == {(7, 1): (2, 3, True, [[1, 4], [2]]), (8, 3): (1, 3, False, None)}


def best_of_all_runs(query, text):
    wanted, found, best = set(trigrams(query)), trigrams(text), 0.0
    for i in range(len(found)):
        run = set()
        for t in found[i:]:
            run.add(t)
            best = max(best, len(run & wanted) / len(run | wanted))
    return best


def test_a_share_that_rounds_up_is_found():
    """A floor that is a share itself can be a little more than it, times the query's size."""
    for q, t in [("óleo x1 de motor válvula", "ing car válvula motor"), (sentences(3, 12, 6)[8], sentences(2, 60, 25)[7])]:
        assert word_similarity(q, t) == pytest.approx(best_of_all_runs(q, t)) and best_of_all_runs(q, t) > 0.3


@pytest.mark.parametrize("cells, characters", [(10, 60), (4_000, 300), (4_000_000, 1_000_000)])
@pytest.mark.parametrize("stride", [2, 96])
def test_windows_of_texts_in_strips_lose_no_run(monkeypatch, stride, cells, characters):
    for name, value in {"STRIDE": stride, "CELLS": cells, "CHARACTERS": characters}.items():
        monkeypatch.setattr(similarity, name, value)
    texts, asked = [*sentences(25, 8, 25), "", "日本 語 " * 5, "casa " * 20], [*sentences(26, 5, 6), "", "日本 語"]
    shares = {(q, c): best_of_all_runs(t, u) for q, t in enumerate(asked) for c, u in enumerate(texts)}
    for floor in (0.0, 0.4, 0.6, 1.0):
        found = similarity.meeting(floor, True)(pa.table({"chunk_id": range(len(texts)), "text": texts}), pa.table({"qid": range(len(asked)), "question": asked}))
        want = {pair: s for pair, s in shares.items() if s >= floor - 1e-9 and s}
        assert {(r["qid"], r["chunk_id"]): pytest.approx(r["trigram"], abs=1e-6) for r in found.to_pylist()} == want and want


def test_few_windows_are_left_to_measure(monkeypatch):
    """Of texts that hold most of a question's trigrams, but apart, hardly one is measured run by run."""
    measured, share = [], similarity._best_share
    monkeypatch.setattr(similarity, "_best_share", lambda *a: (measured.append(a), share(*a))[1])
    r, letters = random.Random(27), "aeiorst"
    words = ["".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(400)]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts, asked = [some(200) for _ in range(100)], [some(30) for _ in range(10)]
    texts[7] = f"{some(90)} {asked[3]} {some(90)}"
    meet = lambda extents: similarity.meeting(0.6, extents)(pa.table({"chunk_id": range(100), "text": texts}), pa.table({"qid": range(10), "question": asked}))
    assert (3, 7) in {(x["qid"], x["chunk_id"]) for x in meet(True).to_pylist()}
    assert len(meet(False)) > 300 and len(measured) < 30


@pytest.mark.parametrize("k", [3, 10])
def test_signals_of_slices_rank_as_all_pairs_do(spark, monkeypatch, k):
    """Counted where slices meet questions, against the join of postings with questions; and no postings are made for it."""
    rows = [*enumerate(sentences(28, 60, 14)), (60, None), (61, ""), (62, "casa <b motor> mesa, or"), (63, "motor motor motor")]
    chunks = spark.createDataFrame(rows, "chunk_id int, text string").cache()
    asked = spark.createDataFrame([*enumerate(sentences(29, 9, 4)), (20, "casa motor nowhere"), (21, "motor"), (22, None), (23, "de a")], "qid int, question string").cache()
    text = lexical.text_signal(asked, lexical.postings(chunks, lexical.asked_lexemes(asked)))
    both = text.join(lexical.trigram_signal(asked, chunks), ["qid", "chunk_id"], "full").fillna(0.0, ["lexical"])
    names = ["qid", "position", "chunk_id", "score", "lexical", "trigram", "lexical_rank", "trigram_rank"]
    want = sorted(map(tuple, lexical.fuse(both, k).select(*names).collect()))
    monkeypatch.setattr(lexical, "postings", None)
    monkeypatch.setattr(lexical, "SLICE_BYTES", 900)
    monkeypatch.setattr(lexical, "QUESTIONS", 5)
    assert sorted(map(tuple, lexical.ranked(asked, chunks, k).select(*names).collect())) == want and want


def test_a_long_text_is_measured_in_windows(monkeypatch):
    """The similarity that is reported beside the first k doesn't look at every run of a long text."""
    r = random.Random(30)
    text = " ".join(r.choice(WORDS) for _ in range(300))
    cases = [(q, text) for q in sentences(31, 4, 8)] + [("casa", ""), ("", "casa"), ("x1", "mesa " * 40 + "x1")]
    want = [word_similarity(q, t) for q, t in cases]
    monkeypatch.setattr(similarity, "extent_similarity", None)
    got = similarity.word_similarity_of.func(pd.Series([q for q, _ in cases]), pd.Series([t for _, t in cases]))
    assert got.tolist() == pytest.approx(want, abs=1e-6)
