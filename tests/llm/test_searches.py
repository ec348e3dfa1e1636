"""Hard negatives, decontamination and ranked search against plain Python, and their parts."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import decontamination, negatives, ranking, words
from lexiloom.llm.queries import QUERIES

LAST = 1 << 62
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- 11 hard negatives


def brute_negatives(rows, asks, positives=5, negatives_=10, low=30, high=90):
    """rows: (id, vector of whole numbers, label)."""
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (i, v, label) in enumerate(rows):
        if not asks(i):
            continue
        ranked = sorted(((-score(v, w), LAST if j is None else j, m, other) for m, (j, w, other) in enumerate(rows) if m != n))
        for minus, p, _, _ in [x for x in ranked if x[3] == label][:positives]:
            found = [x for x in ranked if x[3] != label and low * -minus <= 100 * -x[0] <= high * -minus][:negatives_]
            out += [(i, p, r, x[1], -minus, -x[0]) for r, x in enumerate(found, 1)]
    return Counter(out)


def got_negatives(df):
    none = lambda x: LAST if x is None else x
    return Counter((r["anchor_id"], none(r["positive_id"]), r["rank"], none(r["negative_id"]), r["positive_score"], r["negative_score"]) for r in df.collect())


def taking_part(vectors):
    out = []
    for i, v, label, _ in vectors:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        out.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    return out


@pytest.mark.parametrize("part, leaf, block", [(4096, 64, 2048), (50, 4, 2), (97, 2, 1)])
def test_negatives_against_all_products(spark, folder, vectors, monkeypatch, part, leaf, block):
    monkeypatch.setattr(negatives, "PART_ROWS", part)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", block)
    monkeypatch.setattr(negatives, "LEAF", leaf)
    want = brute_negatives(taking_part(vectors), lambda i: i is not None and i % 100 == 0)
    assert got_negatives(QUERIES["op11_negatives"](spark, folder)) == want and len(want) > 30


def test_negatives_of_many_equal_vectors(spark):
    rows = [(i, [3, 4], i % 2) for i in range(300)] + [(1000 + i, [2, 1], 1) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, vector array<long>, label int").withColumn("vector", F.col("vector").cast("array<double>"))
    got = negatives.hard_negatives(negatives.prepared(df, F.col("vector"), F.col("label"), 1), F.col("id") == 10)
    assert got_negatives(got) == brute_negatives(rows, lambda i: i == 10)


def test_tree_leaves_nodes_out_and_nothing_else(monkeypatch):
    r = np.random.default_rng(3)
    centres = r.integers(-200, 200, (12, 8))
    x = np.concatenate([c + r.integers(-6, 7, (60, 8)) for c in centres])
    label = np.repeat(np.arange(12) % 4, 60)
    q = x[r.integers(0, len(x), 25)]
    products = q @ x.T
    of = np.repeat(np.arange(25), 2)
    wanted = label[r.integers(0, len(x), 50)]
    top = np.sort(products, axis=1)[:, -1][of]
    low, high = np.tile([-LAST, 1], 25).copy(), np.full(50, LAST)
    low[1::2], high[1::2] = (top * 3 // 10)[1::2], (top * 9 // 10)[1::2]
    opened = []
    plain = negatives.Tree._open
    monkeypatch.setattr(negatives.Tree, "_open", lambda self, leaf, who, *rest: (opened.append(len(who)), plain(self, leaf, who, *rest))[1])
    for same in (True, False):
        tree = negatives.Tree.over(x, label, 4)
        scores, places = tree.search(q, of, wanted, same, low, high, 7, np.full(50, -1))
        for i in range(50):
            fits = [j for j in range(len(x)) if (label[j] == wanted[i]) == same and low[i] <= products[of[i], j] <= high[i]]
            best = sorted(fits, key=lambda j: (-products[of[i], j], j))[:7]
            assert places[i][: len(best)].tolist() == best and (scores[i][len(best) :] == negatives._NONE).all()
    leaves = len(tree.bounds) - 1
    assert sum(opened) < 0.6 * 2 * 50 * leaves


def test_products_beyond_doubles():
    a, b = np.array([[1 << 40, 3]]), np.array([[1 << 20, 5], [1, 1]])
    assert negatives._products(a, b).tolist() == [[(1 << 60) + 15, (1 << 40) + 3]]
    assert negatives._products(a, np.array([[1 << 40, 0]])).tolist() == [[1 << 62]]


# --- 12 decontamination


def brute_contamination(text, items, window=10):
    """items: (item_id, text)."""
    own = WORD.findall(lowered(text))
    hit, found = set(), set()
    for i, t in items:
        w = WORD.findall(lowered(t))
        size = min(window, len(w))
        for k in range(len(w) - size + 1) if w else ():
            for at in range(len(own) - size + 1):
                if own[at : at + size] == w[k : k + size]:
                    hit.update(range(at, at + size))
                    found.add(i)
    ids = sorted(str(i) for i in found if i is not None)
    return len(own), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def test_contamination_against_all_windows(spark, folder, rows, items):
    got = Counter(tuple(r) for r in QUERIES["op12_decontamination"](spark, folder).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    want = Counter((d, *brute_contamination(text, [(i, t) for i, t, _ in items])) for d, text, *_ in rows if len(text or "") < 20_000)
    assert not want - got and sum(got.values()) == len(rows) and sum(n for r, n in want.items() if r[2]) > 5


@pytest.mark.parametrize("least", [1, 2, 3, 10])
def test_contamination_of_few_words(spark, least):
    r = random.Random(least)
    text = lambda n: " ".join(r.choice("abé") for _ in range(n))
    docs = [(n, text(n)) for n in range(40)]
    items = [(n, text(r.randint(least, 13))) for n in range(4)]
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == {d: brute_contamination(t, items) for d, t in docs}


def test_no_item_has_a_word(spark, docs):
    got = decontamination.contamination(docs, spark.createDataFrame([(1, "..."), (2, None)], "item_id long, text string"))
    assert got.where("contaminated or n_hit > 0 or n_items > 0").count() == 0 and got.count() == docs.count()


def test_spans_are_long_enough():
    h = np.arange(1, 31, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    field = np.zeros(1 << words.BITS, dtype=bool)
    field[words.bits_of(words.runs(h[4:14], 3))] = True
    field[words.bits_of(words.runs(h[20:28], 3))] = True
    assert decontamination._spans(h, np.packbits(field, bitorder="little"), [(3, 10)]) == [(4, 14)]
    assert decontamination._spans(h, np.packbits(field, bitorder="little"), [(3, 8)]) == [(4, 14), (20, 28)]


# --- 13 ranked search


def brute_search(docs, items, k=10):
    """docs: (doc_id, text), items: (item_id, text)."""
    held = [(d, Counter(w), len(w)) for d, t in docs if (w := WORD.findall(lowered(t)))]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = Counter()
    for i, text in items:
        scored = []
        for d, c, size in held:
            m = 100 - 75 + 75 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in WORD.findall(lowered(text)) if c[t])
            if score > 0:
                scored.append((-score, LAST if d is None else d))
        out.update((i, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1))
    return out


def got_search(df):
    return Counter((r["item_id"], r["rank"], LAST if r["doc_id"] is None else r["doc_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("shard, block", [(16_384, 4_096), (3, 2)])
def test_search_against_all_scores(spark, folder, rows, items, monkeypatch, shard, block):
    monkeypatch.setattr(ranking, "SHARD_DOCS", shard)
    monkeypatch.setattr(ranking, "BLOCK_ITEMS", block)
    want = brute_search([r[:2] for r in rows], [x[:2] for x in items])
    assert got_search(QUERIES["op13_search"](spark, folder)) == want and len(want) > 40


def test_search_keeps_ties(spark):
    docs = [(i, "same words here") for i in range(200, 100, -1)] + [(None, "same words here"), (1, "other")]
    items = [(1, "words"), (2, "same same other"), (3, "absent")]
    got = ranking.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got_search(got) == brute_search(docs, items)


def test_search_of_nothing(spark, docs, empty):
    items = spark.createDataFrame([(1, "ka lo"), (2, None)], "item_id long, text string")
    assert ranking.search(empty, items).collect() == []
    assert ranking.search(docs, items.where("item_id = 2")).collect() == []


def test_max_score_against_sums():
    r = np.random.default_rng(5)
    for trial in range(200):
        size, k = int(r.integers(1, 60)), int(r.integers(1, 12))
        lists = []
        for n in range(int(r.integers(0, 7))):
            where = np.flatnonzero(r.random(size) < (0.05, 0.5, 1.0)[n % 3])
            lists.append((where, r.integers(1, (4, 100)[trial % 2], len(where)) * (1, 50)[n % 2]))
        total = np.zeros(size, np.int64)
        for where, values in lists:
            total[where] += values
        best = sorted((i for i in range(size) if total[i]), key=lambda i: (-total[i], i))[:k]
        found, scores = ranking.max_score(lists, size, k)
        assert found.tolist() == best and scores.tolist() == total[best].tolist()
