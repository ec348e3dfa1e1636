"""Indexes and joins that replace loops over pairs, against plain Python over all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as X
from lexiloom.functions.analysis import cover_density
from lexiloom.functions.similarity import trigram_array, trigrams, word_similarity
from lexiloom.operators import dense, evaluation, lexical, records, terms
from lexiloom.plans import QUERIES
from lexiloom.sources import corpus

WORDS = ["casa", "carro", "motor", "óleo", "mesa", "car", "or", "x1", "Velho", "válvula", "de", "a"]


def sentences(seed, n, most=25):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_trigram_array_is_what_python_gives(spark):
    texts = ["", None, "a", "Ação_de 12-b", "  two  words\t", "日本 語", *sentences(1, 10)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", trigram_array(F.col("t")).alias("g")).collect()
    assert all(r["g"] == trigrams(r["t"] or "") for r in got)


@pytest.mark.parametrize("sent", [500_000, 3])
@pytest.mark.parametrize("floor", [0.3, 0.6, 0.9])
def test_trigram_index_loses_no_pair(spark, monkeypatch, floor, sent):
    monkeypatch.setattr(lexical, "SENT_ROWS", sent)
    chunks = [(f"c{i}", t) for i, t in enumerate(sentences(2, 60))] + [("null", None), ("none", "")]
    asked = [(i, t) for i, t in enumerate(sentences(3, 12, 6))] + [(98, None), (99, "")]
    got = lexical.trigram_signal(spark.createDataFrame(asked, "qid int, question string"), spark.createDataFrame(chunks, "chunk_id string, text string"), floor).collect()
    want = {(q, c): s for q, t in asked for c, u in chunks if t and u and (s := word_similarity(t, u)) >= floor - 1e-9}
    assert {(r["qid"], r["chunk_id"]): pytest.approx(r["trigram"], abs=1e-6) for r in got} == want and want


def test_trigram_candidates_are_few(spark):
    r = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(r.choice(letters) for _ in range(7))
    chunks = [(i, " ".join(word() for _ in range(20))) for i in range(300)]
    asked = [(i, " ".join(chunks[i * 20][1].split()[3:9])) for i in range(10)]
    got = lexical.trigram_candidates(spark.createDataFrame(asked, "qid int, question string"), spark.createDataFrame(chunks, "chunk_id int, text string")).collect()
    assert {(x["qid"], x["chunk_id"]) for x in got} == {(i, i * 20) for i in range(10)}


def test_fused_ranks_equal_windows_over_all(spark):
    r = random.Random(6)
    rows = [(q, c, float(r.choice([0, 0.1, 0.2, 0.2, 0.5])), r.choice([None, None, None, 0.2, 0.6, 0.7, 0.7])) for q in range(3) for c in range(70)]
    got = lexical.fuse(spark.createDataFrame(rows, "qid int, chunk_id int, lexical float, trigram float"), 7).collect()
    for q in range(3):
        fired = [x for x in rows if x[0] == q and (x[2] > 0 or (x[3] or 0) >= 0.6)]
        rank = lambda v, k: 1 + sum((x[k] or 0) > v for x in fired)
        scored = []
        for _, c, lex, tri in fired:
            s = (0.7 / (60 + rank(lex, 2)) if lex > 0 else 0) + (0.3 / (60 + rank(tri, 3)) if (tri or 0) >= 0.6 else 0)
            scored.append((-round(s, 12), c))
        assert [(x["chunk_id"], x["position"]) for x in sorted((x for x in got if x["qid"] == q), key=lambda x: x["position"])] == [(c, i) for i, (_, c) in enumerate(sorted(scored)[:7], 1)]


def test_impact_blocks_give_the_first_and_skip_others(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_CHUNKS", 5)
    r, common = random.Random(10), ["de", "a", "o", "que"]
    texts = [[r.choice(common + WORDS) for _ in range(r.choice([4, 6, 8, 60, 90]))] for _ in range(200)]
    rows = [(c, w, [i for i, x in enumerate(t) if x == w]) for c, t in enumerate(texts) for w in set(t)]
    asked = [(1, "de"), (1, "a"), (1, "a"), (2, "motor"), (2, "nowhere"), (3, "nowhere"), *[(4, w) for w in WORDS]]
    index = lexical.ImpactIndex(spark.createDataFrame(rows, "chunk_id int, lexeme string, positions array<int>"))
    lexemes = spark.createDataFrame(asked, "qid int, lexeme string")
    got = {}
    for x in index.search(lexemes, 10).collect():
        got.setdefault(x["qid"], {})[x["position"]] = (-x["hits"], x["chunk_id"])
    for q in (1, 2, 4):
        wanted = {w for i, w in asked if i == q}
        best = sorted((-n, c) for c, t in enumerate(texts) if (n := sum(w in wanted for w in t)))[:10]
        assert [got[q][i] for i in sorted(got[q])] == best
    assert 3 not in got
    share = index.opened(lexemes.distinct(), 10).count() / index.promised(lexemes.distinct()).count()
    assert share < 0.5


@pytest.mark.parametrize("sent", [500_000, 3])
def test_impact_topk_indexes_asked_words_as_counts(spark, monkeypatch, tmp_path, sent):
    """Words that no question has are neither shuffled nor stored, positions aren't gathered, and a document without an id counts."""
    monkeypatch.setattr(lexical, "SENT_ROWS", sent)
    monkeypatch.setattr(lexical, "BLOCK_CHUNKS", 5)
    docs = [*enumerate(sentences(11, 80)), (3, "motor motor"), (None, "Motor motor casa"), (80, None), (81, "nothing asked")]
    items = [("a", "motor motor CASA"), ("b", "óleo absent"), ("c", None), ("d", "absent")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made, init = [], lexical.ImpactIndex.__init__
    monkeypatch.setattr(lexical.ImpactIndex, "__init__", lambda self, index: (made.append((self, index)), init(self, index))[1])
    got = {}
    for r in QUERIES["impact_topk"](spark, str(tmp_path)).collect():
        got.setdefault(r["item_id"], {})[r["position"]] = (-r["hits"], r["doc_id"] is None, r["doc_id"])
    for item, text in items:
        wanted, hits = set((text or "").lower().split()), {}
        for doc, t in docs:
            hits[doc] = hits.get(doc, 0) + sum(w in wanted for w in (t or "").lower().split())
        best = sorted(((-n, d is None, d) for d, n in hits.items() if n), key=lambda x: (*x[:2], x[2] or 0))[:10]
        assert [got.get(item, {})[i] for i in sorted(got.get(item, {}))] == best
    (index, given), = made
    assert "positions" not in given.columns and {r["lexeme"] for r in index.rows.collect()} == {"motor", "casa", "óleo"}


def brute_density(lists):
    """Every shortest interval of positions that has all lexemes."""
    if not lists or any(not x for x in lists):
        return 0.0
    places = sorted({p for x in lists for p in x})
    holds = lambda a, b: all(any(a <= p <= b for p in x) for x in lists)
    total = 0.0
    for a in places:
        for b in places:
            inner = [p for p in places if a <= p <= b]
            if b >= a and holds(a, b) and not holds(a + 1, b) and not holds(a, b - 1):
                total += 0.1 / (1 + (b - a + 1) - len(inner))
    return total


def test_cover_density_against_all_intervals(spark):
    r, rows = random.Random(7), [[], [[]], [[3], []], [[5]], [[1, 2, 9]]]
    for _ in range(120):
        places, k = r.sample(range(1, 40), r.randint(1, 14)), r.randint(1, 4)
        lists = [[] for _ in range(k)]
        for p in places:
            lists[r.randrange(k)].append(p)
        rows.append([sorted(x) for x in lists])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, p array<array<int>>").select("i", cover_density(F.col("p")).alias("d"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert [x["d"] for x in sorted(df.collect())] == [pytest.approx(brute_density(x), abs=1e-6) for x in rows]


# --- dense


def brute_dense(vectors, queries, k, keep_self=False):
    out = set()
    for q, v in queries:
        found = []
        for i, w in vectors:
            if i != q or keep_self:
                found.append((-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 5), i))
        found.sort()
        out |= {(q, i, -c, 1 + sum(x < c for x, _ in found)) for c, i in found[:k]}
    return out


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(8)
    centres = r.normal(size=(9, 12))
    x = np.concatenate([c + 0.05 * r.normal(size=(70, 12)) for c in centres])
    x[100:130] = x[100]
    return [(i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("cells, block, part", [(1, 4096, 8192), (9, 4096, 8192), (20, 3, 11)])
def test_cells_give_the_exact_ranking(spark, clustered, monkeypatch, cells, block, part):
    monkeypatch.setattr(dense, "BLOCK", block)
    monkeypatch.setattr(dense, "SLICE", part)
    rows = spark.createDataFrame([*clustered, (9_000, None), (9_001, [])], "id long, vector array<double>")
    asked = [x for x in clustered if x[0] % 37 == 0] + [(70_000, [1.0] * 12)]
    got = dense.VectorIndex(rows, cells).search(spark.createDataFrame(asked, "id long, vector array<double>"), 10)
    assert {tuple(r) for r in got.select("qid", "id", "cosine", "rank").collect()} == brute_dense(clustered, asked, 10)


def test_cells_are_passed_over_and_probes_find_most(spark, clustered):
    index = dense.VectorIndex(spark.createDataFrame(clustered, "id long, vector array<double>"), 9)
    asked = [x for x in clustered if x[0] % 10 == 0]
    df = spark.createDataFrame(asked, "id long, vector array<double>")
    kth = df.select(F.col("id").alias("qid"), "vector", F.lit(0.9).alias("kth"), F.lit(0).alias("block"))
    assert index._visits(kth, 1, None).count() < 0.5 * len(asked) * 9
    want = {x[:2] for x in brute_dense(clustered, asked, 10)}
    got = {(r["qid"], r["id"]) for r in index.search(df, 10, probes=3).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_metrics_from_counts_equal_metrics_from_lists(spark):
    r = random.Random(9)
    relevant = {q: r.sample(range(40), q * 3) for q in range(6)}
    ranking = [(q, i, p) for q in range(5) for p, i in enumerate(r.sample(range(40), 10), 1)]
    ranked = spark.createDataFrame(ranking, "qid int, id int, position int")
    lists = evaluation.per_question(evaluation.ranked_lists(ranked, spark.createDataFrame(list(relevant.items()), "qid int, relevant array<int>")))
    hits = spark.createDataFrame([(*x, x[1] in relevant[x[0]]) for x in ranking], "qid int, id int, position int, hit boolean")
    counts = evaluation.per_flagged(hits, spark.createDataFrame([(q, len(x)) for q, x in relevant.items()], "qid int, n_relevant int"))
    names = ["qid", "recall_1", "recall_5", "recall_10", "rr", "ndcg", "hit_rank", "precision", "candidates"]
    assert sorted(map(tuple, lists.select(names).collect())) == sorted(map(tuple, counts.select(names).collect()))


# --- records


def test_span_trees_of_any_depth(spark):
    deep = 100_000
    chain = spark.range(deep).select(F.lit("deep").alias("trace_id"), F.col("id").cast("string").alias("span_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_span_id"), F.col("id").alias("started"), (F.col("id") + 1).alias("ended"))
    odd = spark.createDataFrame(
        [("t", "a", None, 0, 9), ("t", "b", "a", 1, 3), ("t", "c", "a", 4, 5), ("t", "d", "c", 4, 5), ("t", "x", "y", 0, 1), ("t", "y", "x", 0, 1), ("t", "z", "y", 0, 1), ("t", "o", "gone", 0, 1), ("t", "p", "o", 0, 1), (None, "n", None, 0, 1), (None, "m", "n", 0, 1), ("t", "s", "s", 0, 1)],
        "trace_id string, span_id string, parent_span_id string, started long, ended long",
    )
    got = records.span_tree(chain.unionByName(odd)).persist()
    assert got.where("trace_id = 'deep'").agg(F.count("*"), F.max("depth"), F.count_if((F.col("depth") == F.col("span_id").cast("int")) & (F.col("root") == "0") & F.col("fault").isNull())).first()[:] == (deep, deep - 1, deep)
    rest = {r["span_id"]: (r["depth"], r["root"], r["fault"], r["offset"]) for r in got.where("trace_id is null or trace_id = 't'").collect()}
    assert rest == {"a": (0, "a", None, 0), "b": (1, "a", None, 0), "c": (1, "a", None, 2), "d": (2, "a", None, 0), "x": (None, None, "cycle", 0), "y": (None, None, "cycle", 0), "z": (None, None, "cycle", 1), "s": (None, None, "cycle", 0), "o": (0, "o", "orphan", 0), "p": (1, "o", "orphan", 0), "n": (0, "n", None, 0), "m": (1, "n", None, 0)}
    got.unpersist()
    assert records.span_tree(odd.limit(0)).collect() == []


def test_corpus_verbatim_against_all_pairs(spark):
    r = random.Random(11)
    make = lambda n: [r.choice("abcdefg") for _ in range(n)]
    chunks = [(i, make(r.randint(0, 40))) for i in range(25)]
    chunks += [(100 + i, chunks[i][1]) for i in range(5)] + [(200, None)]
    claims = [(i, make(r.randint(0, 20)) + (chunks[i][1][2:14] if i % 2 else [])) for i in range(16)] + [(90, None)]
    want = {}
    for c, t in claims:
        found = []
        for k, u in chunks:
            for a in range(len(t or ())):
                for b in range(len(u or ())):
                    n = 0
                    while a + n < len(t) and b + n < len(u) and t[a + n] == u[b + n]:
                        n += 1
                    if n >= 4:
                        found.append((-n, a, k, b))
        if found:
            n, a, k, b = min(found)
            want[c] = (-n, k, a, b)
    kind = "array<string>"
    got = records.corpus_verbatim(spark.createDataFrame(claims, f"claim_id int, tokens {kind}"), spark.createDataFrame(chunks, f"chunk_id int, tokens {kind}"), 4)
    assert {r["claim_id"]: tuple(r)[1:] for r in got.collect()} == want and len(want) > 8


# --- terms and numbers


def brute_terms(text, vocabulary):
    folded = {v: v.lower().translate(str.maketrans(X._MARKED, X._PLAIN)) for v, _ in vocabulary}
    longest = sorted(set(folded.values()), key=lambda v: -len(v))
    found = set(re.findall(rf"\b(?:{'|'.join(map(re.escape, longest))})\b", text.lower().translate(str.maketrans(X._MARKED, X._PLAIN))))
    return [v for v, _ in sorted(vocabulary, key=lambda x: (x[1], x[0])) if folded[v] in found]


@pytest.mark.parametrize("sent", [200_000, 2])
def test_terms_against_one_regular_expression(spark, monkeypatch, sent):
    monkeypatch.setattr(terms, "SENT_ROWS", sent)
    vocabulary = [("carro velho", 5), ("carro", 1), ("óleo", 2), ("OLEO", 7), ("velho motor", 3), ("motor-x1", 4), ("mesa de", 6), ("de a", 9), ("a", 8), ("_id", 10)]
    r = random.Random(12)
    texts = ["".join(r.choice(WORDS) + r.choice([" ", " ", "-", ", ", "_", "  "]) for _ in range(r.randint(0, 14))) for _ in range(80)] + ["", "mesada carrosvelho", "my _id is", "Ωmesa de Ω"]
    df = spark.createDataFrame([*enumerate(texts), (500, None)], "chunk_id int, text string")
    got = {x["chunk_id"]: x["terms"] for x in terms.used_terms(df, spark.createDataFrame([*vocabulary, (None, 0)], "term string, position int")).collect()}
    assert got == {**{i: brute_terms(t, vocabulary) for i, t in enumerate(texts)}, 500: []}


def test_a_hundred_thousand_terms(spark):
    vocabulary = spark.range(100_000).select(F.concat(F.lit("term "), F.col("id")).alias("term"), "id").withColumnRenamed("id", "position")
    df = spark.createDataFrame([(1, "a term 99999, term 7 and Term 12"), (2, "term x")], "chunk_id int, text string")
    got = {x["chunk_id"]: x["terms"] for x in terms.used_terms(df, vocabulary).collect()}
    assert got == {1: ["term 7", "term 12", "term 99999"], 2: []}
    with pytest.raises(ValueError, match="c\\+\\+"):
        terms.used_terms(df, spark.createDataFrame([("c++", 1)], "term string, position int"))
    assert terms.used_terms(df, vocabulary.limit(0)).where("size(terms) = 0").count() == 2


@pytest.mark.parametrize("expected, text, tolerance, want", [("0.1234567", "is 0.1234567", 1e-9, True), ("1234567890123", "1234567890123", 0.5, True), (" 4,5 ", "4.5", 0.01, True), ("63", "163", 0.5, False)])
def test_numbers_of_any_length(spark, expected, text, tolerance, want):
    assert spark.range(1).select(X.value_matches(F.lit(expected), F.lit(text), F.lit(tolerance))).first()[0] is want


@pytest.mark.parametrize("expected", [".5", "5.", "1e3", "", "-1", "1 2"])
def test_what_is_no_number_as_a_whole(spark, expected):
    with pytest.raises(Exception, match="a tolerance needs a number"):
        spark.range(1).select(X.value_matches(F.lit(expected), F.lit("5"), F.lit(0.5))).collect()


# --- lines


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("one\n\n\rthree")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = corpus.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["line"], r["raw"]) for r in got if r["file"].endswith("a.txt")) == [(i, t) for i, t in enumerate(lines, 1)]
    assert sorted((r["line"], r["raw"]) for r in got if r["file"].endswith("b.txt")) == [(1, "one"), (2, ""), (3, "\rthree")]


def test_every_problem_of_facts_is_told(spark, tmp_path):
    good = '{"fact_id": "%s", "question": "q", "phrasing": "keyword", "expected_value": "v", "chunk_ids": ["c"]}'
    lines = [good % "a", "", good % "a", "{not json", good % "Not A Slug", '{"fact_id": "b", "question": "q", "phrasing": "odd", "expected_value": "v", "chunk_ids": ["c", "c"], "tolerance": 0}', good % "c"]
    path = tmp_path / "facts.jsonl"
    path.write_text("\n".join(lines) + "\n")
    want = ["line 2: blank", "line 3: fact_id a again", "line 4: malformed", "line 5: fact_id is not a slug", "line 6: phrasing", "line 6: chunk_ids", "line 6: tolerance"]
    with pytest.raises(corpus.CorpusError) as told:
        corpus.load_facts(spark, str(path))
    assert str(told.value).split("\n") == want
    assert corpus.fact_problems(spark, str(path)).count() == len(want)
    (tmp_path / "none.jsonl").write_text("")
    with pytest.raises(corpus.CorpusError, match="no facts"):
        corpus.load_facts(spark, str(tmp_path / "none.jsonl"))
    (tmp_path / "q.jsonl").write_text('{"question_id": "a", "question": "x"}\n\n{"question_id": "a", "question": "x"}\n{"question": 1}\n')
    with pytest.raises(corpus.CorpusError, match="line 3: question_id a again\nline 4: malformed"):
        corpus.load_questions(spark, str(tmp_path / "q.jsonl"))
