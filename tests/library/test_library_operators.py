"""Operators on small tables: the behaviours that a user relies on."""

import json

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import answers, chunking, dense, evaluation, lexical, records
from lexiloom.sources import corpus
from lexiloom.streaming import policies

MARKDOWN = """# Cylinder head
<!-- page: 3 -->
| Fastener | Torque (N·m) | Note |
|---|---|---|
| Bolt, stage 1 | 41 | |
| Bolt, stage 2 | 90 | oil |

| Bolt, stage 3 | 12 | |

## Steps
1. Loosen the cover
   and the belt.
2. Lift it.

First sentence. Second one here.
Wrapped line.

Third paragraph.
---
<!-- page: 4 -->
Alone on its page.
"""


def test_markdown_chunks(spark):
    got = chunking.chunk_documents(spark.createDataFrame([("d", MARKDOWN), ("e", None)], "doc_id string, text string")).orderBy("ordinal").collect()
    assert [(r["kind"], r["page"], r["text"]) for r in got] == [
        ("spec", 3, "Cylinder head — Fastener: Bolt, stage 1; Torque (N·m): 41; Note: "),
        ("spec", 3, "Cylinder head — Fastener: Bolt, stage 2; Torque (N·m): 90; Note: oil"),
        ("spec", 3, "Cylinder head — Fastener: Bolt, stage 3; Torque (N·m): 12; Note: "),
        ("procedure", 3, "Steps — step 1: Loosen the cover and the belt."),
        ("procedure", 3, "Steps — step 2: Lift it."),
        ("prose", 3, "First sentence. Second one here. Wrapped line."),
        ("prose", 3, "Wrapped line. Third paragraph."),
        ("prose", 4, "Alone on its page."),
    ]
    assert [r["chunk_id"] for r in got] == [f"d#{i:04d}" for i in range(8)]


def test_chunks_keep_signs_and_find_terms(spark):
    text = "## Wiring in C#\n| a | b |\n|---|:-:|\n| 1 |\n|  |  |\n\n| 2 | 3 | 4 |\n# Other\n| 5 |\n  x\n1. One\n\ttwo\nthree\n\n  2. Own\n"
    got = chunking.chunk_documents(spark.createDataFrame([("d", text)], "doc_id string, text string"), ["own", "two"]).orderBy("ordinal").collect()
    assert [(r["kind"], r["text"], r["jargon_terms"]) for r in got] == [
        ("spec", "Wiring in C# — a: 1", []),
        ("spec", "Wiring in C# — a: 2; b: 3; 4", []),
        ("spec", "Other — 5", []),
        ("prose", "x", []),
        ("procedure", "Other — step 1: One two", ["two"]),
        ("prose", "three", []),
        ("procedure", "Other — step 2: Own", ["own"]),
    ]


def test_dense_ties_and_limits(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0]), (5, None)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    got = dense.top_dense(v, v.where("id = 1"), 3).orderBy("cosine", F.desc("id")).collect()
    assert sorted((r["id"], r["cosine"], r["rank"]) for r in got) == [(2, 1.0, 1), (3, 0.0, 3), (4, 1.0, 1)]
    assert dense.top_dense(v, v.where("id = 99"), 3).count() == 0
    assert dense.clamped(10_000) == 50
    with pytest.raises(ValueError):
        dense.clamped(0)


def test_lexical_strict_then_loose(spark):
    chunks = spark.createDataFrame([("a", "valve clearance intake 0.3", "A"), ("b", "valve cover bolts", "A"), ("c", "flywheel bolt torque", "B")], "chunk_id string, text string, tier string")
    asked = spark.createDataFrame([(1, "valve clearance"), (2, "valve wastegate"), (3, "what is the"), (4, "turbocharger")], "qid int, question string")
    got = {}
    for r in lexical.retrieve(asked, chunks, 5, ("A", "B")).orderBy("position").collect():
        got.setdefault(r["qid"], []).append(r["chunk_id"])
    assert got == {1: ["a"], 2: ["a", "b"]}
    assert lexical.retrieve(asked, chunks, 5, ("B",)).count() == 0
    with pytest.raises(ValueError):
        lexical.retrieve(asked, chunks, 5, ("C",))


def test_gate(spark):
    base = spark.createDataFrame([("s", "mrr", 0.75, True), ("s", "ndcg", 0.8, True), ("s", "gone", 0.5, True), ("s", "free", 0.5, False)], "strategy string, metric string, value double, gated boolean")
    run = spark.createDataFrame([("s", "mrr", 0.74, None), ("s", "ndcg", 0.7, None), ("s", "free", 0.1, None), ("s", "more", 0.2, None)], "strategy string, metric string, value double, x string")
    got = {r["metric"]: r["verdict"] for r in evaluation.gate(base, run, 0.014).collect()}
    assert got == {"mrr": "ok", "ndcg": "failed", "gone": "missing", "free": "ok", "more": "new"}
    assert {r["metric"]: r["gated"] for r in evaluation.promoted(run, base).collect()} == {"mrr": True, "ndcg": True, "free": False, "more": False}


def test_questions_without_results_count_as_misses(spark):
    ranking = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "qid int, id string, position int")
    facts = spark.createDataFrame([(1, ["y"]), (2, ["z"])], "qid int, relevant array<string>")
    row = evaluation.aggregate(evaluation.per_question(evaluation.ranked_lists(ranking, facts))).first()
    assert (row["questions"], row["mrr"], row["recall_at_1"], row["recall_at_10"], row["candidates_at_k"]) == (2, 0.25, 0.0, 0.5, 1.0)


def test_spread_keeps_nulls(spark):
    rows = spark.createDataFrame([("a", 1, 3), ("a", 2, None), ("a", 3, 3)], "g string, i int, v int")
    r = records.spread(rows, ["g"], "v", "i").first()
    assert (r["n"], r["minimum"], r["maximum"], r["distinct_values"], r["spread_values"]) == (3, 3, 3, 1, [3, None, 3])
    assert records.displayed(rows.na.fill(9), ["g"], "v", "i").first()["i"] == 3


def test_overlap(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "qid int, id string, position int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "qid int, id string, position int")
    r = records.agreement(records.overlap(a, b)).first()
    assert (r["common"], r["only_one"], r["only_other"], r["same_members"], r["same_order"]) == (1, 1, 1, False, False)


def test_span_tree(spark):
    spans = spark.createDataFrame([("t", "a", None, 0, 10), ("t", "b", "a", 1, 4), ("t", "c", "a", 4, 9), ("t", "d", "c", 5, 6)], "trace_id string, span_id string, parent_span_id string, started long, ended long")
    assert {r["span_id"]: (r["depth"], r["offset"]) for r in records.span_tree(spans).collect()} == {"a": (0, 0), "b": (1, 0), "c": (1, 3), "d": (2, 0)}


def test_span_tree_of_a_long_chain(spark):
    chain = [("t", i, i - 1 if i else None, i, i + 1) for i in range(130)]
    got = records.span_tree(spark.createDataFrame(chain, "trace_id string, span_id int, parent_span_id int, started long, ended long"))
    assert sorted((r["span_id"], r["depth"]) for r in got.collect()) == [(i, i) for i in range(130)]


@pytest.mark.parametrize(
    "payload, status, support, invalid",
    [
        ({"abstained": False, "claims": [{"text": "a", "citations": [1, 1, 2]}]}, "ok", "supported", 0),
        ({"abstained": False, "claims": [{"text": "a", "citations": [9, "1", True]}, {"text": "b", "citations": [2]}]}, "ok", "partially_supported", 3),
        ({"abstained": False, "claims": [{"text": "a"}]}, "ok", "unsupported", 0),
        ({"abstained": True, "claims": [{"text": "a", "citations": [1]}], "reason": "no"}, "abstained", "not_applicable", 0),
        ({"abstained": False, "claims": []}, "abstained", "not_applicable", 0),
        ({"abstained": "false", "claims": []}, "malformed", "not_applicable", 0),
        ({"abstained": False, "claims": [{"text": " "}]}, "malformed", "not_applicable", 0),
        ({"abstained": False, "claims": [{"text": "a", "citations": 3}]}, "malformed", "not_applicable", 0),
        ("{\"abstained\": fal", "malformed", "not_applicable", 0),
        ([1], "malformed", "not_applicable", 0),
    ],
)
def test_validate(spark, payload, status, support, invalid):
    df = spark.createDataFrame([(payload if isinstance(payload, str) else json.dumps(payload), ["c1", "c2"])], "payload string, context array<string>")
    r = answers.validate(df).first()
    assert (r["status"], r["support"], r["invalid_citations"]) == (status, support, invalid)


def test_citations_and_cost(spark):
    payload = json.dumps({"abstained": False, "claims": [{"text": "a", "citations": [2, 2]}]})
    df = answers.validate(spark.createDataFrame([(1, payload, ["c1", "c2"])], "answer_id int, payload string, context array<string>"))
    assert df.first()["claims"][0]["citations"][0]["chunk_id"] == "c2"
    assert answers.citation_violations(df).first()[1:] == (0, 0)
    cost = answers.with_cost(spark.createDataFrame([("small", 1_000_000, -5), ("none", 1, 1)], "model string, tokens_in long, tokens_out long"), {"small": (0.10, 0.40)})
    got = {r["model"]: (r["tokens_total"], None if r["cost_usd"] is None else float(r["cost_usd"])) for r in cost.collect()}
    assert got == {"small": (1_000_000, 0.1), "none": (2, None)}


def test_numbered_context(spark):
    df = spark.createDataFrame([(1, 2, "c2", "B", "T", None, None, "two"), (1, 1, "c1", "A", "T", "S", 4, "one")], "qid int, position int, chunk_id string, tier string, title string, section string, page int, text string")
    r = answers.numbered_context(df).first()
    assert r["context"] == ["c1", "c2"] and r["prompt"] == "[1] (A — T — S — p. 4)\none\n\n[2] (B — T)\ntwo"


def test_token_bucket_batch_and_stream_agree(spark, tmp_path):
    rows = [(i, f"c{i % 3}", float(i * 7 % 50)) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, client string, at double").orderBy("at", "event_id")
    batch = {r["event_id"]: (r["allowed"], r["retry_after"]) for r in policies.token_bucket(events, 6).collect()}
    assert not all(a for a, _ in batch.values()) and all(w == 0 if a else w >= 1 for a, w in batch.values())
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = policies.token_bucket_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 6)
    q = stream.writeStream.format("memory").queryName("bucket").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r["event_id"]: (r["allowed"], r["retry_after"]) for r in spark.sql("select * from bucket").collect()} == batch


def test_budgets_against_a_plain_fold(spark):
    import random

    r = random.Random(4)
    rows = [(i, f"c{r.randint(0, 5)}", f"d{i // 60}", float(i)) for i in range(240)]
    got = {x["event_id"]: x["reason"] for x in policies.admitted(spark.createDataFrame(rows, "event_id long, client string, day string, at double"), 6, 25).collect()}
    used, total, want = {}, {}, {}
    for i, c, d, _ in rows:
        if used.get((c, d), 0) >= 6:
            want[i] = "client_daily"
        elif total.get(d, 0) >= 25:
            want[i] = "global_daily"
        else:
            want[i] = None
            used[c, d] = used.get((c, d), 0) + 1
            total[d] = total.get(d, 0) + 1
    assert got == want
    requests = spark.createDataFrame([(*x, "request") for x in rows], "event_id long, client string, day string, at double, kind string")
    assert {x["event_id"]: x["reason"] for x in policies.admitted_with_refunds(requests, 6, 25).collect()} == want


def test_refunds_and_forgotten_clients(spark):
    kinds = [("a", "request"), ("a", "request"), ("a", "refund"), ("a", "request"), ("a", "refund"), ("a", "refund"), ("b", "request"), ("b", "request"), ("a", "request")]
    df = spark.createDataFrame([(i, c, "d", float(i), k) for i, (c, k) in enumerate(kinds)], "event_id long, client string, day string, at double, kind string")
    got = [r["reason"] for r in policies.admitted_with_refunds(df, 1, 9).orderBy("event_id").collect()]
    assert got == [None, "client_daily", None, None, None, None, None, "client_daily", None]
    forgetful = [r["reason"] for r in policies.admitted_with_refunds(df.where("kind = 'request'"), 1, 9, tracked=1).orderBy("event_id").collect()]
    assert forgetful == [None, "client_daily", "client_daily", None, "client_daily", None]


def test_cache_expiry_and_eviction(spark):
    rows = [(0, "a", 0.0, 1), (1, "a", 5.0, 1), (2, "a", 10.0, 1), (3, "b", 11.0, 1), (4, "c", 12.0, 1), (5, "a", 13.0, 1)]
    e = spark.createDataFrame(rows, "event_id long, key string, at double, shard int")
    assert {r["event_id"]: r["hit"] for r in policies.cached(e, 10.0).collect()} == {0: False, 1: True, 2: False, 3: False, 4: False, 5: True}
    assert {r["event_id"]: r["hit"] for r in policies.cached_in_order(e, 2, 10.0).collect()}[5] is False


MANIFEST = """manifest_version: 1
corpus_id: c
documents:
  - {doc_id: d1, title: t, publisher: p, year: 1990, tier: A, provenance: x, filename: a.md, sha256: "%s", rights: r}
  - {doc_id: d2, title: t, publisher: p, year: 1991, tier: B, provenance: x, filename: b.md, sha256: "00", rights: r}
"""


def test_manifest_digests_and_artifact(spark, tmp_path):
    import hashlib

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.md").write_text("# A\ntext\n")
    manifest = corpus.parse_manifest(MANIFEST % hashlib.sha256(b"# A\ntext\n").hexdigest())
    docs = corpus.manifest_table(spark, manifest)
    assert [(r["doc_id"], r["problem"]) for r in corpus.verify_digests(docs, str(tmp_path / "src")).collect()] == [("d2", "missing")]
    assert corpus.source_texts(docs, str(tmp_path / "src")).first()["text"] == "# A\ntext\n"
    turned = {**manifest, "documents": manifest["documents"][::-1]}
    assert corpus.corpus_hash(manifest) == corpus.corpus_hash(turned)
    chunks = chunking.chunk_documents(corpus.source_texts(docs, str(tmp_path / "src")))
    assert {r["n"] for r in corpus.violations(docs, chunks).collect()} == {0}
    artifact = corpus.Artifact(spark, str(tmp_path / "artifact"))
    artifact.build({"chunks": chunks}, {"corpus_hash": "1"})
    artifact.build({"chunks": chunks.limit(0)}, {"corpus_hash": "2"})
    assert artifact.current()[1] == {"corpus_hash": "2"} and artifact.table("chunks").count() == 0
    with pytest.raises(corpus.CorpusError, match="more than once"):
        corpus.parse_manifest((MANIFEST % "0").replace("d2", "d1"))


def test_facts_and_questions(spark, tmp_path):
    good = {"fact_id": "a-1", "question": "q", "phrasing": "keyword", "expected_value": "4", "chunk_ids": ["x"], "tolerance": 0.5}
    path = tmp_path / "facts.jsonl"
    path.write_text(json.dumps(good) + "\n")
    assert corpus.load_facts(spark, str(path)).count() == 1
    path.write_text("\n".join([json.dumps(good), "", json.dumps(good), "{", json.dumps(good | {"fact_id": "B", "tolerance": 0})]) + "\n")
    with pytest.raises(corpus.CorpusError) as e:
        corpus.load_facts(spark, str(path))
    assert [x.split(":")[0] for x in str(e.value).splitlines()] == ["line 2", "line 3", "line 4", "line 5", "line 5"]
    path.write_text('{"question_id": "1", "question": "q", "why": "w"}\n\n')
    assert corpus.load_questions(spark, str(path)).count() == 1
