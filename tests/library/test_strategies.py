"""Strategies, embedders, recorded draws, and the entry point without the training-data half."""

import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.cli import parser
from lexiloom.functions.embedding import HashedEmbedder, embed, embedder_for
from lexiloom.operators import dense, retrievers, showcase

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("a", "valve clearance intake", "A", "T1", None, 1), ("b", "valve cover bolts", "A", "T1", "S", None), ("c", "flywheel bolt torque", "B", "T2", None, None)]
    return spark.createDataFrame(rows, "chunk_id string, text string, tier string, title string, section string, page int")


@pytest.fixture(scope="module")
def vectors(chunks):
    own = HashedEmbedder()
    return chunks.select("chunk_id", F.lit(own.model_key).alias("model_key"), embed(F.col("text"), own).alias("embedding"))


def test_embedder(spark):
    own = HashedEmbedder()
    x = own.vectors(["valve clearance", "valve clearance", ""])
    assert (x[0] == x[1]).all() and np.linalg.norm(x[0]) == pytest.approx(1) and not x[2].any()
    assert HashedEmbedder(dimension=8).fingerprint != own.fingerprint
    assert embedder_for("none") is None
    with pytest.raises(ValueError):
        embedder_for("other")
    got = spark.createDataFrame([("a",), (None,)], "t string").select(embed(F.col("t"), own)).collect()
    assert len(got[0][0]) == own.dimension and got[1][0] is None


def test_strategies(spark, chunks, vectors):
    asked = spark.createDataFrame([(1, "flywheel bolt torque"), (2, "zzz")], "qid int, question string")
    found = retrievers.available(chunks, vectors, HashedEmbedder())
    assert list(found) == ["lexical", "dense", "hybrid"] and list(retrievers.available(chunks)) == ["lexical"]
    first = {n: {r["qid"]: r["chunk_id"] for r in f.retrieve(asked, 2).where("position = 1").collect()} for n, f in found.items()}
    assert first["lexical"] == {1: "c"} and first["dense"][1] == "c" and first["hybrid"][1] == "c" and 2 in first["dense"]
    assert {r["chunk_id"] for r in found["dense"].retrieve(asked, 5, ("A",)).collect()} == {"a", "b"}
    other = retrievers.Dense(chunks, vectors.withColumn("model_key", F.lit("x")), HashedEmbedder())
    assert other.retrieve(asked).count() == 0


def test_draws_and_lookup(spark, chunks):
    asked = spark.createDataFrame([(1, "valve clearance"), (2, "zzz")], "qid int, question string")
    calls = []

    def generate(question, prompt):
        calls.append(question)
        if len(calls) == 2:
            raise RuntimeError("quota")
        return '{"abstained": false, "claims": [{"text": "x", "citations": [1]}]}', 5, 2

    got = showcase.draw(retrievers.available(chunks), asked, chunks, generate, n=2).collect()
    assert len(got) == 4 and calls == ["valve clearance"] * 2
    assert [r["payload"] is None for r in got] == [False, True, False, False]
    records = spark.createDataFrame([("Valve  clearance", "lexical", 10, ["B", "A"], "cited", "h", 1, "old"), ("valve clearance", "lexical", 10, ["A", "B"], "cited", "h", 2, "new")], "question string, strategy string, k int, tiers array<string>, contract string, corpus_hash string, recorded_at int, record_id string")
    wanted = spark.createDataFrame([("VALVE clearance", "lexical", 10, ["A", "B"], "cited", "h"), ("valve clearance", "dense", 10, ["A", "B"], "cited", "h")], "question string, strategy string, k int, tiers array<string>, contract string, corpus_hash string")
    assert {r["strategy"]: r["record_id"] for r in showcase.precomputed(records, wanted).collect()} == {"lexical": "new", "dense": None}
    assert showcase.diverges({"corpus_hash": "1"}, {"corpus_hash": "2"}) == ["corpus_hash"]
    assert showcase.for_record(chunks).columns == ["chunk_id", "tier", "title", "page"]


def test_draws_in_tasks(spark, chunks):
    asked = spark.createDataFrame([(1, "valve clearance"), (2, "zzz"), (3, "bolt")], "qid int, question string")

    def generate(question, prompt):
        if question == "bolt":
            raise RuntimeError("quota")
        return f'{{"abstained": false, "claims": [{{"text": "{len(prompt) > 0}", "citations": [1]}}]}}', 5, 2

    got = showcase.draw_in_tasks(retrievers.available(chunks), asked, chunks, generate, n=2, tasks=3).collect()
    assert sorted((r["qid"], r["sample"], r["payload"] is None, r["tokens_in"], r["generate_ms"] is None) for r in got) == [("1", 0, False, 5, False), ("1", 1, False, 5, False), ("2", 0, False, 0, True), ("2", 1, False, 0, True), ("3", 0, True, 0, False), ("3", 1, True, 0, False)]
    assert all(list(r["context"])[:1] == ["a"] for r in got if r["qid"] == "1") and showcase.draw_in_tasks({}, asked, chunks, generate).count() == 0


def test_command_line_parses():
    args = parser().parse_args(["ingest", "c", "a", "--embedder", "hashed"])
    assert (args.corpus, args.artifact, args.embedder) == ("c", "a", "hashed")


def test_the_rest_stands_without_the_training_half(tmp_path):
    for name in ("__spark_entry__.py", "lexiloom"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "lexiloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'dense_topk' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_few_queries_scan_vectors_as_cells_rank_them(spark, monkeypatch):
    """One pass over vectors, whose ties and zeros rank as in an index of cells; more queries than centres go to the cells."""
    rows = [(i, [float((i * 7 + j * j) % 5 - 2) for j in range(4)]) for i in range(150)] + [(150, None), (151, [])]
    vectors = spark.createDataFrame(rows, "id long, vector array<float>").repartition(5)
    asked = vectors.where("id % 15 = 0")
    ranked = lambda df: sorted(map(tuple, df.select("qid", "id", "cosine", "rank").collect()))
    want = ranked(dense.VectorIndex(vectors, 6).search(asked, 7))
    made = []
    monkeypatch.setattr(dense, "VectorIndex", lambda *a, index=dense.VectorIndex: (made.append(a), index(*a))[1])
    assert ranked(dense.top_dense(vectors, asked, 7)) == want and len(want) == 70 and not made
    monkeypatch.setattr(dense, "CELLS", 3)
    assert ranked(dense.top_dense(vectors, asked, 7)) == want and made
