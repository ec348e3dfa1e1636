"""From a corpus to a measured run, a baseline and a gate, by the command line."""

import hashlib
import json

import pytest

from lexiloom import cli
from lexiloom.functions.embedding import HashedEmbedder
from lexiloom.operators import measure, runs
from lexiloom.sources import corpus

TEXTS = {"one.md": "# Manual\n\n## Valves\n\nThe valve clearance is 0.25 mm cold.\n", "deep/two.md": "# Forum\n\nThe flywheel bolt takes 35 Nm.\n"}


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    lines = ["manifest_version: 1", "corpus_id: c", "documents:"]
    for i, (name, text) in enumerate(TEXTS.items()):
        path = folder / "sources" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        lines.append(f"  - {{doc_id: d{i}, title: t, publisher: p, year: 1990, tier: {'AB'[i]}, provenance: x, filename: {name}, sha256: '{hashlib.sha256(text.encode()).hexdigest()}', rights: r}}")
    (folder / "manifest.yaml").write_text("\n".join(lines) + "\n")
    assert cli.main(["ingest", str(folder), str(folder / "artifact"), "--embedder", "hashed"]) == 0
    ids = {r["doc_id"]: r["chunk_id"] for r in corpus.Artifact(spark, str(folder / "artifact")).table("chunks").collect()}
    facts = [{"fact_id": "clearance", "question": "valve clearance", "phrasing": "keyword", "expected_value": "0.25", "chunk_ids": [ids["d0"]], "tolerance": 0.01}, {"fact_id": "bolt", "question": "flywheel bolt", "phrasing": "natural", "expected_value": "36", "chunk_ids": [ids["d1"]], "tolerance": 0.5}]
    (folder / "facts.jsonl").write_text("".join(json.dumps(f) + "\n" for f in facts))
    return folder


def test_evaluate_promote_and_gate(spark, place, capsys):
    asked = [str(place / "artifact"), str(place / "facts.jsonl")]
    stored, baselines = str(place / "runs"), str(place / "baselines")
    assert cli.main(["evaluate", *asked, "--runs", stored, "--corpus", str(place)]) == 0
    out = capsys.readouterr().out
    told = json.loads(out[out.index("{") :])
    assert told["arms"]["lexical"]["recall@1"] == 1.0 and told["arms"]["lexical"]["value_match@1"] == 0.5 and told["arms"]["lexical"]["recall@10:natural"] == 1.0
    assert cli.main(["promote", told["run_id"], stored, baselines]) == 0
    assert cli.main(["gate", *asked, stored, baselines, "--corpus", str(place)]) == 0
    assert "lexical: gates nothing" in capsys.readouterr().out
    record = runs.read_record(spark, stored, fields=measure.RUN_FIELDS)
    baseline = runs.read_record(spark, baselines, fields=measure.BASELINE_FIELDS)
    gated = {**baseline, "tolerance": 0.5, "arms": [{**a, "gated_metrics": ["recall@1"]} for a in baseline["arms"]]}
    again = measure.promoted(record, gated)
    assert again["tolerance"] == 0.5 and again["arms"][0]["gated_metrics"] == ["recall@1"]
    worse = {**record, "arms": [{**a, "metrics": {**a["metrics"], "recall@1": 0.2}, "per_item": [{**i, "hit_rank": None} for i in a["per_item"]]} for a in record["arms"]]}
    got = {(r["finding"], r["subject"]) for r in measure.findings(spark, gated, worse, record).collect()}
    assert got == {("failed", "recall@1"), ("moved", "bolt"), ("moved", "clearance")}
    failures, _ = measure.gate_problems(spark, worse, stored, baselines)
    assert failures == [f"the newest stored run, {record['run_id']}, is not what is measured now"]
    with pytest.raises(corpus.CorpusError, match="not measured"):
        measure.promoted(worse, {**gated, "arms": [{**gated["arms"][0], "gated_metrics": ["gone"]}]})
    with pytest.raises(ValueError, match="not known"):
        runs.read_record(spark, stored, fields=measure.BASELINE_FIELDS)


def test_an_artifact_of_another_kind_is_refused(spark, place, tmp_path):
    artifact = corpus.Artifact(spark, str(place / "artifact"))
    own = HashedEmbedder()
    assert artifact.verified(measure.identity(own))["dimension"] == own.dimension
    with pytest.raises(corpus.CorpusError) as wrong:
        artifact.verified(measure.identity(HashedEmbedder(dimension=64, query_prefix="query: "), "other"))
    assert [line.split(":")[0] for line in str(wrong.value).splitlines()] == ["corpus_hash", "embedder", "dimension"]
    with pytest.raises(corpus.CorpusError, match="ever built"):
        corpus.Artifact(spark, str(tmp_path / "none")).verified({})
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0]), ("c", None)], "chunk_id string, embedding array<float>")
    assert [w.split(":")[0] for w in measure.wrong_dimensions(vectors, 2)] == ["b", "c"]


def test_facts_of_chunks_that_are_gone(spark, place, tmp_path, capsys):
    lost = tmp_path / "facts.jsonl"
    lost.write_text(json.dumps({"fact_id": "a", "question": "q", "phrasing": "keyword", "expected_value": "4", "chunk_ids": ["x", "y"]}) + "\n")
    assert cli.main(["evaluate", str(place / "artifact"), str(lost)]) == 1
    assert "x, y" in capsys.readouterr().err
