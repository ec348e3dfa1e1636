"""Command line: ``python -m lexiloom.cli validate|ingest|evaluate|gate|promote|embedder|query``."""

from __future__ import annotations

import argparse
import json
import sys


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("lexiloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _manifest(spark, folder: str):
    from lexiloom.sources import corpus

    manifest = corpus.parse_manifest(corpus.whole_text(spark, f"{folder}/manifest.yaml"))
    return manifest, corpus.manifest_table(spark, manifest)


def validate(args: argparse.Namespace) -> int:
    from lexiloom.sources import corpus

    spark = _session()
    manifest, docs = _manifest(spark, args.corpus)
    wrong = corpus.verify_digests(docs, f"{args.corpus}/sources").collect()
    for r in wrong:
        print(f"{r['doc_id']}: {r['filename']} {r['problem']}", file=sys.stderr)
    print(json.dumps({"corpus_hash": corpus.corpus_hash(manifest), "documents": len(manifest["documents"]), "wrong": len(wrong)}))
    return int(bool(wrong))


def ingest(args: argparse.Namespace) -> int:
    from lexiloom.functions.analysis import ANALYZER_VERSION
    from lexiloom.functions.embedding import embed, embedder_for
    from lexiloom.operators import chunking
    from lexiloom.operators.lexical import postings
    from lexiloom.operators.measure import wrong_dimensions
    from lexiloom.sources import corpus

    if validate(args):
        return 1
    spark = _session()
    manifest, docs = _manifest(spark, args.corpus)
    chunks = chunking.chunk_documents(corpus.source_texts(docs, f"{args.corpus}/sources")).join(docs.select("doc_id", "tier", "title"), "doc_id")
    tables = {"documents": docs, "chunks": chunks, "postings": postings(chunks)}
    meta = {"corpus_hash": corpus.corpus_hash(manifest), "analyzer_version": ANALYZER_VERSION}
    embedder = embedder_for(args.embedder)
    if embedder:
        from pyspark.sql import functions as F

        tables["embeddings"] = chunks.select("chunk_id", F.lit(embedder.model_key).alias("model_key"), embed(F.col("text"), embedder).alias("embedding"))
        meta |= {"model_key": embedder.model_key, "embedder": embedder.fingerprint, "dimension": embedder.dimension}
    wrong = wrong_dimensions(tables["embeddings"], embedder.dimension) if embedder else []
    if wrong:
        print("\n".join(wrong), file=sys.stderr)
        return 1
    broken = [r["rule"] for r in corpus.violations(docs, chunks).collect() if r["n"]]
    if broken:
        print(f"constraints broken: {', '.join(broken)}", file=sys.stderr)
        return 1
    print(json.dumps({"build": corpus.Artifact(spark, args.artifact).build(tables, meta), **meta}))
    return 0


def _measured(args: argparse.Namespace):
    """The session and the record of a run of the arguments' artifact, facts, embedder and corpus."""
    import datetime as dt

    from lexiloom.functions.embedding import embedder_for
    from lexiloom.operators import measure
    from lexiloom.sources import corpus

    spark = _session()
    expected = corpus.corpus_hash(_manifest(spark, args.corpus)[0]) if args.corpus else None
    return spark, measure.measured_run(spark, corpus.Artifact(spark, args.artifact), args.facts, embedder_for(args.embedder), dt.datetime.now(dt.UTC), expected)


def evaluate(args: argparse.Namespace) -> int:
    from lexiloom.operators import runs
    from lexiloom.sources.corpus import CorpusError

    try:
        spark, record = _measured(args)
    except CorpusError as wrong:
        print(wrong, file=sys.stderr)
        return 1
    if args.runs:
        runs.write_record(spark, args.runs, record["run_id"], record)
    print(json.dumps({"run_id": record["run_id"], "arms": {a["configuration"]["strategy"]: a["metrics"] for a in record["arms"]}}, indent=2, sort_keys=True))
    return 0


def gate(args: argparse.Namespace) -> int:
    from lexiloom.operators import measure
    from lexiloom.sources.corpus import CorpusError

    try:
        spark, record = _measured(args)
        failures, notes = measure.gate_problems(spark, record, args.runs, args.baselines)
    except (CorpusError, LookupError, ValueError) as wrong:
        failures, notes = [str(wrong)], []
    print("\n".join([*(f"note: {n}" for n in notes), f"gate: {'failed' if failures else 'pass'}"]))
    for f in failures:
        print(f, file=sys.stderr)
    return int(bool(failures))


def promote(args: argparse.Namespace) -> int:
    import datetime as dt

    from lexiloom.operators import measure, runs
    from lexiloom.sources.corpus import Artifact

    spark = _session()
    record = runs.read_record(spark, args.runs, args.run_id, measure.RUN_FIELDS)
    held = Artifact(spark, args.baselines).has("")
    previous = runs.read_record(spark, args.baselines, fields=measure.BASELINE_FIELDS) if held else None
    baseline = measure.promoted(record, previous, args.tolerance)
    runs.write_record(spark, args.baselines, runs.compact(dt.datetime.now(dt.UTC)), baseline)
    print(json.dumps({a["configuration"]["strategy"]: a["gated_metrics"] for a in baseline["arms"]}, sort_keys=True))
    return 0


def embedder(args: argparse.Namespace) -> int:
    from lexiloom.functions.embedding import embedder_for
    from lexiloom.sources.corpus import Artifact

    own = embedder_for(args.name)
    out = {"model_key": own.model_key, "dimension": own.dimension, "fingerprint": own.fingerprint} if own else {}
    if args.artifact:
        meta = Artifact(_session(), args.artifact).current()[1]
        out["stored"] = {k: meta.get(k) for k in ("model_key", "dimension", "embedder")}
    print(json.dumps(out, indent=2, sort_keys=True))
    return 0


def query(args: argparse.Namespace) -> int:
    from lexiloom.plans import QUERIES

    QUERIES[args.name](_session(), args.folder).show(args.rows, truncate=False)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexiloom")
    commands = top.add_subparsers(required=True)

    def command(f, *names: str, **options: dict) -> None:
        p = commands.add_parser(f.__name__)
        p.set_defaults(run=f)
        for n in names:
            p.add_argument(n)
        for n, o in options.items():
            p.add_argument(f"--{n}", **o)

    command(validate, "corpus")
    command(ingest, "corpus", "artifact", embedder={"default": "none"})
    measured = {"embedder": {"default": "none"}, "corpus": {"default": None}}
    command(evaluate, "artifact", "facts", runs={"default": None}, **measured)
    command(gate, "artifact", "facts", "runs", "baselines", **measured)
    command(promote, "run_id", "runs", "baselines", tolerance={"type": float, "default": 0.014})
    command(embedder, "name", artifact={"default": None})
    command(query, "name", "folder", rows={"type": int, "default": 20})
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
