"""The pipeline's stages against what they promise."""

import corpus_pipeline as pipeline
from lexiloom.llm.shared import staged


def test_stages_on_edge_cases(spark, docs, rows):
    clash = docs.selectExpr("*", "1 as lang_pred", "'x' as secrets", "2 as _row", "3 as copies")
    after, now = {}, clash
    for name, stage in pipeline.STAGES:
        now = staged(stage(spark, now, ""), f"test-{name}")
        after[name] = now
        if name != "packing":
            assert now.columns == docs.columns
    kept = {r["doc_id"] for r in after["language"].collect()}
    # 108 has letters that the few labelled rows lack: no more like a language than chance
    assert {100, 101, 102, 103} <= {r[0] for r in rows} - kept <= {100, 101, 102, 103, 108}
    left = sorted((r["doc_id"] for r in after["near_duplicates"].collect()), key=str)
    gone = {104, 105, 106}
    assert left == sorted(kept - gone, key=str)
    assert "AKIA" not in "".join(r["text"] for r in after["secrets"].collect())
    assert {r["doc_id"] for r in after["mixing"].collect()} <= kept


def test_empty_table(spark, empty):
    now = empty
    for _, stage in pipeline.STAGES:
        now = staged(stage(spark, now, ""), "test-empty")
    assert now.count() == 0


def test_language_rejects_the_alien_and_keeps_the_short(spark):
    import random

    r = random.Random(3)
    written = lambda parts, n: " ".join("".join(r.choice(parts) for _ in range(r.randint(2, 4))) for _ in range(n))
    tongues = {"xa": ("ka", "lo", "mi", "ten", "ra"), "xb": ("zwo", "pef", "ug", "ist", "on")}
    rows = [(1000 + i, written(tongues[lang], 30), lang) for i, lang in enumerate(["xa", "xb"] * 60)]
    known = [(i, written(tongues[lang], 30), None) for i, lang in enumerate(["xa", "xb"] * 5)]
    scripts = ("абвгдежзийклмнопрстуфхцчшщы", "αβγδεζηθικλμνξοπρστυφχψω", "abcdefghijklmnopqrstuvwxyz")
    alien = [(100 + i, written(scripts[i % 3], 60), "xa" if i % 20 == 0 else None) for i in range(60)]
    short = [(200, "Avec.", "xa"), (201, "да", None)]
    docs = spark.createDataFrame([(d, t, lang, "s", len(t)) for d, t, lang in rows + known + alien + short], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x["doc_id"]: x["lang"] for x in pipeline.language_stage(spark, docs, "").collect()}
    assert {d: kept.get(d) for d, _, _ in known} == {i: ("xa", "xb")[i % 2] for i in range(10)}
    assert not [d for d, _, _ in alien if d in kept]
    assert all(d in kept for d, _, _ in rows)
    assert kept.get(200) == "xa" and 201 in kept and kept[201] is None


def test_rows_that_share_a_doc_id_are_told_apart(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(1, one), (5, one), (5, two), (5, two), (7, two), (9, three), (9, one), (None, three)]
    docs = spark.createDataFrame([(d, t, "xa", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r["doc_id"], r["text"]) for r in pipeline.duplicates_stage(spark, docs, "").collect()]
    assert sorted(left) == [(1, one), (5, two), (9, three)]
