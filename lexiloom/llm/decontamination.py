"""Benchmark passages in documents: a prefix-filtered join of shingle sets, verified word by word over windows of the item.

An item's windows are its runs of ``window`` words; a shorter item is one window. A window is the set of its shingles of
SHINGLE words (a shorter window's only shingle is itself), and it occurs in a document only where all of them do. So the
prefix that a join needs is one shingle long: shingles are ordered by rarity, counted over all documents, and the rarest of a
window stands for it. Where a document has that shingle, its place and the shingle's place in the window give the only place
the window can have there (positional bound), which must lie inside what matched (length bound). What is left is
compared word by word.

Documents are read once. A bit field of fixed size, made of the windows' shingles, tells which runs of a document's words may
hold a window, and only these runs are stored, as words. Everything after is joins on shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.shared import documents, staged
from lexiloom.llm.words import Hashes, bit_field, in_field, runs, words, words_of

#: Words of a window, and of a shingle.
WINDOW, SHINGLE = 10, 3
_RUNS = "n_words long, runs array<struct<start: int, words: string>>"


def _shingles(split: Column, size: Column | int) -> Column:
    """The runs of ``size`` words of an array, joined by blanks; none if it has fewer."""
    last = F.size(split) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(split, i + 1, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, win): the different windows of each item (item_id, text), words joined by blanks."""
    split = items.select("item_id", words(F.col("text")).alias("_words"))
    cut = F.when(F.size("_words") >= window, _shingles(F.col("_words"), window)).when(F.size("_words") > 0, F.array(F.array_join("_words", " ")))
    return split.select("item_id", F.explode(F.array_distinct(cut)).alias("win"))


def _spans(hashes: np.ndarray, field: np.ndarray, least: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words that may hold a window: for each shingle size and its windows' least length, stretches of shingles of
    the field that are long enough for such a window; ranges that touch or overlap are one."""
    covered = np.zeros(len(hashes) + 1, dtype=np.int64)
    for size, length in least:
        known = np.concatenate(([0], in_field(field, runs(hashes, size)).astype(np.int8), [0]))
        turns = np.flatnonzero(np.diff(known))
        starts, ends = turns[::2], turns[1::2]
        long = ends - starts > length - size
        np.add.at(covered, starts[long], 1)
        np.add.at(covered, ends[long] + size - 1, -1)
    inside = np.concatenate(([False], np.cumsum(covered[:-1]) > 0, [False]))
    turns = np.flatnonzero(np.diff(inside.astype(np.int8)))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


def _matched_runs(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, runs) of every row of docs (doc_id, text)."""
    length = F.size(F.split("win", " "))
    least = [(r["size"], r["length"]) for r in windows.groupBy(F.least(length, F.lit(SHINGLE)).alias("size")).agg(F.min(length).alias("length")).collect()]
    sizes = [s for s, _ in least]
    own = Hashes()
    field = bit_field(windows.select("win"), lambda raw: [runs(own.of(split), min(len(split), SHINGLE)) for split in [raw.split(b" ")]])
    form = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            counts, found = [], []
            for raw in batch.column("raw").to_pylist():
                split = words_of(raw)
                counts.append(len(split))
                spans = _spans(hashes.of(split), field.value, least) if split and sizes else []
                found.append([{"start": a, "words": b" ".join(split[a:b]).decode()} for a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, form)], ["doc_id", "n_words", "runs"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return staged(read.mapInArrow(run, f"doc_id long, {_RUNS}").withColumn("row", F.monotonically_increasing_id()), "runs")


def occurrences(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row of docs as (row, doc_id, n_words), and its stretches with windows, as (row, found: array of at, length, win)
    with places inside the stretch."""
    distinct = staged(windows.select("win").distinct(), "windows")
    rows = _matched_runs(docs, distinct)
    stretches = staged(rows.select("row", F.posexplode("runs").alias("run", "r")).select("row", "run", F.split("r.words", " ").alias("words")), "stretches")
    # rarity of the windows' shingles over all documents
    size = F.least(F.size(F.split("win", " ")), F.lit(SHINGLE))
    of_window = distinct.select("win", F.posexplode(_shingles(F.split("win", " "), size)).alias("offset", "shingle"))
    short = distinct.where(F.size(F.split("win", " ")) < SHINGLE).limit(1).count()
    cut = F.posexplode(_shingles(F.col("words"), SHINGLE)).alias("place", "shingle")
    posted = stretches.select("row", "run", F.size("words").alias("size"), cut)
    for s in range(1, SHINGLE) if short else ():
        posted = posted.unionByName(stretches.select("row", "run", F.size("words").alias("size"), F.posexplode(_shingles(F.col("words"), s)).alias("place", "shingle")))
    counts = posted.groupBy("shingle").agg(F.count("*").alias("n")).select(F.col("shingle").alias("_shingle"), "n")
    rarity = of_window.join(counts, F.col("shingle") == F.col("_shingle"), "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "shingle")).alias("least"))
    # a window with a shingle that no document has occurs nowhere
    prefixes = staged(rarity.where("least.n > 0").select("win", F.size(F.split("win", " ")).alias("length"), F.col("least.offset").alias("offset"), F.col("least.shingle").alias("_shingle")), "prefixes")
    met = posted.join(prefixes, F.col("shingle") == F.col("_shingle")).withColumn("at", F.col("place") - F.col("offset")).where((F.col("at") >= 0) & (F.col("at") + F.col("length") <= F.col("size")))
    asked = met.groupBy(F.col("row").alias("_row"), F.col("run").alias("_run")).agg(F.collect_list(F.struct("at", "length", "win")).alias("asked"))
    read = stretches.join(asked, (F.col("row") == F.col("_row")) & (F.col("run") == F.col("_run")))
    holds = F.filter("asked", lambda a: F.array_join(F.slice(F.col("words"), a["at"] + 1, a["length"]), " ") == a["win"])
    found = staged(read.select("row", F.array_sort(holds).alias("found")).where(F.size("found") > 0), "occurrences")
    return rows.select("row", "doc_id", "n_words"), found


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """For every row of docs (doc_id, text): n_words, n_hit (words inside any occurrence of a window of an item), n_items (items
    with windows that occur), items_sha256 (their ids as strings, sorted, joined by commas), contaminated.

    Null and empty texts have no words. Items (item_id, text) without words have no window; an item_id that repeats is one
    item, and the windows of a null item_id hit without counting as an item. Rows that repeat are rows.
    """
    windows = staged(windows_of(items, window), "item-windows")
    rows, found = occurrences(docs, windows)
    # places of a stretch that any occurrence covers: occurrences come in order
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    fold = F.aggregate("found", start, lambda a, x: F.struct(F.greatest(a["end"], x["at"] + x["length"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["at"] + x["length"] - F.greatest(a["end"], x["at"]))).alias("n")))
    hit = found.select("row", fold["n"].alias("n")).groupBy("row").agg(F.sum("n").alias("n_hit"))
    named = found.select("row", F.explode(F.array_distinct("found.win")).alias("win")).join(windows.where("item_id is not null").select("item_id", F.col("win").alias("_win")), F.col("win") == F.col("_win"))
    ids = named.select("row", F.col("item_id").cast("string").alias("item")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    known = hit.join(ids, "row", "left").select(F.col("row").alias("_row"), "n_hit", "items")
    none = F.array().cast("array<string>")
    out = rows.join(known, F.col("row") == F.col("_row"), "left").withColumn("items", F.coalesce("items", none)).withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark's windows in every document."""
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
