"""Packing by cutting-stock column generation.

A document of more than ``capacity`` tokens is cut into full sequences and one rest; the rests are to be packed.
They are counted by length class (``width`` lengths each, so the histogram has at most capacity / width + 1 entries,
whatever the size of the corpus). A pattern says how many rests of each class one sequence takes; a linear program
over patterns finds how often to use each so that all rests are covered by the fewest sequences. Its columns are
generated: the dual prices of the classes go into an unbounded-knapsack dynamic program, and its best filling
enters the basis while it is worth more than one sequence. The use of each pattern is rounded down; what is left
over, less than one sequence for each pattern, is packed by first fit, largest first. In each class, the rests are
ranked, and ranks are dealt to the patterns' places in order. The plan, one row for each class and pattern, is small
and of a bounded size; the documents are only ranked and joined with it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiloom.llm.shared import documents, staged
from lexiloom.llm.workers import release

CAPACITY = 2048
#: Lengths of a class. Its members count as the longest of them when patterns are made.
WIDTH = 8
#: The linear program is solved to within this share of its bound.
GAP = 5e-4
#: Rows of a part of a class, about: ranks are counted apart in parts, so that no task has to hold a whole class.
PART_ROWS = 20_000
#: Tokens of the pieces that leave a worker at once when their ids go with them.
KEPT_IDS = 2_000_000


def knapsack(prices: np.ndarray, room: int) -> tuple[float, dict[int, int]]:
    """The filling of greatest price with items of sizes 1, 2 ... (prices[size - 1]) into a room of that size."""
    best = np.zeros(room + 1)
    taken = np.zeros(room + 1, dtype=np.int64)
    for space in range(1, room + 1):
        reach = min(space, len(prices))
        worth = prices[:reach] + best[space - reach : space][::-1]
        k = int(worth.argmax())
        best[space], taken[space] = best[space - 1], 0
        if worth[k] > best[space] + 1e-12:
            best[space], taken[space] = worth[k], k + 1
    filling: Counter[int] = Counter()
    space = room
    while space:
        if taken[space]:
            filling[int(taken[space])] += 1
            space -= int(taken[space])
        else:
            space -= 1
    return float(best[room]), dict(filling)


def solve(demand: Mapping[int, int], room: int, gap: float = GAP) -> list[tuple[dict[int, int], float]]:
    """Patterns (size -> how many) and their uses, fractional, that cover the demand (size -> how many) with almost
    the fewest rooms. Sizes are whole numbers from 1 to room."""
    sizes = sorted(s for s, n in demand.items() if n > 0)
    if not sizes:
        return []
    row = {s: i for i, s in enumerate(sizes)}
    m = len(sizes)
    wanted = np.array([demand[s] for s in sizes], dtype=float)
    patterns = [{s: room // s} for s in sizes]
    inverse = np.diag([1.0 / (room // s) for s in sizes])
    uses = inverse @ wanted
    for _ in range(50 * m + 1000):
        duals = inverse.sum(axis=0)
        prices = np.zeros(room)
        for s in sizes:
            prices[s - 1] = max(0.0, duals[row[s]])
        worth, filling = knapsack(prices, room)
        if worth <= 1 + gap or not filling:
            break
        column = np.zeros(m)
        for s, k in filling.items():
            column[row[s]] = k
        change = inverse @ column
        ratio = np.full(m, np.inf)
        positive = change > 1e-9
        ratio[positive] = uses[positive] / change[positive]
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        uses -= step * change
        uses[out] = step
        patterns[out] = filling
        pivot = inverse[out] / change[out]
        inverse -= np.outer(change, pivot)
        inverse[out] = pivot
    return [(p, max(0.0, float(u))) for p, u in zip(patterns, uses, strict=True)]


def plan(demand: Mapping[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Whole uses of patterns that take every item of the demand exactly once (a pattern's places may stay empty in
    none of them): the linear program's, rounded down, and first fit for the rest."""
    left = Counter({s: n for s, n in demand.items() if n > 0})
    out: list[tuple[dict[int, int], int]] = []
    for pattern, use in sorted(solve(demand, room), key=lambda x: sorted(x[0].items(), reverse=True)):
        whole = min([int(use + 1e-6), *(left[s] // k for s, k in pattern.items())])
        if whole:
            out.append((pattern, whole))
            for s, k in pattern.items():
                left[s] -= whole * k
    # at most about one sequence for each pattern is left; a row of like sequences is a pattern too
    rest = sorted((s for s, n in left.items() if n), reverse=True)
    while any(left[s] for s in rest):
        space, filling = room, {}
        for s in rest:
            k = min(left[s], space // s)
            if k:
                filling[s] = k
                space -= k * s
        whole = min(left[s] // k for s, k in filling.items())
        out.append((filling, whole))
        for s, k in filling.items():
            left[s] -= whole * k
    return out


def ranked(df: DataFrame, group: str, key: Column, order: list[Column], most: int) -> DataFrame:
    """df with ``rank``: the number of rows before it in its group, of which none has more than ``most`` rows. Counted in
    parts (a hash of the key) of about PART_ROWS rows, whose counts give each part its first rank: no task holds a whole
    group. The counts, a row for each part, are joined as their size asks for."""
    df = df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(-(-most // PART_ROWS) or 1)))
    sums = df.groupBy(group, "_part").agg(F.count("*").alias("_sum"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    first = staged(sums.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_first")), "ranks")
    own = F.row_number().over(W.partitionBy(group, "_part").orderBy(*order)) - 1
    joined = df.withColumn("_own", own).join(first, (F.col(group) == F.col("_group")) & (F.col("_part") == F.col("_of")))
    return joined.withColumn("rank", F.col("_first") + F.col("_own")).drop("_part", "_own", "_group", "_of", "_first")


def placed(pieces: DataFrame, capacity: int = CAPACITY, width: int = WIDTH) -> DataFrame:
    """Pieces of documents with their place: sequence_id and offset.

    ``pieces`` has doc_id, doc_key (distinct for each document row), start and length, 1 to capacity; it is read
    more than once, so it should be a stored table. Full pieces are sequences of their own. Each piece gets exactly
    one place; sequences count gaplessly from 0, and offsets gaplessly from 0 in each. No rows give none.
    """
    spark = pieces.sparkSession
    order = [F.col("doc_key"), F.col("start")]
    room = capacity // width
    # full pieces are class 0; a rest of the longest class fills a sequence alone
    classed = pieces.withColumn("class", F.when(F.col("length") < capacity, F.ceil(F.col("length") / width)).otherwise(0).cast("int"))
    histogram = {r["class"]: r["n"] for r in classed.groupBy("class").agg(F.count("*").alias("n")).collect()}  # room + 1 rows at most
    filled_whole, rests = histogram.pop(0, 0), classed.where("class > 0")
    uses = plan(histogram, room)
    base, filled, rows = 0, Counter(), []
    for number, (pattern, whole) in enumerate(uses):
        spot = 0
        for s, k in sorted(pattern.items(), reverse=True):
            rows.append((s, filled[s], filled[s] + whole * k, k, base, spot))
            filled[s] += whole * k
            spot += k
        base += whole
    # bounded: a row for each class of each pattern, of which there are about as many as classes
    places = spark.createDataFrame(rows, "p_class int, first long, last long, each int, base long, spot int")
    ranks = ranked(rests, "class", F.col("doc_key"), order, max(histogram.values(), default=0))
    dealt = ranks.join(F.broadcast(places), (F.col("class") == F.col("p_class")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    nth = F.col("rank") - F.col("first")
    dealt = dealt.withColumn("sequence_id", F.col("base") + F.floor(nth / F.col("each"))).withColumn("_spot", F.col("spot") + nth % F.col("each"))
    before = W.partitionBy("sequence_id").orderBy("_spot").rowsBetween(W.unboundedPreceding, -1)  # capacity rows at most
    dealt = dealt.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    full = ranked(classed.where("class = 0"), "class", F.struct("doc_key", "start"), order, filled_whole)
    full = full.withColumn("sequence_id", F.lit(base).cast("long") + F.col("rank")).withColumn("offset", F.lit(0).cast("long"))
    kept = [F.col(f"`{c}`") for c in pieces.columns] + [F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset")]
    return dealt.select(*kept).unionByName(full.select(*kept))


def pieces_of(df: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Each document's pieces: doc_id, doc_key, start, length, ids_crc32, doc_tokens (and ids).

    A document is the ids of its text (null: none) and end_id. doc_key numbers the rows of df: it is drawn from
    the row's place in its task, so pieces have to be stored before they are used twice.
    """
    columns = "doc_id long, doc_key long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    keyed = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("doc_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lexiloom.llm.token_ids import encoder

        kept = pa.schema([("ids", pa.list_(pa.int32()))] if keep_ids else [])

        def made(batch: pa.RecordBatch, rows: list[tuple[int, int, int, int, int]], ids: list[bytes]) -> pa.RecordBatch:
            row, start, length, crc, tokens = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
            named = batch.select(["doc_id", "doc_key"]).take(row)
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))] if keep_ids else []
            names = ["doc_id", "doc_key", "start", "length", "ids_crc32", "doc_tokens", *kept.names]
            return pa.RecordBatch.from_arrays([*named.columns, start, length, crc, tokens, *lists], names)

        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            held: list[bytes] = []
            for row, ids in enumerate(encoder(tokenizer).encode(batch.column("text"), end_id)):
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    part = ids[at * 4 : (at + capacity) * 4]
                    rows.append((row, at, len(part) // 4, zlib.crc32(part), n))
                    if keep_ids:
                        held.append(part)
                        if len(held) * capacity >= KEPT_IDS:
                            yield made(batch, rows, held)
                            rows, held = [], []
            if rows:
                yield made(batch, rows, held)
        release()

    return keyed.mapInArrow(run, columns)


def pack(df: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, width: int = WIDTH, keep_ids: bool = False) -> DataFrame:
    """df's documents (doc_id, text) as pieces in sequences: the columns of pieces_of, without doc_key, and sequence_id
    and offset. Rows of equal doc_id or text are documents each; other columns of df don't matter."""
    return placed(staged(pieces_of(df, tokenizer, end_id, capacity, keep_ids), "pieces"), capacity, width).drop("doc_key")


#: The id that ends a document of the query.
END_ID = 1


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    out = pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
