"""Ranked lexical search with MaxScore in each shard.

Documents are read once and leave their length and the counts of those terms that a bit field of fixed size, made of
the items' terms, lets through. Counts over all documents give each term its weight. Documents are dealt at random to shards of about
SHARD_DOCS, items to blocks of about BLOCK_ITEMS, and each block meets each shard in one task: it inverts the shard's
terms, and scores every item by MaxScore. A term's upper bound is its weight times its largest impact in the shard.
Lists are taken by falling bound. While what is still to come could lift a document that hasn't been seen above the k-th best
score, lists are essential and are added whole; beyond, they are probed for those documents alone whose score and
the bounds to come still reach the k-th. Whatever is left out has a bound strictly beneath the k-th score, so ties are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiloom.llm.shared import documents, staged
from lexiloom.llm.words import Hashes, bit_field, in_field, words, words_of

#: Documents of a shard, items that meet a shard together, and how many documents an item gets.
SHARD_DOCS, BLOCK_ITEMS, FIRST = 16_384, 4_096, 10
#: Fixed values of the score: the scale of impacts, and the share of length in a document's damping, in per cent.
SCALE, SHARE = 1_000_000_000, 75


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times) of items (item_id, text); each row is an item of its own, and ``item`` its number."""
    numbered = staged(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("terms")), "items")
    return numbered.select("item", "item_id", F.explode("terms").alias("term")).groupBy("item", "item_id", "term").agg(F.count("*").alias("times"))


def counted(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, doc_id, n, terms, times) of the rows of docs (doc_id, text) that have a term: n terms with repeats, and how often each
    of the wanted ones (and some others, by chance) stands there."""
    own = Hashes()
    field = bit_field(terms, lambda raw: [own.of([raw])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            kept, sizes, found, times = [], [], [], []
            for i, raw in enumerate(batch.column("raw").to_pylist()):
                split = words_of(raw)
                if split:
                    here = Counter(split)
                    names = list(here)
                    named = in_field(field.value, hashes.of(names)).tolist()
                    kept.append(i)
                    sizes.append(len(split))
                    found.append([w for w, ok in zip(names, named, strict=True) if ok])
                    times.append([here[w] for w in found[-1]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "times"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    made = read.mapInArrow(run, "doc_id long, n long, terms array<binary>, times array<int>")
    return staged(made.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n", F.col("terms").cast("array<string>").alias("terms"), "times"), "counted")


def _best(scores: np.ndarray, k: int) -> int:
    """The k-th score; 1 if there are fewer, as scores of 0 don't count."""
    return max(1, int(np.partition(scores, len(scores) - k)[len(scores) - k])) if len(scores) >= k else 1


def max_score(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of ``size`` documents by the sum of their values in the lists (documents ascending, values above 0), then by
    number; and their scores. Documents with no value are left out."""
    lists = sorted((x for x in lists if len(x[0])), key=lambda x: -int(x[1].max()))
    bounds = np.array([int(v.max()) for _, v in lists] + [0], dtype=np.int64)
    left = np.cumsum(bounds[::-1])[::-1]  # left[i]: what the lists from i on can add
    scores, least, i = np.zeros(size, dtype=np.int64), 1, 0
    while i < len(lists) and left[i] >= least:
        where, values = lists[i]
        scores[where] += values
        i += 1
        if i < len(lists) and scores.max() > left[i]:  # else the k-th can't be above what is to come
            least = _best(scores, k)
    seen = np.flatnonzero(scores + left[i] >= max(least, left[i] + 1))
    for n in range(i, len(lists)):
        where, values = lists[n]
        at = np.minimum(np.searchsorted(where, seen), len(where) - 1)
        scores[seen] += np.where(where[at] == seen, values[at], 0)
        least = max(least, _best(scores[seen], k))
        seen = seen[scores[seen] + left[n + 1] >= least]
    first = seen[np.lexsort((seen, -scores[seen]))][:k]
    return first, scores[first]


def _flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All values of a column of lists, and for each the row it comes from."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    return lists.flatten(), np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths(), dtype=np.int64))


def _searched(docs: pa.Table, items: pa.Table, k: int) -> pa.Table:
    """The first k documents of a shard (row, doc_id, n, damping, terms, times) for each item (item, terms, weights)."""
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    if len(docs) and len(items):
        docs = docs.sort_by([("doc_id", "ascending"), ("row", "ascending")])  # nulls stand at the end
        wanted, item = _flat(items["terms"])
        weights, _ = _flat(items["weights"])
        names = pc.unique(wanted)
        terms, doc = _flat(docs["terms"])
        times, _ = _flat(docs["times"])
        code = pc.index_in(terms, value_set=names)
        known = np.asarray(code.is_valid())
        code, doc = code.drop_null().to_numpy(), doc[known]
        tf, damping = times.to_numpy()[known].astype(np.int64), docs["damping"].to_numpy()
        order = np.argsort(code, kind="stable")
        impact = (SCALE * tf // (1000 * tf + 8 * damping[doc]))[order]
        doc, starts = doc[order], np.searchsorted(code[order], np.arange(len(names) + 1))
        asked, weights = pc.index_in(wanted, value_set=names).to_numpy(), weights.to_numpy()
        ends = np.searchsorted(item, np.arange(len(items) + 1))
        for n in range(len(items)):
            lists = []
            for t, w in zip(asked[ends[n] : ends[n + 1]].tolist(), weights[ends[n] : ends[n + 1]].tolist(), strict=True):
                if w > 0 and starts[t] < starts[t + 1]:
                    lists.append((doc[starts[t] : starts[t + 1]], impact[starts[t] : starts[t + 1]] * w))
            found.append((n, *max_score(lists, len(docs), k)))
    sizes = [len(d) for _, d, _ in found]
    of = pa.array(np.repeat(np.array([n for n, _, _ in found], dtype=np.int64), sizes))
    where = pa.array(np.concatenate([np.empty(0, np.int64), *(d for _, d, _ in found)]))
    return pa.table({"item": items["item"].take(of), "doc_id": docs["doc_id"].take(where), "score": pa.array(np.concatenate([np.empty(0, np.int64), *(s for *_, s in found)]))})


def search(docs: DataFrame, items: DataFrame, k: int = FIRST) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items (item_id, text) the k rows of docs (doc_id, text) of the highest
    scores above 0, of equal scores the lower doc_id first, a null one last.

    Null and empty texts have no terms, are not counted as documents and find nothing. Rows that repeat are documents, and
    items, of their own; ranks of an item are unique. No item or no document with a term: no result.
    """
    asked = staged(item_terms(items), "item-terms")
    rows = counted(docs, asked.select("term").distinct())
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = rows.select(F.explode("terms").alias("_term")).groupBy("_term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1))).cast("long") * F.col("times")
    weighed = asked.join(df, F.col("term") == F.col("_term")).groupBy("item", "item_id").agg(F.collect_list(F.struct("term", weight.alias("weight"))).alias("t"))
    shards, blocks = max(1, -(-n // SHARD_DOCS)), max(1, -(-asked.select("item").distinct().count() // BLOCK_ITEMS))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda key, count: F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
    damping = (100 - SHARE + F.expr(f"({SHARE} * n * {n}L) div {max(1, total)}L")).alias("damping")
    held = rows.select("row", "doc_id", "n", damping, "terms", "times", dealt("row", shards).alias("shard"), every(blocks).alias("block"))
    queries = weighed.select("item", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"), dealt("item", blocks).alias("block"), every(shards).alias("shard"))
    near = held.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(lambda a, b: _searched(a, b, k), "item long, doc_id long, score long")
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = weighed.select(F.col("item").alias("_item"), "item_id")
    return best.join(names, F.col("item") == F.col("_item")).select("item_id", "rank", "doc_id", "score")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
