"""Hard negatives by ball trees: rows whose inner product with an anchor lies in a window below that of its positives.

Rows are dealt at random to parts of about PART_ROWS, anchors to blocks of about BLOCK_ANCHORS, and each block meets each
part in one task, which builds a ball tree over the part. A node has a centre c and a radius r, so all its rows' products
with a query q lie between q.c - |q| r and q.c + |q| r. A node is left out when these lie outside the query's window, when
its upper bound is strictly beneath the k-th best found so far (or equals it and all its rows come later), or when it has no
row of a label that is asked for. What is left is scored exactly, in whole numbers; k rows for each query leave a task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiloom.llm.shared import staged

#: Rows of a tree, rows of its leaves, anchors that meet a tree together, leaves that a query opens before its bound is set anew.
PART_ROWS, LEAF, BLOCK_ANCHORS, ROUND = 4_096, 64, 2_048, 4
#: No score yet; no window.
_NONE, _FREE = -(1 << 62), 1 << 62


@dataclass
class Tree:
    """Nodes in levels from the root down, the last level the leaves; rows of ``x`` as the leaves have them."""

    x: np.ndarray
    #: Place of each row in the order of ids, and its label's number.
    place: np.ndarray
    label: np.ndarray
    #: For each level: centres, radii, the least place, and which labels its nodes have.
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    #: Where each leaf's rows begin, and the end.
    bounds: np.ndarray

    @staticmethod
    def over(x: np.ndarray, label: np.ndarray, labels: int) -> Tree:
        """Rows come in the order of ids. Every node is halved at the median of its rows' projections on the line between two
        rows that lie far apart."""
        depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / LEAF))))
        groups, y = [np.arange(len(x))], x.astype(np.float64)
        levels = [Tree._level(y, groups, label, labels)]
        for _ in range(depth):
            groups = [half for g in groups for half in Tree._halves(y, g)]
            levels.append(Tree._level(y, groups, label, labels))
        order = np.concatenate(groups)
        return Tree(x[order], order, label[order], levels, np.append(0, np.cumsum([len(g) for g in groups])))

    @staticmethod
    def _halves(y: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = y[rows]
        far = own[np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
        other = own[np.argmax(((own - far) ** 2).sum(axis=1))]
        order = np.argsort(own @ (other - far), kind="stable")
        return rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]

    @staticmethod
    def _level(y: np.ndarray, groups: list[np.ndarray], label: np.ndarray, labels: int) -> tuple[np.ndarray, ...]:
        centres = np.array([y[g].mean(axis=0) for g in groups])
        radii = np.array([np.sqrt(((y[g] - c) ** 2).sum(axis=1)).max() for g, c in zip(groups, centres, strict=True)])
        has = np.zeros((len(groups), labels + 1), dtype=bool)
        for i, g in enumerate(groups):
            has[i, label[g]] = True
        return centres, radii, np.array([g.min() for g in groups]), has

    def search(self, q: np.ndarray, of: np.ndarray, wanted: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int, passed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of the first k rows of each search, _NONE where there are fewer.

        Search i is of the vector q[of[i]], from low[i] to high[i], for rows of the label number wanted[i] (``same``) or of any
        other, but for the row at the place passed[i].
        """
        y = q.astype(np.float64)
        size = np.sqrt((y**2).sum(axis=1))
        alive, upper = np.ones((len(of), 1), dtype=bool), np.empty(0)
        for n, (centres, radii, _, has) in enumerate(self.levels):
            if n:
                alive = np.repeat(alive, 2, axis=1)
            middle, reach = y @ centres.T, size[:, None] * radii[None, :]
            slack = 1e-6 + 1e-9 * (np.abs(middle) + reach)  # scores are whole numbers, so bounds are rounded inwards
            upper = np.floor(middle + reach + slack)[of]
            alive &= (upper >= low[:, None]) & (np.ceil(middle - reach - slack)[of] <= high[:, None])
            alive &= has[:, wanted].T if same else (has.sum(axis=1)[None, :] - has[:, wanted].T) > 0
        first = self.levels[-1][2]
        upper = np.where(alive, upper, -np.inf)
        order = np.argsort(-upper, axis=1, kind="stable")
        upper = np.take_along_axis(upper, order, axis=1)
        scores, places = np.full((len(of), k), _NONE, dtype=np.int64), np.full((len(of), k), len(self.x), dtype=np.int64)
        for at in range(0, order.shape[1], ROUND):
            leaves, most = order[:, at : at + ROUND], upper[:, at : at + ROUND]
            kth = scores[:, -1:]
            opened = (most >= kth) & (most > -np.inf) & ~((most == kth) & (first[leaves] > places[:, -1:]))
            if not opened.any():
                break
            for leaf in np.unique(leaves[opened]):
                self._open(int(leaf), np.flatnonzero((opened & (leaves == leaf)).any(axis=1)), q, of, wanted, same, low, high, passed, scores, places)
        return scores, places

    def _open(self, leaf: int, who: np.ndarray, q: np.ndarray, of: np.ndarray, wanted: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, passed: np.ndarray, scores: np.ndarray, places: np.ndarray) -> None:
        rows = slice(self.bounds[leaf], self.bounds[leaf + 1])
        vectors, number = np.unique(of[who], return_inverse=True)
        found = _products(q[vectors], self.x[rows])[number]
        place = self.place[rows][None, :]
        fits = (found >= low[who, None]) & (found <= high[who, None]) & ((self.label[rows][None, :] == wanted[who, None]) == same) & (place != passed[who, None])
        fits &= (found > scores[who, -1:]) | (found == scores[who, -1:]) & (place < places[who, -1:])
        better = fits.any(axis=1)
        who, found, fits = who[better], found[better], fits[better]
        if not len(who):
            return
        k = scores.shape[1]
        all_scores = np.concatenate([scores[who], np.where(fits, found, _NONE)], axis=1)
        all_places = np.concatenate([places[who], np.where(fits, place, len(self.x))], axis=1)
        kept = np.lexsort((all_places, -all_scores), axis=-1)[:, :k]
        scores[who], places[who] = np.take_along_axis(all_scores, kept, axis=1), np.take_along_axis(all_places, kept, axis=1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers: by doubles where all sums are exact in them, else by Python's integers, held to 62 bits."""
    bound = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, _NONE + 1, _FREE).astype(np.int64)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of one length; what a shorter one lacks is 0."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    sizes = np.asarray(lists.value_lengths(), dtype=np.int64)
    out = np.zeros((len(lists), width), dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _searching(k: int, same: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a part's rows (row, id, label, vector) and searches (search, anchor, label, vector, low, high): the first k rows of each."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        scores = places = np.empty((0, k), dtype=np.int64)
        if len(rows) and len(asked):
            rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])  # nulls stand at the end
            width = max(int(np.asarray(t["vector"].combine_chunks().value_lengths()).max()) for t in (rows, asked))
            own, theirs = rows["label"].to_numpy(), asked["label"].to_numpy()
            names, label = np.unique(own, return_inverse=True)
            at = np.minimum(np.searchsorted(names, theirs), len(names) - 1)
            wanted = np.where(names[at] == theirs, at, len(names))  # a label that the part doesn't have has the last number
            at_row = {r: i for i, r in enumerate(rows["row"].to_pylist())}
            passed = np.array([at_row.get(a, -1) for a in asked["anchor"].to_pylist()], dtype=np.int64)
            anchors, first, of = np.unique(asked["anchor"].to_numpy(), return_index=True, return_inverse=True)
            tree = Tree.over(_matrix(rows["vector"], width), label, len(names))
            q = _matrix(asked["vector"].take(pa.array(first)), width)
            scores, places = tree.search(q, of, wanted, same, asked["low"].to_numpy(), asked["high"].to_numpy(), k, passed)
        search, n = np.nonzero(scores > _NONE)
        return pa.table({"search": asked["search"].take(pa.array(search)), "id": rows["id"].take(pa.array(places[search, n])), "score": pa.array(scores[search, n])})

    return run


def _first(rows: DataFrame, searches: DataFrame, parts: int, k: int, same: bool) -> DataFrame:
    """(search, n, id, score): the first k rows of each search, n counting from 1."""
    anchors = searches.agg(F.count("*")).first()[0]
    blocks = max(1, -(-anchors // BLOCK_ANCHORS))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = searches.withColumn("block", F.pmod(F.xxhash64("anchor", F.lit("block")), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    near = dealt.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(_searching(k, same), "search long, id long, score long")
    order = W.partitionBy("search").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def prepared(df: DataFrame, vector: Column, label: Column, scale: int = 256) -> DataFrame:
    """df's rows that take part, as (row, id, label, vector of whole numbers): label and vector are given, and neither they nor
    a component may be null, nor a component NaN or infinite. A row has a number of its own, so rows that repeat are told apart."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    kept = df.where(label.isNotNull() & vector.isNotNull() & F.coalesce(finite, F.lit(False)))
    return staged(kept.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("vector")), "vectors")


def hard_negatives(rows: DataFrame, asks: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Of rows as ``prepared`` gives them: for each anchor (a row that ``asks``) and each of its first ``positives`` other rows of
    its label, the first ``negatives`` rows of other labels whose score lies between low and high per cent of the positive's:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is an inner product; higher ones come first, of equal ones the lower id, a null id last. Anchors that repeat ask
    each for themselves, and each is another row to the other. A positive of a score below 0 has no window. Vectors of
    different lengths count as filled up with zeros. No rows, no anchors or no other label: no result.
    """
    parts = max(1, -(-rows.count() // PART_ROWS))
    anchors = staged(rows.where(asks).select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "label", "vector"), "anchors")
    free = anchors.select(F.col("anchor").alias("search"), "anchor", "label", "vector", F.lit(-_FREE).alias("low"), F.lit(_FREE).alias("high"))
    best = _first(rows, free, parts, positives, same=True)
    found = staged(best.select(F.col("search").alias("anchor"), (F.col("search") * positives + F.col("n") - 1).alias("search"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scaled = lambda n: F.col("positive_score").cast("decimal(20,0)") * n / 100
    least, most = F.ceil(scaled(low)).cast("long"), F.floor(scaled(high)).cast("long")
    windows = found.where("positive_score >= 0").join(anchors, "anchor").select("search", "anchor", "label", "vector", least.alias("low"), most.alias("high"))
    rest = _first(rows, windows, parts, negatives, same=False).select(F.col("search").alias("_search"), F.col("n").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.join(rest, F.col("search") == F.col("_search")).join(anchors.select("anchor", "anchor_id"), "anchor")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100, against all vectors. Rows without a label, a vector or a
    finite component take no part; of ids divisible by 7 the label goes up by one, 9 becoming 0."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", "label")
    label = F.when(F.col("id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(prepared(df, F.col("embedding"), label), F.col("id") % 100 == 0)
