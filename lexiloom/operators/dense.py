"""Exact dense ranking over cells: rounded cosine, rank with ties, the first k of each query.

Vectors lie in the cell of their nearest centre, and a cell knows the greatest angle between its centre and one of its
vectors. By the triangle inequality no vector of a cell is nearer to a query than the query's angle to the centre less that
radius. A query first meets its nearest cell alone, which gives its k-th cosine at least; then the cells whose bound reaches
that. Queries and cells are joined, in blocks and slices of bounded sizes; the driver holds centres and radii, CELLS of
them at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Queries that meet a slice of a cell together, vectors of a slice, vectors that a cell has on the average, cells at most.
BLOCK, SLICE, CELL, CELLS = 4_096, 8_192, 2_048, 1_024
DECIMALS = 5


def clamped(k: int, most: int = 50) -> int:
    """k, at most ``most``; k below 1 is an error."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return min(k, most)


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as rows of length 1."""
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1.0, 1.0))


def _searching(k: int, keep_self: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The first k rows of a slice (id, vector) for each query (qid, vector), by rounded cosine and then id."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(rows) or not len(asked):
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        rows = rows.sort_by("id")
        ids, qids = rows["id"].to_numpy(), asked["qid"].to_numpy()
        cosines = np.round(_unit(asked["vector"]) @ _unit(rows["vector"]).T, DECIMALS)
        if not keep_self:
            cosines[qids[:, None] == ids[None, :]] = -np.inf
        if len(ids) > k:  # what ties with the k-th stays, until ids are compared
            cosines[cosines < np.partition(cosines, len(ids) - k, axis=1)[:, len(ids) - k][:, None]] = -np.inf
        q, row = np.nonzero(cosines > -np.inf)
        order = np.lexsort((row, -cosines[q, row], q))
        q, row = q[order], row[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, row = q[kept], row[kept]
        return pa.table({"qid": qids[q], "id": ids[row], "cosine": cosines[q, row]})

    return run


class VectorIndex:
    """Cells over vectors (id, vector); those of length 0 or null are passed over."""

    def __init__(self, vectors: DataFrame, cells: int | None = None) -> None:
        """Centres are the vectors of the least hashes of their ids, as many as ``cells`` (one for each CELL vectors, CELLS at most):
        which they are changes how many cells a query meets, and no result."""
        rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("size(vector) > 0")
        n = rows.count()
        wanted = min(CELLS, cells or max(1, n // CELL))
        if wanted == 1:  # one cell has all vectors, and needs no centre
            self.centres, self.radii, self.slices = np.zeros((1, 1)), np.array([np.pi]), np.array([max(1, -(-n // SLICE))])
            self.rows = rows.withColumn("cell", F.lit(0)).withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(int(self.slices[0]))))
            return
        some = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vector").toArrow()
        self.centres = centres = _unit(some["vector"])

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                angles = _angles(_unit(batch.column("vector")), centres) if len(batch) else np.zeros((0, 1))
                own = angles.argmin(axis=1) if len(batch) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(angles[np.arange(len(own)), own])], ["id", "vector", "cell", "angle"])

        placed = rows.mapInArrow(dealt, "id long, vector array<double>, cell int, angle double")
        found = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()
        self.radii, self.slices = np.full(len(centres), -np.inf), np.zeros(len(centres), np.int64)
        for r in found:
            self.radii[r["cell"]], self.slices[r["cell"]] = r["radius"], -(-r["n"] // SLICE)
        slices = F.get(F.array(*[F.lit(int(s)) for s in np.maximum(1, self.slices)]), F.col("cell"))
        self.rows = placed.select("id", "vector", "cell", F.pmod(F.xxhash64("id"), slices).alias("slice"))

    def _visits(self, asked: DataFrame, blocks: int, nearest: int | None) -> DataFrame:
        """(qid, vector, cell, slice, block) of the cells that a query (qid, vector, kth, block) meets: the ``nearest``, or all whose
        bound reaches kth."""
        centres, radii, slices = self.centres, self.radii, self.slices
        if len(centres) == 1:
            every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(slices[0]) - 1).cast("long"))).alias("slice")
            return asked.select("qid", "vector", "block", F.lit(0).alias("cell"), every)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                angles = _angles(_unit(batch.column("vector")), centres)
                if nearest is None:
                    bound = np.cos(np.clip(angles - radii[None, :], 0.0, np.pi))
                    met = np.round(bound + 1e-9, DECIMALS) >= batch.column("kth").to_numpy()[:, None]
                else:
                    near = np.argsort(np.where(slices > 0, angles, np.inf), axis=1, kind="stable")[:, :nearest]
                    met = np.zeros(angles.shape, dtype=bool)
                    np.put_along_axis(met, near, True, axis=1)
                q, cell = np.nonzero(met & (slices > 0))
                times = slices[cell]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                q, cell = np.repeat(q, times), np.repeat(cell, times)
                kept = batch.select(["qid", "vector", "block"]).take(pa.array(q))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell.astype(np.int32)), pa.array(part)], ["qid", "vector", "block", "cell", "slice"])

        return asked.mapInArrow(run, "qid long, vector array<double>, block int, cell int, slice long")

    def search(self, queries: DataFrame, k: int = 10, keep_self: bool = False, probes: int | None = None) -> DataFrame:
        """(qid, id, cosine, rank): for each query (id, vector) the k nearest, exactly; or, with ``probes``, those that its so
        many nearest cells hold, which may miss some.

        Cosines are rounded to DECIMALS, then ranked with ties; of equal ones the lower id comes first. A query's own
        id is passed over unless ``keep_self``. Queries of length 0 or null are passed over.
        """
        k = clamped(k)
        given = queries.select(F.col("id").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("vector")).where("size(vector) > 0")
        blocks = max(1, -(-given.count() // BLOCK))
        asked = given.withColumn("kth", F.lit(-2.0)).withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
        held = self.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        keys = ["cell", "slice", "block"]
        meet = lambda visits: held.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(_searching(k, keep_self), "qid long, id long, cosine double")
        if probes is None and len(self.centres) > 1:
            order = W.partitionBy("qid").orderBy(F.desc("cosine"))
            first = meet(self._visits(asked, blocks, 1)).withColumn("_n", F.row_number().over(order)).where(F.col("_n") == k)
            kth = first.select(F.col("qid").alias("_qid"), F.col("cosine").alias("_kth"))
            asked = asked.join(kth, F.col("qid") == F.col("_qid"), "left").withColumn("kth", F.coalesce("_kth", "kth")).drop("_qid", "_kth")
        near = meet(self._visits(asked, blocks, probes))
        first, tied = W.partitionBy("qid").orderBy(F.desc("cosine"), "id"), W.partitionBy("qid").orderBy(F.desc("cosine"))
        return near.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= k).withColumn("rank", F.rank().over(tied)).drop("_place")


def _first(found: pa.Table, k: int) -> pa.Table:
    """The first k (qid, id, cosine) of each query."""
    q, order = found["qid"].to_numpy(), np.lexsort((found["id"].to_numpy(), -found["cosine"].to_numpy(), found["qid"].to_numpy()))
    q = q[order]
    return found.take(pa.array(order[np.arange(len(q)) - np.searchsorted(q, q) < k]))


def _scan(vectors: DataFrame, asked: pa.Table, k: int, keep_self: bool) -> DataFrame:
    """(qid, id, cosine): the first k of each part of the vectors for each of a few queries, where the vectors lie."""
    search = _searching(k, keep_self)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:  # a filter before would make vectors that are computed twice
            found = search(pa.Table.from_batches([batch.filter(pc.greater(pc.list_value_length(batch.column("vector")), 0))]), asked)
            best = _first(pa.concat_tables([best, found]), k) if best is not None else found
        if best is not None:
            yield from best.to_batches()

    return vectors.mapInArrow(run, "qid long, id long, cosine double")


def top_dense(vectors: DataFrame, queries: DataFrame, k: int = 10, keep_self: bool = False) -> DataFrame:
    """What ``VectorIndex.search`` gives over an index of these vectors alone. No more than CELLS queries are compared with all vectors in one
    pass, as dealing these to cells would compare them with as many centres; the driver holds these queries, as it does centres."""
    k, lists = clamped(k), lambda df, name: df.select(F.col("id").cast("long").alias(name), "vector")
    asked = lists(queries, "qid").where("size(vector) > 0").limit(CELLS + 1).toArrow()
    if len(asked) > CELLS:
        return VectorIndex(vectors).search(queries, k, keep_self)
    near = _scan(lists(vectors, "id"), asked, k, keep_self)
    first, tied = W.partitionBy("qid").orderBy(F.desc("cosine"), "id"), W.partitionBy("qid").orderBy(F.desc("cosine"))
    return near.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= k).withColumn("rank", F.rank().over(tied)).drop("_place")
