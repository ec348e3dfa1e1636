"""Sharding by a hierarchical weighted hash tree.

A tree has regions, a region has racks, a rack has shards; a shard has a weight, and a rack or region the sum of
its shards'. A row descends from the root: at every level each child draws -ln(u) / weight, u being a hash of the
row's key, the level and the child's name, and the least draw wins. So a child is chosen in proportion to its
weight, and a change of one weight moves rows only into or out of the subtrees whose weights change: elsewhere
all draws stay as they were.

Growth that takes rows only into the new shard: ``grown`` adds a region of its own, so that no old subtree changes
weight. (A shard added to an old rack raises that rack's and that region's weight, and the rows these win are
drawn anew among all their shards: confined to that region, but not to the new shard.)
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiloom.llm.shared import documents, free_prefix, hex_unit

#: region -> rack -> shard -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]

#: Shards of the fleet as first laid out: regions of two racks of four. Each later shard has a region of its own.
BASE_SHARDS, PER_RACK, RACKS = 16, 4, 2
#: Rows of a part of a shard, about: parts are numbered apart, so that no task has to hold a whole shard.
PART_ROWS = 20_000


def laid_out(shards: int) -> dict[str, dict[str, dict[int, float]]]:
    """The tree of that many shards of weight 1; that of one more differs by one new region."""
    if shards < 1:
        raise ValueError("a tree needs a shard")
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(shards):
        region, rack = (f"r{s // (PER_RACK * RACKS)}", f"k{s // PER_RACK % RACKS}") if s < BASE_SHARDS else (f"r{s}", "k0")
        tree.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return tree


def _weight(node: Mapping | float) -> float:
    return float(node) if not isinstance(node, Mapping) else sum(map(_weight, node.values()))


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of each row, as an int. key is a string column; a null key counts as the empty string."""
    named = F.coalesce(key, F.lit(""))

    def descend(node: Mapping, path: str) -> Column:
        below = {str(name): child for name, child in node.items() if _weight(child) > 0}
        if not below:
            raise ValueError(f"{path or 'the tree'} has no child of positive weight")

        def inner(name: str) -> Column:
            child = below[name]
            return descend(child, f"{path}/{name}") if isinstance(child, Mapping) else F.lit(int(name))

        names = list(below)
        if len(names) == 1:
            return inner(names[0])
        draws = [(-F.ln(hex_unit(F.concat(named, F.lit(f"{path}/{n}")))) / _weight(below[n])).alias("draw") for n in names]
        won = F.array_min(F.array(*[F.struct(d, F.lit(i).alias("child")) for i, d in enumerate(draws)]))["child"]
        # branches of a CASE are lazy: a row is hashed at the nodes on its way only
        chosen = F.when(won == 0, inner(names[0]))
        for i, n in enumerate(names[1:-1], 1):
            chosen = chosen.when(won == i, inner(n))
        return chosen.otherwise(inner(names[-1]))

    return descend(tree, "").cast("int")


def numbered(df: DataFrame, shard: str, order: list[str], parts: int) -> DataFrame:
    """df with ``slot``: 0, 1, 2 ... in each shard; an old column of that name is replaced.

    Rows are numbered in parts of a shard (a hash of the columns of order, which also order a part), and the parts'
    counts, a row for each, give each part its first slot. No task sees a whole shard, nor the rows of one key unless
    they are equal in all these columns.
    """
    p = free_prefix(df.columns, "_slot")
    key = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order])
    df = df.withColumn(f"{p}part", F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long") % parts)
    counts = df.groupBy(F.col(shard).alias(f"{p}shard"), F.col(f"{p}part").alias(f"{p}of")).agg(F.count("*").alias(f"{p}n"))
    before = W.partitionBy(f"{p}shard").orderBy(f"{p}of").rowsBetween(W.unboundedPreceding, -1)
    first = counts.withColumn(f"{p}first", F.coalesce(F.sum(f"{p}n").over(before), F.lit(0))).drop(f"{p}n")
    own = F.row_number().over(W.partitionBy(shard, f"{p}part").orderBy(*order)) - 1
    joined = df.withColumn(f"{p}own", own).join(first, (F.col(shard) == F.col(f"{p}shard")) & (F.col(f"{p}part") == F.col(f"{p}of")))
    return joined.withColumn("slot", F.col(f"{p}first") + F.col(f"{p}own")).drop(*[f"{p}{c}" for c in ("part", "own", "shard", "of", "first")])


def assign_shards(df: DataFrame, shards: int = BASE_SHARDS, tree: Tree | None = None, key: str = "doc_id") -> DataFrame:
    """df with ``shard`` and, where the tree is the usual one, ``grown_shard`` (with one shard more).

    Only the key and the tree decide: rows of equal key go together, a null key is a key like any other, the
    text may be null, empty or of any length. Old columns of these two names are replaced; others pass through.
    """
    name = F.col(key).cast("string")
    out = df.withColumn("shard", shard_of(name, tree or laid_out(shards)))
    return out if tree else out.withColumn("grown_shard", shard_of(name, laid_out(shards + 1)))


def parts_of(rows: int, shards: int) -> int:
    """Parts of each shard for a table of so many rows."""
    return -(-rows // (PART_ROWS * shards)) or 1


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15 by the law ``key``; slots are gapless in each shard. A null or empty text has size 1
    and crc32 0; a null doc_id is the key of an empty name; rows that repeat are rows, in the same shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = numbered(assign_shards(rows), "shard", ["doc_id", "size", "text_crc32"], parts_of(rows.count(), BASE_SHARDS))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
