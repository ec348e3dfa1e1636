"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, its source's target over its source's size.
The whole part is taken as it is; the fractional parts are rounded together. Two documents of sizes v, w and
fractions x, y trade mass so that v x + w y stays as it is, in a random direction with no drift, until one of the
fractions is 0 or 1. So each document keeps its expected copies, and all the while the source's words stay at the
target: only the last document of all can miss it.

The rounding is a reduction tree. Documents of one source and one size class (a power of two) are dealt into
groups of about ``group`` documents; each group leaves one fractional document at most, 64 of these form the
next group, and so on. The last fractional documents of a source, a few of each size class, are rounded from the
largest to the smallest, each one also making up for what the larger ones missed, so that a source misses its
target by about half of a small document. No task sees more than one group, however many rows a source has.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.shared import documents, free_prefix, staged

#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating; the share of all words that the mix has; the most copies of a document.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2
#: Documents of a group of the tree's leaves, and groups that meet in one of the next level.
GROUP, FAN_IN = 1_024, 64
#: Documents of each source and size class that wait for the last step, where they make up for what others missed.
RESERVE = 8
SEED = 20_240_601

#: A fraction so near to 0 or 1 is that.
WHOLE = 1e-9

#: doc_id is text on its way through Python, where whole numbers beside nulls would be rounded.
_UNIT = "doc_id string, source string, size long, crc long, m long, whole int, x double, class int, salt long, bit int"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) for each row of (source, source_size), of which each source has one: by weight, none
    above ``most`` times its size.

    Sources are ordered by code point, null last, and numbered in ranges; the excess of those that reach their limit is
    shared again by weight among the others until none is above. A pass gets two sums back, however many sources there are.
    """
    spark = sizes.sparkSession
    by = F.asc_nulls_last("source")
    ordered = sizes.select("source", "source_size").repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id())
    placed = staged(ordered.select("source", "source_size", F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")), "sources")
    before, first = 0, []
    for r in placed.groupBy("_range").count().orderBy("_range").collect():  # a row for each range
        first.append((r["_range"], before))
        before += r["count"]
    starts = F.broadcast(spark.createDataFrame(first, "_range long, _first long"))
    place = F.pmod(F.col("_first") + F.col("_row"), F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), place.cast("int") + 1)
    weighted = staged(placed.join(starts, "_range").select("source", "source_size", weight.alias("_weight")), "weighted")
    level = F.lit(-1.0)  # what a weight of 1 gets; sources whose limit for that is lower are at their limit
    capped = -1
    while True:
        at_limit = most * F.col("source_size") < level * F.col("_weight")
        free = F.when(~at_limit, F.col("_weight"))
        r = weighted.agg(F.sum("source_size").alias("all"), F.sum(F.when(at_limit, most * F.col("source_size"))).alias("given"), F.sum(free).alias("weight"), F.count(F.when(at_limit, 1)).alias("capped")).first()
        if r["capped"] == capped or not r["weight"]:
            break
        left, total, capped = share * r["all"] - (r["given"] or 0.0), r["weight"], r["capped"]
        level = F.lit(left / total)
    if capped < 0:
        return weighted.select("source", "source_size", F.lit(0.0).alias("target"))
    whole = most * F.col("source_size").cast("double")
    return weighted.select("source", "source_size", F.when(most * F.col("source_size") < level * F.col("_weight"), whole).otherwise(F.lit(left) * F.col("_weight") / F.lit(total)).alias("target"))


def _trade(frame: pd.DataFrame, key: tuple, reserve: int) -> pd.DataFrame:
    """One group: trades until one document at most is fractional, besides ``reserve`` that take no part; these keep bit null."""
    frame = frame.sort_values(["size", "doc_id", "crc"], kind="stable").reset_index(drop=True)
    random = np.random.Generator(np.random.Philox(key=[SEED, zlib.crc32(repr(key).encode())]))
    order = random.permutation(len(frame))
    order = order[: max(0, len(order) - reserve)]
    draws = random.random(len(order))
    mass, x = (frame["size"] * frame["m"]).to_numpy(float), frame["x"].to_numpy(float).copy()
    bit = np.full(len(frame), -1, dtype=np.int64)

    def settled(i: int) -> bool:
        """Whether the fraction is 0 or 1; then it is decided."""
        if min(x[i], 1 - x[i]) < WHOLE:
            bit[i] = round(x[i])
        return bit[i] >= 0

    active = -1
    for j, u in zip(order.tolist(), draws.tolist(), strict=True):
        if mass[j] == 0:  # nothing to trade: a draw of its own
            bit[j] = u < x[j]
        elif settled(j):
            pass
        elif active < 0:
            active = j
        else:
            v, w = mass[active], mass[j]
            up, down = min((1 - x[active]) * v, x[j] * w), min(x[active] * v, (1 - x[j]) * w)
            rises = u * (up + down) < down
            moved = up if rises else -down
            # the one that the limit comes from is whole now; the other may be too
            ends = (1 - x[active]) * v <= x[j] * w if rises else x[active] * v <= (1 - x[j]) * w
            x[active] += moved / v
            x[j] -= moved / w
            if ends:
                bit[active] = rises
                active = -1 if settled(j) else j
            else:
                bit[j] = not rises
                if settled(active):
                    active = -1
    frame["x"] = x
    frame["bit"] = pd.array(np.where(bit < 0, 0, bit), dtype="Int32")
    frame.loc[bit < 0, "bit"] = pd.NA
    return frame


def _trades(reserve: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    return lambda key, frame: _trade(frame, key, reserve)


def _last(frame: pd.DataFrame, key: tuple) -> pd.DataFrame:
    """The fractional documents that a source has left, from large to small; each makes up for those before."""
    frame = frame.sort_values(["class", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
    u = np.random.Generator(np.random.Philox(key=[SEED, zlib.crc32(repr(key).encode())])).random()
    missed, bits = 0.0, []
    for i, r in enumerate(frame.itertuples()):
        mass = float(r.size * r.m) or 1.0
        wanted = r.x + missed / mass
        b = int(u < wanted) if i == 0 and len(frame) > 1 else math.floor(wanted + 0.5)
        b = max(-int(r.whole), min(MOST - int(r.whole), b))
        missed += (r.x - b) * mass
        bits.append(b)
    frame["bit"] = pd.array(bits, dtype="Int32")
    return frame


def copies(df: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, group: int = GROUP) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, crc, m, copies, source_size, target.

    A row stands for the m rows that have the same doc_id, source, size in words and crc32 of the text; they are
    taken alike. A null text has size 0; null sources and doc_ids are values like any other. Other columns of df
    don't matter. An empty table gives an empty one.
    """
    keyed = df.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("crc"))
    units = staged(keyed.groupBy("doc_id", "source", "size", "crc").agg(F.count("*").alias("m")).withColumn("class", F.floor(F.log2(F.greatest(F.col("size") * F.col("m"), F.lit(1)).cast("double"))).cast("int")), "units")
    counts = staged(units.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("m")).alias("words")), "counts")
    due = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share)
    due = due.select(F.col("source").alias("t_source"), "source_size", "target")
    plan = counts.join(due, F.col("source").eqNullSafe(F.col("t_source"))).select(F.col("source").alias("p_source"), F.col("class").alias("p_class"), "source_size", "target", F.ceil(F.col("n") / group).alias("salts"))
    plan = staged(plan, "plan")  # a row for each source and power of two
    per_copy = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    dealt = (
        units.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("class") == F.col("p_class")))
        .withColumn("whole", F.floor(per_copy + WHOLE).cast("int"))
        .withColumn("x", F.greatest(per_copy - F.col("whole"), F.lit(0.0)))
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "size", "crc"), F.col("salts")))
        .withColumn("bit", F.when(F.col("x") == 0, 0).cast("int"))
        .select(*(c.split()[0] for c in _UNIT.split(", ")))
    )
    done = [dealt.where("bit is not null")]
    open_, left = dealt.where("bit is null"), plan.agg(F.max("salts")).first()[0] or 1
    while True:
        level = staged(open_.groupBy("source", "class", "salt").applyInPandas(_trades(RESERVE if left <= 1 else 0), _UNIT), "trades")
        done.append(level.where("bit is not null"))
        open_ = level.where("bit is null").withColumn("salt", F.floor(F.col("salt") / FAN_IN))
        if left <= 1:
            break
        left = -(-left // FAN_IN)
    # RESERVE + 1 documents of each size class, at most, are left of a source
    done.append(staged(open_.groupBy("source").applyInPandas(lambda key, frame: _last(frame, key), _UNIT), "last"))
    settled = done[0]
    for part in done[1:]:
        settled = settled.unionByName(part)
    return settled.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("class") == F.col("p_class"))).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "size", "crc", "m", (F.col("whole") + F.col("bit")).cast("int").alias("copies"), "source_size", "target")


def mix(df: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, group: int = GROUP) -> DataFrame:
    """df's rows, each as often as the mix takes it, with df's columns.

    df has doc_id, source and text; further columns pass through, whatever their names. Nulls, empty texts and repeated
    rows are as in ``copies``.
    """
    names = df.columns
    p = free_prefix(names, "_mix")
    taken = copies(df, weights, share, group).where("copies > 0").select(*(F.col(c).alias(f"{p}{c}") for c in ("doc_id", "source", "size", "crc", "copies")))
    own = {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"), "size": words(F.col("text")), "crc": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))}
    keyed = df.select(*(F.col(f"`{c}`") for c in names), *(e.alias(f"{p}own_{k}") for k, e in own.items()))
    same = F.lit(True)
    for k in own:
        same = same & F.col(f"{p}own_{k}").eqNullSafe(F.col(f"{p}{k}"))
    return keyed.join(taken, same).withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1), F.col(f"{p}copies")))).select(*(F.col(f"`{c}`") for c in names))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document of the table, in words. A null or empty text has size 0 and takes nothing; a null
    source is a source; rows that repeat are taken alike; a null doc_id is a key like any other."""
    taken = copies(documents(spark, sf_dir)).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
