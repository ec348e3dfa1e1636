"""Analytics over recorded draws: spreads, the displayed sample, verbatim readings, overlap of two arms, hydration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiloom.functions.similarity import verbatim
from lexiloom.sources.stored import cut


def spread(rows: DataFrame, by: list[str], value: str, index: str) -> DataFrame:
    """For each group: n rows (nulls counted), minimum, maximum, distinct (nulls ignored), and the values in order of the
    index, nulls kept."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("v")))), lambda x: x["v"])
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.count_distinct(F.col(value)).alias("distinct_values"), values.alias("spread_values"))


def displayed(rows: DataFrame, by: list[str], measure: str, index: str) -> DataFrame:
    """The lower median row of each group by the measure; of equal ones the least index."""
    order = W.partitionBy(*by).orderBy(measure, index)
    numbered = rows.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*by))).withColumn("_i", F.row_number().over(order))
    return numbered.where(F.col("_i") == F.floor((F.col("_n") - 1) / 2) + 1).drop("_n", "_i")


def worst_verbatim(claims: DataFrame, run_limit: int = 25, subsequence_limit: int = 25) -> DataFrame:
    """Of claims (question_id, claim_tokens, chunk_id, chunk_tokens, position): the longest common run and subsequence for
    each question, with the chunk of each (the first of equals), and whether either is above its limit."""
    read = claims.withColumn("_v", verbatim("claim_tokens", "chunk_tokens"))
    best = lambda m: F.max_by(F.struct(F.col(f"_v.{m}").alias("tokens"), "chunk_id"), F.struct(F.col(f"_v.{m}"), -F.col("position")))
    out = read.groupBy("question_id").agg(best("run").alias("run"), best("subsequence").alias("subsequence"))
    return out.withColumn("leaks", (F.col("run.tokens") > run_limit) | (F.col("subsequence.tokens") > subsequence_limit))


def overlap(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two arms' rankings (qid, id, position) side by side: where each id stands in either, and ``both``, ``one`` or
    ``other``."""
    a, b = one.select("qid", "id", F.col("position").alias("position_one")), other.select("qid", "id", F.col("position").alias("position_other"))
    side = F.when(F.col("position_other").isNull(), "one").when(F.col("position_one").isNull(), "other").otherwise("both")
    return a.join(b, ["qid", "id"], "full").withColumn("side", side)


def agreement(sides: DataFrame) -> DataFrame:
    """For each question of an overlap: how many ids are common, whether the members and whether the order are the same."""
    count = lambda v: F.count_if(F.col("side") == v)
    out = sides.groupBy("qid").agg(count("both").alias("common"), count("one").alias("only_one"), count("other").alias("only_other"), F.bool_and(F.col("position_one").eqNullSafe(F.col("position_other"))).alias("same_order"))
    return out.withColumn("same_members", (F.col("only_one") == 0) & (F.col("only_other") == 0))


def hydrate(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Each wanted key once, with the stored columns, and ``found``: keys that aren't stored are reported, not dropped."""
    return wanted.select(key).distinct().join(stored.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def recorded_arm(recorded: DataFrame, stored: DataFrame) -> DataFrame:
    """A recorded ranking (record_id, position, chunk_id) with the text that is stored now (chunk_id, text): the recorded places
    stay, nothing is ranked again, and the text of a chunk that is gone is null with ``absent`` true."""
    now = stored.select("chunk_id", F.col("text").alias("text"), F.lit(False).alias("absent"))
    return recorded.select("record_id", "position", "chunk_id").join(now, "chunk_id", "left").withColumn("absent", F.coalesce("absent", F.lit(True)))


def absent_chunks(arm: DataFrame) -> DataFrame:
    """(record_id, chunks, absent): how many places a recorded arm has, and the chunks that are gone, in the recorded order."""
    gone = F.array_sort(F.collect_list(F.when(F.col("absent"), F.struct("position", "chunk_id"))))
    return arm.groupBy("record_id").agg(F.count("*").alias("chunks"), gone.alias("_gone")).select("record_id", "chunks", F.col("_gone.chunk_id").alias("absent"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")


def span_tree(spans: DataFrame) -> DataFrame:
    """Spans (trace_id, span_id, parent_span_id, started, ended) with ``depth`` (roots: 0), ``root``, ``offset``, the time that
    earlier siblings took, and ``fault``: null, ``orphan`` for spans below one whose parent isn't there, which counts as a
    root, or ``cycle`` for spans on or below a cycle, which have neither depth nor root.

    Every span points at its parent, and then at what its pointer points at, until that is a root: twice as far with each
    join, so a tree of any depth takes as many joins as its depth has binary digits. Every pass, the open spans of all depths
    above a bound remain; when none of them closes, what is left is cyclic. Spans that repeat get the same depth.
    """
    siblings = W.partitionBy("trace_id", "parent_span_id").orderBy("started", "span_id").rowsBetween(W.unboundedPreceding, -1)
    timed = spans.withColumn("duration", F.col("ended") - F.col("started")).withColumn("offset", F.coalesce(F.sum("duration").over(siblings), F.lit(0)))
    own = spans.groupBy("trace_id", "span_id").agg(F.min("parent_span_id").alias("parent"))
    there = own.select(F.col("trace_id").alias("_trace"), F.col("span_id").alias("_span"))
    known = own.join(there, F.col("trace_id").eqNullSafe(F.col("_trace")) & (F.col("parent") == F.col("_span")), "left")
    root = F.col("_span").isNull()
    now = cut(known.select("trace_id", "span_id", F.when(root, F.col("span_id")).otherwise(F.col("parent")).alias("to"), F.when(root, 0).otherwise(1).cast("long").alias("depth"), root.alias("closed"), (root & F.col("parent").isNotNull()).alias("orphan")))
    left = now.where(~F.col("closed")).count()
    before = left + 1
    while 0 < left < before:
        far = now.select(F.col("trace_id").alias("_trace"), F.col("span_id").alias("_span"), F.col("to").alias("_to"), F.col("depth").alias("_depth"), F.col("closed").alias("_closed"), F.col("orphan").alias("_orphan"))
        met = now.join(far, ~F.col("closed") & F.col("trace_id").eqNullSafe(F.col("_trace")) & (F.col("to") == F.col("_span")), "left")
        move = lambda one, other: F.when(F.col("closed"), F.col(one)).otherwise(other).alias(one)
        now = cut(met.select("trace_id", "span_id", move("to", F.col("_to")), move("depth", F.col("depth") + F.col("_depth")), move("closed", F.col("_closed")), move("orphan", F.col("_orphan"))))
        before, left = left, now.where(~F.col("closed")).count()
    closed = F.col("closed")
    fault = F.when(~closed, "cycle").when(F.col("orphan"), "orphan")
    tree = now.select(F.col("trace_id").alias("_trace"), F.col("span_id").alias("_span"), F.when(closed, F.col("depth")).cast("int").alias("depth"), F.when(closed, F.col("to")).alias("root"), fault.alias("fault"))
    return timed.join(tree, F.col("trace_id").eqNullSafe(F.col("_trace")) & F.col("span_id").eqNullSafe(F.col("_span"))).drop("_trace", "_span")


def corpus_verbatim(claims: DataFrame, chunks: DataFrame, least: int = 5) -> DataFrame:
    """(claim_id, run, chunk_id, claim_at, chunk_at): the longest run of tokens that each claim (claim_id, tokens) has in common with any
    of the chunks (chunk_id, tokens), where, and in which chunk, the first of equals by claim_at, chunk_id and chunk_at.
    Claims without a common run of ``least`` tokens are left out, as are null and empty ones.

    Every such run starts with a run of ``least`` tokens, a seed. Of the chunks only the stretches made of seeds that some claim
    has are kept, and stretches of the same tokens are one. Claims and stretches are joined on seeds; seeds in a row on
    one diagonal are a run. So a claim is read against the whole corpus, and no pair is read that has no seed in common.
    """
    seeds = lambda tokens: F.when(F.size(tokens) >= least, F.transform(F.sequence(F.lit(0), F.size(tokens) - least), lambda i: F.array_join(F.slice(tokens, i + 1, least), " "))).otherwise(F.array().cast("array<string>"))
    asked = claims.select("claim_id", F.posexplode(seeds(F.col("tokens"))).alias("claim_at", "seed"))
    wanted = asked.select(F.col("seed").alias("_seed")).distinct()
    placed = chunks.select("chunk_id", F.posexplode(seeds(F.col("tokens"))).alias("at", "seed")).join(wanted, F.col("seed") == F.col("_seed"), "left_semi")
    row = F.row_number().over(W.partitionBy("chunk_id").orderBy("at"))
    stretches = placed.withColumn("_island", F.col("at") - row).groupBy("chunk_id", "_island").agg(F.min("at").alias("first"), F.array_sort(F.collect_list(F.struct("at", "seed"))).alias("s"))
    # stretches of the same tokens: the first chunk's stands for all
    one = stretches.select(F.col("s.seed").alias("seeds"), "chunk_id", "first").groupBy("seeds").agg(F.min(F.struct("chunk_id", "first")).alias("where"))
    posted = one.select("where", F.posexplode("seeds").alias("at", "seed"))
    met = asked.join(posted, "seed").select("claim_id", "claim_at", "where", "at", (F.col("at") - F.col("claim_at")).alias("diagonal"))
    order = F.row_number().over(W.partitionBy("claim_id", "where", "diagonal").orderBy("claim_at"))
    runs = met.withColumn("_island", F.col("claim_at") - order).groupBy("claim_id", "where", "diagonal", "_island").agg(F.count("*").alias("n"), F.min("claim_at").alias("claim_at"), F.min("at").alias("at"))
    found = runs.select("claim_id", F.struct((-(F.col("n") + least - 1)).alias("less"), "claim_at", F.col("where.chunk_id").alias("chunk_id"), (F.col("where.first") + F.col("at")).alias("chunk_at")).alias("r"))
    best = found.groupBy("claim_id").agg(F.min("r").alias("r"))
    return best.select("claim_id", (-F.col("r.less")).cast("int").alias("run"), "r.chunk_id", F.col("r.claim_at").alias("claim_at"), F.col("r.chunk_at").cast("int").alias("chunk_at"))


def compare_to_spread(value: Column, low: Column, high: Column) -> Column:
    """(inside, place): whether the value lies in a spread, null if any is unknown; its place from 0 to 1, the middle of a
    spread of one value."""
    place = F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))).otherwise(F.when(value.isNotNull() & low.isNotNull(), F.lit(0.5)))
    return F.struct((value.between(low, high)).alias("inside"), place.alias("place"))
