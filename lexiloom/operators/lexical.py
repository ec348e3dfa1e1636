"""Lexical ranking of many questions in one job: strict match with a loose fallback, cover density, trigram word
similarity, weighted reciprocal-rank fusion.

Questions and chunks meet through inverted indexes only: lexeme and positions for full text, trigrams with a count filter for
word similarity. Ranks come from counts of the values of a signal, so no task sorts all that a question hits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from lexiloom.functions.analysis import analyze, analyzed, cover_density, occurrences
from lexiloom.functions.metrics import fused
from lexiloom.functions.similarity import meeting, word_similarity_of
from lexiloom.operators.dense import clamped
from lexiloom.sources.stored import cut, forget, stored

LEXICAL_WEIGHT, TRIGRAM_WEIGHT, DAMPING, FLOOR = 0.7, 0.3, 60, 0.6
#: Rows of a question index that are sent to all executors, after they have been counted; larger ones are shuffled.
SENT_ROWS = 500_000
#: Questions that meet a slice of chunks together, and bytes of text of a slice, on the average.
QUESTIONS, SLICE_BYTES = 256, 8_000_000


def sized(df: DataFrame) -> DataFrame:
    """df with the hint to send it to all executors if it has SENT_ROWS at most."""
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def postings(chunks: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(chunk_id, lexeme, positions) of chunks (chunk_id, text), or of those lexemes alone that ``only`` (lexeme) has. Texts are dealt out by chunk_id before they are analyzed, so that a
    chunk's words are put together where they are, as is what a question hits of them."""
    words = chunks.select("chunk_id", "text").repartition("chunk_id").select("chunk_id", F.explode(analyze(F.coalesce("text", F.lit("")))).alias("w")).select("chunk_id", "w.lexeme", "w.pos")
    if only is not None:
        words = words.join(sized(only.select("lexeme").distinct()), "lexeme")
    return words.groupBy("chunk_id", "lexeme").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def _hits(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, chunk_id, wanted, held[, total]): of questions' lexemes (qid, lexeme, wanted) those that each chunk holds, counted, and the
    number of their positions, if the index has these. Nothing is shuffled where a chunk's lexemes lie together."""
    total = [F.sum(F.size("positions")).alias("total")] if "positions" in index.columns else []
    return sized(asked).join(index, "lexeme").groupBy("qid", "chunk_id", "wanted").agg(F.count("*").alias("held"), *total)


def _asked(lexemes: DataFrame) -> DataFrame:
    return lexemes.join(lexemes.groupBy("qid").agg(F.count("*").alias("wanted")), "qid")


def strict_matches(lexemes: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, chunk_id, wanted, held, total, strict, lists) of the chunks that hold all of a question's distinct lexemes (qid, lexeme);
    lists has the positions of each. Lexemes are counted first: positions are put together for the pairs that are left."""
    hits = _hits(_asked(lexemes), index)
    whole = cut(hits.where(F.col("held") == F.col("wanted")).withColumn("strict", F.lit(True)))
    places = sized(whole.select("qid", "chunk_id").join(lexemes, "qid")).join(index, ["chunk_id", "lexeme"])
    return whole.join(places.groupBy("qid", "chunk_id").agg(F.collect_list("positions").alias("lists")), ["qid", "chunk_id"])


def matches(lexemes: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, chunk_id, held, wanted, strict): of questions' distinct lexemes (qid, lexeme) and an index (chunk_id,
    lexeme[, positions]) the chunks that hold all of a question's, or, where no chunk does, those that hold one. With positions there
    are ``total``, their number, and ``lists``, null where the match isn't strict."""
    if "positions" not in index.columns:
        hits = _hits(_asked(lexemes), index)
        strict = hits.groupBy(F.col("qid").alias("_qid")).agg((F.max(F.col("held") - F.col("wanted")) == 0).alias("strict"))
        return hits.join(strict, F.col("qid") == F.col("_qid")).drop("_qid").where(~F.col("strict") | (F.col("held") == F.col("wanted")))
    strict = strict_matches(lexemes, index)
    loose = _hits(_asked(lexemes).join(strict.select("qid").distinct(), "qid", "left_anti"), index).withColumn("strict", F.lit(False))
    return strict.unionByName(loose, allowMissingColumns=True)


#: Chunks of a block of an impact index, on the average; blocks that a question opens before it has a bound.
BLOCK_CHUNKS, PROBED = 64, 4


class ImpactIndex:
    """Postings in blocks with upper bounds, for the first k of a question by the number of times its lexemes stand in a chunk.

    Chunks of like length lie in a block, so that what a block can give at most is not far above what its chunks give. A
    question opens its PROBED most promising blocks first, which gives its k-th best count at least, and then those alone
    whose bound reaches that. So a question of common words doesn't score every chunk, and no window sees all its hits.
    """

    def __init__(self, index: DataFrame) -> None:
        """index (chunk_id, lexeme, positions), as ``postings`` gives it, or with ``times``, their number, in their place.

        A chunk's lexemes travel as one row, once, to its block; what is stored is a row for each block and lexeme. Nothing is shuffled
        before that where a chunk's lexemes lie together.
        """
        times = F.col("times") if "times" in index.columns else F.size("positions")
        terms = F.collect_list(F.struct("lexeme", "times")).alias("terms")
        whole = index.select("chunk_id", "lexeme", times.cast("long").alias("times")).groupBy("chunk_id").agg(F.sum("times").alias("size"), terms)
        chunks = stored(whole.select("chunk_id", F.floor(F.log2(F.col("size").cast("double")) * 4).cast("int").alias("class"), "terms"))
        parts = chunks.groupBy(F.col("class").alias("_class")).agg(F.ceil(F.count("*") / BLOCK_CHUNKS).alias("parts"))
        dealt = chunks.join(F.broadcast(parts), F.col("class") == F.col("_class"))  # a row for each quarter of a binary order of length
        placed = dealt.select("chunk_id", "terms", F.struct("class", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).alias("part")).alias("block")).repartition("block")
        rows = placed.select("block", "chunk_id", F.explode("terms").alias("t")).select("block", "chunk_id", "t.lexeme", "t.times")
        self.rows = stored(rows.groupBy("block", "lexeme").agg(F.max("times").alias("most"), F.collect_list(F.struct("chunk_id", "times")).alias("held")))
        forget(chunks)
        self.bounds = self.rows.select("block", "lexeme", "most")

    def promised(self, lexemes: DataFrame) -> DataFrame:
        """(qid, block, upper): what each block can give a question (qid, lexeme) at most."""
        return sized(lexemes).join(self.bounds, "lexeme").groupBy("qid", "block").agg(F.sum("most").alias("upper"))

    def _scored(self, lexemes: DataFrame, opened: DataFrame) -> DataFrame:
        """(qid, chunk_id, hits) of the blocks opened (qid, block). Where these are few, blocks stay where they are; else both are shuffled."""
        opened = opened.select("qid", "block")
        if opened.limit(SENT_ROWS + 1).count() <= SENT_ROWS:
            met = sized(lexemes).join(self.rows, "lexeme").join(F.broadcast(opened), ["qid", "block"])
        else:
            met = opened.join(lexemes, "qid").join(self.rows, ["block", "lexeme"])
        return met.select("qid", F.explode("held").alias("h")).groupBy("qid", F.col("h.chunk_id").alias("chunk_id")).agg(F.sum("h.times").alias("hits"))

    def opened(self, lexemes: DataFrame, k: int = 10) -> DataFrame:
        """(qid, block, upper) of the blocks that can hold one of a question's first k."""
        every = stored(self.promised(lexemes))
        best = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("upper"), "block"))
        some = self._scored(lexemes, stored(every.withColumn("_n", best).where(F.col("_n") <= PROBED)))
        place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("hits")))
        kth = some.withColumn("_n", place).where(F.col("_n") == k).select(F.col("qid").alias("_qid"), F.col("hits").alias("_kth"))
        return stored(every.join(kth, F.col("qid") == F.col("_qid"), "left").where(F.col("_kth").isNull() | (F.col("upper") >= F.col("_kth"))).select("qid", "block", "upper"))

    def search(self, lexemes: DataFrame, k: int = 10) -> DataFrame:
        """(qid, position, chunk_id, hits): the first k by hits, of equal ones by chunk_id, exactly. Lexemes of a question that
        repeat count once; chunks without any of them are left out."""
        lexemes = lexemes.select("qid", "lexeme").distinct()
        order = W.partitionBy("qid").orderBy(F.desc("hits"), F.asc_nulls_last("chunk_id"))
        found = self._scored(lexemes, self.opened(lexemes, k)).withColumn("position", F.row_number().over(order))
        return found.where(F.col("position") <= k).select("qid", "position", "chunk_id", "hits")


def asked_lexemes(questions: DataFrame) -> DataFrame:
    """(qid, lexeme): the distinct lexemes of questions (qid, question)."""
    return questions.select("qid", F.explode(F.array_distinct(analyze(F.coalesce("question", F.lit("")))["lexeme"])).alias("lexeme"))


def text_signal(questions: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, chunk_id, lexical): the chunks that match each question (qid, question), with their cover density. A question of
    stop words has none."""
    hits = matches(asked_lexemes(questions), index)
    loose = (0.1 * F.col("total")).cast("float")
    return hits.select("qid", "chunk_id", F.when(F.col("strict"), cover_density("lists")).otherwise(loose).alias("lexical"))


def _dealt(questions: DataFrame, chunks: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], more: list[T.StructField]) -> DataFrame:
    """(qid, chunk_id, *more) that run makes of blocks of QUESTIONS questions and slices of SLICE_BYTES of text, each pair of them a group of its own."""
    asked = questions.select("qid", "question").where("question <> ''")
    texts = chunks.select("chunk_id", "text").where("text <> ''")
    blocks = max(1, -(-asked.count() // QUESTIONS))
    slices = max(1, -(-(texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // SLICE_BYTES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    some = asked.withColumn("block", dealt("qid", blocks)).withColumn("slice", every(slices))
    held = texts.withColumn("slice", dealt("chunk_id", slices)).withColumn("block", every(blocks))
    kind = lambda df, c: T.StructField(c, df.schema[c].dataType)
    result = T.StructType([kind(asked, "qid"), kind(texts, "chunk_id"), *more])
    return held.groupBy("block", "slice").cogroup(some.groupBy("block", "slice")).applyInArrow(run, result)


def _met(questions: DataFrame, chunks: DataFrame, floor: float, extents: bool) -> DataFrame:
    """``similarity.meeting`` over blocks of questions and slices of text."""
    return _dealt(questions, chunks, meeting(floor, extents), [T.StructField("held", T.IntegerType()), T.StructField("trigram", T.FloatType())])


def trigram_candidates(questions: DataFrame, chunks: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(qid, chunk_id, held) of the pairs that may reach the floor: a pair of that word similarity has in common floor x n of the n
    distinct trigrams of the question at least, and exactly the pairs that do are given, with the number in common.

    All pairs are counted, as a product of the tables of chunks and questions by trigrams, a slice of chunks against a block of
    questions at a time: in prose most trigrams are common, and a join on them has far more rows than there are pairs.
    """
    return _met(questions, chunks, floor, False).select("qid", "chunk_id", "held")


def trigram_signal(questions: DataFrame, chunks: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(qid, chunk_id, trigram) for the pairs whose word similarity reaches the floor. Only what can have a run of trigrams that
    reaches it is compared, extent by extent."""
    return _met(questions, chunks, floor, True).where(F.col("trigram").cast("double") >= floor).select("qid", "chunk_id", "trigram")


#: What ``_signals`` gives beside qid and chunk_id.
SIGNALS = [T.StructField("strict", T.BooleanType()), T.StructField("total", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("lists", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("trigram", T.FloatType())]
#: Occurrences of lexemes that are summed over all questions of a block at a time.
SUMMED = 20_000


def _sums(text: np.ndarray, place: np.ndarray, asks: np.ndarray, n: int) -> np.ndarray:
    """Of n texts' occurrences (text, place), in order, how many each question (a column of asks) has."""
    sums = np.zeros((n, asks.shape[1]), np.int32)
    for i in range(0, len(text), SUMMED):
        own = text[i : i + SUMMED]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        sums[own[starts]] += np.add.reduceat(asks[place[i : i + SUMMED]], starts, axis=0)
    return sums


def _signals(k: int, floor: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of chunks (chunk_id, text) and questions (qid, question). It gives the pairs that the trigram signal finds; those that hold all
    of a question's lexemes, with ``lists`` of their positions; and where no chunk here does, of all others the first k
    by ``total``, the number of places of the question's lexemes, and then chunk_id. Beside these, without a chunk_id, it gives how often
    (``n``, 0 in rows of pairs) each total comes here, so that a rank can be told without the pairs themselves.
    """

    def run(chunks: pa.Table, questions: pa.Table) -> pa.Table:
        chunks = chunks.take(pc.sort_indices(chunks, sort_keys=[("chunk_id", "ascending")], null_placement="at_start"))
        rows, asked = np.arange(len(chunks)), np.arange(len(questions))
        near = meeting(floor, True)(pa.table({"chunk_id": rows, "text": chunks["text"]}), pa.table({"qid": asked, "question": questions["question"]}))
        shares = np.full((len(rows), len(asked)), np.nan, np.float32)
        shares[near["chunk_id"].to_numpy(), near["qid"].to_numpy()] = near["trigram"].to_numpy()
        loud = shares.astype(np.float64) >= floor
        lexemes = [list(dict.fromkeys(x for x, _ in analyzed(q))) for q in questions["question"].to_pylist()]
        places = {x: i for i, x in enumerate(dict.fromkeys(x for own in lexemes for x in own))}
        wanted, asks = np.array([len(own) for own in lexemes]), np.zeros((max(1, len(places)), len(lexemes)), np.int32)
        for q, own in enumerate(lexemes):
            asks[[places[x] for x in own], q] = 1
        text, place, position = occurrences(chunks["text"].to_pylist(), places)
        order = np.lexsort((position, place, text))
        text, place, position = text[order], place[order], position[order]
        new = np.flatnonzero(np.diff(text * len(asks) + place, prepend=-1))
        total, strict = _sums(text, place, asks, len(rows)), (_sums(text[new], place[new], asks, len(rows)) == wanted) & (wanted > 0)
        out: list[tuple] = []  # row, question, strict, total, n
        for q in asked:
            own, hits = total[:, q], np.flatnonzero(total[:, q])
            whole = np.flatnonzero(strict[:, q])
            pairs = np.union1d(whole, np.flatnonzero(loud[:, q]))
            if not len(whole) and len(hits):
                counts = np.bincount(own[hits])
                out += [(None, q, False, t, int(counts[t])) for t in np.flatnonzero(counts).tolist()]
                plain = hits[~loud[hits, q]]
                if len(plain) > k:
                    least = np.partition(own[plain], len(plain) - k)[len(plain) - k]
                    above = plain[own[plain] > least]
                    plain = np.concatenate([above, plain[own[plain] == least][: k - len(above)]])
                pairs = np.concatenate([pairs, plain])
            out += [(int(r), q, bool(strict[r, q]), int(own[r]), 0) for r in pairs]
        ends = np.append(new, len(text))
        first = np.searchsorted(text[new], np.arange(len(rows) + 1))

        def lists(r: int, q: int) -> list[np.ndarray]:
            mine = range(first[r], first[r + 1])
            return [position[ends[i] : ends[i + 1]] for i in mine if asks[place[new[i]], q]]

        columns = list(zip(*out, strict=True)) if out else [()] * 5
        row, q = pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64())
        trigram = [None if r is None or not loud[r, i] else float(shares[r, i]) for r, i in zip(columns[0], columns[1], strict=True)]
        made = {"qid": questions["qid"].take(q), "chunk_id": chunks["chunk_id"].take(row), "strict": pa.array(columns[2], pa.bool_()), "total": pa.array(columns[3], pa.int32()), "n": pa.array(columns[4], pa.int64())}
        found = pa.array([lists(r, i) if s else None for r, i, s in zip(*columns[:3], strict=True)], pa.list_(pa.list_(pa.int32())))
        return pa.table({**made, "lists": found, "trigram": pa.array(trigram, pa.float32())})

    return run


def signals(questions: DataFrame, chunks: DataFrame, k: int, floor: float = FLOOR) -> tuple[DataFrame, DataFrame]:
    """Pairs (qid, chunk_id, lexical, trigram) and counts (qid, lexical, n). Pairs are those that the trigram signal finds, and of others those that
    can be among a question's first k; counts tell how many pairs in all have each value of the lexical signal.

    What a question's lexemes hit is counted as a product of tables, like trigrams, where a slice of chunks meets a block of questions: a
    join on them has a row for each lexeme of nearly every pair.
    """
    # a question of which one chunk somewhere holds all lexemes has strict matches alone
    lexical = F.when(F.col("strict"), cover_density("lists")).otherwise((0.1 * F.col("total")).cast("float"))
    every = stored(_dealt(questions, chunks, _signals(k, floor), SIGNALS).withColumn("lexical", lexical).drop("lists"))
    whole = every.where("strict").select(F.col("qid").alias("_qid")).distinct().withColumn("whole", F.lit(True))
    marked = every.join(whole, F.col("qid") == F.col("_qid"), "left").withColumn("silent", F.coalesce("whole", F.lit(False)) & ~F.col("strict"))
    pairs = marked.where("n = 0").withColumn("lexical", F.when(F.col("silent"), F.lit(0.0).cast("float")).otherwise(F.col("lexical")))
    counts = marked.where("not silent and (n > 0 or strict)").select("qid", "lexical", F.greatest("n", F.lit(1)).alias("n"))
    return pairs.where("lexical > 0 or trigram is not null").select("qid", "chunk_id", "lexical", "trigram"), counts


def _ranks(counts: DataFrame, signal: str) -> DataFrame:
    """(_qid, _value, rank): the rank, with ties, of each value that a signal has for a question, from counts (qid, signal, n) of the values."""
    # values that equal as numbers are one, so no value is joined as a float
    counts = counts.groupBy(F.col("qid").alias("_qid"), F.col(signal).cast("double").alias("_value")).agg(F.sum("n").alias("_n"))
    above = W.partitionBy("_qid").orderBy(F.desc("_value")).rowsBetween(W.unboundedPreceding, -1)
    return counts.select("_qid", "_value", (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).cast("int").alias(f"{signal}_rank"))


def fuse(signals: DataFrame, k: int = 10, floor: float = FLOOR, counts: DataFrame | None = None) -> DataFrame:
    """Ranks of (qid, chunk_id, lexical, trigram): lexical_rank and trigram_rank, null where a signal is silent, the fused
    score, and the first k of each question by score, then chunk_id.

    What only the lexical signal found can't be among the first k unless it is among the lexical signal's first k of its
    kind, so that alone is ranked and fused, beside all that the trigram signal found. Where the signals are no more than that,
    ``counts`` (qid, lexical, n) tells how many have each value in all.
    """
    k = clamped(k)
    loud = F.coalesce(F.col("trigram").cast("double"), F.lit(0.0)) >= floor
    fired = signals.where((F.col("lexical") > 0) | loud)
    order = W.partitionBy("qid").orderBy(F.desc("lexical"), "chunk_id")
    plain = fired.where(~loud).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).drop("_place")
    kept = plain.unionByName(fired.where(loud))
    for signal, speaks in (("lexical", F.col("lexical") > 0), ("trigram", loud)):
        mine = counts if signal == "lexical" and counts is not None else signals.where(speaks).withColumn("n", F.lit(1))
        key = F.when(speaks, F.col(signal).cast("double"))
        kept = kept.withColumn("_key", key).join(_ranks(mine, signal), (F.col("qid") == F.col("_qid")) & (F.col("_key") == F.col("_value")), "left").drop("_qid", "_value", "_key")
    scored = kept.withColumn("score", F.round(fused(LEXICAL_WEIGHT, F.col("lexical_rank"), DAMPING) + fused(TRIGRAM_WEIGHT, F.col("trigram_rank"), DAMPING), 12))
    best = W.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("position", F.row_number().over(best)).where(F.col("position") <= k)


def ranked(questions: DataFrame, chunks: DataFrame, k: int = 10, tiers: tuple[str, ...] | None = None) -> DataFrame:
    """``retrieve`` without the similarities that rank nothing."""
    if tiers is not None:
        if not tiers or set(tiers) - {"A", "B"}:
            raise ValueError("tiers are A, B or both")
        chunks = chunks.where(F.col("tier").isin(*tiers))
    pairs, counts = signals(questions, chunks, clamped(k))
    return fuse(pairs, k, counts=counts)


def retrieve(questions: DataFrame, chunks: DataFrame, k: int = 10, tiers: tuple[str, ...] | None = None) -> DataFrame:
    """The lexical retriever over questions (qid, question) and chunks (chunk_id, text, and tier if tiers are given)."""
    # of what only the text signal found, the raw similarity is reported too: it is below the floor and ranks nothing
    best = sized(cut(ranked(questions, chunks, k, tiers)))
    best = chunks.select("chunk_id", "text").join(best, "chunk_id").join(questions.select("qid", "question"), "qid")
    # few rows, and each takes long: dealt out by number, which keeps them from being put together in one task
    best = best.repartition(int(best.sparkSession.conf.get("spark.sql.shuffle.partitions")), "qid", "chunk_id")
    return best.withColumn("trigram", F.coalesce("trigram", word_similarity_of("question", "text"))).drop("text", "question")
