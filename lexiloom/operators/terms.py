"""Terms of a vocabulary of any size in texts: a join of token n-grams, and one pass over the matches of a text.

``functions.text.detect_terms`` is one regular expression and fits small vocabularies. Here a folded text is cut into pieces, words and what
stands between them; a term that starts and ends with a word is a run of whole pieces, so a hash join finds it. Of
matches that overlap the leftmost counts, and of those that start together the longest, as an alternation of terms in order
of length would have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import fold

_PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
#: Rows of a vocabulary that is sent to all executors, after it has been counted; a larger one is shuffled.
SENT_ROWS = 200_000
_GRAM = "array<struct<at:int,length:int,gram:string>>"


def pieces(text: Column) -> Column:
    """Words and what stands between them, in order: all of the folded text; null has none."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(_PIECE), F.lit(0))


def used_terms(chunks: DataFrame, vocabulary: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, terms): for each of chunks (key, text) the terms of the vocabulary (term, position) that it uses, each once, in order of
    their positions; an empty array where it uses none.

    Terms that fold to the same are found together. A term must start and end with a letter, digit or underscore: others are an
    error. Null texts use none, null terms count for nothing. Chunks that repeat give a row each.
    """
    cut = pieces(F.col("term"))
    known = vocabulary.where("term is not null").select("term", "position", fold(F.col("term")).alias("folded"), F.size(cut).alias("length"))
    edges = known.where(~F.col("folded").rlike(r"(?s)^[\p{L}\p{N}_](.*[\p{L}\p{N}_])?$")).select("term").head(5)
    if edges:
        raise ValueError(f"terms that don't start and end with a word: {', '.join(repr(r['term']) for r in edges)}")
    lengths = sorted(r["length"] for r in known.select("length").distinct().collect())
    distinct = known.groupBy("folded").agg(F.sort_array(F.collect_set(F.struct("position", "term"))).alias("terms"))
    distinct = F.broadcast(distinct) if distinct.limit(SENT_ROWS + 1).count() <= SENT_ROWS else distinct
    numbered = chunks.select(F.monotonically_increasing_id().alias("_row"), key, pieces(F.col("text")).alias("_pieces"))
    grams = [_grams(n) for n in lengths]
    # a run that is no term stands for the chunk itself; of the others only terms are put together again
    itself = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("length"), F.lit(None).cast("string").alias("gram")))
    rows = numbered.select("_row", key, F.explode(F.concat(itself, *grams)).alias("g"))
    met = rows.join(distinct, F.col("g.gram") == F.col("folded"), "left").where(F.col("folded").isNotNull() | (F.col("g.at") < 0)).groupBy("_row", key)
    found = met.agg(F.array_sort(F.collect_list(F.when(F.col("folded").isNotNull(), F.struct(F.col("g.at").alias("at"), (-F.col("g.length")).alias("less"), "terms")))).alias("found"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<position:bigint,term:string>>").alias("terms"))
    kept = F.aggregate("found", start, lambda a, m: F.when(m["at"] >= a["end"], F.struct((m["at"] - m["less"]).alias("end"), F.concat(a["terms"], m["terms"].cast("array<struct<position:bigint,term:string>>")).alias("terms"))).otherwise(a))
    return found.select(key, F.transform(F.sort_array(F.array_distinct(kept["terms"])), lambda t: t["term"]).alias("terms"))


def _grams(n: int) -> Column:
    """Every run of n pieces that starts with a word: where, how long, as text. Words are every other piece."""
    first, last = F.when(F.get("_pieces", F.lit(0)).rlike(r"^[\p{L}\p{N}_]"), 0).otherwise(1), F.size("_pieces") - n
    text = (lambda i: F.get("_pieces", i)) if n == 1 else (lambda i: F.array_join(F.slice("_pieces", i + 1, n), ""))
    some = F.transform(F.sequence(first, last, F.lit(2)), lambda i: F.struct(i.alias("at"), F.lit(n).alias("length"), text(i).alias("gram")))
    return F.when(last >= first, some).otherwise(F.array().cast(_GRAM))
