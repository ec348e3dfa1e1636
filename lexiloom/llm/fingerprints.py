"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is a weighted set: its words, lower-cased, with their counts. For each of ``samples`` draws and each word of
weight S there are r and c, gamma(2, 1), and b, uniform, all from a hash of the word and the draw; then

    t = floor(ln S / r + b)      y = exp(r (t - b))      a = c / (y exp(r))

and the draw's sample is the (word, t) of least a. Two texts have the same sample with a probability that equals
their generalised Jaccard similarity, the sum of the lesser weights over the sum of the greater ones. ln a is
compared in place of a. r and c are -ln(u v) of uniform u and v, 32 bits of a hash each, so both tails are whole: long texts
have their samples from there.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexiloom.llm.shared import documents, partitions

SAMPLES = 32
#: Hexadecimal digits of a sample in a fingerprint.
DIGITS = 8

_SPACE = r"[\x20\x09-\x0D]+"


def terms(text: Column) -> Column:
    """The words of a text, lower-cased; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE), lambda w: w != "")


class _Draws:
    """The draws' expressions over a term (a hash of a word) and its weight's logarithm."""

    def _uniform(self, bits: Column) -> Column:
        """The middle of one of 2 ** 32 equal shares, from the low 32 bits."""
        return (bits.bitwiseAND(F.lit((1 << 32) - 1)).cast("double") + 0.5) / float(1 << 32)

    def gamma(self, bits: Column) -> Column:
        """gamma(2, 1) from a hash's 64 bits: minus the logarithm of the product of two uniform numbers."""
        return -F.ln(self._uniform(bits) * self._uniform(F.shiftrightunsigned(bits, 32)))

    def sample(self, term: Column, log_weight: Column, k: int) -> Column:
        """ln a in the high bits, as a whole number that orders like it, and the sample's name in the low 32."""
        low = F.lit((1 << 32) - 1)
        r = self.gamma(F.xxhash64(term, F.lit(3 * k)))
        log_c = F.ln(self.gamma(F.xxhash64(term, F.lit(3 * k + 1))))
        b = self._uniform(F.xxhash64(term, F.lit(3 * k + 2)))
        t = F.floor(log_weight / r + b)
        log_a = log_c - r * (t.cast("double") - b + 1.0)
        # ln a lies within +-127: r is at most 46, ln c at least -23, and weights are counts below 2 ** 31
        rank = ((log_a + 128.0) * float(1 << 23)).cast("long")
        name = F.shiftrightunsigned(term.bitwiseXOR(t * F.lit(0x9E3779B1)), 16).bitwiseAND(low)
        return F.shiftleft(rank, 32).bitwiseOR(name)


def samples_of(df: DataFrame, key: list[str], sides: dict[str, str], count: int = SAMPLES) -> DataFrame:
    """(key, and for each side an array of ``count`` samples): the weighted set of each of a row's arrays of words.

    ``sides`` names the array of words for each column of samples. A side of no words has samples 0. The key must be a row's
    own; if df is partitioned by some of it, nothing is shuffled. Terms are counted before anything is drawn from them, and
    a term of several sides is hashed once.
    """
    low = F.lit((1 << 32) - 1)
    tagged = F.array(*[F.struct(F.lit(i).alias("side"), F.col(words).alias("words")) for i, words in enumerate(sides.values())])
    each = df.select(*key, F.explode(tagged).alias("_tagged")).select(*key, F.col("_tagged.side").alias("_side"), F.explode_outer("_tagged.words").alias("_word"))
    hashed = each.select(*key, "_side", F.when(F.col("_word").isNotNull(), F.xxhash64("_word")).alias("_term"))
    counts = [F.count(F.when(F.col("_side") == i, F.col("_term"))).alias(f"_n{i}") for i in range(len(sides))]
    weighted = hashed.groupBy(*key, "_term").agg(*counts)
    weighted = weighted.select(*key, "_term", *[F.when(F.col(f"_n{i}") > 0, F.ln(F.col(f"_n{i}").cast("double"))).alias(f"_log{i}") for i in range(len(sides))])
    draws = _Draws()
    # one array for each side, so that no plan above has a column for each draw
    least = [F.array(*[F.min(draws.sample(F.col("_term"), F.col(f"_log{i}"), k)) for k in range(count)]).alias(p) for i, p in enumerate(sides)]
    drawn = weighted.groupBy(*key).agg(*least)
    return drawn.select(*key, *[F.transform(p, lambda x: F.coalesce(x.bitwiseAND(low), F.lit(0))).alias(p) for p in sides])


def as_text(samples: Column) -> Column:
    """The samples as a string of DIGITS hexadecimal digits each."""
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), DIGITS, "0")), "")


def likeness(one: Column, other: Column) -> Column:
    """The share of the draws in which two sides have the same sample; 1 for two empty sets."""
    return F.size(F.filter(F.zip_with(one, other, lambda a, b: a == b), lambda same: same)) / F.size(one)


def fingerprint(df: DataFrame, key: list[str], text: str = "text", count: int = SAMPLES) -> DataFrame:
    """(key, fingerprint) for each row of df; the key must be each row's own. Null and empty texts, and those of white
    space only, have the fingerprint of zeros. Equal texts have equal fingerprints."""
    words = df.select(*key, terms(F.col(text)).alias("_words"))
    return samples_of(words, key, {"_samples": "_words"}, count).select(*key, as_text(F.col("_samples")).alias("fingerprint"))


def in_ranges(df: DataFrame, column: str, tie: str, ranges: int) -> DataFrame:
    """df with ``_range``: rows of like size, by ascending value of the column (null: below the least).

    The bounds are approximate quantiles of the whole column, a number for each range, and are searched by halving. A value
    that several bounds equal is a hot one, and its rows are split once more by ``tie``, a 64-bit hash, in as many parts.
    """
    shares = [i / ranges for i in range(1, ranges)]
    null = F.coalesce(F.col(column), F.lit(-(1 << 63)))
    bounds = df.agg(F.percentile_approx(null, shares, max(10_000, 4 * ranges)).alias("b")).first()["b"] if shares else None
    if not bounds:
        return df.withColumn("_range", F.lit(0).cast("long"))
    times = Counter(bounds)
    listed = F.split(F.lit(",".join(map(str, sorted(times)))), ",").cast("array<long>")
    parts = F.split(F.lit(",".join(str(times[b]) for b in sorted(times))), ",").cast("array<long>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(times).bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda acc, step: acc + F.when(F.get(listed, acc + step - 1) <= null, step).otherwise(0))
    found = df.withColumn("_bound", at)
    hot = F.get(listed, F.col("_bound") - 1) == null
    part = F.when(hot, F.pmod(F.shiftrightunsigned(F.col(tie), 1), F.get(parts, F.col("_bound") - 1))).otherwise(0)
    # a bound's own rows are the lowest of its range
    return found.withColumn("_range", F.col("_bound").cast("long") * (1 << 32) + F.coalesce(part, F.lit(0))).drop("_bound")


#: Rows, and bytes of texts, that a range has at most on the average, whatever the number of shuffle partitions.
RANGE_ROWS, RANGE_BYTES = 20_000, 64_000_000


def op10_fingerprints(spark: SparkSession, sf_dir: str, count: int = SAMPLES) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are.

    Documents lie in ranges of doc_id, and the next one is the next row of the range; a range ends with a copy of the first
    row of the range below (of the highest range, for the very last). Equal doc_ids are ordered by a hash of the text;
    a null doc_id is below all others. A null or empty text has a fingerprint of zeros; rows that repeat are rows.
    """
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_hash", F.xxhash64("text"))
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranged = in_ranges(docs, "doc_id", "_hash", max(4 * partitions(spark), -(-rows // RANGE_ROWS), -(-size // RANGE_BYTES)))
    # descending doc_id, null last, then the part of a hot doc_id and the hash, both ascending
    place = F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("down"), F.col("_range").alias("part"), F.col("_hash").alias("hash"))
    slim = ranged.select("_range", place.alias("place")).groupBy("_range").agg(F.min("place").alias("first")).collect()  # a row for each range
    tops = sorted(((r["_range"], r["first"]) for r in slim), key=lambda r: (r[1]["none"], r[1]["down"] or 0, r[1]["part"], r[1]["hash"]))
    lookup = [(r, below[0], below[1]["down"], below[1]["hash"]) for (r, _), below in zip(tops, [*tops[1:], *tops[:1]], strict=True)]
    wanted = F.broadcast(spark.createDataFrame(lookup, "_above long, _of long, _down long, _first long"))
    firsts = ranged.join(wanted, (F.col("_range") == F.col("_of")) & (-F.col("doc_id")).eqNullSafe(F.col("_down")) & (F.col("_hash") == F.col("_first")))
    edges = firsts.groupBy("_above").agg(F.min("text").alias("text")).select(F.col("_above").alias("_range"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("_hash"), "text", F.lit(True).alias("_edge"))
    rows = ranged.select("_range", "doc_id", "_hash", "text", F.lit(False).alias("_edge")).unionByName(edges)
    order = W.partitionBy("_range").orderBy("_edge", F.desc_nulls_last("doc_id"), "_hash", "text")
    paired = rows.withColumn("_row", F.row_number().over(order)).withColumn("_next", F.coalesce(F.lead("text").over(order), F.lit("")))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("_next"), F.lit(1), half))
    base = paired.select("_range", "_row", "_edge", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))

    key = ["_range", "_row"]
    drawn = samples_of(base.select(*key, terms(F.col("text")).alias("_words"), terms(F.col("edited")).alias("_edited_words")), key, {"own": "_words", "other": "_edited_words"}, count)
    following = F.lead("own").over(W.partitionBy("_range").orderBy("_row"))
    prints = drawn.withColumn("following", following).select(*(F.col(k).alias(f"_of{k}") for k in key), "own", "other", "following")
    info = base.where(~F.col("_edge")).select(*key, "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    joined = info.join(prints.hint("merge"), (F.col("_range") == F.col("_of_range")) & (F.col("_row") == F.col("_of_row")))
    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
