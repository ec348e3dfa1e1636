"""Language identification by hyperdimensional profiles.

Every letter has a random vector of ``DIM`` signs, drawn from its code point. A letter n-gram is bound from its
letters' vectors, each permuted (rotated) once for every place it stands before the last, by their elementwise
product; a text or a language is the bundle (the sum) of its n-grams' vectors. N-grams of different letters or
order are almost orthogonal, so the cosine between a document and a language's prototype says how alike their
n-gram counts are. Sums are of whole numbers, so that they don't depend on how the rows are dealt.

Letters are what str.isalpha() calls so, in lower case; a run of anything else counts as one blank, and the text
starts and ends with one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.shared import documents, free_prefix
from lexiloom.llm.workers import blocks, release

#: Signs of a vector; letters of an n-gram; seed of the letters' vectors.
DIM, ORDER, SEED = 1024, 3, 7_919
#: Characters and texts of a block that is counted at once; n-grams whose vectors are held at once; letters that are kept.
BLOCK_CHARS, BLOCK_TEXTS, GRAMS, LETTERS = 400_000, 4_000, 8_192, 20_000
#: Chance that a text of no relation to any language reaches ``chance_score``. Texts of a length are judged if the labelled ones
#: but the share BELOW, which may be alien themselves, lie above that by MARGIN standard errors of unrelated vectors.
CHANCE, BELOW, MARGIN = 1e-6, 0.05, 2.0

_BLANK = 0x20


@lru_cache(maxsize=1)
def _case_table() -> np.ndarray:
    """For each code point that letter's lower case, or a blank if it isn't a letter."""
    table = np.full(0x110000, _BLANK, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def letter_vector(code: int, dim: int = DIM) -> np.ndarray:
    """Signs of a letter, as int8."""
    bits = np.random.Generator(np.random.Philox(key=[SEED, code])).integers(0, 2, dim, dtype=np.int8)
    return bits * 2 - 1


class Bundler:
    """Turns texts into vectors; keeps the vectors of letters that it has met. What it holds at once is bounded by
    BLOCK_CHARS, GRAMS and the number of texts of a block, however long a text is."""

    def __init__(self, dim: int = DIM, order: int = ORDER) -> None:
        self.dim, self.order = dim, order
        self._letters: dict[int, np.ndarray] = {}
        #: N-grams of each text of the last block.
        self.sizes = np.empty(0, np.int64)

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of these letters: (letters, dim)."""
        if len(self._letters) > LETTERS:
            self._letters.clear()
        for c in codes.tolist():
            if c not in self._letters:
                self._letters[c] = letter_vector(c, self.dim)
        return np.stack([self._letters[c] for c in codes.tolist()])

    def _letters_of(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Letters and the index of their text, as flat arrays, in parts: a part goes on with the last letters of the one
        before where a text goes on, so that each n-gram lies in one part."""
        if sum(map(len, texts)) <= BLOCK_CHARS:
            yield _collapsed("".join(f" {t} " for t in texts), np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts]))
            return
        for i, t in enumerate(texts):
            held = np.empty(0, np.uint32)
            for a in range(0, len(t) + 2, BLOCK_CHARS):
                part = ("" if a else " ") + t[max(0, a - 1) : a - 1 + BLOCK_CHARS] + (" " if a + BLOCK_CHARS >= len(t) + 2 else "")
                low, _ = _collapsed(part, np.zeros(len(part), np.int64))
                if len(held) and len(low) and held[-1] == low[0] == _BLANK:
                    low = low[1:]
                low = np.concatenate([held, low])
                yield low, np.full(len(low), i)
                held = low[max(0, len(low) - self.order + 1) :]

    def counted(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The n-grams of the texts of a block, in parts of at most GRAMS different ones: index of the text, number of the
        n-gram, as flat arrays by text; and the n-grams' vectors (n-grams, dim), as int8."""
        n = self.order
        self.sizes = np.zeros(len(texts), np.int64)
        for low, owner in self._letters_of(texts):
            if len(low) < n:
                continue
            alphabet, letters = np.unique(low, return_inverse=True)
            size = len(alphabet)
            ids = np.zeros(len(low) - n + 1, dtype=np.int64)
            for k in range(n):
                ids = ids * size + letters[k : len(letters) - n + 1 + k]
            inside = owner[n - 1 :] == owner[: len(owner) - n + 1]
            ids, owner = ids[inside], owner[: len(owner) - n + 1][inside]
            self.sizes += np.bincount(owner, minlength=len(texts))
            if size**n <= 4_000_000:
                hit = np.zeros(size**n, dtype=bool)
                hit[ids] = True
                grams = np.flatnonzero(hit)
                number = np.zeros(size**n, dtype=np.int64)
                number[grams] = np.arange(len(grams))
                ids = number[ids]
            else:
                grams, ids = np.unique(ids, return_inverse=True)
            for first in range(0, len(grams), GRAMS):
                rest = grams[first : first + GRAMS]
                some = slice(None) if len(grams) <= GRAMS else (ids >= first) & (ids < first + GRAMS)
                vectors = np.ones((len(rest), self.dim), dtype=np.int8)
                for k in range(n - 1, -1, -1):
                    used, which = np.unique(rest % size, return_inverse=True)
                    vectors *= np.roll(self._rows(alphabet[used]), n - 1 - k, axis=1)[which]
                    rest = rest // size
                yield owner[some], ids[some] - first, vectors

    def documents(self, texts: list[str]) -> np.ndarray:
        """A vector for each text of a block: (texts, dim), whole numbers."""
        out = np.zeros((len(texts), self.dim))
        for owner, ids, vectors in self.counted(texts):
            vectors = vectors.astype(np.float32)  # sums of a part are whole in it: BLOCK_CHARS is below 2 ** 24
            step = max(1, 2_000_000 // max(1, len(vectors)))  # rows of the count matrix that are held at once
            for a in range(0, len(texts), step):
                b = min(a + step, len(texts))
                lo, hi = np.searchsorted(owner, [a, b])
                if hi > lo:
                    counts = np.bincount((owner[lo:hi] - a) * len(vectors) + ids[lo:hi], minlength=(b - a) * len(vectors))
                    out[a:b] += counts.reshape(b - a, -1).astype(np.float32) @ vectors
        return out

    def bundle(self, texts: list[str], group: np.ndarray, groups: int) -> np.ndarray:
        """The sum of the texts' vectors for each group number: (groups, dim), int64."""
        out = np.zeros((groups, self.dim), dtype=np.int64)
        for owner, ids, vectors in self.counted(texts):
            counts = np.bincount(group[owner] * len(vectors) + ids, minlength=groups * len(vectors)).reshape(groups, -1)
            out += np.rint(counts.astype(np.float32) @ vectors.astype(np.float32)).astype(np.int64)
        return out


def _collapsed(joined: str, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters in lower case, one blank for each run of anything else, and whose they are."""
    low = _case_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = (low[1:] != _BLANK) | (low[:-1] != _BLANK) | (owner[1:] != owner[:-1])
    return low[keep], owner[keep]


def text_blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are counted together: of BLOCK_CHARS and BLOCK_TEXTS at most, or single longer ones."""
    return blocks([len(t) + 2 for t in texts], BLOCK_CHARS, BLOCK_TEXTS)


def held_out(doc_id: Column) -> Column:
    """Whether the documents are only for the test of what was learned: crc32 of the id as text, mod 3, is 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(labelled: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """A prototype for each language of the table (text, lang), of all its rows; nulls in either are left out.

    Each task bundles its own rows; the sums, one number for each language and place of the vector, are added up
    by Spark. What reaches the driver is as large as the set of languages, not as the table.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundler, sums = Bundler(dim), {}
        for frame in batches:
            texts = frame["text"].tolist()
            names, numbers = np.unique(frame["lang"].to_numpy(dtype=object).astype(str), return_inverse=True)
            for a, b in text_blocks(texts):
                got = bundler.bundle(texts[a:b], numbers[a:b], len(names))
                for k, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + got[k]
        if sums:
            yield pd.DataFrame({"lang": list(sums), "sums": [v.tolist() for v in sums.values()]})
        release()

    parts = labelled.select("text", "lang").where("text is not null and lang is not null").mapInPandas(run, "lang string, sums array<long>")
    total = parts.select("lang", F.posexplode("sums").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))
    rows = total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("all")).select("lang", F.col("all.value").alias("vector")).collect()
    return {r["lang"]: np.array(r["vector"], dtype=np.float64) for r in sorted(rows, key=lambda r: r["lang"])}


def identify(df: DataFrame, prototypes: dict[str, np.ndarray], dim: int = DIM, carry: list[str] | None = None) -> DataFrame:
    """df with ``lang_pred``, ``lang_score`` and ``lang_size``: the language of the nearest prototype, its cosine, 0 to 1, and
    the number of the text's n-grams.

    A text that is null or has no letter gets ``und``, 0 and 0; so does every text if nothing was learned. Ties go to
    the language that comes first by name. Columns pass through, or those that ``carry`` names; old columns of
    these names are replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in ("lang_pred", "lang_score", "lang_size") and (carry is None or f.name in carry)]
    names = [f.name for f in kept]
    found_here = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_size", T.LongType())]
    langs = sorted(prototypes)
    matrix = np.stack([prototypes[x] / (np.linalg.norm(prototypes[x]) or 1.0) for x in langs]) if langs else np.zeros((0, dim))
    source = free_prefix(names, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler(dim)
        for batch in batches:
            texts = pc.fill_null(batch.column(source), "").to_pylist()
            found, scores, sizes = ["und"] * len(texts), [0.0] * len(texts), [0] * len(texts)
            for a, b in text_blocks(texts) if langs else ():
                vectors = bundler.documents(texts[a:b])
                norm = np.linalg.norm(vectors, axis=1)
                cosines = (vectors @ matrix.T) / np.maximum(norm, 1e-9)[:, None]
                best = cosines.argmax(axis=1)
                for i in range(b - a):
                    if any(c.isalpha() for c in texts[a + i]):
                        found[a + i], scores[a + i] = langs[best[i]], float(min(1.0, max(0.0, cosines[i, best[i]])))
                        sizes[a + i] = int(bundler.sizes[i])
            columns = [*batch.select(names).columns, pa.array(found), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, *(f.name for f in found_here)])
        release()

    named = [F.col(f"`{n}`") for n in names]
    return df.select(*named, F.col("text").cast("string").alias(source)).mapInArrow(run, T.StructType([*kept, *found_here]))


def chance_score(languages: int, dim: int = DIM) -> float:
    """A cosine that the greatest of so many cosines of unrelated vectors reaches with a probability of CHANCE."""
    return NormalDist().inv_cdf(1 - CHANCE / max(1, languages)) * dim**-0.5


def _length(size: Column) -> Column:
    """Class of a length: the whole part of its binary logarithm."""
    return F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int")


def judged(labelled: DataFrame, languages: int) -> Callable[[Column], Column]:
    """From identified labelled documents, which lengths can be judged: whether a text of so many n-grams that is in one of the
    languages surely reaches ``chance_score``, by the low quantile of the labelled ones of its class of lengths.

    A class without labelled documents is as the next shorter one that has some. Classes are a few dozen.
    """
    by = labelled.where("lang_pred <> 'und'").groupBy(_length(F.col("lang_size")).alias("length")).agg(F.percentile_approx("lang_score", BELOW, 10_000).alias("low"))
    low = {r["length"]: r["low"] for r in by.collect()}
    yes, last, least = [], False, chance_score(languages) + MARGIN * DIM**-0.5
    for length in range(64):
        last = low[length] >= least if length in low else last
        yes += [length] * last
    return lambda size: _length(size).isin(yes) if yes else F.lit(False)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out. A null or empty text, or one without a
    letter, is ``und`` with a score of 0; rows that repeat are rows; a null doc_id stays null and is learned from."""
    docs = documents(spark, sf_dir)
    prototypes = learn(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), prototypes, carry=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
