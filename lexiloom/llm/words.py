"""Words of whole texts as UTF-8 bytes, their hashes, and sets of hashes as bit fields of a fixed size.

A word is a maximal run of digits, letters and characters beyond ASCII; only A-Z are lower-cased. Bit fields serve as filters
alone: what they let through by chance is told apart later, by the words themselves.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word in lower-cased bytes, and the same in a regular expression of the JVM.
_WORD, PATTERN = re.compile(rb"[0-9a-z\x80-\xff]+"), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A bit field has 2 ** BITS bits, 2 MB, however many hashes are set. Hashes of words that a task remembers.
BITS, KNOWN = 24, 500_000


def words_of(raw: bytes | None) -> list[bytes]:
    """The words of a text's bytes; none of null."""
    return _WORD.findall(raw.lower()) if raw else []


def words(text: Column) -> Column:
    """The same in the JVM; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(PATTERN), F.lit(0))


class Hashes(dict):
    """64-bit hashes of words, each made once while there are at most KNOWN."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KNOWN:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    count = max(0, len(hashes) - size + 1)
    out = np.full(count, size, dtype=np.uint64)
    for i in range(size):
        out = (out ^ hashes[i : i + count]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def bits_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def bit_field(texts: DataFrame, hashed: Callable[[bytes], Iterable[np.ndarray]]) -> Broadcast[np.ndarray]:
    """The bit field of all hashes that ``hashed`` gives for each value of the only column of texts, sent to all tasks. The
    driver sees numbers of bits, of which there are 2 ** BITS at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bits_of(h) for raw in batch.column(0).to_pylist() if raw is not None for h in hashed(raw)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.empty(0, np.int64), *found])))], ["bit"])

    bits = texts.select(F.col(texts.columns[0]).cast("binary")).mapInArrow(run, "bit long").distinct().toArrow().column(0).to_numpy()
    field = np.zeros(1 << BITS, dtype=bool)
    field[bits] = True
    return texts.sparkSession.sparkContext.broadcast(np.packbits(field, bitorder="little"))


def in_field(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = bits_of(hashes)
    return (field[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)
