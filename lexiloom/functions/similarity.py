"""Similarities of texts: trigrams as arrays in the JVM, and what needs a walk over a sequence as Arrow functions: trigram extents
and common token runs."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RUN = re.compile(r"[^\W_]+")
#: The same in a regular expression of the JVM.
WORD = r"[\p{L}\p{N}]+"


def trigram_array(text: Column) -> Column:
    """What ``trigrams`` gives, in order and with repeats; null has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))))


def trigrams(text: str) -> list[str]:
    """Trigrams in order: of each lower-case run of letters and digits, with two blanks before it and one after."""
    out = []
    for word in _RUN.findall(text.lower()):
        padded = f"  {word} "
        out += [padded[i : i + 3] for i in range(len(padded) - 2)]
    return out


def word_similarity(query: str, text: str, floor: float = 0.0) -> float:
    """The greatest share |Q & E| / |Q | E| over runs E of the text's trigrams, Q being the query's; 0 if below floor."""
    found, wanted = trigrams(text), frozenset(trigrams(query))
    return extent_similarity(wanted, found, frozenset(found), floor or _some_share(wanted, found))


def _some_share(wanted: frozenset[str], found: list[str]) -> float:
    """The best share of runs from thirty-odd starts: what the best of all runs has at least, so that few starts are left to look at."""
    best = 0.0
    for start in range(0, len(found), max(1, len(found) // 32)):
        hits, strangers = set(), set()
        for t in islice(found, start, None):
            if t in wanted:
                hits.add(t)
                best = max(best, len(hits) / (len(wanted) + len(strangers)))
            else:
                strangers.add(t)
                if len(wanted) < best * (len(wanted) + len(strangers)):
                    break
    return best


def extent_similarity(wanted: frozenset[str], found: list[str], held: frozenset[str], floor: float = 0.0) -> float:
    """The same of the query's trigrams, the text's in order, and the text's as a set.

    A best run starts and ends at a trigram of the query, and it has no more strangers than leave its share above
    the best so far, so most starts end after a few steps. A text that holds too few of the query's is done at once.
    """
    reachable, q = len(wanted & held), len(wanted)
    if not reachable or reachable < floor * q - 1e-9:
        return 0.0
    least = max(0.0, floor - 1e-9)
    best = least
    for start in _starts(wanted, found, floor * q - 1e-9, reachable / floor - q + 1e-9) if floor else range(len(found)):
        if found[start] not in wanted:
            continue
        hits, strangers = set(), set()
        limit = reachable / best - q if best else len(found)
        for t in islice(found, start, None):
            if t in wanted:
                hits.add(t)
                share = len(hits) / (q + len(strangers))
                if share > best:
                    best = share
                    limit = reachable / best - q
            else:
                strangers.add(t)
                if len(strangers) > limit:
                    break
    return best if best > least else 0.0


def _starts(wanted: frozenset[str], found: list[str], hits: float, strangers: float) -> list[int]:
    """Where a run can start that has so many hits and no more strangers: one window slides over the text."""
    inside: dict[str, int] = {}
    held, odd, end, out = 0, 0, 0, []
    for start, first in enumerate(found):
        while end < len(found):
            t = found[end]
            if t not in inside:
                if t in wanted:
                    held += 1
                elif odd + 1 > strangers:
                    break
                else:
                    odd += 1
                inside[t] = 0
            inside[t] += 1
            end += 1
        if held >= hits:
            out.append(start)
        if end == start:  # not even the first trigram fits
            end += 1
            continue
        inside[first] -= 1
        if not inside[first]:
            del inside[first]
            if first in wanted:
                held -= 1
            else:
                odd -= 1
    return out


@F.pandas_udf(T.FloatType())
def word_similarity_of(query: pd.Series, text: pd.Series) -> pd.Series:
    """Of long texts too: the best of some runs is a floor, and what can reach it is measured."""
    return pd.Series([None if q is None or t is None else _measured(q, t) for q, t in zip(query, text, strict=True)], dtype="float32")


def _measured(query: str, text: str) -> float:
    floor = max(0.0, _some_share(frozenset(trigrams(query)), trigrams(text)) - 1e-9)
    found = meeting(floor, True)(pa.table({"chunk_id": [0], "text": [text]}), pa.table({"qid": [0], "question": [query]}))
    return found["trigram"][0].as_py() if len(found) else 0.0


def word_similarity_at(floor: float) -> Callable[..., Column]:
    """The same with a floor: 0 where it isn't reached, which is told far sooner. The trigrams of a text that comes again are
    those of before."""

    def run(query: pd.Series, text: pd.Series) -> pd.Series:
        of_query: dict[str, frozenset[str]] = {}
        out, last, found, held = [], None, [], frozenset()
        for q, t in zip(query, text, strict=True):
            if q is None or t is None:
                out.append(None)
                continue
            if t != last:
                last, found = t, trigrams(t)
                held = frozenset(found)
            if q not in of_query:
                of_query[q] = frozenset(trigrams(q))
            out.append(extent_similarity(of_query[q], found, held, floor))
        return pd.Series(out, dtype="float32")

    return F.pandas_udf(run, T.FloatType())


#: Cells of the table of a batch's texts by trigrams, characters of a batch, places of a block (runs that start in one are bounded together),
#: starts whose runs are measured together, and blocks whose places are put together.
CELLS, CHARACTERS, STRIDE, STRIP, NEAR = 4_000_000, 1_000_000, 96, 64, 128


def _padded(text: str | None) -> str:
    """The words of a text so that its windows of three characters, but those of two blanks at the end, are its trigrams."""
    return f"  {'   '.join(_RUN.findall((text or '').lower()))} "


def _codes(texts: list[str], letters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of padded texts as numbers, in order and with repeats, and for each the place of its text. With ``letters``, a number for each
    code point, numbers are small, and trigrams whose letters have one number are told apart no more."""
    signs = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    whole = np.flatnonzero((signs[1:-1] != 32) | (signs[2:] != 32))
    low, base = (signs.astype(np.int64), 1 << 21) if letters is None else (letters[signs], int(letters.max()) + 1)
    return ((low[:-2] * base + low[1:-1]) * base + low[2:])[whole], owner[whole]


def _letters(texts: list[str]) -> np.ndarray:
    """A number from 1 for each letter of the texts, 0 for all other code points."""
    found = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32))
    numbers = np.zeros(0x110000, np.int32 if len(found) < 1_000 else np.int64)
    numbers[found] = np.arange(1, len(found) + 1)
    return numbers


def _before(found: np.ndarray) -> np.ndarray:
    """For each place where its value stood last, -1 where it is new."""
    bits = len(found).bit_length()
    order = np.sort((found.astype(np.int64) << bits) | np.arange(len(found))) if not len(found) or int(found.max()) >> (62 - bits) == 0 else None
    if order is None:
        at = np.argsort(found, kind="stable")
        again = found[at[1:]] == found[at[:-1]]
    else:
        at, value = order & ((1 << bits) - 1), order >> bits
        again = value[1:] == value[:-1]
    before = np.full(len(found), -1)
    before[at[1:][again]] = at[:-1][again]
    return before


class _Windows:
    """Bounds on runs of many texts at once. ``found`` are trigrams as numbers, text after text, ``place`` their columns of ``asks``, and
    ``ends`` tells where texts end.

    Runs that start in a block of STRIDE places and have no more than d distinct trigrams lie in the block's window: up to where d + 1 distinct ones
    have stood since the next block's start. A run with h of a query's trigrams that reaches the floor has no more than
    h (1 + floor) / floor - size distinct ones. So what a text holds of the query's bounds the window, what the window
    holds bounds h, and that bounds the window again.
    """

    def __init__(self, found: np.ndarray, place: np.ndarray, ends: np.ndarray, floor: float) -> None:
        self.place, self.before, self.floor = place, _before(found), floor
        starts = np.concatenate([[0], ends[:-1]])
        blocks = -(-(ends - starts) // STRIDE)
        self.text = np.repeat(np.arange(len(ends)), blocks)
        self.start = starts[self.text] + STRIDE * (np.arange(len(self.text)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        self.end = ends[self.text]
        self.next = np.minimum(self.start + STRIDE, self.end)

    def distinct(self, held: np.ndarray, size: int) -> np.ndarray:
        """How many distinct trigrams a run can have that reaches the floor with so many of the query's."""
        return np.floor(held.astype(np.float64) * ((1 + self.floor) / self.floor) - size + 1e-6).astype(np.int64) if self.floor else np.full(len(held), 1 << 40)

    def open(self, held: np.ndarray, sizes: np.ndarray, least: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, query, where the window ends) of the windows that can have a run that reaches the floor; held (text, query) tells
        what a text holds of a query's trigrams."""
        wanted = held >= least
        width, n, out = 4 * min(int(self.distinct(held.max(axis=0), sizes).max()), 1 << 20) + STRIDE, len(self.place), [(np.zeros(0, np.int64),) * 3]
        known = max(int(c.max()) for c in columns if len(c)) + 1
        later, strip = np.full(known + 1, n, np.int32), max(1, 2 * CELLS // max(known, width))
        for last in range(len(self.text), 0, -strip):
            first = max(0, last - strip)
            own, start, after, end = self.text[first:last], self.start[first:last], self.next[first:last], self.end[first:last]
            # where each trigram stands next, from the start of each block on: the least place is written last, and a few blocks at a time
            # stay in a processor's cache
            small = (end - start).max() < 65_535
            ahead = np.empty((known + 1, last - first), np.uint16 if small else np.int32)
            for b in range(last - first, 0, -NEAR):
                a = max(0, b - NEAR)
                near = np.full((known + 1, b - a), n, np.int32)
                near[:, -1] = later
                places = np.arange(start[a], after[b - 1], dtype=np.int32)[::-1]
                near.reshape(-1)[self.place[places] * np.int64(b - a) + np.repeat(np.arange(b - a), after[a:b] - start[a:b])[::-1]] = places
                np.minimum.accumulate(near[:, ::-1], axis=1, out=near[:, ::-1])
                later = near[:, 0].copy()
                near -= start[a:b].astype(np.int32)
                ahead[:, a:b] = np.minimum(near, 65_535) if small else near
            # where new ones arrive, from the next block's start on
            lengths = np.minimum(end - after, width)
            since = np.repeat(after.astype(np.int32), lengths)
            ramp = np.arange(len(since), dtype=np.int32) + np.repeat((after - np.cumsum(lengths) + lengths).astype(np.int32), lengths)
            new = np.flatnonzero(self.before[ramp] < since)
            offset = np.searchsorted(new, np.cumsum(lengths) - lengths)
            many, arrivals = np.diff(offset, append=len(new)), np.append(ramp[new], n)

            def ends(rows: np.ndarray | slice, most: np.ndarray, q: int) -> np.ndarray:
                d = self.distinct(most, sizes[q])
                return np.where(d < many[rows], arrivals[np.clip(offset[rows] + d, 0, len(arrivals) - 1)], end[rows]) - start[rows]  # noqa: B023

            mine = wanted[own]
            for q in np.flatnonzero(mine.any(axis=0)):
                table, most = ahead.take(columns[q], axis=0), held[own, q]
                inside = np.add.reduce((table < np.where(mine[:, q], ends(slice(None), most, q), 0).astype(ahead.dtype)).view(np.uint8), axis=0, dtype=np.uint8 if len(table) < 256 else np.int32)
                rows = np.flatnonzero(inside >= least[q])
                while len(rows) and (inside[rows] < most[rows]).any():
                    most = inside.copy()
                    inside[rows] = np.count_nonzero(table[:, rows] < ends(rows, most[rows], q), axis=0)
                    rows = rows[inside[rows] >= least[q]]
                if len(rows):
                    out.append((rows + first, np.full(len(rows), q), ends(rows, most[rows], q) + start[rows]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _best_share(before: np.ndarray, hit: np.ndarray, start: int, after: int, limit: int, size: int) -> float:
    """The greatest share |Q & E| / |Q | E| over runs E that start at a hit from start on, before ``after``, and end before limit; ``hit`` tells
    which places have one of the ``size`` trigrams of Q, ``before`` where a place's trigram stood last."""
    best, starts = 0.0, start + np.flatnonzero(hit[start:after])
    places = np.concatenate([np.arange(start, after), after + np.flatnonzero(before[after:limit] < after)])
    for i in range(0, len(starts), STRIP):
        begin = starts[i : i + STRIP, None]
        new = (before[places] < begin) & (places >= begin)
        hits = np.cumsum(new & hit[places], axis=1)
        best = max(best, float((hits / (size + np.cumsum(new, axis=1) - hits)).max()))
    return best


def _batches(texts: list[str], width: int) -> list[slice]:
    cuts, start, size = [], 0, 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t) > CHARACTERS or (i - start + 1) * width > CELLS):
            cuts.append(slice(start, i))
            start, size = i, 0
        size += len(t)
    return [*cuts, slice(start, len(texts))]


def _finder(known: np.ndarray, base: int) -> Callable[[np.ndarray], np.ndarray]:
    """The place of each of some trigrams among the known ones, sorted, and their number where it is none of them."""
    if base**3 <= 1 << 24:
        table = np.full(base**3, len(known), np.int32)
        table[known] = np.arange(len(known))
        return lambda found: table[found]

    def search(found: np.ndarray) -> np.ndarray:
        place = np.searchsorted(known, found)
        return np.where(known[np.minimum(place, len(known) - 1)] == found, place, len(known))

    return search


def meeting(floor: float, extents: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of texts (chunk_id, text) and queries (qid, question): the pairs (qid, chunk_id, held, trigram) whose text holds
    ``floor`` of the query's distinct trigrams at least, and how many; with ``extents`` only those of that word similarity, which is
    null without.

    Texts by trigrams times trigrams by queries counts what all pairs have in common; what passes is bounded by windows of few distinct
    trigrams, for all texts of a batch at once, and only the runs of windows that are left are measured.
    """

    def run(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        asked = [_padded(q) for q in queries["question"].to_pylist()]
        letters = _letters(asked)
        codes = [np.unique(_codes([q], letters)[0]) for q in asked]
        known = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]))
        columns, sizes = [np.searchsorted(known, c) for c in codes], np.array([len(c) for c in codes])
        least = np.maximum(1, np.ceil(sizes * floor - 1e-9))
        place_of = _finder(known, int(letters.max()) + 1)
        asks = np.zeros((len(known) + 1, len(codes)), np.float32)  # the last row is that of all other trigrams
        for i, c in enumerate(columns):
            asks[c, i] = 1
        sets: dict[int, np.ndarray] = {}
        texts, rows, by, counts, values = [_padded(t) for t in chunks["text"].to_pylist()], [], [], [], []
        for part in _batches(texts, len(known)) if len(known) and texts else []:
            found, owner = _codes(texts[part], letters)
            place = place_of(found)
            table = np.zeros((part.stop - part.start, len(known) + 1), np.float32)
            table[owner, place] = 1
            held = table @ asks
            met = held >= least
            if not extents:
                row, query = np.nonzero(met)
                rows, by, counts = [*rows, row + part.start], [*by, query], [*counts, held[row, query]]
                continue
            some = np.flatnonzero(met.any(axis=1))
            if not len(some):
                continue
            kept = met.any(axis=1)[owner]
            windows = _Windows(found[kept], place[kept], np.cumsum(np.bincount(owner, minlength=len(table))[some]), floor)
            block, query, limit = windows.open(held[some], sizes, least, columns)
            if not len(block):
                continue
            order = np.lexsort((block, query, windows.text[block]))
            block, query, limit = block[order], query[order], limit[order]
            pairs = windows.text[block] * len(codes) + query
            cuts, last = np.flatnonzero(np.diff(pairs, prepend=-1)), -1
            for a, b in zip(cuts, [*cuts[1:], len(pairs)], strict=True):
                r, q = int(some[windows.text[block[a]]]), int(query[a])
                if r != last:
                    order = _codes([texts[part][r]])[0]
                    before, last, shift = _before(order), r, int(windows.end[block[a]]) - len(order)
                hit = np.isin(order, sets[q] if q in sets else sets.setdefault(q, np.unique(_codes([asked[q]])[0])))
                value = max(_best_share(before, hit, windows.start[w] - shift, windows.next[w] - shift, end - shift, sizes[q]) for w, end in zip(block[a:b], limit[a:b], strict=True))
                if value > max(0.0, floor - 1e-9):
                    rows, by, counts, values = [*rows, [r + part.start]], [*by, [q]], [*counts, [held[r, q]]], [*values, value]
        flat = lambda parts, kind: pa.array(np.concatenate([np.zeros(0), *parts]).astype(kind))
        picked, askers = chunks.take(flat(rows, np.int64)), queries.take(flat(by, np.int64))
        shares = pa.array(np.array(values, np.float32)) if extents else pa.nulls(len(picked), pa.float32())
        return pa.table({"qid": askers["qid"], "chunk_id": picked["chunk_id"], "held": flat(counts, np.int32), "trigram": shares})

    return run


def common_run(left: list[str], right: list[str]) -> int:
    """Length of the longest run of tokens that both hold: one row of the table for each token of the shorter one."""
    short, long_ = sorted((left, right), key=len)
    names = {t: i for i, t in enumerate(dict.fromkeys(long_))}
    numbers = np.array([names[t] for t in long_], dtype=np.int64)
    row, best = np.zeros(len(long_) + 1, dtype=np.int64), 0
    for t in short:
        row[1:] = np.where(numbers == names.get(t, -1), row[:-1] + 1, 0)
        best = max(best, int(row.max(initial=0)))
    return best


def common_subsequence(left: list[str], right: list[str]) -> int:
    """Length of the longest common subsequence, by bits: a set bit is a place where the row doesn't grow."""
    where: dict[str, int] = {}
    for i, t in enumerate(right):
        where[t] = where.get(t, 0) | 1 << i
    full = (1 << len(right)) - 1
    row = full
    for t in left:
        match = row & where.get(t, 0)
        row = (row + match | row - match) & full
    return len(right) - row.bit_count()


@F.pandas_udf(T.StructType([T.StructField("run", T.IntegerType()), T.StructField("subsequence", T.IntegerType())]))
def verbatim(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Both measures of two arrays of tokens."""
    pairs = [(list(a) if a is not None else [], list(b) if b is not None else []) for a, b in zip(left, right, strict=True)]
    return pd.DataFrame({"run": [common_run(a, b) for a, b in pairs], "subsequence": [common_subsequence(a, b) for a, b in pairs]})
