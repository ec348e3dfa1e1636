"""Secret scans through a trigram inverted index.

From each rule's regular expression follows a Boolean query over trigrams that every match must satisfy: a literal
of three or more characters needs all its trigrams, a sequence needs what its parts need, an alternation needs one
of its branches' queries, a part that may be absent needs nothing, and so do characters outside ASCII and letters that
match such. The index is built in segments (a batch of documents), in one pass over their bytes: for each trigram that
some query names, the sorted ordinals of the segment's documents that hold it, A-Z folded in both. Postings are intersected and united as the query says, and only the candidates meet the
rule's regular expression. A rule that needs no trigram (a run of hexadecimal digits) scans every document.

Segments are local to their task, so nothing is shuffled, and the query never decides what is found: it only
spares documents that can't match.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from re import _constants as _op
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.shared import documents, free_prefix
from lexiloom.llm.workers import blocks, release

# --- Boolean trigram queries ------------------------------------------------------------------------------------

#: ("all",) is satisfied by every document; ("tri", t) by those that hold t; ("and", ...) and ("or", ...) combine.
Query = tuple
ALL: Query = ("all",)


def _and(parts: Iterable[Query]) -> Query:
    flat: dict[Query, None] = {}
    for p in parts:
        for q in p[1:] if p[0] == "and" else (p,):
            if q != ALL:
                flat[q] = None
    return ALL if not flat else next(iter(flat)) if len(flat) == 1 else ("and", *flat)


def _or(parts: Iterable[Query]) -> Query:
    flat: dict[Query, None] = {}
    for p in parts:
        if p == ALL:
            return ALL
        for q in p[1:] if p[0] == "or" else (p,):
            flat[q] = None
    return next(iter(flat)) if len(flat) == 1 else ("or", *flat)


def _trigrams(literals: frozenset[str]) -> Query:
    """What a text holds that holds one of these strings."""
    return _or(_and(("tri", s[i : i + 3]) for i in range(len(s) - 2)) for s in sorted(literals))


#: Strings that a part can be are listed up to this many; beyond, the part counts as unknown.
_MOST = 64


def trigram_query(pattern: str) -> Query:
    """The query that every text with a match of the pattern satisfies, over trigrams of the folded text."""
    parsed = _parser.parse(pattern)
    exact, query = _needs(parsed, parsed.state.flags)
    return query if exact is None else _trigrams(exact)


Needs = tuple[frozenset[str] | None, Query]
_NOTHING: Needs = (None, ALL)
#: ASCII letters that match letters outside ASCII where case is ignored.
_WIDE = frozenset("iks")


def _letter(code: int, flags: int) -> str | None:
    """The folded character, or none where the index can't tell: outside ASCII, or a match of letters there."""
    c = chr(code).lower() if code < 128 else None
    return None if c in _WIDE and flags & re.IGNORECASE and not flags & re.ASCII else c


def _needs(items: Sequence, flags: int) -> Needs:
    """The strings that the items can match, if these are known and few, else None; and what any match needs."""
    run, parts, whole = frozenset([""]), [], True
    for kind, value in items:
        exact, query = _needs_one(kind, value, flags)
        if exact is not None and len(run) * len(exact) <= _MOST:
            run = frozenset(a + b for a in run for b in exact)
            continue
        whole = False
        parts += [_trigrams(run), query]
        run = frozenset([""]) if exact is None else exact
    return (run, ALL) if whole else (None, _and([*parts, _trigrams(run)]))


def _needs_one(kind: object, value: object, flags: int) -> Needs:
    if kind is _op.LITERAL or kind is _op.IN and all(k is _op.LITERAL for k, _ in value):
        letters = [_letter(v, flags) for v in ([value] if kind is _op.LITERAL else [v for _, v in value])]
        return _NOTHING if None in letters else (frozenset(letters), ALL)
    if kind is _op.AT:
        return frozenset([""]), ALL
    if kind is _op.SUBPATTERN:
        _, added, removed, inner = value
        return _needs(inner, (flags | added) & ~removed)
    if kind is _op.BRANCH:
        branches = [_needs(b, flags) for b in value[1]]
        if all(e is not None for e, _ in branches) and sum(len(e) for e, _ in branches) <= _MOST:
            return frozenset().union(*(e for e, _ in branches)), ALL
        return None, _or(q if e is None else _trigrams(e) for e, q in branches)
    if kind in (_op.MAX_REPEAT, _op.MIN_REPEAT):
        low, high, inner = value
        exact, query = _needs(inner, flags)
        if exact is not None and high == 1:
            return (exact if low else exact | {""}), ALL
        return None, ALL if not low else query if exact is None else _trigrams(exact)
    return _NOTHING


def named_trigrams(query: Query) -> set[str]:
    return {query[1]} if query[0] == "tri" else set().union(*map(named_trigrams, query[1:])) if len(query) > 1 else set()


# --- rules ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches of the pattern, of which those with group ``group`` of at
    least ``least`` characters count."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    query: Query = field(init=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "query", trigram_query(self.pattern))


def _either_case(words: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in words)


#: The base rules, in the order in which spans of equal start are listed.
BASE = (
    Rule("assign", f"({_either_case('password|passwd|secret|token|api_?key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]+", 24),
)
#: Further rules, listed after the base ones. Public formats of credentials.
FURTHER = (
    Rule("private_key", "-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("code_host", "(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]+", 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("payment", "[sr]k_live_[A-Za-z0-9]+", 24),
    Rule("map_key", "AIza[A-Za-z0-9_-]+", 39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("url_login", r"[a-z]+://[A-Za-z0-9._-]+:([^\x20\n@/:]+)@[A-Za-z0-9.-]+", 3, 1),
)
RULES = BASE + FURTHER

# --- index and scan ---------------------------------------------------------------------------------------------

Span = tuple[int, int, int]  # start, number of the rule, end


#: Bytes as the index has them: A-Z as a-z, and 0 for all that isn't ASCII.
_FOLDED = np.array([b + 32 if 65 <= b <= 90 else b if b < 128 else 0 for b in range(256)], dtype=np.int32)
#: Bytes of a segment that are looked through at once.
_SLICE = 4_000_000


class Segment:
    """The inverted index of a batch of texts over the trigrams that some query names: for each, the ascending ordinals of
    the texts that hold it, made in one pass over the texts' bytes however many trigrams there are."""

    def __init__(self, texts: Sequence[str], trigrams: Iterable[str]) -> None:
        self.size = len(texts)
        self.names = sorted(trigrams)
        number = np.full(1 << 21, -1, dtype=np.int32)
        for i, t in enumerate(self.names):
            number[self._code(*t.encode())] = i
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        found = [np.empty(0, np.int64)]
        for a in range(0, max(0, len(data) - 2), _SLICE):
            x = _FOLDED[data[a : a + _SLICE + 2]]
            hit = number[self._code(x[:-2], x[1:-1], x[2:])]
            at = np.flatnonzero(hit >= 0)
            owner = np.searchsorted(ends, a + at, "right")
            inside = a + at + 2 < ends[owner]
            found.append(np.unique(hit[at[inside]].astype(np.int64) * self.size + owner[inside]))
        pairs = np.unique(np.concatenate(found))
        bounds = np.searchsorted(pairs, np.arange(len(self.names) + 1) * self.size)
        self.postings = {t: pairs[bounds[i] : bounds[i + 1]] - i * self.size for i, t in enumerate(self.names)}

    @staticmethod
    def _code(a, b, c):
        return a << 14 | b << 7 | c

    def candidates(self, query: Query) -> np.ndarray:
        """Ordinals of the texts that satisfy the query, ascending."""
        kind, *parts = query
        if kind == "all":
            return np.arange(self.size)
        if kind == "tri":
            return self.postings[parts[0]]
        found = [self.candidates(p) for p in parts]
        if kind == "or":
            return np.unique(np.concatenate(found))
        found.sort(key=len)  # the shortest postings first
        left = found[0]
        for other in found[1:]:
            if not len(left):
                break
            left = left[np.isin(left, other, assume_unique=True)]
        return left


def scan(texts: Sequence[str], rules: Sequence[Rule] = RULES) -> list[list[Span]]:
    """The spans of each text, by start and then by rule; code points, end exclusive."""
    segment = Segment(texts, set().union(*(named_trigrams(r.query) for r in rules)))
    found: list[list[Span]] = [[] for _ in texts]
    for n, rule in enumerate(rules):
        matcher = re.compile(_scanned(rule))
        for i in segment.candidates(rule.query).tolist():
            for m in matcher.finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[i].append((m.start(), n, m.end()))
    for spans in found:
        spans.sort()
    return found


def _scanned(rule: Rule) -> str:
    """The pattern to run. A pattern that is one repeated class has maximal runs as its matches: short ones need not
    be visited."""
    whole = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    return f"{whole[1]}{{{rule.least},}}" if whole and rule.group == 0 and rule.least > 1 else rule.pattern


#: Texts of a segment: so many rows, or fewer when they are long.
SEGMENT_ROWS, SEGMENT_CHARS = 2_000, 8_000_000


def segments(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows that form a segment."""
    return blocks([len(t) for t in texts], SEGMENT_CHARS, SEGMENT_ROWS)


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_secrets(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """df with ``secrets``: the spans (kind, start, end) of each row's text, by start and then in the order of rules.

    A null or empty text has no spans. The other columns pass through as they are, or those that ``carry`` names; one named
    ``secrets`` is replaced.
    """
    kept = [f for f in df.schema.fields if f.name != "secrets" and (carry is None or f.name in carry)]
    names, rules = [f.name for f in kept], tuple(rules)
    source = free_prefix(names, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, form = pa.array([r.kind for r in rules]), pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            texts = pc.fill_null(batch.column(source), "").to_pylist()
            for a, b in segments(texts):
                found = scan(texts[a:b], rules)
                flat = np.array([s for spans in found for s in spans], dtype=np.int64).reshape(-1, 3)
                spans = pa.StructArray.from_arrays([kinds.take(pa.array(flat[:, 1])), pa.array(flat[:, 0]), pa.array(flat[:, 2])], fields=list(form))
                ends = pa.array(np.append(0, np.cumsum([len(x) for x in found])), pa.int32())
                columns = batch.slice(a, b - a).select(names).columns
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, spans)], [*names, "secrets"])
        release()

    named = [F.col(f"`{n}`") for n in names]
    return df.select(*named, F.col(f"`{text}`").cast("string").alias(source)).mapInArrow(run, T.StructType([*kept, T.StructField("secrets", _SPANS)]))


def redacted(text: str, spans: Sequence[Span], rules: Sequence[Rule]) -> str:
    """The text with each span as ``<kind>``; of spans that overlap, the union goes under the first's kind."""
    out, at = [], 0
    for start, n, end in spans:
        if start >= at:
            out += [text[at:start], f"<{rules[n].kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """df with every secret in ``text`` replaced by ``<kind>``; of spans that overlap, the union goes under the first's
    kind. Null texts stay null; ``n_chars``, where there is one, follows a text that changes. All other columns pass
    through as they are, and no row goes."""
    rules = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in segments(pc.fill_null(whole.column("text"), "").to_pylist()):
                batch = whole.slice(a, b - a)
                texts = pc.fill_null(batch.column("text"), "").to_pylist()
                found = scan(texts, rules)
                if any(found):
                    changed = pa.array([bool(x) for x in found])
                    clean = [redacted(t, spans, rules) if spans else None for t, spans in zip(texts, found, strict=True)]
                    batch = _with(batch, "text", pc.if_else(changed, pa.array(clean, pa.string()), batch.column("text")))
                    if "n_chars" in batch.schema.names:
                        old = batch.column("n_chars")
                        sizes = pa.array([None if c is None else len(c) for c in clean], pa.int64()).cast(old.type)
                        batch = _with(batch, "n_chars", pc.if_else(changed, sizes, old))
                yield batch
        release()

    return df.mapInArrow(run, df.schema)


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return batch.set_column(batch.schema.names.index(name), pa.field(name, column.type), column)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans, for every document. A null or empty text has none;
    rows that repeat are rows; a null doc_id stays null."""
    base = [r.kind for r in BASE]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: lambda k: k == kind
    found = find_secrets(documents(spark, sf_dir), carry=["doc_id"])
    return found.select(
        "doc_id",
        *[F.size(F.filter(F.col("secrets.kind"), of(k))).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(listed(F.filter("secrets", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )
