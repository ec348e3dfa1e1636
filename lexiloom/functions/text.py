"""Text columns: folding, normal forms, tokens, numbers, keys. All but the two ``_exact`` functions stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Latin letters with marks, and the letters under them.
_MARKED = "áàâãäåāăąçćčďđéèêëēėęěğíìîïīįłñńňóòôõöøōőřśšşťúùûüūůűųýÿźżž"
_PLAIN = "aaaaaaaaacccddeeeeeeeegiiiiiilnnnoooooooorssstuuuuuuuuyyzzz"
_NUMBER = r"\d+(?:[.,]\d+)?"


def fold(text: Column) -> Column:
    """Lower case without the marks of Latin letters; composed letters only. ``fold_exact`` knows all of Unicode."""
    return F.translate(F.lower(text), _MARKED, _PLAIN)


#: Hangul syllables decompose by arithmetic into letters of three rows.
_HANGUL, _LEADS, _VOWELS_, _TAILS = 0xAC00, *("".join(chr(start + i) for i in range(n)) for start, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))


@lru_cache
def _fold_tables() -> tuple[str, str, str, list[str]]:
    """Of all characters but Hangul syllables, by case folding and canonical decomposition: those that fold to another one, what these
    fold to (shorter by those that fold to nothing), those that fold to several, and what these fold to."""
    one, to, gone, many, parts = [], [], [], [], []
    for code in range(0x110000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or _HANGUL <= code < _HANGUL + 19 * 588:
            continue
        folded = "".join(x for x in unicodedata.normalize("NFD", c.casefold()) if not unicodedata.combining(x))
        if len(folded) > 1:
            many.append(c)
            parts.append(folded)
        elif not folded:
            gone.append(c)
        elif folded != c:
            one.append(c)
            to.append(folded)
    return "".join(one + gone), "".join(to), "".join(many), parts


def fold_full(text: Column) -> Column:
    """What ``fold_exact`` gives, for all of Unicode, in the JVM: a text of ASCII alone is lower-cased; in others characters that
    fold to one or to none are translated together; a text that has others is taken apart, and only then."""
    source, target, many, parts = _fold_tables()
    listed = F.array(*[F.lit(p) for p in parts])
    code = lambda c: F.ascii(c) - _HANGUL
    letter = lambda row, i: F.substring(F.lit(row), i + 1, F.lit(1))
    at = lambda n: F.floor(n).cast("int")
    jamo = lambda c: F.concat(letter(_LEADS, at(code(c) / 588)), letter(_VOWELS_, at(code(c) % 588 / 28)), F.when(code(c) % 28 > 0, letter(_TAILS, at(code(c) % 28 - 1))).otherwise(""))
    syllable = lambda c: code(c).between(0, 19 * 588 - 1)
    apart = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c: F.when(c == "", c).when(syllable(c), jamo(c)).when(F.contains(F.lit(many), c), F.get(listed, F.instr(F.lit(many), c) - 1)).otherwise(c)), "")
    swapped = F.translate(text, source, target)
    escaped = "".join(f"\\x{{{ord(c):x}}}" for c in many)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).when(swapped.rlike(rf"[\x{{ac00}}-\x{{d7a3}}{escaped}]"), apart(swapped)).otherwise(swapped)


@F.pandas_udf(T.StringType())
def fold_exact(texts: pd.Series) -> pd.Series:
    """Case-folded, decomposed, without combining marks; null stays null."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        if t.isascii():
            return t.lower()
        return "".join(c for c in unicodedata.normalize("NFD", t.casefold()) if not unicodedata.combining(c))

    return texts.map(one, na_action="ignore")


def normalize_question(text: Column) -> Column:
    """Lower case, white space collapsed to single blanks, none at the ends; accents stay. Composed letters only;
    ``normalize_question_exact`` composes and folds all of Unicode."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\x{85}\x{A0}]+", " "))


@F.pandas_udf(T.StringType())
def normalize_question_exact(texts: pd.Series) -> pd.Series:
    """Composed (NFC), case-folded, white space collapsed; null stays null."""
    return texts.map(lambda t: " ".join(unicodedata.normalize("NFC", t).casefold().split()), na_action="ignore")


def tokens(text: Column) -> Column:
    """Folded words between white space; punctuation stays attached."""
    return F.filter(F.split(fold(text), r"\s+"), lambda w: w != "")


def numbers(text: Column) -> Column:
    """All numbers of a text as doubles, a comma counting as the decimal point."""
    return F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit(".")).cast("double"))


def value_matches(expected: Column, text: Column, tolerance: Column) -> Column:
    """Whether the text holds the expected value: with a tolerance, a number within it; without, the folded string. A
    tolerance on what is no number as a whole (digits, and digits after a point or comma) is an error."""
    digits = F.regexp_extract(expected, rf"^\s*({_NUMBER})\s*$", 1)
    wanted = F.when(digits != "", F.replace(digits, F.lit(","), F.lit(".")).cast("double"))
    near = F.when(wanted.isNull() & expected.isNotNull(), F.raise_error(F.concat(F.lit("a tolerance needs a number, not "), expected)).cast("boolean")).otherwise(F.exists(numbers(text), lambda n: F.abs(n - wanted) <= tolerance))
    return F.when(tolerance.isNotNull(), F.coalesce(near, F.lit(False))).otherwise(F.contains(fold(text), fold(expected)))


def cache_key(question: Column, **axes: Column) -> Column:
    """sha256 of a canonical JSON object of the normalized question and every other axis; nulls stay in it as null."""
    fields = {**axes, "question": normalize_question(question)}
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def utc_day(moment: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd")


def client_address(forwarded: Column, peer: Column, trusted: bool) -> Column:
    """The last entry of X-Forwarded-For if it is trusted and has one, else the peer, else ``unknown``."""
    entries = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    last = F.when(F.size(entries) > 0, F.element_at(entries, -1)) if trusted else F.lit(None).cast("string")
    return F.coalesce(last, peer, F.lit("unknown"))


def detect_terms(text: Column, vocabulary: list[str]) -> Column:
    """Which terms of the vocabulary a text uses, whole words of the folded text, in vocabulary order, each once.

    Of terms that overlap in the text, the longest counts.
    """
    import re

    plain = str.maketrans(_MARKED, _PLAIN)
    folded = [v.lower().translate(plain) for v in vocabulary]
    longest = sorted(set(folded), key=lambda v: (-len(v), v))
    escaped = "|".join(re.sub(r"([^a-z0-9 ])", r"\\\1", v) for v in longest)
    found = F.regexp_extract_all(fold(text), F.lit(rf"\b(?:{escaped})\b"), F.lit(0))
    order = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(v).alias("v")) for f, v in zip(folded, vocabulary, strict=True)])
    return F.transform(F.filter(order, lambda t: F.array_contains(found, t["f"])), lambda t: t["v"])
