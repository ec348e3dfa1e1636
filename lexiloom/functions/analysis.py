"""Text analysis for full-text ranking: tokens of a text by type, stop words of two languages, Portuguese stems, positions.

A text is cut into tokens: words, words with digits, hyphenated words with their parts, e-mail addresses, hosts, URLs with
host and path, file names, numbers and versions; tags, entities and protocols are seen and left out. Tokens are numbered
from 1. Words are lower-cased and unaccented, English and Portuguese stop words leave gaps in the numbers, and other words are
stemmed by the published Snowball algorithm for Portuguese; tokens of any other type stay, in lower case. The version is part of
an artifact's identity.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Collection, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANALYZER_VERSION = 2
LEXEMES = T.ArrayType(T.StructType([T.StructField("lexeme", T.StringType()), T.StructField("pos", T.IntegerType())]), False)

# Stop words of English and Portuguese, unaccented.
ENGLISH = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
PORTUGUESE = frozenset(
    (
        "de a o que e do da em um para com nao uma os no se na por mais as dos como mas ao ele das seu sua ou quando muito nos ja eu tambem so pelo pela ate isso ela entre depois sem mesmo aos seus quem nas me esse eles voce essa num nem suas meu as minha numa pelos elas qual nos lhe deles essas esses pelas este dele "
        "tu te voces vos lhes meus minhas teu tua teus tuas nosso nossa nossos nossas dela delas esta estes estas aquele aquela aqueles aquelas isto aquilo "
        "estou esta estamos estao estive esteve estivemos estiveram estava estavamos estavam estivera estiveramos esteja estejamos estejam estivesse estivessemos estivessem estiver estivermos estiverem "
        "hei ha havemos hao houve houvemos houveram houvera houveramos haja hajamos hajam houvesse houvessemos houvessem houver houvermos houverem houverei houvera houveremos houverao houveria houveriamos houveriam "
        "sou somos sao era eramos eram fui foi fomos foram fora foramos seja sejamos sejam fosse fossemos fossem for formos forem serei sera seremos serao seria seriamos seriam "
        "tenho tem temos tinha tinhamos tinham tive teve tivemos tiveram tivera tiveramos tenha tenhamos tenham tivesse tivessemos tivessem tiver tivermos tiverem terei tera teremos terao teria teriamos teriam "
        "ser ter havia haver"
    ).split()
)

_PART = r"[^\W_]*[^\W\d_][^\W_]*"
#: What a token can be at a place, the first that fits; numbers end where no letter goes on.
_TOKEN = re.compile(
    rf"""
    (?P<tag></?[A-Za-z!?][^<>]*>)
  | (?P<entity>&(?:[A-Za-z]+|\#[0-9]+|\#[xX][0-9A-Fa-f]+);)
  | (?P<email>[A-Za-z0-9](?:[A-Za-z0-9._+-]*[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{{2,}})
  | (?P<protocol>[A-Za-z]+://)
  | (?P<host>(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{{2,}}(?::[0-9]+)?)(?![^\W_])(?P<path>/[^\s<>"']*)?
  | (?P<file>(?:~?/|[A-Za-z0-9][A-Za-z0-9._-]*/)[A-Za-z0-9](?:[A-Za-z0-9._/-]*[A-Za-z0-9])?(?![^\W_]))
  | (?P<sfloat>[-+]?\d+(?:\.\d+)?[eE][-+]?\d+(?![^\W_]))
  | (?P<version>\d+\.\d+(?:\.\d+)+(?![^\W_]))
  | (?P<float>[-+]?\d+\.\d+(?![^\W_]))
  | (?P<int>[-+]\d+(?![^\W_]))
  | (?P<hword>{_PART}(?:-{_PART})+)
  | (?P<uint>\d+(?![^\W_]))
  | (?P<word>[^\W_]+)
    """,
    re.X,
)
#: Types whose tokens are words: they alone lose marks and stop words and are stemmed.
WORD_TYPES = frozenset({"asciiword", "word", "asciihword", "hword", "hword_asciipart", "hword_part"})
_VOWELS = frozenset("aeiou")

# Suffixes of the Snowball algorithm for Portuguese, in their unaccented forms where these exist.
_DELETE = "eza ezas ico ica icos icas ismo ismos ista istas oso osa osos osas amento amentos imento imentos adora ador adoras adores ante antes".split()
_VERB = (
    "ada ida ia aria eria iria ara era ira ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ar er ir as adas idas ias arias erias irias aras eras iras avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis areis ereis ireis ados idos amos emos imos armos ermos irmos aremos eremos iremos eu iu ou"
).split()


_VERBS = frozenset(_VERB)


def _after(word: str, start: int) -> int:
    """Where the region begins after the first non-vowel that follows a vowel, from start on."""
    for i in range(start, len(word) - 1):
        if word[i] in _VOWELS and word[i + 1] not in _VOWELS:
            return i + 2
    return len(word)


def _verb_region(word: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[1] not in _VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] in _VOWELS), len(word))
    if word[0] in _VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in _VOWELS), len(word))
    return 3


def _longest(word: str, suffixes: Collection[str], start: int = 0) -> str:
    """The longest of the suffixes, of 7 letters at most, that the word ends with from start on."""
    for i in range(max(start, len(word) - 7), len(word)):
        if word[i:] in suffixes:
            return word[i:]
    return ""


_STANDARD = {
    **dict.fromkeys(_DELETE, ("r2", "", ())),
    **dict.fromkeys(["logia", "logias"], ("r2", "log", ())),
    **dict.fromkeys(["amente"], ("r1", "", ("ativ", "iv", "os", "ic", "ad"))),
    **dict.fromkeys(["mente"], ("r2", "", ("ante", "avel"))),
    **dict.fromkeys(["idade", "idades"], ("r2", "", ("abil", "ic", "iv"))),
    **dict.fromkeys(["iva", "ivo", "ivas", "ivos"], ("r2", "", ("at",))),
    **dict.fromkeys(["ira", "iras"], ("rv", "ir", ())),
}


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The Portuguese stem of an unaccented lower-case word."""
    r1 = _after(word, 0)
    regions = {"r1": r1, "r2": _after(word, r1), "rv": _verb_region(word)}
    rv, before = regions["rv"], word

    suffix = _longest(word, _STANDARD)
    if suffix:
        region, instead, further = _STANDARD[suffix]
        rest = word[: len(word) - len(suffix)]
        if len(rest) >= regions[region] and (not suffix.startswith("ira") or rest.endswith("e")):
            word = rest + instead
            also = _longest(word, further)
            if also and len(word) - len(also) >= regions["r2"]:
                word = word[: len(word) - len(also)]
            elif also == "ativ" and len(word) - 2 >= regions["r2"]:
                word = word[:-2]
    if word == before:
        suffix = _longest(word, _VERBS, rv)
        if suffix:
            word = word[: len(word) - len(suffix)]
    if word != before:
        if word.endswith("ci") and len(word) - 1 >= rv:
            word = word[:-1]
    else:
        suffix = _longest(word, ("os", "a", "i", "o"), rv)
        word = word[: len(word) - len(suffix)]
    if word.endswith("e") and len(word) - 1 >= rv:
        word = word[:-1]
        if word.endswith(("gu", "ci")) and len(word) - 1 >= rv:
            word = word[:-1]
    return word


def unaccent(text: str) -> str:
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def _kind(word: str, ascii_: str, other: str, mixed: str) -> str:
    if any(c.isdigit() for c in word):
        return mixed
    return ascii_ if word.isascii() else other


def tokens_of(text: str) -> Iterator[tuple[str, str]]:
    """(type, token) of every token that has a place; a compound comes before its parts, a URL before its host and path."""
    for m in _TOKEN.finditer(text):
        kind, token = m.lastgroup, m.group()
        if kind in ("tag", "entity", "protocol"):
            continue
        if kind == "word":
            yield _kind(token, "asciiword", "word", "numword"), token
        elif kind == "hword":
            yield _kind(token, "asciihword", "hword", "numhword"), token
            for part in token.split("-"):
                yield _kind(part, "hword_asciipart", "hword_part", "hword_numpart"), part
        elif kind == "path":
            yield "url", token
            yield "host", m["host"]
            yield "url_path", m["path"]
        else:
            yield kind, token


def _numbered(text: str) -> tuple[list[tuple[str, int]], int]:
    """What ``analyzed`` gives, and the number of tokens."""
    bare = text.rstrip(".,;:!?")
    if bare.isalpha():  # letters alone are one word, whatever the lexer would try before
        word = unaccent(bare)
        return ([] if word in ENGLISH or word in PORTUGUESE else [(stem(word), 1)]), 1
    out, pos = [], 0
    for pos, (kind, token) in enumerate(tokens_of(text), 1):
        if kind not in WORD_TYPES:
            out.append((token.lower(), pos))
            continue
        word = unaccent(token)
        if word not in ENGLISH and word not in PORTUGUESE:
            out.append((stem(word), pos))
    return out, pos


def analyzed(text: str) -> list[tuple[str, int]]:
    """(lexeme, position) of every token that isn't a stop word."""
    return _numbered(text)[0]


#: Texts whose lexemes are Python objects at a time (what a batch has more is Arrow's), and characters of a piece that is remembered.
PIECE, REMEMBERED = 256, 64
_remembered = lru_cache(maxsize=200_000)(_numbered)


def _pieces(text: str) -> list[str]:
    """A text cut where no token goes on: at blanks, which only tags have within."""
    return [text] if "<" in text else text.split()


def _of_piece(piece: str) -> tuple[list[tuple[str, int]], int]:
    return _remembered(piece) if len(piece) <= REMEMBERED else _numbered(piece)


def occurrences(texts: list[str], places: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, position) of every token whose lexeme has a place, in order. A piece that comes again is analyzed once."""
    numbers: dict[str, int] = {}
    pieces = [_pieces(t) for t in texts]
    flat = np.array([numbers.setdefault(p, len(numbers)) for x in pieces for p in x], np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in pieces])
    sizes, counts, found, offsets = [], [], [], []
    for p in numbers:
        lexemes, n = _of_piece(p)
        own = [(places[x], pos) for x, pos in lexemes if x in places]
        sizes.append(n)
        counts.append(len(own))
        found += [x for x, _ in own]
        offsets += [pos for _, pos in own]
    sizes, counts, found, offsets = (np.array(x, np.int64) for x in (sizes, counts, found, offsets))
    if not len(flat):
        return owner, flat, flat
    ends = np.cumsum(sizes[flat])
    base = ends - sizes[flat]
    first = np.concatenate([[0], ends])[np.searchsorted(owner, np.arange(len(texts)))]  # tokens before each text
    many = counts[flat]
    which = np.arange(many.sum()) + np.repeat((np.cumsum(counts) - counts)[flat] - np.cumsum(many) + many, many)
    text = np.repeat(owner, many)
    return text, found[which], np.repeat(base, many) - first[text] + offsets[which]


def _lexemes(texts: list[str | None]) -> pa.Array:
    ends, lexemes, places = [0], [], []
    for t in texts:
        before = 0
        for piece in _pieces(t) if t else ():
            found, n = _of_piece(piece)
            for lexeme, pos in found:
                lexemes.append(lexeme)
                places.append(before + pos)
            before += n
        ends.append(len(lexemes))
    rows = pa.StructArray.from_arrays([pa.array(lexemes, pa.string()), pa.array(places, pa.int32())], ["lexeme", "pos"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


@F.arrow_udf(LEXEMES)
def analyze(texts: pa.Array) -> pa.Array:
    """Lexemes and positions of each text; null gives none."""
    return pa.concat_arrays([_lexemes(texts[i : i + PIECE].to_pylist()) for i in range(0, max(1, len(texts)), PIECE)])


def cover_density(positions: Column) -> Column:
    """Density of the covers of all lexemes: positions is, for each lexeme of the query, the array of its positions.

    A cover is a shortest run of positions with every lexeme; it adds a tenth, divided by one more than the number of
    positions in it that are not the query's. Of one lexeme every occurrence is a cover. No lexeme, or one without a
    position, has none. One sweep over the merged positions keeps each lexeme's last occurrence: when all have one, the
    earliest of them starts a cover, and is forgotten.
    """
    marked = F.transform(positions, lambda places, k: F.transform(places, lambda p: F.struct(p.cast("int").alias("p"), k.alias("k"))))
    none = F.lit(None).cast("struct<i:int,p:int>")
    start = F.struct(F.lit(0).alias("i"), F.array_repeat(none, F.size(positions)).alias("last"), F.lit(0.0).alias("total"))

    def step(acc: Column, x: Column) -> Column:
        here = F.transform(acc["last"], lambda old, k: F.when(k == x["k"], F.struct(acc["i"].alias("i"), x["p"].alias("p"))).otherwise(old))

        def closed(last: Column) -> Column:
            first = F.when(F.forall(last, lambda o: o.isNotNull()), F.array_min(last))
            strangers = x["p"] - first["p"] - (acc["i"] - first["i"])
            left = F.transform(last, lambda o: F.when(o["i"] == first["i"], none).otherwise(o))
            adds = F.when(first.isNotNull(), 0.1 / (1 + F.greatest(strangers, F.lit(0)))).otherwise(0.0)
            return F.struct((acc["i"] + 1).alias("i"), F.when(first.isNull(), last).otherwise(left).alias("last"), (acc["total"] + adds).alias("total"))

        return F.get(F.transform(F.array(here), closed), F.lit(0))

    swept = F.aggregate(F.array_sort(F.flatten(marked)), start, step, lambda acc: acc["total"])
    known = (F.size(positions) > 0) & F.forall(positions, lambda p: F.size(p) > 0)
    return F.when(known, swept).otherwise(0.0).cast("float")
