"""Licence scans by a trained paragraph classifier, in DataFrame functions only.

A paragraph (a line of text) is a sparse vector of its words and word pairs. A multinomial logistic regression over
these gives the probability of each licence family and of ``unknown``, the class of all other prose. It is fitted
on the driver to labelled paragraphs, some two thousand variants of a fixed list of templates and of sentences that only
sound alike, and calibrated by a temperature on a third of them that was left out. A paragraph whose most probable family
reaches ``LEAST`` is then compared with that family's templates: the share of a template's words that the paragraph has, in word
pairs, must reach ``CONFIRM``; only confirmed predictions count.

The features that are worth something to a family are few, and all other features only speak for ``unknown``; so
a paragraph that holds none of the families' telling words is unknown, and a text that holds none of them as a
substring isn't even split. That spares work and decides nothing: such paragraphs can't be confirmed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.shared import documents

UNKNOWN = "unknown"
#: Least probability of a family, and least share of a template's word pairs that the paragraph has.
LEAST, CONFIRM = 0.5, 0.6
#: Passes and step of the fit; weight decay; variants of each template that it is fitted to.
PASSES, STEP, DECAY, VARIANTS = 300, 4.0, 1e-5, 16

# How licence grants begin or are named in a text. {v} stands for a version.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ),
    "zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        "Released under the zlib License.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
    ),
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU AGPL v3.",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Released under the Eclipse Public License, version 2.0.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This work is licensed under the Apache License 2.0.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GNU GPL v3.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the GNU Lesser General Public License, version 3.",
        "Licensed under the GNU LGPL v3.",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License, version 2.0.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc0": (
        "Released under CC0 1.0.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced without permission.",
        "This software is proprietary and confidential. Unauthorized copying is prohibited.",
        "All rights reserved.",
        "Copyright (c). All rights reserved.",
    ),
}
# Sentences that share words with grants and grant nothing.
UNLIKE = (
    "She renewed her driver license at the office in town.",
    "The general public was invited to the work of the foundation.",
    "The fishing license fee rose to four dollars under the new rules.",
    "Version 2 of the report was released in the spring.",
    "He studied at MIT before he moved to work for the city.",
    "The Apache helicopter flew over the valley under low clouds.",
    "Permission to enter the building is granted at the front desk.",
    "The public library is open to all without charge.",
    "A copy of the letter was sent to the office with the terms of the sale.",
    "The software was released under great pressure in version 3.",
    "Commons debates are published with attribution to the speaker.",
    "All rights of way are reserved for walkers in the park.",
    "The terms of the contract were modified without notice.",
    "The of and to in is was that with by the.",
    "This work is a study of the sea and of the people by the sea.",
    "They were licensed to sell drinks under the arches.",
    "The eclipse was seen by the public from the terms office in town.",
    "The accompanying materials were made available to the program of the school.",
    "A notice of the sale shall be included in all copies of the paper.",
    "Anyone may use the park for any purpose, including commercial fairs.",
    "The town was released into the care of the public domain office.",
    "The rights to publish and sell copies of the book were merged.",
)

#: A word: a run of letters, digits, dots and hyphens that starts and ends with a letter or digit.
_WORD = r"[a-z0-9](?:[a-z0-9.\-]*[a-z0-9])?"
_JOIN = " "
#: A hyphen at the end of a line, what comments begin the next line with, and the rest of the word.
_CUT = r"([A-Za-z0-9]-)[\x20\t\r]*\n([^A-Za-z0-9\n]*)([A-Za-z0-9.\-]+)"


def words_of(text: str) -> list[str]:
    """Words in plain Python, for the fit; ``_words`` gives the same in Spark."""
    return re.findall(_WORD, text.translate({c: c + 32 for c in range(65, 91)}))


def features_of(text: str) -> set[str]:
    w = words_of(text)
    return {*w, *map(_JOIN.join, zip(w, w[1:]))}


def pairs_of(text: str) -> set[str]:
    w = words_of(text)
    return set(map(_JOIN.join, zip(w, w[1:])))


class Model:
    """Weights of the families for each feature, a bias for each family, and the temperature."""

    def __init__(self, families: list[str], weights: dict[str, list[float]], bias: list[float], temperature: float) -> None:
        self.families, self.weights, self.bias, self.temperature = families, weights, bias, temperature

    def scores(self, text: str) -> list[float]:
        features = features_of(text)
        scale, out = 1 / math.sqrt(len(features) or 1), list(self.bias)
        for f in features:
            for k, w in enumerate(self.weights.get(f, ())):
                out[k] += scale * w
        return out

    def probabilities(self, text: str) -> list[float]:
        return _softmax([s / self.temperature for s in self.scores(text)])


def _softmax(scores: list[float]) -> list[float]:
    top = max(scores)
    e = [math.exp(s - top) for s in scores]
    return [x / sum(e) for x in e]


def labelled_paragraphs(seed: int = 1) -> list[tuple[str, str]]:
    """(text, family) of the paragraphs that the model is fitted to, some VARIANTS of each template and of each look-alike.

    A template's variants are of its family: whole, without some words at either end, with a word changed, between words of
    prose; where a variant has too few of the template's word pairs to be confirmed it is unknown, as are scrambled
    templates, short pieces of them, and all that is made of look-alikes: themselves, their pieces, halves of two joined.
    """
    import random

    r = random.Random(seed)
    prose = sorted({w for t in UNLIKE for w in words_of(t)})
    some = lambda n: [r.choice(prose) for _ in range(n)]
    out = [(t, f) for f, ts in TEMPLATES.items() for t in ts] + [(t, UNKNOWN) for t in UNLIKE]
    for family, templates in TEMPLATES.items():
        for t in templates:
            own, pairs = words_of(t), pairs_of(t)
            for n in range(VARIANTS):
                w = own[r.randint(0, n % 3) : len(own) - r.randint(0, n % 3)]
                if n % 2:
                    at = r.randint(0, len(w))
                    w = w[:at] + some(r.randint(0, 1)) + w[at + r.randint(0, 1) :]
                text = _JOIN.join(some(r.randint(0, 4)) + w + some(r.randint(0, 4)))
                sure = bool(pairs) and len(pairs & pairs_of(text)) >= CONFIRM * len(pairs)
                out.append((text, family if sure else UNKNOWN))
            for _ in range(VARIANTS // 2):
                mixed = r.sample(own, len(own))
                if not pairs & pairs_of(_JOIN.join(mixed)) or len(pairs) > 6:
                    out.append((_JOIN.join(some(2) + mixed[: max(1, len(own) // 2)] + some(6)), UNKNOWN))
                piece = r.randint(0, len(own))
                out.append((_JOIN.join(some(4) + own[piece : piece + len(own) // 4] + some(8)), UNKNOWN))
    # what a template shares with one of another family: the stretches of it that come close to the other
    every = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    for family, t in every:
        for other, u in every:
            own, wanted = words_of(t), pairs_of(u)
            for at in range(len(own)) if other != family else ():
                for size in (len(words_of(u)), len(words_of(u)) * 5 // 4, len(words_of(u)) * 4 // 5):
                    text = _JOIN.join(own[at : at + size])
                    if len(wanted & pairs_of(text)) >= CONFIRM * len(wanted):
                        of = {f for f, v in every if text in _JOIN.join(words_of(v))}
                        out += [(text, family)] * 2 if of == {family} else [(text, UNKNOWN)] * VARIANTS
    for t in UNLIKE:
        for n in range(2 * VARIANTS):
            w, v = words_of(t), words_of(r.choice(UNLIKE))
            out.append((_JOIN.join(w[r.randint(0, 4) :] if n % 2 else w[: len(w) // 2] + v[len(v) // 2 :]), UNKNOWN))
    return out


def _matrix(texts: list[set[str]], names: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(texts), len(names)), dtype=np.float32)
    for i, features in enumerate(texts):
        x[i, [names[f] for f in features if f in names]] = 1 / math.sqrt(len(features) or 1)
    return x


def _chances(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit(x: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of least cross entropy, classes of equal weight, by steps with momentum and a decay of the weights."""
    weights, bias = np.zeros((x.shape[1], k), np.float32), np.zeros(k, np.float32)
    moved, tilted = np.zeros_like(weights), np.zeros_like(bias)
    wanted = np.eye(k, dtype=np.float32)[label]
    share = np.sqrt(len(label) / (k * np.maximum(1, np.bincount(label, minlength=k))))[label][:, None].astype(np.float32)
    for _ in range(PASSES):
        slope = (_chances(x @ weights + bias) - wanted) * share / len(label)
        moved = 0.9 * moved - STEP * (x.T @ slope + DECAY * weights)
        tilted = 0.9 * tilted - 0.1 * STEP * slope.sum(axis=0)
        weights, bias = weights + moved, bias + tilted
    return weights, bias


def calibration_error(chances: np.ndarray, label: np.ndarray, bins: int = 10) -> float:
    """How far the probabilities of the most probable classes are from the share that is right, on the average over bins."""
    top, right = chances.max(axis=1), chances.argmax(axis=1) == label
    of = np.minimum((top * bins).astype(int), bins - 1)
    return float(sum(abs(top[of == b].sum() - right[of == b].sum()) for b in range(bins)) / len(label))


@lru_cache
def held_out() -> tuple[float, float, float]:
    """(temperature, calibration error, share that is right) of a model that hasn't seen every third labelled paragraph, on these."""
    families = [*TEMPLATES, UNKNOWN]
    rows = labelled_paragraphs()
    features, label = [features_of(t) for t, _ in rows], np.array([families.index(f) for _, f in rows])
    x = _matrix(features, _names())
    rest = np.arange(len(rows)) % 3 == 0
    weights, bias = _fit(x[~rest], label[~rest], len(families))
    scores, truth = x[rest] @ weights + bias, label[rest]
    loss = lambda t: -float(np.log(_chances(scores / t)[np.arange(len(truth)), truth] + 1e-12).sum())
    temperature = min((2 ** (i / 8) for i in range(-24, 17)), key=loss)
    found = _chances(scores / temperature)
    return temperature, calibration_error(found, truth), float((found.argmax(axis=1) == truth).mean())


def _names() -> dict[str, int]:
    """The features that have weights: those of templates and look-alikes; all others only make a paragraph longer."""
    return {f: i for i, f in enumerate(sorted({f for t in [*UNLIKE, *(t for ts in TEMPLATES.values() for t in ts)] for f in features_of(t)}))}


@lru_cache
def trained() -> Model:
    """The model of all labelled paragraphs, with the temperature that ``held_out`` finds."""
    families, rows, names = [*TEMPLATES, UNKNOWN], labelled_paragraphs(), _names()
    label = np.array([families.index(f) for _, f in rows])
    weights, bias = _fit(_matrix([features_of(t) for t, _ in rows], names), label, len(families))
    rounded = {f: [round(float(w), 6) for w in weights[i]] for f, i in names.items()}
    return Model(families, rounded, [round(float(b), 6) for b in bias], held_out()[0])


@lru_cache
def anchors(confirm: float = CONFIRM) -> tuple[str, ...]:
    """Words of which every confirmed paragraph has one.

    A paragraph with the share ``confirm`` of a template's word pairs has one of any set of them that is more than the rest; for each
    template, words are taken until the pairs that hold one of them are more than that.
    """
    chosen: list[str] = []
    for template in sorted(t for ts in TEMPLATES.values() for t in ts):
        pairs = sorted(pairs_of(template))
        touched = lambda words: sum(any(w in p.split(_JOIN) for w in words) for p in pairs)  # noqa: E731, B023
        while touched(chosen) <= (1 - confirm) * len(pairs):
            rest = [w for w in words_of(template) if w not in chosen and len(w) > 2 and w not in _COMMON] or [w for w in words_of(template) if w not in chosen]
            if not rest:
                break
            chosen.append(max(rest, key=lambda w: (touched([*chosen, w]), len(w), w)))
    return tuple(sorted(chosen))


#: Too common in prose to be worth a look.
_COMMON = frozenset("the and for with that this under from without you may any are not was free can work all all use part terms software".split())


def _has_anchor(text: Column, confirm: float) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for a in anchors(confirm):
        found = found | F.contains(low, F.lit(a))
    return found


def _folded_words(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(_WORD), F.lit(0))


def _json(value: object) -> Column:
    import json

    return F.lit(json.dumps(value))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) in which value is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pairs(words: Column) -> Column:
    """A word and the next one, for each word but the last."""
    return F.filter(F.zip_with(words, F.slice(words, 2, 1_000_000_000), lambda a, b: F.concat(a, F.lit(_JOIN), b)), lambda x: x.isNotNull())


def _classified(units: Column) -> Column:
    """(at, pairs, family, probability) of each (at, words): the most probable family of the words."""
    model = trained()
    weights = F.from_json(_json({f: [round(w, 6) for w in ws] for f, ws in model.weights.items()}), "map<string,array<double>>")
    names = F.array(*[F.lit(f) for f in model.families])
    bias = F.array(*[F.lit(round(b, 6)) for b in model.bias])
    none = F.array(*[F.lit(0.0)] * len(model.families))

    paired = F.transform(units, lambda s: F.struct(s["at"].alias("at"), F.array_distinct(s["words"]).alias("words"), F.array_distinct(_pairs(s["words"])).alias("pairs")))
    summed = F.transform(
        paired,
        lambda s: F.struct(
            s["at"].alias("at"),
            s["pairs"].alias("pairs"),
            F.aggregate(F.concat(s["words"], s["pairs"]), none, lambda acc, f: F.zip_with(acc, F.coalesce(F.element_at(weights, f), none), lambda a, b: a + b)).alias("sums"),
            F.sqrt(F.greatest(F.size(s["words"]) + F.size(s["pairs"]), F.lit(1)).cast("double")).alias("root"),
        ),
    )
    scored = F.transform(summed, lambda s: F.struct(s["at"].alias("at"), s["pairs"].alias("pairs"), F.zip_with(bias, s["sums"], lambda b, x: (b + x / s["root"]) / model.temperature).alias("scores")))
    risen = F.transform(scored, lambda s: F.struct(s["at"].alias("at"), s["pairs"].alias("pairs"), F.transform(s["scores"], lambda x: F.exp(x - F.array_max(s["scores"]))).alias("exps")))
    return F.transform(
        risen,
        lambda s: F.struct(
            s["at"].alias("at"),
            s["pairs"].alias("pairs"),
            F.get(names, F.array_position(s["exps"], F.lit(1.0)).cast("int") - 1).alias("family"),
            (1.0 / F.aggregate(s["exps"], F.lit(0.0), lambda a, x: a + x)).alias("probability"),
        ),
    )


_FOUND = "array<struct<paragraph:int,family:string,probability:double,similarity:double>>"


def _by_lines(lines: Column, least: float, confirm: float) -> Column:
    """Lines that are a grant as a whole; lines are (paragraph, line)."""
    templates = F.from_json(_json({f: [sorted(pairs_of(t)) for t in ts] for f, ts in TEMPLATES.items()}), "map<string,array<array<string>>>")
    worded = F.transform(F.filter(lines, lambda s: _has_anchor(s["line"], confirm)), lambda s: F.struct(s["paragraph"].alias("at"), _folded_words(s["line"]).alias("words")))
    compared = F.transform(
        F.filter(_classified(worded), lambda s: (s["family"] != UNKNOWN) & (s["probability"] >= least)),
        lambda s: F.struct(
            s["at"].alias("paragraph"),
            s["family"].alias("family"),
            s["probability"].alias("probability"),
            F.array_max(F.transform(F.element_at(templates, s["family"]), lambda t: F.size(F.array_intersect(t, s["pairs"])) / F.size(t))).alias("similarity"),
        ),
    )
    return F.filter(compared, lambda s: s["similarity"] >= confirm).cast(_FOUND)


def _by_windows(lines: Column, whole: Column, least: float, confirm: float) -> Column:
    """Grants within a line or over the lines of a paragraph, which ends at a line without words.

    Around each pair of a template that holds an anchor, the words that have most of the template's pairs are taken, within
    the template's length and a quarter; these alone are classified. Of windows of a family that overlap or start in the
    same line the most similar one counts, and none in a line of ``whole``, what was found by lines.
    """
    every = sorted({p for ts in TEMPLATES.values() for t in ts for p in pairs_of(t)})
    anchored = [p for p in every if any(w in anchors(confirm) for w in p.split(_JOIN))]
    listed = [{"family": f, "pairs": sorted(pairs_of(t)), "size": len(pairs_of(t)), "span": (5 * len(words_of(t)) + 3) // 4} for f, ts in TEMPLATES.items() for t in ts]
    templates = F.from_json(_json(listed), "array<struct<family:string,pairs:array<string>,size:int,span:int>>")

    gap = F.array_repeat(F.lit(""), max(t["span"] for t in listed))
    tokens = F.flatten(
        F.transform(
            F.transform(lines, lambda s: F.struct(s["paragraph"].alias("line"), _folded_words(s["line"]).alias("words"))),
            # a line without words is as many empty words, which no template has, as no window can span
            lambda s: F.transform(F.when(F.size(s["words"]) > 0, s["words"]).otherwise(gap), lambda w: F.struct(s["line"].alias("line"), w.alias("word"))),
        )
    )

    def best(pairs: Column, pos: Column, t: Column) -> Column:
        """The window of the template about the pair at pos: (similarity, less for more words, first, last, family)."""
        low = F.greatest(pos - t["span"], F.lit(0))
        near = F.transform(F.slice(pairs, low + 1, 2 * t["span"] + 1), lambda p, i: F.struct((low + i).alias("pos"), p.alias("pair")))

        def window(matched: Column, start: Column) -> Column:
            inside = F.filter(matched, lambda x: (x["pos"] >= start) & (x["pos"] < start + t["span"]))
            return _let(
                inside,
                lambda m: F.struct(
                    (F.size(F.array_distinct(m["pair"])) / t["size"]).alias("similarity"),
                    (start - F.array_max(m["pos"])).alias("short"),
                    start.alias("first"),
                    F.array_max(m["pos"]).alias("last"),
                    t["family"].alias("family"),
                ),
            )

        matched = F.filter(near, lambda x: F.array_contains(t["pairs"], x["pair"]))
        return _let(matched, lambda m: F.array_max(F.transform(F.filter(m, lambda x: x["pos"] <= pos), lambda x: window(m, x["pos"]))))

    def searched(words: Column, at: Column, pairs: Column) -> Column:
        places = F.filter(F.transform(pairs, lambda p, i: F.struct(i.alias("pos"), p.alias("pair"))), lambda x: x["pair"].isin(anchored))
        opened = F.flatten(F.transform(places, lambda a: F.transform(F.filter(templates, lambda t: F.array_contains(t["pairs"], a["pair"])), lambda t: best(pairs, a["pos"], t))))
        likely = F.array_distinct(F.filter(opened, lambda c: c["similarity"] >= confirm))
        units = F.transform(likely, lambda c: F.struct(c.alias("at"), F.slice(words, c["first"] + 1, c["last"] - c["first"] + 2).alias("words")))
        sure = F.filter(_classified(units), lambda s: (s["family"] == s["at"]["family"]) & (s["probability"] >= least))
        kept = F.transform(
            sure,
            lambda s: F.struct(
                s["at"]["similarity"].alias("similarity"),
                s["probability"].alias("probability"),
                s["at"]["first"].alias("first"),
                s["at"]["last"].alias("last"),
                F.element_at(at, s["at"]["first"] + 1).alias("line"),
                F.element_at(at, s["at"]["last"] + 2).alias("to"),
                s["family"].alias("family"),
            ),
        )
        new = F.filter(kept, lambda s: ~F.exists(whole, lambda o: (o["family"] == s["family"]) & (o["paragraph"] >= s["line"]) & (o["paragraph"] <= s["to"])))
        ranked = F.sort_array(new, asc=False)
        clash = lambda x, y: (x["family"] == y["family"]) & ((x["line"] == y["line"]) | ((x["first"] <= y["last"] + 1) & (y["first"] <= x["last"] + 1)))
        none = F.slice(ranked, 1, 0)
        chosen = F.aggregate(ranked, none, lambda acc, s: F.when(F.exists(acc, lambda o: clash(o, s)), acc).otherwise(F.concat(acc, F.array(s))))
        return F.transform(chosen, lambda s: F.struct(s["line"].alias("paragraph"), s["family"].alias("family"), s["probability"].alias("probability"), s["similarity"].alias("similarity")))

    split = _let(tokens, lambda x: F.struct(x["word"].alias("words"), x["line"].alias("at")))
    return _let(split, lambda x: _let(_pairs(x["words"]), lambda p: searched(x["words"], x["at"], p))).cast(_FOUND)


def find_licences(df: DataFrame, text: str = "text", least: float = LEAST, confirm: float = CONFIRM) -> DataFrame:
    """df with ``licences``: paragraph (number of the line in which the grant starts), family, probability, similarity of each
    confirmed grant, in order: lines that are one as a whole, and windows of a line or of the lines of a paragraph.
    Null and empty texts have none. Other columns pass through; an old ``licences`` is replaced."""
    numbered = lambda t: F.transform(F.split(t, "\n"), lambda p, i: F.struct(i.alias("paragraph"), p.alias("line")))
    # a word that a line ends after a hyphen of is read as a part of that line
    joined = F.regexp_replace(F.col(f"`{text}`"), _CUT, "$1$3\n$2")
    found = _let(_by_lines(numbered(F.col(f"`{text}`")), least, confirm), lambda whole: F.sort_array(F.concat(whole, _by_windows(numbered(joined), whole, least, confirm))))
    empty = F.array().cast(_FOUND)
    return df.withColumn("licences", F.when(_has_anchor(F.coalesce(F.col(f"`{text}`"), F.lit("")), confirm), found).otherwise(empty))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of every document: how many paragraphs grant one, which families, and the surest one. A null or empty text
    has no paragraph and no licence; rows that repeat are rows; a null doc_id stays null."""
    found = find_licences(documents(spark, sf_dir).select("doc_id", "text"))
    best = F.array_max(F.transform("licences", lambda s: F.struct(s["probability"].alias("probability"), s["similarity"].alias("similarity"), s["family"].alias("family"))))
    return found.select(
        "doc_id",
        F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0).cast("long").alias("n_paragraphs"),
        F.size("licences").cast("long").alias("n_licences"),
        F.array_join(F.sort_array(F.array_distinct(F.col("licences.family"))), ",").alias("families"),
        F.array_join(F.transform("licences", lambda s: F.concat_ws(":", s["family"], s["paragraph"].cast("string"))), ",").alias("found"),
        best.alias("best"),
    ).select("doc_id", "n_paragraphs", "n_licences", "families", "found", F.coalesce(F.col("best.family"), F.lit(UNKNOWN)).alias("family"), F.coalesce(F.round("best.probability", 6), F.lit(0.0)).alias("probability"), F.coalesce(F.round("best.similarity", 6), F.lit(0.0)).alias("similarity"))
