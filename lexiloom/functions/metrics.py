"""Ranking metrics of one query: ``ranked`` is the array of ids in rank order, ``relevant`` an array of distinct ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hits(ranked: Column, relevant: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.slice(ranked, 1, k), relevant))


def recall_at(ranked: Column, relevant: Column, k: int) -> Column:
    """Share of the relevant ids among the first k; null if none is relevant."""
    return F.try_divide(_hits(ranked, relevant, k).cast("double"), F.size(relevant))


def precision_at(ranked: Column, relevant: Column, k: int) -> Column:
    """Hits among the first k, divided by k however short the list is."""
    return _hits(ranked, relevant, k) / F.lit(float(k))


def hit_rank(ranked: Column, relevant: Column, k: int) -> Column:
    """Position of the first relevant id among the first k, from 1; null on a miss."""
    places = F.transform(F.slice(ranked, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), i + 1))
    return F.array_min(places)


def reciprocal_rank(ranked: Column, relevant: Column, k: int) -> Column:
    return F.coalesce(1.0 / hit_rank(ranked, relevant, k), F.lit(0.0))


def _gain(place: Column) -> Column:
    return 1.0 / F.log2(place.cast("double") + 1.0)


def ndcg_at(ranked: Column, relevant: Column, k: int) -> Column:
    """Normalized discounted gain with gains 0 and 1; 0 if none is relevant."""
    gains = F.transform(F.slice(ranked, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), _gain(i + 1)).otherwise(0.0))
    total = F.aggregate(gains, F.lit(0.0), lambda a, x: a + x)
    best = F.least(F.size(relevant), F.lit(k))
    ideal = F.aggregate(F.when(best > 0, F.sequence(F.lit(1), best)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + _gain(i))
    return F.when(ideal > 0, total / ideal).otherwise(0.0)


def fused(weight: float, place: Column, damping: int = 60) -> Column:
    """One signal's part of a reciprocal-rank fusion; nothing where the signal has no rank."""
    return F.coalesce(F.lit(weight) / (damping + place), F.lit(0.0))
