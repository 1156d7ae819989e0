"""Score arithmetic of search and fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_decay(rank: Column) -> Column:
    """exp(-0.3 |rank|): the tool profile's normaliser of a text rank."""
    return F.exp(F.lit(-0.3) * F.abs(rank))


def rank_reciprocal(rank: Column) -> Column:
    """1 / (1 + |rank|) within 0..1: the HTTP profile's normaliser."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) / (F.lit(1.0) + F.abs(rank))))


def rank_monotone(rank: Column) -> Column:
    """|rank| / (1 + |rank|): grows with the quality of the match, unlike the two profiles' normalisers."""
    return F.abs(rank) / (F.lit(1.0) + F.abs(rank))


def distance_similarity(d: Column, profile: str) -> Column:
    """Similarity of a vector distance: 'tool' 1 - d, 'http' 1 / (1 + d / 100), 'similar' max(0, 1 - d / 2)."""
    return {"tool": F.lit(1.0) - d, "http": F.lit(1.0) / (F.lit(1.0) + d / 100.0), "similar": F.greatest(F.lit(0.0), F.lit(1.0) - d / 2.0)}[profile]


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_literal(a: Column, query: list[float]) -> Column:
    """Inner product with a fixed vector of any length, one literal array: for a row or two; many rows are better served by a matrix product."""
    return dot(a, F.lit([float(q) for q in query]))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, null for an empty whole."""
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)))
