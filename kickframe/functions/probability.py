"""Expressions on home/draw/away probability triples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]


def normalise(h: Column, d: Column, a: Column) -> Triple:
    """Scale to one; uniform when the total is not positive."""
    total = h + d + a
    third = F.lit(1.0) / F.lit(3.0)
    return tuple(F.when(total > 0, x / total).otherwise(third) for x in (h, d, a))


def blend(first: Triple, second: Triple, weight: float | Column) -> Triple:
    """Convex mix of two normalised triples, `weight` on the second."""
    w = F.lit(weight) if isinstance(weight, (int, float)) else weight
    a, b = normalise(*first), normalise(*second)
    return normalise(*[(F.lit(1.0) - w) * x + w * y for x, y in zip(a, b)])


def from_expected_score(expected_home: Column, draw_rate: float | Column) -> Triple:
    """Carve a fixed draw share out of an Elo expectation."""
    d = F.lit(draw_rate) if isinstance(draw_rate, (int, float)) else draw_rate
    rest = F.lit(1.0) - d
    return normalise(expected_home * rest, d, (F.lit(1.0) - expected_home) * rest)


def implied(odds: Column) -> Column:
    """1 / odds, zero for a missing or non-positive price."""
    return F.when(odds > 0, F.lit(1.0) / odds).otherwise(F.lit(0.0))


def implied_triple(h: Column, d: Column, a: Column) -> Triple:
    """Normalised implied probabilities; all zero when nothing is priced."""
    raw = [implied(x) for x in (h, d, a)]
    total = raw[0] + raw[1] + raw[2]
    return tuple(F.when(total > 0, x / total).otherwise(F.lit(0.0)) for x in raw)


def elo_expectation(home: Column, away: Column, advantage: float | Column) -> Column:
    adv = F.lit(advantage) if isinstance(advantage, (int, float)) else advantage
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (away - (home + adv)) / F.lit(400.0)))


def kelly(prob: Column, odds: Column, cap: float) -> Column:
    """Kelly stake clipped to [0, cap]; zero when the price pays nothing."""
    b = odds - 1
    raw = (b * prob - (F.lit(1.0) - prob)) / b
    return F.when(b <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(raw, F.lit(cap))))


def confidence_band(edge: Column, prob: Column) -> Column:
    return (
        F.when((edge >= 0.10) & (prob >= 0.50), "HIGH")
        .when((edge >= 0.05) & (prob >= 0.35), "MEDIUM")
        .otherwise("LOW")
    )


def favourite(h: Column, d: Column, a: Column) -> Column:
    """Most likely outcome; ties go home, draw, away."""
    return (
        F.when((h >= d) & (h >= a), "Home Win").when(d >= a, "Draw").otherwise("Away Win")
    )
