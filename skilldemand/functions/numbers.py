"""Rounding and growth columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RISING_ABOVE = 20.0


def round_exact(value: Column, digits: int) -> Column:
    """Round the exact binary value of a double, ties to even.

    Spark's ``round`` and ``bround`` look at the shortest decimal text instead, so
    1/160 at four digits gives 0.0062 there and 0.0063 here. The product with
    ``2 * 10^digits`` is formed in two exact halves, which makes the comparison
    with the midpoint exact.
    """
    x = value.cast("double")
    scale = float(10**digits)
    below = F.floor(x * scale).cast("double")
    shifted = x * 134217729.0  # 2^27 + 1 splits a double into two short halves
    high = shifted - (shifted - x)
    low = x - high
    from_midpoint = (high * (2 * scale) - (below * 2 + 1)) + low * (2 * scale)
    nearest = (
        F.when(from_midpoint > 0, below + 1)
        .when(from_midpoint < 0, below)
        .otherwise(below + F.abs(below % 2))
    )
    return nearest / scale


def growth_pct(current: Column, previous: Column) -> Column:
    """Week-over-week change in percent; a missing or zero start counts as 100 (or 0)."""
    return F.when(
        F.coalesce(previous, F.lit(0)) == 0, F.when(current > 0, 100.0).otherwise(0.0)
    ).otherwise((current - previous) / previous * 100.0)


def safe_ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0.0 where the whole is zero."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def f_score(precision: Column, recall: Column) -> Column:
    """Harmonic mean, 0.0 where both are zero."""
    return F.when(precision + recall > 0, precision * 2 * recall / (precision + recall)).otherwise(
        0.0
    )
