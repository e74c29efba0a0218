"""Threshold bands as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sentiment_band(score: Column, pos: float = 0.15, neg: float = -0.05, strict: bool = False) -> Column:
    """positive / negative / neutral by two thresholds; ``strict`` leaves the bounds neutral."""
    above = score > pos if strict else score >= pos
    below = score < neg if strict else score <= neg
    return (
        F.when(score.isNull(), None)
        .when(above, "positive")
        .when(below, "negative")
        .otherwise("neutral")
    )


def confidence_band(label: Column, score: Column, threshold: float = 0.75) -> Column:
    """The classifier's label, neutral where it is not confident enough."""
    lowered = F.lower(label)
    return F.when(
        score >= threshold, F.when(lowered == "positive", "positive").otherwise("negative")
    ).otherwise("neutral")


def momentum(change: Column) -> Column:
    """Five-way band of a week-over-week change."""
    return (
        F.when(change > 20, "strong_up")
        .when(change > 5, "up")
        .when(change < -20, "strong_down")
        .when(change < -5, "down")
        .otherwise("flat")
    )


def momentum_badge(change: Column) -> Column:
    """Three-way band of a week-over-week change."""
    return F.when(change > 20, "rising").when(change < -10, "falling").otherwise("neutral")


def match_band(score: Column) -> Column:
    """Band of a skill-gap score."""
    return F.when(score >= 75, "strong").when(score >= 40, "partial").otherwise("low")


def staleness(last_seen: Column, now: Column) -> Column:
    """fresh below 8 h, ageing below 24 h, else stale; unknown for null."""
    hours = _seconds_between(last_seen, now) / 3600
    return (
        F.when(last_seen.isNull(), "unknown")
        .when(hours < 8, "fresh")
        .when(hours < 24, "ageing")
        .otherwise("stale")
    )


def age_text(seen: Column, now: Column) -> Column:
    """Relative age in words, null for null."""
    minutes = F.floor(_seconds_between(seen, now) / 60)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    return (
        F.when(seen.isNull(), None)
        .when(minutes < 1, "just now")
        .when(minutes < 60, _ago(minutes, "minute"))
        .when(hours < 24, _ago(hours, "hour"))
        .otherwise(_ago(days, "day"))
    )


def _ago(count: Column, unit: str) -> Column:
    plural = F.when(count == 1, unit).otherwise(unit + "s")
    return F.concat_ws(" ", count.cast("string"), plural, F.lit("ago"))


def _seconds_between(start: Column, end: Column) -> Column:
    return F.unix_micros(end.cast("timestamp")) / 1e6 - F.unix_micros(start.cast("timestamp")) / 1e6
