"""The weekly (skill, role, week) aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skilldemand.functions.dates import week_start
from skilldemand.functions.numbers import round_exact, safe_ratio

KEY = ["skill", "role_category", "week_start"]
SLOT = ["role_category", "week_start"]


def _slots(postings: DataFrame) -> DataFrame:
    return postings.select("posting_id", "role_category", week_start(F.col("scraped_at")).alias("week_start"))


def skill_mentions(postings: DataFrame, processed: DataFrame) -> DataFrame:
    """Postings that mention a skill, per role and week; a posting counts once per skill."""
    skills = processed.select(
        "posting_id", F.explode(F.array_compact(F.array_distinct("skills_extracted"))).alias("skill")
    )
    return (
        _slots(postings)
        .join(skills, "posting_id")
        .groupBy(*KEY)
        .agg(F.count("*").alias("mention_count"))
    )


def weekly_totals(postings: DataFrame) -> DataFrame:
    """All postings per role and week, processed or not."""
    return _slots(postings).groupBy(*SLOT).agg(F.count("*").alias("total_postings"))


def build_trends(postings: DataFrame, processed: DataFrame) -> DataFrame:
    """Mentions and their share of all postings of the role and week.

    One pass: every posting yields a row per skill plus a row without a skill, whose
    count is the weekly total. What reaches the second shuffle is already one row
    per skill, role and week.
    """
    lists = processed.select(
        "posting_id", F.array_compact(F.array_distinct("skills_extracted")).alias("skills")
    )
    with_total = F.array_append(
        F.coalesce("skills", F.array().cast("array<string>")), F.lit(None).cast("string")
    )
    counts = (
        _slots(postings)
        .join(lists, "posting_id", "left")
        .select(*SLOT, F.explode(with_total).alias("skill"))
        .groupBy(*KEY)
        .agg(F.count("*").alias("mention_count"))
    )
    total = F.max(F.when(F.col("skill").isNull(), F.col("mention_count"))).over(Window.partitionBy(*SLOT))
    return (
        counts.withColumn("_total", total)
        .where("skill is not null")
        .select(*KEY, "mention_count", _pct("mention_count", "_total"))
    )


def _pct(count: str, total: str):
    return round_exact(safe_ratio(F.col(count), F.col(total)), 4).alias("pct_of_postings")


def merge_trends(stored: DataFrame, delta: DataFrame, totals: DataFrame) -> DataFrame:
    """Add the counts of newly processed postings to the stored rows.

    ``delta`` has mention counts per key, ``totals`` the postings of each role and week.
    The share is recomputed for every row of a role and week that ``totals`` covers,
    also for skills the delta does not mention; other rows keep theirs.
    """
    counts = (
        stored.select(*KEY, "mention_count", "pct_of_postings")
        .unionByName(
            delta.select(*KEY, "mention_count", F.lit(None).cast("double").alias("pct_of_postings"))
        )
        .groupBy(*KEY)
        .agg(F.sum("mention_count").alias("mention_count"), F.max("pct_of_postings").alias("_stored_pct"))
    )
    joined = counts.join(totals.select(*SLOT, "total_postings"), SLOT, "left")
    fresh = round_exact(safe_ratio(F.col("mention_count"), F.col("total_postings")), 4)
    return joined.select(
        *KEY,
        "mention_count",
        F.when(F.col("total_postings").isNotNull(), fresh)
        .otherwise(F.coalesce("_stored_pct", F.lit(0.0)))
        .alias("pct_of_postings"),
    )
