"""The stored tables and the CSV exports."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skilldemand.operators.trends import skill_gap, trending
from skilldemand.operators.weekly import merge_trends
from skilldemand.functions.numbers import round_exact
from skilldemand.schemas import TRENDS
from skilldemand.sources.ledger import WeeklyTable, weeks_of

# Trends are held by week behind a ledger of runs: the newest week, a range of weeks and the
# weeks an upsert touches each read or rewrite only their own folders.
WEEKLY = {"trends": TRENDS}


def table_path(base: str, table: str) -> str:
    return f"{base.rstrip('/')}/{table}"


def weekly_table(spark: SparkSession, base: str, table: str = "trends") -> WeeklyTable:
    return WeeklyTable(spark, table_path(base, table), WEEKLY[table])


def write_table(df: DataFrame, base: str, table: str, mode: str = "append", run: str | None = None) -> None:
    """Write to a table; ``overwrite`` of a weekly table replaces the given weeks only.

    A weekly table ignores a ``run`` that it has finished before.
    """
    if table not in WEEKLY:
        df.write.mode(mode).parquet(table_path(base, table))
        return
    weekly, weeks = weekly_table(df.sparkSession, base, table), weeks_of(df)
    rows = df.select(*WEEKLY[table].names)
    if mode == "append":
        rows = weekly.read(weeks).unionByName(rows)
    weekly.replace(rows, weeks, run or uuid.uuid4().hex)


def read_table(spark: SparkSession, base: str, table: str, weeks: list[dt.date] | None = None) -> DataFrame:
    """The rows of a table; of a weekly one, ``weeks`` reads the folders of some weeks only."""
    if table in WEEKLY:
        return weekly_table(spark, base, table).read(weeks)
    return spark.read.parquet(table_path(base, table))


def save_bucketed(df: DataFrame, name: str, buckets: int, key: str = "posting_id") -> None:
    """A catalog table bucketed by key.

    Postings and their enrichment bucketed alike join without a shuffle.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def upsert_trends(
    spark: SparkSession, base: str, delta: DataFrame, totals: DataFrame, run: str | None = None
) -> None:
    """Merge new counts into the stored trends; only the weeks they touch are read and written.

    ``run`` names the counts: merging the same run again changes nothing, whether it was
    finished or lost on the way.
    """
    weekly = weekly_table(spark, base)
    if run is not None and weekly.committed(run):
        return
    weeks = weeks_of(delta, totals)
    weekly.replace(merge_trends(weekly.read(weeks), delta, totals), weeks, run or uuid.uuid4().hex)


TRENDING_COLUMNS = [
    "skill",
    "role_category",
    "week_start",
    "mention_count",
    "pct_of_postings",
    "wow_change",
]
GAP_COLUMNS = ["skill", "status", "demand_pct", "role_category"]


def trending_export(trends: DataFrame, role: str | None = None) -> DataFrame:
    return trending(trends, role).select(
        *[
            round_exact(F.col(c), 4).alias(c) if c == "pct_of_postings" else F.col(c)
            for c in TRENDING_COLUMNS
        ]
    )


def gap_export(trends: DataFrame, role: str, user_skills: list[str], top_n: int = 30) -> DataFrame:
    return skill_gap(trends, role, user_skills, top_n).select(*GAP_COLUMNS)


def export_trending(trends: DataFrame, path: str, role: str | None = None) -> None:
    """Trending skills as CSV with a header, also if there are none."""
    trending_export(trends, role).write.mode("overwrite").csv(path, header=True)


def export_gap(
    trends: DataFrame, role: str, user_skills: list[str], path: str, top_n: int = 30
) -> None:
    """A skill gap as CSV with a header: matched, missing, bonus."""
    gap_export(trends, role, user_skills, top_n).write.mode("overwrite").csv(path, header=True)
