"""The weekly digest: four tables, each one job for all roles."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skilldemand.operators.ingest import ROLES
from skilldemand.operators.trends import cooccurrence, emerging, similar_pairs, with_momentum


def weekly_digest(
    postings: DataFrame,
    processed: DataFrame,
    trends: DataFrame,
    roles: list[str] | None = None,
    rising_n: int = 5,
    emerging_n: int = 20,
    pairs_n: int = 5,
) -> dict[str, DataFrame]:
    named = ROLES if roles is None else roles
    of_roles = F.col("role_category").isin(named)
    return {
        "rising": with_momentum(trends.where(of_roles), None, rising_n).where("current_count > 0"),
        "emerging": emerging(trends).limit(emerging_n),
        "pairs": cooccurrence(postings.where(of_roles), processed, None, pairs_n, 2),
        "similar": similar_pairs(trends, named),
    }


def write_digest(digest: dict[str, DataFrame], path: str) -> None:
    """One Parquet table per section."""
    for name, df in digest.items():
        df.write.mode("overwrite").parquet(os.path.join(path, name))
