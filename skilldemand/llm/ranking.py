"""Exact ranks of rows in an order, without one task that sees a whole group.

Rows carry a hexadecimal digest whose first digits cut the order into ranges. Ranges are
counted, offsets are running sums over the counts of ranges, and rows are numbered within
their range alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PER_RANGE = 20_000  # rows that one range holds on average


def range_count(rows: int, per_range: int = PER_RANGE) -> int:
    return max(1, math.ceil(rows / per_range))


def seeded_digest(seed: int, *columns: Column) -> Column:
    """32 hexadecimal digits of a seed and some values; nulls count as an empty text."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))


def digest_fraction(digest: Column) -> Column:
    """A digest's first 13 digits as a number from 0 to below 1, exact in a double."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def group_name(column: Column) -> Column:
    """A text that is never null: nulls are one group, apart from every value."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def ranked(df: DataFrame, groups: list[str], bucket: str, order: list, rank: str, total: str) -> DataFrame:
    """Add ``rank``, from 1, of each row in its group, and ``total``, the group's rows.

    ``bucket`` is a whole number that does not decrease along the order; rows are numbered
    within a bucket. Group columns must not be null. Only counts of buckets meet by group.
    """
    keys = [*groups, bucket]
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    whole = Window.partitionBy(*groups)
    earlier = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *keys,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias(total),
    )
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    numbered = df.withColumn("_number", number).join(starts, keys)
    return numbered.withColumn(rank, F.col("_before") + F.col("_number")).drop("_before", "_number")
