"""Pages of an ordered table, however deep.

Rows are counted by ranges of the order first. A running sum over the ranges tells which of
them a page lies in, and only their rows are ordered, range by range. So no task gets all
rows up to the page, and the last page costs what the first one does. Everything is
one plan; nothing is counted while it is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGE_SIZE = 100  # fixed value: the most rows of a page


def check_page(page: int, page_size: int) -> None:
    if page < 1 or not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page must be 1 or more, page_size 1 to {MAX_PAGE_SIZE}: {page}, {page_size}")


def _pages(total: Column, page_size: int) -> Column:
    return F.greatest(F.ceil(total / F.lit(page_size)), F.lit(1)).cast("int")


def envelope(df: DataFrame, page: int, page_size: int, last_if_past: bool = False) -> DataFrame:
    """One row about a page; with ``last_if_past``, a page past the end counts as the last one."""
    total = df.agg(F.count("*").alias("total_count"))
    pages = total.select("total_count", _pages(F.col("total_count"), page_size).alias("total_pages"))
    at = F.least(F.lit(page), F.col("total_pages")) if last_if_past else F.lit(page)
    return pages.select(
        at.alias("page"),
        F.lit(page_size).alias("page_size"),
        "total_count",
        "total_pages",
        (at < F.col("total_pages")).alias("has_next"),
        (at > 1).alias("has_prev"),
    )


def page_rows(
    df: DataFrame, ranges: list[tuple[Column, bool]], order: list[Column], page: int, page_size: int, last_if_past: bool = False
) -> DataFrame:
    """The rows of a page of ``df`` under ``order``.

    ``ranges`` are coarse values of the order, each with True if it falls; rows that come
    earlier must never have later ranges, and nulls come last. There should be far fewer
    ranges than rows: the running sum over them is one task.
    """
    names = [f"_range{i}" for i in range(len(ranges))]
    keyed = df.withColumns({n: c for n, (c, _) in zip(names, ranges)})
    counts = keyed.groupBy(*names).agg(F.count("*").alias("_rows"))
    along = [F.desc_nulls_last(n) if falls else F.asc_nulls_last(n) for n, (_, falls) in zip(names, ranges)]
    earlier = Window.orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
    at = F.lit(page)
    if last_if_past:
        at = F.least(at, _pages(df.agg(F.count("*")).scalar(), page_size))
    low = (at.cast("long") - 1) * page_size
    held = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    held = held.where((F.col("_before") < low + page_size) & (F.col("_before") + F.col("_rows") > low))
    held = held.select(F.struct(*names).alias("_at"), "_before")
    rows = keyed.withColumn("_range", F.struct(*names)).join(held, F.col("_range").eqNullSafe(F.col("_at")))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_at").orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place").between(low + 1, low + page_size)).select(*df.columns)
