"""Connected components of a table of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skilldemand.llm.common import stage


def connected_components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Smallest reachable id of every id that a link names: ``(id, component)``.

    ``links`` has the columns ``a`` and ``b``. Alternates the two steps of the star
    algorithm: every vertex's larger neighbours are hung on its smallest neighbour, then
    its smaller ones are. Both keep components as they are, and no vertex ever collects
    its neighbours: they stay rows. Each round is written to the shared folder; it ends
    when a round changes nothing. Null ends and loops are ignored; no links, no rows.
    The joins are merge joins by hint: files of ids are a fraction of the ids in memory,
    and a broadcast of them goes through the driver.
    """
    edges = stage(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "cc",
    )
    mark = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        edges = stage(small.distinct(), "cc")
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("id")).distinct()
    return (
        edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        .unionByName(roots.select("id", F.col("id").alias("component")))
        .groupBy("id")
        .agg(F.min("component").alias("component"))
    )
