"""Proportional stratified interleaving: every shard has the mixture of the whole.

Rows of a source are shuffled by a seeded digest and ranked; row r of the n rows of a
source has the fractional rank (r - 1/2) / n. Sorted by it, any stretch of the whole holds
each source in proportion, so the shards are equal cuts of that order. Only DataFrame
functions are used. A source with a third of all rows is ranked in ranges of its digests,
the whole in ranges of the fraction, so no task sees a source or the order as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skilldemand.llm.ranking import (
    PER_RANGE,
    digest_fraction,
    group_name,
    range_count,
    ranked,
    seeded_digest,
)

WORK = ["_group", "_digest", "_bucket", "_rank", "_of", "_fraction", "_place", "_all"]


def interleaved_shards(
    df: DataFrame,
    shards: int = 8,
    source: str = "source",
    key: str = "doc_id",
    tiebreak: tuple[Column, ...] = (),
    seed: int = 0,
    per_range: int = PER_RANGE,
) -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` (int) and ``slot`` (long, from 0).

    The rows of any two shards differ by one at most. Rows with a null source are a source
    of their own; null keys count as an empty text. Rows of equal key are ordered by
    ``tiebreak``, so rows equal in these too may change places. Columns named shard, slot
    or like a working column are refused. An empty table gives an empty result.
    """
    clash = {c.lower() for c in df.columns} & {"shard", "slot", *WORK}
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    total = df.count()
    buckets = range_count(total, per_range)
    rows = df.withColumns(
        {"_group": group_name(F.col(source)), "_digest": seeded_digest(seed, F.col(key))}
    )
    rows = rows.withColumn("_bucket", F.floor(digest_fraction(F.col("_digest")) * buckets))
    shuffled = ["_digest", F.col(key).asc_nulls_first(), *tiebreak]
    rows = ranked(rows, ["_group"], "_bucket", shuffled, "_rank", "_of")
    rows = rows.withColumn("_fraction", (F.col("_rank") * 2 - 1) / (F.col("_of") * 2))
    rows = rows.withColumn("_bucket", F.floor(F.col("_fraction") * buckets))
    rows = ranked(rows, [], "_bucket", ["_fraction", "_group", "_rank"], "_place", "_all")
    shard = F.expr(f"((_place - 1) * {shards}) div _all").cast("int")
    start = F.expr(f"(shard * _all + {shards - 1}) div {shards}")
    rows = rows.withColumn("shard", shard).withColumn("slot", F.col("_place") - 1 - start)
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], "shard", "slot")
