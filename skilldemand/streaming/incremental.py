"""Incremental runs over arriving files with Structured Streaming.

Every sink writes the folder ``batch_id=N`` of its table and overwrites it when a batch is
repeated, so a run that lost executors or was restarted leaves no duplicates. All
checkpoints and tables belong in a folder that all executors share.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from skilldemand.operators.ingest import dedupe_against, first_per_url
from skilldemand.functions.numbers import round_exact, safe_ratio
from skilldemand.operators.weekly import KEY, SLOT, skill_mentions, weekly_totals
from skilldemand.sources.ledger import WeeklyTable, weeks_of

BUCKETS = 64  # folders of a batch, by the hash of the URL

BatchJob = Callable[[DataFrame], DataFrame]


def read_arrivals(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None, **options
) -> DataFrame:
    """A stream over the Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def read_batches(
    spark: SparkSession, path: str, schema: T.StructType, before: int | None = None
) -> DataFrame:
    """The rows of all finished batches of a table, or of those before a batch."""
    schema = T.StructType(list(schema.fields))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema.add("batch_id", T.LongType()))
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(with_batch).parquet(path)
    return rows if before is None else rows.where(F.col("batch_id") < before)


def _write_batch(df: DataFrame, path: str, batch_id: int, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(os.path.join(path, f"batch_id={batch_id}"))


def _run(stream: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what has arrived, batch by batch, then stop."""
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(job)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def url_bucket(buckets: int):
    return F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")


def ingest_stream(
    arrivals: DataFrame,
    store: str,
    checkpoint: str,
    roles: list[str] | None = None,
    buckets: int = BUCKETS,
    recent: str | None = None,
) -> StreamingQuery:
    """Add arriving postings whose URL is not stored yet, one per URL.

    The store makes URLs unique for all time. It is cut by the hash of the URL, and a batch
    reads the URLs of the buckets it falls into, no other folders. The number of buckets must
    not change for a store. With ``recent``, a delay on ``scraped_at``, rows that arrive again
    unchanged within it are dropped by a state of that length before they meet the store;
    what is stored is the same.
    """
    schema = arrivals.schema
    if recent is not None:
        simple = [c for c, kind in arrivals.dtypes if not kind.startswith(("array", "map", "struct", "variant"))]
        arrivals = arrivals.withWatermark("scraped_at", recent).dropDuplicatesWithinWatermark(simple)

    def job(batch: DataFrame, batch_id: int) -> None:
        new = first_per_url(batch, roles).withColumn("bucket", url_bucket(buckets))
        asked = [r["bucket"] for r in batch.select(url_bucket(buckets).alias("bucket")).distinct().collect()]
        stored = read_batches(batch.sparkSession, store, schema.add("bucket", T.IntegerType()), before=batch_id)
        fresh = dedupe_against(new, stored.where(F.col("bucket").isin(asked)))
        _write_batch(fresh, store, batch_id, ["bucket"])

    return _run(arrivals, job, checkpoint)


def enrich_stream(arrivals: DataFrame, enrich_job: BatchJob, out: str, checkpoint: str) -> StreamingQuery:
    """Enrich arriving postings; failed rows go to their own partition."""

    def job(batch: DataFrame, batch_id: int) -> None:
        done = enrich_job(batch).withColumn("failed", F.col("error").isNotNull())
        _write_batch(done, out, batch_id, ["failed"])

    return _run(arrivals, job, checkpoint)


def weekly_counts(mentions: DataFrame, delay: str = "14 days") -> DataFrame:
    """Mentions per (role, skill, week) of a stream of (role_category, skill, scraped_at).

    A seven-day window that starts four days into the epoch starts on Mondays. State of a
    week is dropped once the watermark has passed it, and so are rows that come later
    than that; ``trends_stream`` accepts rows of any age.
    """
    week = F.window("scraped_at", "7 days", startTime="4 days")
    counted = (
        mentions.withWatermark("scraped_at", delay)
        .groupBy(week.alias("week"), "role_category", "skill")
        .agg(F.count("*").alias("mention_count"))
    )
    start_day = F.floor(F.unix_seconds("week.start") / 86400).cast("int")
    return counted.select(
        "skill", "role_category", F.date_from_unix_date(start_day).alias("week_start"), "mention_count"
    )


def weekly_counts_stream(counts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the counts that each batch changed; ``current_counts`` takes the newest of each key."""
    return _run(counts, lambda batch, i: _write_batch(batch, out, i), checkpoint, "update")


COUNTS = T.StructType(
    [
        T.StructField("skill", T.StringType()),
        T.StructField("role_category", T.StringType()),
        T.StructField("week_start", T.DateType()),
        T.StructField("mention_count", T.LongType()),
    ]
)
def current_counts(spark: SparkSession, out: str) -> DataFrame:
    return (
        read_batches(spark, out, COUNTS)
        .groupBy(*KEY)
        .agg(F.max_by("mention_count", "batch_id").alias("mention_count"))
    )


def counts_table(spark: SparkSession, out: str) -> WeeklyTable:
    """Counts that add up, by week; a row without a skill is the total of its role."""
    return WeeklyTable(spark, out, COUNTS)


def trends_stream(
    arrivals: DataFrame, out: str, checkpoint: str, name: str = "batch", compact_every: int | None = None
) -> StreamingQuery:
    """Weekly counts of arriving enriched postings of any age.

    Each batch of (posting_id, role_category, scraped_at, skills_extracted) is added to the
    stored counts of the weeks that it touches, as a run of its own, so a repeated batch adds
    nothing. A null skill list is a posting that is not processed. ``name`` tells streams
    that share a table apart. Every ``compact_every`` batches folders that newer ones
    replace are deleted; readers of older rows should be done by then.
    """

    def job(batch: DataFrame, batch_id: int) -> None:
        table = counts_table(batch.sparkSession, out)
        run = f"{name}-{batch_id}"
        if table.committed(run):
            return
        processed = batch.where("skills_extracted is not null")
        mentions = skill_mentions(batch, processed.select("posting_id", "skills_extracted"))
        totals = weekly_totals(batch).select(
            F.lit(None).cast("string").alias("skill"), *SLOT, F.col("total_postings").alias("mention_count")
        )
        new = mentions.unionByName(totals)
        weeks = weeks_of(weekly_totals(batch))
        added = table.read(weeks).unionByName(new).groupBy(*KEY).agg(F.sum("mention_count").alias("mention_count"))
        table.replace(added, weeks, run)
        if compact_every and batch_id % compact_every == compact_every - 1:
            table.compact()

    return _run(arrivals, job, checkpoint)


def trends_of_batches(spark: SparkSession, out: str, weeks: list | None = None) -> DataFrame:
    """The trends table that all batches so far add up to, or some weeks of it."""
    counts = counts_table(spark, out).read(weeks)
    totals = counts.where("skill IS NULL").select(*SLOT, F.col("mention_count").alias("total"))
    share = round_exact(safe_ratio(F.col("mention_count"), F.col("total")), 4).alias("pct_of_postings")
    return counts.where("skill IS NOT NULL").join(totals, SLOT).select(*KEY, "mention_count", share)
