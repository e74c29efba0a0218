"""The test tables read as postings, enrichment and trends."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skilldemand.operators.weekly import build_trends
from skilldemand.session import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def basket_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as postings."""
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("posting_id"),
        F.col("o_orderstatus").alias("source"),
        F.col("o_orderpriority").alias("role_category"),
        F.concat(F.lit("Order "), key).alias("title"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("company"),
        F.lit(None).cast("string").alias("location"),
        F.concat(F.lit("http://shop/"), key).alias("url"),
        F.concat_ws(" ", F.lit("needed now"), F.col("o_orderpriority")).alias("raw_text"),
        F.col("o_orderdate").alias("scraped_at"),
        F.lit(None).cast("timestamp").alias("posted_at"),
    )


def basket_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))


def basket_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of an order as its enrichment."""
    topic = F.struct(
        F.min("l_linenumber").alias("topic_id"),
        F.min("l_returnflag").alias("topic_label"),
        F.avg("l_tax").alias("probability"),
    )
    none = F.array().cast("array<string>")
    entities = F.struct(none.alias("orgs"), none.alias("locations"), none.alias("products"))
    return (
        basket_lines(spark, sf_dir)
        .groupBy(F.col("l_orderkey").alias("posting_id"))
        .agg(
            F.sort_array(F.collect_set("p_name")).alias("skills_extracted"),
            F.avg("l_discount").alias("sentiment_score"),
            topic.alias("topics"),
        )
        .withColumn("entities", entities)
    )


_stored: dict[tuple[str, str, str], str] = {}


def _stored_trends(spark: SparkSession, sf_dir: str, kind: str, build) -> DataFrame:
    """The weekly table of a folder, written on first use and read from then on.

    That is how the table is used: analytics read what the weekly job has stored.
    """
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _stored:
        path = scratch_dir(spark, kind)
        # Sorted instead of partitioned by week: the test table has few rows per week.
        build(spark, sf_dir).sortWithinPartitions("week_start").write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def build_basket_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_trends(basket_postings(spark, sf_dir), basket_processed(spark, sf_dir))


def basket_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_trends(spark, sf_dir, "basket", build_basket_trends)


BASKET_ROLES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def event_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as postings of ten roles."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("posting_id"),
        F.concat(F.lit("r"), (F.col("user_id") % 10).cast("string")).alias("role_category"),
        F.col("ts").alias("scraped_at"),
        F.concat(F.lit("http://events/"), (F.col("event_id") % 1000).cast("string")).alias("url"),
        F.col("event_type").alias("raw_text"),
    )


def event_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("posting_id"), F.array("event_type").alias("skills_extracted")
    )


def build_event_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_trends(event_postings(spark, sf_dir), event_processed(spark, sf_dir))


def event_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_trends(spark, sf_dir, "events", build_event_trends)


EVENT_ROLES = [f"r{i}" for i in range(10)]


def document_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings over nine weeks."""
    day = (F.col("doc_id") % 63).cast("int")
    return (
        table(spark, sf_dir, "documents").select(
            F.col("doc_id").alias("posting_id"),
            F.col("source"),
            F.col("lang").alias("role_category"),
            F.col("text").alias("raw_text"),
            F.timestamp_add("DAY", day, F.expr("timestamp_ntz'2024-01-01'")).alias("scraped_at"),
        )
    )


def spread_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, dealt over the tasks by id and text: of a file with few row groups, few tasks read texts."""
    return document_postings(spark, sf_dir).repartition("posting_id", "raw_text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")
