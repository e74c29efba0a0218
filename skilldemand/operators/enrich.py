"""The enrichment of postings: clean, skills, sentiment, entities, topics."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skilldemand.functions.numbers import round_exact
from skilldemand.functions.text import clean_checked
from skilldemand.operators.sentiment import with_sentiment
from skilldemand.operators.skills import merge_tool_entities, no_entities, with_entities, with_skills
from skilldemand.schemas import TOPIC

Stage = Callable[[DataFrame], DataFrame]


def enrich(
    postings: DataFrame,
    vocab: DataFrame,
    lexicon: DataFrame,
    gazetteer: DataFrame | None = None,
    topic_stage: Stage | None = None,
    chunks: Column | None = None,
    entity_stage: Stage | None = None,
    processed_at: Column | None = None,
    inline: bool = True,
) -> DataFrame:
    """One row per posting with its skills, sentiment, entities and topic, and an error if any.

    With ``inline`` the whole enrichment is one pass over the postings without a shuffle;
    a reference table too large for that is refused and needs False, which joins by word
    and changes no result. A posting that fails in a Python stage
    carries the message in ``error`` and nulls elsewhere; the others are unaffected.

    ``topic_stage`` adds a ``topics`` struct to a frame with ``posting_id`` and ``text``,
    ``entity_stage`` an ``entities`` struct in place of the gazetteer, and ``chunks`` is
    an array of phrases made from the column ``text``. A stage that adds ``topics_error`` or
    ``entities_error`` as well, as ``isolate.isolated_stage`` does, reports its failed rows there.
    """
    cleaned = postings.select("posting_id", clean_checked(F.col("raw_text")).alias("_c")).select(
        "posting_id", F.col("_c.text").alias("text"), F.col("_c.error").alias("error")
    )
    chunks_col = None
    if chunks is not None:
        cleaned, chunks_col = cleaned.withColumn("_chunks", chunks), "_chunks"
    staged = with_skills(cleaned, vocab, "text", "posting_id", chunks_col, inline=inline)
    staged = with_sentiment(staged, lexicon, "text", "posting_id", inline=inline)
    names = F.transform(F.col("skills"), lambda s: s["skill"])
    staged = staged.withColumn("skills_extracted", names)
    if entity_stage is not None:
        staged = _with_error(entity_stage(staged), "entities")
    elif gazetteer is not None:
        staged = with_entities(staged, gazetteer, "text", "posting_id", inline=inline)
    if gazetteer is None and entity_stage is None:
        staged = staged.withColumn("entities", no_entities())
    else:
        staged = staged.withColumn(
            "entities", merge_tool_entities(F.col("entities"), F.col("skills_extracted"))
        )
    if topic_stage is None:
        staged = staged.withColumn("topics", F.lit(None).cast(TOPIC))
    else:
        staged = _with_error(topic_stage(staged), "topics")
    fine = F.col("error").isNull()
    return staged.select(
        "posting_id",
        F.when(fine, F.col("skills_extracted")).alias("skills_extracted"),
        F.when(fine, round_exact(F.col("sentiment.compound"), 4)).alias("sentiment_score"),
        F.when(fine, F.col("topics")).alias("topics"),
        F.when(fine, F.col("entities")).alias("entities"),
        (F.current_timestamp() if processed_at is None else processed_at).alias("processed_at"),
        "error",
    )


def _with_error(staged: DataFrame, out: str) -> DataFrame:
    """Move the errors of a stage to ``error``, named after the stage; the first one stays."""
    if f"{out}_error" not in staged.columns:
        return staged
    named = F.when(F.col(f"{out}_error").isNotNull(), F.concat(F.lit(f"{out}: "), f"{out}_error"))
    return staged.withColumn("error", F.coalesce("error", named)).drop(f"{out}_error")


def append_processed(enriched: DataFrame, path: str, run: str | None = None) -> None:
    """Write an enrichment run to its own folder; failed rows go to their own partition of it.

    A run that is repeated under its name replaces what it wrote before.
    """
    rows = enriched.withColumn("failed", F.col("error").isNotNull())
    rows.write.mode("overwrite").partitionBy("failed").parquet(f"{path.rstrip('/')}/run={run or uuid.uuid4().hex}")


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """Rows that were enriched; only their partition is read."""
    return spark.read.parquet(path).where("failed = false").drop("run", "failed", "error")


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """(posting, error) of the rows that failed."""
    return spark.read.parquet(path).where("failed = true").select("posting_id", "error")


def written_summary(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """Rows processed and rows failed of what is stored, or of one run of it; no text is parsed again."""
    rows = spark.read.parquet(path)
    if run is not None:
        rows = rows.where(F.col("run").cast("string") == run)
    return rows.agg(F.count_if(~F.col("failed")).alias("processed"), F.count_if("failed").alias("errors"))


def run_summary(enriched: DataFrame) -> DataFrame:
    """Rows processed and rows failed of a run that is not written."""
    return enriched.agg(
        F.count_if(F.col("error").isNull()).alias("processed"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
