"""Queries on postings and their enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skilldemand.functions.dates import week_start
from skilldemand.functions.numbers import round_exact
from skilldemand.functions.pages import check_page, envelope, page_rows
from skilldemand.functions.text import urgency

CARD = ["posting_id", "title", "company", "location", "url", "source", "role_category", "scraped_at", "posted_at"]

MAX_WEEKS = 52  # fixed value: the most weeks of a timeline


def _of_role(df: DataFrame, role: str | None) -> DataFrame:
    return df if role is None else df.where(F.col("role_category") == role)


def _marked(postings: DataFrame, processed: DataFrame) -> DataFrame:
    """Postings with a flag for those that have an enrichment row."""
    done = processed.select("posting_id", F.lit(True).alias("_done"))
    return postings.join(done, "posting_id", "left")


def roles(postings: DataFrame, processed: DataFrame) -> DataFrame:
    """Postings of each role: all, processed and not processed."""
    counted = (
        _marked(postings.select("posting_id", "role_category"), processed)
        .groupBy("role_category")
        .agg(F.count("*").alias("posting_count"), F.count("_done").alias("processed_count"))
    )
    return counted.withColumn(
        "unprocessed_count", F.col("posting_count") - F.col("processed_count")
    ).orderBy(F.desc("posting_count"), "role_category")


def stats(
    postings: DataFrame, processed: DataFrame, trends: DataFrame, role: str | None = None
) -> DataFrame:
    """One row of totals, of everything or of one role (which counts as one tracked role)."""
    chosen = _of_role(postings, role)
    if role is None:
        done = processed.agg(F.count("*").alias("n"))
        tracked = F.count_distinct("role_category")
    else:
        done = processed.select("posting_id").join(
            chosen.select("posting_id"), "posting_id", "left_semi"
        ).agg(F.count("*").alias("n"))
        tracked = F.lit(1).cast("bigint")
    weeks = _of_role(trends, role).agg(F.count_distinct("week_start").alias("n"))
    return (
        chosen.agg(
            F.count("*").alias("total_postings"),
            F.max("scraped_at").alias("last_scraped"),
            tracked.alias("roles_tracked"),
            F.sort_array(F.collect_set("source")).alias("sources"),
        )
        .withColumns({"processed_postings": done.scalar(), "weeks_of_data": weeks.scalar()})
        .withColumn("unprocessed_postings", F.col("total_postings") - F.col("processed_postings"))
        .select(
            "total_postings",
            "processed_postings",
            "unprocessed_postings",
            "last_scraped",
            "roles_tracked",
            "weeks_of_data",
            "sources",
        )
    )


def _attach(page: DataFrame, processed: DataFrame) -> DataFrame:
    """Enrichment of a bounded page of postings.

    The page has at most ``MAX_PAGE_SIZE`` rows, so it can be broadcast and the enrichment
    table is scanned once without being shuffled.
    """
    fields = ["posting_id", "skills_extracted", "sentiment_score", "topics", "entities"]
    hits = processed.select(*fields).join(F.broadcast(page.select("posting_id")), "posting_id")
    return page.join(hits, "posting_id", "left")


def recent_postings(
    postings: DataFrame,
    processed: DataFrame,
    role: str | None = None,
    page: int = 1,
    page_size: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """A page of postings, newest first, with their enrichment, and the envelope.

    A page past the end is empty.
    """
    check_page(page, page_size)
    chosen = _of_role(postings, role)
    order = [F.desc("scraped_at"), F.asc("posting_id")]
    cards = page_rows(
        chosen.select(*CARD), [(F.date_trunc("minute", "scraped_at"), True)], order, page, page_size
    )
    filled = _attach(cards, processed)
    texts = ["title", "company", "location", "url", "source", "role_category"]
    data = filled.select(
        "posting_id",
        *[F.coalesce(c, F.lit("")).alias(c) for c in texts],
        "scraped_at",
        "posted_at",
        F.coalesce("skills_extracted", F.array().cast("array<string>")).alias("skills"),
        "sentiment_score",
        "topics",
        "entities",
    ).orderBy(F.desc("scraped_at"), "posting_id")
    return data, envelope(chosen, page, page_size)


def recent_by_role(
    postings: DataFrame,
    role: str,
    limit: int = 50,
    processed: DataFrame | None = None,
) -> DataFrame:
    """The newest postings of a role; with ``processed``, their enrichment too."""
    check_page(1, limit)
    order = [F.desc("scraped_at"), F.asc("posting_id")]
    newest = _of_role(postings, role).orderBy(*order).limit(limit)
    return newest if processed is None else _attach(newest, processed).orderBy(*order)


def posting_detail(postings: DataFrame, processed: DataFrame, posting_id) -> DataFrame:
    """One posting with its enrichment; no row if it does not exist."""
    wanted = F.col("posting_id") == posting_id
    return postings.where(wanted).join(processed.where(wanted), "posting_id", "left")


def sentiment_timeline(
    postings: DataFrame, processed: DataFrame, role: str | None = None, weeks: int = 8
) -> DataFrame:
    """Mean sentiment, urgency phrases and postings per week, oldest first.

    The cutoff is taken from the newest posting of any role. Urgency is counted before
    the join, so no text is shuffled.
    """
    if not 1 <= weeks <= MAX_WEEKS:
        raise ValueError(f"weeks must be 1 to {MAX_WEEKS}: {weeks}")
    newest = postings.agg(F.max("scraped_at").alias("newest"))
    cutoff = newest.scalar() - F.expr(f"INTERVAL {7 * weeks} DAYS")
    recent = _of_role(postings, role).where(F.col("scraped_at") >= cutoff)
    scored = recent.select(
        "posting_id",
        week_start(F.col("scraped_at")).alias("week"),
        urgency(F.col("raw_text")).alias("urgency"),
    )
    return (
        scored.join(processed.select("posting_id", "sentiment_score"), "posting_id")
        .groupBy("week")
        .agg(
            round_exact(_stable_mean(F.col("sentiment_score")), 4).alias("avg_sentiment"),
            F.sum("urgency").alias("urgency_score"),
            F.count("*").alias("posting_count"),
        )
        .orderBy("week")
    )


def _stable_mean(value: Column) -> Column:
    """Mean that does not depend on the order of the rows: the sum is exact to 12 digits."""
    return F.sum(value.cast("decimal(18,12)")).cast("double") / F.count(value)


def timeline_summary(timeline: DataFrame) -> DataFrame:
    """Mean of the weekly means, urgency in all, and the change from first to last week."""
    change = F.when(
        F.count("*") >= 2, F.max_by("avg_sentiment", "week") - F.min_by("avg_sentiment", "week")
    )
    return timeline.agg(
        F.avg("avg_sentiment").alias("avg_sentiment"),
        F.coalesce(F.sum("urgency_score"), F.lit(0).cast("bigint")).alias("total_urgency"),
        change.alias("change"),
    ).withColumn("direction", _direction(F.col("change")))


def _direction(change: Column) -> Column:
    return F.when(change > 0, "up").when(change < 0, "down").when(change == 0, "flat")


def topics(postings: DataFrame, processed: DataFrame, role: str | None = None) -> DataFrame:
    """Postings and mean non-zero probability per topic label; postings without one left out."""
    labelled = processed.where("topics.topic_label is not null").select("posting_id", "topics.*")
    probability = F.when(F.col("probability") != 0, F.col("probability"))
    return (
        _of_role(postings, role)
        .select("posting_id")
        .join(labelled, "posting_id")
        .groupBy("topic_label")
        .agg(
            F.max(F.coalesce("topic_id", F.lit(-1))).alias("topic_id"),
            F.count("*").alias("posting_count"),
            round_exact(F.coalesce(F.avg(probability), F.lit(0.0)), 3).alias("avg_probability"),
        )
        .orderBy(F.desc("posting_count"), "topic_label")
    )


def table_counts(postings: DataFrame, processed: DataFrame, trends: DataFrame) -> DataFrame:
    """Rows of each stored table."""
    tables = {"postings": postings, "processed": processed, "trends": trends}
    counts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows")) for name, df in tables.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def unprocessed(
    postings: DataFrame, processed: DataFrame, limit: int | None = None, role: str | None = None
) -> DataFrame:
    """Postings without enrichment, oldest first."""
    rows = _of_role(postings, role).join(processed.select("posting_id"), "posting_id", "left_anti")
    ordered = rows.orderBy("scraped_at", "posting_id")
    return ordered if limit is None else ordered.limit(limit)
