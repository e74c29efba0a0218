"""From parsed sources to new rows of the postings table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skilldemand.functions.lookup import literal
from skilldemand.functions.text import explode_once

# The tracked roles in their order, and the title words that stand for them.
ROLES = [
    "data analyst",
    "data scientist",
    "ml engineer",
    "data engineer",
    "software engineer",
    "backend engineer",
    "frontend engineer",
    "product manager",
    "devops",
    "ai researcher",
]
ROLE_KEYWORDS = {
    "data analyst": ["data analyst", "analytics", "data analysis"],
    "data scientist": ["data scientist", "data science", "machine learning"],
    "ml engineer": ["ml engineer", "machine learning engineer", "mlops"],
    "data engineer": ["data engineer", "data pipeline", "etl"],
    "software engineer": ["software engineer", "software developer", "swe"],
    "backend engineer": ["backend", "back end", "back-end", "api developer"],
    "frontend engineer": ["frontend", "front end", "front-end", "react", "vue"],
    "product manager": ["product manager", "product management", "pm"],
    "devops": ["devops", "sre", "site reliability", "platform engineer"],
    "ai researcher": ["ai researcher", "research scientist", "nlp researcher"],
}

# The order in which sources are saved.
SOURCES = ["reed", "remoteok", "adzuna"]


def tag_roles(
    feed: DataFrame,
    roles: list[str] | None = None,
    keywords: dict[str, list[str]] | None = None,
    title_col: str = "title",
    tags_col: str = "tags",
) -> DataFrame:
    """One row per posting and matching role.

    A role matches if one of its keywords occurs in the title or in a tag; a role
    without keywords is its own keyword. The roles are an argument, hence few.
    """
    known = ROLE_KEYWORDS if keywords is None else keywords
    table = literal(
        [{"role": r, "keywords": known.get(r.lower(), [r.lower()])} for r in (ROLES if roles is None else roles)],
        "array<struct<role: string, keywords: array<string>>>",
    )
    title = F.coalesce(F.lower(title_col), F.lit(""))
    tags = F.transform(
        F.coalesce(F.col(tags_col), F.array().cast("array<string>")),
        lambda t: F.replace(F.lower(t), F.lit("-"), F.lit(" ")),
    )
    # A keyword never spans two tags: the separator occurs in no keyword.
    haystack = F.array_join(F.concat(F.array(title), tags), "\n")
    matching = F.transform(
        F.filter(
            table, lambda role: F.exists(role["keywords"], lambda k: F.contains(F.col("_haystack"), k))
        ),
        lambda role: role["role"],
    )
    searched = feed.withColumn("_haystack", haystack)
    return explode_once(searched, matching, "role_category", *feed.columns)


def union_sources(*sources: DataFrame) -> DataFrame:
    """All sources in one frame; ``source_ord`` keeps their order."""
    ordered = [df.withColumn("source_ord", F.lit(i)) for i, df in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ordered)


def stamp(df: DataFrame, scraped_at: Column | None = None) -> DataFrame:
    """Defaults of newly ingested postings."""
    return df.withColumns(
        {
            "location": F.coalesce("location", F.lit("")),
            "raw_text": F.coalesce("raw_text", F.lit("")),
            "scraped_at": F.current_timestamp() if scraped_at is None else scraped_at,
            "is_processed": F.lit(False),
        }
    )


def order_of(col: Column, values: list[str]) -> Column:
    """Position in a fixed list; values outside it come last."""
    position = F.array_position(F.array(*[F.lit(v) for v in values]), col)
    return F.when(position > 0, position).otherwise(len(values) + 1)


def first_per_url(
    df: DataFrame, roles: list[str] | None = None, key: str = "url", tiebreak: list[str] | None = None
) -> DataFrame:
    """One row per URL: the first by source order, then role order, then ``tiebreak``.

    Rows equal in these are ordered by all their other columns of simple types (nulls
    first), so the row that stays does not depend on how the input is split.

    The ranking is cut to one row per URL before the shuffle as well, so a URL with
    very many copies does not fill one task.
    """
    order = [F.col("source_ord"), order_of(F.col("role_category"), ROLES if roles is None else roles)]
    order += [F.col(c) for c in (tiebreak or ["role_category"])]
    simple = [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct", "variant"))]
    order += [F.col(f"`{c}`").asc_nulls_first() for c in sorted(simple)]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def dedupe_against(new: DataFrame, existing: DataFrame, key: str = "url") -> DataFrame:
    """New rows whose URL is not stored yet.

    The stored URLs are first reduced to those the batch asks for: a batch small enough
    to broadcast leaves the store unshuffled, and a larger one can still be turned
    into a runtime filter on the store.
    """
    asked = new.select(key).distinct()
    seen = existing.select(key).join(asked, key, "left_semi").distinct()
    return new.join(seen, key, "left_anti")


def ingest_summary(saved: DataFrame) -> DataFrame:
    """Saved rows per source and role, per source, and in all."""
    return saved.rollup("source", "role_category").agg(F.count("*").alias("saved"))
