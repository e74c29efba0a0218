"""JSON feeds to postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skilldemand.functions.dates import epoch_utc, iso_utc
from skilldemand.functions.text import explode_once, strip, strip_html

# Source names and the address that stands in for a missing one.
FLAT_SOURCE = "remoteok"
FLAT_LINK = "https://remoteok.com/l/"
NESTED_SOURCE = "adzuna"


def _filled(value: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(value, F.lit(""))


def parse_flat_feed(
    raw: DataFrame, payload_col: str = "payload", source: str = FLAT_SOURCE, link: str = FLAT_LINK
) -> DataFrame:
    """Jobs of payloads that are one JSON array each; entries without ``position`` are skipped.

    Adds ``tags`` for role tagging. A key that is missing and one that is null differ
    here, so each entry is read as a map first.
    """
    entries = F.from_json(payload_col, "array<map<string, string>>")
    job = explode_once(raw, entries, "job").where(
        F.map_contains_key("job", F.lit("position"))
    )
    get = F.col("job").getItem
    url = F.coalesce(_filled(get("url")), F.concat(F.lit(link), F.coalesce(get("id"), F.lit(""))))
    title = F.coalesce(_filled(get("position")), get("title"), F.lit(""))
    company = F.when(F.map_contains_key("job", F.lit("company")), get("company")).otherwise("Unknown")
    return job.select(
        F.lit(source).alias("source"),
        title.alias("title"),
        company.alias("company"),
        F.coalesce(_filled(get("location")), F.lit("Remote")).alias("location"),
        url.alias("url"),
        strip_html(F.coalesce(get("description"), F.lit("")), strip=True).alias("raw_text"),
        epoch_utc(get("epoch")).alias("posted_at"),
        F.coalesce(F.from_json(get("tags"), "array<string>"), F.array().cast("array<string>")).alias(
            "tags"
        ),
    )


_NESTED = """
    results array<struct<
        title: string, redirect_url: string, description: string, created: string,
        company: struct<display_name: string>, location: struct<display_name: string>>>
"""


def parse_nested_feed(
    raw: DataFrame, payload_col: str = "payload", source: str = NESTED_SOURCE
) -> DataFrame:
    """Results of API pages (role_category, payload); those without title or address are dropped."""
    results = F.from_json(payload_col, _NESTED)["results"]
    r = explode_once(raw, results, "r", "role_category").select("role_category", "r.*")

    def text(name: str) -> Column:
        return strip(F.coalesce(F.col(name), F.lit("")))

    return r.select(
        F.lit(source).alias("source"),
        "role_category",
        text("title").alias("title"),
        strip(F.coalesce(_filled(F.col("company.display_name")), F.lit("Unknown"))).alias("company"),
        text("location.display_name").alias("location"),
        text("redirect_url").alias("url"),
        text("description").alias("raw_text"),
        iso_utc(F.col("created")).alias("posted_at"),
    ).where("title != '' and url != ''")
