"""File sources: labelled CSV, line corpora, the vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skilldemand.functions.text import strip
from skilldemand.operators.matching import bounded_pattern


def _read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def read_skill_gold(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, skills) with the skills as a set of lower-cased names."""
    rows = _read_csv(spark, path, "id string, text string, skills string")
    names = F.transform(F.split("skills", ","), lambda s: F.lower(strip(s)))
    skills = F.array_distinct(F.filter(names, lambda s: s != ""))
    return rows.select("id", "text", F.coalesce(skills, F.array().cast("array<string>")).alias("skills"))


def read_sentiment_gold(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, text)."""
    return _read_csv(spark, path, "id string, label string, text string")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(text): one document per line, blank lines dropped."""
    return spark.read.text(path).select(strip(F.col("value")).alias("text")).where("text != ''")


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(skill, category, kind, ord, pattern) of a vocabulary file.

    The file has ``technical`` (category to skills) and ``soft`` (skills). A skill named
    twice, in whatever case, counts where it comes first; ``ord`` puts long names first.
    """
    raw = spark.read.text(path, wholetext=True).select(
        F.from_json("value", "technical map<string, array<string>>, soft array<string>").alias("v")
    )
    technical = raw.select(F.posexplode(F.map_entries("v.technical")).alias("at", "entry")).select(
        "at",
        F.col("entry.key").alias("category"),
        F.posexplode("entry.value").alias("pos", "skill"),
        F.lit("technical").alias("kind"),
    )
    soft = raw.select(F.posexplode("v.soft").alias("pos", "skill")).select(
        F.lit(None).cast("int").alias("at"),
        F.lit("soft").alias("category"),
        "pos",
        "skill",
        F.lit("soft").alias("kind"),
    )
    named = technical.unionByName(soft)
    place = [F.asc_nulls_last("at"), F.asc("pos")]
    first = F.row_number().over(Window.partitionBy(F.lower("skill")).orderBy(*place))
    unique = named.withColumn("_n", first).where("_n = 1")
    # A vocabulary file is small by nature: it is one JSON value.
    order = Window.orderBy(F.desc(F.length("skill")), *place)
    return unique.select(
        "skill",
        "category",
        "kind",
        (F.row_number().over(order) - 1).cast("bigint").alias("ord"),
        bounded_pattern(F.col("skill")).alias("pattern"),
    )
