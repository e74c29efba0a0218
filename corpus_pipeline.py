"""A training corpus from raw documents, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each
result to the shared folder and hands the table read back to the next stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skilldemand.llm.common import fold, read, stage
from skilldemand.llm.interleave import interleaved_shards
from skilldemand.llm.jaccard import ngram_jaccard_components
from skilldemand.llm.lsa_vote import quality_scores
from skilldemand.llm.spaced_seeds import contaminated
from skilldemand.llm.temperature import temperature_mixture

SHARDS = 8


def row_name() -> Column:
    """A row's name, made of its id and text: an id with several texts is several documents."""
    return F.xxhash64("doc_id", "text")


def named(docs: DataFrame) -> DataFrame:
    """The documents under their rows' names."""
    return docs.withColumn("doc_id", row_name())


def without(docs: DataFrame, names: DataFrame) -> DataFrame:
    """The documents whose row is not named in ``names``, a table of rejected ones."""
    rejected = names.select(F.col("doc_id").alias("_row")).distinct()
    return docs.withColumn("_row", row_name()).join(rejected, "_row", "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours vote low go."""
    labels = read(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1)
    rows = docs.select("doc_id", row_name().alias("_row")).distinct()
    labels = labels.join(rows, "doc_id").withColumn("doc_id", F.col("_row")).drop("_row")
    return without(docs, quality_scores(named(docs), labels).where("predicted = 0").select("doc_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays (null ids last)."""
    found = stage(ngram_jaccard_components(named(docs)).distinct(), "corpus-components")
    linked = found.where("doc_id <> component_id").select("doc_id", "component_id")
    linked = linked.unionByName(linked.select(F.col("component_id").alias("doc_id"), "component_id").distinct())
    ids = docs.select(F.col("doc_id").alias("id"), row_name().alias("doc_id")).distinct()
    linked = linked.join(ids, "doc_id")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("doc_id"))
    first = linked.groupBy("component_id").agg(F.min(order).alias("first")).select("component_id", "first.doc_id")
    kept = without(docs, linked.select("doc_id").join(first, "doc_id", "left_anti"))
    # of rows that are equal in id and text, one stays
    again = docs.groupBy(row_name().alias("_row")).agg(F.count("*").alias("_rows")).where("_rows > 1").select("_row")
    again = stage(again, "corpus-again")
    if again.isEmpty():
        return kept
    rows = kept.withColumn("_row", row_name())
    one = rows.join(again, "_row", "left_semi").dropDuplicates(["_row"])
    return rows.join(again, "_row", "left_anti").unionByName(one).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return without(docs, contaminated(named(docs), read(spark, sf_dir, "benchmark")).select("doc_id"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their tempered weights: a row for every time that a document is taken.

    Rows of sources with large shares are left out; that is what the mixture is for.
    """
    return temperature_mixture(docs).select(docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their place in it."""
    return interleaved_shards(docs, SHARDS)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "corpus-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)


#: Voting among singular vectors has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
