"""URL filter: gradient-boosted trees on lexical features, under a list of rules.

Rules decide the urls they fit, the longest first. The others are judged by boosted trees
on what the url looks like: length, depth, digits, entropy, parameters, and how common the
host's suffix is and how often labelled urls with it are blocked.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skilldemand.llm.common import ascii_lower, stage

TRAIN_ROWS = 20_000  # labelled urls that are fitted on at most
TREES, DEPTH = 20, 4
LEXICAL = ["length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "parameters", "hyphens", "vowels", "longest", "query_length"]
SUFFIX = ["suffix_common", "suffix_blocked"]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty if the url has no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule ``host/path`` that fits; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, _, rule_path = text.partition("/")
        fits = (host == rule_host) | host.endswith("." + rule_host)
        fits &= path.startswith("/" + rule_path)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def lexical_features(url: Column) -> dict[str, Column]:
    """Numbers from the url's text; a null counts as empty."""
    url = F.coalesce(url, F.lit(""))
    host, path = host_of(url), path_of(url)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    length = F.length(url).cast("double")
    marks = F.split(url, "")
    share = lambda c: F.size(F.filter(marks, lambda x: x == c)) / length
    kinds = F.filter(F.array_distinct(marks), lambda x: x != "")
    entropy = F.aggregate(kinds, F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    runs = F.transform(F.split(host, r"[.\-]"), lambda x: F.length(x))
    return {
        "length": length,
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": count(path, "/[^/]"),
        "labels": F.size(F.split(host, r"\.")).cast("double"),
        "digits": F.when(length > 0, count(url, "[0-9]") / length).otherwise(0.0),
        "entropy": F.when(length > 0, entropy).otherwise(0.0),
        "parameters": count(query, "[^&=]+="),
        "hyphens": count(host, "-"),
        "vowels": F.when(F.length(host) > 0, count(host, "[aeiou]") / F.length(host)).otherwise(0.0),
        "longest": F.coalesce(F.array_max(runs), F.lit(0)).cast("double"),
        "query_length": F.length(query).cast("double"),
    }


def url_verdicts(
    urls: DataFrame,
    rules: list[tuple[str, str]],
    labelled: DataFrame | None = None,
    train_rows: int = TRAIN_ROWS,
    trees: int = TREES,
    depth: int = DEPTH,
    seed: int = 0,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``: one row per row of ``urls``.

    ``labelled`` has ``url`` and ``verdict`` (allow or block); by default the urls that a
    rule decides are the labelled ones. At most ``train_rows`` distinct labelled urls are
    fitted on; the statistics of suffixes cover all urls and all labelled ones. ``score``
    is the trees' probability of block; without labelled urls of both kinds it is the share
    of block among them, 0 without any. Null urls and those without ``://`` have an empty
    host and path, and are judged by the trees. Repeated rows are judged alike.
    """
    parts = urls.select(F.col("page_id").cast("long").alias("page_id"), "url")
    parts = parts.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, decided = rule_for(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": rule, "decided": decided, "suffix": suffix_of(F.col("host"))})
    parts = stage(parts.withColumns(lexical_features(F.col("url"))), "urls")
    if labelled is None:
        marked = parts.where("decided is not null").withColumn("block", (F.col("decided") == "block").cast("int"))
    else:
        marked = labelled.where("url is not null and verdict in ('allow', 'block')")
        marked = marked.select("url", (F.col("verdict") == "block").cast("int").alias("block"))
        marked = marked.withColumns(lexical_features(F.col("url"))).withColumn("suffix", suffix_of(host_of(F.col("url"))))
    by_suffix = marked.groupBy("suffix").agg(F.sum("block").alias("blocked"), F.count("*").alias("marked"))
    sums = by_suffix.agg(F.sum("blocked"), F.sum("marked")).first()
    blocked, n = sums[0] or 0, sums[1] or 0
    share = blocked / n if n else 0.0
    common = parts.groupBy("suffix").agg(F.log1p(F.count("*")).alias("suffix_common"))
    blocked_share = (F.coalesce("blocked", F.lit(0)) + F.lit(10 * share)) / (F.coalesce("marked", F.lit(0)) + 10)
    statistics = common.join(by_suffix, "suffix", "left").select("suffix", "suffix_common", blocked_share.alias("suffix_blocked"))
    statistics = stage(statistics, "url-suffixes")
    judged = parts.join(statistics, "suffix", "left").fillna(0.0, SUFFIX)
    if 0 < blocked < n:
        rows = marked.select("url", "suffix", "block", *LEXICAL).dropDuplicates(["url"])
        rows = rows.orderBy(F.xxhash64(F.lit(seed), "url"), "url").limit(train_rows)
        rows = stage(rows.join(statistics, "suffix", "left").fillna(0.0, SUFFIX).coalesce(4), "url-train")
        features = VectorAssembler(inputCols=LEXICAL + SUFFIX, outputCol="features", handleInvalid="keep")
        boosted = GBTClassifier(
            labelCol="block", maxIter=trees, maxDepth=depth, stepSize=0.3, minInstancesPerNode=5, seed=seed
        )
        model = Pipeline(stages=[features, boosted]).fit(rows)
        judged = model.transform(judged).withColumn("score", vector_to_array("probability")[1])
    else:
        judged = judged.withColumn("score", F.lit(float(share)))
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("decided", own).alias("verdict"), "score")


def entropy_bits(text: str) -> float:
    """Entropy per character of a text, as the feature has it."""
    n = len(text)
    return -sum(text.count(c) / n * math.log2(text.count(c) / n) for c in set(text)) if n else 0.0
