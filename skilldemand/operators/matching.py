"""Find vocabulary terms in texts.

A term counts where neither neighbour is an ASCII letter, digit or underscore. So the
words inside a term are whole words of the text, and one of them (the anchor) is enough
to find the few terms worth counting. The cost is one pass over the text plus one search
per term that can occur, not one search per vocabulary entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skilldemand.functions.lookup import InlineTable, join_rows
from skilldemand.functions.text import fold, word_runs

_EDGE = "[a-zA-Z0-9_]"


def bounded_pattern(term: Column, ignore_case: bool = True) -> Column:
    """Regular expression for a term between word boundaries.

    The left neighbour is looked at after the term has matched, which spares the check
    at every other position.
    """
    quoted = F.concat(
        F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")
    )
    return F.concat(
        F.lit("(?iu)" if ignore_case else ""),
        quoted,
        F.lit(f"(?<!{_EDGE}"),
        quoted,
        F.lit(f")(?!{_EDGE})"),
    )


def anchored(terms: DataFrame, ignore_case: bool = True) -> DataFrame:
    """Add the pattern and the anchor (longest word, "" if a term has none)."""
    text = fold(F.col("term")) if ignore_case else F.col("term")
    longest = F.element_at(
        F.array_sort(F.transform(word_runs(text), lambda w: F.struct(F.length(w), w.alias("w")))), -1
    )
    return terms.withColumns(
        {
            "anchor": F.when(F.size(word_runs(text)) > 0, longest["w"]).otherwise(""),
            "pattern": bounded_pattern(F.col("term"), ignore_case),
        }
    )


def match_terms(
    docs: DataFrame,
    terms: DataFrame,
    text_col: str,
    out: str = "matches",
    ignore_case: bool = True,
    inline: bool = True,
) -> DataFrame:
    """Add an array of the term rows found in the text, each with its count ``n``.

    ``terms`` has the texts in ``term`` and any other columns to carry along; null terms are
    ignored, equal rows count once. ``inline`` tells how they are looked up and changes no
    result; larger tables than ``MAX_INLINE_ROWS`` need False.
    """
    attributes = terms.columns
    terms = terms.where("term is not null")
    table = anchored(terms, ignore_case)
    words = F.array_append(
        word_runs(fold(F.col(text_col)) if ignore_case else F.col(text_col)), F.lit("")
    )
    words = F.array_distinct(words)
    if inline:
        found = docs.withColumn("_candidates", InlineTable(table, "anchor").find(words))
    else:
        # the pattern is longer than its term, so it is made again where it is used
        found = join_rows(docs, table.drop("pattern"), "anchor", words, F.col(text_col), "_candidates", attributes)
    counted = F.filter(
        F.transform(
            F.col("_candidates"),
            lambda c: F.struct(
                *[c[name].alias(name) for name in attributes],
                F.regexp_count(F.col(text_col), c["pattern"] if inline else bounded_pattern(c["term"], ignore_case)).cast("bigint").alias("n"),
            ),
        ),
        lambda m: m["n"] > 0,
    )
    empty = F.array().cast(f"array<struct<{_ddl(terms)}, n: bigint>>")
    return found.withColumn(out, F.coalesce(counted, empty)).drop("_candidates")


def _ddl(terms: DataFrame) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in terms.schema.fields)

