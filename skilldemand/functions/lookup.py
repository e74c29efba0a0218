"""Rows of a reference table by key, for the words or phrases of a text.

There are two ways to the same rows, and the caller chooses. Inlined, the table becomes a
literal inside the expression, so the lookup is part of the scan: no join, no shuffle of
texts; a table above ``MAX_INLINE_ROWS`` rows is refused. Joined, the table may have any
size. Either way null keys are no rows and equal rows count once.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skilldemand.session import shuffles_removed

# Most rows of a table that may become a literal.
MAX_INLINE_ROWS = 20_000


def distinct_rows(table: DataFrame, key: str) -> DataFrame:
    return table.where(F.col(key).isNotNull()).distinct()


def literal(value, ddl: str) -> Column:
    """Any nested value as one literal, built by the parser instead of column by column."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), ddl)


MARK_BITS = 1 << 20  # of the literal that tells which words a table may hold


def may_hold(table: DataFrame, key: str):
    """A test whether a word may be a key of the table, from a bit table of a fixed size.

    Words without a row are mostly told apart before they are shuffled; where the table has
    more keys than bits, fewer are, with the same results.
    """
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(MARK_BITS))
    marks = table.where(F.col(key).isNotNull()).select(
        F.shiftright(place, 6).alias("at"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), {MARK_BITS}) & 63L AS int))").alias("bit")
    )
    bits = [0] * (MARK_BITS >> 6)
    with shuffles_removed(table.sparkSession):
        for row in marks.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():
            bits[row["at"]] = row["bits"]
    held = literal(bits, "array<bigint>")

    def test(word: Column) -> Column:
        at = F.pmod(F.xxhash64(word), F.lit(MARK_BITS))
        word_bits = F.get(held, F.shiftright(at, 6).cast("int"))
        return F.call_function("shiftrightunsigned", word_bits, (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

    return test


def join_rows(
    df: DataFrame, table: DataFrame, key: str, keys: Column, content: Column, out: str, columns: list[str] | None = None
) -> DataFrame:
    """Add all rows of ``table`` whose ``key`` is among ``keys``, an array of distinct strings.

    Of the rows, ``columns`` are gathered, all where none are named.

    ``content`` is a string that decides ``keys``. Rows are gathered by a hash of it, not
    by an id, so repeated and null ids do no harm; null where nothing is found. Only words
    that the table may hold are shuffled, beside 16 bytes of hash. A null content has an empty
    hash: a filter of nulls would keep a shuffle of the texts below from being used for both sides.
    """
    keys = F.filter(keys, may_hold(table, key))
    keyed = df.withColumn("_content", F.coalesce(F.unhex(F.substring(F.sha2(content.cast("binary"), 256), 1, 32)), F.lit(b"")))
    hits = (
        keyed.select("_content", F.explode(keys).alias(key))
        .join(distinct_rows(table, key), key)
        .groupBy("_content")
        .agg(F.collect_set(F.struct(*(columns or table.columns))).alias(out))
    )
    return keyed.join(hits, "_content", "left").drop("_content")


class InlineTable:
    """Rows of a small table spread over hash buckets, for lookups by ``key``."""

    def __init__(self, table: DataFrame, key: str):
        self.key = key
        rows = distinct_rows(table, key).limit(MAX_INLINE_ROWS + 1).collect()
        if len(rows) > MAX_INLINE_ROWS:
            raise ValueError(f"more than {MAX_INLINE_ROWS} rows can't be inlined; use inline=False")
        self.buckets = max(1, len(rows))
        fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in table.schema.fields)
        self._ddl = f"array<array<struct<{fields}>>>"
        spark = table.sparkSession
        keys = sorted({row[key] for row in rows})
        placed = {
            r["k"]: r["b"]
            for r in spark.createDataFrame([(k,) for k in keys], "k string")
            .select("k", self._bucket(F.col("k")).alias("b"))
            .collect()
        }
        spread = [[] for _ in range(self.buckets)]
        for row in rows:
            spread[placed[row[key]]].append(row.asDict())
        self._spread = spread

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.hash(key), F.lit(self.buckets))

    def first(self, key: Column) -> Column:
        """A row of the key, for tables with one row per key; null if there is none."""
        rows = F.get(literal(self._spread, self._ddl), self._bucket(key))
        return F.get(F.filter(rows, lambda row: row[self.key] == key), F.lit(0))

    def find(self, keys: Column) -> Column:
        """All rows whose key is among ``keys``, an array of distinct strings."""
        table = literal(self._spread, self._ddl)
        return F.flatten(
            F.transform(
                keys,
                lambda k: F.filter(F.get(table, self._bucket(k)), lambda row: row[self.key] == k),
            )
        )
