"""SimHash near-duplicates by deletion variants.

Fingerprints link where at most two of their 64 bits differ. Cut into two halves (a cut for
equal segments would need three), one half of a linked pair differs in one bit at most, so
both have the same text of that half with some bit wiped out. Every distinct fingerprint is
indexed by its 64 one-wildcard variants, and fingerprints meet by an equi-join on those.

No bucket is expanded into its pairs. The members of a bucket are first held against the
bucket's smallest fingerprint, which joins most of them. Buckets that still hold more than one
component are refined: a linked pair has the same fingerprint once the two bits are wiped
out, and each bit must be a wildcard whose bucket is still open for both (or, where one
half is equal, two bits of the other half). All members of such a second variant are linked
with one another, so one link to its smallest member is enough. That is at most 2016 rows for
a fingerprint, whatever the size of its buckets.

Spark sizes a table by that of the file it comes from, also behind an explode into 64 or 2016
rows, and keeps to a broadcast that it has planned so. The joins are merge joins by hint.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skilldemand.llm.common import stage
from skilldemand.llm.components import connected_components
from skilldemand.llm.simhash import SEED, fingerprints

WIDTH = 3
DISTANCE = 2  # bits in which linked fingerprints differ at most; the two halves depend on it
LOW_HALF = 0xFFFFFFFF
PER_TASK = 20_000  # fingerprints that a task makes variants of


def document_fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` for every row of ``docs``."""

    def describe(batches):
        for batch in batches:
            codes = fingerprints(batch.column(1), width, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view("int64"))], ["doc_id", "fp"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(describe, "doc_id long, fp long")


def bit(at: str) -> str:
    return f"shiftleft(1L, cast({at} as int))"


def variants(nodes: DataFrame) -> DataFrame:
    """The one-wildcard variants of both halves: ``key, at, fp, id``."""
    each = nodes.select("fp", "id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at"))
    half = f"(CASE WHEN at < 32 THEN fp & {LOW_HALF}L ELSE shiftrightunsigned(fp, 32) END)"
    return each.selectExpr(f"({half} & ~{bit('at % 32')}) | shiftleft(cast(at as long), 32) AS key", "at", "fp", "id")


def pair_variants(open_: DataFrame) -> DataFrame:
    """The two-wildcard variants: ``at, wiped`` of fingerprints with their ``mask`` of open bits.

    Of linked fingerprints with bits in both halves wiped out, both wildcards are open; where
    all 32 wildcards of a half are, it may be equal, and any two bits of the other half count.
    """
    low, high = f"(mask & {LOW_HALF}L) = {LOW_HALF}L", f"shiftrightunsigned(mask, 32) = {LOW_HALF}L"
    first = open_.select("*", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("p")).where(
        f"(mask & {bit('p')}) <> 0 OR (p < 32 AND {high}) OR (p >= 32 AND {low})"
    )
    second = first.select("*", F.explode(F.sequence(F.col("p") + 1, F.lit(63))).alias("q"))
    both = f"p < 32 AND q >= 32 AND (mask & {bit('p')}) <> 0 AND (mask & {bit('q')}) <> 0"
    kept = second.where(f"({both}) OR (q < 32 AND {high}) OR (p >= 32 AND {low})")
    return kept.selectExpr("p * 64 + q AS at", f"fp & ~({bit('p')} | {bit('q')}) AS wiped", "fp", "id", "comp")


def apart(one: Column, two: Column) -> Column:
    return F.bit_count(one.bitwiseXOR(two))


def with_components(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Add ``comp``, the component of ``id``; an id without links is its own."""
    joined = rows.join(comps.hint("merge"), "id", "left")
    return joined.withColumn("comp", F.coalesce("component", "id")).drop("component")


def fingerprint_links(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between ids that join all fingerprints at most two bits apart.

    ``nodes`` has distinct ``fp`` and the ``id`` that stands for each; ``known`` are links
    that hold anyway. Not all links are returned, but as many as connect the same ids.
    """
    every = variants(nodes)
    shared = every.groupBy("key").agg(F.min(F.struct("fp", "id")).alias("hub"), F.max("fp").alias("last"))
    shared = shared.where("hub.fp <> last").select("key", F.col("hub.fp").alias("hub_fp"), F.col("hub.id").alias("hub"))
    met = stage(every.join(shared.hint("merge"), "key"), "variants-met")
    near = met.where((F.col("fp") != F.col("hub_fp")) & (apart(F.col("fp"), F.col("hub_fp")) <= DISTANCE))
    links = near.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct().unionByName(known)
    links = stage(links, "variants-links")
    comps = stage(connected_components(links), "variants-comps")

    labelled = with_components(met.select("key", "at", "fp", "id"), comps)
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    open_ = labelled.join(mixed.select("key").hint("merge"), "key", "left_semi").groupBy("fp", "id", "comp")
    open_ = stage(open_.agg(F.expr(f"bit_or({bit('at')})").alias("mask")), "variants-open")
    wiped = pair_variants(open_)
    meet = wiped.groupBy("at", "wiped").agg(
        F.min("id").alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
    )
    meet = meet.where("lo <> hi").select("at", "wiped", "hub").hint("merge")
    more = wiped.join(meet, ["at", "wiped"]).where("id <> hub")
    return links.unionByName(more.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())


def simhash_components(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    ``docs`` needs ``doc_id`` (whole numbers) and ``text``; other columns are ignored.
    ``fingerprint`` is the SimHash of the whole text (see ``simhash.fingerprints``) in 16
    hexadecimal digits; a null, empty or blank text has zero, which links like any other.
    ``component_id`` is the smallest id reachable by fingerprints at most two bits apart.
    Rows that repeat an id are each returned; what any of their texts is linked with is
    linked under that id. Rows without an id are returned with a null component and link
    nothing. Empty table, no rows.
    """
    rows = stage(document_fingerprints(docs, width, seed), "variants-rows")
    known = rows.where("doc_id is not null")
    nodes = known.groupBy("fp").agg(F.min("doc_id").alias("id"))
    nodes = stage(nodes.repartition(max(1, -(-known.count() // PER_TASK)), "fp"), "variants-nodes")
    # an id with several fingerprints joins them
    several = known.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    owned = known.join(several.select("doc_id").hint("merge"), "doc_id", "left_semi").join(nodes.hint("merge"), "fp")
    same = owned.where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = stage(fingerprint_links(nodes, same), "variants-links")
    named = with_components(nodes, connected_components(links))
    # an id that repeats may stand for no fingerprint, but its links are its fingerprints' ones
    named = named.select("fp", F.col("comp").alias("component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    found = known.join(named.hint("merge"), "fp").select("doc_id", digits, "component_id")
    none = rows.where("doc_id is null").select("doc_id", digits, F.lit(None).cast("long").alias("component_id"))
    return found.unionByName(none)
