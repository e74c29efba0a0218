"""Merkle fixity audit of record archives.

Each record's hash covers its bytes and its place (file, offset). A leaf covers one range
of offsets of a file; a node of the levels above covers as many ranges as the fan-out, in
order of offset, up to one node per file. The files' nodes go into a tree by the digits of
the hash of the file's name, up to one root. Two replicas are compared from the root down:
a level's nodes are only looked at below nodes that differ, and records only in leaves
that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skilldemand.llm.common import stage

RANGE = 1 << 20  # bytes of offsets that a leaf covers
FANOUT = 16
DIGITS = 4  # of the hash of a file's name, levels of the tree of files


def record_hashes(records: DataFrame, content: list[str]) -> DataFrame:
    """``file, offset, digest, copies``: one row per place, from the bytes of ``content``.

    Nulls in a column differ from empty values. Rows that share a place are one entry
    whose digest is the sum of theirs, word by word, with their number. A null file or offset
    is a place of its own.
    """
    parts = [F.coalesce(F.concat(F.lit("="), F.base64(F.col(c).cast("binary"))), F.lit("null")) for c in content]
    place = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in ("file", "offset")]
    digest = F.sha2(F.concat_ws(":", *place, *parts).cast("binary"), 256)
    rows = records.select("file", F.col("offset").cast("long").alias("offset"), digest.alias("digest"))
    return combined(rows, ["file", "offset"])


def words_of(digest: Column) -> list[Column]:
    """A hexadecimal SHA-256 as eight numbers."""
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(8)]


def combined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One digest for the rows of a key, whatever their order and number, and that number.

    Sums add up before the shuffle, so a key may have up to 2 ** 31 rows. Equal rows do not
    cancel out in them.
    """
    sums = [F.sum(w).alias(f"w{i}") for i, w in enumerate(words_of(F.col("digest")))]
    out = rows.groupBy(*keys).agg(F.count("*").alias("copies"), *sums)
    text = F.concat_ws("", *[F.lpad(F.lower(F.hex(f"w{i}")), 16, "0") for i in range(8)])
    return out.select(*keys, text.alias("digest"), "copies")


def merkle_nodes(hashes: DataFrame, height: int, size: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """All nodes: ``level, file, node, digest``; parents of (level, file, node) are at level + 1.

    Levels 0 to ``height`` are ranges of offsets, ``height`` being one node per file; the
    levels above are of files, ``node`` being digits of the file name's hash.
    """
    place = F.coalesce(F.floor(F.col("offset") / F.lit(size)), F.lit(-1)).cast("string")
    entry = F.sha2(F.concat_ws(":", "digest", "copies").cast("binary"), 256)
    leaves = combined(hashes.select("file", place.alias("node"), entry.alias("digest")), ["file", "node"])
    level = leaves.select("file", "node", hashed("digest", "copies"))
    out = [level.select(F.lit(0).alias("level"), "file", "node", "digest")]
    for k in range(1, height + 1):
        up = parent_range(F.col("node"), fanout, last=k == height)
        level = ordered_parents(level.withColumn("up", up), ["file", "up"]).withColumnRenamed("up", "node")
        out.append(level.select(F.lit(k).alias("level"), "file", "node", "digest"))
    name = F.sha2(F.coalesce(F.concat(F.lit("="), "file"), F.lit("null")).cast("binary"), 256)
    files = combined(level.select(F.substring(name, 1, DIGITS).alias("node"), "digest"), ["node"])
    level = files.select("node", hashed("digest", "copies"))
    none = F.lit(None).cast("string")
    out.append(level.select(F.lit(height + 1).alias("level"), none.alias("file"), "node", "digest"))
    for k in range(1, DIGITS + 1):
        up = F.substring("node", 1, DIGITS - k)
        level = ordered_parents(level.withColumn("up", up), ["up"]).withColumnRenamed("up", "node")
        out.append(level.select(F.lit(height + 1 + k).alias("level"), none.alias("file"), "node", "digest"))
    nodes = out[0]
    for part in out[1:]:
        nodes = nodes.unionByName(part)
    return nodes


def hashed(*columns: str) -> Column:
    return F.sha2(F.concat_ws(":", *columns).cast("binary"), 256).alias("digest")


def parent_range(node: Column, fanout: int, last: bool) -> Column:
    """Number of the range above; records without an offset stay in the range -1."""
    if last:
        return F.lit("0")
    up = F.floor(node.cast("long") / F.lit(fanout))
    return F.when(node == "-1", F.lit("-1")).otherwise(up.cast("string"))


def ordered_parents(level: DataFrame, keys: list[str]) -> DataFrame:
    """Hash of the children in order; a node has at most a fan-out of them (and range -1)."""
    children = F.sort_array(F.collect_list(F.struct(F.length("node"), "node", "digest")))
    text = F.concat_ws(",", F.transform(children, lambda c: F.concat_ws(":", c["node"], c["digest"])))
    return level.groupBy(*keys).agg(F.sha2(text.cast("binary"), 256).alias("digest"))


def fixity_audit(
    one: DataFrame, two: DataFrame, content: list[str], size: int = RANGE, fanout: int = FANOUT
) -> DataFrame:
    """Places where two replicas differ: ``file, offset, state, digest_one, digest_two``.

    Both have the columns ``file`` and ``offset`` and those in ``content``; others are
    ignored. ``state`` is changed, missing (not in ``two``) or extra (not in ``one``).
    A place with repeated rows differs if its rows or their number do. Places with a null
    file or offset are compared like others. Equal replicas, also empty ones, give no rows.
    """
    hashes = [stage(record_hashes(r, content), "fixity") for r in (one, two)]
    highest = max(h.agg(F.max("offset")).first()[0] or 0 for h in hashes)
    height, ranges = 1, highest // size + 1
    while ranges > fanout:
        ranges, height = -(-ranges // fanout), height + 1
    trees = [stage(merkle_nodes(h, height, size, fanout), "fixity-nodes") for h in hashes]
    top = height + 1 + DIGITS
    root = [t.where(F.col("level") == top) for t in trees]
    differ = stage(differing(*root), "fixity-differ")
    for level in range(top - 1, -1, -1):
        if differ.isEmpty():
            break  # below equal nodes there is nothing to find
        below = [t.where(F.col("level") == level).withColumn("up", parent_key(level, height, fanout)) for t in trees]
        below = [b.join(differ, F.col("up") == F.col("id"), "left_semi") for b in below]
        differ = stage(differing(*below), "fixity-differ")
    place = F.coalesce(F.floor(F.col("offset") / F.lit(size)), F.lit(-1)).cast("string")
    suspects = [
        h.withColumn("up", node_id(F.lit(0), F.col("file"), place)).join(
            differ, F.col("up") == F.col("id"), "left_semi"
        )
        for h in hashes
    ]
    a, b = (s.select(*[F.col(c).alias(f"{c}_{k}") for c in ("file", "offset", "digest", "copies")]) for s, k in zip(suspects, "ab"))
    same = F.col("file_a").eqNullSafe(F.col("file_b")) & F.col("offset_a").eqNullSafe(F.col("offset_b"))
    both = a.join(b, same, "full_outer")
    state = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("changed")
    unlike = ~(F.col("digest_a").eqNullSafe(F.col("digest_b")) & F.col("copies_a").eqNullSafe(F.col("copies_b")))
    return both.where(unlike).select(
        F.coalesce("file_a", "file_b").alias("file"),
        F.coalesce("offset_a", "offset_b").alias("offset"),
        state.alias("state"),
        F.col("digest_a").alias("digest_one"),
        F.col("digest_b").alias("digest_two"),
    )


def node_id(level: Column, file: Column, node: Column) -> Column:
    return F.concat_ws("/", level.cast("string"), F.coalesce(F.concat(F.lit("="), file), F.lit("null")), node)


def parent_key(level: int, height: int, fanout: int) -> Column:
    """The id of the node above a node of ``level``."""
    none = F.lit(None).cast("string")
    if level < height:
        return node_id(F.lit(level + 1), F.col("file"), parent_range(F.col("node"), fanout, level + 1 == height))
    if level == height:
        name = F.sha2(F.coalesce(F.concat(F.lit("="), "file"), F.lit("null")).cast("binary"), 256)
        return node_id(F.lit(height + 1), none, F.substring(name, 1, DIGITS))
    return node_id(F.lit(level + 1), none, F.substring("node", 1, DIGITS - (level - height)))


def differing(one: DataFrame, two: DataFrame) -> DataFrame:
    """Nodes of either tree that the other lacks or has with another digest."""
    a = one.select(node_id(F.col("level"), F.col("file"), F.col("node")).alias("id"), F.col("digest").alias("da"))
    b = two.select(node_id(F.col("level"), F.col("file"), F.col("node")).alias("id"), F.col("digest").alias("db"))
    joined = a.join(b, "id", "full_outer")
    return joined.where(~F.col("da").eqNullSafe(F.col("db"))).select("id")
