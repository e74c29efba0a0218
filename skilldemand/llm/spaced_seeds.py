"""Benchmark decontamination by spaced-seed hashing.

A mask is a window of token positions of which some are ignored, so windows agree under it
although the tokens at the ignored positions differ. Every window of the benchmark is
hashed under every mask into an index. The documents' windows are hashed in the same way;
a bit table of fixed size that holds the index's hashes lets most of them go before the
join. Where hashes meet, document and item are laid over each other at that shift, and the
best stretch of the overlap decides, substitutions included; where it does not suffice, the
one with the most agreeing tokens among all stretches that reach the share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skilldemand.llm import hashing as H
from skilldemand.llm.common import stage

# Fixed masks: 1 is compared, 0 ignored. Any one substitution, and most pairs of them,
# leave one of the masks untouched at some shift within a dozen tokens.
MASKS = ("1101101011", "1011010111", "11110011011")
FILTER_BITS = 1 << 24  # of the bit table that goes to all tasks: 2 MB, whatever the index
MIN_TOKENS = 13  # tokens that must agree (or all of a shorter item's)
MIN_SHARE = 0.8  # of the stretch's tokens
MISS = 2  # what a differing token costs against an agreeing one
SHORT = -1  # mask number of items shorter than a mask: the whole item


def item_index(items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """``hash, item_id, at, mask``: every window of every item under every mask."""
    longest = max(len(m) for m in masks)

    def index(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for low, data, offsets in H.slices(batch.column(1)):
                tokens, rows, _ = H.tokens(data, offsets, H.LETTERS)
                bounds = H.row_bounds(rows, len(offsets) - 1)
                found = []
                for m, mask in enumerate(masks):
                    code, at = H.window_hashes(tokens, rows, mask, m)
                    found.append((code, rows[at], at - bounds[rows[at]], np.full(len(code), m)))
                size = np.diff(bounds)
                for length in range(1, longest):
                    of = np.flatnonzero(size == length)
                    if len(of):
                        code, at = H.window_hashes(tokens, rows, "1" * length, 1000 + length)
                        mine = size[rows[at]] == length
                        found.append((code[mine], rows[at[mine]], np.zeros(mine.sum(), int), np.full(mine.sum(), SHORT - length)))
                code, row, at, mask_ = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(code.view(np.int64)),
                        pa.array(ids[low + row].astype(np.int64)),
                        pa.array(at.astype(np.int32)),
                        pa.array(mask_.astype(np.int32)),
                    ],
                    ["hash", "item_id", "at", "mask"],
                )

    return items.select("item_id", "text").mapInArrow(index, "hash long, item_id long, at int, mask int")


def bit_table(index: DataFrame) -> np.ndarray:
    """A table of ``FILTER_BITS`` bits with those of the index's hashes set."""
    words = index.selectExpr(
        f"shiftright(hash & {FILTER_BITS - 1}L, 5) w", "shiftleft(1L, cast(hash & 31L as int)) b"
    )
    out = np.zeros(FILTER_BITS >> 5, np.uint32)
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        out[r.w] = r.b
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def document_hits(docs: DataFrame, masks: tuple[str, ...], table: np.ndarray, lengths: list[int]) -> DataFrame:
    """``row, hash, place, mask`` of the windows of documents that the bit table lets through."""
    packed = np.packbits(table, bitorder="little").tobytes()
    plans = [(m, mask, m) for m, mask in enumerate(masks)]
    plans += [(SHORT - n, "1" * n, 1000 + n) for n in lengths]

    def hits(batches):
        bits = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            ids = batch.column(0)
            for low, data, offsets in H.slices(batch.column(1)):
                tokens, rows, _ = H.tokens(data, offsets, H.LETTERS)
                bounds = H.row_bounds(rows, len(offsets) - 1)
                for m, mask, salt in plans:
                    code, at = H.window_hashes(tokens, rows, mask, salt)
                    ok = bits[(code & np.uint64(FILTER_BITS - 1)).astype(np.int64)]
                    code, at = code[ok], at[ok]
                    row = rows[at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(low + row)),
                            pa.array(code.view(np.int64)),
                            pa.array((at - bounds[row]).astype(np.int32)),
                            pa.array(np.full(len(code), m, np.int32)),
                        ],
                        ["row", "hash", "place", "mask"],
                    )

    return docs.select("row", "text").mapInArrow(hits, "row string, hash long, place int, mask int")


def best_stretch(agree: np.ndarray) -> tuple[int, int, int]:
    """Start, end and agreeing tokens of the stretch with the most agreement, costs taken off."""
    gain = np.where(agree, 1, -MISS)
    total = np.concatenate([[0], np.cumsum(gain)])
    lowest = np.minimum.accumulate(total)
    end = int(np.argmax(total - lowest))
    start = int(np.flatnonzero(total[: end + 1] == lowest[end])[-1]) if end else 0
    return start, end, int(agree[start:end].sum())


def fullest_stretch(agree: np.ndarray, min_share: float) -> tuple[int, int, int]:
    """Start, end and agreeing tokens of the stretch that has the most of all that reach the share."""
    same = np.concatenate([[0], np.cumsum(agree)])
    over = same - min_share * np.arange(len(same))  # does not fall over a stretch that reaches it
    lowest = np.minimum.accumulate(over)
    starts = np.searchsorted(-lowest, -over - 1e-9)  # the earliest for each end
    end = int(np.argmax(same - same[starts]))
    start = int(starts[end])
    while start < end and not agree[start]:
        start += 1
    return start, end, int(same[end] - same[start])


def overlap_of(doc: np.ndarray, item: np.ndarray, shift: int, min_tokens: int, min_share: float):
    """The decisive stretch where ``doc[i + shift]`` faces ``item[i]``, or None.

    Returns its first token in the document, its length and its agreeing tokens.
    """
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    if high <= low:
        return None
    agree = doc[low + shift : high + shift] == item[low:high]
    start, end, same = best_stretch(agree)
    if same < min(min_tokens, len(item)) or same < min_share * (end - start) - 1e-9:
        # another stretch may do, inside this one or apart from it
        start, end, same = fullest_stretch(agree, min_share)
    if same < min(min_tokens, len(item)) or same < min_share * (end - start) - 1e-9:
        return None
    return low + shift + start, end - start, same


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    masks: tuple[str, ...] = MASKS,
    min_tokens: int = MIN_TOKENS,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """Documents that hold a passage of an item: ``doc_id, item_id, start, length, same``.

    One row per document and item, with the longest verified overlap: its first token in
    the document, its tokens, and how many of them agree with the item. Tokens are runs of
    letters and digits, ASCII ones in lower case. ``docs`` needs ``doc_id`` and ``text``,
    ``items`` needs ``item_id`` and ``text``; others are ignored. Null and blank texts match
    nothing; an item shorter than a mask must occur whole. Null ids of items are dropped,
    null ids of documents are kept as null. Repeated documents and items each count once
    per pair of ids. An empty table on either side gives no rows.
    """
    items = items.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("long").alias("id"), "text", F.sha2("text", 256).alias("name")
    )
    # items of equal text are searched once
    first = items.groupBy("name").agg(F.min("id").alias("item_id"), F.min("text").alias("text"))
    members = items.select("name", "id").distinct().join(first.select("name", "item_id"), "name")
    members = members.select("id", "item_id")
    items = first.select("item_id", "text")
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text").cast("string"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("row"), "text")
    index = stage(item_index(items, masks), "seed-index")
    short = index.where(F.col("mask") < 0).select((F.lit(SHORT) - F.col("mask")).alias("n")).distinct()
    lengths = sorted(r.n for r in short.collect())  # below a mask's length
    table = bit_table(index)
    found = stage(document_hits(docs, masks, table, lengths), "seed-hits")
    shifts = (
        found.join(index, ["hash", "mask"])
        .select("row", "item_id", (F.col("place") - F.col("at")).alias("shift"))
        .distinct()
    )
    shifts = stage(shifts, "seed-shifts")
    facing = F.struct("item_id", "shift", F.col("text").alias("item"))
    facing = shifts.join(items, "item_id").groupBy("row").agg(F.collect_list(facing).alias("facing"))
    laid = docs.join(facing, "row").select("doc_id", "text", "facing")

    def verify(batches):
        for batch in batches:
            out = {c: [] for c in ("doc_id", "item_id", "start", "length", "same")}
            for low, data, offsets in H.slices(batch.column(1)):
                tokens, rows, _ = H.tokens(data, offsets, H.LETTERS)
                bounds = H.row_bounds(rows, len(offsets) - 1)
                for i in range(len(offsets) - 1):
                    doc, sides = tokens[bounds[i] : bounds[i + 1]], batch.column(2)[low + i].as_py()
                    data_, offsets_ = H.flat(pa.array([side["item"] for side in sides]))
                    faced, owners, _ = H.tokens(data_, offsets_, H.LETTERS)
                    at = H.row_bounds(owners, len(sides))
                    for j, side in enumerate(sides):
                        best = overlap_of(doc, faced[at[j] : at[j + 1]], side["shift"], min_tokens, min_share)
                        if best:
                            ids = (batch.column(0)[low + i].as_py(), side["item_id"])
                            for c, v in zip(out, (*ids, *best)):
                                out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out))

    schema = "doc_id long, item_id long, start long, length long, same long"
    overlaps = laid.mapInArrow(verify, schema)
    best = F.max(F.struct("same", (-F.col("length")).alias("l"), (-F.col("start")).alias("s"))).alias("best")
    best = overlaps.groupBy("doc_id", "item_id").agg(best).join(members, "item_id")
    return best.select(
        "doc_id", F.col("id").alias("item_id"), (-F.col("best.s")).alias("start"), (-F.col("best.l")).alias("length"), F.col("best.same")
    )
