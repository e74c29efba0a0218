"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersections.

A document's set holds its distinct five-word shingles. Two sets with a Jaccard
similarity of at least t must share one of the first ``n - ceil(t n) + 1`` shingles of
either set in any fixed order of all shingles, so documents meet by an equi-join on those.
The smaller set has their first common shingle earlier still, among ``n - ceil(2t/(1+t) n) + 1``;
buckets in which no set has the shingle so early are left out.
The order puts the shingles that most documents have last.

Documents that meet on a shingle form a bucket. First every document of a bucket is held
against the bucket's smallest id alone, which joins most copies and grows with the rows of
the bucket; a bitmap of each set bounds the overlap before sets are fetched. Then the buckets that still hold more than one component are cut into tiles
by set size; two tiles meet only if their sizes allow the similarity, and a bitmap of each set
bounds the overlap from above (each bit in which two parity bitmaps differ is an element
that only one has). A tile does not return the pairs that the bound leaves open, only which rows
they connect. Each family of rows so connected then gets its sets once, in tiles again,
and pairs of different components are checked there by intersecting the sorted shingle
arrays. A tile returns the links that join components, fewer than its rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skilldemand.llm import hashing as H
from skilldemand.llm.common import arrow_batches, stage
from skilldemand.llm.components import connected_components

WIDTH = 5
PERCENT = 75  # similarity of a link
COMMON = 1 << 16  # shingles that are put last in the order; bounds the broadcast
SEEN_OFTEN = 8  # a task reports shingles that so many of a slice's documents share
TILE = 2048  # bitmaps in a tile, and four times the sets in one
LOT_BYTES = 1 << 25  # of the rows of one component's buckets that are held together
FEW = 6  # rows of a bucket that are compared pair by pair
MAX_BITS = 1 << 14
BATCH = 1000  # rows of an Arrow batch: texts, bitmaps or sets
ID_BITS = 1 << 26  # of the table of ids whose sets are needed


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, row bounds and sorted distinct shingles of slices of a column of texts."""
    for low, data, offsets in H.slices(texts):
        n = len(offsets) - 1
        hashes, rows, _ = H.tokens(data, offsets)
        code, owner = H.shingles(hashes, H.row_bounds(rows, n), width)
        order = np.lexsort((code, owner))
        code, owner = code[order], owner[order]
        if len(code):
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
            code, owner = code[new], owner[new]
        yield low, H.row_bounds(owner, n), code


def common_shingles(docs: DataFrame, width: int, limit: int = COMMON) -> np.ndarray:
    """The shingles in most documents, for the order alone: no pair depends on this list."""

    def often(batches):
        for batch in batches:
            for _, _, code in shingle_sets(batch.column(0), width):
                value, count = np.unique(code, return_counts=True)
                many = count >= SEEN_OFTEN
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[many].view(np.int64)), pa.array(count[many])], ["s", "n"]
                )

    counted = docs.select("text").mapInArrow(often, "s long, n long")
    top = counted.groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(limit)
    return np.sort(top.select("s").toArrow()["s"].to_numpy().view(np.uint64))


def required(n, percent: int = PERCENT):
    """Shingles that a set of ``n`` must share with any set it is linked to."""
    return -(-n * percent // 100)


def parity_bits(code: np.ndarray) -> bytes:
    """A bitmap of about as many bits as the set has elements; each element flips one bit."""
    width = 64
    while width < len(code) and width < MAX_BITS:
        width *= 2
    bits = np.bincount((code & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def describe_sets(docs: DataFrame, width: int, percent: int, common: np.ndarray) -> DataFrame:
    """Per document its set's size, 128-bit name, bitmap and prefix in the common order."""
    schema = "doc_id long, n long, name binary, bits binary, prefix array<long>"

    def describe(batches):
        told = set()  # names whose prefix this task has given out, under an id
        for batch in batches:
            ids = batch.column(0)
            named = ids.is_valid().to_numpy(zero_copy_only=False)
            for low, bounds, code in shingle_sets(batch.column(1), width):
                late = np.zeros(len(code), bool)
                if len(common):
                    at = np.minimum(np.searchsorted(common, code), len(common) - 1)
                    late = common[at] == code
                names, bits, prefixes = [], [], []
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]), low):
                    own = code[a:b]
                    if a == b:
                        names.append(None), bits.append(None), prefixes.append(None)
                        continue
                    name = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    names.append(name)
                    bits.append(parity_bits(own))
                    if name in told or not named[i]:
                        prefixes.append(None)
                        continue
                    told.add(name)
                    k = b - a - required(b - a, percent) + 1
                    first = np.concatenate([own[~late[a:b]], own[late[a:b]]])[:k]
                    prefixes.append(first.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(low, len(bounds) - 1),
                        pa.array(np.diff(bounds)),
                        pa.array(names, pa.binary()),
                        pa.array(bits, pa.binary()),
                        pa.array(prefixes, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "name", "bits", "prefix"],
                )

    return docs.select("doc_id", "text").mapInArrow(describe, schema)


def id_bits(ids: DataFrame) -> bytes:
    """A table of ``ID_BITS`` bits, 8 MB whatever the ids: texts without a set bit stay unread.

    It spares the shuffle of all texts; ids that share a bit are told apart by the join.
    """
    bit = f"pmod(doc_id, {ID_BITS}L)"
    words = ids.selectExpr(f"shiftright({bit}, 5) w", f"shiftleft(1L, cast({bit} & 31L as int)) b")
    words = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(ID_BITS >> 5, np.uint32)
    out[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.uint32)
    return out.tobytes()


def fetched_sets(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, code``: the sorted shingle array of each of the ``ids``, written once."""
    ids = stage(ids, "jaccard-ids")
    packed = id_bits(ids)

    def sets(batches):
        table = np.frombuffer(packed, np.uint8)
        for batch in batches:
            ids_ = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False) % ID_BITS
            named = (table[ids_ >> 3] >> (ids_ & 7).astype(np.uint8)) & 1
            batch = batch.filter(pa.array(named.astype(bool)))
            for low, bounds, code in shingle_sets(batch.column(1), width):
                arrays = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), code.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, len(bounds) - 1), arrays.cast(pa.list_(pa.int64()))],
                    ["doc_id", "code"],
                )

    described = docs.select("doc_id", "text").mapInArrow(sets, "doc_id long, code array<long>")
    return stage(described.join(ids, "doc_id", "left_semi"), "jaccard-sets")


def verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are similar enough, by intersecting sorted arrays."""
    found = fetched_sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs, width)
    one = found.select(F.col("doc_id").alias("a"), F.col("code").alias("left"))
    two = found.select(F.col("doc_id").alias("b"), F.col("code").alias("right"))

    def similar(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right")
    return joined.mapInArrow(similar, "a long, b long")


def apart_at_least(one: bytes, two: bytes) -> int:
    """Elements that only one of two sets has, at least: bits in which their bitmaps differ."""
    x, y = int.from_bytes(one, "little"), int.from_bytes(two, "little")
    wide, narrow = max(len(one), len(two)) * 8, min(len(one), len(two)) * 8
    if len(one) < len(two):
        x, y = y, x
    while wide > narrow:
        wide //= 2
        x = (x & ((1 << wide) - 1)) ^ (x >> wide)
    return (x ^ y).bit_count()


def within_bound(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and bitmaps leave open; ``bits`` has doc_id, n and bits."""
    sides = [bits.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "nb", "bitsa", "bitsb")

    def open_(batches):
        for batch in batches:
            n, m, one, two = (batch.column(i).to_pylist() for i in range(2, 6))
            most = [(x + y - apart_at_least(p, q)) // 2 for x, y, p, q in zip(n, m, one, two)]
            keep = [(100 + percent) * k >= percent * (x + y) for k, x, y in zip(most, n, m)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(open_, "a long, b long")


def fold_bits(bits: np.ndarray, width: int) -> np.ndarray:
    """Parity bitmaps (rows of bytes) folded to ``width`` bytes."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def tile_pairs(one: dict, two: dict | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in two tiles of pairs that size, component and bitmaps leave open.

    A tile has arrays ``n``, ``comp`` and a list ``bits``; without a second tile, pairs are
    those within the first.
    """
    other = one if two is None else two
    rows, cols = [], []
    by_width: dict[int, np.ndarray] = {}
    for j, b in enumerate(other["bits"]):
        by_width.setdefault(len(b), []).append(j)
    mats = {
        w: (np.array(at), np.frombuffer(b"".join(other["bits"][j] for j in at), np.uint8).reshape(-1, w))
        for w, at in by_width.items()
    }
    for i, (n, comp, b) in enumerate(zip(one["n"], one["comp"], one["bits"])):
        own = np.frombuffer(b, np.uint8)[None, :]
        for w, (at, matrix) in mats.items():
            m = other["n"][at]
            open_ = (other["comp"][at] != comp) & (100 * np.minimum(m, n) >= percent * np.maximum(m, n))
            if two is None:
                open_ &= at > i
            if not open_.any():
                continue
            at_, m_, narrow = at[open_], m[open_], min(w, own.shape[1])
            apart = np.bitwise_count(
                fold_bits(matrix[open_], narrow) ^ fold_bits(own, narrow)
            ).sum(axis=1, dtype=np.int64)
            most = (m_ + n - apart) // 2  # shared elements at most
            ok = (100 + percent) * most >= percent * (m_ + n)
            rows.append(np.full(int(ok.sum()), i))
            cols.append(at_[ok])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(cols)


def with_partners(members: DataFrame, percent: int) -> DataFrame:
    """The members whose bucket holds another component at a size that may be similar.

    Sizes fall into bands as wide as the similarity allows, so a partner is in the same
    band or in one beside it. Only the extreme components of bands meet.
    """
    wide = math.log(100 / percent) + 1e-9  # a little more, for rounding
    banded = members.withColumn("band", F.floor(F.log("n") / F.lit(wide)))
    bands = banded.groupBy("bucket", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    beside = F.explode(F.expr("array(band - 1, band, band + 1)")).alias("band")
    mixed = bands.select("bucket", beside, "lo", "hi").groupBy("bucket", "band")
    mixed = mixed.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi")
    return banded.join(mixed, ["bucket", "band"], "left_semi").drop("band")


def united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels of rows, made equal for rows ``i`` and ``j`` and all that had their labels."""
    while len(i):
        least = np.minimum(label[i], label[j])
        if (label[i] == least).all() and (label[j] == least).all():
            break
        # the rows that had either label follow, as labels are numbers of rows
        np.minimum.at(label, label[i], least)
        np.minimum.at(label, label[j], least)
        label = label[label]
    return label


def few_open(n: list, comp: list, bits: list, percent: int) -> tuple[list, list]:
    """Positions of the open pairs among a few rows."""
    i, j = [], []
    for y in range(1, len(n)):
        for x in range(y):
            if comp[x] == comp[y] or 100 * min(n[x], n[y]) < percent * max(n[x], n[y]):
                continue
            most = (n[x] + n[y] - apart_at_least(bits[x], bits[y])) // 2
            if (100 + percent) * most >= percent * (n[x] + n[y]):
                i.append(x)
                j.append(y)
    return i, j


def open_roots(group: pa.Table, two_tiles: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in some buckets that have an open pair, each with one id that open pairs lead to.

    ``group``: doc_id, n, comp, bits and the places of a row, its buckets and their tiles.
    As many links as there are ids at most, however many pairs are open. A bucket whose rows
    are connected already is passed over.
    """
    group = group.sort_by("doc_id").combine_chunks()
    places = pa.concat_arrays(group["places"].chunks)
    bucket, t = (x.to_numpy(zero_copy_only=False) for x in places.flatten().flatten())
    owner = np.repeat(np.arange(len(places)), pc.list_value_length(places).to_numpy(zero_copy_only=False))
    order = np.lexsort((owner, t, bucket))
    bucket, t, place = bucket[order], t[order], owner[order]
    ids, told = group["doc_id"].to_numpy(), group["bits"].to_pylist()
    n, comp = (group[c].to_numpy()[place] for c in ("n", "comp"))
    bits = [told[k] for k in place]
    label = np.arange(len(ids))
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for low, high in zip(cuts[:-1], cuts[1:]):
        at = place[low:high]
        if (label[at] == label[at[0]]).all():
            continue
        if high - low <= FEW and not two_tiles:
            i, j = few_open(n[low:high].tolist(), comp[low:high].tolist(), bits[low:high], percent)
        else:
            parts = [(low, high)]
            if two_tiles:
                middle = low + int(np.searchsorted(t[low:high], t[high - 1]))
                parts = [(low, middle), (middle, high)]
            tiles = [{"n": n[x:y], "comp": comp[x:y], "bits": bits[x:y]} for x, y in parts]
            i, j = tile_pairs(tiles[0], tiles[1] if two_tiles else None, percent)
            j = j + (parts[-1][0] - low)
        label = united(label, at[i], at[j])
    rows = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[rows]], ids[rows]


def tile_units(members: DataFrame, group: str, tile: int, percent: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``members`` of groups ranked by size ``n`` and cut into tiles ``t``, and the tiles that meet.

    Tiles whose sizes allow the similarity meet, as ``group, t1, t2, t``: a row for each of the
    two, or one for a tile that meets itself.
    """
    by_size = Window.partitionBy(group).orderBy("n", "doc_id")
    tiled = stage(members.withColumn("t", F.floor((F.row_number().over(by_size) - 1) / F.lit(tile))), name)
    ranges = tiled.groupBy(group, "t").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    left, right = ranges.alias("x"), ranges.alias("y")
    meet = left.join(right, group).where(
        (F.col("y.t") >= F.col("x.t")) & (F.col("x.hi") * 100 >= F.col("y.lo") * percent)
    )
    meet = meet.select(group, F.col("x.t").alias("t1"), F.col("y.t").alias("t2"))
    return tiled, meet.select(group, "t1", "t2", F.explode(F.array_distinct(F.array("t1", "t2"))).alias("t"))


def open_links(members: DataFrame, bits: DataFrame, percent: int, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` that connect all pairs of a bucket that sizes and bitmaps leave open.

    ``members``: bucket, doc_id, n, comp; ``bits``: doc_id, bits. Every two tiles of a large
    bucket whose sizes allow the similarity are one group of at most two tiles of rows, and
    only there bitmaps come in. Buckets of one tile are dealt into lots of about a tile of
    rows; those of the same smallest component stay together up to a bounded size, so that a
    family is not told again by each of its buckets. A row enters a group once, with its
    places in the group's buckets, so its bitmap is sent once. A link need not be an open pair.
    """
    tiled, units = tile_units(members, "bucket", tile, percent, "jaccard-tiles")
    size = F.lit(64) + F.least(F.col("n") / 4, F.lit(MAX_BITS // 8))
    facts = tiled.groupBy("bucket").agg(F.max("t").alias("last"), F.sum(size).alias("size"), F.min("comp").alias("least"))
    earlier = Window.partitionBy("least").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    part = F.floor(F.coalesce(F.sum("size").over(earlier), F.lit(0)) / F.lit(LOT_BYTES))
    lots = max(1, -(-tiled.count() // tile))
    single = facts.where("last = 0").select("bucket", F.pmod(F.xxhash64("least", part), F.lit(lots)).alias("lot"))
    work = units.join(single, "bucket", "left").withColumn("whole", F.when(F.col("lot").isNull(), F.col("bucket")))
    work = work.join(tiled, ["bucket", "t"]).groupBy("lot", "whole", "t1", "t2", "doc_id", "n", "comp")
    work = work.agg(F.collect_list(F.struct("bucket", "t")).alias("places")).join(bits, "doc_id")

    def compare(key, group):
        a, b = open_roots(group, key[2].as_py() != key[3].as_py(), percent)
        return pa.table({"a": a, "b": b})

    found = work.groupBy("lot", "whole", "t1", "t2").applyInArrow(compare, "a long, b long")
    return found.distinct()


def parity_matrix(sets: list[np.ndarray], width: int) -> np.ndarray:
    """Parity bitmaps of ``width`` bits, a row per set."""
    out = np.zeros((len(sets), width // 8), np.uint8)
    for row, code in zip(out, sets):
        bits = np.bincount((code & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
        row[:] = np.packbits(bits.astype(np.uint8))
    return out


def similar_links(sets: list[np.ndarray], comp: np.ndarray, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Positions of similar pairs, as many as connect the same sets that all of them do.

    ``sets`` are sorted arrays, ascending in size; pairs within a component are known. With
    ``side``, pairs are those of a set of one side and one of the other. Sizes and bitmaps of
    twice as many bits as elements, which bound the overlap from above, come before the
    intersection of two arrays.
    """
    n = np.array([len(s) for s in sets], np.int64)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    width = 64
    while width < 2 * n.max(initial=0) and width < MAX_BITS:
        width *= 2
    bits = parity_matrix(sets, width)
    links = []
    for i in range(len(sets) - 1):
        last = np.searchsorted(n, n[i] * 100 // percent, side="right")
        others = np.arange(i + 1, last)
        if side is not None:
            others = others[side[others] != side[i]]
        others = others[comp[others] != comp[i]]
        if not len(others):
            continue
        apart = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
        whole = n[others] + n[i]
        most = (whole - apart) // 2
        for j in others[(100 + percent) * most >= percent * whole]:
            a, b = root(int(comp[i])), root(int(comp[j]))
            if a == b:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * shared >= percent * (n[i] + n[j] - shared):
                parent[max(a, b)] = min(a, b)
                links.append((i, int(j)))
    return links


def verified_links(open_: DataFrame, known: DataFrame, comps: DataFrame, docs: DataFrame, width: int, percent: int, tile: int) -> DataFrame:
    """Links between components from the families that ``open_`` links connect.

    All open pairs lie within families. A family's sets are fetched once, small families
    share a group, large ones are cut into tiles by size; pairs are verified in the group and
    at most one link for each of its rows is returned.
    """
    families = connected_components(open_).select(F.col("id").alias("doc_id"), F.col("component").alias("family"))
    label = F.coalesce("component", "doc_id").alias("comp")
    sizes = known.where("prefix is not null").select("doc_id", "n")
    rows = families.join(sizes, "doc_id").join(comps, F.col("doc_id") == comps.id, "left")
    rows = rows.select("doc_id", "family", "n", label)
    tiled, units = tile_units(rows, "family", tile, percent, "jaccard-families")
    sets = fetched_sets(tiled.select("doc_id").distinct(), docs, width)
    # families of one tile are dealt together, about a tile of rows to a group
    single = units.groupBy("family").agg((F.max("t") == 0).alias("single"))
    lots = max(1, -(-tiled.count() // tile))
    lot = F.when(F.col("single"), F.pmod(F.xxhash64("family"), F.lit(lots)))
    work = units.join(single, "family").join(tiled, ["family", "t"]).join(sets, "doc_id")
    work = work.withColumn("lot", lot).withColumn("whole", F.when(~F.col("single"), F.col("family")))

    def check(key, group):
        order = pc.sort_indices(group, sort_keys=[("family", "ascending"), ("n", "ascending"), ("doc_id", "ascending")])
        group = group.take(order).combine_chunks()
        ids, comp = group["doc_id"].to_numpy(), group["comp"].to_numpy()
        family, t = group["family"].to_numpy(), group["t"].to_numpy()
        lists = group["code"].combine_chunks() if isinstance(group["code"], pa.ChunkedArray) else group["code"]
        code = [lists[k].values.to_numpy().view(np.uint64) for k in range(len(lists))]
        cuts = np.flatnonzero(np.concatenate([[True], family[1:] != family[:-1], [True]]))
        a, b = [], []
        for low, high in zip(cuts[:-1], cuts[1:]):
            side = t[low:high] if key[2].as_py() != key[3].as_py() else None
            for i, j in similar_links(code[low:high], comp[low:high], side, percent):
                a.append(ids[low + i])
                b.append(ids[low + j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return work.groupBy("lot", "whole", "t1", "t2").applyInArrow(check, "a long, b long")


def ngram_jaccard_components(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, tile: int = TILE
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    ``docs`` needs ``doc_id`` (whole numbers) and ``text``; other columns are ignored.
    Words are runs of bytes other than white space, A-Z in lower case. A null, empty or
    blank text has no shingles and is linked with nothing; a text with fewer words than
    ``width`` has its whole sequence as its only shingle. ``component_id`` is the smallest
    id reachable by links. Rows that repeat an id are each returned; what any of their texts
    is linked with is linked under that id. A null id is returned as its own component
    (null). Empty table, no rows. Shingles are told apart by 64-bit hashes, sets by 128-bit
    ones, different texts of one id by a 64-bit name that takes the id's place.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    name = F.xxhash64("doc_id", F.sha2("text", 256))
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"))
    several = stage(several.where("rows > 1").select("doc_id", F.lit(True).alias("more")), "jaccard-several")
    if several.isEmpty():
        return set_components(docs, width, percent, tile)
    # every text of such an id is a document of its own, then the id's components are one
    key = F.when(F.col("more"), name).otherwise(F.col("doc_id"))
    keyed = stage(docs.join(several, "doc_id", "left").select(key.alias("key"), "doc_id", "text", "more"), "jaccard-keyed")
    alone = keyed.where("more is null and key is not null").select("key", "text")
    alone = alone.unionByName(keyed.where("more").select("key", "text").dropDuplicates(["key"]))
    found = set_components(alone.withColumnRenamed("key", "doc_id"), width, percent, tile)
    found = found.withColumnRenamed("doc_id", "key")
    rows = stage(keyed.select("key", "doc_id").join(found, "key", "left"), "jaccard-rows")
    owned = rows.join(several, "doc_id", "left_semi").select("doc_id", "component_id").distinct()
    first = owned.groupBy("doc_id").agg(F.min("component_id").alias("a"))
    again = owned.join(first, "doc_id").where("component_id <> a").select("a", F.col("component_id").alias("b"))
    merged = stage(connected_components(stage(again.distinct(), "jaccard-again")), "jaccard-merged")
    rows = rows.join(merged, rows.component_id == merged.id, "left")
    rows = rows.withColumn("whole", F.coalesce("component", "component_id"))
    smallest = rows.where("doc_id is not null").groupBy("whole").agg(F.min("doc_id").alias("smallest"))
    known = rows.where("doc_id is not null").join(smallest, "whole")
    known = known.select("doc_id", "n_shingles", F.col("smallest").alias("component_id"))
    # rows without an id are in no component
    sets = describe_sets(docs.where("doc_id is null"), width, percent, np.zeros(0, np.uint64))
    none = sets.select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return known.unionByName(none)


def set_components(docs: DataFrame, width: int, percent: int, tile: int) -> DataFrame:
    """The same for documents of which no two rows have an id in common, null ids aside.

    All Python work is done when this returns: what it returns joins staged tables.
    """
    with arrow_batches(docs.sparkSession, BATCH):
        sets, comps = sets_and_components(docs, width, percent, tile)
    return sets.join(comps, sets.doc_id == comps.id, "left").select(
        sets.doc_id, F.col("n").alias("n_shingles"), F.coalesce("component", sets.doc_id).alias("component_id")
    )


def sets_and_components(docs: DataFrame, width: int, percent: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """The staged sets of ``describe_sets`` and the staged components of their ids."""
    common = common_shingles(docs, width)
    sets = stage(describe_sets(docs, width, percent, common), "jaccard")
    known = sets.where("doc_id is not null and n > 0")
    names = known.groupBy("name").agg(F.min("doc_id").alias("first"))
    same = known.join(names, "name").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    same = stage(same, "jaccard-same")

    per_bucket = Window.partitionBy("s")
    met = (
        known.where("prefix is not null")
        .select(F.posexplode("prefix").alias("at", "s"), "doc_id", "n")
        # the smaller set of a pair has their first common shingle this early; size and mark
        # are one number, as most of the shuffle is these rows
        .select("s", "doc_id", F.expr(f"2 * n + int(at <= n * {100 - percent} div {100 + percent})").alias("marked"))
        .repartition("s")
        .select("s", "doc_id", F.expr("shiftright(marked, 1)").alias("n"), F.expr("marked % 2").alias("early"))
        .withColumn("hub", F.min(F.struct("doc_id", "n")).over(per_bucket))
        .withColumn("last", F.max("doc_id").over(per_bucket))
        # buckets of the same members are one bucket
        .withColumn("members", F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).over(per_bucket))
        .withColumn("some_early", F.max("early").over(per_bucket))
        .where("hub.doc_id <> last and some_early = 1")
        .select("s", "doc_id", "n", "members", F.col("hub.doc_id").alias("hub"), F.col("hub.n").alias("hub_n"))
    )
    met = stage(met, "jaccard-met")
    fits = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
    stars = met.where((F.col("doc_id") != F.col("hub")) & fits).select(
        F.col("hub").alias("a"), F.col("doc_id").alias("b")
    )
    bits = known.where("prefix is not null").select("doc_id", "n", "bits")
    stars = stars.distinct().join(same, ["a", "b"], "left_anti")
    stars = stage(within_bound(stars, bits, percent), "jaccard-stars")
    links = stage(verify(stars, docs, width, percent).unionByName(same), "jaccard-links")
    comps = stage(connected_components(links), "jaccard-comps")

    label = F.coalesce("component", "doc_id").alias("comp")
    labelled = met.join(comps, met.doc_id == comps.id, "left").select("s", "members", "doc_id", "n", label)
    mixed = labelled.groupBy("members").agg(
        F.min("s").alias("s"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
    )
    mixed = mixed.where("lo <> hi").select("s")
    members = labelled.join(mixed, "s", "left_semi").select(F.col("s").alias("bucket"), "doc_id", "n", "comp")
    members = with_partners(stage(members, "jaccard-members"), percent)
    rest = stage(open_links(members, bits.drop("n"), percent, tile), "jaccard-open")
    if not rest.isEmpty():
        more = verified_links(rest, known, comps, docs, width, percent, max(tile // 4, 1))
        links = stage(links.unionByName(more), "jaccard-links")
        comps = stage(connected_components(links), "jaccard-comps")
    return sets, comps
