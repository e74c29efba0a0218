"""Hard negatives by coordinate pruning of an exact inner-product search.

All vectors lie in length buckets: runs of rows in order of their length, each with a
sorted list of values per coordinate. For an anchor, a score to reach and a bucket's greatest
length, every coordinate of a vector that can reach the score lies in a range that has a
closed form; for the anchor's focus coordinates, those that it is strongest in, the ranges
are looked up in the sorted lists and the rows in all of them are the candidates, whose
scores are then computed exactly, in integers. A bucket too short for the score is passed over.

The score to reach is known from the start, from a bounded first bucket of the longest
vectors, and rises while a task goes through its buckets. Anchors come in blocks of a bounded
size against all rows, so a task holds one block, one bucket and the best rows so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skilldemand.llm.common import stage

BLOCK = 1 << 15  # anchors that meet all rows at once
FIRST = 1 << 13  # rows of the first bucket, which only sets scores to reach
BUCKET = 4096
FOCUS = 3  # coordinates whose ranges are intersected
ANCHORS_AT_ONCE = 128  # whose scores with a bucket are held at once; of them only the best rows stay
EXACT = float(1 << 53)
POSITIVES = 5
NEGATIVES = 10
LEAST, MOST = -(1 << 62), 1 << 62


def feasible(anchors: np.ndarray, lengths: np.ndarray, longest: float, reach: np.ndarray, at: np.ndarray):
    """Least and greatest value of coordinates ``at`` in vectors of a score of ``reach`` or more.

    The vectors' length is ``longest`` at most. With a the angle between the anchor and the axis
    and b the greatest angle to the anchor, the vector's angle to the axis is within a - b and
    a + b. A reach out of reach gives an empty range.
    """
    with np.errstate(over="ignore"):
        share = reach / np.maximum(lengths * longest, 1e-300)
        axis = np.arccos(np.clip(np.take_along_axis(anchors, at, 1) / np.maximum(lengths, 1e-300)[:, None], -1, 1))
    wide = np.arccos(np.clip(share, -1, 1))[:, None]
    low = longest * np.cos(np.minimum(axis + wide, np.pi))
    high = longest * np.cos(np.maximum(axis - wide, 0))
    slack = 1e-6 * (longest + 1)  # for rounding
    none = share > 1 + 1e-9
    low[none], high[none] = np.inf, -np.inf
    return low - slack, high + slack


class Bucket:
    """Rows of similar length with a sorted list of values for each coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.longest = float(np.sqrt((vectors.astype(float) ** 2).sum(axis=1).max(initial=0)))
        self.lists = np.sort(vectors, axis=0)

    def candidates(self, anchors: np.ndarray, lengths: np.ndarray, reach: np.ndarray, focus: int) -> np.ndarray:
        """For each anchor, the rows in the feasible ranges of its focus coordinates."""
        out = np.ones((len(anchors), len(self.ids)), bool)
        width = anchors.shape[1]
        if width == 0 or not len(anchors):
            return out
        focus = min(focus, width)
        at = np.argpartition(-np.abs(anchors), focus - 1, axis=1)[:, :focus]
        low, high = feasible(anchors.astype(float), lengths, self.longest, reach, at)
        for c in np.unique(at):
            rows, k = np.nonzero(at == c)
            values = self.lists[:, c]
            first = np.searchsorted(values, low[rows, k], side="left")
            last = np.searchsorted(values, high[rows, k], side="right")
            for row, a, b in zip(rows, first, last):
                if b <= a:
                    out[row] = False
                elif b - a < len(values):
                    out[row] &= (self.vectors[:, c] >= values[a]) & (self.vectors[:, c] <= values[b - 1])
        return out


def products(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices."""
    lengths = [np.sqrt((m.astype(float) ** 2).sum(axis=1).max(initial=0)) for m in (one, two)]
    if lengths[0] * lengths[1] < EXACT:
        return (one.astype(float) @ two.astype(float).T).astype(np.int64)
    if lengths[0] * lengths[1] < 2.0**62:
        return one @ two.T
    raise OverflowError("inner products beyond 62 bits")


class Search:
    """The best rows of anchors' bands of scores, over any number of buckets.

    ``low`` and ``high`` have a band per column; a row counts for a band if its score is in
    it, its label is the anchor's (``same``) or another one, and its id is not the anchor's.
    """

    def __init__(self, ids, labels, vectors, low, high, same: bool, k: int, focus: int = FOCUS):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.low, self.high, self.same, self.k, self.focus = low.copy(), high, same, k, focus
        self.lengths = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        self.best = np.zeros((0, 4), np.int64)  # anchor, band, score, id

    def add(self, bucket: Bucket) -> None:
        found = [np.zeros((0, 4), np.int64)]
        for start in range(0, len(self.ids), ANCHORS_AT_ONCE):
            some = slice(start, min(start + ANCHORS_AT_ONCE, len(self.ids)))
            reach = self.low[some].min(axis=1).astype(float)
            ok = bucket.candidates(self.vectors[some], self.lengths[some], reach, self.focus)
            matches = self.labels[some][:, None] == bucket.labels[None, :]
            ok &= matches if self.same else ~matches
            ok &= self.ids[some][:, None] != bucket.ids[None, :]
            rows = np.flatnonzero(ok.any(axis=0))
            if not len(rows):
                continue
            scores = products(self.vectors[some], bucket.vectors[rows])
            a, r = np.nonzero(ok[:, rows] & (scores >= self.low[some].min(axis=1)[:, None]))
            score = scores[a, r]
            for band in range(self.low.shape[1]):
                fits = np.flatnonzero((score >= self.low[a + start, band]) & (score <= self.high[a + start, band]))
                fits = fits[self._foremost(a[fits], score[fits], *scores.shape)]
                found.append(self._first(np.stack([a[fits] + start, np.full(len(fits), band), score[fits], bucket.ids[rows[r[fits]]]], axis=1)))
        self._keep(np.concatenate([self.best, *found]))

    def _foremost(self, a: np.ndarray, score: np.ndarray, n: int, width: int) -> np.ndarray:
        """Which of many matches may be among the best ``k`` of their anchor; ties with the last of them stay."""
        if len(a) <= 8 * self.k * n or width <= self.k:
            return np.ones(len(a), bool)
        place = np.arange(len(a)) - np.searchsorted(a, a)  # matches come in order of their anchors
        dense = np.full((n, place.max() + 1), LEAST)
        dense[a, place] = score
        if dense.shape[1] <= self.k:
            return np.ones(len(a), bool)
        return score >= np.partition(dense, -self.k, axis=1)[a, -self.k]

    def _first(self, rows: np.ndarray) -> np.ndarray:
        """The best ``k`` rows of each anchor and band, in order."""
        if not len(rows):
            return rows
        rows = rows[np.lexsort((rows[:, 3], -rows[:, 2], rows[:, 1], rows[:, 0]))]
        group = rows[:, 0] * self.low.shape[1] + rows[:, 1]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        return rows[np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows)))) < self.k]

    def _keep(self, rows: np.ndarray) -> None:
        self.best = rows = self._first(rows)
        # a band with k rows need not look below the last of them
        group = rows[:, 0] * self.low.shape[1] + rows[:, 1]
        full = np.flatnonzero(group[self.k - 1 :] == group[: max(0, len(group) - self.k + 1)]) + self.k - 1
        last = rows[full]
        self.low[last[:, 0], last[:, 1]] = np.maximum(self.low[last[:, 0], last[:, 1]], last[:, 2])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def buckets(batches, width: int, size: int = BUCKET) -> Iterator[Bucket]:
    for batch in batches:
        for low in range(0, batch.num_rows, size):
            part = batch.slice(low, size)
            yield Bucket(part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2), width))


def search(rows: DataFrame, first: Bucket, anchors: tuple, low, high, same: bool, k: int, width: int) -> DataFrame:
    """``anchor, band, score, id``: candidates that hold the best ``k`` of each band, by tasks."""
    start = Search(*anchors, low, high, same, k)
    start.add(first)
    reach = start.low

    def run(batches):
        ours = Search(*anchors, reach, high, same, k)
        for bucket in buckets(batches, width):
            ours.add(bucket)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ours.best[:, i]) for i in range(4)], ["anchor", "band", "score", "id"]
        )

    found = rows.mapInArrow(run, "anchor long, band long, score long, id long")
    order = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def prepared(vectors: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """Rows that take part: ``id, label, q`` (whole numbers), ``len2`` (the square of the length)."""
    component = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(component, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & F.col(key).isNotNull() & F.coalesce(sound, F.lit(False)))
    q = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), q.alias("q"))
    return rows.withColumn("len2", F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def hard_negatives(
    vectors: DataFrame,
    anchors: str = "id % 100 = 0",
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = 256,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = 30,
    most: int = 90,
    block: int = BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` needs an id, a label and an array of numbers; other columns are ignored.
    Components become floor(``scale`` x); the score of two rows is their inner product, higher
    is better, ties go to the smaller id. ``anchors`` is a condition on ``id`` (and ``label``).
    The ``positives`` of an anchor are its best rows of its label; for each of them the first
    ``negatives`` rows of other labels with a score from ``least`` to ``most`` hundredths of
    the positive's are returned, none where no row has one. Rows without id, label or vector,
    or with a null or non-finite component, take no part. All vectors must have one length.
    Rows that share an anchor's id are never its positives or negatives; other rows that
    repeat each count. Rows that repeat an anchor with the same label and vector give its
    results once, with another label or vector their own. Empty table, no rows.
    """
    rows = prepared(vectors, key, vector, label, scale)
    ordered = rows.withColumn("spread", F.xxhash64("id")).repartitionByRange(F.desc("len2"), "spread")
    rows = stage(ordered.sortWithinPartitions(F.desc("len2"), "spread").select("id", "label", "q", "len2"), "vectors")
    widths = rows.agg(F.min(F.size("q")), F.max(F.size("q"))).first()
    if widths[0] != widths[1]:
        raise ValueError(f"vectors of {widths[0]} to {widths[1]} components")
    width = widths[0] or 0
    longest = rows.orderBy(F.desc("len2"), "id").limit(FIRST).select("id", "label", "q").toArrow()
    first = next(buckets(longest.combine_chunks().to_batches(max_chunksize=FIRST), width, FIRST), None)
    chosen = rows.where(anchors).select("id", "label", "q").distinct()
    n_blocks = max(1, -(-chosen.count() // block))
    parts = []
    if first is not None:
        chosen = chosen.withColumn("block", F.pmod(F.xxhash64("id", "label"), F.lit(n_blocks)))
        chosen = stage(chosen, "anchors") if n_blocks > 1 else chosen
        data = rows.select("id", "label", "q")
        for i in range(n_blocks):
            taken = chosen.where(F.col("block") == i).select("id", "label", "q").toArrow().combine_chunks()
            if taken.num_rows:
                part = block_negatives(data, first, taken, width, positives, negatives, least, most)
                # a plan holds its block's anchors, so of many blocks only the results stay
                parts.append(stage(part, "negatives") if n_blocks > 1 else part)
    if not parts:
        kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return vectors.sparkSession.createDataFrame([], kinds)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def block_negatives(data, first, taken, width, positives, negatives, least, most) -> DataFrame:
    """The hard negatives of one block of anchors."""
    spark = data.sparkSession
    ids, labels = taken["id"].to_numpy(), taken["label"].to_numpy()
    anchors = (ids, labels, matrix(taken["q"], width))
    n = len(ids)
    found = search(data, first, anchors, np.full((n, 1), LEAST), np.full((n, 1), MOST), True, positives, width)
    found = stage(found.select("anchor", "place", "score", "id"), "positives")
    # at most ``positives`` rows for each anchor of the block
    best = found.toArrow().to_pandas()
    score = np.zeros((n, positives), np.int64)
    has = np.zeros((n, positives), bool)
    score[best["anchor"], best["place"] - 1] = best["score"]
    has[best["anchor"], best["place"] - 1] = True
    low = np.where(has, -(-least * score // 100), MOST)
    high = np.where(has, most * score // 100, LEAST)
    held = search(data, first, anchors, low, high, False, negatives, width)
    names = spark.createDataFrame(pa.table({"anchor": pa.array(np.arange(n)), "anchor_id": pa.array(ids)}))
    pairs = found.select("anchor", (F.col("place") - 1).cast("long").alias("band"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    joined = held.join(pairs, ["anchor", "band"]).join(names, "anchor")
    return joined.select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
