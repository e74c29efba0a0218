"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a text are its words, the shapes of its tokens ("Aa", "A!!", "a$$$") and a mark
for a word that repeats the one before. Log counts times inverse document frequency are
projected on the leading singular vectors of the labelled texts. The labelled vectors, of
a bounded number, go to every task; each text's cosines with all of them are exact blocked
products, and its nearest neighbours vote with their similarity. The space is fitted in a
task, and the driver only holds its directions and the labelled vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skilldemand.llm import hashing as H
from skilldemand.llm.nnpu import bounded_sample

PER_CLASS = 2_000  # labelled rows of each class that are fitted on at most
TERMS = 2_048
LEAST_ROWS = 4  # labelled texts that a term must occur in
RANK = 64
NEIGHBOURS = 25
BLOCK = 1_024

SHAPES = np.arange(256, dtype=np.uint8)
SHAPES[list(H.SPACES)] = 32
SHAPES[48:58] = ord("0")
SHAPES[65:91] = ord("A")
SHAPES[97:123] = ord("a")
SHAPES[128:] = ord("a")
RUNS = np.zeros(256, bool)
RUNS[[ord("0"), ord("A"), ord("a")]] = True
SALT = np.uint64(0x5851F42D4C957F2D)
REPEAT = np.uint64(0x14057B7EF767814F)


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every term of some texts: words, shapes, marks of repeats."""
    words, rows, _ = H.tokens(data, offsets, H.LETTERS)
    again = np.flatnonzero((words[1:] == words[:-1]) & (rows[1:] == rows[:-1])) + 1
    shape = SHAPES[data]
    keep = np.ones(len(shape), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | ~RUNS[shape[1:]]
    starts = offsets[:-1][offsets[:-1] < len(shape)]
    keep[starts] = True
    short = np.append(0, np.cumsum(keep))[offsets]
    forms, form_rows, _ = H.tokens(shape[keep], short, H.EXACT_WORDS)
    code = np.concatenate([words, forms ^ SALT, np.full(len(again), REPEAT)])
    return code, np.concatenate([rows, form_rows, rows[again]])


def term_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, label, terms, counts``: the distinct terms of every text."""

    def count(batches):
        for batch in batches:
            for low, data, offsets in H.slices(batch.column(2)):
                n = len(offsets) - 1
                code, rows = terms_of(data, offsets)
                order = np.lexsort((code, rows))
                code, rows = code[order], rows[order]
                new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (rows[1:] != rows[:-1]))) if len(code) else order
                times = np.diff(np.append(new, len(code)))
                bounds = pa.array(H.row_bounds(rows[new], n), pa.int64())
                lists = [pa.LargeListArray.from_arrays(bounds, v) for v in (code[new].view(np.int64), times)]
                lists = [v.cast(pa.list_(pa.int64())) for v in lists]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, n), batch.column(1).slice(low, n), *lists],
                    ["doc_id", "label", "terms", "counts"],
                )

    return docs.select("doc_id", "label", "text").mapInArrow(
        count, "doc_id long, label int, terms array<long>, counts array<long>"
    )


class LatentSpace:
    """Weights of terms and leading directions, from the counts of labelled texts.

    Text ``r`` has ``times[bounds[r]:bounds[r + 1]]`` of the terms at those places of ``at``.
    Only a block of texts is ever a dense matrix.
    """

    def __init__(self, terms: np.ndarray, bounds: np.ndarray, at: np.ndarray, times: np.ndarray, rank: int):
        n = len(bounds) - 1
        self.lookup = H.Lookup(terms, np.arange(len(terms)))
        self.width = len(terms)
        self.idf = np.log((1 + n) / (1 + np.bincount(at, minlength=self.width))) + 1
        gram = np.zeros((self.width, self.width), np.float32)
        for counts in self._blocks(bounds, at, times):
            weighted = self._weigh(counts)
            gram += weighted.T @ weighted
        values, vectors = np.linalg.eigh(gram) if len(terms) and n else (np.zeros(0), np.zeros((len(terms), 0)))
        lead = np.argsort(values)[::-1][:rank]
        self.axes = vectors[:, lead[values[lead] > 1e-6]].astype(np.float32)
        fitted = [self.vectors(counts) for counts in self._blocks(bounds, at, times)]
        self.fitted = np.concatenate([np.zeros((0, self.axes.shape[1]), np.float32), *fitted])

    @classmethod
    def of(cls, terms: np.ndarray, idf: np.ndarray, axes: np.ndarray) -> LatentSpace:
        """A space that was fitted elsewhere, without the texts it was fitted on."""
        space = cls.__new__(cls)
        space.lookup, space.width = H.Lookup(terms, np.arange(len(terms))), len(terms)
        space.idf, space.axes, space.fitted = idf, axes, None
        return space

    def _blocks(self, bounds: np.ndarray, at: np.ndarray, times: np.ndarray) -> Iterator[np.ndarray]:
        for low in range(0, len(bounds) - 1, BLOCK):
            own = bounds[low : low + BLOCK + 1]
            counts = np.zeros((len(own) - 1, self.width), np.float32)
            rows = np.repeat(np.arange(len(own) - 1), np.diff(own))
            counts[rows, at[own[0] : own[-1]]] = times[own[0] : own[-1]]
            yield counts

    def _weigh(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counts) * self.idf).astype(np.float32)

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors; a text without known terms has none and stays zero."""
        return unit(self._weigh(counts) @ self.axes).astype(np.float32)

    def count(self, code: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        at = self.lookup.at(code)
        known = at >= 0
        flat = rows[known] * self.width + at[known]
        return np.bincount(flat, minlength=n * self.width).reshape(n, self.width) if self.width else np.zeros((n, 0))


def fitted_space(kept: DataFrame, terms: np.ndarray, rank: int) -> tuple[LatentSpace, np.ndarray, np.ndarray]:
    """The space of labelled texts, ``doc_id, label, i, c``; their vectors and labels by ``doc_id``.

    One task fits it: the texts are a bounded sample, and the matrices of a fit would be most of
    the driver's Python memory.
    """

    def fit(batches):
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        sizes = pc.fill_null(pc.list_value_length(table["i"]), 0).to_numpy()
        at, times = (pc.list_flatten(table[c]).to_numpy() for c in ("i", "c"))
        space = LatentSpace(terms, np.append(0, np.cumsum(sizes)), at, times, rank)
        arrays = (space.idf, space.axes, space.fitted, table["label"].to_numpy().astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], ["idf", "axes", "fitted", "labels"])

    rows = kept.repartition(1).sortWithinPartitions("doc_id").select("label", "i", "c")
    found = rows.mapInArrow(fit, "idf binary, axes binary, fitted binary, labels binary").first()
    if found is None:
        empty = np.zeros(0, np.int64)
        space = LatentSpace(terms, np.zeros(1, np.int64), empty, empty, rank)
        return space, space.fitted, np.zeros(0)
    axes = np.frombuffer(found["axes"], np.float32).reshape(len(terms), -1) if len(terms) else np.zeros((0, 0), np.float32)
    marked = np.frombuffer(found["labels"], np.float64)
    known = np.frombuffer(found["fitted"], np.float32).reshape(len(marked), axes.shape[1])
    return LatentSpace.of(terms, np.frombuffer(found["idf"], np.float64), axes), known, marked


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


def vote(queries: np.ndarray, known: np.ndarray, labels: np.ndarray, k: int, prior: float) -> np.ndarray:
    """Share of label 1 among the ``k`` nearest, weighted by similarity; exact, block by block.

    Neighbours of no or negative similarity do not vote; without voters the score is the
    prior. Of equally near neighbours at the end of the list, any may be left out.
    """
    out = np.full(len(queries), prior)
    if not len(known) or not queries.shape[1]:
        return out
    k = min(k, len(known))
    for low in range(0, len(queries), BLOCK):
        near = queries[low : low + BLOCK] @ known.T
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(near, top, axis=1), 0, None).astype(np.float64)
        weight = np.where(weight > 1e-6, weight, 0) ** 4
        total = weight.sum(axis=1)
        has = total > 0
        out[low : low + BLOCK][has] = (weight * labels[top]).sum(axis=1)[has] / total[has]
    return np.clip(out, 0, 1)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = PER_CLASS,
    terms: int = TERMS,
    rank: int = RANK,
    neighbours: int = NEIGHBOURS,
    threshold: float = 0.5,
    seed: int = 0,
) -> DataFrame:
    """``doc_id, score, predicted``: one row per row of ``docs``, from its whole text alone.

    ``labels`` has ``doc_id`` and ``quality`` (0 or 1). At most ``per_class`` labelled
    documents of each class become neighbours; the space has at most ``terms`` terms. Null
    texts count as empty; an empty text, or one without a known term, gets the share of
    1 among the neighbours; 0.5 if nothing is labelled. Ids labelled twice have their higher
    label; null ids are scored but not learnt from. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = labels.where("doc_id is not null and quality in (0, 1)")
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    picked = None
    for value in (0, 1):
        own = bounded_sample(marks.where(F.col("label") == value).join(docs.select("doc_id"), "doc_id", "left_semi"), per_class, seed)
        own = own.withColumn("label", F.lit(value))
        picked = own if picked is None else picked.unionByName(own)
    chosen = docs.join(F.broadcast(picked), "doc_id")  # 2 * per_class ids
    seen = term_counts(chosen).dropDuplicates(["doc_id"]).persist()
    try:
        used = seen.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
        used = used.where(F.col("n") >= LEAST_ROWS).orderBy(F.desc("n"), "t").limit(terms).select("t").toArrow()
        names = np.sort(used["t"].to_numpy())
        index = pa.table({"t": names, "i": np.arange(len(names), dtype=np.int32)})
        index = F.broadcast(seen.sparkSession.createDataFrame(index))
        pairs = seen.select("doc_id", F.explode(F.arrays_zip("terms", "counts")).alias("p"))
        pairs = pairs.select("doc_id", F.col("p.terms").alias("t"), F.col("p.counts").cast("int").alias("c")).join(index, "t")
        kept = pairs.groupBy("doc_id").agg(F.collect_list(F.struct("i", "c")).alias("p"))
        kept = seen.select("doc_id", "label").join(kept, "doc_id", "left")
        kept = kept.select("doc_id", "label", F.col("p.i").alias("i"), F.col("p.c").alias("c"))
        space, known, marked = fitted_space(kept, names, rank)
    finally:
        seen.unpersist()
    prior = float(marked.mean()) if len(marked) else 0.5

    def score(batches):
        for batch in batches:
            for low, data, offsets in H.slices(batch.column(1)):
                n = len(offsets) - 1
                code, rows = terms_of(data, offsets)
                order = np.argsort(rows, kind="stable")
                bounds = H.row_bounds(rows[order], n)
                value = np.full(n, prior)
                for a in range(0, n, BLOCK):
                    b = min(a + BLOCK, n)
                    part = order[bounds[a] : bounds[b]]
                    value[a:b] = vote(
                        space.vectors(space.count(code[part], rows[part] - a, b - a)), known, marked, neighbours, prior
                    )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, n), pa.array(value), pa.array((value >= threshold).astype(np.int32))],
                    ["doc_id", "score", "predicted"],
                )

    return docs.mapInArrow(score, "doc_id long, score double, predicted int")
