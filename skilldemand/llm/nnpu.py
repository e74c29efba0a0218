"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all else is unlabelled, toxic or not. With class
prior p, sigmoid loss and a linear score, the risk is ``p R+(positives)`` plus the larger
of 0 and ``R-(unlabelled) - p R-(positives)``: the part of the unlabelled loss that
toxic texts among them explain is taken off, and what is left may not fall below zero.
When it would, the step goes the other way for that part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skilldemand.llm import hashing as H

SAMPLE = 8_000  # confirmed rows, and unlabelled ones, that are fitted on at most
FEATURES = 256  # words and beginnings of words that the score may use
FALSE_SHARE = 0.05  # of the chosen words that may stand out by chance
BEGINNINGS = (4, 6)  # bytes of a word that are a feature of their own, for inflected words


def features_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word and of every beginning of a longer word."""
    words, rows, starts = H.tokens(data, offsets, H.LETTERS)
    mapped = H.LETTERS[data]
    codes, owners = [words], [rows]
    for size in BEGINNINGS:
        fits = starts + size < len(mapped)
        at, row = starts[fits], rows[fits]
        longer = at + size < offsets[row + 1]
        for i in range(1, size + 1):
            longer &= mapped[np.minimum(at + i, len(mapped) - 1)] != 32
        at, row = at[longer], row[longer]
        code = np.zeros(len(at), np.uint64)
        for i in range(size):
            code = (code << np.uint64(8)) | mapped[at + i].astype(np.uint64)
        codes.append(H.mix(code + np.uint64(size)))
        owners.append(row)
    return np.concatenate(codes), np.concatenate(owners)


def distinct_words(docs: DataFrame, keep: str) -> DataFrame:
    """``keep`` and ``words``, the hashes of a text's distinct words."""
    kind = dict(docs.dtypes)[keep]

    def words(batches):
        for batch in batches:
            for low, data, offsets in H.slices(batch.column(1)):
                n = len(offsets) - 1
                code, rows = features_of(data, offsets)
                pair, bounds = distinct_per_row(code, rows, n)
                lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pair.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, n), lists.cast(pa.list_(pa.int64()))], [keep, "words"]
                )

    return docs.select(keep, "text").mapInArrow(words, f"{keep} {kind}, words array<long>")


def distinct_per_row(code: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((code, rows))
    code, rows = code[order], rows[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (rows[1:] != rows[:-1])
    return code[new], H.row_bounds(rows[new], n)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk_gradient(weights: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Direction of the step on some positives ``p`` and unlabelled rows ``u``, without decay.

    The gradient of the risk; where the unlabelled part falls below zero, that of the part
    taken the other way.
    """
    sp, su = sigmoid(p @ weights), sigmoid(u @ weights)
    slope_p, slope_u = (sp * (1 - sp)) @ p / len(p), (su * (1 - su)) @ u / len(u)
    rest = su.mean() - prior * sp.mean()
    grad_rest = slope_u - prior * slope_p
    return -prior * slope_p + grad_rest if rest >= 0 else -grad_rest


def nn_pu_fit(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 60, rate: float = 0.05, decay: float = 1e-4, batch: int = 512, seed: int = 0
) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear score, by Adam on the non-negative risk.

    Rows are 0/1 features. Without positives or unlabelled rows, or features, the score is
    the same for all texts.
    """
    width = positive.shape[1]
    weights = np.zeros(width + 1)
    if not len(positive) or not len(unlabelled):
        return weights[:-1], float(np.log(prior / (1 - prior)))
    rng = np.random.default_rng(seed)
    add_one = lambda x: np.hstack([x, np.ones((len(x), 1))])
    positive, unlabelled = add_one(positive.astype(np.float64)), add_one(unlabelled.astype(np.float64))
    mean, square, step = np.zeros(width + 1), np.zeros(width + 1), 0
    for _ in range(rounds):
        order = rng.permutation(len(unlabelled))
        for low in range(0, len(order), batch):
            u = unlabelled[order[low : low + batch]]
            p = positive[rng.integers(0, len(positive), min(batch, len(positive)))]
            grad = risk_gradient(weights, p, u, prior)
            grad = grad + decay * np.append(weights[:-1], 0)
            step += 1
            mean = 0.9 * mean + 0.1 * grad
            square = 0.999 * square + 0.001 * grad**2
            weights -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return weights[:-1], float(weights[-1])


def bounded_sample(rows: DataFrame, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` ids in a seeded order, the same on every run."""
    order = F.xxhash64(F.lit(seed), "doc_id")
    return rows.select("doc_id").distinct().orderBy(order, "doc_id").limit(limit)


def nn_pu_scores(
    docs: DataFrame,
    labels: DataFrame,
    prior: float | None = None,
    sample: int = SAMPLE,
    features: int = FEATURES,
    threshold: float = 0.3,
    seed: int = 0,
) -> DataFrame:
    """``doc_id, score, predicted``: one row per row of ``docs``, from its whole text alone.

    ``labels`` has ``doc_id`` and ``toxic``; only its rows with 1 are confirmed. The model
    is fitted on at most ``sample`` confirmed documents and ``sample`` of all, whose labels
    are not looked at, over at most
    ``features`` words and beginnings of words, those that stand out most among the confirmed. ``prior`` is the
    share of toxic texts among all; by default that among the rows of ``labels``
    with a value. Features are presences. Null texts count as empty; null
    ids are scored but not learnt from; ids labelled twice are confirmed if any label is;
    of an id with several texts the one with the smallest list of word hashes is learnt from.
    Without confirmed rows all scores equal the prior, 0.01 if nothing is labelled.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = labels.where("doc_id is not null and toxic is not null")
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = marks.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    prior = min(max(prior if prior is not None else 0.01, 0.001), 0.999)
    confirmed = marks.where("toxic = 1")
    picked = bounded_sample(confirmed, sample, seed).withColumn("mark", F.lit(1))
    every = docs.where("doc_id is not null")
    others = bounded_sample(every, sample, seed).withColumn("mark", F.lit(0))
    # twice ``sample`` ids at most, so texts are not shuffled
    chosen = docs.join(F.broadcast(picked.unionByName(others)), "doc_id")
    chosen = chosen.withColumn("key", F.col("doc_id") * 2 + F.col("mark"))
    seen = distinct_words(chosen, "key").groupBy("key").agg(F.min("words").alias("words"))
    seen = seen.withColumn("mark", F.pmod("key", F.lit(2)).cast("int")).persist()
    try:
        sizes = {r.mark: r.n for r in seen.groupBy("mark").agg(F.count("*").alias("n")).collect()}
        n_pos, n_rest = sizes.get(1, 0), sizes.get(0, 0)
        words = standing_out(seen, n_pos, n_rest, features)
        rows = seen.select("mark", "key", F.explode("words").alias("w"))
        used = F.broadcast(seen.sparkSession.createDataFrame([(int(w), i) for i, w in enumerate(words)], "w long, f int"))
        kept = rows.join(used, "w").groupBy("mark", "key").agg(F.collect_list("f").alias("f")).orderBy("key").toArrow()
    finally:
        seen.unpersist()
    matrices = [np.zeros((n, len(words)), np.float32) for n in (n_rest, n_pos)]
    for mark, matrix in enumerate(matrices):  # rows without any of the words stay zero
        lists = kept.filter(pc.equal(kept["mark"], mark))["f"].combine_chunks()
        matrix[np.repeat(np.arange(len(lists)), lists.value_lengths()), lists.flatten()] = 1
    unlabelled, positive = matrices
    weights, bias = nn_pu_fit(positive, unlabelled, prior, seed=seed)
    order = np.argsort(words)
    return apply_scores(docs, words[order], weights[order], bias, threshold)


def standing_out(seen: DataFrame, n_pos: int, n_rest: int, features: int) -> np.ndarray:
    """Words that confirmed texts have more often than chance, the least likely first.

    If a word's texts were confirmed or not by chance alone, ``a`` or more of its ``t`` texts
    would be confirmed with a probability of at most exp(-t KL(a/t, share)). Words are taken as
    far as the share of chance finds among them (Benjamini and Hochberg) allows, so how far
    a word must stand out follows from the number of rows and of words.
    """
    if not n_pos or not n_rest:
        return np.zeros(0, np.int64)
    share = n_pos / (n_pos + n_rest)
    rows = seen.select("mark", F.explode("words").alias("w"))
    counts = rows.groupBy("w").agg(F.sum("mark").alias("a"), F.count("*").alias("t"))
    part = F.col("a") / F.col("t")
    without = F.col("t") - F.col("a")
    chance = -F.col("a") * F.log(part / F.lit(share))
    chance = chance - F.when(without > 0, without * F.log((1 - part) / F.lit(1 - share))).otherwise(0.0)
    likely = F.when(part > share, chance).otherwise(0.0)
    counts = counts.withColumn("p", F.when(F.col("a") > 0, likely).otherwise(0.0)).persist()
    try:
        tested = counts.count()
        top = counts.where("p < 0").orderBy("p", "w").limit(features).toArrow()
    finally:
        counts.unpersist()
    p, rank = top["p"].to_numpy(), np.arange(1, len(top) + 1)
    passed = np.flatnonzero(p <= np.log(FALSE_SHARE * rank / max(tested, 1)))
    return top["w"].to_numpy()[: passed[-1] + 1 if len(passed) else 0]


def apply_scores(docs: DataFrame, words: np.ndarray, weights: np.ndarray, bias: float, threshold: float) -> DataFrame:
    lookup = H.Lookup(words, weights)

    def score(batches):
        for batch in batches:
            for low, data, offsets in H.slices(batch.column(1)):
                n = len(offsets) - 1
                code, rows = features_of(data, offsets)
                hit = lookup.at(code) >= 0
                pair, bounds = distinct_per_row(code[hit], rows[hit], n)
                row = np.repeat(np.arange(n), np.diff(bounds))
                z = np.bincount(row, lookup.get(pair), n) + bias
                value = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, n), pa.array(value), pa.array((value >= threshold).astype(np.int32))],
                    ["doc_id", "score", "predicted"],
                )

    return docs.mapInArrow(score, "doc_id long, score double, predicted int")
