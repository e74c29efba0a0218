"""Prediction by partial matching: byte contexts, escapes, symbol exclusion.

The trie of a corpus is a table: one row per context of up to four bytes and next byte,
with its count. Contexts and counts come from all training rows. Scoring asks the table
only for what a chunk of documents contains: every chunk lists its distinct five-byte
windows and words once, Spark joins those lists with the counts, and each chunk's answers
meet its texts again by the chunk's number. No model is broadcast or collected, so it may
grow with the corpus.

Probability of a byte after a context (escape method C): the longest context seen in
training gives a byte it knows ``n / (N + Q)``, where N counts all its bytes and Q its
distinct ones, and escapes with ``Q / (N + Q)``. A shorter context then leaves out the
bytes that the longer one knows, from its N and its Q. Below the empty context, the bytes
nobody has seen share the rest evenly. Texts begin after four 0xFF bytes and end with
0xFE; neither occurs in UTF-8.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skilldemand.llm import hashing as H
from skilldemand.llm.common import stage

ORDER = 4
BEGIN, END = 0xFF, 0xFE
CHUNK = 20 << 20  # bytes of text whose windows and words are asked for together
WINDOW, WORD = 0, 1
END_WORD = 0  # the key of the token that ends a text
PIECE = 1 << 20


def padded(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each with ``order`` begin bytes before and an end byte after it."""
    size = np.diff(offsets)
    begins = np.arange(len(size)) * (order + 1) + offsets[:-1]
    out = np.full(len(data) + len(size) * (order + 1), BEGIN, np.uint8)
    shift = np.repeat(begins + order - offsets[:-1], size)
    out[np.arange(len(data)) + shift] = data
    out[begins + order + size] = END
    return out, np.append(begins, len(out))


def windows(buffer: np.ndarray, order: int):
    """Position of the last byte and code of every window of ``order + 1`` bytes, by pieces."""
    for low in range(0, len(buffer) - order, PIECE):
        part = buffer[low : low + PIECE + order].astype(np.int64)
        code = np.zeros(len(part) - order, np.int64)
        for i in range(order + 1):
            code = (code << 8) | part[i : len(part) - order + i]
        yield low + order, code


class Tally:
    """Counts of 64-bit keys, merged now and then; a key that was only named counts 0."""

    def __init__(self):
        self.keys, self.counts, self.size, self.merged = [], [], 0, 0

    def add(self, keys: np.ndarray, learnt: np.ndarray) -> None:
        value, count = H.counted(keys[learnt])
        named, _ = H.counted(keys[~learnt])
        self.keys += [value, named]
        self.counts += [count, np.zeros(len(named), np.int64)]
        self.size += len(value) + len(named)
        if self.size > 2 * self.merged + (4 << 20):
            self.close()

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
        self.keys = [keys[first]]
        self.counts = [np.add.reduceat(counts, first) if len(first) else counts]
        self.size = self.merged = len(first)
        return self.keys[0], self.counts[0]


def asked(texts: pa.Array, train: np.ndarray, order: int):
    """Distinct windows and words of some texts, each with its count in the training ones."""
    found, words = Tally(), Tally()
    for low, data, offsets in H.slices(texts):
        n = len(offsets) - 1
        learn = train[low : low + n]
        buffer, begins = padded(data, offsets, order)
        learnt = np.repeat(learn, np.diff(begins))
        for at, code in windows(buffer, order):
            real = buffer[at : at + len(code)] != BEGIN
            found.add(code[real], learnt[at : at + len(code)][real])
        hashes, rows, _ = H.tokens(data, offsets)
        words.add(hashes.view(np.int64), learn[rows])
        words.add(np.full(n, END_WORD, np.int64), learn)
    return found.close(), words.close()


def window_table(counts: DataFrame, order: int) -> DataFrame:
    """``key, value``: log10 probability of the last byte of every window.

    ``counts`` has ``key`` and ``n``, the count in the training rows, which may be 0.
    """
    levels = [counts.select("key", "n")]
    for k in range(order - 1, -1, -1):
        short = F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("key")
        levels.insert(0, levels[0].groupBy(short).agg(F.sum("n").alias("n")))
    known = None
    for k, level in enumerate(levels):
        here = level.select(
            F.col("key").alias(f"key{k}"), F.col("n").alias(f"n{k}"), F.shiftright("key", 8).alias("context")
        )
        by_context = Window.partitionBy("context")
        seen = F.when(F.col(f"n{k}") > 0, 1).otherwise(0)
        if known is not None:
            mask = F.lit((1 << 8 * k) - 1)
            here = here.withColumn("short", F.col(f"key{k}").bitwiseAND(mask))
            here = here.join(known, F.col("short") == F.col(f"key{k - 1}")).drop("short", f"key{k - 1}")
            here = here.withColumn(f"e{k}", F.sum(seen * F.col(f"n{k - 1}")).over(by_context))
        here = here.withColumn(f"N{k}_", F.sum(f"n{k}").over(by_context))
        here = here.withColumn(f"Q{k}_", F.sum(seen).over(by_context))
        known = here.drop("context")
    value, done = F.lit(0.0), F.lit(False)
    log = lambda c: F.log10(c.cast("double"))
    branches = []  # (condition that the byte is coded here, its log probability)
    for k in range(order, -1, -1):
        left = F.col(f"N{k}_") - (F.col(f"e{k + 1}") if k < order else F.lit(0))
        distinct = F.col(f"Q{k}_") - (F.col(f"Q{k + 1}_") if k < order else F.lit(0))
        total = left + distinct
        branches.append((F.col(f"n{k}") > 0, value + log(F.col(f"n{k}")) - log(total)))
        value = value + F.when(total > 0, log(distinct) - log(total)).otherwise(F.lit(0.0))
    chosen = value - log(F.lit(256) - F.col("Q0_"))
    for condition, amount in reversed(branches):
        chosen = F.when(condition, amount).otherwise(chosen)
    return known.select(F.col(f"key{order}").alias("key"), chosen.alias("value"))


def ppm_scores(docs: DataFrame, train: Column, order: int = ORDER, chunk: int = CHUNK) -> DataFrame:
    """Score whole texts with a model of the rows where ``train`` holds.

    Returns ``doc_id, n_tokens, n_known, train_tokens, base_score, score``, one row per
    input row. ``score`` is the log10 probability of the text and its end under the
    pretrained trie; ``base_score`` that of its tokens (lower-case words and one end)
    by counts with a half added. A null text counts as empty: one end token. A null
    ``train`` is false; without training rows all bytes are equally likely. Repeated rows
    are scored, and learnt from, as often as they occur. Other columns are ignored.
    Words are told apart by 64-bit hashes.
    """
    docs = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    volume = docs.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    chunks = max(1, math.ceil(volume / chunk))
    number = F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(chunks))
    docs = docs.withColumn("chunk", number.cast("int"))

    def requests(key, group):
        train = np.asarray(group["train"].to_numpy(), bool)
        parts = []
        for kind, (value, count) in enumerate(asked(group["text"], train, order)):
            parts.append(
                pa.table(
                    {
                        "chunk": pa.array(np.full(len(value), key[0].as_py(), np.int32)),
                        "kind": pa.array(np.full(len(value), kind, np.int8)),
                        "key": pa.array(value),
                        "n": pa.array(count),
                    }
                )
            )
        return pa.concat_tables(parts)

    lists = stage(
        docs.groupBy("chunk").applyInArrow(requests, "chunk int, kind byte, key long, n long"), "ppm-asked"
    )
    counts = stage(lists.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ppm-counts")
    words = counts.where(F.col("kind") == WORD)
    totals = words.agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("distinct")).first()
    total, distinct = totals.total or 0, totals.distinct or 0
    answers = window_table(counts.where(F.col("kind") == WINDOW), order).select(
        F.lit(WINDOW).cast("byte").alias("kind"), "key", "value"
    )
    answers = answers.unionByName(words.select("kind", "key", F.col("n").cast("double").alias("value")))
    told = lists.select("chunk", "kind", "key").join(answers, ["kind", "key"])

    def score(key, group, known):
        kind, keys, values = (known[c].to_numpy() for c in ("kind", "key", "value"))
        tables = [H.Lookup(keys[kind == k], values[kind == k]) for k in (WINDOW, WORD)]
        out = score_texts(group["text"], tables, order, total, distinct)
        return pa.table({"doc_id": group["doc_id"], **out, "train_tokens": pa.array(np.full(len(out["score"]), total))})

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, train_tokens long"
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, schema)


def score_texts(texts, tables, order: int, total: int, distinct: int) -> dict[str, np.ndarray]:
    logs, names = tables
    n_all = len(texts)
    out = {c: np.zeros(n_all, np.int64) for c in ("n_tokens", "n_known")}
    out |= {c: np.zeros(n_all) for c in ("base_score", "score")}
    for low, data, offsets in H.slices(texts):
        n = len(offsets) - 1
        buffer, begins = padded(data, offsets, order)
        amount = np.zeros(len(buffer))
        for at, code in windows(buffer, order):
            real = buffer[at : at + len(code)] != BEGIN
            amount[at : at + len(code)][real] = logs.get(code[real])
        out["score"][low : low + n] = np.add.reduceat(amount, begins[:-1])
        hashes, rows, _ = H.tokens(data, offsets)
        rows = np.concatenate([rows, np.arange(n)])
        count = names.get(np.concatenate([hashes.view(np.int64), np.full(n, END_WORD, np.int64)]))
        weight = np.log10((count + 0.5) / (total + 0.5 * (distinct + 1)))
        out["n_tokens"][low : low + n] = np.bincount(rows, minlength=n)
        out["n_known"][low : low + n] = np.bincount(rows, count > 0, n).astype(np.int64)
        out["base_score"][low : low + n] = np.bincount(rows, weight, n)
    return out


class Trie:
    """The same model as a dictionary of contexts, for one text at a time."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.next: dict[bytes, dict[int, int]] = defaultdict(lambda: defaultdict(int))

    def learn(self, context: bytes, symbol: int) -> None:
        for k in range(self.order + 1):
            self.next[context[len(context) - k :]][symbol] += 1

    def log10(self, context: bytes, symbol: int) -> float:
        value, barred = 0.0, frozenset()
        for k in range(self.order, -1, -1):
            counts = self.next.get(context[len(context) - k :])
            if not counts:
                continue
            open_ = {s: n for s, n in counts.items() if s not in barred}
            barred = barred | counts.keys()
            if not open_:
                continue
            total = sum(open_.values()) + len(open_)
            if symbol in open_:
                return value + math.log10(open_[symbol]) - math.log10(total)
            value += math.log10(len(open_)) - math.log10(total)
        return value - math.log10(256 - len(barred))

    def walk(self, text: bytes, learn: bool, score: bool = True) -> float:
        """Log10 probability of a text and its end; ``learn``: adapts after every byte."""
        context, value = bytes([BEGIN]) * self.order, 0.0
        for symbol in (*text, END):
            if score:
                value += self.log10(context, symbol)
            if learn:
                self.learn(context, symbol)
            context = (context + bytes([symbol]))[-self.order :] if self.order else b""
        return value


def adaptive_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``doc_id, score``: log10 probability of each text under a trie that starts empty and
    learns as it reads that text alone. A null text counts as empty."""

    def read(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            scores = [Trie(order).walk((t or "").encode(), learn=True) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        read, "doc_id long, score double"
    )
