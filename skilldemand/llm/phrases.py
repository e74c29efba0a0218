"""Phrase collocations by top-order marginalisation.

A text's pieces are cut into words, and every word leads one window: itself and the next
words of its piece up to the longest phrase, padded with nulls where the piece ends. Only
these longest windows are counted. A window's count is also one for each of its prefixes,
so ``ROLLUP`` over the columns of the window sums the counts of all shorter phrases, and of
all words of the language, from the same rows: no n-grams of single lengths are made.

Windows end early, too, where no frequent phrase can go on. A phrase found at least
``min_count`` times holds only shorter phrases found as often. The hashes of words and pairs
are counted first, over all texts, then those of triples of frequent pairs, then those of
longer phrases of frequent triples, and the frequent ones are marked in a bit table of a
fixed size; where others share a hash or a bit, windows are longer than they need be and the
counts are the same. Words are compared as texts; hashes only mark, and every count that is
returned comes from the windows.

A task gives an equal window out once. Tasks that grew in number with the texts would each
give out nearly all frequent windows, whose number grows with the texts as well; so the texts
are read in tasks by the cores (``TASKS_A_CORE``), and a task begins anew after ``HELD`` windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skilldemand.llm import hashing as H
from skilldemand.llm.common import stage

LONGEST = 5  # words
MIN_COUNT = 100
TOP = 2000
MARK_BITS = 1 << 26  # of the table of frequent words and phrases: 8 MB whatever the texts
LOW = np.uint64(0xFFFFFFFF)
SLICE = 2 << 20  # bytes of text counted at a time
HELD = 1 << 18  # windows that a task counts before it gives them out
HELD_BYTES = 64 << 20  # of their words
TASKS_A_CORE = 2  # at most, that cut texts into windows
BREAKS = b".,;:!?\n\x0b\x0c\r"  # fixed values: where a text is cut into pieces


def piece_table() -> np.ndarray:
    """What each byte counts as: blanks and breaks become a space, A-Z lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(b" \t" + BREAKS)] = 32
    return table


PIECES = piece_table()
IS_BREAK = np.isin(np.arange(256), list(BREAKS))


def word_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first byte of every word, and whether the next word is in its piece."""
    code, rows, starts = H.tokens(data, offsets, PIECES)
    piece = np.cumsum(IS_BREAK[data])[starts] if len(starts) else starts
    goes_on = np.zeros(len(code), bool)
    goes_on[:-1] = (rows[1:] == rows[:-1]) & (piece[1:] == piece[:-1])
    return code, rows, starts, goes_on


def by_language(batch: pa.RecordBatch):
    """Slices of a batch of texts and languages, with the number of each row's language."""
    langs = batch.column(1).dictionary_encode()
    number = langs.indices.to_numpy(zero_copy_only=False)
    names = langs.dictionary.to_pylist()
    salt = np.array([int(hashlib.blake2b(name.encode(), digest_size=8).hexdigest(), 16) for name in names], np.uint64)
    for low, data, offsets in H.slices(batch.column(0), SLICE):
        yield names, salt, number[low : low + len(offsets) - 1], data, offsets


def marks(code: np.ndarray, goes_on: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in their language, and of each word with the next (0 at a piece's end)."""
    word = H.mix(code ^ salt)
    pair = np.zeros(len(code), np.uint64)
    pair[:-1] = H.mix(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:])
    pair[~goes_on] = 0
    return word, pair


def phrase_marks(
    table: np.ndarray, word: np.ndarray, pair: np.ndarray, joined: np.ndarray, known: int, longest: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 3 to ``longest`` words: hashes of the phrase that each word leads, and whether it may be frequent.

    A hash is 0 where one of the phrase's two parts shorter by a word can't be frequent; phrases
    of up to ``known`` words must be marked, too.
    """
    found, key, able = [], pair, joined
    for k in range(3, longest + 1):
        longer = np.zeros(len(word), np.uint64)
        both = np.flatnonzero(able[: 1 - k] & able[1 : len(able) + 2 - k]) if len(word) >= k else np.zeros(0, np.int64)
        longer[both] = H.mix(key[both] * np.uint64(0x9E3779B97F4A7C15) + word[both + k - 1])
        key, able = longer, longer != 0
        if k <= known:
            able &= marked(table, key)
        found.append((key, able))
    return found


def frequent_marks(docs: DataFrame, min_count: int, longest: int = LONGEST) -> bytes:
    """The bit table of words and phrases that occur ``min_count`` times in a language."""

    def single(word, pair, goes_on, table):
        return np.concatenate([word, pair[goes_on]])

    def longer(known, most):
        def keys_of(word, pair, goes_on, table):
            found = phrase_marks(table, word, pair, joined_pairs(table, word, pair, goes_on), known, most)
            return np.concatenate([key[key != 0] for key, _ in found[known - 2 :]])

        return keys_of

    packed = counted_marks(docs, min_count, single, b"")
    for known, most in ((2, min(3, longest)), (3, longest)):
        if most > known:
            more = counted_marks(docs, min_count, longer(known, most), packed)
            packed = (np.frombuffer(packed, np.uint8) | np.frombuffer(more, np.uint8)).tobytes()
    return packed


def counted_marks(docs: DataFrame, min_count: int, keys_of, packed: bytes) -> bytes:
    """The bit table of the keys that ``keys_of`` finds ``min_count`` times in all texts.

    The lower half of a hash is counted, which is an upper bound for each key that has it.
    """

    def count(batches):
        table = np.frombuffer(packed, np.uint8)
        for batch in batches:
            for _, salt, number, data, offsets in by_language(batch):
                code, rows, _, goes_on = word_runs(data, offsets)
                word, pair = marks(code, goes_on, salt[number[rows]])
                key, n = H.counted(keys_of(word, pair, goes_on, table) & LOW)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    counted = docs.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    often = counted.where(F.col("n") >= min_count)
    place = f"(key & {MARK_BITS - 1}L)"
    words = often.selectExpr(f"shiftright({place}, 5) AS w", f"shiftleft(1L, cast({place} & 31L AS int)) AS b")
    words = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(MARK_BITS >> 5, np.uint32)
    out[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.uint32)
    return out.tobytes()


def marked(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    place = (key & np.uint64(MARK_BITS - 1)).astype(np.int64)
    return (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def joined_pairs(table: np.ndarray, word: np.ndarray, pair: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
    """Whether each word and the next are both frequent, and so is their pair."""
    often = marked(table, word)
    joined = goes_on & often & marked(table, pair)
    joined[:-1] &= often[1:]
    return joined


def window_lengths(
    table: np.ndarray, word: np.ndarray, pair: np.ndarray, goes_on: np.ndarray, longest: int
) -> np.ndarray:
    """Words in the window that each word leads: 0 for a rare word, else those of its longest marked phrase."""
    joined = joined_pairs(table, word, pair, goes_on)
    length = marked(table, word).astype(np.int64)
    if longest > 1:
        length += joined
    for _, able in phrase_marks(table, word, pair, joined, longest, longest):
        length += able
    return length


class Held:
    """A task's windows, by hash, with their counts; each is made into texts once."""

    def __init__(self):
        self.key, self.place, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.parts: list[pa.RecordBatch] = []

    def add(self, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Count windows of distinct hashes; says which of them are not held yet."""
        at = np.searchsorted(self.key, key)
        old = np.zeros(len(key), bool)
        inside = at < len(self.key)
        old[inside] = self.key[at[inside]] == key[inside]
        self.n[self.place[at[old]]] += n[old]
        return ~old

    def keep(self, key: np.ndarray, n: np.ndarray, words: pa.RecordBatch) -> None:
        key = np.concatenate([self.key, key])
        place = np.concatenate([self.place, np.arange(len(self.n), len(key))])
        order = np.argsort(key, kind="stable")
        self.key, self.place, self.n = key[order], place[order], np.concatenate([self.n, n])
        self.parts.append(words)

    def full(self) -> bool:
        return len(self.n) >= HELD or sum(part.nbytes for part in self.parts) >= HELD_BYTES

    def batches(self):
        low = 0
        for part in self.parts:
            n = pa.array(self.n[low : low + part.num_rows])
            yield pa.RecordBatch.from_arrays([*part.columns, n], [*part.schema.names, "n"])
            low += part.num_rows


def lead_windows(docs: DataFrame, longest: int, packed: bytes) -> DataFrame:
    """The padded longest windows, ``lang, w1 ... n``, counted within a task.

    Every word of the texts is counted in one window; rare words lead a window of nulls.
    A task gives out a window once, or again for each ``HELD`` windows that it has met.
    """
    names = [f"w{k}" for k in range(1, longest + 1)]

    def windows(batches):
        table = np.frombuffer(packed, np.uint8)
        held = Held()
        for batch in batches:
            for langs, salt, number, data, offsets in by_language(batch):
                code, rows, starts, goes_on = word_runs(data, offsets)
                if not len(code):
                    continue
                lang = number[rows]
                word, pair = marks(code, goes_on, salt[lang])
                length = window_lengths(table, word, pair, goes_on, longest)
                # windows that are equal in language and words count together
                same = H.mix(salt[lang])
                for k in range(longest):
                    has = np.flatnonzero(length > k)
                    same[has] = H.mix(same[has] * np.uint64(0x9E3779B97F4A7C15) + word[has + k])
                key, first, n = np.unique(same, return_index=True, return_counts=True)
                new = held.add(key, n)
                if new.any():
                    held.keep(key[new], n[new], window_batch(langs, lang, data, offsets, starts, code, length, first[new], names))
                if held.full():
                    yield from held.batches()
                    held = Held()
        yield from held.batches()

    columns = ", ".join(f"{name} string" for name in names)
    return docs.mapInArrow(windows, f"lang string, {columns}, n long")


def window_batch(langs, lang, data, offsets, starts, code, length, first, names) -> pa.RecordBatch:
    """One row for each of the windows that begin at the words ``first``."""
    used = np.unique(np.concatenate([first[length[first] > k] + k for k in range(len(names))]))
    _, at, which = np.unique(code[used], return_index=True, return_inverse=True)
    texts = word_texts(data, offsets, starts[used[at]])
    columns = [pa.array(langs, pa.string()).take(pa.array(lang[first]))]
    for k in range(len(names)):
        has = length[first] > k
        place = np.zeros(len(first), np.int64)
        place[has] = which[np.searchsorted(used, first[has] + k)]
        columns.append(texts.take(pa.array(place, mask=~has)))
    return pa.RecordBatch.from_arrays(columns, ["lang", *names])


def word_texts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The words that begin at some bytes, A-Z in lower case; a word ends with its row, too."""
    mapped = PIECES[data]
    spaces = np.flatnonzero(mapped == 32)
    at = np.searchsorted(spaces, starts)
    ends = np.append(spaces, len(data))[at]
    ends = np.minimum(ends, offsets[np.searchsorted(offsets, starts, side="right")])
    return pa.array([mapped[a:b].tobytes().decode() for a, b in zip(starts, ends)], pa.string())


def phrase_counts(docs: DataFrame, longest: int, min_count: int) -> DataFrame:
    """Phrases found ``min_count`` times, ``lang, words, f``; no words: all words of a language."""
    names = [f"w{k}" for k in range(1, longest + 1)]
    packed = frequent_marks(docs, min_count, longest)
    tasks = TASKS_A_CORE * docs.sparkSession.sparkContext.defaultParallelism
    windows = lead_windows(docs.coalesce(tasks), longest, packed)
    level = F.grouping_id("lang", *names).alias("level")
    summed = windows.rollup("lang", *names).agg(F.sum("n").alias("f"), level)
    # the level has a bit for each column that is summed over; the last one kept must hold a word
    kept = F.lit(False)
    for k in range(longest + 1):
        is_level = F.col("level") == (1 << (longest - k)) - 1
        kept |= is_level if k == 0 else is_level & F.col(names[k - 1]).isNotNull()
    frequent = (F.col("f") >= min_count) | (F.col("level") == (1 << longest) - 1)
    words = F.filter(F.array(*names), lambda w: w.isNotNull())
    return summed.where(kept & frequent).select("lang", words.alias("words"), "f")


def cut_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)), exact: products may pass 64 bits, the quotient does not."""
    wide = [c.cast("decimal(18,0)") for c in (a, n, left, right)]
    over = (wide[0] * F.lit(1000).cast("decimal(4,0)")).cast("decimal(20,0)") * wide[1]
    return F.call_function("div", over, wide[2] * wide[3]).cast("long")


def phrase_collocations(
    docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, top: int = TOP
) -> DataFrame:
    """Each language's best phrases: ``lang, rank, phrase, a, l, r, n, score``.

    ``docs`` needs ``text`` and ``lang``; other columns are ignored. A null text is empty, a
    null language is ``und``. A-Z count in lower case; texts are cut at ``. , ; : ! ?`` and
    line ends into pieces and those at blanks and tabs into words. ``n`` is the number of
    words of the language, ``a`` that of a phrase of 2 to ``longest`` words, which must reach
    ``min_count``. A cut into two parts scores floor(1000 a n / (l r)) by the counts of its
    parts; the lowest-scoring cut counts, the earliest of equal ones. A phrase is dropped if
    a longer one holds it and occurs as often. ``top`` phrases a language are returned, by
    score, then count, then the bytes of the phrase. Counts must stay below 10 ** 17. Rows
    that repeat count again. Empty table or no such phrase: no rows.
    """
    docs = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    counts = stage(phrase_counts(docs, longest, min_count), "phrases")
    size = F.size("words")
    found = counts.where(size > 0)
    totals = counts.where(size == 0).select("lang", F.col("f").alias("n"))
    candidates = found.where(size > 1)

    # a chain of ever longer phrases of one count starts with a phrase longer by one word
    longer = candidates.where(size > 2).select(
        "lang", F.explode(F.expr("array(slice(words, 1, size(words) - 1), slice(words, 2, size(words) - 1))")).alias("words"), "f"
    )
    longer = longer.groupBy("lang", "words").agg(F.max("f").alias("held"))
    kept = candidates.join(longer, ["lang", "words"], "left").where("held IS NULL OR held < f").drop("held")

    cuts = kept.select("lang", "words", "f", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    cuts = cuts.withColumn("first", F.expr("slice(words, 1, k)")).withColumn("rest", F.expr("slice(words, k + 1, size(words))"))
    left = found.select("lang", F.col("words").alias("first"), F.col("f").alias("l"))
    right = found.select("lang", F.col("words").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    scored = scored.withColumn("score", cut_score(F.col("f"), F.col("n"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("lang", "words", F.col("f").alias("a"), "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    phrases = lowest.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = phrases.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
