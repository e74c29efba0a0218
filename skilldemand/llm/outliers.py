"""Quality rules: robust multivariate outliers per language and source.

Every text becomes a vector of transformed statistics. For each language and source the
mean and covariance of the least scattered 75 % of vectors are found by concentration
steps: measure all vectors, keep the nearest, estimate again. A step is one aggregate over
all rows by group and bin of distance, so a group of any size is only ever summed. Texts
far from their group's estimate, by Mahalanobis distance, are rejected.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skilldemand.llm import hashing as H
from skilldemand.llm.common import stage

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
KEEP_PERCENT = 75  # of a group's vectors that the estimate rests on
STEPS = 6
LEAST_GROUP = 60  # vectors that a group of its own needs
TAIL = 1e-9  # share of a normal group beyond the cut-off
SALTS = 16
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VECTOR = ["x_words", "x_length", "x_symbols", "x_dup_lines", "x_repeats", "x_upper", "x_marks"]
# Least deviation of each statistic: keeps the matrix regular where most of a group's texts
# have none of a thing (symbols, repeated lines and words), so that it does not vary at all.
FLOOR = [0.02] * 7
# Counts of a short text say little: so much plain text is added to each before shares are
# taken, and shares far below the unit weigh little on the logarithmic scale.
ADDED_CHARS, ADDED_WORDS, ADDED_LINES = 200, 40, 20
UNIT = {"n_symbols": 0.05, "n_dup_lines": 1.0, "n_repeat_words": 1.0, "n_upper": 0.05, "n_marks": 0.05}
BINS = 16  # bins of distance in an octave


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with the base counts, ``n_upper`` and ``n_marks`` (long)."""
    rest = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*rest).dtypes)
    schema += ", n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    schema += ", n_lines long, n_upper long, n_marks long"

    def measure(batches):
        for batch in batches:
            for low, data, offsets in H.slices(batch.column("text")):
                n = len(offsets) - 1
                own = [batch.column(c).slice(low, n) for c in rest]
                counts = [pa.array(c) for c in measure_texts(data, offsets)]
                yield pa.RecordBatch.from_arrays(own + counts, schema_names)

    schema_names = [*rest, *BASE, "n_lines", "n_upper", "n_marks"]
    return docs.select(*rest, "text").mapInArrow(measure, schema)


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(mask, dtype=np.int64))
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(code: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether the same row has the same code elsewhere, and whether that is earlier."""
    order = np.lexsort((np.arange(len(code)), code, rows))
    same = np.zeros(len(code) + 1, bool)
    same[1:-1] = (code[order][1:] == code[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    any_, later = np.zeros(len(code), bool), np.zeros(len(code), bool)
    any_[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return np.stack([any_, later])


def measure_texts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n = len(offsets) - 1
    space = H.EXACT_WORDS[data] == 32
    chars = ((data & 0xC0) != 0x80) & ~space
    symbols = np.isin(data, np.frombuffer(SYMBOLS, np.uint8))
    upper = (data >= 65) & (data <= 90)
    letters = (H.LETTERS[data] != 32) | space
    words, rows, _ = H.tokens(data, offsets, H.EXACT_WORDS)
    n_words = np.bincount(rows, minlength=n)
    code, at = H.window_hashes(words, rows, "1" * WINDOW, 0)
    twice = at[repeated(code, rows[at])[0]]
    cover = np.zeros(len(words) + WINDOW + 1, np.int64)
    cover[twice] += 1
    cover[twice + WINDOW] -= 1
    n_repeat = np.bincount(rows[np.cumsum(cover)[: len(words)] > 0], minlength=n)
    # lines: between line feeds and ends of rows
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10), np.flatnonzero(data == 10) + 1]))
    starts, ends = (cuts[:-1], cuts[1:]) if len(cuts) > 1 else (cuts[:0], cuts[:0])
    filled = np.append(0, np.cumsum(~space))
    real = filled[ends] > filled[starts]
    starts, ends = starts[real], ends[real]
    line_rows = np.searchsorted(offsets, starts, side="right") - 1
    later = repeated(H.hash_segments(data, starts, ends), line_rows)[1]
    out = [n_words, per_row(chars, offsets), per_row(symbols, offsets)]
    out += [np.bincount(line_rows[later], minlength=n), n_repeat]
    out += [np.bincount(line_rows, minlength=n), per_row(upper, offsets), per_row(~letters, offsets)]
    return [c.astype(np.int64) for c in out]


def vector_columns() -> dict[str, Column]:
    """The transformed statistics: logarithms of counts and of shares in a text with some plain text added."""
    share = lambda a, b, added: F.log1p(F.col(a) / (F.col(b) + added) / F.lit(UNIT[a]))
    return {
        "x_words": F.log1p("n_words"),
        "x_length": F.log((F.col("word_chars") + ADDED_CHARS) / (F.col("n_words") + ADDED_WORDS)),
        "x_symbols": share("n_symbols", "word_chars", ADDED_CHARS),
        "x_dup_lines": share("n_dup_lines", "n_lines", ADDED_LINES),
        "x_repeats": share("n_repeat_words", "n_words", ADDED_WORDS),
        "x_upper": share("n_upper", "word_chars", ADDED_CHARS),
        "x_marks": share("n_marks", "word_chars", ADDED_CHARS),
    }


def chi_square(share: float, freedom: int) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty)."""
    low, high = -40.0, 40.0
    for _ in range(200):
        z = (low + high) / 2
        low, high = (z, high) if 0.5 * math.erfc(-z / math.sqrt(2)) < share else (low, z)
    return freedom * (1 - 2 / (9 * freedom) + z * math.sqrt(2 / (9 * freedom))) ** 3


def at_share(counts: DataFrame, keys: list[str], bin_: str, percent: int) -> DataFrame:
    """The lowest bin of each key at which ``percent`` of its rows (column ``rows``) are covered."""
    whole = Window.partitionBy(*keys)
    so_far = whole.orderBy(bin_).rowsBetween(Window.unboundedPreceding, 0)
    covered = counts.withColumns({"_c": F.sum("rows").over(so_far), "_n": F.sum("rows").over(whole)})
    return covered.where(F.col("_c") * 100 >= F.col("_n") * percent).groupBy(*keys).agg(F.min(bin_).alias(bin_))


def first_estimate(rows: DataFrame, grid: int = 256) -> DataFrame:
    """``g, mean, precision`` from medians and absolute deviations of each statistic."""
    d = len(VECTOR)
    long = rows.select("g", F.posexplode(F.array(*VECTOR)).alias("i", "x"))
    binned = long.groupBy("g", "i", F.floor(F.col("x") * grid).alias("b")).agg(F.count("*").alias("rows"))
    binned = stage(binned, "mcd-start")
    middle = at_share(binned, ["g", "i"], "b", 50).withColumnRenamed("b", "m")
    away = binned.join(middle, ["g", "i"]).select("g", "i", "m", F.abs(F.col("b") - F.col("m")).alias("b"), "rows")
    away = away.groupBy("g", "i", "m", "b").agg(F.sum("rows").alias("rows"))
    spread = at_share(away, ["g", "i", "m"], "b", 50)
    gathered = spread.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", "m", "b"))).alias("s"))

    def estimate(frames):
        for frame in frames:
            out = []
            for g, s in zip(frame["g"], frame["s"]):
                mean = [(r["m"] + 0.5) / grid for r in s]
                scale = [max(1.4826 * r["b"] / grid, f) for r, f in zip(s, FLOOR)]
                out.append((g, mean, np.diag(1 / np.square(scale)).ravel().tolist(), 1.0))
            yield pd.DataFrame(out, columns=["g", "mean", "precision", "scale"])

    assert d == len(FLOOR)
    return gathered.mapInPandas(estimate, "g string, mean array<double>, precision array<double>, scale double")


def with_distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Squared distances ``d2`` from the group's estimate; a hot group is spread over salts."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    spread = estimates.select("g", "mean", "precision", "scale", salts)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    joined = salted.join(spread, ["g", "salt"], "left").drop("salt")
    d = len(VECTOR)
    joined = joined.withColumns({f"_d{i}": F.col(VECTOR[i]) - F.col("mean")[i] for i in range(d)})
    total = F.lit(0.0)
    for i in range(d):
        for j in range(i, d):
            total = total + F.col("precision")[i * d + j] * F.col(f"_d{i}") * F.col(f"_d{j}") * (1 if i == j else 2)
    joined = joined.withColumn("d2", F.greatest(total, F.lit(0.0)))
    return joined.drop("mean", "precision", *[f"_d{i}" for i in range(d)])


def concentrate(rows: DataFrame, estimates: DataFrame, percent: int) -> DataFrame:
    """One step: the estimates from the ``percent`` of each group's rows that are nearest.

    The cut falls on the upper edge of a bin of distance, so ties are kept together.
    """
    d = len(VECTOR)
    measured = with_distance(rows, estimates)
    bin_ = F.floor(F.log2(F.col("d2") + 1e-6) * BINS).alias("b")
    sums = [F.sum(F.col(x)).alias(f"s{i}") for i, x in enumerate(VECTOR)]
    squares = [
        F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"q{i}_{j}") for i in range(d) for j in range(i, d)
    ]
    by_bin = measured.groupBy("g", bin_).agg(F.count("*").alias("rows"), *sums, *squares)
    by_bin = stage(by_bin, "mcd-step")
    cut = at_share(by_bin, ["g"], "b", percent).withColumnRenamed("b", "cut")
    middle = at_share(by_bin, ["g"], "b", 50).withColumnRenamed("b", "middle")
    names = [f"s{i}" for i in range(d)] + [f"q{i}_{j}" for i in range(d) for j in range(i, d)]
    kept = by_bin.join(cut, "g").join(middle, "g").where("b <= cut")
    totals = kept.groupBy("g", "middle").agg(F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in names])

    def estimate(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                n = row.rows
                mean = np.array([getattr(row, f"s{i}") for i in range(d)]) / n
                cov = np.zeros((d, d))
                for i in range(d):
                    for j in range(i, d):
                        cov[i, j] = cov[j, i] = getattr(row, f"q{i}_{j}") / n - mean[i] * mean[j]
                cov += np.diag(np.square(FLOOR))
                out.append((row.g, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), 2.0 ** ((row.middle + 1) / BINS)))
            yield pd.DataFrame(out, columns=["g", "mean", "precision", "scale"])

    return totals.mapInPandas(estimate, "g string, mean array<double>, precision array<double>, scale double")


def grouped(rows: DataFrame, least: int) -> DataFrame:
    """Add ``g``: language and source, or, for too few rows, the small groups of a language,
    or of all. Nulls are values of their own. A last group that is too small has none."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    own = rows.groupBy(text("lang").alias("l"), text("source").alias("s")).agg(F.count_if("usable").alias("n"))
    own = own.withColumn("small", F.col("n") < least)
    langs = own.groupBy("l").agg(F.sum(F.when(F.col("small"), F.col("n"))).alias("n_l"))
    last = langs.agg(F.coalesce(F.sum(F.when(F.col("n_l") < least, F.col("n_l"))), F.lit(0))).first()[0] or 0
    rest = F.lit("*") if last >= least else F.lit(None).cast("string")
    g = F.when(~F.col("small"), F.concat_ws("\x01", "l", "s")).when(F.col("n_l") >= least, F.col("l")).otherwise(rest)
    names = own.join(langs, "l").select("l", "s", g.alias("g"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    keyed = rows.withColumns(
        {"l": text("lang"), "s": text("source"), "salt": F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(SALTS)).cast("int")}
    )
    return keyed.join(names.select("*", salts), ["l", "s", "salt"]).drop("l", "s", "salt")


def outlier_verdicts(
    docs: DataFrame,
    percent: int = KEEP_PERCENT,
    steps: int = STEPS,
    least: int = LEAST_GROUP,
    tail: float = TAIL,
) -> DataFrame:
    """The base counts of every text, ``base_failed``, ``distance`` and ``kept``.

    ``docs`` has ``doc_id``, ``text``, ``lang`` and ``source``; others are ignored. Texts
    that fail the base rules (under 10 words; over a fifth of the words in repeated
    five-word windows) are rejected and not estimated from. A language and source with
    fewer than ``least`` other texts shares an estimate with the language's other small
    ones, then with those of all languages; if these are still fewer, nothing is rejected
    and ``distance`` is null. A null text has no words. Repeated rows count as often as
    they occur. Words are compared by 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    rows = text_statistics(docs).withColumns(vector_columns())
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    rows = stage(rows.withColumns({"base_failed": failed, "usable": ~failed}), "mcd-rows")
    rows = stage(grouped(rows, least), "mcd-groups")
    usable = rows.where("usable and g is not null")
    estimates = stage(first_estimate(usable), "mcd-estimates")
    for _ in range(steps):
        estimates = stage(concentrate(usable, estimates, percent), "mcd-estimates")
    measured = with_distance(rows, estimates)
    # the scale makes the median distance that of a normal group
    d = len(VECTOR)
    distance = F.col("d2") / F.greatest(F.col("scale") / F.lit(chi_square(0.5, d)), F.lit(1.0))
    measured = measured.withColumn("distance", F.when(F.col("usable"), F.sqrt(distance)))
    near = F.coalesce(F.col("distance") <= F.lit(math.sqrt(chi_square(1 - tail, d))), F.lit(True))
    return measured.select(
        "doc_id", *BASE, "base_failed", (~F.col("base_failed") & near).alias("kept"), "distance", "lang", "source"
    )
