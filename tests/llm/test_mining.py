"""Fingerprint components, hard negatives and phrases, each against a brute-force version."""

import itertools
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pyspark.sql import functions as F

from skilldemand.llm import components, deletion_variants, phrases
from skilldemand.llm.common import arrow_batches, stage
from skilldemand.llm.coordinate_pruning import LEAST, MOST, Bucket, Search, feasible, hard_negatives, products
from skilldemand.llm.deletion_variants import fingerprint_links, simhash_components
from skilldemand.llm.phrases import phrase_collocations
from skilldemand.llm.simhash import fingerprints

SCHEMA = "doc_id long, text string, lang string, source string, fp long, key string, id int, n long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    """Documents with extra columns named like those the operators use."""
    return spark.createDataFrame([(i, t, lang, "s", 5, "k", 1, 2) for i, t, lang in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def brute_fingerprint(text):
    w = words(text)
    parts = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    counts = [0] * 64
    for part in parts:
        h = xxhash.xxh64_intdigest(part.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(parts))


def smallest_reachable(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in itertools.combinations(nodes, 2):
        if linked(x, y):
            a, b = sorted((root(x), root(y)))
            parent[b] = a
    return {n: root(n) for n in nodes}


TEXTS = [
    None,
    "",
    " \t\n ",
    "One",
    "one TWO",
    "a b c",
    "Ünïcode wörds änd more",
    "x" * 40 + " y " + "z" * 200,
    "w" * 100_000,
    " ".join(f"t{i % 613}" for i in range(40_000)),
    "la " * 700,
]


def test_fingerprints_of_odd_texts():
    found = fingerprints(pa.array(TEXTS, pa.string()))
    assert [int(v) for v in found] == [brute_fingerprint(t) for t in TEXTS]
    assert len(fingerprints(pa.array([], pa.string()))) == 0


def test_simhash_components(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(300)}" for _ in range(400)]
    rows = [(100 + i, t, None) for i, t in enumerate(TEXTS)]
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(400)] = f"v{rng.randrange(9)}"
        rows.append((500 - i, " ".join(copy), "en"))
    rows += [(7, "apart from all others", "de"), (7, TEXTS[9], "de"), (7, TEXTS[9], "de")]  # an id with several texts
    rows += [(None, " ".join(base), "en"), (None, None, None)]
    found = simhash_components(table(spark, rows).repartition(3)).collect()
    assert len(found) == len(rows)
    assert sorted(Counter((r.doc_id, r.fingerprint) for r in found).items(), key=str) == sorted(
        Counter((i, f"{brute_fingerprint(t):016x}") for i, t, _ in rows).items(), key=str
    )
    codes = {}
    for i, t, _ in rows:
        if i is not None:
            codes.setdefault(i, set()).add(brute_fingerprint(t))
    want = smallest_reachable(
        list(codes), lambda x, y: any((a ^ b).bit_count() <= 2 for a in codes[x] for b in codes[y])
    )
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == want
    assert all(r.component_id is None for r in found if r.doc_id is None)
    assert simhash_components(table(spark, []).where("false")).collect() == []


@pytest.mark.parametrize("flips", [3, 6])
def test_links_within_hot_buckets(spark, flips):
    """Hundreds of fingerprints around one centre, most of them further apart than a link."""
    rng = random.Random(flips)
    centre = rng.getrandbits(64)
    codes = {rng.getrandbits(64) for _ in range(50)}
    while len(codes) < 450:
        code = centre
        # bits of one half, or of both, so that halves are equal, too
        for b in rng.sample(range(rng.choice([10, 64])), rng.randrange(flips)):
            code ^= 1 << b
        codes.add(code)
        code = centre ^ 0xFFFF0000FFFF  # far from the first ones
        for b in rng.sample(range(32, 64), flips):
            code ^= 1 << b
        codes.add(code)
    codes = sorted(codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    nodes = spark.createDataFrame([(c, i) for i, c in enumerate(signed)], "fp long, id long")
    links = fingerprint_links(nodes, spark.createDataFrame([], "a long, b long")).collect()
    assert all((codes[r.a] ^ codes[r.b]).bit_count() <= 2 for r in links)
    pairs = {tuple(sorted((r.a, r.b))) for r in links}
    want = smallest_reachable(range(len(codes)), lambda x, y: (codes[x] ^ codes[y]).bit_count() <= 2)
    assert smallest_reachable(range(len(codes)), lambda x, y: (x, y) in pairs) == want


def test_variants_are_not_sent_through_the_driver(spark, monkeypatch):
    plans = []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, name)

    for module in (deletion_variants, components):
        monkeypatch.setattr(module, "stage", seen)
    texts = [" ".join(f"w{i * j % 37}" for j in range(12)) for i in range(40)]
    rows = table(spark, [(i % 30, t, "en") for i, t in enumerate(texts)])
    found = simhash_components(rows)
    assert found.count() == 40
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 4
    assert not any("Broadcast" in p for p in plans)


def brute_negatives(rows, scale=256, positives=5, negatives=10):
    taking = [
        (i, lab, [math.floor(scale * float(x)) for x in v])
        for i, lab, v in rows
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, lab, q in dict.fromkeys((i, lab, tuple(q)) for i, lab, q in taking if i % 100 == 0):
        scored = sorted((-sum(x * y for x, y in zip(q, r)), j, other == lab) for j, other, r in taking if j != i)
        for score, j, same in [s for s in scored if s[2]][:positives]:
            fits = [s for s in scored if not s[2] and 30 * -score <= -100 * s[0] <= 90 * -score][:negatives]
            out += [(i, j, rank, k, -score, -s) for rank, (s, k, _) in enumerate(fits, 1)]
    return Counter(out)


VECTORS = "vec_id long, embedding array<float>, label int, score long, anchor string, q int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 0, "x", 1) for i, lab, v in rows], VECTORS)


def negatives_of(df):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(tuple(r) for r in df.select(cols).collect())


def test_hard_negatives(spark):
    rng = np.random.default_rng(5)
    peaks = rng.normal(size=(6, 8)).astype(np.float32)
    rows = []
    for i in range(600):
        v = peaks[i % 6] * (i % 3) + rng.normal(size=8, scale=0.3).astype(np.float32)
        rows.append((i, i % 4, [float(x) for x in v.astype(np.float32)]))
    same = rows[100][2]
    rows += [(j, j % 3, same) for j in range(601, 640)]  # ties
    rows += [(100, 0, same), (100, 0, same), (100, 1, rows[7][2]), (650, 1, same), (650, 1, same)]  # repeated ids
    rows += [(700, None, same), (701, 1, None), (702, 1, [None, *same[1:]]), (703, 1, [float("nan"), *same[1:]])]
    rows += [(800, 1, [float("inf"), *same[1:]]), (None, 1, same), (900, 2, [0.0] * 8)]
    df = vectors(spark, rows).repartition(5)
    want = brute_negatives(rows)
    assert len(want) > 200
    assert negatives_of(hard_negatives(df)) == want
    assert negatives_of(hard_negatives(df, block=3)) == want  # several blocks of anchors


def test_hard_negatives_of_small_tables(spark):
    assert hard_negatives(vectors(spark, []).where("false")).collect() == []
    assert hard_negatives(vectors(spark, [(0, 1, [1.0]), (1, 1, [1.0])])).collect() == []
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.5, 9.0]), (3, 3, [0.95, 0.0])]
    assert negatives_of(hard_negatives(vectors(spark, rows))) == brute_negatives(rows) == Counter([(0, 1, 1, 2, 65536, 32768)])
    with pytest.raises(ValueError):
        hard_negatives(vectors(spark, [(0, 1, [1.0]), (1, 1, [1.0, 2.0])]))


def test_feasible_ranges_lose_no_row_and_prune():
    rng = np.random.default_rng(1)
    rows = rng.integers(-60, 60, (500, 6)) * (rng.random((500, 6)) < 0.5)
    rows[:40] = rng.integers(-5, 5, (40, 6))
    anchors = np.concatenate([rows[:60], [[0] * 6, [200, 0, 0, 0, 0, 0]]])
    bucket = Bucket(np.arange(500), np.zeros(500), rows)
    scores = products(anchors, rows)
    assert (scores == anchors @ rows.T).all()
    lengths = np.sqrt((anchors**2).sum(axis=1))
    pruned = 0
    for share in (-0.5, 0.0, 0.4, 0.8, 0.99, 1.2):
        reach = share * lengths * bucket.longest
        kept = bucket.candidates(anchors, lengths, reach, 3)
        assert kept[scores >= np.maximum(reach[:, None], -1e18)].all()
        pruned += (~kept).sum()
    assert pruned > 50_000
    low, high = feasible(anchors.astype(float), lengths, bucket.longest, lengths * bucket.longest * 0.9, np.zeros((62, 1), int))
    assert low[-1, 0] == pytest.approx(bucket.longest * 0.9, abs=1e-3) and high[-1, 0] >= bucket.longest


def test_matches_of_many_anchors_are_not_held_at_once():
    rng = np.random.default_rng(3)
    rows = rng.integers(-60, 60, (2048, 4))
    ids, labels = np.arange(2048), np.zeros(2048, np.int64)
    search = Search(ids, labels, rows, np.full((2048, 1), LEAST), np.full((2048, 1), MOST), True, 5)
    bucket = Bucket(ids, labels, rows)
    tracemalloc.start()
    search.add(bucket)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6  # all 4 million matches take 130 MB, and as much again where they are sorted
    scores = rows @ rows.T
    for i in (0, 77, 2047):
        want = sorted((-int(scores[i, j]), j) for j in range(2048) if j != i)[:5]
        assert [(-s, j) for a, _, s, j in search.best.tolist() if a == i] == want
        assert search.low[i, 0] == -want[-1][0]


def test_products_beyond_doubles():
    big = np.array([[1 << 28, 3], [(1 << 28) + 1, -7]])
    assert products(big, big).tolist() == [[sum(int(x) * int(y) for x, y in zip(a, b)) for b in big] for a in big]
    with pytest.raises(OverflowError):
        products(big << 10, big << 10)


def brute_phrases(rows, least, top, longest=5):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = (lang, tuple(w[i : i + k]))
                    counts[key] = counts.get(key, 0) + 1
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    held = Counter()
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                held[lang, p[i : i + k]] = max(held[lang, p[i : i + k]], a)
    out = {}
    for (lang, p), a in candidates.items():
        if held[lang, p] >= a:
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        row = (" ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], totals[lang], score)
        out.setdefault(lang, []).append(row)
    return sorted(
        (lang, rank, *row)
        for lang, found in out.items()
        for rank, row in enumerate(sorted(found, key=lambda r: (-r[5], -r[1], r[0].encode())), 1)
        if rank <= top
    )


@pytest.mark.parametrize(("least", "top"), [(2, 1000), (4, 7), (40, 1000)])
def test_phrase_collocations(spark, least, top):
    rng = random.Random(11)
    vocabulary = ["the", "THE", "of", "a b", "straße", "Éa", "x#", "#", "in", "spite", "big", "\x00", "日本"]
    rows = []
    for i in range(150):
        parts = [rng.choice(vocabulary[: 4 + i % 10]) + rng.choice([" ", "  ", "\t", " ", ", ", ".", "\n", "\x0b"]) for _ in range(60)]
        rows.append((i, "".join(parts), rng.choice(["en", "de", None, "und", ""])))
    rows += [(1, rows[1][1], rows[1][2]), (None, "in spite of the big", "en"), (None, None, "en"), (3, "", None), (4, " .,;\n", "fr")]
    rows += [(5, "very very " * 400, "en"), (6, "y" * 50_000 + " z", "xx")]
    df = table(spark, rows).repartition(4)
    found = phrase_collocations(df, min_count=least, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    want = brute_phrases(rows, least, top)
    assert want and sorted(tuple(r) for r in found.collect()) == want


def test_phrases_of_empty_tables(spark):
    assert phrase_collocations(table(spark, []).where("false")).collect() == []
    assert phrase_collocations(table(spark, [(1, "one two", "en")])).collect() == []


@pytest.mark.parametrize("held", [1 << 18, 5])
def test_windows_leave_a_task_once(spark, monkeypatch, held):
    rows = [(i, "one two three four, five six one two", ("en", None)[i % 2]) for i in range(400)]
    df = table(spark, rows).select("text", F.coalesce("lang", F.lit("und")).alias("lang")).coalesce(1)
    packed = phrases.frequent_marks(df, 1)
    monkeypatch.setattr(phrases, "HELD", held)
    with arrow_batches(spark, 20):
        found = phrases.lead_windows(df, 5, packed).collect()
    # four windows of the first piece, four of the second, for each language
    assert {(r.lang, r.n) for r in found} == {("en", 200), ("und", 200)} if held > 5 else len(found) > 16
    assert sum(r.n for r in found) == 400 * 8
    assert held == 5 or len(found) == 16


def test_windows_follow_the_cores_not_the_parts_of_the_table(spark, monkeypatch):
    rows = [(i, "one two three four, five six one two", "en") for i in range(512)]
    df = table(spark, rows).select("text", "lang").repartition(64)
    made, lead_windows = [], phrases.lead_windows
    monkeypatch.setattr(phrases, "lead_windows", lambda *given: made.append(lead_windows(*given)) or made[0])
    assert phrases.phrase_counts(df, 5, 100).where("size(words) = 4").count() == 2
    found = made[0].collect()
    # eight windows of the text, once for each of two tasks a core
    assert len(found) <= 8 * 2 * spark.sparkContext.defaultParallelism < 8 * 64
    assert sum(r.n for r in found) == 512 * 8


def test_words_end_with_their_text(spark):
    rows = [(1, "of course", "en"), (2, "course of course", "en"), (3, "of", "en")] * 5
    found = phrase_collocations(table(spark, rows).coalesce(1), min_count=5)
    found = found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(r) for r in found.collect()) == brute_phrases(rows, 5, 100)


def test_windows_end_with_the_longest_frequent_phrase(spark):
    # every triple is frequent, the phrases of four words and of five are not
    rows = [(i, "a b c. b c d. c d e", "en") for i in range(40)] + [(99, "a b c d e", "en")]
    df = table(spark, rows).select("text", "lang")
    found = phrases.lead_windows(df, 5, phrases.frequent_marks(df, 40)).collect()
    windows = {tuple(w for w in (r.w1, r.w2, r.w3, r.w4, r.w5) if w is not None) for r in found}
    assert {"".join(w) for w in windows} == {"abc", "bcd", "cde", "bc", "cd", "de", "c", "d", "e"}
    assert sum(r.n for r in found) == 40 * 9 + 5


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_shorter_phrases(spark, longest):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["in", "spite", "of", "all,", "that"]) for _ in range(40)), "en") for i in range(60)]
    found = phrase_collocations(table(spark, rows), longest=longest, min_count=9, top=500)
    want = brute_phrases(rows, 9, 500, longest)
    found = found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert want and sorted(tuple(r) for r in found.collect()) == want
