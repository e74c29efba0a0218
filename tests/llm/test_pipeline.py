"""Every stage of the pipeline on its own input, the mixture and a hot bucket by brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from skilldemand.llm.jaccard import ngram_jaccard_components
from skilldemand.llm.temperature import STEPS, temperature_mixture

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def md5(*parts):
    return hashlib.md5(":".join("" if p is None else str(p) for p in parts).encode()).hexdigest()


def brute_mixture(rows, per_block, evenness=0.5, entropy_ratio=None, max_repeats=4.0, budget=None):
    """The exponent and a Counter of (doc_id, text, epoch, block) for rows (doc_id, text, source)."""
    blocks = max(1, math.ceil(len(rows) / per_block))
    groups = {}
    for i, text, source in rows:
        crc = None if text is None else zlib.crc32(text.encode())
        digest = md5(0, i, crc)
        block = math.floor(int(digest[:13], 16) / (1 << 52) * blocks)
        name = "null" if source is None else "=" + source
        groups.setdefault(name, []).append((block, digest, i, text, len(words(text))))
    tokens = {g: sum(r[4] for r in own) for g, own in groups.items()}
    tokens = {g: n for g, n in tokens.items() if n}
    total = sum(tokens.values())
    budget = budget or total
    share = {g: n / total for g, n in tokens.items()}
    natural = -sum(p * math.log(p) for p in share.values())
    even = math.log(len(share))
    target = entropy_ratio * even if entropy_ratio is not None else natural + evenness * max(even - natural, 0.0)

    def weights(a):
        w = {g: p**a for g, p in share.items()}
        z = sum(w.values())
        return {g: x / z for g, x in w.items()}

    def good(a):
        w = weights(a)
        entropy = -sum(x * math.log(x) for x in w.values())
        return entropy <= target + 1e-12 and max(w[g] / share[g] for g in w) * budget / total <= max_repeats + 1e-9

    exponent = next((t / STEPS for t in range(STEPS + 1) if good(t / STEPS)), 1.0)
    out = Counter()
    for g, weight in weights(exponent).items():
        full, rest = divmod(math.floor(weight * budget + 0.5), tokens[g])
        visit = sorted({r[0] for r in groups[g]}, key=lambda b: (md5(0, g, full, b), b))
        spent = 0
        for block in visit:
            for _, _, i, text, n in sorted((r for r in groups[g] if r[0] == block), key=lambda r: (r[1], r[2] is not None, r[2])):
                for epoch in range(full + (spent < rest)):
                    out[i, text, epoch, block] += 1
                spent += n
    return exponent, out


def mixture_rows():
    rng = random.Random(6)
    rows = [(i, " ".join(["word"] * rng.randrange(1, 30)), "hot" if i % 3 else f"s{i % 21}") for i in range(600)]
    return rows + [(700, None, "hot"), (701, "", None), (702, "one two three", None), (None, "no id here", "s0"), (703, None, "empty")]


@pytest.mark.parametrize(
    "options", [{}, {"evenness": 0.9, "max_repeats": None}, {"max_repeats": 1.2}, {"entropy_ratio": 0.8}, {"budget": 20_000}, {"evenness": 1.0}]
)
def test_mixture_equals_brute_force(spark, options):
    rows = mixture_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = temperature_mixture(df, per_block=40, **options).collect()
    options = {k: 1e9 if v is None else v for k, v in options.items()}
    exponent, want = brute_mixture(rows, 40, **options)
    assert Counter((r.doc_id, r.text, r.epoch, r.block) for r in got) == want
    if not options:
        assert 0 < exponent < 1 and max(want.values()) == 1
        spent = Counter()
        for r in got:
            spent[r.source] += r.n_tokens
        natural = Counter()
        for _, text, source in rows:
            natural[source] += len(words(text))
        assert spent["hot"] < natural["hot"] and all(spent[s] > natural[s] for s in natural if s not in ("hot", "empty"))
        assert abs(sum(spent.values()) - sum(natural.values())) < 30 * len(natural)


def test_hot_bucket_of_copies_that_are_mostly_apart(spark):
    """One rare shingle in all of them, many tiles of rows, most pairs just below the limit."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(130):
        text = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            text[rng.randrange(5, 40)] = f"v{rng.randrange(12)}"
        rows.append((1000 - i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = {i: {tuple(words(t)[k : k + 5]) for k in range(36)} for i, t in rows}
    label = {i: i for i in sets}
    apart = 0
    for _ in range(8):
        apart = 0
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
            else:
                apart += 1
    assert apart > 130 * 129 / 4
    for tile in (8, 40, 2048):
        got = {r.doc_id: r.component_id for r in ngram_jaccard_components(df, tile=tile).collect()}
        assert got == label


PASSAGE = " ".join(f"quiz{i} asks about thing{i}" for i in range(12))
JUNK = ["BUY!! NOW!! $$$"] * 5


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(3)
    good = [f"alpha beta gamma delta w{i} v{i * 7 % 101} u{i * 3 % 53} " + " ".join(f"x{rng.randrange(900)}" for _ in range(25)) for i in range(240)]
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(1000 + i, " ".join([*JUNK, f"X{i}!!"])) for i in range(120)]
    rows += [(300 + i, good[i] + " more") for i in range(20)]  # near copies
    rows += [(5, good[5]), (5, " ".join([*JUNK, "X5!!"])), (None, good[9]), (None, "alpha beta gamma delta alone here w1 v1")]
    rows += [(400 + i, good[100 + i] + " " + PASSAGE + f" end{i}") for i in range(6)]
    rows = [(i, t, "en", "hot" if k % 3 else f"s{k % 9}", len(t), "x") for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{path}/documents.parquet")
    marks = [(i, int(i < 1000), 0) for i, *_ in rows if i is not None and i != 5]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").distinct().write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = C.quality(spark, docs, folder)
    assert kept.columns == docs.columns
    want = Counter({p: n for p, n in pairs(docs).items() if "BUY" not in p[1]})  # the good text of id 5 stays
    assert pairs(kept) == want

    kept = C.stage(kept, "test")
    sets = [(i is None, i or 0, t, {tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)}) for i, t in want]
    label = smallest(sets)
    want = Counter({(None if sets[k][0] else sets[k][1], sets[k][2]): 1 for k in set(label)})
    single = C.near_duplicates(spark, kept, folder)
    assert single.columns == docs.columns and pairs(single) == want
    assert {i for i, _ in want} >= {0, 19} and not {i for i, _ in want} & {300, 319}

    single = C.stage(single, "test")
    clean = C.decontamination(spark, single, folder)
    want = Counter({p: n for p, n in want.items() if "quiz0" not in p[1]})
    assert clean.columns == docs.columns and pairs(clean) == want

    clean = C.stage(clean, "test")
    rows = [(r.doc_id, r.text, r.source) for r in clean.collect()]
    mixed = C.mixture(spark, clean, folder)
    exponent, drawn = brute_mixture(rows, 2000)
    counted = Counter()
    for (i, text, _, _), n in drawn.items():
        counted[i, text] += n
    assert 0 < exponent < 1 and mixed.columns == docs.columns and pairs(mixed) == counted

    mixed = C.stage(mixed, "test")
    shards = C.shards(spark, mixed, folder)
    assert pairs(shards) == counted
    sizes = Counter(r.shard for r in shards.select("shard").collect())
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 1
    assert pairs(C.run(spark, folder)) == counted


def smallest(sets):
    """For each set the position of the first of its group, in the order of ids, null ids last."""
    order = sorted(range(len(sets)), key=lambda k: sets[k][:2])
    label = {k: k for k in order}
    rank = {k: n for n, k in enumerate(order)}
    for _ in range(4):
        for a, b in itertools.combinations(order, 2):
            x, y = sets[a][3], sets[b][3]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                label[a] = label[b] = min(label[a], label[b], key=rank.get)
    return [label[k] for k in range(len(sets))]


def test_empty_tables(spark, folder, tmp_path):
    path = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    assert C.run(spark, path).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert C.quality(spark, docs, path).count() >= 0
    assert pairs(C.decontamination(spark, docs, path)) == pairs(docs)
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string"))
    assert C.near_duplicates(spark, odd, path).count() == 3
