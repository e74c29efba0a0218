import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skilldemand.llm.common import fold
from skilldemand.llm.fixity import fixity_audit
from skilldemand.llm.interleave import interleaved_shards
from skilldemand.llm.jaccard import ngram_jaccard_components
from skilldemand.llm.lsa_vote import quality_scores
from skilldemand.llm.nnpu import nn_pu_scores
from skilldemand.llm.outliers import outlier_verdicts
from skilldemand.llm.ppm import Trie, adaptive_scores, ppm_scores
from skilldemand.llm.spaced_seeds import contaminated, fullest_stretch, overlap_of
from skilldemand.llm.temperature import temperature_mixture
from skilldemand.llm.url_trees import url_verdicts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, bits string"
PLAIN = "the cat sat on the mat and saw a small bird fly over our old house by the wide river"
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
ROWS = [
    (1, PLAIN, "en", "a"),
    (2, PLAIN, "en", "a"),
    (2, PLAIN, "en", "a"),  # a repeated row
    (3, PLAIN + " today", "en", None),
    (4, None, None, "b"),
    (5, "", "en", "b"),
    (6, " \n\t ", "de", "b"),
    (7, "One two", "de", "c"),
    (8, "one TWO", None, None),
    (9, LONG, "en", "c"),
    (10, "Ünïcode wörds änd more of thêm in ä line\nÜnïcode wörds änd more of thêm in ä line", "de", "c"),
    (None, "a row without an id", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, 0, 1, "x") for i, t, lang, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (3, 1, 1), (7, 0, 1), (7, 0, 0), (9, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def test_ppm_against_a_trie(docs, none):
    got = {(r.doc_id, r.score, r.base_score, r.n_tokens, r.n_known) for r in ppm_scores(docs, fold(F.col("doc_id"), 5) != 1, chunk=1000).collect()}
    train = [t for i, t, *_ in ROWS if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    trie, counts = Trie(), Counter()
    for t in train:
        trie.walk((t or "").encode(), learn=True, score=False)
        counts.update([*words(low(t)), None])
    total, distinct = sum(counts.values()), len(counts)
    by_id = {g[0]: g for g in got}
    for i, t, *_ in ROWS:
        own = [*words(low(t)), None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        _, score, base_score, n, known = by_id[i]
        assert score == pytest.approx(trie.walk((t or "").encode(), learn=False), rel=1e-9)
        assert base_score == pytest.approx(base, rel=1e-9)
        assert (n, known) == (len(own), sum(counts[w] > 0 for w in own))
    assert ppm_scores(none, F.lit(True)).count() == 0
    fresh = {r.doc_id: r.score for r in adaptive_scores(docs.where("doc_id in (4, 7)")).collect()}
    assert fresh[4] == pytest.approx(-math.log10(256))


def test_probabilities_of_a_context_sum_to_one():
    trie = Trie()
    trie.walk(b"abracadabra", learn=True)
    for context in (b"\xff" * 4, b"abra", b"zzra", b"zzzz"):
        assert sum(10 ** trie.log10(context, s) for s in range(256)) == pytest.approx(1)


def test_fixity_finds_the_damage(spark, none):
    rows = [(f"f{i % 3}", 100 * i, f"record {i}") for i in range(300)] + [(None, None, "lost"), ("f0", 5, "twin"), ("f0", 5, "twin")]
    one = spark.createDataFrame(rows, "file string, offset long, body string")
    bad = [r for r in rows if r[2] != "record 7"]
    bad[bad.index(rows[40])] = (rows[40][0], rows[40][1], "rotten")
    bad.remove(rows[-1])
    two = spark.createDataFrame([*bad, ("f9", 1, "new")], one.schema)
    found = {(r.file, r.offset, r.state) for r in fixity_audit(one, two, ["body"], size=500, fanout=4).collect()}
    assert found == {("f1", 700, "missing"), (rows[40][0], 4000, "changed"), ("f0", 5, "changed"), ("f9", 1, "extra")}
    assert fixity_audit(one, one, ["body"]).count() == 0
    assert fixity_audit(one.limit(0), one.limit(0), ["body"]).count() == 0


def test_fixity_finds_twins_damaged_alike(spark):
    one = spark.createDataFrame([("f", 1, "twin"), ("f", 1, "twin"), ("f", 2, "x")], "file string, offset long, body string")
    two = spark.createDataFrame([("f", 1, "rot"), ("f", 1, "rot"), ("f", 2, "x")], one.schema)
    found = [(r.file, r.offset, r.state) for r in fixity_audit(one, two, ["body"]).collect()]
    assert found == [("f", 1, "changed")]


def test_shards_are_even_and_match_the_mixture(spark, docs, none):
    rows = spark.range(1000).selectExpr("id doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 7)) source")
    got = interleaved_shards(rows, 8, per_range=50).collect()
    assert len({r.doc_id for r in got}) == 1000
    for k in range(8):
        own = [r for r in got if r.shard == k]
        assert sorted(r.slot for r in own) == list(range(125))
        assert 41 <= sum(r.source == "hot" for r in own) <= 43
    assert interleaved_shards(docs).count() == len(ROWS)
    assert interleaved_shards(none).count() == 0
    with pytest.raises(ValueError):
        interleaved_shards(docs.withColumn("Shard", F.lit(1)))


def test_mixture_keeps_budget_and_limit(docs, none, spark):
    rows = spark.range(2000).selectExpr("id doc_id", "if(id < 1900, 'big', 'small') source", "'three small words' text")
    got = temperature_mixture(rows, entropy_ratio=0.9, max_repeats=None, per_block=100).collect()
    share = sum(r.source == "small" for r in got) / len(got)
    entropy = -(share * math.log(share) + (1 - share) * math.log(1 - share)) / math.log(2)
    assert abs(len(got) - 2000) <= 2 and entropy == pytest.approx(0.9, abs=0.01)
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)
    capped = temperature_mixture(rows, entropy_ratio=0.9, max_repeats=2.0, per_block=100).collect()
    assert max(Counter(r.doc_id for r in capped).values()) <= 2
    assert temperature_mixture(none).count() == 0
    assert temperature_mixture(docs.where("doc_id in (4, 5)")).count() == 0
    assert temperature_mixture(docs).count() > 0


def test_even_sources_keep_their_shares(spark):
    rows = spark.range(1000).selectExpr("id doc_id", "if(id < 550, 'a', 'b') source", "'three small words' text")
    for ratio in (0.95, 0.5):  # the natural entropy is 0.993
        got = temperature_mixture(rows, entropy_ratio=ratio, per_block=100).collect()
        assert Counter(r.doc_id for r in got) == Counter(range(1000))
    skewed = spark.range(1000).selectExpr("id doc_id", "if(id < 990, 'a', 'b') source", "'three small words' text")
    got = temperature_mixture(skewed, entropy_ratio=0.95, max_repeats=1.0, per_block=100).collect()
    assert Counter(r.doc_id for r in got) == Counter(range(1000))
    with pytest.warns(UserWarning, match="over the limit"):
        got = temperature_mixture(skewed, budget=9000, max_repeats=2.0, per_block=100).collect()
    assert Counter(r.doc_id for r in got) == Counter({i: 3 for i in range(1000)})


def test_classifiers_on_odd_rows(docs, none, labels):
    for function in (nn_pu_scores, quality_scores):
        for marks in (labels, labels.limit(0)):
            got = function(docs, marks).collect()
            assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
        assert function(none, labels).count() == 0


def test_classifiers_on_held_out_rows(spark):
    plain = [f"alpha beta gamma delta w{i} v{i * 7 % 101} u{i * 3 % 53} end" for i in range(400)]
    rows = [(i, t + (" vile rotten" if i % 4 == 0 else "")) for i, t in enumerate(plain)]
    junk = [(1000 + i, " ".join(["BUY!! NOW!!", "$$$", f"X{i}!!"] * 5)) for i in range(200)]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string")
    toxic = docs.where("doc_id < 1000").selectExpr("doc_id", "cast(doc_id % 4 = 0 as int) toxic").where("doc_id % 3 = 0")
    got = {r.doc_id: r.predicted for r in nn_pu_scores(docs, toxic).collect()}
    assert all(got[i] == (i % 4 == 0) for i in range(400) if i % 3)
    quality = docs.selectExpr("doc_id", "cast(doc_id < 1000 as int) quality").where("doc_id % 3 = 0")
    got = {r.doc_id: r.predicted for r in quality_scores(docs, quality).collect()}
    assert all(got[i] == (i < 1000) for i in got)


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block")]


def test_url_rules_and_trees(spark):
    fixed = [
        ("http://WWW.Example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://a.example.com/en/?q=1", "a.example.com", "/en/", "example.com/en/", "block"),
        ("https://example.com", "example.com", "", None, None),
        ("x://b.net/es/x#y", "b.net", "/es/x", "net/es/", "block"),
        ("badexample.com/en/", "", "", None, None),
        (None, "", "", None, None),
        ("", "", "", None, None),
    ]
    more = [(f"http://s{i}.{'com' if i % 2 else 'net'}/{'en' if i % 2 else 'es'}/{'9' * (3 if i % 2 else 12)}",) for i in range(200)]
    pages = spark.createDataFrame([(i, u[0]) for i, u in enumerate(fixed + more)], "page_id long, url string")
    got = {r.page_id: r for r in url_verdicts(pages, RULES, trees=3).collect()}
    assert len(got) == 207
    for i, (_, host, path, rule, verdict) in enumerate(fixed):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert verdict is None or got[i].verdict == verdict
    assert all((r.score >= 0.5) == (i % 2 == 1) for i, r in got.items() if i >= 7)
    assert url_verdicts(pages.limit(0), RULES).count() == 0


def brute_base(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    twice = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").encode().split(b"\n") if words(x.decode())]
    return (
        len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)), len(twice),
    )


def test_outliers(spark, docs, none):
    got = outlier_verdicts(docs).collect()
    assert len(got) == len(ROWS)
    texts = {i: t for i, t, *_ in ROWS}
    for r in got:
        want = brute_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert outlier_verdicts(none).count() == 0
    good = [(i, " ".join(f"word{(i * 31 + j * j) % 4001}" for j in range(40 + i % 30)), "en", "s") for i in range(150)]
    odd = [(900, " ".join(f"$#{j}$*&" for j in range(60)), "en", "s")]
    got = {r.doc_id: r.kept for r in outlier_verdicts(spark.createDataFrame(good + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert not got.pop(900) and all(got.values())


def test_outliers_of_one_statistic(spark):
    plain = lambda i, n: " ".join(f"word{(i * 31 + j * j) % 4001}" for j in range(n))
    lines = lambda i, n: "\n".join(plain(i * 50 + k, 8) for k in range(n))
    good = [(i, lines(i, 12 + i % 9)) for i in range(200)]
    good += [(300, lines(300, 15) + "\nword1 word2\nword1 word2"), (301, lines(301, 15) + " #")]
    symbols = " ".join(w[:4] + "##" if j % 5 else w for j, w in enumerate(plain(7, 120).split()))
    copies = "\n".join("see\nsee\nsee\n" + plain(400 + k, 4) for k in range(15))
    bad = [(900, symbols), (901, copies), (902, lines(9, 15).upper())]
    rows = [(i, t, "en", "s") for i, t in good + bad]
    got = {r.doc_id: r for r in outlier_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [got[i].kept for i in (900, 901, 902)] == [got[i].base_failed for i in (900, 901, 902)] == [False] * 3
    assert all(got[i].kept for i, _ in good)


def test_decontamination(spark, docs, none):
    item = "q0 q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12 q13 q14 q15 q16 q17 q18 q19"
    items = spark.createDataFrame([(1, item), (2, item), (3, "tiny item"), (4, None), (None, item), (5, "")], "item_id long, text string")
    changed = item.replace("q5", "zz").replace("q13", "yy")
    rows = [
        (20, "before it " + item.upper() + ", after"), (21, changed), (22, " ".join(item.split()[:6])),
        (23, "a Tiny item!"), (24, " ".join(reversed(item.split()))), (25, LONG + " " + item),
    ]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.start, r.length, r.same) for r in contaminated(docs.select("doc_id", "text").unionByName(more), items).collect()}
    assert got == {
        (20, 1, 2, 20, 20), (20, 2, 2, 20, 20), (21, 1, 0, 20, 18), (21, 2, 0, 20, 18),
        (23, 3, 1, 2, 2), (25, 1, 30000, 20, 20), (25, 2, 30000, 20, 20),
    }
    assert contaminated(none, items).count() == 0 and contaminated(more, items.limit(0)).count() == 0


def test_jaccard_components_against_all_pairs(spark, docs, none):
    base = [f"t{i}" for i in range(60)]
    family = [(100 + k, " ".join(base[k : k + 45]) + f" own{k}") for k in range(8)]  # a chain of near copies
    common = [(200 + k, " ".join(base[:12]) + " " + " ".join(f"z{k}_{j}" for j in range(30))) for k in range(10)]
    all_ = docs.select("doc_id", "text").unionByName(spark.createDataFrame(family + common, "doc_id long, text string"))
    sets = {}
    for r in all_.where("doc_id is not null").collect():
        w = words(low(r.text))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for x in sets:
            for y in sets:
                shared = len(sets[x] & sets[y])
                if shared and 100 * shared >= 75 * len(sets[x] | sets[y]):
                    root[x] = root[y] = min(root[x], root[y])
        if all(root[root[x]] == root[x] for x in root):
            break
    got = ngram_jaccard_components(all_, tile=3).collect()
    assert len(got) == all_.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root[r.doc_id])
    assert ngram_jaccard_components(none).count() == 0


def test_jaccard_links_beside_null_and_repeated_ids(spark):
    text = lambda k, n, own="": " ".join(f"r{k}_{i}" for i in range(n)) + own
    rows = [
        (None, text(1, 60)), (5, text(1, 60)), (6, text(1, 60, " near")),  # the row without an id comes first
        (9, text(2, 40)), (9, text(3, 200)), (10, text(2, 40, " near")), (8, text(3, 200, " near")), (11, text(4, 50)),
    ]
    for last in (3, len(rows)):
        all_ = spark.createDataFrame(rows[:last], "doc_id long, text string").coalesce(1)
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_components(all_).collect())
        want = [(None, 56, None), (5, 56, 5), (6, 57, 5), (9, 36, 8), (9, 196, 8), (10, 37, 8), (8, 197, 8), (11, 46, 11)]
        assert got == Counter(want[:last])


def test_more_overlap_loses_no_passage():
    item = np.arange(59)
    doc = item.copy()
    doc[[i for i in range(14, 59) if (i - 14) % 7 in (0, 3)]] = -1  # 5 of 7 agree after 14 tokens
    start, length, same = overlap_of(doc, item, 0, 13, 0.8)
    assert start == 0 and same >= 14 and same >= 0.8 * length
    rng = np.random.default_rng(3)
    for n in rng.integers(1, 40, 200):
        agree = rng.random(n) < 0.7
        fits = [agree[a:b].sum() for a in range(n) for b in range(a + 1, n + 1) if 5 * agree[a:b].sum() >= 4 * (b - a)]
        start, end, same = fullest_stretch(agree, 0.8)
        assert same == max(fits, default=0) == agree[start:end].sum() and 5 * same >= 4 * (end - start)
