"""Density topics, topics as a table, weekly ledgers, pages, isolated steps and idioms."""

import datetime as dt
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skilldemand.functions import pages as PG
from skilldemand.functions.isolate import isolated, isolated_stage
from skilldemand.functions.lookup import MARK_BITS, may_hold
from skilldemand.operators import density as D
from skilldemand.operators import enrich as N
from skilldemand.operators import postings as P
from skilldemand.operators import term_topics as TT
from skilldemand.operators import topics as M
from skilldemand.operators import trends as T
from skilldemand.operators.sentiment import score_sentiment
from skilldemand.schemas import TOPIC, TRENDS
from skilldemand.sources import html_pages, store
from skilldemand.sources.ledger import WeeklyTable


def brute_density(rows, eps, min_points):
    """(topic, core, neighbours) of each row by the definition."""
    known = [k for k, (_, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    near = {k: [j for j in known if sum((x - y) ** 2 for x, y in zip(rows[k][1], rows[j][1])) <= eps * eps] for k in known}
    core = {k for k in known if len(near[k]) >= min_points}
    topic = {}
    for k in sorted(core):
        if k in topic:
            continue
        todo, topic[k] = [k], k
        while todo:
            for j in near[todo.pop()]:
                if j in core and j not in topic:
                    topic[j] = topic[k]
                    todo.append(j)
    for k in known:
        cores = [j for j in near[k] if j in core]
        if k not in core and cores:
            d = lambda j: sum((x - y) ** 2 for x, y in zip(rows[k][1], rows[j][1]))
            topic[k] = topic[min(cores, key=lambda j: (d(j), rows[j][0]))]
    sizes = Counter(topic.values())
    first = {t: min(rows[k][0] for k in core if topic[k] == t) for t in sizes}
    number = {t: n for n, t in enumerate(sorted(sizes, key=lambda t: (-sizes[t], first[t])))}
    return [(rows[k][0], number[topic[k]] if k in topic else -1, k in core, len(near.get(k, []))) for k in range(len(rows))]


@pytest.mark.parametrize(("eps", "min_points", "axes"), [(0.35, 4, 2), (0.8, 9, 3), (0.05, 2, 1)])
def test_density_topics_equal_brute_force(spark, eps, min_points, axes):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(5, 4)) * 2
    rows = [(i, [float(x) for x in centres[i % 5] + rng.normal(size=4) * 0.2]) for i in range(240)]
    rows += [(1000 + i, [float(x) for x in rng.normal(size=4) * 3]) for i in range(40)]
    rows += [(2000 + i, rows[3][1]) for i in range(30)]  # copies
    rows += [(3000, None), (3001, [1.0, None, 0.0, 0.0]), (3002, [float("nan"), 0.0, 0.0, 0.0]), (5, rows[200][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "posting_id long, embedding array<double>, cell string, weight int")
    got = D.density_topics(df.repartition(3), eps, min_points, axes=axes, tile=17).collect()
    want = brute_density(rows, eps, min_points)
    assert Counter((r.posting_id, r.topic_id, r.is_core, r.neighbours) for r in got) == Counter(want)
    assert {t for _, t, _, _ in want} > {-1, 0}


def test_density_topics_are_the_same_in_many_rounds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=3) + 3 * (i % 3)]) for i in range(150)]
    compared = []
    compare = D.compare_tiles
    monkeypatch.setattr(D, "compare_tiles", lambda placed, units, *a: compared.append(units.count()) or compare(placed, units, *a))
    monkeypatch.setattr(D, "LEAST_ROWS", 400)
    monkeypatch.setattr(D, "FOLD", 2)
    df = spark.createDataFrame(rows, "posting_id long, embedding array<float>")
    got = D.density_topics(df, 0.9, 4, tile=20).collect()
    assert Counter((r.posting_id, r.topic_id, r.is_core, r.neighbours) for r in got) == Counter(brute_density(rows, 0.9, 4))
    assert len(compared) >= 6  # three rounds or more, for counts and for links
    half = len(compared) // 2
    assert sum(compared[:half]) == sum(compared[half:]) > max(compared)


def test_density_topics_of_nothing(spark):
    none = spark.createDataFrame([], "posting_id long, embedding array<float>")
    assert D.density_topics(none, 1.0).collect() == []
    one = spark.createDataFrame([(1, [0.5])], "posting_id long, embedding array<float>")
    assert [tuple(r) for r in D.density_topics(one, 1.0).collect()] == [(1, -1, False, 1)]
    empty = spark.createDataFrame([(1, [])], "posting_id long, embedding array<float>")
    assert D.density_topics(empty, 1.0).first().topic_id == -1


def numpy_topics(features, seeds, rounds):
    """Assignments and sums of cosines of spherical k-means on (id, term) -> tf."""
    ids, terms = sorted({i for i, _ in features}), sorted({t for _, t in features})
    x = np.zeros((len(ids), len(terms)))
    for (i, t), tf in features.items():
        x[ids.index(i), terms.index(t)] = tf
    x *= np.log((len(ids) + 1) / ((x > 0).sum(axis=0) + 1))
    length = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    c = x[[ids.index(s) for s in seeds]]
    sums = []
    for _ in range(rounds):
        s = x @ c.T
        best, top = s.argmax(axis=1), s.max(axis=1)
        sums.append(top[top > 0].sum())
        for k in range(len(c)):
            rows = x[(best == k) & (top > 0)]
            if len(rows):
                c[k] = rows.sum(axis=0) / np.linalg.norm(rows.sum(axis=0))
    s = x @ c.T
    return dict(zip(ids, np.where(s.max(axis=1) > 0, s.argmax(axis=1), -1))), sums


def test_term_topics_equal_numpy(spark, tmp_path):
    rng = random.Random(4)
    pools = [[f"{p}{i}" for i in range(30)] for p in ("red", "blue", "green")]
    rows = [(i, " ".join(rng.choices(pools[i % 3], k=12) + rng.choices(["and", "with", "common"], k=4))) for i in range(90)]
    rows += [(200, ""), (201, None), (7, "red1 red2 again")]
    docs = spark.createDataFrame(rows, "posting_id long, text string").repartition(3)
    assert TT.fit_term_topics(docs.limit(20), 3) is None
    model = TT.fit_term_topics(docs, 3, max_iter=4, tolerance=-1.0)
    features = {(r.posting_id, r.term): r.tf for r in M.topic_features(docs).collect()}
    ids = spark.createDataFrame([(i,) for i in {i for i, _ in features}], "id long")
    seeds = [r.id for r in ids.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(3).collect()]
    want, sums = numpy_topics(features, seeds, 4)
    assert model.objective == pytest.approx(sums)
    path = str(tmp_path / "model")
    model.save(path)
    again = TT.TermTopics.load(spark, path)
    assert again.k == 3 and again.objective == model.objective
    got = {r.posting_id: r.topics for r in again.assign(docs).collect()}
    assert {i: t.topic_id for i, t in got.items()} == {**want, 200: -1, 201: -1}
    assert got[200].topic_label == "unknown" and got[1].topic_label.startswith(f"{got[1].topic_id}_")
    assert again.top_words(2).count() == 6


def test_term_topics_leave_the_model_alone(spark, tmp_path, monkeypatch):
    before = {t.name for t in spark.catalog.listTables()}
    made = iter(range(100))
    monkeypatch.setattr(TT, "CLASSES", 2)
    monkeypatch.setattr(TT, "scratch_dir", lambda _, name: str(tmp_path / f"{name}-{next(made)}"))
    docs = spark.createDataFrame([(i, f"red{i % 7} blue{i % 5} own{i}") for i in range(60)], "posting_id long, text string")
    model = TT.fit_term_topics(docs, 2, max_iter=3)
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["term-topics"]
    assert {t.name for t in spark.catalog.listTables()} == before
    # each document's own terms have a weight, too
    assert model.centroids.where("term LIKE 'own%'").count() == 60
    lengths = model.centroids.groupBy("topic").agg(F.sum(F.col("w") * F.col("w")).alias("l")).collect()
    assert [r.l for r in lengths] == pytest.approx([1.0] * len(lengths))


WEEKS = [dt.date(2026, 3, 2), dt.date(2026, 3, 9), dt.date(2026, 3, 16)]


def test_weekly_table_keeps_runs_apart(spark, tmp_path):
    table = WeeklyTable(spark, str(tmp_path / "t"), TRENDS)
    assert table.read().collect() == [] and table.current() == {}

    def rows(n, *weeks):
        return spark.createDataFrame([(f"s{n}", "r", w, n, 0.5) for w in weeks], TRENDS)

    table.replace(rows(1, *WEEKS), WEEKS, "one")
    table.replace(rows(2, WEEKS[1]), WEEKS[1:], "two")  # empties the last week
    counts = {r.week_start: r.mention_count for r in table.read().collect()}
    assert counts == {WEEKS[0]: 1, WEEKS[1]: 2}
    table.replace(rows(9, *WEEKS), WEEKS, "two")  # a finished run is not run again
    assert {r.week_start: r.mention_count for r in table.read().collect()} == counts
    # a run that was lost before its entry is not seen, and overwrites what it left
    rows(7, WEEKS[0]).withColumn("run", F.lit("three")).write.partitionBy("week_start", "run").mode("append").parquet(f"{tmp_path}/t/rows")
    assert {r.week_start: r.mention_count for r in table.read().collect()} == counts
    table.replace(rows(3, WEEKS[0]), WEEKS[:1], "three")
    assert [r.mention_count for r in table.read(WEEKS[:1]).collect()] == [3]
    files = table.read(WEEKS[:1]).inputFiles()
    assert files and all("week_start=2026-03-02/run=three" in f for f in files)  # no other week is read
    assert table.compact() == 3 and table.compact() == 0
    assert {r.week_start: r.mention_count for r in table.read().collect()} == {WEEKS[0]: 3, WEEKS[1]: 2}


def test_upsert_reads_touched_weeks_and_repeats(spark, tmp_path):
    base = str(tmp_path)
    start = spark.createDataFrame([("a", "r", w, 5, 0.5) for w in WEEKS], TRENDS)
    store.write_table(start, base, "trends", "overwrite", "start")
    delta = spark.createDataFrame([("a", "r", WEEKS[2], 1), ("b", "r", WEEKS[2], 2)], "skill string, role_category string, week_start date, mention_count long")
    totals = spark.createDataFrame([("r", WEEKS[2], 12)], "role_category string, week_start date, total_postings long")
    for _ in range(3):
        store.upsert_trends(spark, base, delta, totals, "more")
    got = {(r.skill, r.week_start): (r.mention_count, r.pct_of_postings) for r in store.read_table(spark, base, "trends").collect()}
    assert got == {("a", WEEKS[0]): (5, 0.5), ("a", WEEKS[1]): (5, 0.5), ("a", WEEKS[2]): (6, 0.5), ("b", WEEKS[2]): (2, 0.1667)}
    store.write_table(delta.withColumn("pct_of_postings", F.lit(0.1)).where("skill = 'b'"), base, "trends")
    assert store.read_table(spark, base, "trends", WEEKS[2:]).count() == 3


@pytest.mark.parametrize("page", [1, 2, 7, 20, 21, 40])
def test_pages_equal_offsets(spark, page):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 9]), rng.choice(["aa", "ab", "abc", "b", None]) or "z", i) for i in range(199)]
    df = spark.createDataFrame(rows, "n int, name string, id int").repartition(5)
    order = [F.desc("n"), F.asc("name"), F.asc("id")]
    ranges = [(F.col("n"), True), (F.substring("name", 1, 2), False)]
    got = PG.page_rows(df, ranges, order, page, 10).orderBy(*order).collect()
    assert got == df.orderBy(*order).offset(10 * (page - 1)).limit(10).collect()
    last = PG.page_rows(df, ranges, order, page, 10, last_if_past=True).collect()
    assert len(last) == (9 if page >= 20 else 10)
    about = PG.envelope(df, page, 10, last_if_past=True).first()
    assert tuple(about) == (min(page, 20), 10, 199, 20, page < 20, page > 1)


def test_pages_of_nulls_and_nothing(spark):
    rows = [(None, 3), (dt.datetime(2026, 1, 1), 1), (dt.datetime(2026, 1, 2), 2), (None, 4)]
    df = spark.createDataFrame(rows, "at timestamp, id int")
    order, ranges = [F.desc("at"), F.asc("id")], [(F.date_trunc("minute", "at"), True)]
    pages = [[r.id for r in PG.page_rows(df, ranges, order, p, 1).collect()] for p in (1, 2, 3, 4, 5)]
    assert pages == [[2], [1], [3], [4], []]
    none = df.limit(0)
    assert PG.page_rows(none, ranges, order, 1, 10, last_if_past=True).collect() == []
    assert tuple(PG.envelope(none, 3, 10, last_if_past=True).first()) == (1, 10, 0, 1, False, False)


def test_bounds(spark, trends, skill_sets):
    for weeks in (0, 27):
        with pytest.raises(ValueError):
            T.emerging(trends, lookback_weeks=weeks)
    for weeks in (0, 53):
        with pytest.raises(ValueError):
            P.sentiment_timeline(*skill_sets, weeks=weeks)


def test_isolated_steps(spark, vocab, tmp_path):
    def first_letter(text):
        return text[0].upper()

    df = spark.createDataFrame([(1, "one"), (2, ""), (3, None), (4, "two")], "posting_id long, raw_text string")
    got = df.select("posting_id", isolated(first_letter, "string")(F.col("raw_text")).alias("s")).collect()
    assert [(r.s.value, bool(r.s.error)) for r in got] == [("O", False), (None, True), (None, True), ("T", False)]

    def topic(text):
        if "bad" in text:
            raise ValueError("no topic")
        return {"topic_id": len(text), "topic_label": "t", "probability": 0.5}

    lexicon = spark.createDataFrame([("great", 3.1)], "word string, valence double")
    texts = ["great python", "bad python", "<![bad[ html", "agile"]
    docs = spark.createDataFrame(list(enumerate(texts)), "posting_id long, raw_text string")
    stage = isolated_stage(topic, TOPIC.simpleString(), "topics")
    done = N.enrich(docs, vocab, lexicon, topic_stage=stage, processed_at=F.lit(dt.datetime(2026, 1, 1)))
    path = str(tmp_path / "p")
    for _ in range(2):
        N.append_processed(done, path, "one")
    assert sorted(r.posting_id for r in N.read_processed(spark, path).collect()) == [0, 3]
    failed = {r.posting_id: r.error for r in N.read_quarantine(spark, path).collect()}
    assert failed[1] == "topics: ValueError: no topic" and set(failed) == {1, 2}
    N.append_processed(done.where("posting_id = 3"), path, "two")
    assert N.written_summary(spark, path).first().asDict() == {"processed": 3, "errors": 2}
    assert N.written_summary(spark, path, "two").first().asDict() == {"processed": 1, "errors": 0}


def test_pages_that_cannot_be_parsed(spark):
    card = '<article data-qa="job-card"><h2><a href="{}">Chef</a></h2></article>'
    pages = [("r", card.format("/jobs/1")), ("r", card.format("//[bad/jobs/2")), ("r", None), ("s", card.format("/jobs/3"))]
    df = spark.createDataFrame(pages, "role_category string, html string").repartition(1)
    assert html_pages.parse_html_pages(df).count() == 2
    failed = html_pages.parse_html_pages_checked(df).where("error IS NOT NULL").collect()
    assert [r.role_category for r in failed] == ["r"] and "ValueError" in failed[0].error


@pytest.mark.parametrize("inline", [True, False])
def test_idioms_and_marks(spark, inline):
    lexicon = spark.createDataFrame([("great", 3.1), ("happy", 2.7), ("death", -2.9), ("good", 1.9)], "word string, valence double")
    idioms = spark.createDataFrame(
        [("kind of", None, -0.293), ("kiss of death", -1.5, None), ("good grief", -0.9, None), ("to die for", 3.0, None)],
        "phrase string, valence double, boost double",
    )
    texts = ["(great)", "great!!!!", "we are so happy", "it is kind of good", "it was the kiss of death", "a b good grief indeed", "oh my my good grief indeed"]
    df = spark.createDataFrame(list(enumerate(texts)), "posting_id long, raw_text string")
    got = [r.compound for r in score_sentiment(df, lexicon, inline=inline, idioms=idioms).orderBy("posting_id").collect()]

    def norm(x):
        return round(x / (x * x + 15) ** 0.5, 4)

    assert got == pytest.approx(
        # one letter is no word, so "good grief" has no three words before it in the sixth
        [norm(3.1), norm(3.1 + 4 * 0.292), norm(2.7 + 0.293), norm(1.9 - 0.293), norm(-1.5), norm(1.9), norm(-0.9)]
    )


def test_marks_of_words(spark):
    words = spark.range(3000).selectExpr("concat('w', id) AS word")
    test = may_hold(words, "word")
    assert words.where(test(F.col("word"))).count() == 3000
    others = spark.range(20_000).selectExpr("concat('x', id) AS word")
    assert others.where(test(F.col("word"))).count() < 20_000 * 3000 / MARK_BITS * 2
    none = may_hold(words.limit(0), "word")
    assert words.where(none(F.col("word"))).count() == 0


def test_connected(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(30)] + [(7, 7)]
    got = {r.id: r.component for r in D.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    want = {n: n for n in nodes}
    for _, (a, b) in itertools.product(range(len(nodes)), links):
        if a != b:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want
    assert D.connected(spark.createDataFrame([], "a long, b long")).collect() == []
