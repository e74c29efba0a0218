import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from skilldemand.functions import bands as B
from skilldemand.operators import enrich as N
from skilldemand.operators import evaluate as V
from skilldemand.operators import postings as P
from skilldemand.operators import topics as M
from skilldemand.schemas import PROCESSED, TOPIC, TRENDS
from skilldemand.streaming import incremental as I

AT = dt.datetime(2026, 3, 4, 10)


@pytest.fixture(scope="module")
def small(spark):
    postings = spark.createDataFrame(
        [
            ("p1", "board", "nurse", "Ward Nurse", "St Anna", "Leeds", "w1", "Wards need triage and first aid", AT, None),
            ("p2", "agency", "baker", "Night Baker", "Krume", None, "w2", "Sourdough baker: immediate start, urgently wanted", AT, None),
            ("p3", "board", "nurse", "School Nurse", "Oakfield", "York", "w3", "First aid for pupils", AT, None),
        ],
        "posting_id string, source string, role_category string, title string, company string, location string, "
        "url string, raw_text string, scraped_at timestamp, posted_at timestamp",
    )
    none = {"orgs": [], "locations": [], "products": []}
    processed = spark.createDataFrame(
        [
            ("p1", ["triage", "first aid"], 0.5, (0, "care", 0.7), none, AT),
            ("p2", ["sourdough"], -0.2, (1, "kitchen", 0.6), none, AT),
        ],
        PROCESSED,
    )
    weeks = dt.date(2026, 3, 2), dt.date(2026, 2, 23)
    trends = spark.createDataFrame([("triage", "nurse", weeks[0], 7, 0.7), ("triage", "nurse", weeks[1], 4, 0.5)], TRENDS)
    return postings, processed, trends


def test_status_queries(small):
    postings, processed, trends = small
    rows = {r.role_category: r for r in P.roles(postings, processed).collect()}
    assert all(r.posting_count == r.processed_count + r.unprocessed_count for r in rows.values())
    assert rows["nurse"].unprocessed_count == 1
    stats = P.stats(postings, processed, trends).first()
    assert (stats.total_postings, stats.processed_postings, stats.unprocessed_postings, stats.roles_tracked) == (3, 2, 1, 2)
    assert stats.sources == ["agency", "board"] and stats.weeks_of_data == 2
    nobody = P.stats(postings, processed, trends, "sailor").first()
    assert (nobody.total_postings, nobody.roles_tracked, nobody.last_scraped) == (0, 1, None)
    counts = {r.table_name: r.rows for r in P.table_counts(*small).collect()}
    assert counts == {"postings": 3, "processed": 2, "trends": 2}


def test_timeline_and_topics(small):
    postings, processed, _ = small
    timeline = P.sentiment_timeline(postings, processed)
    (row,) = timeline.collect()
    assert (str(row.week), row.avg_sentiment, row.urgency_score, row.posting_count) == ("2026-03-02", 0.15, 3, 2)
    summary = P.timeline_summary(timeline).first()
    assert (summary.total_urgency, summary.change, summary.direction) == (3, None, None)
    topics = [(r.topic_label, r.posting_count, r.avg_probability) for r in P.topics(postings, processed).collect()]
    assert topics == [("care", 1, 0.7), ("kitchen", 1, 0.6)]


def test_pages(small):
    postings, processed, _ = small
    data, envelope = P.recent_postings(postings, processed, None, 1, 2)
    first, second = data.collect()
    assert (first.posting_id, first.skills, first.location) == ("p1", ["triage", "first aid"], "Leeds")
    assert second.location == ""
    assert envelope.first().total_pages == 2 and envelope.first().has_next
    assert P.recent_postings(postings, processed, None, 9, 2)[0].count() == 0
    third = P.recent_postings(postings, processed, None, 2, 2)[0].first()
    assert (third.skills, third.topics, third.sentiment_score) == ([], None, None)
    assert P.recent_by_role(postings, "nurse", 1).count() == 1
    for page, size in ((0, 2), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            P.recent_postings(postings, processed, None, page, size)
    with pytest.raises(ValueError):
        P.recent_by_role(postings, "nurse", 101)
    assert P.posting_detail(postings, processed, "p2").first().sentiment_score == -0.2
    assert P.posting_detail(postings, processed, "9").count() == 0
    assert [r.posting_id for r in P.unprocessed(postings, processed, 5).collect()] == ["p3"]


def test_bands(spark):
    df = spark.createDataFrame([(v,) for v in (0.15, 0.1, -0.05, 0.05, None)], "v double")
    got = [tuple(r) for r in df.select(B.sentiment_band(F.col("v")), B.sentiment_band(F.col("v"), 0.05, -0.05, True)).collect()]
    assert got == [("positive", "positive"), ("neutral", "positive"), ("negative", "neutral"), ("neutral", "neutral"), (None, None)]
    change = spark.createDataFrame([(v,) for v in (20.1, 20.0, 5.0, -5.1, -10.1, -20.1)], "v double")
    got = [tuple(r) for r in change.select(B.momentum(F.col("v")), B.momentum_badge(F.col("v"))).collect()]
    assert [g[0] for g in got] == ["strong_up", "up", "flat", "down", "down", "strong_down"]
    assert [g[1] for g in got] == ["rising", "neutral", "neutral", "neutral", "falling", "falling"]


def test_set_scores(spark):
    ddl = "id int, skills array<string>"
    gold = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, [])], ddl)
    pred = spark.createDataFrame([(1, ["a", "x"]), (2, ["c"])], ddl)
    macro = V.prf_macro(gold, pred).first()
    assert (macro.precision, macro.recall, macro.f1) == (0.5, 0.5, 0.5)
    micro = V.prf_micro(gold, pred).first()
    assert (micro.precision, micro.recall, micro.f1) == (0.667, 0.667, 0.667)
    table = {r.extractor: r for r in V.ab_compare(gold, {"A": pred, "B": gold}).collect()}
    assert table["B"].is_winner and not table["A"].is_winner and table["A"].f1_margin == round(table["B"].f1 - table["A"].f1, 3)


def test_class_scores(spark):
    rows = [("p", "p"), ("p", "n"), ("n", "n"), ("n", "n"), ("x", "p"), ("o", "o")]
    df = spark.createDataFrame(rows, "gold string, pred string")
    classes = ["p", "n", "o", "never"]
    assert V.accuracy(df).first().accuracy == pytest.approx(4 / 6)
    matrix = {r.gold: [r.p, r.n, r.o, r.never] for r in V.confusion(df, classes).collect()}
    assert matrix == {"p": [1, 1, 0, 0], "n": [0, 2, 0, 0], "o": [0, 0, 1, 0], "never": [0, 0, 0, 0]}
    per = {r["class"]: (r.precision, r.recall, r.f1) for r in V.prf_per_class(df, classes).collect()}
    assert per["p"] == (0.5, 0.5, 0.5) and per["n"] == (0.667, 1.0, 0.8) and per["never"] == (0.0, 0.0, 0.0)
    want = round(sum(per[c][2] * n / 6 for c, n in {"p": 2, "n": 2, "o": 1}.items()), 3)
    assert V.weighted_f1(df, classes).first().weighted_f1 == want


def lexicon(spark):
    return spark.createDataFrame([("great", 3.1), ("toxic", -2.6)], "word string, valence double")


TEXTS = ["<p>Great Python &amp; SQL</p>", "<![bad[ Python", "toxic SQL. No agencies please. sql", None]


def raw(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "posting_id bigint, raw_text string")


def test_enrich_inlined_equals_joined(spark, vocab):
    gazetteer = spark.createDataFrame([("Python", "PRODUCT"), ("SQL", "ORG")], "name string, label string")
    twice = raw(spark).union(raw(spark).select(F.lit(0), "raw_text"))
    one, two = (
        N.enrich(twice, vocab, lexicon(spark), gazetteer, processed_at=F.lit(AT), inline=inline).collect()
        for inline in (True, False)
    )
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == 2 * len(TEXTS)


def test_enrich_isolates_errors_and_does_not_shuffle(spark, vocab, tmp_path):
    gazetteer = spark.createDataFrame([("SQL", "PRODUCT")], "name string, label string")
    done = N.enrich(raw(spark), vocab, lexicon(spark), gazetteer)
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
    rows = {r.posting_id: r for r in done.collect()}
    assert rows[0].skills_extracted == ["Python", "SQL"] and rows[0].sentiment_score > 0
    assert rows[0].entities.orgs == ["Python", "SQL"] and rows[0].entities.products == ["SQL"]
    assert rows[0].topics is None and rows[1].error and rows[1].skills_extracted is None
    assert rows[2].sentiment_score < 0 and rows[3].skills_extracted == [] and rows[3].sentiment_score == 0.0
    assert N.run_summary(done).first().asDict() == {"processed": 3, "errors": 1}
    N.append_processed(done, str(tmp_path / "p"))
    assert N.read_processed(spark, str(tmp_path / "p")).count() == 3
    assert [r.posting_id for r in N.read_quarantine(spark, str(tmp_path / "p")).collect()] == [1]


def test_enrich_takes_user_stages(spark, vocab):
    topic = F.struct(F.lit(7), F.lit("t"), F.lit(0.5)).cast(TOPIC)
    entity = F.struct(*[F.array(F.lit("E")).alias(n) for n in ("orgs", "locations", "products")])
    done = N.enrich(
        raw(spark), vocab, lexicon(spark),
        topic_stage=lambda df: df.withColumn("topics", topic),
        entity_stage=lambda df: df.withColumn("entities", entity),
        chunks=F.array(F.lit("agile")),
    )
    row = done.where("posting_id = 0").first()
    assert row.topics.topic_id == 7 and row.skills_extracted == ["Python", "SQL", "agile"]
    assert row.entities.orgs == ["E", "Python", "SQL"]


def corpus(spark, n=60):
    words = [["python", "pandas", "notebook"], ["docker", "helm", "cluster"]]
    return spark.createDataFrame(
        [(i, " ".join(words[i % 2]) * 1 + f" item{i % 3}", [float(i % 2), 1.0]) for i in range(n)],
        "posting_id bigint, text string, embedding array<float>",
    )


def test_topics(spark, tmp_path):
    docs = corpus(spark)
    assert M.fit_topics(docs.limit(10), 2) is None
    assert M.assign_topics(docs, None).where("topics is not null").count() == 0
    path = str(tmp_path / "model")
    model = M.fit_topics(docs, 2, embedding_col="embedding", path=path)
    again = M.get_or_fit(spark, path, docs, 2)
    rows = M.assign_topics(docs, again).collect()
    by_parity = {(r.posting_id % 2, r.topics.topic_id) for r in rows}
    assert len(by_parity) == 2 and len({t for _, t in by_parity}) == 2 and again.labels == model.labels
    labels = {r.topics.topic_label for r in rows}
    assert labels == set(model.labels.values())
    unsure = M.assign_topics(docs, again, min_probability=1.1).first().topics
    assert (unsure.topic_id, unsure.topic_label) == (-1, "unknown")
    words = M.topic_words(docs.withColumn("topic_id", (F.col("posting_id") % 2).cast("int")), 3).collect()
    assert {r.word for r in words if r.topic_id == 1} <= {"docker", "helm", "cluster", "docker helm", "helm cluster"}


def test_no_term_is_left_out(spark):
    words = [[f"w{i}x{j}" for j in range(2500)] for i in range(60)]  # 300,000 words and pairs
    schema = "posting_id bigint, text string"
    model = M.fit_topics(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], schema), 2, max_iter=1)
    single = [(i, w) for i, w in enumerate(w for ws in words for w in ws[::100])]
    probes = spark.createDataFrame([*single, (-1, "")], schema)
    assert M.assign_topics(probes, model).where("topics.topic_id = -1").select("posting_id").collect() == [(-1,)]


def test_features(spark):
    df = spark.createDataFrame([(1, "The data data team a")], "posting_id int, text string")
    got = {r.term: r.tf for r in M.topic_features(df).collect()}
    assert got == {"data": 2, "team": 1, "data data": 1, "data team": 1}


def test_coherence_equals_brute_force(spark):
    import random

    random.seed(5)
    texts = [[random.choice("abcdefgh") for _ in range(random.choice([1, 3, 9, 30]))] for _ in range(25)]
    topics = {0: ["a", "b", "c"], 1: ["d", "a", "zz"]}
    window = 5
    windows = [set(t[i : i + window]) for t in texts for i in range(max(1, len(t) - window + 1))]
    n = len(windows)

    def p(*ws):
        return sum(all(w in s for w in ws) for s in windows) / n

    def npmi(x, y):
        return math.log((p(x, y) + 1e-12) / (p(x) * p(y))) / -math.log(p(x, y) + 1e-12)

    scores = []
    for ws in topics.values():
        known = [w for w in ws if p(w)]
        vectors = [[npmi(x, y) for y in known] for x in known]
        total = [sum(col) for col in zip(*vectors)]

        def cos(a, b):
            return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

        scores.append(sum(cos(v, total) for v in vectors) / len(vectors))
    docs = spark.createDataFrame([(" ".join(t),) for t in texts], "text string")
    words = spark.createDataFrame([(k, w) for k, ws in topics.items() for w in ws], "topic_id int, word string")
    got = M.coherence(docs, words, window=window).first().c_v
    assert got == pytest.approx(sum(scores) / len(scores), abs=1e-4)


def test_ingest_stream_is_unique_over_runs(spark, tmp_path):
    ddl = "url string, source_ord int, role_category string, n int"
    inbox, store, state = (str(tmp_path / d) for d in ("in", "store", "state"))
    schema = spark.createDataFrame([], ddl).schema
    for day in range(3):
        rows = [(f"u{i}", i % 2, "devops", day) for i in range(day, day + 4)] * 2
        spark.createDataFrame(rows, schema).write.mode("append").parquet(inbox)
        I.ingest_stream(I.read_arrivals(spark, inbox, schema), store, state).awaitTermination()
    rows = I.read_batches(spark, store, schema).collect()
    assert sorted(r.url for r in rows) == [f"u{i}" for i in range(6)]
    assert {r.url: r.n for r in rows}["u1"] == 0


def test_late_rows_count(spark, tmp_path):
    ddl = "posting_id int, role_category string, scraped_at timestamp, skills_extracted array<string>"
    inbox, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    schema = spark.createDataFrame([], ddl).schema
    days = [dt.datetime(2026, 4, 14), dt.datetime(2026, 1, 6), dt.datetime(2026, 4, 15)]
    for i, day in enumerate(days):
        rows = [(10 * i, "r", day, ["a", "b"]), (10 * i + 1, "r", day, None)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(inbox)
        I.trends_stream(I.read_arrivals(spark, inbox, schema), out, state).awaitTermination()
    rows = {(r.skill, str(r.week_start)): (r.mention_count, r.pct_of_postings) for r in I.trends_of_batches(spark, out).collect()}
    assert rows == {
        ("a", "2026-04-13"): (2, 0.5), ("b", "2026-04-13"): (2, 0.5),
        ("a", "2026-01-05"): (1, 0.5), ("b", "2026-01-05"): (1, 0.5),
    }
