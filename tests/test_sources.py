import json

import pytest
from pyspark.sql import functions as F

from skilldemand.operators import ingest as I
from skilldemand.schemas import assert_posting_schema
from skilldemand.sources import feeds, files, html_pages, store
from skilldemand.sources.html_pages import job_cards

CARD = """<article data-qa="job-card" class="card"><h2 class="t"><a href="{href}" class="t-link">
  {title} </a></h2><ul><li class="m">{company}</li><li class="m m--location"> London </li></ul>
  <time{when}>Posted</time><div class="card__description"><p>Work with Python,</p> <p>SQL</p></div></article>"""
PAGE = "<html><body>" + "".join(
    [
        CARD.format(href="/jobs/a/1", title="Senior <b>Analyst</b>", company='<a class="Recruiter" href="/r">Acme</a>', when=' datetime="2026-04-10T09:00:00Z"'),
        CARD.format(href="/jobs/a/2", title="ML", company='<span class="x-recruiter">Gamma</span>', when=""),
        CARD.format(href="/jobs/a/3", title="Dev", company='<a href="/jobs/gamma/p9">Delta</a>', when=' datetime="soon"'),
        '<article data-qa="job-card"><h2><a class="title">Broken</a></h2></article>',
        '<article><h2><a href="/x">not a card</a></h2></article>',
    ]
) + "</body></html>"


def test_html_pages(spark):
    pages = spark.createDataFrame([("data analyst", PAGE), ("x", None), ("x", "<p>none</p>")], "role_category string, html string")
    df = html_pages.parse_html_pages(pages)
    assert_posting_schema(df)
    rows = {r.url.rsplit("/", 1)[1]: r for r in df.collect()}
    assert len(rows) == 3
    assert (rows["1"].title, rows["1"].company, rows["1"].location) == ("SeniorAnalyst", "Acme", "London")
    assert rows["1"].url == "https://www.reed.co.uk/jobs/a/1" and rows["1"].raw_text == "Work with Python, SQL"
    assert (rows["2"].company, rows["3"].company) == ("Gamma", "Delta")
    assert rows["2"].posted_at is None and rows["3"].posted_at is None
    assert str(rows["1"].posted_at) == "2026-04-10 09:00:00" and rows["1"].role_category == "data analyst"


def test_card_fallbacks():
    html = '<article data-qa="job-card"><a data-element="job_title" href="u">T</a><ul><li>one</li><li>two</li></ul></article>'
    assert list(job_cards(html, "https://b.uk")) == [("T", "Unknown", "two", "https://b.uk/u", "", None)]


FLAT = [
    {"legal": "terms"},
    {"id": "1", "epoch": 1772013600, "company": "Harbour Labs", "position": "Data Scientist", "tags": ["tides"],
     "description": "<p>Tides at <i>Harbour Labs</i></p><ol><li>Model</li></ol>", "url": "https://h/7", "location": "Oban"},
    {"id": "2", "epoch": None, "position": "Developer", "tags": [], "description": "", "url": "", "location": None},
    {"id": 3, "position": None, "title": "ML Engineer", "company": None},
]


def test_flat_feed_and_roles(spark):
    raw = spark.createDataFrame([(json.dumps(FLAT),), ("{not json",)], "payload string")
    rows = sorted(feeds.parse_flat_feed(raw).collect(), key=lambda r: r.url)
    assert [r.title for r in rows] == ["Data Scientist", "Developer", "ML Engineer"]
    first, second, third = rows
    assert str(first.posted_at) == "2026-02-25 10:00:00" and first.raw_text == "Tides at Harbour Labs Model"
    assert (second.company, second.location, second.posted_at, second.raw_text) == ("Unknown", "Remote", None, "")
    assert (third.company, third.url) == (None, "https://remoteok.com/l/3")
    tagged = I.tag_roles(feeds.parse_flat_feed(raw))
    assert {(r.title, r.role_category) for r in tagged.collect()} == {
        ("Data Scientist", "data scientist"), ("ML Engineer", "ml engineer"),
    }
    own = I.tag_roles(feeds.parse_flat_feed(raw), ["Developer"])
    assert [r.title for r in own.collect()] == ["Developer"]


NESTED = {
    "results": [
        {"id": "1", "title": " Analyst ", "redirect_url": "https://a/1", "company": {"display_name": "Acme"},
         "location": {"display_name": "London"}, "description": " SQL ", "created": "2026-04-15T09:30:00Z"},
        {"title": "Junior", "redirect_url": "https://a/2", "company": None, "location": None, "description": None, "created": None},
        {"title": "", "redirect_url": "https://a/3"},
        {"title": "No URL", "redirect_url": ""},
    ]
}


def test_nested_feed(spark):
    raw = spark.createDataFrame([("data analyst", json.dumps(NESTED))], "role_category string, payload string")
    df = feeds.parse_nested_feed(raw)
    assert_posting_schema(df)
    one, two = sorted(df.collect(), key=lambda r: r.url)
    assert (one.title, one.company, one.raw_text) == ("Analyst", "Acme", "SQL")
    assert str(one.posted_at) == "2026-04-15 09:30:00"
    assert (two.company, two.location, two.raw_text, two.posted_at) == ("Unknown", "", "", None)


def test_source_contract(spark):
    with pytest.raises(ValueError):
        assert_posting_schema(spark.createDataFrame([("x",)], "source string"))


def test_ingest(spark):
    ddl = "url string, source string, role_category string, location string, raw_text string"
    html = spark.createDataFrame([("u1", "reed", "devops", None, None), ("u1", "reed", "data analyst", "L", "t")], ddl)
    feed = spark.createDataFrame([("u1", "remoteok", "data analyst", "L", "t"), ("u2", "remoteok", "devops", "L", "t")], ddl)
    rows = I.stamp(I.union_sources(html, feed), F.lit("2026-04-14").cast("timestamp"))
    assert rows.where("location is null or raw_text is null or is_processed").count() == 0
    kept = {r.url: r for r in I.first_per_url(rows).collect()}
    assert (kept["u1"].source, kept["u1"].role_category) == ("reed", "data analyst") and len(kept) == 2
    stored = spark.createDataFrame([("u2",), ("u9",)], "url string")
    assert [r.url for r in I.dedupe_against(I.first_per_url(rows), stored).collect()] == ["u1"]
    assert I.dedupe_against(rows.where("false"), stored).count() == 0
    summary = {(r.source, r.role_category): r.saved for r in I.ingest_summary(I.first_per_url(rows)).collect()}
    assert summary[None, None] == 2 and summary["reed", "data analyst"] == 1


def test_first_per_url_prunes_before_the_shuffle(spark):
    rows = spark.createDataFrame([("u", 0, "devops")], "url string, source_ord int, role_category string")
    plan = I.first_per_url(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_files(spark, tmp_path):
    (tmp_path / "gold.csv").write_text('id,text,skills\n1,"Strong ""Python"", SQL\nand more","Python, SQL,,python"\n2,x,\n')
    rows = files.read_skill_gold(spark, str(tmp_path / "gold.csv")).orderBy("id").collect()
    assert rows[0].text == 'Strong "Python", SQL\nand more' and rows[0].skills == ["python", "sql"] and rows[1].skills == []
    (tmp_path / "labels.csv").write_text('id,label,text\n1,positive,"a, b"\n')
    assert files.read_sentiment_gold(spark, str(tmp_path / "labels.csv")).first().asDict() == {"id": "1", "label": "positive", "text": "a, b"}
    (tmp_path / "corpus.txt").write_text(" one \n\n  \ntwo\n")
    assert sorted(r.text for r in files.read_corpus(spark, str(tmp_path / "corpus.txt")).collect()) == ["one", "two"]


def test_store_and_upsert(spark, trends, tmp_path):
    from conftest import CURR, OLD4, TREND_ROWS

    base = str(tmp_path)
    store.write_table(trends, base, "trends", "overwrite")
    assert store.read_table(spark, base, "trends").count() == len(TREND_ROWS)
    delta = spark.createDataFrame([("First aid", "nurse", CURR, 10)], "skill string, role_category string, week_start date, mention_count bigint")
    totals = spark.createDataFrame([("nurse", CURR, 100)], "role_category string, week_start date, total_postings bigint")
    store.upsert_trends(spark, base, delta, totals)
    rows = {(r.skill, r.role_category, r.week_start): r for r in store.read_table(spark, base, "trends").collect()}
    assert len(rows) == len(TREND_ROWS)
    first = rows["First aid", "nurse", CURR]
    assert (first.mention_count, first.pct_of_postings) == (70, 0.7)
    assert rows["Night shifts", "nurse", CURR].pct_of_postings == 0.36
    assert rows["Wound care", "nurse", OLD4].mention_count == 2


def test_latest_week_reads_one_partition(spark, trends, tmp_path):
    from skilldemand.operators.trends import trending

    store.write_table(trends, str(tmp_path), "trends", "overwrite")
    df = trending(store.read_table(spark, str(tmp_path), "trends"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(week_start" in plan


def test_bucketed_tables_join_without_a_shuffle(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("posting_id"), "id")
    store.save_bucketed(df, "b_postings", 4)
    store.save_bucketed(df, "b_processed", 4)
    joined = spark.table("b_postings").hint("merge").join(spark.table("b_processed"), "posting_id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_csv_exports(spark, trends, tmp_path):
    path = str(tmp_path / "t")
    store.export_trending(trends, path, "baker")
    assert spark.read.csv(path, header=True).columns == store.TRENDING_COLUMNS
    store.export_trending(trends.where("false"), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines == [",".join(store.TRENDING_COLUMNS)]
    store.export_gap(trends, "baker", ["ovens"], path)
    assert [r.value for r in spark.read.text(path).collect()][1] == "Ovens,matched,30.0,baker"
