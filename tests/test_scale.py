"""Steps that have to grow with their input: dealt tasks, counts in the row, pruned distances, one inference."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skilldemand.functions import text as X
from skilldemand.functions.html_text import text_of
from skilldemand.operators import density as D
from skilldemand.operators import topics as M
from skilldemand.plans import adapters as A
from skilldemand.plans import source_queries as Q
from skilldemand.sources import html_pages


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_density_rules_far_pairs_out_by_a_product():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(70, 8)), rng.normal(size=(50, 8))
    y[:5] = x[:5] + 1e-9
    y[5] = 1e200  # its square is no finite number
    one, two = (pa.table({"v": pa.array(m.tolist(), pa.list_(pa.float64()))}) for m in (x, y))
    with np.errstate(over="ignore"):
        want = ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)
    reach = float(np.median(want))
    got = D.distances(one, two, reach)
    assert ((got <= reach) == (want <= reach)).all()
    assert (got[want <= reach] == want[want <= reach]).all()
    assert np.isinf(got[want > reach * 1.001]).all()


def test_terms_are_counted_in_their_row(spark):
    rows = [(1, "data team data team data"), (2, None), (3, "x"), (4, "red blue"), (4, "blue red blue"), (None, "data lake"), (None, "data")]
    df = spark.createDataFrame(rows, "posting_id int, text string")
    got = M.topic_features(df)
    assert {(r.posting_id, r.term): r.tf for r in got.collect()} == {
        (1, "data"): 3, (1, "team"): 2, (1, "data team"): 2, (1, "team data"): 2,
        (4, "red"): 2, (4, "blue"): 3, (4, "red blue"): 2, (4, "blue red"): 1,
        (None, "data"): 2, (None, "lake"): 1, (None, "data lake"): 1,
    }
    assert got.count() == 11
    # rows with an id of their own are told apart before terms are grouped
    assert "LeftAnti" in plan_of(got)


def test_stop_words_may_be_none(spark):
    df = spark.createDataFrame([(1, "the cat")], "posting_id int, text string")
    assert {r.term for r in M.topic_features(df, stop_words=[]).collect()} == {"the", "cat", "the cat"}


def test_pages_are_dealt_over_tasks(spark):
    card = '<article data-qa="job-card"><h2><a href="/jobs/{}">Chef</a></h2></article>'
    pages = spark.createDataFrame([("r", card.format(i % 7)) for i in range(20)] + [("r", None)], "role_category string, html string")
    got = html_pages.parse_html_pages(pages.coalesce(1))
    assert "RepartitionByExpression" in plan_of(got)
    assert Counter(r.url[-1] for r in got.collect()) == Counter(str(i % 7) for i in range(20))


def test_documents_of_one_row_group_are_dealt_over_tasks(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("abcdefgh ", k=6000)), "en", "src1") for i in range(1500)] + [(None, None, "en", "src1"), (3, "twice", "en", "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    plain, spread = A.document_postings(spark, str(tmp_path)), A.spread_postings(spark, str(tmp_path))
    assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))
    tasks = spread.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 600


def test_texts_arrive_in_files_of_few_rows(spark, monkeypatch):
    rows = spark.range(9000).select(F.col("id").alias("posting_id"), F.lit("a text").alias("raw_text"))
    seen = []
    monkeypatch.setattr(Q.I, "read_arrivals", lambda spark, path, schema, files_per_batch: seen.append((path, files_per_batch)))
    Q._arrivals(spark, rows, "arrivals", 2, Q.TEXTS_PER_FILE)
    (path, files_per_batch), = seen
    files = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert len(files) == 3 and files_per_batch == 2 and max(r["count"] for r in files) <= Q.TEXTS_PER_FILE


def test_markup_is_parsed_in_slices(monkeypatch):
    texts = [f"<p> {i} </p>" for i in range(600)] + [None, ""]
    asked = []
    monkeypatch.setattr(X, "pa", type("P", (), {"Array": pa.Array, "string": pa.string, "concat_arrays": pa.concat_arrays, "array": lambda v, t: asked.append(len(v)) or pa.array(v, t)}))
    got = X._parsed(pa.array(texts), strip=True)
    assert got.to_pylist() == [None if t is None else text_of(t, strip=True, lenient=True) for t in texts]
    assert max(asked) <= X.SLICE < len(texts)
    assert X._parsed(pa.array([], pa.string()), strip=False).to_pylist() == []


def test_a_sweep_finds_topics_once_for_each_number(spark, monkeypatch):
    rng = random.Random(1)
    pools = [["python", "pandas", "numpy", "model"], ["docker", "helm", "cluster", "node"]]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(pools[i % 2], k=8))) for i in range(60)], "posting_id int, text string")
    calls = []
    plain = M.TopicModel.distribution
    monkeypatch.setattr(M.TopicModel, "distribution", lambda self, d: calls.append(1) or plain(self, d))
    assert M.sweep_topics(docs, (2, 3), max_iter=2).count() == 2
    assert len(calls) == 2
    model = M.fit_topics(docs, 2, max_iter=2)
    words = model.words.orderBy("topic_id", "rank").collect()
    assigned = M.with_topics(docs, model).withColumn("topic_id", F.col("topics.topic_id"))
    want = M.topic_words(assigned).orderBy("topic_id", "rank").collect()
    assert [(r.topic_id, r.word) for r in words] == [(r.topic_id, r.word) for r in want]
    assert [r.score for r in words] == pytest.approx([r.score for r in want])
