import random
import re

import pytest
from pyspark.sql import functions as F

from skilldemand.operators import skills as K
from skilldemand.operators.sentiment import score_sentiment


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "posting_id bigint, raw_text string")


def brute_counts(texts, names):
    out = {}
    for i, text in enumerate(texts):
        for name in names:
            n = len(re.findall(r"(?<![a-zA-Z0-9_])" + re.escape(name) + r"(?![a-zA-Z0-9_])", text or "", re.I))
            if n:
                out[i, name] = n
    return out


def as_dict(df):
    return {(r.posting_id, r.skill): r.n for r in df.collect()}


TEXTS = [
    "Must know Python and SQL. PYTHON python, Python!",
    "React and REST API experience",
    "Strong stakeholder management skills; CI/CD, C++ and C++11, Next.js",
    "Apache Spark on Kubernetes, .NET core, R & Go",
    "A/B testing. ſQL and PyThOn_3 sql-server",
    "",
    None,
]


def test_vocab_order_and_first_occurrence(vocab):
    rows = vocab.orderBy("ord").collect()
    names = [r.skill for r in rows]
    assert names[0] == "stakeholder management"
    assert [len(n) for n in names] == sorted((len(n) for n in names), reverse=True)
    assert "SQL" in names and "sql" not in names and "docker" not in names
    assert {r.kind for r in rows if r.skill == "Docker"} == {"technical"}


@pytest.mark.parametrize("inline", [True, False])
def test_match_vocab_equals_brute_force(spark, vocab, inline):
    names = [r.skill for r in vocab.collect()]
    random.seed(3)
    pieces = names + ["foo", "_", "+", ".", " ", "9", "Ünder", "-", "/"]
    texts = TEXTS + ["".join(random.choice(pieces) + random.choice(["", " ", ",", "x"]) for _ in range(40)) for _ in range(60)]
    got = as_dict(K.match_vocab(docs(spark, texts), vocab, inline=inline))
    assert got == brute_counts(texts, names)
    assert got[0, "Python"] == 4 and (1, "R") not in got


def test_terms_without_a_word_are_found(spark):
    vocab = spark.createDataFrame([("++", 0), ("東京", 1), ("\\E.x", 2)], "skill string, ord bigint")
    texts = ["a ++ b", "a++", "at 東京 and 東京", "y \\E.x z \\E.xx"]
    got = as_dict(K.match_vocab(docs(spark, texts), vocab))
    assert got == brute_counts(texts, ["++", "東京", "\\E.x"])


def test_extract_skills(spark, vocab):
    rows = {r.posting_id: [(s.skill, s.n) for s in r.skills] for r in K.extract_skills(docs(spark, TEXTS), vocab).collect()}
    assert rows[0] == [("Python", 4), ("SQL", 1)]
    assert rows[5] == [] and rows[6] == []
    few = K.extract_skills(docs(spark, TEXTS), vocab, min_count=2).where("posting_id = 0").first()
    assert [s.skill for s in few.skills] == ["Python"]


@pytest.mark.parametrize("inline", [True, False])
def test_chunks_add_one_and_sort_last(spark, vocab, inline):
    df = spark.createDataFrame(
        [(1, "SQL and Python and python", ["python", "AGILE", "other", "agile"])],
        "posting_id bigint, raw_text string, chunks array<string>",
    )
    row = K.extract_skills(df, vocab, chunks_col="chunks", inline=inline).first()
    assert [(s.skill, s.n) for s in row.skills] == [("Python", 3), ("SQL", 1), ("agile", 1)]
    chunked = K.match_chunks(df, vocab, "chunks", inline=inline).collect()
    assert sorted(r.skill for r in chunked) == ["Python", "agile"]


@pytest.mark.parametrize("inline", [True, False])
def test_categorise(spark, vocab, inline):
    df = spark.createDataFrame(
        [(1, ["Python", "Agile", "unknown", "stakeholder management"]), (2, [])],
        "posting_id bigint, skills_extracted array<string>",
    )
    rows = {r.posting_id: r for r in K.categorise(df, vocab, inline=inline).collect()}
    assert rows[1].technical == ["Python", "unknown"]
    assert rows[1].soft == ["Agile", "stakeholder management"]
    assert rows[2].technical == [] and rows[2].soft == []


@pytest.mark.parametrize("inline", [True, False])
def test_entities(spark, inline):
    names = [("London", "GPE"), ("Acme Corp", "ORG"), ("the City", "LOC"), ("Jira", "PRODUCT"), ("2026", "DATE")]
    gazetteer = spark.createDataFrame(names, "name string, label string")
    texts = ["Acme Corp, London: use Jira in the City in 2026. London", "london acme corp", ""]
    rows = K.extract_entities(docs(spark, texts), gazetteer, inline=inline).orderBy("posting_id").collect()
    assert rows[0].entities.asDict() == {"orgs": ["Acme Corp"], "locations": ["London", "the City"], "products": ["Jira"]}
    assert rows[1].entities.orgs == [] and rows[2].entities.locations == []


def test_merge_tools_and_phrases(spark):
    df = spark.createDataFrame(
        [(["Acme"], ["Kubernetes", "dbt", "Acme", "Éclair"], ["The Python stack", "a  Python", "our", "nice day", "the python stack"])],
        "orgs array<string>, skills array<string>, chunks array<string>",
    )
    none = F.array().cast("array<string>")
    entities = F.struct("orgs", none.alias("locations"), none.alias("products"))
    row = df.select(
        K.merge_tool_entities(entities, F.col("skills")).alias("e"), K.phrase_skills(F.col("chunks")).alias("p")
    ).first()
    assert row.e.orgs == ["Acme", "Kubernetes", "Éclair"]
    assert row.p == ["python stack", "python"]


LEXICON = [("great", 3.1), ("good", 1.9), ("bad", -2.5), ("toxic", -2.6)]


@pytest.mark.parametrize("inline", [True, False])
def test_sentiment_rules(spark, inline):
    lexicon = spark.createDataFrame(LEXICON, "word string, valence double")
    texts = ["good", "very good", "not good", "GOOD day", "good but bad", "good!!", "", "so very good", "least good", "nothing here"]
    rows = score_sentiment(docs(spark, texts), lexicon, inline=inline).orderBy("posting_id").collect()

    def norm(x):
        return round(x / (x * x + 15) ** 0.5, 4)

    want = [
        norm(1.9),
        norm(1.9 + 0.293),
        norm(1.9 * -0.74),
        norm(1.9 + 0.733),
        norm(1.9 * 0.5 - 2.5 * 1.5),
        norm(1.9 + 2 * 0.292),
        0.0,
        norm(1.9 + 0.293 + 0.293 * 0.95),
        norm(1.9 * -0.74),
        0.0,
    ]
    assert [r.compound for r in rows] == pytest.approx(want, abs=1e-9)
    assert (rows[6].positive, rows[6].negative, rows[6].neutral, rows[6].urgency) == (0.0, 0.0, 1.0, 0)
    assert all(abs(r.positive + r.negative + r.neutral - 1) < 0.002 for r in rows)


@pytest.mark.parametrize("inline", [True, False])
def test_odd_tables_and_ids(spark, inline):
    df = spark.createDataFrame(
        [(1, "python only"), (1, "Python and sql, Good"), (None, "sql good"), (2, None)],
        "posting_id bigint, raw_text string",
    )
    vocab = spark.createDataFrame([("Python", 0), ("Python", 0), ("SQL", 1), (None, 2)], "skill string, ord bigint")
    found = K.extract_skills(df, vocab, inline=inline).collect()
    assert sorted((r.posting_id or 0, [tuple(s) for s in r.skills]) for r in found) == [
        (0, [("SQL", 1)]),
        (1, [("Python", 1)]),
        (1, [("Python", 1), ("SQL", 1)]),
        (2, []),
    ]
    lexicon = spark.createDataFrame([("good", 1.9), ("Good", -3.0), (None, 1.0), ("sql", None)], "word string, valence double")
    scores = sorted(r.compound for r in score_sentiment(df, lexicon, inline=inline).collect())
    assert scores == pytest.approx([0.0, 0.0, 0.4404, 0.4404])


def test_tables_that_cannot_be_inlined_are_refused(spark):
    wide = spark.range(20_001).selectExpr("concat('w', id) skill", "id ord")
    df = docs(spark, ["w3 and w20000"])
    with pytest.raises(ValueError):
        K.match_vocab(df, wide)
    assert as_dict(K.match_vocab(df, wide, inline=False)) == {(0, "w3"): 1, (0, "w20000"): 1}


def test_joined_lookups_shuffle_texts_once_and_terms_alone(spark, tmp_path):
    texts = [(i, f"python and sql {i}" if i % 5 else None) for i in range(200)]
    path = str(tmp_path / "texts")
    spark.createDataFrame(texts, "posting_id long, raw_text string").write.parquet(path)
    docs = spark.read.parquet(path).repartition("posting_id", "raw_text")
    known = spark.createDataFrame([("sql", "technical", 0), ("Python", "technical", 1)], "skill string, kind string, ord bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = K.match_vocab(docs, known, inline=False)
        assert found.count() == 320
        assert {tuple(r)[1:] for r in found.collect()} == {("sql", 1), ("Python", 1)}
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ReusedExchange" in plan
    gathered = [line for line in plan.splitlines() if "collect_set" in line]
    assert gathered and not any("pattern" in line for line in gathered)
