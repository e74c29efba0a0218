"""Registered queries on sources, topics and streams, with their SQL.

Pages, feeds and files are first derived from the given tables, one payload per row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skilldemand.operators import enrich as N
from skilldemand.operators import ingest
from skilldemand.operators import density as D
from skilldemand.operators import term_topics as TT
from skilldemand.operators import topics as M
from skilldemand.plans import adapters as A
from skilldemand.plans.basket_queries import EVENT_SQL
from skilldemand.plans.text_queries import CLEANED_SQL, WS, gazetteer, lexicon, skills_sql, vocab
from skilldemand.session import scratch_dir
from skilldemand.sources import feeds, files, html_pages
from skilldemand.streaming import incremental as I

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Sources


@query(
    "a1_html_pages",
    """SELECT 'reed' AS source, c_mktsegment AS role_category, 'Senior & ' || c_mktsegment || ' Lead' AS title,
      CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'Span ' || c_name ELSE 'Unknown' END AS company,
      CASE WHEN c_custkey % 2 = 0 THEN 'Nation ' || c_nationkey ELSE 'Second ' || c_nationkey END AS location,
      'https://www.reed.co.uk/jobs/x/' || c_custkey AS url, 'Balance ' || c_custkey || ' and more' AS raw_text,
      CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE DATE '2026-01-01' + CAST(c_custkey % 300 AS INTEGER) END AS posted_on
      FROM customer""",
)
def a1(spark, sf):
    key = F.col("c_custkey").cast("string")
    nation = F.col("c_nationkey").cast("string")
    company = (
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('<a class="x-Recruiter-name">'), "c_name", F.lit("</a>")))
        .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit('<span class="recruiter">Span '), "c_name", F.lit("</span>")))
        .otherwise("")
    )
    location = F.when(
        F.col("c_custkey") % 2 == 0,
        F.concat(F.lit('<li class="m-Location">Nation '), nation, F.lit("</li><li>x</li>")),
    ).otherwise(F.concat(F.lit("<li>Second "), nation, F.lit("</li>")))
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")).cast("string")
    time = F.when(F.col("c_custkey") % 5 == 0, "<time>new</time>").otherwise(
        F.concat(F.lit('<time datetime="'), day, F.lit('T09:00:00Z">new</time>'))
    )
    html = F.concat(
        F.lit('<html><body><main><article data-qa="job-card"><h2><a href="/jobs/x/'),
        key,
        F.lit('">Senior &amp; '),
        "c_mktsegment",
        F.lit(" Lead</a></h2><ul><li>"),
        company,
        F.lit("</li>"),
        location,
        F.lit("</ul>"),
        time,
        F.lit('<div class="Description"><p>Balance '),
        key,
        F.lit("</p> <p>and more</p></div></article>"),
        F.lit('<article data-qa="job-card"><h2><a class="title">No link</a></h2></article></main></body></html>'),
    )
    pages = A.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("role_category"), html.alias("html"))
    rows = html_pages.parse_html_pages(pages)
    return rows.withColumn("posted_on", F.to_date("posted_at")).drop("posted_at")


@query(
    "a2_flat_feed",
    """SELECT 'remoteok' AS source, coalesce(nullif(p_name, ''), '') AS title,
      CASE WHEN p_size % 7 = 0 THEN 'Unknown' ELSE p_brand END AS company,
      CASE WHEN p_size % 3 = 0 THEN 'Remote' ELSE p_type END AS location,
      CASE WHEN p_partkey % 5 = 0 THEN 'https://remoteok.com/l/' || p_partkey ELSE 'http://parts/' || p_partkey END AS url,
      'Wanted: ' || p_name || ' & ' || p_brand AS raw_text,
      CASE WHEN p_partkey = 0 THEN NULL ELSE CAST(p_partkey * 3600 AS BIGINT) END AS posted_epoch,
      lower(p_type) || '|data-science' AS tags
      FROM part WHERE p_size % 10 <> 0""",
)
def a2(spark, sf):
    job = F.struct(
        F.col("p_partkey").cast("string").alias("id"),
        (F.col("p_partkey") * 3600).alias("epoch"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("company"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_name")).alias("position"),
        F.array(F.lower("p_type"), F.lit("data-science")).alias("tags"),
        F.concat(F.lit("<p>Wanted: "), "p_name", F.lit(" &amp; <b>"), "p_brand", F.lit("</b></p>")).alias("description"),
        F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("http://parts/"), F.col("p_partkey").cast("string"))).alias("url"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("location"),
    )
    payload = F.concat(F.lit('[{"legal": "terms"}, '), F.to_json(job), F.lit("]"))
    raw = A.table(spark, sf, "part").select(payload.alias("payload"))
    rows = feeds.parse_flat_feed(raw)
    return rows.select(
        "source", "title", "company", "location", "url", "raw_text",
        F.unix_seconds("posted_at").alias("posted_epoch"), F.array_join("tags", "|").alias("tags"),
    )


@query(
    "a3_nested_feed",
    """SELECT 'adzuna' AS source, 'role' || (c_custkey % 4) AS role_category, c_name AS title,
      CASE WHEN c_custkey % 3 = 0 THEN 'Unknown' ELSE c_mktsegment END AS company,
      CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Nation ' || c_nationkey END AS location,
      'http://jobs/' || c_custkey AS url, 'Balance of ' || c_name AS raw_text,
      CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE DATE '2026-01-01' + CAST(c_custkey % 300 AS INTEGER) END AS posted_on
      FROM customer WHERE c_custkey % 10 <> 1 AND c_custkey % 10 <> 2""",
)
def a3(spark, sf):
    key = F.col("c_custkey").cast("string")
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")).cast("string")
    job = F.struct(
        F.when(F.col("c_custkey") % 10 != 1, F.concat(F.lit(" "), "c_name")).alias("title"),
        F.when(F.col("c_custkey") % 10 == 2, " ").otherwise(F.concat(F.lit("http://jobs/"), key)).alias("redirect_url"),
        F.when(F.col("c_custkey") % 3 != 0, F.struct(F.col("c_mktsegment").alias("display_name"))).alias("company"),
        F.when(
            F.col("c_custkey") % 4 != 0,
            F.struct(F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("display_name")),
        ).alias("location"),
        F.concat(F.lit("Balance of "), "c_name", F.lit("\n")).alias("description"),
        F.when(F.col("c_custkey") % 5 != 0, F.concat(day, F.lit("T09:30:00Z"))).alias("created"),
    )
    payload = F.to_json(F.struct(F.array(job).alias("results")))
    raw = A.table(spark, sf, "customer").select(
        F.concat(F.lit("role"), (F.col("c_custkey") % 4).cast("string")).alias("role_category"), payload.alias("payload")
    )
    rows = feeds.parse_nested_feed(raw)
    return rows.withColumn("posted_on", F.to_date("posted_at")).drop("posted_at")


@query(
    "a4_tag_roles",
    """WITH t AS (SELECT p_partkey AS id, lower(p_name || '|' || p_type || '|' || p_brand) AS s FROM part)
      SELECT id, 'round' AS role_category FROM t WHERE contains(s, 'ring') OR contains(s, 'nut')
      UNION ALL SELECT id, 'cheap' FROM t WHERE contains(s, 'economy') OR contains(s, 'small')
      UNION ALL SELECT id, 'Red' FROM t WHERE contains(s, 'red')""",
)
def a4(spark, sf):
    feed = A.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array("p_type", "p_brand").alias("tags")
    )
    keywords = {"round": ["ring", "nut"], "cheap": ["economy", "small"]}
    return ingest.tag_roles(feed, ["round", "cheap", "Red"], keywords).select("id", "role_category")


def _write_csv(df, spark, name):
    path = scratch_dir(spark, name)
    df.write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(
        path, header=True, escape='"', quoteAll=True
    )
    return path


@query(
    "a10_skill_gold",
    """SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS digest, lang || '|' || lower(source) AS skills FROM documents""",
)
def a10(spark, sf):
    skills = F.concat("lang", F.lit(", "), F.upper("source"), F.lit(", ,"), "lang")
    docs = A.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", skills.alias("skills"))
    rows = files.read_skill_gold(spark, _write_csv(docs, spark, "skill-gold"))
    return rows.select("id", F.md5("text").alias("digest"), F.array_join("skills", "|").alias("skills"))


@query(
    "a10_sentiment_gold",
    "SELECT CAST(doc_id AS VARCHAR) AS id, CASE toxic WHEN 1 THEN 'negative' ELSE 'neutral' END AS label, md5(text) AS digest FROM labels JOIN documents USING (doc_id)",
)
def a10_sentiment(spark, sf):
    label = F.when(F.col("toxic") == 1, "negative").otherwise("neutral")
    docs = A.table(spark, sf, "labels").join(A.table(spark, sf, "documents"), "doc_id")
    path = _write_csv(docs.select(F.col("doc_id").alias("id"), label.alias("label"), "text"), spark, "sentiment-gold")
    return files.read_sentiment_gold(spark, path).select("id", "label", F.md5("text").alias("digest"))


@query(
    "a11_corpus",
    f"""SELECT md5(line) AS digest, count(*) AS n FROM (
      SELECT trim(unnest(string_split(text, chr(10))), {WS}) AS line FROM documents) WHERE line <> '' GROUP BY ALL""",
)
def a11(spark, sf):
    path = scratch_dir(spark, "corpus")
    A.table(spark, sf, "documents").select("text").write.text(path)
    return files.read_corpus(spark, path).groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


@query(
    "a12_load_vocab",
    """WITH brands AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS place FROM (SELECT DISTINCT p_brand FROM part)),
      named AS (SELECT p_name AS skill, p_brand AS category, 'technical' AS kind, place,
                       row_number() OVER (PARTITION BY p_brand ORDER BY p_name) - 1 AS pos
                FROM (SELECT DISTINCT p_brand, p_name FROM part) JOIN brands USING (p_brand)
                UNION ALL SELECT upper(p_name), 'soft', 'soft', NULL, row_number() OVER (ORDER BY p_name) - 1
                FROM (SELECT DISTINCT p_name FROM part) UNION ALL
                SELECT p_type, 'soft', 'soft', NULL, 100000 + row_number() OVER (ORDER BY p_type) - 1 FROM (SELECT DISTINCT p_type FROM part)),
      firsts AS (SELECT *, row_number() OVER (PARTITION BY lower(skill) ORDER BY place NULLS LAST, pos) AS n FROM named)
      SELECT skill, category, kind, row_number() OVER (ORDER BY length(skill) DESC, place NULLS LAST, pos) - 1 AS ord FROM firsts WHERE n = 1""",
)
def a12(spark, sf):
    part = A.table(spark, sf, "part")
    entry = F.struct(F.col("p_brand").alias("key"), F.sort_array(F.collect_set("p_name")).alias("value"))
    technical = part.groupBy("p_brand").agg(entry.alias("e")).agg(F.map_from_entries(F.sort_array(F.collect_list("e"))).alias("m"))
    soft = part.agg(
        F.concat(
            F.transform(F.sort_array(F.collect_set("p_name")), F.upper), F.sort_array(F.collect_set("p_type"))
        ).alias("s")
    )
    path = scratch_dir(spark, "vocab")
    technical.select(F.to_json(F.struct(F.col("m").alias("technical"), soft.scalar().alias("soft"))).alias("value")).write.text(path)
    return files.load_vocab(spark, path).drop("pattern")


# Topics


STOP = ["the", "and", "of", "is", "to", "in"]
TERMS_SQL = """words AS (SELECT doc_id AS posting_id, source, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (
    SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}\\p{Pc}]{2,}')) AS w,
           generate_subscripts(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}\\p{Pc}]{2,}'), 1) AS i FROM documents)
  WHERE w NOT IN ('the', 'and', 'of', 'is', 'to', 'in')),
terms AS (SELECT posting_id, source, w AS term FROM words UNION ALL
  SELECT a.posting_id, a.source, a.w || ' ' || b.w FROM words a JOIN words b ON a.posting_id = b.posting_id AND b.i = a.i + 1)"""


@query(
    "c12_topic_features",
    f"""WITH {TERMS_SQL}, tf AS (SELECT posting_id, term, count(*) AS tf FROM terms GROUP BY ALL)
      SELECT posting_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS total, max(tf) AS highest,
             min(term) AS first_term, max(term) AS last_term FROM tf GROUP BY posting_id""",
)
def c12(spark, sf):
    rows = M.topic_features(A.document_postings(spark, sf), "raw_text", stop_words=STOP)
    return rows.groupBy("posting_id").agg(
        F.count("*").alias("n_terms"),
        F.sum("tf").alias("total"),
        F.max("tf").alias("highest"),
        F.min("term").alias("first_term"),
        F.max("term").alias("last_term"),
    )


def _vectors(spark, sf):
    return A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("posting_id"), "embedding")


@query("c13_fit_topics")
def c13(spark, sf):
    """Clusters of the embeddings: size and mean probability of each topic."""
    docs = _vectors(spark, sf)
    model = M.fit_topics(docs, 10, embedding_col="embedding", path=scratch_dir(spark, "topics"))
    return (
        M.assign_topics(docs, model)
        .groupBy("topics.topic_id")
        .agg(F.count("*").alias("n"), F.avg("topics.probability").alias("mean_probability"))
    )


DENSITY_SQL = """WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS (SELECT a.id AS x, b.id AS y, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON list_distance(a.e, b.e) <= 1.15),
counts AS (SELECT x AS id, count(*) AS neighbours, count(*) >= 5 AS core FROM near GROUP BY x),
links AS (SELECT x, y FROM near JOIN counts p ON p.id = x AND p.core JOIN counts q ON q.id = y AND q.core),
reach AS (SELECT id AS x, id AS y FROM counts WHERE core UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
comps AS (SELECT x AS id, min(y) AS component FROM reach GROUP BY x),
border AS (SELECT x AS id, component FROM near JOIN counts p ON p.id = x AND NOT p.core JOIN comps c ON c.id = y
  QUALIFY row_number() OVER (PARTITION BY x ORDER BY d, y) = 1),
members AS (SELECT * FROM comps UNION ALL SELECT * FROM border),
numbered AS (SELECT component, row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS topic_id FROM members GROUP BY component)
SELECT id AS posting_id, CAST(coalesce(topic_id, -1) AS INTEGER) AS topic_id, core AS is_core, neighbours
FROM counts LEFT JOIN members USING (id) LEFT JOIN numbered USING (component)"""


@query("c13_density_topics", DENSITY_SQL)
def c13_density(spark, sf):
    """Dense regions of the embeddings, and outliers."""
    return D.density_topics(_vectors(spark, sf), eps=1.15, min_points=5)


# No SQL: rounds until the sum of cosines settles; a test does the same with numpy.
@query("c13_term_topics")
def c13_terms(spark, sf):
    """Topics of the documents' words: their documents and mean cosine."""
    docs = A.document_postings(spark, sf).withColumnRenamed("raw_text", "text")
    model = TT.fit_term_topics(docs, 5)
    rows = model.assign(docs)
    return rows.groupBy("topics.topic_id").agg(F.count("*").alias("n"), F.avg("topics.probability").alias("mean_probability"))


@query("c14_assign_topics")
def c14(spark, sf):
    """Topics of the documents' texts, from a model that is saved and loaded again."""
    docs = A.document_postings(spark, sf).withColumnRenamed("raw_text", "text")
    path = scratch_dir(spark, "topics")
    M.fit_topics(docs, 5, path=path)
    model = M.get_or_fit(spark, path, docs, 5)
    spread = A.spread_postings(spark, sf).withColumnRenamed("raw_text", "text")
    return M.assign_topics(spread, model, min_probability=0.3).select("posting_id", "topics.*")


def _by_source(spark, sf):
    """The source of a document as its topic."""
    docs = A.spread_postings(spark, sf).withColumnRenamed("raw_text", "text")
    return docs.withColumn("topic_id", F.substring("source", 4, 9).cast("int"))


TOPIC_WORDS_SQL = f"""{TERMS_SQL},
counted AS (SELECT CAST(substr(source, 4) AS INTEGER) AS topic_id, term AS word, count(*) AS tf FROM terms GROUP BY ALL),
total AS (SELECT sum(tf) / count(DISTINCT topic_id) AS a FROM counted),
scored AS (SELECT topic_id, word, tf * ln(1 + a / sum(tf) OVER (PARTITION BY word)) AS score FROM counted, total),
ranked AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, word) AS rank FROM scored)"""


@query(
    "c15_topic_words",
    f"WITH {TOPIC_WORDS_SQL} SELECT topic_id, rank, word, CAST(score AS DECIMAL(18,4)) AS score FROM ranked WHERE rank <= 10",
)
def c15(spark, sf):
    rows = M.topic_words(_by_source(spark, sf), 10, stop_words=STOP)
    return rows.select(
        "topic_id", F.col("rank").cast("bigint").alias("rank"), "word", F.col("score").cast("decimal(18,4)").alias("score")
    )


TOPIC_WORDS = {
    0: ["pathetic", "clown", "moron", "disgusting", "loser"],
    1: ["worthless", "trash", "stupid", "scum", "idiot"],
    2: ["without", "there", "whose", "idiot", "nosuchword"],
}


# No SQL: the sliding windows take it minutes on whole tables; a test does the same by brute force.
@query("c16_coherence")
def c16(spark, sf):
    docs = A.spread_postings(spark, sf).withColumnRenamed("raw_text", "text")
    rows = [(t, w) for t, ws in TOPIC_WORDS.items() for w in ws]
    return M.coherence(docs, spark.createDataFrame(rows, "topic_id int, word string"))


@query("c17_sweep_topics")
def c17(spark, sf):
    docs = A.document_postings(spark, sf).withColumnRenamed("raw_text", "text")
    return M.sweep_topics(docs)


# Streams


ROWS_PER_FILE = 100_000
TEXTS_PER_FILE = 4_000


def _arrivals(spark, df, name, batches=4, rows=ROWS_PER_FILE):
    """The rows as files that arrive in a few batches; a file has a bounded number of rows."""
    path = scratch_dir(spark, name)
    files = max(batches, -(-df.count() // rows))
    df.repartition(files).write.parquet(path)
    return I.read_arrivals(spark, path, df.schema, files_per_batch=-(-files // batches))


@query("i1_incremental_ingest", "SELECT DISTINCT 'http://events/' || (event_id % 1000) AS url, 1 AS copies FROM events")
def i1(spark, sf):
    rows = A.event_postings(spark, sf).withColumn("source_ord", F.lit(0))
    arrivals = _arrivals(spark, rows, "arrivals")
    store = scratch_dir(spark, "postings")
    I.ingest_stream(arrivals, store, scratch_dir(spark, "checkpoint"), A.EVENT_ROLES).awaitTermination()
    stored = I.read_batches(spark, store, rows.schema)  # urls repeat across batches
    return stored.groupBy("url").agg(F.count("*").cast("int").alias("copies"))


@query("i2_incremental_enrich", f"WITH {CLEANED_SQL} SELECT posting_id, names AS skills FROM ({skills_sql('docs')})")
def i2(spark, sf):
    rows = A.document_postings(spark, sf).select("posting_id", "raw_text")
    arrivals = _arrivals(spark, rows, "arrivals", 2, TEXTS_PER_FILE)
    out = scratch_dir(spark, "processed")
    known = (vocab(spark), lexicon(spark), gazetteer(spark))
    I.enrich_stream(arrivals, lambda b: N.enrich(b, *known), out, scratch_dir(spark, "checkpoint")).awaitTermination()
    return N.read_processed(spark, out).select("posting_id", F.array_join("skills_extracted", "|").alias("skills"))


@query("i3_incremental_weekly_counts", EVENT_SQL + "SELECT skill, role_category, week_start, mention_count FROM trends")
def i3(spark, sf):
    # the wall time of the table read as UTC, whatever the session's zone
    utc = F.from_utc_timestamp(F.col("scraped_at").cast("timestamp"), F.current_timezone())
    rows = A.event_postings(spark, sf).select("role_category", F.col("raw_text").alias("skill"), utc.alias("scraped_at"))
    counts = I.weekly_counts(_arrivals(spark, rows, "arrivals"), "60 days")
    out = scratch_dir(spark, "counts")
    I.weekly_counts_stream(counts, out, scratch_dir(spark, "checkpoint")).awaitTermination()
    return I.current_counts(spark, out)


@query("i4_late_rows", EVENT_SQL + "SELECT * FROM trends")
def i4(spark, sf):
    processed = A.event_processed(spark, sf)
    rows = A.event_postings(spark, sf).join(processed, "posting_id").select(
        "posting_id", "role_category", "scraped_at", "skills_extracted"
    )
    out = scratch_dir(spark, "trend-batches")
    I.trends_stream(_arrivals(spark, rows, "arrivals"), out, scratch_dir(spark, "checkpoint")).awaitTermination()
    return I.trends_of_batches(spark, out)
