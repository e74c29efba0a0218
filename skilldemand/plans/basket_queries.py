"""Registered queries on the basket and event tables, with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skilldemand.functions.bands import (
    age_text,
    confidence_band,
    match_band,
    momentum_badge,
    sentiment_band,
    staleness,
)
from skilldemand.functions.dates import week_start
from skilldemand.operators import ingest, postings as P, trends as T, weekly
from skilldemand.plans import adapters as A
from skilldemand.plans.digest import weekly_digest
from skilldemand.session import scratch_dir
from skilldemand.sources import store

Frame = DataFrame
ROLES = A.BASKET_ROLES
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def dec(col: str):
    return F.col(col).cast("decimal(18,6)").alias(col)


BASKET_SQL = """
WITH lines AS (
  SELECT l_orderkey AS posting_id, p_name, l_discount, l_tax, l_returnflag, l_linenumber
  FROM lineitem JOIN part ON l_partkey = p_partkey),
postings AS (
  SELECT o_orderkey AS posting_id, o_orderstatus AS source, o_orderpriority AS role_category,
         o_orderdate AS scraped_at, 'needed now ' || o_orderpriority AS raw_text,
         CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start FROM orders),
processed AS (
  SELECT posting_id, list_sort(list(DISTINCT p_name)) AS skills, avg(l_discount) AS sentiment_score,
         min(l_returnflag) AS topic_label, min(l_linenumber) AS topic_id, avg(l_tax) AS probability
  FROM lines GROUP BY posting_id),
mentions AS (
  SELECT p_name AS skill, role_category, week_start, count(DISTINCT posting_id) AS mention_count
  FROM lines JOIN postings USING (posting_id) GROUP BY ALL),
totals AS (SELECT role_category, week_start, count(*) AS total_postings FROM postings GROUP BY ALL),
trends AS (
  SELECT skill, role_category, week_start, mention_count,
         CAST(printf('%.4f', mention_count / total_postings) AS DOUBLE) AS pct_of_postings
  FROM mentions JOIN totals USING (role_category, week_start)),
latest AS (SELECT max(week_start) AS w FROM trends),
trending AS (
  SELECT *, CAST(printf('%.1f', change) AS DOUBLE) AS wow_change, change > 20 AS is_rising FROM (
    SELECT c.*, coalesce(p.mention_count, 0) AS previous_count,
           CASE WHEN coalesce(p.mention_count, 0) = 0 THEN 100.0::DOUBLE
                ELSE (c.mention_count - p.mention_count)::DOUBLE / p.mention_count * 100.0 END AS change
    FROM trends c JOIN latest ON c.week_start = w
    LEFT JOIN trends p ON p.skill = c.skill AND p.role_category = c.role_category
         AND p.week_start = w - 7))
"""

EVENT_SQL = """
WITH postings AS (
  SELECT event_id AS posting_id, 'r' || (user_id % 10) AS role_category, event_type AS skill, ts,
         CAST(date_trunc('week', ts) AS DATE) AS week_start FROM events),
totals AS (SELECT role_category, week_start, count(*) AS total_postings FROM postings GROUP BY ALL),
trends AS (
  SELECT skill, role_category, week_start, count(*) AS mention_count,
         CAST(printf('%.4f', count(*) / any_value(total_postings)) AS DOUBLE) AS pct_of_postings
  FROM postings JOIN totals USING (role_category, week_start) GROUP BY ALL),
latest AS (SELECT max(week_start) AS w FROM trends)
"""

# Change between the two newest rows of a key; used on both tables.
WOW_SQL = """,
last_two AS (
  SELECT *, row_number() OVER (PARTITION BY skill, role_category ORDER BY week_start DESC) AS n FROM trends),
wow AS (
  SELECT skill, role_category, CAST(printf('%.1f', change) AS DOUBLE) AS change_pct, change > 20 AS is_rising,
         current_count, previous_count, current_week, previous_week
  FROM (SELECT *, CASE WHEN previous_count = 0 THEN 100.0::DOUBLE
                       ELSE (current_count - previous_count)::DOUBLE / previous_count * 100.0 END AS change
        FROM (SELECT c.skill, c.role_category, c.mention_count AS current_count,
                     coalesce(p.mention_count, 0) AS previous_count,
                     c.week_start AS current_week, p.week_start AS previous_week
              FROM last_two c LEFT JOIN last_two p
                ON p.skill = c.skill AND p.role_category = c.role_category AND p.n = 2
              WHERE c.n = 1))),
rising AS (
  SELECT *, row_number() OVER (PARTITION BY role_category ORDER BY change_pct DESC, skill) AS rank
  FROM wow WHERE current_week = (SELECT max(t.week_start) FROM trends t WHERE t.role_category = wow.role_category))
"""

PAIRS_SQL = """,
named AS (SELECT DISTINCT posting_id, role_category, p_name AS skill FROM lines JOIN postings USING (posting_id)),
pairs AS (
  SELECT a.role_category, a.skill AS skill_a, b.skill AS skill_b, count(*) AS count
  FROM named a JOIN named b ON a.posting_id = b.posting_id AND a.skill < b.skill GROUP BY ALL)
"""


def cosine_sql(source: str) -> str:
    return source + """,
vectors AS (SELECT role_category, skill, avg(pct_of_postings) AS w FROM trends GROUP BY ALL),
norms AS (SELECT role_category, sqrt(sum(w * w)) AS norm FROM vectors GROUP BY ALL),
cosines AS (
  SELECT a.role_category AS role_a, b.role_category AS role_b,
         CAST(printf('%.4f', greatest(0.0, least(1.0, sum(a.w * b.w) / (any_value(n.norm) * any_value(m.norm))))) AS DOUBLE) AS similarity
  FROM vectors a JOIN vectors b USING (skill)
  JOIN norms n ON n.role_category = a.role_category JOIN norms m ON m.role_category = b.role_category
  GROUP BY ALL),
names AS (SELECT DISTINCT role_category AS r FROM trends),
matrix AS (
  SELECT x.r AS role_a, y.r AS role_b,
         CASE WHEN x.r = y.r THEN 1.0::DOUBLE ELSE coalesce(similarity, 0.0) END AS similarity
  FROM names x CROSS JOIN names y LEFT JOIN cosines ON role_a = x.r AND role_b = y.r)
"""


def emerging_sql(source: str, lookback: int, min_current: int, max_old: float) -> str:
    return source + f""",
history AS (
  SELECT skill, role_category, max(pct_of_postings) AS max_old FROM trends, latest
  WHERE week_start >= w - {7 * lookback} AND week_start < w GROUP BY ALL),
emerging AS (
  SELECT c.skill, c.role_category,
         CAST(printf('%.1f', CASE WHEN coalesce(o.mention_count, 0) = 0 THEN 100.0::DOUBLE
           ELSE (c.mention_count - o.mention_count)::DOUBLE / o.mention_count * 100.0 END) AS DOUBLE) AS growth_pct,
         c.mention_count AS current_count, coalesce(o.mention_count, 0) AS old_count, c.week_start AS current_week
  FROM trends c JOIN latest ON c.week_start = w
  LEFT JOIN history h ON h.skill = c.skill AND h.role_category = c.role_category
  LEFT JOIN trends o ON o.skill = c.skill AND o.role_category = c.role_category AND o.week_start = w - {7 * lookback}
  WHERE c.mention_count >= {min_current} AND coalesce(h.max_old, 0.0) <= {max_old})
"""


# Ingest


@query(
    "a5_union_sources",
    """SELECT o_orderkey AS posting_id, o_orderstatus AS source,
       CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS source_ord FROM orders""",
)
def a5(spark: SparkSession, sf: str) -> Frame:
    rows = A.basket_postings(spark, sf)
    parts = [rows.where(F.col("source") == s) for s in ("F", "O", "P")]
    return ingest.union_sources(*parts).select("posting_id", "source", "source_ord")


@query(
    "a6_stamp",
    """SELECT o_orderkey AS posting_id, '' AS location, 'needed now ' || o_orderpriority AS raw_text,
       DATE '2026-04-14' AS scraped_on, false AS is_processed FROM orders""",
)
def a6(spark, sf):
    rows = ingest.stamp(A.basket_postings(spark, sf), F.expr("timestamp_ntz'2026-04-14 10:00:00'"))
    return rows.select(
        "posting_id", "location", "raw_text", F.to_date("scraped_at").alias("scraped_on"), "is_processed"
    )


def _by_customer(spark, sf):
    orders = A.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customer = F.concat(F.lit("http://shop/"), F.col("o_custkey").cast("string"))
    rows = A.basket_postings(spark, sf).join(orders, F.col("posting_id") == F.col("o_orderkey"))
    return rows.withColumn("url", customer).withColumn(
        "source_ord", ingest.order_of(F.col("source"), ["P", "O", "F"])
    )


@query(
    "a7_dedupe_against",
    """SELECT o_orderkey AS posting_id, 'http://shop/' || o_custkey AS url FROM orders
       WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def a7(spark, sf):
    rows = _by_customer(spark, sf)
    new, stored = rows.where("source != 'F'"), rows.where("source = 'F'")
    return ingest.dedupe_against(new, stored).select("posting_id", "url")


@query(
    "a8_first_per_url",
    """SELECT posting_id, url FROM (
         SELECT o_orderkey AS posting_id, 'http://shop/' || o_custkey AS url,
                row_number() OVER (PARTITION BY o_custkey ORDER BY
                  CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderpriority, o_orderkey) AS n
         FROM orders) WHERE n = 1""",
)
def a8(spark, sf):
    return ingest.first_per_url(_by_customer(spark, sf), ROLES, tiebreak=["posting_id"]).select("posting_id", "url")


@query(
    "a9_ingest_summary",
    """SELECT o_orderstatus AS source, o_orderpriority AS role_category, count(*) AS saved
       FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
)
def a9(spark, sf):
    return ingest.ingest_summary(A.basket_postings(spark, sf))


@query(
    "a13_table_store",
    BASKET_SQL + "SELECT week_start, count(*) AS n_rows, CAST(sum(mention_count) AS BIGINT) AS mentions FROM trends GROUP BY ALL",
)
def a13(spark, sf):
    base = scratch_dir(spark, "store")
    store.write_table(A.build_basket_trends(spark, sf), base, "trends", "overwrite")
    return (
        store.read_table(spark, base, "trends")
        .groupBy("week_start")
        .agg(F.count("*").alias("n_rows"), F.sum("mention_count").alias("mentions"))
    )


@query("a13_upsert_trends", BASKET_SQL + "SELECT * FROM trends")
def a13_upsert(spark, sf):
    """The even postings stored, the odd ones merged in as a run, and the run repeated."""
    base = scratch_dir(spark, "store")
    rows, done = A.basket_postings(spark, sf), A.basket_processed(spark, sf)
    even = F.col("posting_id") % 2 == 0
    store.write_table(weekly.build_trends(rows.where(even), done.where(even)), base, "trends", "overwrite", "even")
    delta = weekly.skill_mentions(rows.where(~even), done.where(~even))
    for _ in range(2):
        store.upsert_trends(spark, base, delta, weekly.weekly_totals(rows), "odd")
    return store.read_table(spark, base, "trends")


@query(
    "a14_export_trending",
    BASKET_SQL + "SELECT skill, role_category, week_start, mention_count, pct_of_postings, wow_change FROM trending",
)
def a14(spark, sf):
    path = scratch_dir(spark, "trending-csv")
    store.export_trending(A.basket_trends(spark, sf), path)
    schema = (
        "skill string, role_category string, week_start date, mention_count bigint, "
        "pct_of_postings double, wow_change double"
    )
    return spark.read.schema(schema).csv(path, header=True)


USER_SKILLS = ["Hot Ring", "small ring", "red plate", " RED BOLT ", "blue nut", "no such skill"]
GAP_SQL = BASKET_SQL + """,
owned AS (SELECT DISTINCT lower(trim(s)) AS key FROM (SELECT unnest(
  ['Hot Ring', 'small ring', 'red plate', ' RED BOLT ', 'blue nut', 'no such skill']) AS s)),
ranked AS (
  SELECT lower(role_category) AS role_category, skill, mention_count, pct_of_postings,
         row_number() OVER (PARTITION BY role_category ORDER BY mention_count DESC, skill) AS rank
  FROM trends JOIN latest ON week_start = w),
gap AS (
  SELECT role_category, skill, CASE WHEN rank > 5 THEN 'bonus' WHEN lower(skill) IN (SELECT key FROM owned)
           THEN 'matched' ELSE 'missing' END AS status,
         CAST(printf('%.1f', pct_of_postings * 100) AS DOUBLE) AS demand_pct, rank, mention_count, pct_of_postings
  FROM ranked WHERE rank <= 5 OR lower(skill) IN (SELECT key FROM owned))
"""


def _lower_role_trends(spark, sf):
    return A.basket_trends(spark, sf).withColumn("role_category", F.lower("role_category"))


@query("a15_export_gap", GAP_SQL + "SELECT skill, status, demand_pct, role_category FROM gap WHERE role_category = '1-urgent'")
def a15(spark, sf):
    path = scratch_dir(spark, "gap-csv")
    store.export_gap(_lower_role_trends(spark, sf), "1-Urgent ", USER_SKILLS, path, top_n=5)
    schema = "skill string, status string, demand_pct double, role_category string"
    return spark.read.schema(schema).csv(path, header=True)


# Bands


@query(
    "c8_sentiment_band",
    """WITH s AS (SELECT l_discount - 0.05 AS score, l_discount * 10 AS sure, l_returnflag AS flag FROM lineitem)
       SELECT CASE WHEN score >= 0.15 THEN 'positive' WHEN score <= -0.05 THEN 'negative' ELSE 'neutral' END AS wide,
              CASE WHEN score >= 0.08 THEN 'positive' WHEN score <= -0.03 THEN 'negative' ELSE 'neutral' END AS narrow,
              CASE WHEN score > 0.05 THEN 'positive' WHEN score < -0.05 THEN 'negative' ELSE 'neutral' END AS strict,
              CASE WHEN sure < 0.75 THEN 'neutral' WHEN flag = 'A' THEN 'positive' ELSE 'negative' END AS confident,
              count(*) AS n
       FROM s GROUP BY ALL""",
)
def c8(spark, sf):
    score = F.col("l_discount") - F.lit(0.05)
    label = F.when(F.col("l_returnflag") == "A", "POSITIVE").otherwise("NEGATIVE")
    return (
        A.table(spark, sf, "lineitem")
        .groupBy(
            sentiment_band(score).alias("wide"),
            sentiment_band(score, 0.08, -0.03).alias("narrow"),
            sentiment_band(score, 0.05, -0.05, strict=True).alias("strict"),
            confidence_band(label, F.col("l_discount") * 10).alias("confident"),
        )
        .agg(F.count("*").alias("n"))
    )


@query(
    "c10_merge_tool_entities",
    BASKET_SQL + """, named AS (
       SELECT l_orderkey AS posting_id, unnest([p_brand, CASE WHEN upper(p_type[1]) = p_type[1] THEN p_type ELSE p_brand END]) AS s
       FROM lineitem JOIN part ON l_partkey = p_partkey)
       SELECT posting_id, string_agg(DISTINCT s, '|' ORDER BY s) AS orgs FROM named GROUP BY ALL""",
)
def c10(spark, sf):
    from skilldemand.operators.skills import merge_tool_entities

    parts = A.table(spark, sf, "part")
    none = F.array().cast("array<string>")
    rows = (
        A.table(spark, sf, "lineitem")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("posting_id"))
        .agg(
            F.collect_set("p_brand").alias("brands"),
            F.array_union(F.collect_set("p_type"), F.collect_set("p_name")).alias("skills"),
        )
    )
    entities = F.struct(F.col("brands").alias("orgs"), none.alias("locations"), none.alias("products"))
    merged = merge_tool_entities(entities, F.col("skills"))
    return rows.select("posting_id", F.array_join(merged["orgs"], "|").alias("orgs"))


# Enrichment run and weekly aggregate


@query(
    "d1_unprocessed",
    """SELECT o_orderkey AS posting_id, CAST(o_orderdate AS DATE) AS day FROM orders
       WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def d1(spark, sf):
    rows = P.unprocessed(A.basket_postings(spark, sf), A.basket_processed(spark, sf))
    return rows.select("posting_id", F.to_date("scraped_at").alias("day"))


@query(
    "d1_unprocessed_batch",
    """SELECT o_orderkey AS posting_id, CAST(o_orderdate AS DATE) AS day FROM orders
       WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderpriority = '2-HIGH'
       ORDER BY o_orderdate, o_orderkey LIMIT 50""",
)
def d1_batch(spark, sf):
    rows = P.unprocessed(A.basket_postings(spark, sf), A.basket_processed(spark, sf), 50, "2-HIGH")
    return rows.select("posting_id", F.to_date("scraped_at").alias("day"))


@query("e1_week_start", "SELECT o_orderkey AS posting_id, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start FROM orders")
def e1(spark, sf):
    return A.basket_postings(spark, sf).select("posting_id", week_start(F.col("scraped_at")).alias("week_start"))


@query("e2_skill_mentions", BASKET_SQL + "SELECT * FROM mentions")
def e2(spark, sf):
    return weekly.skill_mentions(A.basket_postings(spark, sf), A.basket_processed(spark, sf))


@query("e3_weekly_totals", BASKET_SQL + "SELECT * FROM totals")
def e3(spark, sf):
    return weekly.weekly_totals(A.basket_postings(spark, sf))


@query("e4_build_trends", BASKET_SQL + "SELECT * FROM trends")
def e4(spark, sf):
    return A.build_basket_trends(spark, sf)


@query("e4_build_trends_events", EVENT_SQL + "SELECT * FROM trends")
def e4_events(spark, sf):
    return A.build_event_trends(spark, sf)


@query("e5_merge_trends", BASKET_SQL + "SELECT * FROM trends")
def e5(spark, sf):
    """Half of the postings stored, the other half merged in."""
    rows, done = A.basket_postings(spark, sf), A.basket_processed(spark, sf)
    even = F.col("posting_id") % 2 == 0
    stored = weekly.build_trends(rows.where(even), done.where(even))
    delta = weekly.skill_mentions(rows.where(~even), done.where(~even))
    return weekly.merge_trends(stored, delta, weekly.weekly_totals(rows))


# Skill analytics


@query("f1_latest_week", BASKET_SQL + "SELECT w AS latest_week FROM latest")
def f1(spark, sf):
    return T.latest_week(A.basket_trends(spark, sf))


@query("f2_trending", BASKET_SQL + "SELECT skill, role_category, week_start, mention_count, pct_of_postings, wow_change, is_rising FROM trending")
def f2(spark, sf):
    return T.trending(A.basket_trends(spark, sf))


@query(
    "f2_trending_role",
    BASKET_SQL + """SELECT skill, role_category, week_start, mention_count, pct_of_postings, wow_change, is_rising
                    FROM trending WHERE role_category = '5-LOW'""",
)
def f2_role(spark, sf):
    return T.trending(A.basket_trends(spark, sf), "5-LOW")


@query(
    "f3_trending_page",
    BASKET_SQL + """SELECT skill, role_category, mention_count, wow_change FROM trending
                    ORDER BY mention_count DESC, skill, role_category LIMIT 10 OFFSET 10""",
)
def f3(spark, sf):
    data, _ = T.trending_page(A.basket_trends(spark, sf), page=2, page_size=10)
    return data.select("skill", "role_category", "mention_count", "wow_change")


@query(
    "f3_trending_envelope",
    BASKET_SQL + """SELECT CAST(least(99, pages) AS INTEGER) AS page, 10 AS page_size, n AS total_count,
        CAST(pages AS INTEGER) AS total_pages, false AS has_next, pages > 1 AS has_prev
        FROM (SELECT count(*) AS n, greatest(1, ceil(count(*) / 10)) AS pages FROM trending)""",
)
def f3_envelope(spark, sf):
    return T.trending_page(A.basket_trends(spark, sf), page=99, page_size=10)[1]


@query("f4_wow_change", BASKET_SQL + WOW_SQL + "SELECT * FROM wow")
def f4(spark, sf):
    return T.wow_change(A.basket_trends(spark, sf))


@query(
    "f4_wow_change_keys",
    EVENT_SQL + WOW_SQL + """SELECT k.skill, k.role_category, coalesce(change_pct, 0.0) AS change_pct,
      coalesce(is_rising, false) AS is_rising, coalesce(current_count, 0) AS current_count,
      coalesce(previous_count, 0) AS previous_count, current_week, previous_week
      FROM (SELECT DISTINCT event_type || CASE WHEN user_id % 3 = 0 THEN '?' ELSE '' END AS skill,
                   'r' || (user_id % 10) AS role_category FROM events) k
      LEFT JOIN wow ON wow.skill = k.skill AND wow.role_category = k.role_category""",
)
def f4_keys(spark, sf):
    keys = A.table(spark, sf, "events").select(
        F.when(F.col("user_id") % 3 == 0, F.concat("event_type", F.lit("?"))).otherwise(F.col("event_type")).alias("skill"),
        F.concat(F.lit("r"), (F.col("user_id") % 10).cast("string")).alias("role_category"),
    )
    return T.wow_change(A.event_trends(spark, sf), keys)


@query("f5_rising_skills", BASKET_SQL + WOW_SQL + "SELECT * FROM rising WHERE rank <= 10")
def f5(spark, sf):
    return T.rising_skills(A.basket_trends(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@query("f5_rising_skills_events", EVENT_SQL + WOW_SQL + "SELECT * FROM rising WHERE rank <= 3")
def f5_events(spark, sf):
    return T.rising_skills(A.event_trends(spark, sf), top_n=3).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "f6_cooccurrence",
    BASKET_SQL + PAIRS_SQL + """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role_category
        ORDER BY count DESC, skill_a, skill_b) AS rank FROM pairs WHERE count >= 2) WHERE rank <= 20""",
)
def f6(spark, sf):
    rows = T.cooccurrence(A.basket_postings(spark, sf), A.basket_processed(spark, sf))
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "f7_cooccurrence_matrix",
    BASKET_SQL + PAIRS_SQL + """SELECT * FROM pairs
        UNION ALL SELECT role_category, skill_b, skill_a, count FROM pairs
        UNION ALL SELECT role_category, skill, skill, count(*) FROM named GROUP BY role_category, skill""",
)
def f7(spark, sf):
    return T.cooccurrence_matrix(A.basket_postings(spark, sf), A.basket_processed(spark, sf))


@query("f7_cooccurrence_skills", BASKET_SQL + PAIRS_SQL + "SELECT DISTINCT role_category, skill FROM named")
def f7_skills(spark, sf):
    return T.cooccurrence_skills(A.basket_postings(spark, sf), A.basket_processed(spark, sf))


@query("f8_role_similarity", cosine_sql(BASKET_SQL) + "SELECT * FROM matrix WHERE role_a = '1-URGENT' AND role_b = '5-LOW'")
def f8(spark, sf):
    return T.role_similarity(A.basket_trends(spark, sf), "1-URGENT", "5-LOW")


@query("f9_similarity_matrix", cosine_sql(BASKET_SQL) + "SELECT * FROM matrix")
def f9(spark, sf):
    return T.similarity_matrix(A.basket_trends(spark, sf), ROLES).drop("row", "col")


@query("f9_similarity_matrix_events", cosine_sql(EVENT_SQL) + "SELECT * FROM matrix")
def f9_events(spark, sf):
    return T.similarity_matrix(A.event_trends(spark, sf), A.EVENT_ROLES).drop("row", "col")


SIMILAR_SQL = cosine_sql(BASKET_SQL) + """,
upper_half AS (SELECT * FROM matrix WHERE role_a < role_b)
SELECT * FROM (SELECT 'most' AS section, * FROM upper_half ORDER BY similarity DESC, role_a, role_b LIMIT 5)
UNION ALL
SELECT * FROM (SELECT 'least' AS section, * FROM upper_half ORDER BY similarity, role_a DESC, role_b DESC LIMIT 3)
"""


@query("f10_similar_pairs", SIMILAR_SQL)
def f10(spark, sf):
    return T.similar_pairs(A.basket_trends(spark, sf), ROLES)


@query("f11_emerging", emerging_sql(BASKET_SQL, 4, 1, 0.08) + "SELECT * FROM emerging")
def f11(spark, sf):
    return T.emerging(A.basket_trends(spark, sf), min_current=1, max_old_pct=0.08)


@query("f11_emerging_events", emerging_sql(EVENT_SQL, 3, 3, 0.25) + "SELECT * FROM emerging")
def f11_events(spark, sf):
    return T.emerging(A.event_trends(spark, sf), lookback_weeks=3, max_old_pct=0.25)


COMPARED = ["1-URGENT", "3-MEDIUM", "5-LOW"]
COMPARE_SQL = cosine_sql(BASKET_SQL) + """,
best AS (
  SELECT role_category, skill, max(pct_of_postings) AS pct FROM trends
  WHERE role_category IN ('1-URGENT', '3-MEDIUM', '5-LOW') GROUP BY ALL),
owners AS (SELECT skill, count(*) AS n_roles, max(pct) AS max_pct FROM best GROUP BY ALL)
"""


@query(
    "f12_compare_overlap",
    COMPARE_SQL + """SELECT count(*) FILTER (WHERE n_roles = 3) AS shared, count(*) AS "union",
      CAST(printf('%.1f', count(*) FILTER (WHERE n_roles = 3) / count(*) * 100) AS DOUBLE) AS overlap_pct,
      (SELECT similarity FROM matrix WHERE role_a = '1-URGENT' AND role_b = '3-MEDIUM') AS similarity_score FROM owners""",
)
def f12(spark, sf):
    return T.compare_overlap(A.basket_trends(spark, sf), COMPARED)


@query("f12_compare_shared", COMPARE_SQL + "SELECT skill, max_pct FROM owners WHERE n_roles = 3")
def f12_shared(spark, sf):
    return T.compare_shared(A.basket_trends(spark, sf), COMPARED)


@query(
    "f13_compare_profiles",
    COMPARE_SQL + """, ranked AS (
      SELECT b.*, n_roles, row_number() OVER (PARTITION BY role_category ORDER BY pct DESC, skill) AS t,
             row_number() OVER (PARTITION BY role_category, n_roles = 1 ORDER BY pct DESC, skill) AS u
      FROM best b JOIN owners USING (skill))
      SELECT role_category, 'top' AS section, t AS rank, skill, pct FROM ranked WHERE t <= 10
      UNION ALL SELECT role_category, 'unique', u, skill, pct FROM ranked WHERE n_roles = 1 AND u <= 10""",
)
def f13(spark, sf):
    rows = T.compare_profiles(A.basket_trends(spark, sf), COMPARED)
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


@query("f14_skill_gap", GAP_SQL + "SELECT role_category, skill, status, demand_pct, rank FROM gap WHERE role_category = '3-medium'")
def f14(spark, sf):
    gap = T.skill_gap(_lower_role_trends(spark, sf), " 3-MEDIUM", USER_SKILLS, top_n=5)
    return gap.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "f14_skill_gap_users",
    GAP_SQL + """, users AS (
      SELECT DISTINCT o_custkey AS user_id, lower(o_orderpriority) AS role_category, lower(p_name) AS key
      FROM orders JOIN lines ON posting_id = o_orderkey)
      SELECT u.user_id, r.role_category, r.skill,
             CASE WHEN k.key IS NULL THEN 'missing' ELSE 'matched' END AS status,
             CAST(printf('%.1f', pct_of_postings * 100) AS DOUBLE) AS demand_pct, rank
      FROM (SELECT DISTINCT user_id, role_category FROM users) u
      JOIN ranked r ON r.role_category = u.role_category AND rank <= 5
      LEFT JOIN users k ON k.user_id = u.user_id AND k.role_category = u.role_category AND k.key = lower(r.skill)
      UNION ALL
      SELECT u.user_id, r.role_category, r.skill, 'bonus', CAST(printf('%.1f', pct_of_postings * 100) AS DOUBLE), rank
      FROM users u JOIN ranked r ON r.role_category = u.role_category AND r.rank > 5 AND lower(r.skill) = u.key""",
)
def f14_users(spark, sf):
    orders = A.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    lines = A.basket_lines(spark, sf).select("l_orderkey", "p_name")
    users = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("role_category"),
        F.upper("p_name").alias("skill"),
    )
    gap = T.skill_gap_users(_lower_role_trends(spark, sf), users, top_n=5)
    return gap.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "f15_gap_score",
    GAP_SQL + """, s AS (
      SELECT count(*) FILTER (WHERE status = 'matched') AS matched, count(*) FILTER (WHERE status = 'missing') AS missing,
             max_by(mention_count, -rank) AS m, max_by(pct_of_postings, -rank) AS p
      FROM gap WHERE role_category = '1-urgent')
      SELECT '1-urgent' AS role_category, matched, missing,
             CAST(printf('%.1f', matched / (matched + missing) * 100) AS DOUBLE) AS match_score,
             CASE WHEN matched / (matched + missing) >= 0.75 THEN 'strong'
                  WHEN matched / (matched + missing) >= 0.4 THEN 'partial' ELSE 'low' END AS band,
             CAST(printf('%.0f', m / p) AS BIGINT) AS total_postings_analysed FROM s""",
)
def f15(spark, sf):
    return T.gap_score(_lower_role_trends(spark, sf), "1-URGENT", USER_SKILLS, top_n=5)


@query(
    "f16_trends_by_role",
    BASKET_SQL + """SELECT * FROM trends WHERE role_category = '2-HIGH' AND week_start >= DATE '2000-01-03'
                    ORDER BY week_start DESC, mention_count DESC, skill LIMIT 20""",
)
def f16(spark, sf):
    return T.trends_by_role(A.basket_trends(spark, sf), "2-HIGH", date(2000, 1, 3))


@query(
    "f17_top_in_range",
    BASKET_SQL + """SELECT * FROM trends WHERE week_start BETWEEN DATE '1998-01-05' AND DATE '1999-12-27'
                    ORDER BY mention_count DESC, skill, role_category, week_start LIMIT 25""",
)
def f17(spark, sf):
    return T.top_in_range(A.basket_trends(spark, sf), date(1998, 1, 5), date(1999, 12, 27))


@query(
    "f18_top_skills_total",
    BASKET_SQL + "SELECT skill, CAST(sum(mention_count) AS BIGINT) AS total FROM trends GROUP BY skill ORDER BY total DESC, skill LIMIT 5",
)
def f18(spark, sf):
    return T.top_skills_total(A.basket_trends(spark, sf))


MOMENTUM_SQL = """CASE WHEN {c} > 20 THEN 'strong_up' WHEN {c} > 5 THEN 'up' WHEN {c} < -20 THEN 'strong_down'
                  WHEN {c} < -5 THEN 'down' ELSE 'flat' END"""


@query(
    "f19_momentum",
    BASKET_SQL + WOW_SQL + f"""SELECT role_category, skill, change_pct, {MOMENTUM_SQL.format(c='change_pct')} AS momentum,
      CASE WHEN change_pct > 20 THEN 'rising' WHEN change_pct < -10 THEN 'falling' ELSE 'neutral' END AS badge
      FROM rising WHERE rank <= 30""",
)
def f19(spark, sf):
    rows = T.with_momentum(A.basket_trends(spark, sf), None, 30)
    return rows.select("role_category", "skill", "change_pct", "momentum", momentum_badge(F.col("change_pct")).alias("badge"))


@query(
    "f20_rising_shortlist",
    BASKET_SQL + """SELECT skill, role_category, mention_count, wow_change FROM trending WHERE is_rising
                    ORDER BY mention_count DESC, skill, role_category LIMIT 8""",
)
def f20(spark, sf):
    return T.rising_shortlist(A.basket_trends(spark, sf)).select("skill", "role_category", "mention_count", "wow_change")


@query(
    "f21_prev_current_series",
    BASKET_SQL + """, top AS (SELECT * FROM trending ORDER BY mention_count DESC, skill, role_category LIMIT 5)
      SELECT skill, role_category, 'current' AS week, mention_count FROM top
      UNION ALL SELECT skill, role_category, 'previous', previous_count FROM top""",
)
def f21(spark, sf):
    return T.prev_current_series(A.basket_trends(spark, sf))


def _digest(spark, sf):
    return weekly_digest(
        A.basket_postings(spark, sf), A.basket_processed(spark, sf), A.basket_trends(spark, sf), ROLES
    )


@query(
    "f22_digest_rising",
    BASKET_SQL + WOW_SQL + f"""SELECT *, {MOMENTUM_SQL.format(c='change_pct')} AS momentum
                               FROM rising WHERE rank <= 5 AND current_count > 0""",
)
def f22_rising(spark, sf):
    return _digest(spark, sf)["rising"].withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "f22_digest_emerging",
    emerging_sql(BASKET_SQL, 4, 3, 0.02) + "SELECT * FROM emerging ORDER BY growth_pct DESC, skill, role_category LIMIT 20",
)
def f22_emerging(spark, sf):
    return _digest(spark, sf)["emerging"]


@query(
    "f22_digest_pairs",
    BASKET_SQL + PAIRS_SQL + """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role_category
        ORDER BY count DESC, skill_a, skill_b) AS rank FROM pairs WHERE count >= 2) WHERE rank <= 5""",
)
def f22_pairs(spark, sf):
    return _digest(spark, sf)["pairs"].withColumn("rank", F.col("rank").cast("bigint"))


@query("f22_digest_similar", SIMILAR_SQL)
def f22_similar(spark, sf):
    return _digest(spark, sf)["similar"]


# Postings and status


@query(
    "g1_roles",
    BASKET_SQL + """SELECT role_category, count(*) AS posting_count, count(q.posting_id) AS processed_count,
      count(*) - count(q.posting_id) AS unprocessed_count
      FROM postings LEFT JOIN processed q USING (posting_id) GROUP BY role_category""",
)
def g1(spark, sf):
    return P.roles(A.basket_postings(spark, sf), A.basket_processed(spark, sf))


def _stats(spark, sf, role):
    rows = P.stats(A.basket_postings(spark, sf), A.basket_processed(spark, sf), A.basket_trends(spark, sf), role)
    return rows.withColumns(
        {"last_scraped": F.to_date("last_scraped"), "sources": F.array_join("sources", "|")}
    )


STATS_SQL = BASKET_SQL + """SELECT count(*) AS total_postings, count(q.posting_id) AS processed_postings,
  count(*) - count(q.posting_id) AS unprocessed_postings, CAST(max(scraped_at) AS DATE) AS last_scraped,
  {tracked} AS roles_tracked, (SELECT count(DISTINCT week_start) FROM trends {where}) AS weeks_of_data,
  string_agg(DISTINCT source, '|' ORDER BY source) AS sources
  FROM postings LEFT JOIN processed q USING (posting_id) {where}"""


@query("g2_stats", STATS_SQL.format(tracked="count(DISTINCT role_category)", where=""))
def g2(spark, sf):
    return _stats(spark, sf, None)


@query("g3_stats_role", STATS_SQL.format(tracked="CAST(1 AS BIGINT)", where="WHERE role_category = '4-NOT SPECIFIED'"))
def g3(spark, sf):
    return _stats(spark, sf, "4-NOT SPECIFIED")


AGE_SQL = """WITH a AS (SELECT event_id, CASE WHEN event_id % 100 = 7 THEN NULL ELSE ts END AS seen,
                               (SELECT epoch_us(max(ts)) FROM events) - epoch_us(ts) AS us FROM events),
b AS (SELECT *, us // 60000000 AS m, us // 3600000000 AS h, us // 86400000000 AS d FROM a WHERE us >= 0)
SELECT CASE WHEN seen IS NULL THEN 'unknown' WHEN us < 28800000000 THEN 'fresh'
            WHEN us < 86400000000 THEN 'ageing' ELSE 'stale' END AS band,
       CASE WHEN seen IS NULL THEN NULL WHEN m < 1 THEN 'just now'
            WHEN m < 60 THEN m || CASE WHEN m = 1 THEN ' minute ago' ELSE ' minutes ago' END
            WHEN h < 24 THEN h || CASE WHEN h = 1 THEN ' hour ago' ELSE ' hours ago' END
            ELSE d || CASE WHEN d = 1 THEN ' day ago' ELSE ' days ago' END END AS age, count(*) AS n
FROM b GROUP BY ALL"""


@query("g4_staleness", AGE_SQL)
def g4(spark, sf):
    newest = A.table(spark, sf, "events").agg(F.max("ts").alias("ts"))
    now = F.lit(newest.first().ts)  # all rows are read: the newest is the present
    seen = F.when(F.col("event_id") % 100 == 7, None).otherwise(F.col("ts"))
    return (
        A.table(spark, sf, "events")
        .where(F.col("ts").isNotNull())
        .groupBy(staleness(seen, now).alias("band"), age_text(seen, now).alias("age"))
        .agg(F.count("*").alias("n"))
    )


RECENT_SQL = BASKET_SQL + """SELECT p.posting_id, '' AS location, source, role_category, CAST(scraped_at AS DATE) AS day,
  coalesce(array_to_string(skills, '|'), '') AS skills, CAST(sentiment_score AS DECIMAL(18,6)) AS sentiment_score,
  topic_label FROM postings p LEFT JOIN processed q USING (posting_id) """


def _recent_columns(df):
    return df.select(
        "posting_id",
        F.coalesce("location", F.lit("")).alias("location"),
        "source",
        "role_category",
        F.to_date("scraped_at").alias("day"),
        F.array_join("skills", "|").alias("skills"),
        dec("sentiment_score"),
        F.col("topics.topic_label").alias("topic_label"),
    )


@query("g5_recent_postings", RECENT_SQL + "ORDER BY scraped_at DESC, p.posting_id LIMIT 20 OFFSET 40")
def g5(spark, sf):
    data, _ = P.recent_postings(A.basket_postings(spark, sf), A.basket_processed(spark, sf), None, 3, 20)
    return _recent_columns(data)


@query(
    "g5_recent_envelope",
    BASKET_SQL + """SELECT 9999 AS page, 20 AS page_size, count(*) AS total_count,
      CAST(ceil(count(*) / 20) AS INTEGER) AS total_pages, 9999 < ceil(count(*) / 20) AS has_next, true AS has_prev
      FROM postings WHERE role_category = '5-LOW'""",
)
def g5_envelope(spark, sf):
    return P.recent_postings(A.basket_postings(spark, sf), A.basket_processed(spark, sf), "5-LOW", 9999, 20)[1]


@query("g6_recent_by_role", RECENT_SQL + "WHERE role_category = '1-URGENT' ORDER BY scraped_at DESC, p.posting_id LIMIT 50")
def g6(spark, sf):
    rows = P.recent_by_role(A.basket_postings(spark, sf), "1-URGENT", 50, A.basket_processed(spark, sf))
    none = F.array().cast("array<string>")
    return _recent_columns(rows.withColumn("skills", F.coalesce("skills_extracted", none)))


@query("g7_posting_detail", RECENT_SQL + "WHERE p.posting_id = (SELECT max(o_orderkey) FROM orders)")
def g7(spark, sf):
    rows = A.basket_postings(spark, sf)
    newest = rows.agg(F.max("posting_id")).scalar()
    detail = P.posting_detail(rows, A.basket_processed(spark, sf), newest)
    none = F.array().cast("array<string>")
    return _recent_columns(detail.withColumn("skills", F.coalesce("skills_extracted", none)))


TIMELINE_SQL = BASKET_SQL + """, timeline AS (
  SELECT week_start AS week, CAST(printf('%.4f', CAST(sum(CAST(sentiment_score AS DECIMAL(18,12))) AS DOUBLE) / count(*)) AS DOUBLE) AS avg_sentiment,
         CAST(sum(1 + CASE WHEN role_category = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS urgency_score,
         count(*) AS posting_count
  FROM postings JOIN processed USING (posting_id)
  WHERE scraped_at >= (SELECT max(scraped_at) FROM postings) - INTERVAL {days} DAY {role} GROUP BY ALL)
"""


@query("g8_sentiment_timeline", TIMELINE_SQL.format(days=84, role="") + "SELECT * FROM timeline")
def g8(spark, sf):
    return P.sentiment_timeline(A.basket_postings(spark, sf), A.basket_processed(spark, sf), None, 12)


@query(
    "g8_sentiment_timeline_role",
    TIMELINE_SQL.format(days=364, role="AND role_category = '1-URGENT'") + "SELECT * FROM timeline",
)
def g8_role(spark, sf):
    return P.sentiment_timeline(A.basket_postings(spark, sf), A.basket_processed(spark, sf), "1-URGENT", 52)


@query(
    "g9_timeline_summary",
    TIMELINE_SQL.format(days=84, role="") + """SELECT CAST(avg(avg_sentiment) AS DECIMAL(18,6)) AS avg_sentiment,
      CAST(sum(urgency_score) AS BIGINT) AS total_urgency,
      CAST(max_by(avg_sentiment, week) - min_by(avg_sentiment, week) AS DECIMAL(18,6)) AS change,
      CASE WHEN max_by(avg_sentiment, week) > min_by(avg_sentiment, week) THEN 'up'
           WHEN max_by(avg_sentiment, week) < min_by(avg_sentiment, week) THEN 'down' ELSE 'flat' END AS direction
      FROM timeline""",
)
def g9(spark, sf):
    timeline = P.sentiment_timeline(A.basket_postings(spark, sf), A.basket_processed(spark, sf), None, 12)
    rows = P.timeline_summary(timeline)
    return rows.select(dec("avg_sentiment"), "total_urgency", dec("change"), "direction")


@query(
    "g10_topics",
    BASKET_SQL + """SELECT topic_label, max(topic_id) AS topic_id, count(*) AS posting_count,
      CAST(printf('%.3f', coalesce(avg(nullif(probability, 0)), 0.0)) AS DOUBLE) AS avg_probability
      FROM processed JOIN postings USING (posting_id) GROUP BY topic_label""",
)
def g10(spark, sf):
    return P.topics(A.basket_postings(spark, sf), A.basket_processed(spark, sf))


@query(
    "g11_table_counts",
    BASKET_SQL + """SELECT 'postings' AS table_name, count(*) AS rows FROM postings
      UNION ALL SELECT 'processed', count(*) FROM processed UNION ALL SELECT 'trends', count(*) FROM trends""",
)
def g11(spark, sf):
    return P.table_counts(A.basket_postings(spark, sf), A.basket_processed(spark, sf), A.basket_trends(spark, sf))
