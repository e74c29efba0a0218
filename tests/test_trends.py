import datetime as dt

import pytest
from conftest import CURR, OLD4, PREV
from pyspark.sql import functions as F

from skilldemand.operators import trends as T
from skilldemand.operators import weekly as W
from skilldemand.plans.digest import weekly_digest, write_digest
from skilldemand.schemas import TRENDS


def test_wow_change(spark, trends):
    names = ("First aid", "Night shifts", "Triage", "Phlebotomy", "Juggling")
    keys = spark.createDataFrame([(s, "nurse") for s in names], "skill string, role_category string")
    rows = {r.skill: r for r in T.wow_change(trends, keys).collect()}
    first = rows["First aid"]
    assert (first.change_pct, first.is_rising) == (25.0, True)
    assert (first.current_count, first.previous_count, first.current_week, first.previous_week) == (60, 48, CURR, PREV)
    assert (rows["Night shifts"].change_pct, rows["Night shifts"].is_rising) == (-10.0, False)
    assert (rows["Triage"].change_pct, rows["Triage"].is_rising) == (0.0, False)
    assert (rows["Phlebotomy"].change_pct, rows["Phlebotomy"].previous_week) == (100.0, None)
    assert (rows["Juggling"].change_pct, rows["Juggling"].current_week) == (0.0, None)


def test_wow_uses_previous_row_and_trending_the_calendar_week(trends):
    row = T.wow_change(trends).where("skill = 'Wound care'").first()
    assert (row.previous_week, row.change_pct) == (OLD4, 350.0)
    assert T.trending(trends).where("skill = 'Wound care'").first().wow_change == 100.0


def test_rising(trends):
    rows = [(r.skill, r.change_pct) for r in T.rising_skills(trends, "nurse").collect()]
    assert rows == [
        ("Wound care", 350.0), ("Phlebotomy", 100.0), ("First aid", 25.0), ("Triage", 0.0), ("Night shifts", -10.0),
    ]
    assert T.rising_skills(trends, "nurse", 2).count() == 2
    assert T.rising_skills(trends, "sailor").count() == 0


def test_cooccurrence(skill_sets):
    postings, processed = skill_sets
    rows = T.cooccurrence(postings, processed, "nurse", min_count=1).collect()
    counts = [({r.skill_a, r.skill_b}, r["count"]) for r in rows]
    assert counts[:2] == [({"First aid", "Triage"}, 3), ({"Night shifts", "Triage"}, 2)]
    assert len(counts) == 5 and all(n == 1 for _, n in counts[2:])
    assert T.cooccurrence(postings, processed, "nurse", min_count=2).count() == 2
    assert T.cooccurrence(postings, processed, "nurse", min_count=1, top_n=4).count() == 4
    cells = {(r.skill_a, r.skill_b): r["count"] for r in T.cooccurrence_matrix(postings, processed, "nurse").collect()}
    assert all(cells[b, a] == n for (a, b), n in cells.items())
    assert cells["Triage", "Triage"] == 4 and cells["Phlebotomy", "Phlebotomy"] == 1
    assert T.cooccurrence_skills(postings, processed, "nurse").count() == 4


def test_role_similarity(trends):
    def one(a, b):
        return T.role_similarity(trends, a, b).first().similarity

    assert one("nurse", "nurse") == 1.0
    # mean shares: (0.675 * 0.95 + 0.3 * 0.4) / (sqrt(0.797975) * sqrt(1.3125))
    assert one("nurse", "paramedic") == one("paramedic", "nurse") == 0.7438
    # 0.475 * 0.5 / (sqrt(0.797975) * sqrt(1.0625))
    assert one("nurse", "baker") == 0.2579
    assert one("nurse", "sailor") == one("sailor", "smith") == 0.0
    cells = {(r.row, r.col): r.similarity for r in T.similarity_matrix(trends, ["nurse", "paramedic", "baker", "sailor"]).collect()}
    want = [[1.0, 0.7438, 0.2579, 0.0], [0.7438, 1.0, 0.0, 0.0], [0.2579, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]
    assert cells == {(i, j): want[i][j] for i in range(4) for j in range(4)}
    pairs = T.similar_pairs(trends, ["nurse", "paramedic", "baker"], 2, 1).collect()
    assert [(p.section, p.similarity) for p in pairs] == [("most", 0.7438), ("most", 0.2579), ("least", 0.0)]


def test_emerging(trends):
    rows = {(r.skill, r.role_category): r.growth_pct for r in T.emerging(trends).collect()}
    assert rows == {
        ("Wound care", "nurse"): 350.0,
        ("Phlebotomy", "nurse"): 100.0,
        ("First aid", "paramedic"): 100.0,
        ("Triage", "paramedic"): 100.0,
        ("Night shifts", "baker"): 100.0,
        ("Ovens", "baker"): 100.0,
    }
    assert T.emerging(trends, min_current=61).count() == 0
    assert T.emerging(trends.where("false")).count() == 0
    assert T.trending(trends.where("false")).count() == 0


API_ROWS = [
    ("welding", "fitter", CURR, 14, 0.7),
    ("brazing", "fitter", CURR, 9, 0.45),
    ("welding", "fitter", PREV, 8, 0.4),
    ("glazing", "joiner", CURR, 4, 0.5),
]


@pytest.fixture(scope="module")
def api_trends(spark):
    return spark.createDataFrame(API_ROWS, TRENDS).cache()


def test_trending(api_trends):
    rows = {r.skill: r for r in T.trending(api_trends).collect()}
    assert rows["welding"].wow_change == 75.0 and rows["welding"].is_rising
    assert rows["brazing"].wow_change == rows["glazing"].wow_change == 100.0
    data, envelope = T.trending_page(api_trends, page=9, page_size=2)
    assert [r.skill for r in data.collect()] == ["glazing"]
    assert envelope.first().asDict() == {
        "page": 2, "page_size": 2, "total_count": 3, "total_pages": 2, "has_next": False, "has_prev": True,
    }


def test_latest_week_is_global(spark, api_trends):
    later = spark.createDataFrame([("planing", "joiner", CURR + dt.timedelta(weeks=1), 1, 1.0)], TRENDS)
    assert T.trending(api_trends.union(later), "fitter").count() == 0
    assert T.rising_skills(api_trends.union(later), "fitter").count() == 2


def test_compare(api_trends, trends):
    row = T.compare_overlap(api_trends, ["fitter", "joiner"]).first()
    assert (row.overlap_pct, row.similarity_score) == (0.0, 0.0)
    assert T.compare_shared(api_trends, ["fitter", "joiner"]).count() == 0
    with pytest.raises(ValueError):
        T.compare_overlap(api_trends, ["fitter", " "])
    assert [r.skill for r in T.compare_shared(trends, ["nurse", "paramedic"]).collect()] == ["First aid", "Triage"]
    profiles = T.compare_profiles(trends, ["nurse", "baker"], 2).collect()
    assert [r.skill for r in profiles if (r.role_category, r.section) == ("baker", "top")] == ["Sourdough", "Night shifts"]


def test_gap(api_trends, trends):
    gap = T.skill_gap(api_trends, " Fitter ", ["Welding ", "juggling"]).collect()
    assert [(r.skill, r.status, r.demand_pct) for r in gap] == [("welding", "matched", 70.0), ("brazing", "missing", 45.0)]
    score = T.gap_score(api_trends, "fitter", ["welding", "juggling"]).first()
    assert (score.match_score, score.band, score.total_postings_analysed) == (50.0, "partial", 20)
    empty = T.gap_score(api_trends, "sailor", ["welding"]).first()
    assert (empty.match_score, empty.matched, empty.total_postings_analysed) == (0.0, 0, 0)
    bonus = T.skill_gap(trends, "nurse", ["phlebotomy", "first aid"], top_n=3).collect()
    assert [(r.skill, r.status) for r in bonus] == [
        ("First aid", "matched"), ("Night shifts", "missing"), ("Triage", "missing"), ("Phlebotomy", "bonus"),
    ]


def test_gap_users_equal_single_gap(spark, trends):
    users = spark.createDataFrame(
        [("u1", "nurse", "phlebotomy"), ("u1", "nurse", "First aid"), ("u2", "baker", "")],
        "user_id string, role_category string, skill string",
    )
    many = T.skill_gap_users(trends, users, top_n=3)
    one = T.skill_gap(trends, "nurse", ["phlebotomy", "First aid"], top_n=3)
    assert sorted(many.where("user_id = 'u1'").drop("user_id").collect()) == sorted(one.collect())
    assert many.where("user_id = 'u2'").count() == 3


def test_build_and_merge(spark):
    postings = spark.createDataFrame(
        [(i, "r" + str(i % 2), f"2026-04-{13 + i % 9}") for i in range(40)], "posting_id int, role_category string, d string"
    ).withColumn("scraped_at", F.to_timestamp("d"))
    skills = [["a"], ["a", "b"], ["b", "c", "b"], None]
    processed = spark.createDataFrame(
        [(i, skills[i % 4]) for i in range(40) if i % 5], "posting_id int, skills_extracted array<string>"
    )
    full = sorted(W.build_trends(postings, processed).collect())
    merged = W.build_trends(postings.where("false"), processed)
    seen = None
    for k in range(3):
        part = F.col("posting_id") % 3 == k
        seen = postings.where(part) if seen is None else seen.union(postings.where(part))
        delta = W.skill_mentions(postings.where(part), processed)
        merged = W.merge_trends(merged, delta, W.weekly_totals(seen))
    assert sorted(merged.select(*[f.name for f in TRENDS]).collect()) == full
    total = {tuple(r[:2]): r.total_postings for r in W.weekly_totals(postings).collect()}
    assert all(0 < r[4] <= 1 and round(r[3] / total[r[1], r[2]], 4) == r[4] for r in full)


def test_merge_adds(spark):
    stored = spark.createDataFrame([("Triage", "r", CURR, 5, 0.5)], TRENDS)
    delta = spark.createDataFrame([("Triage", "r", CURR, 1, None)], TRENDS)
    totals = spark.createDataFrame([("r", CURR, 12)], "role_category string, week_start date, total_postings bigint")
    row = W.merge_trends(stored, delta, totals).first()
    assert (row.mention_count, row.pct_of_postings) == (6, 0.5)


def test_digest(spark, trends, skill_sets, tmp_path):
    digest = weekly_digest(*skill_sets, trends, ["nurse", "paramedic", "baker"])
    write_digest(digest, str(tmp_path))
    rising = spark.read.parquet(str(tmp_path / "rising"))
    assert rising.groupBy("role_category").count().where("count > 5").count() == 0
    assert rising.where("skill = 'Wound care'").first().momentum == "strong_up"
    assert spark.read.parquet(str(tmp_path / "pairs")).count() > 0
    assert spark.read.parquet(str(tmp_path / "similar")).count() == 6
