"""Skill analytics on the weekly aggregate.

The latest week is a scalar subquery: it is computed first and then prunes partitions
and row groups of the scan it filters. Rankings per role are filters on ``row_number``,
which Spark also applies before the shuffle.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skilldemand.functions.bands import match_band, momentum
from skilldemand.functions.lookup import literal
from skilldemand.functions.numbers import RISING_ABOVE, growth_pct, round_exact
from skilldemand.functions.pages import check_page, envelope, page_rows

TREND_KEY = ["skill", "role_category"]
TIES = ["skill", "role_category"]
MAX_LOOKBACK = 26  # fixed value: the most weeks that emerging skills look back


def latest_week(trends: DataFrame) -> DataFrame:
    """The most recent week of the whole table."""
    return trends.agg(F.max("week_start").alias("latest_week"))


def _latest(trends: DataFrame) -> Column:
    return latest_week(trends).scalar()


def _of_role(df: DataFrame, role: str | None) -> DataFrame:
    return df if role is None else df.where(F.col("role_category") == role)


def _current_and_previous(trends: DataFrame, role: str | None) -> DataFrame:
    """Rows of the latest week with the count of the week before, from one scan."""
    latest = _latest(trends)
    is_current = F.col("week_start") == latest
    return (
        _of_role(trends, role)
        .where(F.col("week_start").between(F.date_sub(latest, 7), latest))
        .where(is_current | (F.col("week_start") == F.date_sub(latest, 7)))
        .groupBy(*TREND_KEY)
        .agg(
            F.max(F.when(is_current, F.col("week_start"))).alias("week_start"),
            F.max(F.when(is_current, F.col("mention_count"))).alias("mention_count"),
            F.max(F.when(is_current, F.col("pct_of_postings"))).alias("pct_of_postings"),
            F.max(F.when(~is_current, F.col("mention_count"))).alias("previous_count"),
        )
        .where("week_start is not null")
    )


def _unsorted_trending(trends: DataFrame, role: str | None) -> DataFrame:
    change = growth_pct(F.col("mention_count"), F.col("previous_count"))
    return _current_and_previous(trends, role).select(
        *TREND_KEY,
        "week_start",
        "mention_count",
        "pct_of_postings",
        round_exact(change, 1).alias("wow_change"),
        (change > RISING_ABOVE).alias("is_rising"),
    )


def _by_demand() -> list[Column]:
    return [F.desc("mention_count"), *[F.asc(c) for c in TIES]]


def trending(trends: DataFrame, role: str | None = None) -> DataFrame:
    """Skills of the latest week with the change since the calendar week before."""
    return _unsorted_trending(trends, role).orderBy(*_by_demand())


def trending_page(
    trends: DataFrame, role: str | None = None, page: int = 1, page_size: int = 15
) -> tuple[DataFrame, DataFrame]:
    """One page of ``trending`` and its envelope; a page past the end becomes the last one."""
    check_page(page, page_size)
    rows = _unsorted_trending(trends, role)
    # the order by demand, with the beginning of the skill to part equal counts
    ranges = [(F.col("mention_count"), True), (F.substring("skill", 1, 2), False)]
    data = page_rows(rows, ranges, _by_demand(), page, page_size, last_if_past=True).orderBy(*_by_demand())
    return data, envelope(rows, page, page_size, last_if_past=True)


def wow_change(trends: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Change between the two most recent weeks a (skill, role) has rows for.

    With ``keys``, one record for each of them; a pair without rows gets zeros.
    """
    newest_first = Window.partitionBy(*TREND_KEY).orderBy(F.desc("week_start"))
    last_two = trends.withColumn("_n", F.row_number().over(newest_first)).where("_n <= 2")
    pairs = last_two.groupBy(*TREND_KEY).agg(
        F.max(F.when(F.col("_n") == 1, F.col("mention_count"))).alias("current_count"),
        F.coalesce(F.max(F.when(F.col("_n") == 2, F.col("mention_count"))), F.lit(0)).alias("previous_count"),
        F.max(F.when(F.col("_n") == 1, F.col("week_start"))).alias("current_week"),
        F.max(F.when(F.col("_n") == 2, F.col("week_start"))).alias("previous_week"),
    )
    if keys is not None:
        pairs = (
            keys.select(*TREND_KEY).distinct().join(pairs, TREND_KEY, "left").fillna(
                0, ["current_count", "previous_count"]
            )
        )
    change = growth_pct(F.col("current_count"), F.col("previous_count"))
    return pairs.select(
        *TREND_KEY,
        round_exact(change, 1).alias("change_pct"),
        (change > RISING_ABOVE).alias("is_rising"),
        "current_count",
        "previous_count",
        "current_week",
        "previous_week",
    )


def rising_skills(trends: DataFrame, role: str | None = None, top_n: int = 10) -> DataFrame:
    """Per role, the skills of the role's own latest week with the largest change."""
    rows = _of_role(trends, role)
    role_latest = rows.groupBy("role_category").agg(F.max("week_start").alias("week_start"))
    # only skills of that week are ranked over their history
    keys = rows.join(role_latest, ["role_category", "week_start"], "left_semi").select(*TREND_KEY).distinct()
    present = wow_change(rows.join(keys, TREND_KEY, "left_semi"))
    order = Window.partitionBy("role_category").orderBy(F.desc("change_pct"), F.asc("skill"))
    return (
        present.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_n)
        .orderBy("role_category", "rank")
    )


# Co-occurrence


def _skill_sets(postings: DataFrame, processed: DataFrame, role: str | None) -> DataFrame:
    return (
        _of_role(postings, role)
        .select("posting_id", "role_category")
        .join(
            processed.select(
                "posting_id", F.array_compact(F.array_distinct("skills_extracted")).alias("skills")
            ),
            "posting_id",
        )
        .select("role_category", "skills")
    )


def _pair_counts(sets: DataFrame) -> DataFrame:
    """Postings per pair a < b. The pairs are those of one posting, counted before the shuffle."""
    return (
        sets.select("role_category", "skills", F.explode("skills").alias("skill_a"))
        .select(
            "role_category",
            "skill_a",
            F.explode(F.expr("filter(skills, s -> s > skill_a)")).alias("skill_b"),
        )
        .groupBy("role_category", "skill_a", "skill_b")
        .agg(F.count("*").alias("count"))
    )


def cooccurrence(
    postings: DataFrame,
    processed: DataFrame,
    role: str | None = None,
    top_n: int = 20,
    min_count: int = 2,
) -> DataFrame:
    """Per role, the skill pairs named together in the most postings."""
    pairs = _pair_counts(_skill_sets(postings, processed, role)).where(F.col("count") >= min_count)
    order = Window.partitionBy("role_category").orderBy(F.desc("count"), "skill_a", "skill_b")
    return (
        pairs.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_n)
        .orderBy("role_category", "rank")
    )


def cooccurrence_matrix(postings: DataFrame, processed: DataFrame, role: str | None = None) -> DataFrame:
    """Long-form symmetric matrix per role: pairs both ways, postings per skill on the diagonal."""
    sets = _skill_sets(postings, processed, role)
    counted = (
        sets.select("role_category", "skills", F.explode("skills").alias("skill_a"))
        .select(
            "role_category",
            "skill_a",
            F.explode(F.expr("filter(skills, s -> s >= skill_a)")).alias("skill_b"),
        )
        .groupBy("role_category", "skill_a", "skill_b")
        .agg(F.count("*").alias("count"))
    )
    both_ways = F.when(
        F.col("skill_a") == F.col("skill_b"), F.array(F.struct("skill_a", "skill_b"))
    ).otherwise(
        F.array(
            F.struct("skill_a", "skill_b"),
            F.struct(F.col("skill_b").alias("skill_a"), F.col("skill_a").alias("skill_b")),
        )
    )
    return counted.select("role_category", "count", F.explode(both_ways).alias("p")).select(
        "role_category", "p.skill_a", "p.skill_b", "count"
    )


def cooccurrence_skills(postings: DataFrame, processed: DataFrame, role: str | None = None) -> DataFrame:
    """Sorted skills of the matrix."""
    return (
        _skill_sets(postings, processed, role)
        .select("role_category", F.explode("skills").alias("skill"))
        .distinct()
        .orderBy("role_category", "skill")
    )


# Role similarity


def _mean_vectors(trends: DataFrame, roles: list[str]) -> DataFrame:
    return (
        trends.where(F.col("role_category").isin(roles))
        .groupBy("role_category", "skill")
        .agg(F.avg("pct_of_postings").alias("w"))
    )


def _cosines(trends: DataFrame, roles: list[str]) -> DataFrame:
    """Cosine of the pairs a <= b of the given roles that share a skill.

    A skill's weights form one short list, at most one entry per given role, and the
    products of its pairs are summed before the shuffle.
    """
    lists = _mean_vectors(trends, roles).groupBy("skill").agg(
        F.collect_list(F.struct(F.col("role_category").alias("role"), "w")).alias("ws")
    )
    products = (
        lists.select("ws", F.explode("ws").alias("a"))
        .select("a", F.explode(F.expr("filter(ws, b -> b.role >= a.role)")).alias("b"))
        .groupBy(F.col("a.role").alias("role_a"), F.col("b.role").alias("role_b"))
        .agg(F.sum(F.col("a.w") * F.col("b.w")).alias("dot"))
    )
    norms = products.where("role_a = role_b").select("role_a", F.sqrt("dot").alias("norm"))
    cosine = F.col("dot") / (F.col("norm_a") * F.col("norm_b"))
    return (
        products.join(norms.withColumnRenamed("norm", "norm_a"), "role_a")
        .join(norms.select(F.col("role_a").alias("role_b"), F.col("norm").alias("norm_b")), "role_b")
        .select(
            F.struct("role_a", "role_b").alias("pair"),
            F.when(
                (F.col("norm_a") > 0) & (F.col("norm_b") > 0),
                round_exact(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(0.0)), 4),
            )
            .otherwise(0.0)
            .alias("similarity"),
        )
    )


def role_similarity(trends: DataFrame, role_a: str, role_b: str) -> DataFrame:
    """Cosine of the mean shares of two roles; 0.0 if one has no rows."""
    low, high = sorted([role_a, role_b])
    found = _cosines(trends, [role_a, role_b]).where(
        (F.col("pair.role_a") == low) & (F.col("pair.role_b") == high)
    )
    return found.agg(F.coalesce(F.max("similarity"), F.lit(0.0)).alias("similarity")).select(
        F.lit(role_a).alias("role_a"), F.lit(role_b).alias("role_b"), "similarity"
    )


def similarity_matrix(trends: DataFrame, roles: list[str]) -> DataFrame:
    """All ordered pairs of the given roles; 1.0 on the diagonal, 0.0 for a role without rows."""
    names = literal(roles, "array<string>")
    n = len(roles)
    cells = trends.sparkSession.range(n * n).select(
        F.floor(F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col")
    )
    named = cells.select(
        "row", "col", F.get(names, F.col("row")).alias("role_a"), F.get(names, F.col("col")).alias("role_b")
    ).withColumn(
        "pair",
        F.struct(
            F.least("role_a", "role_b").alias("role_a"), F.greatest("role_a", "role_b").alias("role_b")
        ),
    )
    return (
        named.join(_cosines(trends, roles), "pair", "left")
        .select(
            "role_a",
            "role_b",
            F.when(F.col("row") == F.col("col"), 1.0)
            .otherwise(F.coalesce("similarity", F.lit(0.0)))
            .alias("similarity"),
            "row",
            "col",
        )
        .orderBy("row", "col")
    )


def similar_pairs(trends: DataFrame, roles: list[str], top: int = 5, bottom: int = 3) -> DataFrame:
    """The most and the least similar pairs of the given roles."""
    pairs = similarity_matrix(trends, roles).where(F.col("row") < F.col("col"))
    most = pairs.orderBy(F.desc("similarity"), "row", "col").limit(top)
    least = pairs.orderBy(F.asc("similarity"), F.desc("row"), F.desc("col")).limit(bottom)
    return most.withColumn("section", F.lit("most")).unionByName(
        least.withColumn("section", F.lit("least"))
    ).select("section", "role_a", "role_b", "similarity")


def emerging(
    trends: DataFrame,
    lookback_weeks: int = 4,
    min_current: int = 3,
    max_old_pct: float = 0.02,
) -> DataFrame:
    """Skills of the latest week that were rare all through the weeks before.

    The share filter looks at the largest share since ``lookback_weeks`` before; growth
    compares with the row of exactly that week.
    """
    if not 1 <= lookback_weeks <= MAX_LOOKBACK:
        raise ValueError(f"lookback_weeks must be 1 to {MAX_LOOKBACK}: {lookback_weeks}")
    latest = _latest(trends)
    start = F.date_sub(latest, 7 * lookback_weeks)
    is_current = F.col("week_start") == latest
    history = (
        trends.where(F.col("week_start").between(start, latest))
        .groupBy(*TREND_KEY)
        .agg(
            F.max(F.when(is_current, F.col("mention_count"))).alias("current_count"),
            F.coalesce(F.max(F.when(~is_current, F.col("pct_of_postings"))), F.lit(0.0)).alias("max_old"),
            F.coalesce(
                F.max(F.when((F.col("week_start") == start) & ~is_current, F.col("mention_count"))), F.lit(0)
            ).alias("old_count"),
            F.max(F.when(is_current, F.col("week_start"))).alias("current_week"),
        )
    )
    growth = F.when(F.col("old_count") == 0, 100.0).otherwise(
        (F.col("current_count") - F.col("old_count")) / F.col("old_count") * 100.0
    )
    return (
        history.where((F.col("current_count") >= min_current) & (F.col("max_old") <= max_old_pct))
        .select(
            *TREND_KEY,
            round_exact(growth, 1).alias("growth_pct"),
            "current_count",
            "old_count",
            "current_week",
        )
        .orderBy(F.desc("growth_pct"), *TIES)
    )


# Comparing roles


def _max_vectors(trends: DataFrame, roles: list[str]) -> DataFrame:
    return (
        trends.where(F.col("role_category").isin(roles))
        .groupBy("role_category", "skill")
        .agg(F.max("pct_of_postings").alias("pct"))
    )


def _need_two(roles: list[str]) -> list[str]:
    named = [r.strip() for r in roles if r.strip()]
    if len(named) < 2:
        raise ValueError("compare needs at least two roles")
    return named


def _shared(trends: DataFrame, roles: list[str]) -> DataFrame:
    return (
        _max_vectors(trends, roles)
        .groupBy("skill")
        .agg(F.count("*").alias("n_roles"), F.max("pct").alias("max_pct"))
    )


def compare_overlap(trends: DataFrame, roles: list[str]) -> DataFrame:
    """Skills common to all roles as a share of all their skills, and the first two roles' cosine."""
    named = _need_two(roles)
    every = F.count_if(F.col("n_roles") == len(set(named)))
    ratio = F.when(F.count("*") > 0, every / F.count("*") * 100).otherwise(0.0)
    similarity = role_similarity(trends, named[0], named[1]).select("similarity")
    return _shared(trends, named).agg(
        every.alias("shared"), F.count("*").alias("union"), round_exact(ratio, 1).alias("overlap_pct")
    ).select("*", similarity.scalar().alias("similarity_score"))


def compare_shared(trends: DataFrame, roles: list[str]) -> DataFrame:
    """Skills every role has, by their largest share in any of them."""
    named = _need_two(roles)
    return (
        _shared(trends, named)
        .where(F.col("n_roles") == len(set(named)))
        .select("skill", "max_pct")
        .orderBy(F.desc("max_pct"), "skill")
    )


def compare_profiles(trends: DataFrame, roles: list[str], n: int = 10) -> DataFrame:
    """Per role its top skills and the top of those no other compared role has."""
    named = _need_two(roles)
    vectors = _max_vectors(trends, named)
    owners = F.count("*").over(Window.partitionBy("skill"))
    by_pct = [F.desc("pct"), F.asc("skill")]
    ranked = vectors.withColumn("only_here", owners == 1).withColumns(
        {
            "top_rank": F.row_number().over(Window.partitionBy("role_category").orderBy(*by_pct)),
            "unique_rank": F.row_number().over(
                Window.partitionBy("role_category", "only_here").orderBy(*by_pct)
            ),
        }
    )
    sections = F.array_compact(
        F.array(
            F.when(F.col("top_rank") <= n, F.struct(F.lit("top").alias("section"), F.col("top_rank").alias("rank"))),
            F.when(
                F.col("only_here") & (F.col("unique_rank") <= n),
                F.struct(F.lit("unique").alias("section"), F.col("unique_rank").alias("rank")),
            ),
        )
    )
    return (
        ranked.select("role_category", "skill", "pct", F.explode(sections).alias("s"))
        .select("role_category", "s.section", "s.rank", "skill", "pct")
        .orderBy("role_category", "section", "rank")
    )


# Skill gap


def _ranked_demand(trends: DataFrame, role: str | None, top_n: int) -> DataFrame:
    order = Window.partitionBy("role_category").orderBy(F.desc("mention_count"), F.asc("skill"))
    latest = _latest(trends)
    return (
        _of_role(trends, role)
        .where(F.col("week_start") == latest)
        .select(
            "role_category",
            "skill",
            F.lower("skill").alias("key"),
            "mention_count",
            "pct_of_postings",
            F.row_number().over(order).alias("rank"),
        )
        .withColumn("in_top", F.col("rank") <= top_n)
    )


def _bonus_candidates(ranked: DataFrame) -> DataFrame:
    """Skills beyond the top, one per case-insensitive name, names of the top left out."""
    same_name = Window.partitionBy("role_category", "key")
    return (
        ranked.withColumns({"_named": F.max("in_top").over(same_name), "_last": F.max("rank").over(same_name)})
        .where(~F.col("_named") & (F.col("rank") == F.col("_last")))
        .drop("_named", "_last")
    )


def _gap_columns(status: Column) -> list[Column]:
    return [
        F.col("role_category"),
        F.col("skill"),
        status.alias("status"),
        round_exact(F.col("pct_of_postings") * 100, 1).alias("demand_pct"),
        F.col("rank"),
    ]


def _user_keys(spark, user_skills: list[str]) -> Column:
    return literal(sorted({s.strip().lower() for s in user_skills if s.strip()}), "array<string>")


def skill_gap(trends: DataFrame, role: str, user_skills: list[str], top_n: int = 30) -> DataFrame:
    """A role's most wanted skills split into matched and missing, and the user's further ones."""
    named = role.strip().lower()
    keys = _user_keys(trends.sparkSession, user_skills)
    ranked = _ranked_demand(trends, named, top_n)
    has = F.array_contains(keys, F.col("key"))
    top = ranked.where("in_top").select(*_gap_columns(F.when(has, "matched").otherwise("missing")))
    bonus = _bonus_candidates(ranked).where(has).select(*_gap_columns(F.lit("bonus")))
    return _ordered_gap(top.unionByName(bonus), [])


def _ordered_gap(gap: DataFrame, first: list[str]) -> DataFrame:
    status = F.when(F.col("status") == "matched", 0).when(F.col("status") == "missing", 1).otherwise(2)
    return gap.orderBy(*first, status, F.desc("demand_pct"), "skill")


def skill_gap_users(trends: DataFrame, users: DataFrame, top_n: int = 30) -> DataFrame:
    """``skill_gap`` for many users: rows of (user_id, role_category, skill)."""
    wanted = users.select(
        "user_id",
        F.lower(F.trim("role_category")).alias("role_category"),
        F.lower(F.trim("skill")).alias("key"),
    )
    # one row per user and role; collect_set leaves null keys out
    owned = wanted.groupBy("user_id", "role_category").agg(F.collect_set(F.when(F.col("key") != "", F.col("key"))).alias("owned"))
    ranked = _ranked_demand(trends, None, top_n)
    top = ranked.where("in_top").groupBy("role_category").agg(
        F.array_sort(F.collect_list(F.struct("rank", "skill", "key", "pct_of_postings"))).alias("top")
    )
    both = owned.join(small_side(top), "role_category")
    matched = both.select("user_id", "role_category", "owned", F.explode("top").alias("t")).select(
        "user_id",
        "role_category",
        "t.skill",
        "t.pct_of_postings",
        "t.rank",
        F.when(F.array_contains("owned", F.col("t.key")), "matched").otherwise("missing").alias("_status"),
    )
    # what the top does not name is looked up by role and skill
    others = F.array_except("owned", F.transform("top", lambda t: t["key"]))
    bonus = (
        both.select("user_id", "role_category", F.explode(others).alias("key"))
        .join(_bonus_candidates(ranked), ["role_category", "key"])
        .select("user_id", "role_category", "skill", "pct_of_postings", "rank", F.lit("bonus").alias("_status"))
    )
    return matched.unionByName(bonus).select("user_id", *_gap_columns(F.col("_status")))


MAX_BROADCAST_ROLES = 10_000  # of at most ``top_n`` skills each


def small_side(roles: DataFrame) -> DataFrame:
    """One row per role, marked for broadcasting if there are few; else left to the optimiser."""
    few = roles.limit(MAX_BROADCAST_ROLES + 1).count() <= MAX_BROADCAST_ROLES
    return F.broadcast(roles) if few else roles


def gap_score(trends: DataFrame, role: str, user_skills: list[str], top_n: int = 30) -> DataFrame:
    """One record: share of the top skills the user has, its band, and the postings behind it.

    A role without rows in the latest week gets the empty record.
    """
    named = role.strip().lower()
    ranked = _ranked_demand(trends, named, top_n)
    has = F.array_contains(_user_keys(trends.sparkSession, user_skills), F.col("key"))
    first = F.max_by(F.struct("mention_count", "pct_of_postings"), -F.col("rank"))
    totals = ranked.agg(
        F.count_if("in_top").alias("top"),
        F.count_if(F.col("in_top") & has).alias("matched"),
        first.alias("first"),
    )
    score = F.when(F.col("top") > 0, round_exact(F.col("matched") / F.col("top") * 100, 1)).otherwise(0.0)
    postings = F.when(
        F.col("first.pct_of_postings") > 0,
        round_exact(F.col("first.mention_count") / F.col("first.pct_of_postings"), 0).cast("bigint"),
    )
    return totals.select(
        F.lit(named).alias("role_category"),
        "matched",
        (F.col("top") - F.col("matched")).alias("missing"),
        score.alias("match_score"),
        match_band(score).alias("band"),
        F.coalesce(postings, F.lit(0).cast("bigint")).alias("total_postings_analysed"),
    )


# Row queries


def trends_by_role(
    trends: DataFrame, role: str, since: date | None = None, top_n: int = 20
) -> DataFrame:
    """Rows of a role, newest week first, then by mentions."""
    rows = _of_role(trends, role)
    if since is not None:
        rows = rows.where(F.col("week_start") >= F.lit(since))
    return rows.orderBy(F.desc("week_start"), F.desc("mention_count"), "skill").limit(top_n)


def top_in_range(
    trends: DataFrame, since: date, until: date | None = None, top_n: int = 25
) -> DataFrame:
    """The rows with the most mentions in a date range, all roles."""
    rows = trends.where(F.col("week_start") >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col("week_start") <= F.lit(until))
    return rows.orderBy(F.desc("mention_count"), "skill", "role_category", "week_start").limit(top_n)


def top_skills_total(trends: DataFrame, n: int = 5) -> DataFrame:
    """Skills with the most mentions over all weeks and roles."""
    return (
        trends.groupBy("skill")
        .agg(F.sum("mention_count").alias("total"))
        .orderBy(F.desc("total"), "skill")
        .limit(n)
    )


def with_momentum(trends: DataFrame, role: str | None = None, top_n: int = 5) -> DataFrame:
    """Rising skills with the band of their change."""
    return rising_skills(trends, role, top_n).withColumn("momentum", momentum(F.col("change_pct")))


def rising_shortlist(trends: DataFrame, role: str | None = None, n: int = 8) -> DataFrame:
    """The rising skills of the latest week in the order of demand."""
    return _unsorted_trending(trends, role).where("is_rising").orderBy(*_by_demand()).limit(n)


def prev_current_series(trends: DataFrame, role: str | None = None, n: int = 5) -> DataFrame:
    """Mentions of the top skills in the previous and the current week, one row each."""
    top = (
        _current_and_previous(trends, role)
        .orderBy(*_by_demand())
        .limit(n)
        .select(
            *TREND_KEY,
            F.coalesce("previous_count", F.lit(0)).alias("previous"),
            F.col("mention_count").alias("current"),
        )
    )
    return top.unpivot(TREND_KEY, ["previous", "current"], "week", "mention_count")
