"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local cores, BENCH_QUERIES an
optional comma list of query names. Every query runs on its whole tables; the weekly
table that the analytics read is stored once (``e4_build_trends`` times its making).
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from skilldemand.plans import catalog
from skilldemand.plans.adapters import basket_trends
from skilldemand.session import build_session

HEADLINE = [
    "e4_build_trends",
    "e5_merge_trends",
    "f2_trending",
    "f4_wow_change",
    "f5_rising_skills",
    "f6_cooccurrence",
    "f7_cooccurrence_matrix",
    "f9_similarity_matrix",
    "f11_emerging",
    "f12_compare_overlap",
    "f14_skill_gap_users",
    "g1_roles",
    "g2_stats",
    "g5_recent_postings",
    "g8_sentiment_timeline",
    "g10_topics",
    "a7_dedupe_against",
    "a8_first_per_url",
    "b1_strip_html",
    "b5_clean",
    "c1_match_vocab",
    "c5_urgency",
    "c6_score_sentiment",
    "c9_extract_entities",
    "d2_enrich",
    "h1_prf_macro",
    "h8_compare_models",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=str(cpus),
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__sql__files__minPartitionNum=str(cpus),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = catalog.queries()
    basket_trends(spark, sf_dir).count()
    times = {}
    for name in names.split(",") if names else HEADLINE:
        start = time.time()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
