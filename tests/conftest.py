import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from skilldemand.schemas import TRENDS  # noqa: E402
from skilldemand.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


CURR = dt.date(2026, 3, 2)
PREV = CURR - dt.timedelta(weeks=1)
OLD4 = CURR - dt.timedelta(weeks=4)

TREND_ROWS = [
    ("First aid", "nurse", CURR, 60, 0.75),
    ("Night shifts", "nurse", CURR, 36, 0.45),
    ("Triage", "nurse", CURR, 24, 0.30),
    ("Phlebotomy", "nurse", CURR, 12, 0.15),
    ("Wound care", "nurse", CURR, 9, 0.12),
    ("First aid", "nurse", PREV, 48, 0.60),
    ("Night shifts", "nurse", PREV, 40, 0.50),
    ("Triage", "nurse", PREV, 24, 0.30),
    ("Wound care", "nurse", OLD4, 2, 0.01),
    ("First aid", "paramedic", CURR, 50, 0.95),
    ("Driving", "paramedic", CURR, 40, 0.80),
    ("Triage", "paramedic", CURR, 20, 0.40),
    ("Driving", "paramedic", PREV, 10, 0.20),
    ("Sourdough", "baker", CURR, 16, 0.80),
    ("Night shifts", "baker", CURR, 10, 0.50),
    ("Ovens", "baker", CURR, 6, 0.30),
    ("Sourdough", "baker", PREV, 20, 0.90),
]

SKILL_SETS = [
    ("nurse", ["First aid", "Triage"]),
    ("nurse", ["First aid", "Triage", "Night shifts"]),
    ("nurse", ["Triage", "Night shifts"]),
    ("nurse", ["First aid", "Triage", "Phlebotomy"]),
    ("paramedic", ["Driving", "First aid"]),
    ("paramedic", ["Driving"]),
]


@pytest.fixture(scope="session")
def trends(spark):
    return spark.createDataFrame(TREND_ROWS, TRENDS).cache()


@pytest.fixture(scope="session")
def skill_sets(spark):
    postings = spark.createDataFrame(
        [(str(i), role) for i, (role, _) in enumerate(SKILL_SETS)], "posting_id string, role_category string"
    )
    processed = spark.createDataFrame(
        [(str(i), skills) for i, (_, skills) in enumerate(SKILL_SETS)],
        "posting_id string, skills_extracted array<string>",
    )
    return postings, processed


VOCAB_JSON = """{"technical": {
  "languages": ["Python", "SQL", "R", "C++", "Go", "TypeScript"],
  "tools": ["Apache Spark", "Spark", "dbt", "Next.js", ".NET", "sql"],
  "infra": ["Docker", "Kubernetes", "CI/CD"]},
 "soft": ["stakeholder management", "agile", "A/B testing", "docker"]}"""


@pytest.fixture(scope="session")
def vocab(spark, tmp_path_factory):
    from skilldemand.sources.files import load_vocab

    path = tmp_path_factory.mktemp("vocab") / "vocab.json"
    path.write_text(VOCAB_JSON)
    return load_vocab(spark, str(path)).cache()
