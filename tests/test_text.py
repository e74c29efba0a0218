import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from skilldemand.functions import text as X
from skilldemand.functions.dates import epoch_utc, iso_utc, week_start
from skilldemand.functions.numbers import round_exact


def apply(spark, fn, values, ddl="v string"):
    df = spark.createDataFrame([(v,) for v in values], ddl).coalesce(1)
    return [r.out for r in df.select(fn(F.col("v")).alias("out")).collect()]


def test_rounding_equals_python(spark):
    values = [i / d for d in (7, 13, 160, 640, 1000) for i in range(-50, 200, 3)] + [2.675, 0.125, 1.005]
    for digits in (0, 1, 2, 3, 4):
        got = apply(spark, lambda c: round_exact(c, digits), values, "v double")
        assert got == [round(v, digits) for v in values]


def test_strip_html(spark):
    texts = [
        "<p>We need <strong>Python</strong> and <em>SQL</em></p>",
        "<div><ul><li>React</li>\n<li>TypeScript &amp; co</li></ul></div>",
        "a<script>var x = '<p>';</script>b<!-- c -->d<br>e",
        "plain",
        "   ",
        None,
    ]
    assert apply(spark, X.strip_html, texts) == [
        "We need  Python  and  SQL",
        "React \n TypeScript & co",
        "a b d e",
        "plain",
        " ",
        "",
    ]
    trimmed = apply(spark, lambda c: X.strip_html(c, strip=True), texts)
    assert trimmed == ["We need Python and SQL", "React TypeScript & co", "a b d e", "plain", "", ""]


def test_normalise_unicode(spark):
    text = "“Senior” role in ‘London’ – café • a b"
    want = unicodedata.normalize("NFC", "\"Senior\" role in 'London' - café - a b")
    assert apply(spark, X.normalise_unicode, [text]) == [want]


BOILERPLATE_TEXTS = [
    "Great role. We are an equal opportunities employer and welcome all. Apply",
    "You must have the right to work in the United Kingdom. Strong Python skills required.",
    "Looking for a Data Engineer. No agencies please.",
    "By submitting your CV you agree to our\nGDPR policy. Done. DBS check needed.",
    "DEI statement here. Competitive salary and benefits package offered. ok",
    "dDEI x.EI y. nothing",
    "nothing to remove",
]


def test_remove_boilerplate_equals_one_pattern_after_the_other(spark):
    def brute(text):
        for _, pattern in X.BOILERPLATE:
            text = re.sub(pattern, "", text, flags=re.I | re.S)
        return text

    got = apply(spark, X.remove_boilerplate, BOILERPLATE_TEXTS)
    assert got == [brute(t) for t in BOILERPLATE_TEXTS]
    assert "Python" in got[1] and "right to work" not in got[1].lower()


def test_every_pattern_contains_its_fixed_text():
    for needle, pattern in X.BOILERPLATE + X.URGENCY:
        letters = re.sub(r"\\[bsS]|[\\\[\](){}?:+*^.|]", " ", pattern)
        assert needle in letters or needle in pattern


def test_clean(spark):
    got = apply(spark, X.clean, ["", "   ", None, "a   b\t\tc\n\n\n\nd • e ", "<b>x</b>  &lt;y&gt;"])
    assert got == ["", "", "", "a b c\n\nd - e", "x <y>"]
    assert apply(spark, X.clean_lower, ["Python AND"]) == ["python and"]


def test_clean_reports_a_text_the_parser_rejects(spark):
    rows = apply(spark, X.clean_checked, ["<![oops[ hi", "fine & good"])
    assert rows[0].text is None and "AssertionError" in rows[0].error
    assert rows[1].text == "fine & good" and rows[1].error is None


def test_urgency(spark):
    texts = [
        "IMMEDIATE START AVAILABLE - apply ASAP! TechCorp is urgently hiring",
        "Immediate start available.",
        "URGENT: we need someone now.",
        "we know nowadays",
        "now now time-sensitive time sensitive timesensitive",
        "",
        None,
    ]
    def brute(t):
        return sum(len(re.findall(p, t or "", re.I)) for _, p in X.URGENCY)

    assert apply(spark, X.urgency, texts) == [brute(t) for t in texts]


def test_ngrams(spark):
    got = apply(spark, lambda c: X.ngrams(c, 2), ["We use Power BI, we use C++."])
    assert set(got[0]) >= {"power bi", "c++", "we use"} and len(got[0]) == len(set(got[0]))


@pytest.mark.parametrize(
    "value, want",
    [
        ("2026-04-10T09:00:00Z", "2026-04-10 09:00:00"),
        ("2026-04-10", "2026-04-10 00:00:00"),
        ("2026-04-10T09:00:00+02:00", "2026-04-10 09:00:00"),
        ("2026-04-10 09:30", "2026-04-10 09:30:00"),
        ("soon", None),
        (None, None),
    ],
)
def test_iso_utc(spark, value, want):
    assert apply(spark, lambda c: iso_utc(c).cast("string"), [value]) == [want]


def test_epoch_and_week(spark):
    got = apply(spark, lambda c: epoch_utc(c).cast("string"), ["1776153600", "0", None, "x"])
    assert got == ["2026-04-14 08:00:00", None, None, None]
    days = apply(spark, lambda c: week_start(c.cast("timestamp")).cast("string"), ["2026-04-14 10:00:00", "2026-04-13", "2026-04-19"])
    assert days == ["2026-04-13"] * 3
