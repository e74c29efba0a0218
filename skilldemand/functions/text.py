"""Text cleaning and counting as columns.

Everything runs in the JVM except markup parsing and Unicode composition, which
Spark has no function for. Those go through one Pandas UDF, and only for rows that
hold markup, entities or characters that composition could change.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce
from operator import add, or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skilldemand.functions.html_text import text_of

# Character replacements.
QUOTES_AND_DASHES = {
    "‘": "'",
    "’": "'",
    "“": '"',
    "”": '"',
    "–": "-",
    "—": "-",
    " ": " ",
    "•": "-",
}

# Boilerplate sentences in the order they are removed. Each comes with a
# lower-case text that every match contains.
BOILERPLATE = [
    ("equal", r"we are an equal\s+opportunit(?:y|ies)\s+employer[^.]*\."),
    ("equal", r"equal\s+opportunit(?:y|ies)\s+employer[^.]*\."),
    ("equal", r"equal\s+opportunit(?:y|ies)\s+and\s+diversity[^.]*\."),
    ("celebrate", r"we\s+celebrate\s+diversity[^.]*\."),
    ("committed", r"we\s+(?:are\s+)?committed\s+to\s+(?:a\s+)?(?:diverse|inclusive)[^.]*\."),
    ("diversity", r"diversity[,\s]+equity[,\s]+and\s+inclusion[^.]*\."),
    ("dei", r"dei\b[^.]*\."),
    (
        "applicants",
        r"applicants\s+must\s+(?:have\s+the\s+)?(?:right|eligibility)\s+to\s+work\s+in\s+"
        r"(?:the\s+)?(?:uk|united\s+kingdom)[^.]*\.",
    ),
    ("right", r"right\s+to\s+work\s+in\s+(?:the\s+)?(?:uk|united\s+kingdom)[^.]*\."),
    ("criminal", r"criminal\s+records?\s+(?:bureau\s+)?(?:check|disclosure)[^.]*\."),
    ("dbs", r"dbs\s+check[^.]*\."),
    ("subject", r"this\s+role\s+is\s+subject\s+to[^.]*\."),
    ("submitting", r"by\s+submitting\s+(?:your\s+)?(?:application|cv)[^.]*gdpr[^.]*\."),
    ("gdpr", r"in\s+line\s+with\s+gdpr[^.]*\."),
    ("your", r"your\s+data\s+will\s+be\s+(?:processed|stored|held)[^.]*\."),
    ("agencies", r"no\s+agencies\s+please[^.]*\."),
    ("agency", r"agency\s+applications?\s+will\s+not\s+be\s+(?:accepted|considered)[^.]*\."),
    ("directly", r"please\s+do\s+not\s+contact\s+us\s+directly[^.]*\."),
    ("salary", r"salary\s+will\s+be\s+(?:discussed|confirmed|revealed)[^.]*\."),
    ("salary", r"competitive\s+salary\s+(?:and\s+benefits?\s+)?package[^.]*\."),
]

# Urgency phrases, each with a lower-case text that every match contains.
URGENCY = [
    ("asap", r"\basap\b"),
    ("immediate", r"\bimmediate(?:ly)?\b"),
    ("immediate", r"\bimmediately?\s+available\b"),
    ("urgent", r"\burgent(?:ly)?\b"),
    ("right", r"\bright\s+away\b"),
    ("starting", r"\bstarting\s+immediately\b"),
    ("immediate", r"\bimmediate\s+start\b"),
    ("start", r"\bstart\s+(?:as\s+soon|immediately)\b"),
    ("delay", r"\bno\s+delay\b"),
    ("now", r"\b(?:hiring\s+)?now\b"),
    ("deadline", r"\bdeadline\b"),
    ("sensitive", r"\btime[\s-]sensitive\b"),
    ("fill", r"\bfill\s+immediately\b"),
]

BULLETS = "•·▪▸►‣⁃✓✗✘★☆"

# The whitespace that Python's str.strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

SLICE = 256  # texts of an Arrow batch that are parsed at once

_CHECKED = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]
)


def strip(col: Column) -> Column:
    """Trim whitespace of any kind from both ends."""
    return F.trim(col, F.lit(WHITESPACE))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def explode_once(df: DataFrame, array: Column | str, out: str, *keep: str) -> DataFrame:
    """One row per element of a costly array.

    A plain explode makes the optimiser filter empty arrays first, which computes the
    array twice; the outer one with its empty rows dropped afterwards does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(out)).where(F.col(out).isNotNull())


def fold(col: Column) -> Column:
    """Lower case, with the four letters that match ASCII letters case-insensitively."""
    special = reduce(or_, [col.contains(letter) for letter in "ſKıİ"])
    return F.lower(F.when(special, F.translate(col, "ſKıİ", "skii")).otherwise(col))


def word_runs(col: Column) -> Column:
    """The runs of letters, digits and underscores (ASCII) of a folded text."""
    return F.regexp_extract_all(col, F.lit("[a-zA-Z0-9_]+"), F.lit(0))


def ngrams(col: Column, longest: int = 4) -> Column:
    """Distinct 1- to ``longest``-word phrases of a text, lower-cased."""

    def of_length(words: Column, n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    words = F.regexp_extract_all(F.lower(col), F.lit(r"(?U)[\w+#./&-]*[\w+#]"), F.lit(0))
    return let(
        words,
        lambda w: F.array_distinct(F.concat(*[of_length(w, n) for n in range(1, longest + 1)])),
    )


def strip_html(col: Column, strip: bool = False) -> Column:
    """Text of the markup in ``col``; plain text passes by untouched."""
    has_markup = col.contains("<") | col.contains("&")
    parsed = _markup_text_trimmed(F.when(has_markup, col)) if strip else _markup_text(F.when(has_markup, col))
    plain = _trim_node(col) if strip else _blank_node(col)
    return F.coalesce(parsed, plain, F.lit(""))


def _blank_node(col: Column) -> Column:
    """A text without markup is one text node; a blank one shrinks to one character."""
    return F.when(
        (F.trim(col, F.lit(" \n\t\x0c\r")) == "") & (F.length(col) > 0),
        F.when(col.contains("\n"), "\n").otherwise(" "),
    ).otherwise(col)


def _trim_node(col: Column) -> Column:
    return strip(col)


@F.arrow_udf(T.StringType())
def _markup_text(texts: pa.Array) -> pa.Array:
    return _parsed(texts, strip=False)


@F.arrow_udf(T.StringType())
def _markup_text_trimmed(texts: pa.Array) -> pa.Array:
    return _parsed(texts, strip=True)


def _parsed(texts: pa.Array, strip: bool) -> pa.Array:
    """The texts of markup; of a batch only ``SLICE`` texts at a time are Python strings."""
    parts = [pa.array([], pa.string())]
    for low in range(0, len(texts), SLICE):
        some = texts.slice(low, SLICE).to_pylist()
        parts.append(pa.array([None if t is None else text_of(t, strip, lenient=True) for t in some], pa.string()))
    return pa.concat_arrays(parts)


def normalise_unicode(col: Column) -> Column:
    """Plain quotes and dashes, then composed (NFC) form."""
    plain = _plain_quotes(col)
    return F.coalesce(_compose(F.when(_may_compose(plain), plain)), plain)


def _plain_quotes(col: Column) -> Column:
    return F.translate(col, "".join(QUOTES_AND_DASHES), "".join(QUOTES_AND_DASHES.values()))


def _may_compose(col: Column) -> Column:
    """Characters below U+0300 never change under composition."""
    return col.rlike(r"[^\x{0}-\x{2ff}]")


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: unicodedata.normalize("NFC", text), na_action="ignore")


def remove_boilerplate(col: Column, sentences: list[tuple[str, str]] = BOILERPLATE) -> Column:
    """Remove the boilerplate sentences one after the other.

    A text that none of the patterns matches stays as it is, so the chain of
    replacements runs only on texts with boilerplate, and a pattern is tried only on
    texts that hold its fixed part.
    """

    def removed(text: Column) -> Column:
        cleaned = text
        for _, pattern in sentences:
            cleaned = F.regexp_replace(cleaned, f"(?isU){pattern}", "")
        return F.when(let(fold(text), lambda folded: any_match(text, folded)), cleaned).otherwise(text)

    def any_match(text: Column, folded: Column) -> Column:
        return reduce(
            or_,
            [folded.contains(needle) & text.rlike(f"(?isU){pattern}") for needle, pattern in sentences],
        )

    return let(col, removed)


def normalise_whitespace(col: Column) -> Column:
    """Bullets to dashes, space runs to one space, three or more newlines to two, trimmed."""
    dashed = F.translate(col, BULLETS, "-" * len(BULLETS))
    spaced = F.regexp_replace(dashed, r"[ \t]{2,}", " ")
    return strip(F.regexp_replace(spaced, r"\n{3,}", "\n\n"))


def clean_checked(col: Column) -> Column:
    """Clean a text; a struct of the cleaned text and the error of a row that failed."""
    blank = ~F.coalesce(col.rlike(f"[^{WHITESPACE}]"), F.lit(False))
    hard = col.contains("<") | col.contains("&") | _may_compose(col)
    parsed = _parse_and_compose(F.when(hard & ~blank, col))
    plain = F.when(hard, parsed["text"]).otherwise(_plain_quotes(col))
    cleaned = normalise_whitespace(remove_boilerplate(plain))
    return F.struct(
        F.when(blank, F.lit("")).otherwise(cleaned).alias("text"), parsed["error"].alias("error")
    )


@F.pandas_udf(_CHECKED)
def _parse_and_compose(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    table = str.maketrans(QUOTES_AND_DASHES)

    def one(text):
        if text is None:
            return None, None
        try:
            return unicodedata.normalize("NFC", text_of(text).translate(table)), None
        except Exception as exc:  # a bad row is reported, its neighbours go on
            return None, f"{type(exc).__name__}: {exc}"

    for texts in batches:
        yield pd.DataFrame([one(text) for text in texts], columns=["text", "error"])


def clean(col: Column) -> Column:
    """Markup out, Unicode composed, boilerplate out, whitespace normalised; blank gives ""."""
    return clean_checked(col)["text"]


def clean_lower(col: Column) -> Column:
    return F.lower(clean(col))


def urgency(col: Column, phrases: list[tuple[str, str]] = URGENCY) -> Column:
    """Matches summed over all phrases; a phrase is searched only where its fixed text occurs."""

    def total(folded: Column) -> Column:
        counts = [
            F.when(
                folded.contains(needle), F.regexp_count(col, F.lit(f"(?iU){pattern}"))
            ).otherwise(0)
            for needle, pattern in phrases
        ]
        return reduce(add, counts).cast("bigint")

    return F.coalesce(let(fold(col), total), F.lit(0).cast("bigint"))
