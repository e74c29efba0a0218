"""Lexicon sentiment of texts.

The rules are the published ones for rule-based valence scoring (Hutto and Gilbert,
"VADER", ICWSM 2014); the lexicon is a table the caller supplies with ``word`` and
``valence``. Idioms are a table of the caller's, too; emoji are left out. Every word is looked
up once, and a word of the lexicon looks at the three before it, so the cost is in
proportion to the text.

Punctuation is trimmed from both ends of a word where two or more characters remain, so
"(great)" and "great!!!!" are "great"; the marks of emphasis are counted in the whole text. "never
so" and "never this" strengthen a word two places on by half and three places on by a
quarter, undamped, as in the published program.
"""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skilldemand.functions.lookup import InlineTable, join_rows
from skilldemand.functions.numbers import round_exact
from skilldemand.functions.text import WHITESPACE, let, urgency

# Weights of the published rules.
BOOST = 0.293
CAPS = 0.733
NEGATE = -0.74
ALPHA = 15.0
DAMPING = {1: 1.0, 2: 0.95, 3: 0.9}
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, MAX_EXCLAMATIONS = 0.292, 4
QUESTION, MANY_QUESTIONS = 0.18, 0.96
NEVER_SO = {2: 1.5, 3: 1.25}

# Words that strengthen or weaken the word after them.
STRENGTHEN = (
    "absolutely amazingly awfully completely considerably decidedly deeply effing enormously "
    "entirely especially exceptionally extremely fabulously flipping flippin fricking frickin "
    "frigging friggin fully fucking greatly hella highly hugely incredibly intensely majorly "
    "more most particularly purely quite really remarkably so substantially thoroughly totally "
    "tremendously uber unbelievably unusually utterly very"
).split()
WEAKEN = (
    "almost barely hardly kinda kindof less little marginally occasionally partly scarcely "
    "slightly somewhat sorta sortof"
).split()

# Words that turn the meaning of the words after them.
NEGATIONS = (
    "aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't "
    "didn't doesn't dont hadnt hasnt havent isnt mightnt mustnt neither don't hadn't hasn't "
    "haven't isn't mightn't mustn't neednt needn't never none nope nor not nothing nowhere "
    "oughtnt shant shouldnt uhuh wasnt werent oughtn't shan't shouldn't uh-uh wasn't weren't "
    "without wont wouldnt won't wouldn't rarely seldom despite"
).split()

_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_HITS = "array<struct<word: string, valence: double>>"


def score_sentiment(
    postings: DataFrame,
    lexicon: DataFrame,
    text_col: str = "raw_text",
    id_col: str = "posting_id",
    inline: bool = True,
    idioms: DataFrame | None = None,
) -> DataFrame:
    """(posting, compound, positive, negative, neutral, urgency); blank texts are neutral."""
    scored = with_sentiment(
        postings.select(id_col, text_col), lexicon, text_col, id_col, inline=inline, idioms=idioms
    )
    return scored.select(
        id_col,
        *[
            round_exact(F.col("sentiment")[name], 4).alias(name)
            for name in ("compound", "positive", "negative", "neutral")
        ],
        urgency(F.col(text_col)).alias("urgency"),
    )


def compound(
    postings: DataFrame,
    lexicon: DataFrame,
    text_col: str = "raw_text",
    id_col: str = "posting_id",
    inline: bool = True,
) -> DataFrame:
    """(posting, compound)."""
    return score_sentiment(postings, lexicon, text_col, id_col, inline).select(id_col, "compound")


def words_of(text: Column) -> Column:
    """Words of two or more characters, punctuation trimmed where two or more remain.

    One search: from the first to the last character that is not punctuation, or a whole
    word in which no two such characters are.
    """
    mark = "[" + re.sub(r"([\]\[\\^&-])", r"\\\1", _PUNCTUATION) + "]"
    plain = "[^\\s" + mark[1:]
    core = rf"{plain}\S*{plain}"
    return F.regexp_extract_all(text, F.lit(rf"(?U){core}|(?<!\S)(?!\S*?{core})\S{{2,}}"), F.lit(0))


def with_sentiment(
    df: DataFrame,
    lexicon: DataFrame,
    text_col: str,
    id_col: str,
    out: str = "sentiment",
    inline: bool = True,
    idioms: DataFrame | None = None,
) -> DataFrame:
    """Add a struct of unrounded compound, positive, negative and neutral scores.

    Words of the lexicon that are equal in lower case have the highest of their valences;
    rows without a word or a valence are ignored. ``inline`` changes no result. ``idioms``
    has ``phrase``, two or three words in lower case, with a ``valence`` in place of that of
    a lexicon word in or after it, a ``boost`` that is added to it ("kind of"), or both; of
    equal phrases the highest values count. They are inlined.
    """
    table = lexicon.select(F.lower("word").alias("word"), F.col("valence").cast("double").alias("valence"))
    table = table.where("valence is not null").groupBy("word").agg(F.max("valence").alias("valence"))
    words = F.coalesce(words_of(F.col(text_col)), F.array().cast("array<string>"))
    if inline:
        known = InlineTable(table, "word")
        found, hits = df, None
        valences = lambda lower, _: F.transform(lower, lambda w: known.first(w)["valence"])
    else:
        found = join_rows(
            df, table, "word", F.array_distinct(F.transform(words, F.lower)), F.col(text_col), "_hits"
        )
        hits = F.map_from_entries(F.coalesce("_hits", F.array().cast(_HITS)))
        valences = lambda lower, held: F.transform(lower, lambda w: F.try_element_at(held, w))
    phrases = None
    if idioms is not None:
        rows = idioms.select("phrase", *[F.col(c).cast("double").alias(c) for c in ("valence", "boost")])
        rows = rows.where("phrase is not null").groupBy("phrase").agg(F.max("valence").alias("valence"), F.max("boost").alias("boost"))
        phrases = InlineTable(rows, "phrase")
    text = F.col(text_col)
    blank = ~F.coalesce(text.rlike(f"[^{WHITESPACE}]"), F.lit(False))

    def with_lower(d: Column) -> Column:
        return F.struct(d["words"].alias("words"), F.transform(d["words"], F.lower).alias("lower"), d["hits"].alias("hits"))

    def with_valences(d: Column) -> Column:
        return F.struct(
            d["words"].alias("words"),
            d["lower"].alias("lower"),
            valences(d["lower"], d["hits"]).alias("v"),
            (F.array_position(d["lower"], "but") - 1).alias("but"),
            _emphasis(text).alias("emphasis"),
        )

    held = F.lit(None) if hits is None else hits
    doc = let(let(F.struct(words.alias("words"), held.alias("hits")), with_lower), with_valences)
    nothing = _result(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    scored = found.withColumn(out, F.when(blank, nothing).otherwise(let(doc, partial(_scores, phrases))))
    return scored.drop("_hits")


def _result(compound: Column, positive: Column, negative: Column, neutral: Column) -> Column:
    return F.struct(
        compound.alias("compound"),
        positive.alias("positive"),
        negative.alias("negative"),
        neutral.alias("neutral"),
    )


def _emphasis(text: Column) -> Column:
    marks = F.least(F.regexp_count(text, F.lit("!")), F.lit(MAX_EXCLAMATIONS)) * EXCLAMATION
    questions = F.regexp_count(text, F.lit(r"\?"))
    return marks + F.when(questions > 3, MANY_QUESTIONS).when(
        questions > 1, questions * QUESTION
    ).otherwise(0.0)


def _scores(phrases: InlineTable | None, doc: Column) -> Column:
    return let(
        F.struct(
            _valences(phrases, doc).alias("v"), doc["emphasis"].alias("emphasis"), F.size(doc["words"]).alias("n")
        ),
        _summary,
    )


def _shouted(word: Column) -> Column:
    return (F.upper(word) == word) & (F.lower(word) != word)


def _stands_out(c: Column, i: Column) -> Column:
    """A word in capitals in a text that is not all in capitals."""
    return _shouted(F.get(c["words"], i)) & F.exists(c["words"], lambda w: ~_shouted(w))


def _known(c: Column, i: Column) -> Column:
    return F.get(c["v"], i).isNotNull()


def _valences(phrases: InlineTable | None, c: Column) -> Column:
    """Valence of every lexicon word in place; other words count as zero and are left out."""
    found = F.filter(F.transform(c["v"], lambda v, i: F.when(v.isNotNull(), i)), lambda i: i.isNotNull())
    positions = F.filter(
        found,
        lambda i: (_booster(F.get(c["lower"], i)) == 0.0)
        & ~((F.get(c["lower"], i) == "kind") & _is(F.get(c["lower"], i + 1), "of")),
    )

    def one(i: Column) -> Column:
        own = F.get(c["v"], i)
        loud = F.when(own > 0, own + CAPS).otherwise(own - CAPS)
        start = F.when(_stands_out(c, i), loud).otherwise(own)
        modified = start
        for distance in (1, 2, 3):
            modified = let(modified, partial(_modify, c, i, distance))
        if phrases is not None:
            far = F.get(c["lower"], i - 3)
            with_idioms = let(modified, partial(_idioms, phrases, c, i))
            modified = F.when(far.isNotNull() & ~_known(c, i - 3), with_idioms).otherwise(modified)
        least = let(modified, lambda v: F.when(_least(c, i), v * NEGATE).otherwise(v))
        weight = (
            F.when(c["but"] < 0, 1.0)
            .when(i < c["but"], BEFORE_BUT)
            .when(i > c["but"], AFTER_BUT)
            .otherwise(1.0)
        )
        return least * weight

    return F.transform(positions, one)


def _idioms(phrases: InlineTable, c: Column, i: Column, valence: Column) -> Column:
    """The valence of an idiom around ``i``, if there is one, and the boosts before it.

    As published: idioms that end at or before the word are tried in a fixed order, those
    that begin with it go over them, and only words with three words before them are
    looked at.
    """

    def row(first: int, last: int) -> Column:
        return phrases.first(F.array_join(F.slice(c["lower"], i + first + 1, last - first + 1), " "))

    before = F.coalesce(*[row(x, y)["valence"] for x, y in ((-1, 0), (-2, 0), (-2, -1), (-3, -1), (-3, -2))])
    n = F.size(c["lower"])
    after = F.coalesce(
        F.when(i + 2 < n, row(0, 2)["valence"]),
        F.when(i + 1 < n, row(0, 1)["valence"]),
    )
    boosts = [F.coalesce(row(x, y)["boost"], F.lit(0.0)) for x, y in ((-3, -1), (-3, -2), (-2, -1))]
    return F.coalesce(after, before, valence) + boosts[0] + boosts[1] + boosts[2]


def _modify(c: Column, i: Column, distance: int, valence: Column) -> Column:
    """Effect of the word ``distance`` places before on the valence at ``i``."""
    near = F.get(c["lower"], i - distance)
    boost = _booster(near)
    signed = F.when(valence < 0, -boost).otherwise(boost)
    loud = F.when(
        (boost != 0) & _stands_out(c, i - distance),
        F.when(valence > 0, CAPS).otherwise(-CAPS),
    ).otherwise(0.0)
    boosted = valence + (signed + loud) * DAMPING[distance]
    turned = F.when(_negated(near), NEGATE)
    if distance > 1:
        so = _is(F.get(c["lower"], i - 1), "so", "this")
        if distance == 3:
            so = so | _is(F.get(c["lower"], i - 2), "so", "this")
        factor = F.when((near == "never") & so, NEVER_SO[distance]).otherwise(turned)
    else:
        factor = turned
    return F.when(
        near.isNotNull() & ~_known(c, i - distance), boosted * F.coalesce(factor, F.lit(1.0))
    ).otherwise(valence)


def _least(c: Column, i: Column) -> Column:
    before = F.get(c["lower"], i - 1)
    return (
        _is(before, "least")
        & ~_known(c, i - 1)
        & ~_is(F.get(c["lower"], i - 2), "at", "very")
    )


def _is(word: Column, *values: str) -> Column:
    return F.coalesce(word.isin(*values), F.lit(False))


def _booster(word: Column) -> Column:
    return F.when(word.isin(STRENGTHEN), BOOST).when(word.isin(WEAKEN), -BOOST).otherwise(0.0)


def _negated(word: Column) -> Column:
    return word.isin(NEGATIONS) | word.contains("n't")


def _summary(s: Column) -> Column:
    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)

    positive = total(F.transform(F.filter(s["v"], lambda v: v > 0), lambda v: v + 1))
    negative = total(F.transform(F.filter(s["v"], lambda v: v < 0), lambda v: v - 1))
    neutral = s["n"] - F.size(F.filter(s["v"], lambda v: v != 0))
    return let(
        F.struct(
            total(s["v"]).alias("sum"),
            positive.alias("pos"),
            negative.alias("neg"),
            neutral.alias("neu"),
            s["emphasis"].alias("emphasis"),
        ),
        _normalised,
    )


def _normalised(t: Column) -> Column:
    summed = F.when(t["sum"] > 0, t["sum"] + t["emphasis"]).when(
        t["sum"] < 0, t["sum"] - t["emphasis"]
    ).otherwise(0.0)
    positive = F.when(t["pos"] > -t["neg"], t["pos"] + t["emphasis"]).otherwise(t["pos"])
    negative = F.when(t["pos"] < -t["neg"], t["neg"] - t["emphasis"]).otherwise(t["neg"])
    whole = positive - negative + t["neu"]

    def share(part: Column) -> Column:
        return F.when(whole > 0, round_exact(F.abs(part) / whole, 3)).otherwise(0.0)

    bounded = F.greatest(F.least(summed / F.sqrt(summed * summed + ALPHA), F.lit(1.0)), F.lit(-1.0))
    return _result(bounded, share(positive), share(negative), share(t["neu"].cast("double")))
