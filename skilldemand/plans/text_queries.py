"""Registered queries on the document and page tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skilldemand.functions import text as X
from skilldemand.operators import enrich as N
from skilldemand.operators import evaluate as V
from skilldemand.operators import sentiment as S
from skilldemand.operators import skills as K
from skilldemand.plans import adapters as A
from skilldemand.functions.bands import sentiment_band
from skilldemand.plans.basket_queries import BASKET_SQL
from skilldemand.session import scratch_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Reference tables of the queries.

SKILLS = ["worthless", "trash", "idiot", "with", "the", "for"]  # longest first
SOFT = ["with", "for"]
LEXICON = {
    "pathetic": -2.3,
    "clown": -1.2,
    "moron": -2.5,
    "disgusting": -2.4,
    "loser": -2.4,
    "worthless": -1.9,
    "trash": -1.6,
    "stupid": -2.4,
    "scum": -2.8,
    "idiot": -2.3,
    "and": 0.4,
    "of": 0.3,
}
GAZETTEER = [("The", "ORG"), ("Than", "GPE"), ("And", "LOC"), ("idiot", "PRODUCT"), ("There", "DATE"), ("Of", "ORG")]
PHRASE_KEYWORDS = ["idiot", "tion", "trash"]


def vocab(spark):
    rows = [(s, "soft" if s in SOFT else "technical", i) for i, s in enumerate(SKILLS)]
    return spark.createDataFrame(rows, "skill string, kind string, ord bigint")


def lexicon(spark):
    return spark.createDataFrame(list(LEXICON.items()), "word string, valence double")


def gazetteer(spark):
    return spark.createDataFrame(GAZETTEER, "name string, label string")


# SQL of the text operators. ``src`` is a relation (posting_id, text).

DOCS_SQL = "docs AS (SELECT doc_id AS posting_id, text FROM documents)"
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"


def unicode_sql(col: str) -> str:
    return f"nfc_normalize(translate({col}, '‘’“”–—' || chr(160) || '•', '''''\"\"-- -'))"


def boilerplate_sql(col: str) -> str:
    sql = col
    for _, pattern in X.BOILERPLATE:
        # \b is ASCII in RE2; a non-word character or the full stop has to follow instead.
        pattern = pattern.replace(r"dei\b[^.]*\.", r"dei(?:[^\p{L}\p{M}\p{N}_.][^.]*)?\.")
        sql = f"regexp_replace({sql}, '(?is){pattern}', '', 'g')"
    return sql


def whitespace_sql(col: str) -> str:
    dashed = f"translate({col}, '{X.BULLETS}', '{'-' * len(X.BULLETS)}')"
    spaced = f"regexp_replace({dashed}, '[ ' || chr(9) || ']{{2,}}', ' ', 'g')"
    return f"trim(regexp_replace({spaced}, '\\n{{3,}}', chr(10) || chr(10), 'g'), {WS})"


def clean_sql(col: str) -> str:
    return whitespace_sql(boilerplate_sql(unicode_sql(col)))


def counts_sql(src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT posting_id, '{s}' AS skill, {i} AS ord, len(regexp_extract_all(text, '(?i)\\b{s}\\b')) AS n FROM {src}"
        for i, s in enumerate(SKILLS)
    )


def skills_sql(src: str) -> str:
    return f"""SELECT d.posting_id, coalesce(string_agg(skill || ':' || n, '|' ORDER BY n DESC, ord), '') AS skills,
      coalesce(string_agg(skill, '|' ORDER BY n DESC, ord), '') AS names
      FROM {src} d LEFT JOIN (SELECT * FROM ({counts_sql(src)}) WHERE n > 0) c USING (posting_id) GROUP BY d.posting_id"""


def urgency_sql(col: str) -> str:
    """Words end where a character is no letter, mark, number or connector; each such
    character is doubled first, so that neighbouring matches do not share it."""
    edge = r"[^\p{L}\p{M}\p{N}\p{Pc}]"
    doubled = f"(chr(10) || regexp_replace({col}, '({edge})', '\\1\\1', 'g') || chr(10))"
    counts = []
    for _, pattern in X.URGENCY:
        body = pattern.removeprefix(r"\b").removesuffix(r"\b").replace(r"[\s-]", r"[\s-]{2}")
        counts.append(f"len(regexp_extract_all({doubled}, '(?i){edge}(?:{body}){edge}'))")
    return "(" + " + ".join(counts) + ")"


def sentiment_sql(src: str) -> str:
    """The scoring rules over one row per word."""
    lex = ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in LEXICON.items())
    quoted = lambda ws: ", ".join("'" + w.replace("'", "''") + "'" for w in ws)
    punct = "'" + S._PUNCTUATION.replace("'", "''") + "'"
    boost = lambda w: (
        f"CASE WHEN {w} IN ({quoted(S.STRENGTHEN)}) THEN {S.BOOST}::DOUBLE "
        f"WHEN {w} IN ({quoted(S.WEAKEN)}) THEN -{S.BOOST}::DOUBLE ELSE 0.0::DOUBLE END"
    )
    steps, before = [], "start"
    for d in (1, 2, 3):
        negated = f"(p{d} IN ({quoted(S.NEGATIONS)}) OR contains(p{d}, 'n''t'))"
        turned = f"WHEN {negated} THEN {S.NEGATE}"
        so = "p1 IN ('so', 'this')" if d == 2 else "(p1 IN ('so', 'this') OR p2 IN ('so', 'this'))"
        never = f"WHEN p{d} = 'never' AND coalesce({so}, false) THEN {S.NEVER_SO.get(d)}" if d > 1 else ""
        loud = (
            f"CASE WHEN mixed AND b{d} <> 0 AND up{d} THEN CASE WHEN {before} > 0 THEN {S.CAPS} ELSE -{S.CAPS} END ELSE 0 END"
        )
        steps.append(
            f"""s{d} AS (SELECT *, CASE WHEN p{d} IS NULL OR k{d} THEN {before} ELSE
              ({before} + (CASE WHEN {before} < 0 THEN -b{d} ELSE b{d} END + {loud}) * {S.DAMPING[d]})
              * CASE {never} {turned} ELSE 1.0 END END AS v{d} FROM {'s0' if d == 1 else f's{d - 1}'})"""
        )
        before = f"v{d}"
    lags = ", ".join(
        f"lag(w, {d}) OVER o AS p{d}, lag(up, {d}) OVER o AS up{d}, coalesce(lag(known, {d}) OVER o, false) AS k{d}, "
        f"{boost(f'lag(w, {d}) OVER o')} AS b{d}"
        for d in (1, 2, 3)
    )
    return f"""lex(word, valence) AS (VALUES {lex}),
raw AS (SELECT posting_id, text, unnest(regexp_extract_all(text, '\\S{{2,}}')) AS r,
               generate_subscripts(regexp_extract_all(text, '\\S{{2,}}'), 1) AS i FROM {src}),
bare AS (SELECT *, CASE WHEN length(trim(r, {punct})) > 1 THEN trim(r, {punct}) ELSE r END AS b FROM raw),
tokens AS (SELECT bare.*, lower(b) AS w, upper(b) = b AND lower(b) <> b AS up, valence, valence IS NOT NULL AS known
           FROM bare LEFT JOIN lex ON word = lower(b)),
ctx AS (SELECT *, lead(w) OVER o AS nxt, {lags},
               count(*) FILTER (WHERE up) OVER d > 0 AND count(*) FILTER (WHERE NOT up) OVER d > 0 AS mixed,
               min(CASE WHEN w = 'but' THEN i END) OVER d AS but
        FROM tokens WINDOW o AS (PARTITION BY posting_id ORDER BY i), d AS (PARTITION BY posting_id)),
s0 AS (SELECT *, valence + CASE WHEN mixed AND up THEN CASE WHEN valence > 0 THEN {S.CAPS} ELSE -{S.CAPS} END ELSE 0 END AS start
       FROM ctx WHERE known AND {boost('w')} = 0 AND NOT (w = 'kind' AND coalesce(nxt = 'of', false))),
{', '.join(steps)},
scored AS (SELECT posting_id,
  v3 * CASE WHEN p1 = 'least' AND NOT k1 AND NOT coalesce(p2 IN ('at', 'very'), false) THEN {S.NEGATE} ELSE 1.0 END
     * CASE WHEN but IS NULL OR i = but THEN 1.0 WHEN i < but THEN {S.BEFORE_BUT} ELSE {S.AFTER_BUT} END AS v FROM s3),
sums AS (SELECT posting_id, sum(v) AS total, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS pos,
                sum(CASE WHEN v < 0 THEN v - 1 ELSE 0 END) AS neg, count(*) FILTER (WHERE v <> 0) AS nonzero
         FROM scored GROUP BY posting_id),
marks AS (SELECT d.posting_id, text, coalesce(total, 0.0) AS total, coalesce(pos, 0.0) AS pos, coalesce(neg, 0.0) AS neg,
  len(regexp_extract_all(text, '\\S{{2,}}')) - coalesce(nonzero, 0) AS neu,
  least(length(text) - length(replace(text, '!', '')), {S.MAX_EXCLAMATIONS}) * {S.EXCLAMATION}::DOUBLE
  + CASE WHEN length(text) - length(replace(text, '?', '')) > 3 THEN {S.MANY_QUESTIONS}::DOUBLE
         WHEN length(text) - length(replace(text, '?', '')) > 1
         THEN (length(text) - length(replace(text, '?', ''))) * {S.QUESTION}::DOUBLE ELSE 0.0 END AS emph
  FROM {src} d LEFT JOIN sums USING (posting_id)),
emphasised AS (SELECT *, CASE WHEN total > 0 THEN total + emph WHEN total < 0 THEN total - emph ELSE 0.0 END AS t,
  CASE WHEN pos > -neg THEN pos + emph ELSE pos END AS p, CASE WHEN pos < -neg THEN neg - emph ELSE neg END AS n FROM marks),
sentiment AS (SELECT posting_id, text,
  CASE WHEN trim(text, {WS}) = '' THEN 0.0 ELSE t / sqrt(t * t + {S.ALPHA}) END AS compound,
  CASE WHEN trim(text, {WS}) = '' OR p - n + neu = 0 THEN 0.0 ELSE p / (p - n + neu) END AS positive,
  CASE WHEN trim(text, {WS}) = '' OR p - n + neu = 0 THEN 0.0 ELSE -n / (p - n + neu) END AS negative,
  CASE WHEN trim(text, {WS}) = '' THEN 1.0 WHEN p - n + neu = 0 THEN 0.0 ELSE neu / (p - n + neu) END AS neutral
  FROM emphasised)"""


def entities_sql(src: str, extra: str = "NULL") -> str:
    fields = {"ORG": "orgs", "GPE": "locations", "LOC": "locations", "PRODUCT": "products"}
    columns = []
    for field in ("orgs", "locations", "products"):
        names = sorted(n for n, label in GAZETTEER if fields.get(label) == field)
        found = ", ".join(
            f"CASE WHEN regexp_matches(text, '\\b{n}\\b') THEN '{n}' END" for n in names
        )
        columns.append(f"array_to_string(list_filter([{found}], lambda x: x IS NOT NULL), '|') AS {field}")
    return f"SELECT posting_id, {', '.join(columns)} FROM {src}"


# Cleaning


def _docs(spark, sf):
    return A.spread_postings(spark, sf)


def _digest_of(column):
    return [F.md5(column).alias("digest"), F.length(column).alias("n")]


PAGE_TEXT = r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>|<[^>]*>"


@query(
    "b1_strip_html",
    f"""WITH t AS (SELECT page_id, regexp_replace(html, '{PAGE_TEXT}', ' ', 'g') AS t FROM pages),
      e AS (SELECT page_id, replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM t)
      SELECT page_id, md5(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS digest,
             length(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS n FROM e""",
)
def b1(spark, sf):
    text = X.strip_html(F.col("html"))
    squeezed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return A.pages(spark, sf).select("page_id", squeezed.alias("t")).select("page_id", *_digest_of(F.col("t")))


@query(
    "b1_strip_html_trimmed",
    f"""WITH t AS (SELECT doc_id, trim('<p>' || text || '</p>', '') AS t FROM documents)
      SELECT doc_id, md5(trim(substr(t, 4, length(t) - 7), {WS})) AS digest,
             length(trim(substr(t, 4, length(t) - 7), {WS})) AS n FROM t""",
)
def b1_trimmed(spark, sf):
    marked = F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>"))
    docs = A.table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id", "text")
    rows = docs.select("doc_id", X.strip_html(marked, strip=True).alias("t"))
    return rows.select("doc_id", *_digest_of(F.col("t")))


CLEANING = {
    "b2_normalise_unicode": (X.normalise_unicode, unicode_sql("text")),
    "b3_remove_boilerplate": (X.remove_boilerplate, boilerplate_sql("text")),
    "b4_normalise_whitespace": (X.normalise_whitespace, whitespace_sql("text")),
    "b5_clean": (X.clean, clean_sql("text")),
    "b6_clean_lower": (X.clean_lower, f"lower({clean_sql('text')})"),
}


def _register_cleaning(name, function, sql):
    def run(spark, sf):
        rows = _docs(spark, sf).select("posting_id", function(F.col("raw_text")).alias("t"))
        return rows.select("posting_id", *_digest_of(F.col("t")))

    full = f"WITH t AS (SELECT doc_id AS posting_id, {sql} AS t FROM documents) SELECT posting_id, md5(t) AS digest, length(t) AS n FROM t"
    query(name, full)(run)


for _name, (_function, _sql) in CLEANING.items():
    _register_cleaning(_name, _function, _sql)


# Skills, sentiment, entities


@query("c1_match_vocab", f"WITH {DOCS_SQL} SELECT posting_id, skill, n FROM ({counts_sql('docs')}) WHERE n > 0")
def c1(spark, sf):
    return K.match_vocab(_docs(spark, sf), vocab(spark))


CHUNKS_SQL = """phrases AS (SELECT DISTINCT posting_id, lower(unnest(string_split(text, ' '))) AS skill FROM docs),
chunks AS (SELECT posting_id, skill, CAST(1 AS BIGINT) AS n FROM phrases
           WHERE skill IN ('worthless', 'trash', 'idiot', 'with', 'the', 'for'))"""


@query("c2_match_chunks", f"WITH {DOCS_SQL}, {CHUNKS_SQL} SELECT * FROM chunks")
def c2(spark, sf):
    rows = _docs(spark, sf).withColumn("chunks", F.split("raw_text", " "))
    return K.match_chunks(rows, vocab(spark), "chunks")


# the skills here are single words, so phrases of one word are all that can equal them
PHRASES_SQL = r"""WITH g AS (SELECT DISTINCT doc_id AS posting_id, unnest(regexp_extract_all(lower(text),
    '[\p{L}\p{M}\p{N}\p{Pc}+#./&-]*[\p{L}\p{M}\p{N}\p{Pc}+#]')) AS p FROM documents)"""


@query("c2_match_phrases", PHRASES_SQL + f" SELECT posting_id, p AS skill, CAST(1 AS BIGINT) AS n FROM g WHERE p IN ({', '.join(repr(s) for s in SKILLS)})")
def c2_phrases(spark, sf):
    return K.match_chunks(_docs(spark, sf), vocab(spark))


LARGE_SQL = """SELECT doc_id AS posting_id, w AS skill, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM documents)
  WHERE regexp_full_match(w, '[a-z]{9,}') GROUP BY ALL"""


@query("c1_match_large_vocab", LARGE_SQL)
def c1_large(spark, sf):
    """A vocabulary of all long words of the documents, joined by word."""
    words = X.explode_once(_docs(spark, sf), X.word_runs(X.fold(F.col("raw_text"))), "skill")
    known = words.where(F.col("skill").rlike("^[a-z]{9,}$")).distinct().withColumn("ord", F.lit(0))
    return K.match_vocab(_docs(spark, sf), known, inline=False)


@query("c3_extract_skills", f"WITH {DOCS_SQL} SELECT posting_id, skills FROM ({skills_sql('docs')})")
def c3(spark, sf):
    return _joined_skills(K.extract_skills(_docs(spark, sf), vocab(spark)))


def _joined_skills(rows):
    pairs = F.transform("skills", lambda s: F.concat_ws(":", s["skill"], s["n"].cast("string")))
    return rows.select("posting_id", F.array_join(pairs, "|").alias("skills"))


@query(
    "c3_extract_skills_chunks",
    f"""WITH {DOCS_SQL}, {CHUNKS_SQL},
      summed AS (SELECT posting_id, skill, ord, c.n + coalesce(k.n, 0) AS n
                 FROM ({counts_sql('docs')}) c LEFT JOIN chunks k USING (posting_id, skill))
      SELECT d.posting_id, coalesce(string_agg(skill || ':' || n, '|' ORDER BY n DESC, ord), '') AS skills
      FROM docs d LEFT JOIN (SELECT * FROM summed WHERE n >= 3) s USING (posting_id) GROUP BY d.posting_id""",
)
def c3_chunks(spark, sf):
    rows = _docs(spark, sf).withColumn("chunks", F.split("raw_text", " "))
    return _joined_skills(K.extract_skills(rows, vocab(spark), chunks_col="chunks", min_count=3))


@query(
    "c4_categorise",
    BASKET_SQL + """SELECT posting_id, array_to_string(list_filter(skills, lambda s: s NOT LIKE 'small%' AND s NOT LIKE 'hot%'), '|') AS technical,
      array_to_string(list_filter(skills, lambda s: s LIKE 'small%' OR s LIKE 'hot%'), '|') AS soft FROM processed""",
)
def c4(spark, sf):
    names = A.table(spark, sf, "part").select("p_name").distinct()
    kinds = F.when(F.col("p_name").rlike("^(small|hot)"), "soft").otherwise("technical")
    known = names.select(F.initcap("p_name").alias("skill"), kinds.alias("kind"))
    rows = K.categorise(A.basket_processed(spark, sf), known)
    return rows.select("posting_id", F.array_join("technical", "|").alias("technical"), F.array_join("soft", "|").alias("soft"))


@query("c5_urgency", f"SELECT doc_id AS posting_id, CAST({urgency_sql('text')} AS BIGINT) AS urgency FROM documents")
def c5(spark, sf):
    return _docs(spark, sf).select("posting_id", X.urgency(F.col("raw_text")).alias("urgency"))


def _rounded_sql(digits: dict[str, int]) -> str:
    return ", ".join(f"CAST(printf('%.{d}f', {c}) AS DOUBLE) AS {c}" for c, d in digits.items())


@query(
    "c6_score_sentiment",
    f"""WITH {DOCS_SQL}, {sentiment_sql('docs')} SELECT posting_id,
      {_rounded_sql({'compound': 4, 'positive': 3, 'negative': 3, 'neutral': 3})},
      CAST({urgency_sql('text')} AS BIGINT) AS urgency FROM sentiment""",
)
def c6(spark, sf):
    return S.score_sentiment(_docs(spark, sf), lexicon(spark))


@query("c7_compound", f"WITH {DOCS_SQL}, {sentiment_sql('docs')} SELECT posting_id, {_rounded_sql({'compound': 4})} FROM sentiment")
def c7(spark, sf):
    return S.compound(_docs(spark, sf), lexicon(spark))


@query("c9_extract_entities", f"WITH {DOCS_SQL} {entities_sql('docs')}")
def c9(spark, sf):
    return _joined_entities(K.extract_entities(_docs(spark, sf), gazetteer(spark)))


def _joined_entities(rows):
    return rows.select(
        "posting_id",
        *[F.array_join(F.col("entities")[f], "|").alias(f) for f in ("orgs", "locations", "products")],
    )


@query(
    "c9_entities_from_mentions",
    BASKET_SQL + """SELECT p.posting_id, coalesce(string_agg(DISTINCT p_name, '|' ORDER BY p_name) FILTER (WHERE l_returnflag = 'A'), '') AS orgs,
      coalesce(string_agg(DISTINCT p_name, '|' ORDER BY p_name) FILTER (WHERE l_returnflag = 'N'), '') AS locations, '' AS products
      FROM postings p LEFT JOIN lines USING (posting_id) GROUP BY p.posting_id""",
)
def c9_mentions(spark, sf):
    label = F.when(F.col("l_returnflag") == "A", "ORG").when(F.col("l_returnflag") == "N", "GPE").otherwise("DATE")
    mentions = A.basket_lines(spark, sf).select(
        F.col("l_orderkey").alias("posting_id"), F.concat(F.lit(" "), "p_name").alias("text"), label.alias("label")
    )
    return _joined_entities(K.entities_from_mentions(A.basket_postings(spark, sf), mentions))


@query(
    "c11_phrase_skills",
    f"""WITH parts AS (SELECT doc_id AS posting_id, unnest(string_split(text, '.')) AS c FROM documents),
      kept AS (SELECT posting_id, regexp_replace(regexp_replace(trim(lower(c), {WS}), '\\s+', ' ', 'g'),
                 '^(?:(?:{'|'.join(K.DETERMINERS)})(?: |$))+', '') AS c
               FROM parts WHERE {' OR '.join(f"contains(lower(c), '{k}')" for k in PHRASE_KEYWORDS)}),
      sets AS (SELECT posting_id, string_agg(DISTINCT c, '|' ORDER BY c) AS c FROM kept WHERE c <> '' GROUP BY posting_id)
      SELECT d.doc_id AS posting_id, md5(coalesce(c, '')) AS digest, length(coalesce(c, '')) AS n
      FROM documents d LEFT JOIN sets ON posting_id = doc_id""",
)
def c11(spark, sf):
    phrases = K.phrase_skills(F.split("raw_text", r"\."), PHRASE_KEYWORDS)
    rows = _docs(spark, sf).select("posting_id", F.array_join(F.array_sort(phrases), "|").alias("t"))
    return rows.select("posting_id", *_digest_of(F.col("t")))


# Enrichment run

FAILING = "<![broken[ "


def _enriched(spark, sf, bad: bool = False):
    rows = _docs(spark, sf)
    if bad:
        rows = rows.withColumn(
            "raw_text",
            F.when(F.length("raw_text") % 50 == 0, F.concat(F.lit(FAILING), "raw_text")).otherwise(F.col("raw_text")),
        )
    return N.enrich(rows, vocab(spark), lexicon(spark), gazetteer(spark))


CLEANED_SQL = f"docs AS (SELECT doc_id AS posting_id, {clean_sql('text')} AS text FROM documents)"
ENRICH_SQL = f"""WITH {CLEANED_SQL}, {sentiment_sql('docs')},
found AS ({skills_sql('docs')}), named AS ({entities_sql('docs')})
SELECT posting_id, names AS skills, {_rounded_sql({'compound': 4}).replace('AS compound', 'AS sentiment_score')},
       orgs, locations, products FROM sentiment JOIN found USING (posting_id) JOIN named USING (posting_id)"""


def _joined_enrichment(rows):
    return rows.select(
        "posting_id",
        F.array_join("skills_extracted", "|").alias("skills"),
        "sentiment_score",
        *[F.array_join(F.col("entities")[f], "|").alias(f) for f in ("orgs", "locations", "products")],
    )


@query("d2_enrich", ENRICH_SQL)
def d2(spark, sf):
    return _joined_enrichment(_enriched(spark, sf))


@query("d3_append_processed", ENRICH_SQL + " WHERE posting_id NOT IN (SELECT doc_id FROM documents WHERE length(text) % 50 = 0)")
def d3(spark, sf):
    path = scratch_dir(spark, "processed")
    N.append_processed(_enriched(spark, sf, bad=True), path)
    return _joined_enrichment(N.read_processed(spark, path))


@query("d4_quarantine", "SELECT doc_id AS posting_id, true AS has_message FROM documents WHERE length(text) % 50 = 0")
def d4(spark, sf):
    path = scratch_dir(spark, "processed")
    N.append_processed(_enriched(spark, sf, bad=True), path)
    return N.read_quarantine(spark, path).select("posting_id", (F.length("error") > 0).alias("has_message"))


@query(
    "d5_run_summary",
    """SELECT count(*) FILTER (WHERE length(text) % 50 <> 0) AS processed,
              count(*) FILTER (WHERE length(text) % 50 = 0) AS errors FROM documents""",
)
def d5(spark, sf):
    path = scratch_dir(spark, "processed")
    for _ in range(2):  # a repeated run counts once
        N.append_processed(_enriched(spark, sf, bad=True), path, "one")
    return N.written_summary(spark, path, "one")


# Evaluation


def _sets(spark, sf, keep=None):
    lines = A.basket_lines(spark, sf)
    chosen = lines if keep is None else lines.where(keep)
    return chosen.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("p_name").alias("skills"))


def prf_sql(keep: str, name: str) -> str:
    return f"""pred_{name} AS (SELECT DISTINCT posting_id, p_name FROM lines WHERE {keep}),
gold_{name} AS (SELECT DISTINCT posting_id, p_name FROM lines WHERE l_linenumber > 1 OR l_discount > 0.02::DOUBLE),
per_{name} AS (
  SELECT g.posting_id, count(*) FILTER (WHERE g.p_name IS NOT NULL AND p.p_name IS NOT NULL) AS tp,
         count(*) FILTER (WHERE p.p_name IS NULL) AS fn,
         (SELECT 0) AS zero
  FROM gold_{name} g LEFT JOIN pred_{name} p ON p.posting_id = g.posting_id AND p.p_name = g.p_name GROUP BY g.posting_id),
sized_{name} AS (
  SELECT posting_id, tp, fn, coalesce(n, 0) - tp AS fp FROM per_{name}
  LEFT JOIN (SELECT posting_id, count(*) AS n FROM pred_{name} GROUP BY posting_id) USING (posting_id)),
macro_{name} AS (SELECT avg(p) AS p, avg(r) AS r, avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS f
  FROM (SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
               CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM sized_{name})),
micro_{name} AS (SELECT p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f
  FROM (SELECT sum(tp) / (sum(tp) + sum(fp)) AS p, sum(tp) / (sum(tp) + sum(fn)) AS r FROM sized_{name}))"""


GOLD_KEEP = "l_linenumber > 1 OR l_discount > 0.02D"
PRED_A = "l_discount <= 0.05D"
PRED_B = "l_tax <= 0.06D"
PRED_A_SQL, PRED_B_SQL = "l_discount <= 0.05::DOUBLE", "l_tax <= 0.06::DOUBLE"


def _prf_out(rel: str, prefix: str = "") -> str:
    names = {"p": "precision", "r": "recall", "f": "f1"}
    return ", ".join(f"CAST(printf('%.3f', {rel}.{c}) AS DOUBLE) AS {prefix}{n}" for c, n in names.items())


@query("h1_prf_macro", BASKET_SQL + "," + prf_sql(PRED_A_SQL, "a") + f" SELECT {_prf_out('macro_a')} FROM macro_a")
def h1(spark, sf):
    return V.prf_macro(_sets(spark, sf, GOLD_KEEP), _sets(spark, sf, PRED_A))


@query("h2_prf_micro", BASKET_SQL + "," + prf_sql(PRED_A_SQL, "a") + f" SELECT {_prf_out('micro_a')} FROM micro_a")
def h2(spark, sf):
    return V.prf_micro(_sets(spark, sf, GOLD_KEEP), _sets(spark, sf, PRED_A))


@query(
    "h3_ab_compare",
    BASKET_SQL + "," + prf_sql(PRED_A_SQL, "a") + "," + prf_sql(PRED_B_SQL, "b") + f""", both_rows AS (
      SELECT 'discount' AS extractor, {_prf_out('macro_a')}, {_prf_out('micro_a', 'micro_')} FROM macro_a, micro_a
      UNION ALL SELECT 'tax', {_prf_out('macro_b')}, {_prf_out('micro_b', 'micro_')} FROM macro_b, micro_b)
      SELECT *, f1 = (SELECT max(f1) FROM both_rows) AS is_winner,
             CAST(printf('%.3f', (SELECT max(f1) - min(f1) FROM both_rows)) AS DOUBLE) AS f1_margin FROM both_rows""",
)
def h3(spark, sf):
    preds = {"discount": _sets(spark, sf, PRED_A), "tax": _sets(spark, sf, PRED_B)}
    return V.ab_compare(_sets(spark, sf, GOLD_KEEP), preds)


CLASSES = ["positive", "neutral", "negative"]
BAND_SQL = "CASE WHEN {c} >= 0.03 THEN 'positive' WHEN {c} <= -0.02 THEN 'negative' ELSE 'neutral' END"
GOLD_SQL = BAND_SQL.format(c="(o_custkey % 11 / 100.0::DOUBLE - 0.05)")
LABELLED_SQL = f"""WITH labelled AS (SELECT o_orderkey AS id,
  {GOLD_SQL} AS gold, {BAND_SQL.format(c='(o_orderkey % 9 / 100.0::DOUBLE - 0.04)')} AS pred,
  CASE WHEN o_totalprice > 50000 THEN {GOLD_SQL} ELSE 'neutral' END AS pred2 FROM orders),
classes(ord, class) AS (VALUES (0, 'positive'), (1, 'neutral'), (2, 'negative'))"""


def _labelled(spark, sf):
    band = lambda c: sentiment_band(c, 0.03, -0.02)
    gold = band(F.col("o_custkey") % 11 / 100.0 - 0.05)
    return A.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        gold.alias("gold"),
        band(F.col("o_orderkey") % 9 / 100.0 - 0.04).alias("pred"),
        F.when(F.col("o_totalprice") > 50000, gold).otherwise("neutral").alias("pred2"),
    )


def per_class_sql(pred: str) -> str:
    return f"""(SELECT class, ord, n, tp + fn AS support, CAST(printf('%.3f', p) AS DOUBLE) AS precision,
      CAST(printf('%.3f', r) AS DOUBLE) AS recall,
      CAST(printf('%.3f', CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END) AS DOUBLE) AS f1
      FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
                      CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r
            FROM (SELECT class, ord, count(*) AS n, count(*) FILTER (WHERE gold = class AND {pred} = class) AS tp,
                         count(*) FILTER (WHERE gold <> class AND {pred} = class) AS fp,
                         count(*) FILTER (WHERE gold = class AND {pred} <> class) AS fn
                  FROM labelled CROSS JOIN classes GROUP BY class, ord)))"""


@query("h4_accuracy", LABELLED_SQL + " SELECT CAST(avg(CASE WHEN gold = pred THEN 1 ELSE 0 END) AS DECIMAL(18,6)) AS accuracy FROM labelled")
def h4(spark, sf):
    return V.accuracy(_labelled(spark, sf)).select(F.col("accuracy").cast("decimal(18,6)").alias("accuracy"))


@query(
    "h5_confusion",
    LABELLED_SQL + """ SELECT class AS gold, count(*) FILTER (WHERE pred = 'positive') AS positive,
      count(*) FILTER (WHERE pred = 'neutral') AS neutral, count(*) FILTER (WHERE pred = 'negative') AS negative
      FROM classes LEFT JOIN labelled ON gold = class GROUP BY class""",
)
def h5(spark, sf):
    return V.confusion(_labelled(spark, sf), CLASSES)


@query("h6_prf_per_class", LABELLED_SQL + f" SELECT class, precision, recall, f1, support FROM {per_class_sql('pred')}")
def h6(spark, sf):
    return V.prf_per_class(_labelled(spark, sf), CLASSES)


@query("h7_weighted_f1", LABELLED_SQL + f" SELECT CAST(printf('%.3f', sum(f1 * support / n)) AS DOUBLE) AS weighted_f1 FROM {per_class_sql('pred')}")
def h7(spark, sf):
    return V.weighted_f1(_labelled(spark, sf), CLASSES)


def _model_sql(model: str, pred: str) -> str:
    cells = ", ".join(
        f"max({s}) FILTER (WHERE class = '{c}') AS {c}_{s}" for c in CLASSES for s in ("precision", "recall", "f1")
    )
    return f"""SELECT '{model}' AS model,
      CAST((SELECT avg(CASE WHEN gold = {pred} THEN 1 ELSE 0 END) FROM labelled) AS DECIMAL(18,6)) AS accuracy,
      CAST(printf('%.3f', sum(f1 * support / n)) AS DOUBLE) AS weighted_f1, {cells} FROM {per_class_sql(pred)}"""


@query("h8_compare_models", LABELLED_SQL + _model_sql("tax", "pred") + " UNION ALL " + _model_sql("mixed", "pred2"))
def h8(spark, sf):
    rows = _labelled(spark, sf)
    preds = {"tax": rows.select("id", "pred"), "mixed": rows.select("id", F.col("pred2").alias("pred"))}
    out = V.compare_models(rows, preds, CLASSES)
    return out.withColumn("accuracy", F.col("accuracy").cast("decimal(18,6)"))
