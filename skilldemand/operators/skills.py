"""Skills, phrases and named entities of posting texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skilldemand.functions.lookup import InlineTable, join_rows
from skilldemand.functions.text import explode_once, let, ngrams, strip
from skilldemand.operators.matching import match_terms

# Determiners cut from the front of a phrase.
DETERMINERS = ["a", "an", "the", "our", "your", "their", "its", "this", "that"]

# A phrase is kept if it contains one of these.
SEED_KEYWORDS = [
    "python", "sql", "spark", "kafka", "airflow", "pytorch", "tensorflow", "kubernetes",
    "docker", "aws", "gcp", "azure", "react", "fastapi", "postgresql", "redis", "mongodb",
    "dbt", "snowflake", "tableau", "pandas", "numpy", "scikit", "mlops", "terraform",
    "typescript", "graphql", "looker", "bigquery", "databricks", "linux", "go", "rust", "nlp",
    "bert", "transformers", "sagemaker", "redshift", "power bi", "devops", "agile", "scrum",
    "okr",
]

# Entity label to result field.
ENTITY_FIELDS = {"ORG": "orgs", "GPE": "locations", "LOC": "locations", "PRODUCT": "products"}


def vocab_terms(vocab: DataFrame) -> DataFrame:
    return vocab.select(F.col("skill").alias("term"), F.col("ord").cast("bigint").alias("ord"))


def match_vocab(
    postings: DataFrame,
    vocab: DataFrame,
    text_col: str = "raw_text",
    id_col: str = "posting_id",
    inline: bool = True,
) -> DataFrame:
    """(posting, skill, n): bounded occurrences of each vocabulary skill."""
    found = match_terms(
        postings.select(id_col, text_col), vocab_terms(vocab), text_col, inline=inline
    )
    return explode_once(found, "matches", "m", id_col).select(
        id_col, F.col("m.term").alias("skill"), F.col("m.n").alias("n")
    )


def match_chunks(
    postings: DataFrame,
    vocab: DataFrame,
    chunks_col: str | None = None,
    id_col: str = "posting_id",
    inline: bool = True,
    text_col: str = "raw_text",
) -> DataFrame:
    """(posting, skill, n=1) for each skill that equals one of the posting's phrases.

    Without a column of phrases, they are all runs of one to four words of the text.
    """
    if chunks_col is None:
        rows, chunks_col = postings.select(id_col, ngrams(F.col(text_col)).alias("_phrases")), "_phrases"
    else:
        rows = postings.select(id_col, chunks_col)
    found = _with_chunk_matches(rows, vocab, chunks_col, inline)
    return explode_once(found, "_chunk_matches", "m", id_col).select(
        id_col, F.col("m.term").alias("skill"), F.lit(1).cast("bigint").alias("n")
    )


def _with_chunk_matches(
    df: DataFrame, vocab: DataFrame, chunks_col: str, inline: bool
) -> DataFrame:
    keyed = vocab_terms(vocab).withColumn("key", F.lower("term"))
    chunks = F.array_distinct(F.transform(F.col(chunks_col), F.lower))
    if inline:
        return df.withColumn("_chunk_matches", InlineTable(keyed, "key").find(chunks))
    return join_rows(df, keyed, "key", chunks, F.to_json(chunks), "_chunk_matches")


def with_skills(
    df: DataFrame,
    vocab: DataFrame,
    text_col: str,
    id_col: str,
    chunks_col: str | None = None,
    min_count: int = 1,
    out: str = "skills",
    inline: bool = True,
) -> DataFrame:
    """Add the skills of a text as (skill, n), most frequent first, then vocabulary order."""
    found = match_terms(df, vocab_terms(vocab), text_col, "_matches", inline=inline)
    if chunks_col is None:
        counts = F.transform(
            F.col("_matches"),
            lambda m: F.struct(
                (-m["n"]).alias("neg"), F.lit(0).alias("late"), m["ord"].alias("ord"), m["term"].alias("skill")
            ),
        )
    else:
        found = _with_chunk_matches(found, vocab, chunks_col, inline)
        counts = _sum_matches(F.col("_matches"), F.col("_chunk_matches"))
    kept = F.filter(counts, lambda c: -c["neg"] >= min_count)
    ordered = F.transform(
        F.array_sort(kept), lambda c: F.struct(c["skill"].alias("skill"), (-c["neg"]).alias("n"))
    )
    return found.withColumn(out, ordered).drop("_matches", "_chunk_matches")


def _sum_matches(matches: Column, chunk_matches: Column) -> Column:
    """Add one for each chunk match; skills found only as a chunk sort after their equals."""

    def merged(by_text: Column, by_chunk: Column) -> Column:
        chunk_terms = F.transform(by_chunk, lambda c: c["term"])
        text_terms = F.transform(by_text, lambda m: m["term"])
        both = F.transform(
            by_text,
            lambda m: F.struct(
                (-(m["n"] + F.array_contains(chunk_terms, m["term"]).cast("bigint"))).alias("neg"),
                F.lit(0).alias("late"),
                m["ord"].alias("ord"),
                m["term"].alias("skill"),
            ),
        )
        only_chunk = F.transform(
            F.filter(by_chunk, lambda c: ~F.array_contains(text_terms, c["term"])),
            lambda c: F.struct(
                F.lit(-1).cast("bigint").alias("neg"),
                F.lit(1).alias("late"),
                c["ord"].alias("ord"),
                c["term"].alias("skill"),
            ),
        )
        return F.concat(both, only_chunk)

    no_chunks = F.array().cast("array<struct<term: string, ord: bigint, key: string>>")
    return let(
        F.struct(matches.alias("m"), F.coalesce(chunk_matches, no_chunks).alias("c")),
        lambda s: merged(s["m"], s["c"]),
    )


def extract_skills(
    postings: DataFrame,
    vocab: DataFrame,
    text_col: str = "raw_text",
    id_col: str = "posting_id",
    chunks_col: str | None = None,
    min_count: int = 1,
    inline: bool = True,
) -> DataFrame:
    """(posting, skills): array of (skill, n) for every posting, empty where none is found."""
    columns = [id_col, text_col] + ([chunks_col] if chunks_col else [])
    return with_skills(
        postings.select(*columns), vocab, text_col, id_col, chunks_col, min_count, inline=inline
    ).select(id_col, "skills")


def categorise(
    postings: DataFrame,
    vocab: DataFrame,
    skills_col: str = "skills_extracted",
    inline: bool = True,
) -> DataFrame:
    """Add ``technical`` and ``soft`` arrays; what is not a soft skill is technical."""
    soft = vocab.where(F.col("kind") == "soft").select(F.lower("skill").alias("key")).distinct()
    lowered = F.transform(F.col(skills_col), F.lower)
    keys = F.array_distinct(lowered)
    if inline:
        found = postings.withColumn("_soft", InlineTable(soft, "key").find(keys))
    else:
        found = join_rows(postings, soft, "key", keys, F.to_json(keys), "_soft")
    none = F.array().cast("array<struct<key: string>>")
    found = found.withColumn("_soft", F.transform(F.coalesce("_soft", none), lambda row: row["key"]))
    is_soft = lambda s: F.array_contains(F.col("_soft"), F.lower(s))
    return found.withColumns(
        {
            "technical": F.filter(F.col(skills_col), lambda s: ~is_soft(s)),
            "soft": F.filter(F.col(skills_col), is_soft),
        }
    ).drop("_soft")


def extract_entities(
    postings: DataFrame,
    gazetteer: DataFrame,
    text_col: str = "raw_text",
    id_col: str = "posting_id",
    inline: bool = True,
) -> DataFrame:
    """(posting, entities) from a table of (name, label); names match case-sensitively."""
    return with_entities(
        postings.select(id_col, text_col), gazetteer, text_col, id_col, inline=inline
    ).select(id_col, "entities")


def with_entities(
    df: DataFrame,
    gazetteer: DataFrame,
    text_col: str,
    id_col: str,
    out: str = "entities",
    inline: bool = True,
) -> DataFrame:
    terms = (
        gazetteer.select(strip(F.col("name")).alias("term"), entity_field(F.col("label")).alias("field"))
        .where("field is not null and term != ''")
        .distinct()
    )
    found = match_terms(
        df, terms, text_col, "_mentions", ignore_case=False, inline=inline
    )
    return found.withColumn(out, _entity_struct(F.col("_mentions"))).drop("_mentions")


def entity_field(label: Column) -> Column:
    field = F.lit(None).cast("string")
    for name, target in ENTITY_FIELDS.items():
        field = F.when(label == name, target).otherwise(field)
    return field


def _entity_struct(mentions: Column) -> Column:
    def names(field: str) -> Column:
        chosen = F.filter(mentions, lambda m: m["field"] == field)
        return F.array_sort(F.array_distinct(F.transform(chosen, lambda m: m["term"])))

    return F.struct(*[names(f).alias(f) for f in ("orgs", "locations", "products")])


def entities_from_mentions(
    postings: DataFrame, mentions: DataFrame, id_col: str = "posting_id"
) -> DataFrame:
    """(posting, entities) from ready mentions (posting, text, label), e.g. of a tagger."""
    kept = (
        mentions.select(
            id_col, strip(F.col("text")).alias("term"), entity_field(F.col("label")).alias("field")
        )
        .where("field is not null and term != ''")
        .distinct()
        .groupBy(id_col)
        .agg(F.collect_list(F.struct("term", "field")).alias("_mentions"))
    )
    empty = F.array().cast("array<struct<term: string, field: string>>")
    return postings.select(id_col).join(kept, id_col, "left").select(
        id_col, let(F.coalesce("_mentions", empty), _entity_struct).alias("entities")
    )


def no_entities() -> Column:
    empty = F.array().cast("array<string>")
    return F.struct(empty.alias("orgs"), empty.alias("locations"), empty.alias("products"))


def merge_tool_entities(entities: Column, skills: Column) -> Column:
    """Add the skills that start with a capital to the organisations."""
    tools = F.filter(skills, lambda s: s.rlike(r"^\p{IsUppercase}"))
    return entities.withField("orgs", F.array_sort(F.array_union(entities["orgs"], tools)))


def phrase_skills(chunks: Column, keywords: list[str] | None = None) -> Column:
    """Phrases that contain a keyword, lower-cased, without leading determiners, distinct."""
    wanted = F.array(*[F.lit(k) for k in (SEED_KEYWORDS if keywords is None else keywords)])
    lowered = F.transform(chunks, lambda c: strip(F.lower(c)))
    kept = F.filter(lowered, lambda c: F.exists(wanted, lambda k: F.contains(c, k)))
    spaced = F.transform(kept, lambda c: F.regexp_replace(c, r"(?U)\s+", " "))
    bare = F.transform(
        spaced, lambda c: F.regexp_replace(c, rf"^(?:(?:{'|'.join(DETERMINERS)})(?: |$))+", "")
    )
    return F.array_distinct(F.filter(bare, lambda c: c != ""))
