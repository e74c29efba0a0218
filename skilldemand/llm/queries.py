"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skilldemand.llm.common import fold, read
from skilldemand.llm.coordinate_pruning import hard_negatives
from skilldemand.llm.deletion_variants import simhash_components
from skilldemand.llm.fixity import fixity_audit
from skilldemand.llm.interleave import interleaved_shards
from skilldemand.llm.jaccard import ngram_jaccard_components
from skilldemand.llm.lsa_vote import quality_scores
from skilldemand.llm.nnpu import nn_pu_scores
from skilldemand.llm.outliers import BASE, outlier_verdicts
from skilldemand.llm.phrases import phrase_collocations
from skilldemand.llm.ppm import ppm_scores
from skilldemand.llm.spaced_seeds import contaminated
from skilldemand.llm.temperature import temperature_mixture
from skilldemand.llm.url_trees import url_verdicts

URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
RECORDS_PER_FILE = 1_000


def op1_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 5) == 1
    scored = ppm_scores(read(spark, sf_dir, "documents"), ~held_out)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def replica_pair(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages as records of archive files, and a copy with damage that their ids decide."""
    file = F.concat(F.lit("part-"), (F.floor(F.col("page_id") / RECORDS_PER_FILE)).cast("string"))
    size = F.octet_length(F.coalesce("url", F.lit(""))) + F.octet_length(F.coalesce("html", F.lit(""))) + 200
    earlier = "over (partition by file order by page_id rows between unbounded preceding and 1 preceding)"
    records = pages.select("page_id", "url", "html", file.alias("file"), size.cast("long").alias("size"))
    records = records.withColumn("offset", F.expr(f"cast(coalesce(sum(size) {earlier}, 0) as long)")).drop("size")
    lot = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    damaged = records.where(lot != "01")
    damaged = damaged.withColumn("html", F.when(lot == "00", F.concat(F.col("html"), F.lit("\0"))).otherwise(F.col("html")))
    return records.where(lot != "02"), damaged


def op2_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = replica_pair(read(spark, sf_dir, "pages"))
    return fixity_audit(one, two, ["url", "html"]).select("file", "offset", "state")


OP2_SQL = """
WITH records AS (
  SELECT page_id, 'part-' || CAST(page_id // 1000 AS VARCHAR) AS file,
         octet_length(encode(coalesce(url, ''))) + octet_length(encode(coalesce(html, ''))) + 200 AS size,
         substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS lot
  FROM pages
), placed AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY file ORDER BY page_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM records
)
SELECT file, "offset", CASE lot WHEN '00' THEN 'changed' WHEN '01' THEN 'missing' ELSE 'extra' END AS state
FROM placed WHERE lot IN ('00', '01', '02')
"""


def op3_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    tiebreak = (F.col("size"), F.col("text_crc32"))
    return interleaved_shards(docs, 8, tiebreak=tiebreak).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 4) == 2
    labels = read(spark, sf_dir, "labels").where(~held_out)
    scored = nn_pu_scores(read(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(read(spark, sf_dir, "pages"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "score"
    )


def op6_lsa_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 3) == 1
    labels = read(spark, sf_dir, "labels").where(~held_out)
    scored = quality_scores(read(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlier_verdicts(read(spark, sf_dir, "documents")).select("doc_id", *BASE, "base_failed", "kept", "distance")


def op8_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(read(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
           WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * k >= 75 * (p.n + q.n - k)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id
FROM documents d JOIN reach ON reach.x = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
GROUP BY d.doc_id
"""


def op10_temperature_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temperature_mixture(read(spark, sf_dir, "documents")).select(
        "doc_id", "source", "n_tokens", "epoch", "block"
    )


def op11_deletion_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))


def op12_coordinate_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives(read(spark, sf_dir, "embeddings").withColumn("label", moved))


OP12_SQL = """
WITH taking AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM taking a JOIN taking b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_collocations(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), runs AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p
  FROM runs, range(1, 6) AS t(k) WHERE len(w) >= k
), counts AS (
  SELECT lang, p, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE len(p) = 1 GROUP BY lang
), candidates AS (
  SELECT * FROM counts WHERE len(p) >= 2 AND f >= 100
), held AS (
  SELECT lang, unnest([p[1:len(p) - s], p[1 + s:]]) AS p, f
  FROM candidates, range(1, 4) AS t(s) WHERE len(p) - s >= 2
  UNION ALL
  SELECT lang, p[2:len(p) - 1], f FROM candidates WHERE len(p) >= 4
  UNION ALL
  SELECT lang, unnest([p[2:3], p[3:4], p[2:4]]), f FROM candidates WHERE len(p) = 5
), kept AS (
  SELECT c.* FROM candidates c
  WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.lang = c.lang AND h.p = c.p AND 100 * h.f >= 100 * c.f)
), cuts AS (
  SELECT c.lang, c.p, c.f AS a, k, x.f AS l, y.f AS r, n,
         ((1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM kept c, range(1, 5) AS t(k), counts x, counts y, totals t2
  WHERE k < len(c.p) AND x.lang = c.lang AND x.p = c.p[1:k] AND y.lang = c.lang AND y.p = c.p[k + 1:] AND t2.lang = c.lang
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), ranked AS (
  SELECT *, array_to_string(p, ' ') AS phrase FROM lowest
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INTEGER AS rank, phrase, a, l, r, n, score
FROM ranked
QUALIFY rank <= 2000
"""


QUERIES = {
    "op1_ppm_scores": op1_ppm_scores,
    "op2_fixity_audit": op2_fixity_audit,
    "op3_interleaved_shards": op3_interleaved_shards,
    "op4_nnpu_toxicity": op4_nnpu_toxicity,
    "op5_url_trees": op5_url_trees,
    "op6_lsa_vote": op6_lsa_vote,
    "op7_robust_outliers": op7_robust_outliers,
    "op8_spaced_seeds": op8_spaced_seeds,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_temperature_mixture": op10_temperature_mixture,
    "op11_deletion_variants": op11_deletion_variants,
    "op12_coordinate_pruning": op12_coordinate_pruning,
    "op13_phrase_collocations": op13_phrase_collocations,
}
ORACLES = {
    "op2_fixity_audit": OP2_SQL,
    "op9_jaccard_join": OP9_SQL,
    "op12_coordinate_pruning": OP12_SQL,
    "op13_phrase_collocations": OP13_SQL,
}
