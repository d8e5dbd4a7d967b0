"""Vector neighbours and hashed features over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.features import BUCKET_SEED, FNV_PRIME, SIGN_SEED
from ..operators.retrieval import DIRECT_SCORE, expand_neighbours, merge_hits
from ..operators.vectors import BAND_BITS, BANDS, DIMENSIONS, hashed_tfidf, nearest_neighbours, pending_vectors, planes, valid_vector
from ..session import cut, load
from .registry import query

# Random 64-dimensional vectors rarely reach the production floor of 0.48.
LOW_FLOOR = 0.3


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


_KNN = f"""
  v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  p AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id),
  k AS (SELECT src, dst, round(s, 6) AS score, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS place FROM p WHERE s >= {LOW_FLOOR} QUALIFY place <= 10)"""


@query("cosine_knn", f"WITH {_KNN} SELECT src, dst, score, place FROM k")
def cosine_knn(spark: SparkSession, folder: str) -> DataFrame:
    """The exact neighbour build, at every size."""
    edges = nearest_neighbours(vectors(spark, folder), floor=LOW_FLOOR, method="exact")
    return edges.withColumn("place", F.col("place").cast("bigint"))


_WIDTH = 64
_PLANES = ", ".join(
    f"({band}, {bit}, [{', '.join(repr(float(x)) for x in planes(_WIDTH)[band * BAND_BITS + bit])}]::DOUBLE[])"
    for band in range(BANDS)
    for bit in range(BAND_BITS)
)


@query(
    "lsh_knn",
    f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      pl AS (SELECT * FROM (VALUES {_PLANES}) AS t(band, bit, normal)),
      sig AS (SELECT vec_id, band, sum(CASE WHEN list_dot_product(e, normal) >= 0 THEN 1 << bit ELSE 0 END)::INTEGER AS bits FROM v, pl GROUP BY ALL),
      c AS (SELECT DISTINCT a.vec_id AS src, b.vec_id AS dst FROM sig a JOIN sig b ON a.band = b.band AND a.vec_id <> b.vec_id AND bit_count(xor(a.bits, b.bits)) <= 1),
      s AS (SELECT src, dst, list_cosine_similarity(x.e, y.e) AS s FROM c JOIN v x ON x.vec_id = src JOIN v y ON y.vec_id = dst)
    SELECT src, dst, round(s, 6) AS score, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS place FROM s WHERE s >= {LOW_FLOOR} QUALIFY place <= 10""",
)
def lsh_knn(spark: SparkSession, folder: str) -> DataFrame:
    edges = nearest_neighbours(vectors(spark, folder), floor=LOW_FLOOR, method="buckets")
    return edges.withColumn("place", F.col("place").cast("bigint"))


@query(
    "neighbor_expansion",
    f"""WITH {_KNN}, h AS (
      SELECT label, vec_id, 20.0 AS score, TRUE AS direct FROM v
      UNION ALL SELECT label, dst, 6 * score, FALSE FROM v JOIN k ON vec_id = src)
    SELECT label, vec_id, round(max(score), 6) AS score, bool_or(direct) AS direct FROM h GROUP BY label, vec_id""",
)
def neighbor_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """Each label as a film whose vectors are its direct hits, with their graph neighbours around them."""
    edges = cut(nearest_neighbours(vectors(spark, folder), floor=LOW_FLOOR, method="exact"))
    direct = load(spark, folder, "embeddings", "label", "vec_id").select(
        F.col("label").alias("request_id"), F.col("vec_id").alias("passage_id"), F.col("label").alias("anchor")
    )
    hits = direct.withColumns({"score": F.lit(DIRECT_SCORE), "direct": F.lit(True)}).unionByName(
        expand_neighbours(direct, edges, LOW_FLOOR)
    )
    return merge_hits(hits).select(
        F.col("request_id").alias("label"),
        F.col("passage_id").alias("vec_id"),
        F.round("score", 6).alias("score"),
        "direct",
    )


@query(
    "valid_pending_vectors",
    """WITH w AS (SELECT vec_id, label, sha256('embedding:64:' || vec_id) AS input_hash,
        len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS valid FROM embeddings)
    SELECT input_hash, valid FROM w WHERE input_hash NOT IN (SELECT input_hash FROM w WHERE label < 5)""",
)
def valid_pending_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of the lower labels are cached already; the rest is pending and checked."""
    table = load(spark, folder, "embeddings").withColumn(
        "input_hash", F.sha2(F.concat(F.lit("embedding:64:"), F.col("vec_id").cast("string")), 256)
    )
    cached = table.where("label < 5").select("input_hash")
    return pending_vectors(table, cached).select("input_hash", valid_vector("embedding", 64).alias("valid"))


def _fnv_sql(seed: int) -> str:
    return (
        f"list_reduce(list_prepend({seed}::BIGINT, list_transform(string_split(f, ''), lambda c: unicode(c)::BIGINT)), "
        f"lambda h, c: (xor(h, c) * {FNV_PRIME}) % 4294967296)"
    )


@query(
    "hashed_tfidf",
    f"""WITH l AS (SELECT doc_id, lower(text) AS t FROM documents),
      w AS (SELECT doc_id, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+') AS ws, regexp_replace(t, '\\s+', ' ', 'g') AS c FROM l),
      x AS (SELECT doc_id, unnest(list_transform(ws, lambda a: 'w:' || a)) AS f FROM w
        UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: 'b:' || ws[i] || '_' || ws[i + 1])) FROM w
        UNION ALL SELECT doc_id, unnest(list_transform(range(1, greatest(length(c) - 1, 1)), lambda i: 'c:' || substr(c, i, 3))) FROM w),
      tf AS (SELECT doc_id, f, count(*) AS tf FROM x GROUP BY ALL),
      d AS (SELECT f, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf,
        {_fnv_sql(BUCKET_SEED)} % {DIMENSIONS} AS bucket, CASE WHEN {_fnv_sql(SIGN_SEED)} % 2 = 1 THEN 1 ELSE -1 END AS sign FROM tf GROUP BY f)
    SELECT doc_id, CAST(bucket AS BIGINT) AS bucket, round(sum(sign * (1 + ln(tf)) * idf), 4) AS weight FROM tf JOIN d USING (f) GROUP BY ALL""",
)
def hashed_features(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents", "doc_id", "text").withColumnRenamed("doc_id", "id")
    return hashed_tfidf(docs).select(
        F.col("id").alias("doc_id"), F.col("bucket").cast("bigint").alias("bucket"), (F.round("weight", 4) + 0.0).alias("weight")
    )
