"""Record files and vector caches, written from the given tables and read back in splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import load, scratch_path
from ..sources.model_io import UNKNOWN_TIME, read_vector_cache, write_vector_cache
from ..sources.records import read_records, write_records
from .registry import query


@query(
    "record_files",
    """SELECT CAST(doc_id AS VARCHAR) AS id, source AS publisher, lang AS language, sha256(coalesce(text, '')) AS text_sha,
      coalesce(CAST(length(text) AS BIGINT), 0) AS chars FROM documents""",
)
def record_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as records with one passage, in files of JSON arrays."""
    docs = load(spark, folder, "documents", "doc_id", "text", "lang", "source")
    passage = F.struct(F.lit("p1").alias("id"), "text", F.lit("body").alias("locator"))
    record = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("publisher"), F.col("lang").alias("language"), F.array(passage).alias("passages"))
    path = scratch_path(spark, "records")
    write_records(docs.select(F.to_json(record).alias("raw")), path)
    text = F.coalesce(F.col("passages")[0]["text"], F.lit(""))
    return read_records(spark, path, "*.txt").where("NOT parse_error").select(
        "id", "publisher", "language", F.sha2(text, 256).alias("text_sha"), F.length(text).cast("bigint").alias("chars")
    )


@query(
    "vector_cache",
    f"""SELECT CAST(vec_id AS VARCHAR) AS input_hash, CAST(64 AS INTEGER) AS dimensions, CAST(len(embedding) AS BIGINT) AS entries, CAST(embedding[1] AS DOUBLE) AS first,
      CAST(embedding[-1] AS DOUBLE) AS last, CASE WHEN vec_id % 3 = 0 THEN '{UNKNOWN_TIME}' ELSE 'label ' || label END AS generated_at FROM embeddings WHERE embedding IS NOT NULL""",
)
def vector_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors in cache files; the time of every third is unknown."""
    table = load(spark, folder, "embeddings", "vec_id", "embedding", "label")
    at = F.when(F.col("vec_id") % 3 != 0, F.concat(F.lit("label "), F.col("label").cast("string")))
    path = scratch_path(spark, "vectors")
    vectors = table.select(F.col("vec_id").cast("string").alias("input_hash"), F.col("embedding").cast("array<double>").alias("vector"), at.alias("generated_at"))
    write_vector_cache(vectors, path, "m", 64)
    vector = F.col("vector")
    return read_vector_cache(spark, path, "*.txt").select(
        "input_hash", "dimensions", F.size(vector).cast("bigint").alias("entries"), F.get(vector, F.lit(0)).alias("first"),
        F.try_element_at(vector, F.lit(-1)).alias("last"), "generated_at",
    )
