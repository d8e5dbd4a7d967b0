"""All-or-nothing publication of a validated batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.urls import published_url


def record_urls(records: DataFrame) -> DataFrame:
    """Source and text URLs of records(id, url[, text_url])."""
    columns = ["url"] + (["text_url"] if "text_url" in records.columns else [])
    listed = records.select("id", F.explode(F.array_compact(F.array(*columns))).alias("url"))
    return listed.where(F.col("url") != "")


def published_urls(records: DataFrame) -> DataFrame:
    return record_urls(records).select("url").distinct()


def repeated_urls(batch: DataFrame, published: DataFrame) -> DataFrame:
    """Batch URLs that are published already or occur more than once in the batch."""
    known = published.select(published_url("url").alias("url")).distinct().withColumn("known", F.lit(True))
    counted = record_urls(batch).select(published_url("url").alias("url")).groupBy("url").agg(F.count("*").alias("rows"))
    return (
        counted.join(known, "url", "left")
        .where(F.col("known") | (F.col("rows") > 1))
        .select("url", F.when(F.col("known"), "published").otherwise("repeated").alias("reason"), "rows")
    )


def repeated_ids(batch: DataFrame, existing: DataFrame) -> DataFrame:
    known = existing.select("id").distinct().withColumn("known", F.lit(True))
    counted = batch.groupBy("id").agg(F.count("*").alias("rows"))
    return (
        counted.join(known, "id", "left")
        .where(F.col("known") | (F.col("rows") > 1))
        .select("id", F.when(F.col("known"), "published").otherwise("repeated").alias("reason"), "rows")
    )


def publication_violations(batch: DataFrame, existing: DataFrame, report: DataFrame) -> DataFrame:
    """Every reason against publishing batch(id, url[, text_url], errors); empty means publish.

    report(status, published_candidates, requested) must be validated and count the batch exactly.
    """
    rows = batch.agg(F.count("*")).scalar()
    counts = report.where(
        (F.col("status") != "validated")
        | (F.col("published_candidates") != rows)
        | (F.col("requested") != rows)
        | (rows == 0)
    )
    parts = [
        counts.select(F.lit("report").alias("rule"), F.lit(None).cast("string").alias("subject")),
        batch.where(F.size("errors") > 0).select(F.lit("admission").alias("rule"), F.col("id").alias("subject")),
        repeated_ids(batch, existing).select(F.concat(F.lit("id_"), "reason").alias("rule"), F.col("id").alias("subject")),
        repeated_urls(batch, published_urls(existing)).select(F.concat(F.lit("url_"), "reason").alias("rule"), F.col("url").alias("subject")),
    ]
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


def publish(batch: DataFrame, existing: DataFrame, report: DataFrame, path: str) -> DataFrame:
    """Write the batch to a new path when nothing speaks against it; return the violations."""
    violations = publication_violations(batch, existing, report)
    if violations.isEmpty():
        batch.write.mode("errorifexists").parquet(path)
    return violations
