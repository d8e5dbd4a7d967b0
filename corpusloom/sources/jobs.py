"""Collection jobs, discovery plans and manifests."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.collection import manifest

JOB = (
    "version int, id string, createdAt string, description string, targets array<struct<id:string,url:string,textUrl:string,"
    "sourceFamily:string,proposedType:string,language:string,titleHint:string,tags:array<string>,note:string>>"
)
PLAN = (
    "version int, id string, targetDocuments int, families array<struct<sourceFamily:string,seeds:array<string>,"
    "pageStart:int,pageEnd:int,includePathPrefixes:array<string>,quota:int,proposedType:string,tags:array<string>>>"
)
FAMILIES = (
    "version int, families array<struct<id:string,publisher:string,hosts:array<string>,allowedPathPrefixes:array<string>,"
    "defaultType:string,defaultLanguage:string,rights:struct<mode:string,licenseUrl:string,note:string>,paceMs:int,minimumTextChars:int>>"
)


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path).where("version = 1")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Targets of a job file in job order."""
    rows = _document(spark, path, JOB).select(F.col("id").alias("job_id"), F.posexplode("targets").alias("ordinal", "t"))
    return rows.select(
        "job_id", "ordinal", F.col("t.id").alias("target_id"), F.col("t.sourceFamily").alias("family_id"), "t.url",
        F.col("t.textUrl").alias("text_url"), F.col("t.proposedType").alias("proposed_type"), "t.language", "t.tags",
    )


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """Families of a discovery plan with their position."""
    rows = _document(spark, path, PLAN).select(F.posexplode("families").alias("position", "f"))
    return rows.select(
        "position", F.col("f.sourceFamily").alias("family_id"), "f.seeds", F.col("f.pageStart").alias("page_start"),
        F.col("f.pageEnd").alias("page_end"), F.col("f.includePathPrefixes").alias("include"), "f.quota",
    )


def read_families(spark: SparkSession, path: str) -> DataFrame:
    """The source registry, one row per family, as validate_families and plan_collection take it."""
    rows = _document(spark, path, FAMILIES).select(F.inline("families"))
    return rows.select(
        "id", F.col("id").alias("family_id"), "publisher", "hosts", F.col("allowedPathPrefixes").alias("prefixes"),
        F.col("defaultType").alias("type"), F.col("defaultLanguage").alias("language"), F.col("rights.note").alias("note"),
        F.col("paceMs").alias("pace_ms"), F.col("minimumTextChars").alias("min_chars"),
    )


def write_manifest(items: DataFrame, path: str) -> DataFrame:
    """Write the items to a new path and return the manifest row over what was written."""
    items.write.mode("errorifexists").parquet(os.path.join(path, "items"))
    return manifest(items.sparkSession.read.parquet(os.path.join(path, "items")))
