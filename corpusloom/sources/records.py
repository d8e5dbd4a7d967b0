"""Record files, identity registries and page caches as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import record_hash
from ..operators.elements import elements, file_parts, numbered
from ..schemas import RECORD, REGISTRY
from ..session import cut, lookup


def read_records(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Files of JSON arrays as (file, idx, raw, parsed fields, content_hash, parse_error).

    A file that is no JSON array gives one row with `parse_error`; the other files go on. Large files are read
    by many tasks; an element is what a task has to hold.
    """
    items, verdicts = elements(file_parts(spark, path, glob), keep=False)
    read = cut(items.select("group", "part", "idx", F.try_parse_json(F.trim("item", F.lit(" \t\r\n"))).alias("json")))
    broken = read.groupBy("group").agg(F.bool_or(F.col("json").isNull()).alias("broken"))
    judged = verdicts.join(broken, "group", "left").select("group", (~F.col("is_array") | F.coalesce("broken", F.lit(False))).alias("parse_error"))
    good = lookup(numbered(read, "idx_in_file", dense=True), judged.where("NOT parse_error"), ["group"])
    rows = good.select(F.col("group").alias("file"), F.col("idx_in_file").cast("int").alias("idx"), F.to_json("json").alias("raw"), "parse_error")
    bad = judged.where("parse_error").select(F.col("group").alias("file"), F.lit(0).alias("idx"), F.lit(None).cast("string").alias("raw"), "parse_error")
    # JSON null is no record.
    raw = rows.where("raw != 'null'").unionByName(bad)
    return raw.withColumn("r", F.from_json("raw", RECORD)).select(
        "file", "idx", "raw", "parse_error", record_hash("raw").alias("content_hash"), "r.*"
    )


def write_records(raw: DataFrame, path: str) -> None:
    """raw(raw) as files of JSON arrays below a new path, one per partition, an element a line."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            out = []
            for value in batch.column(0).to_pylist():
                out.append(lead + value)
                lead = ","
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": ["]" if lead == "," else "[]"]})

    raw.select("raw").where("raw IS NOT NULL").mapInArrow(lines, "value string").write.mode("errorifexists").text(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A versioned identity registry as one row per entity."""
    body = spark.read.schema(REGISTRY).option("multiLine", True).json(path)
    return body.where("version = 1").select(F.inline("films"))


def registry_rows(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """entities(key, title, year, director, externalIds) with aliases(key, alias, alias_type) folded in."""
    named = aliases.groupBy("key").agg(
        F.sort_array(F.collect_set(F.when(F.col("alias_type") == "title", F.col("alias")))).alias("titles"),
        F.sort_array(F.collect_set(F.when(F.col("alias_type") == "record_key", F.col("alias")))).alias("sourceKeys"),
    )
    return entities.join(named, "key", "left").select(
        "key",
        "title",
        "year",
        "director",
        F.array_except(F.coalesce("titles", F.array().cast("array<string>")), F.array("title")).alias("aliases"),
        "externalIds",
        F.coalesce("sourceKeys", F.array().cast("array<string>")).alias("sourceKeys"),
    )


def write_registry(rows: DataFrame, path: str) -> None:
    """One JSON line per entity in key order, to a path that must be new."""
    rows.repartitionByRange("key").sortWithinPartitions("key").write.mode("errorifexists").json(path)


def read_registry_rows(spark: SparkSession, path: str) -> DataFrame:
    schema = "key string, title string, year int, director string, aliases array<string>, externalIds array<struct<provider:string,id:string>>, sourceKeys array<string>"
    return spark.read.schema(schema).json(path)


EXTRACTOR_VERSION = 3
CACHE_DAYS = 7


def usable_pages(cache: DataFrame, now) -> DataFrame:
    """Cached page texts of the current extractor whose hash verifies and that are under seven days old."""
    return cache.where(
        (F.col("extractor_version") == EXTRACTOR_VERSION)
        & (F.col("status") == "readable")
        & (F.col("text") != "")
        & (F.sha2("text", 256) == F.col("text_hash"))
        & (F.col("checked_at") > F.lit(now) - F.expr(f"interval {CACHE_DAYS} days"))
    )


def normalise_external_ids(films: DataFrame) -> DataFrame:
    """films(key, externalIds array<variant>): plain texts and {provider,id} objects as `provider:id`.

    The provider `wikidata` is written `wd`.
    """
    ref = F.explode("externalIds")
    rows = films.select("key", ref.alias("v"))
    provider = F.try_variant_get("v", "$.provider", "string")
    prefixed = F.concat_ws(":", F.when(provider == "wikidata", "wd").otherwise(provider), F.try_variant_get("v", "$.id", "string"))
    return rows.select("key", F.when(provider.isNotNull(), prefixed).otherwise(F.try_variant_get("v", "$", "string")).alias("ref"))
