"""The normalised version store, snapshots and neighbour artefacts on Parquet."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import text_hash, version_id
from ..functions.text import normalize_casefold
from ..session import cut

TABLES = (
    "sources versions entities aliases document_films passages observations participants evidence_links"
).split()

# Tables that versions share, with the columns that make a row known.
SHARED_KEYS = {
    "sources": ["source_id", "current_version"],
    "entities": ["key"],
    "aliases": ["key", "alias_type", "alias_normalized", "year", "director_normalized"],
}


def version_tables(records: DataFrame, resolved: DataFrame) -> dict[str, DataFrame]:
    """The nine tables of admitted records.

    records: record columns plus content_hash; resolved(source_key, key) maps source keys to entities.
    """
    base = records.withColumn("version_id", version_id("id", "content_hash"))
    versions = base.select(
        "version_id", F.col("id").alias("source_id"), "content_hash", "title", "author", "publisher", "type",
        "language", "publishedAt", "checkedAt", "access", F.col("rights.mode").alias("rights_mode"),
    )
    films = base.select("version_id", F.posexplode("films").alias("ordinal", "f")).select(
        "version_id", "ordinal", F.col("f.key").alias("source_key"), "f"
    )
    document_films = films.join(resolved, "source_key").select("version_id", "key", "source_key", "ordinal")
    keyed = films.join(resolved, "source_key")
    entities = keyed.groupBy("key").agg(
        F.min(F.struct("version_id", "ordinal", F.struct("f.title", "f.year", "f.director", "f.externalIds").alias("v"))).alias("m")
    ).select("key", "m.v.*")
    titles = keyed.select(
        "key", F.explode(F.concat(F.array("f.title"), F.col("f.aliases"))).alias("alias"), F.lit("title").alias("alias_type"), "f.year", "f.director"
    ).unionByName(
        keyed.select("key", F.col("source_key").alias("alias"), F.lit("record_key").alias("alias_type"), "f.year", "f.director")
    )
    aliases = (
        titles.withColumn("alias_normalized", normalize_casefold("alias"))
        .withColumn("director_normalized", normalize_casefold("director"))
        .groupBy("key", "alias_type", "alias_normalized", "year", "director_normalized")
        .agg(F.min("alias").alias("alias"))
    )
    passages = base.select("version_id", F.posexplode("passages").alias("ordinal", "p")).select(
        F.concat_ws("/", "version_id", "p.id").alias("passage_id"), "version_id", F.col("p.id").alias("local_id"),
        "ordinal", F.col("p.text").alias("text"), F.col("p.locator").alias("locator"), text_hash("p.text").alias("text_hash"),
    )
    each = base.select("version_id", F.explode("observations").alias("o")).withColumn(
        "observation_id", F.concat_ws("/", "version_id", "o.id")
    )
    observations = each.select(
        "observation_id", "version_id", F.col("o.id").alias("local_id"), "o.summary", "o.summaryKo", "o.boundary", "o.kind", "o.subjects"
    )
    cast = each.select("observation_id", F.posexplode("o.filmKeys").alias("ordinal", "source_key"))
    participants = (
        cast.join(resolved, "source_key").groupBy("observation_id", "key").agg(F.min("ordinal").alias("ordinal"))
    )
    links = each.select("observation_id", "version_id", F.posexplode("o.passageIds").alias("ordinal", "local")).select(
        "observation_id", F.concat_ws("/", "version_id", "local").alias("passage_id"), "ordinal"
    )
    sources = base.select(F.col("id").alias("source_id"), F.col("url").alias("canonical_url"), F.col("version_id").alias("current_version"))
    return dict(
        sources=sources, versions=versions, entities=entities, aliases=aliases, document_films=document_films,
        passages=passages, observations=observations, participants=participants, evidence_links=links,
    )


def read_table(spark: SparkSession, root: str, name: str, like: DataFrame) -> DataFrame:
    folder = os.path.join(root, name)
    exists = _exists(spark, folder)
    return spark.read.parquet(folder) if exists else spark.createDataFrame([], like.schema)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def append_versions(tables: dict[str, DataFrame], root: str) -> DataFrame:
    """Append rows of versions the store does not hold yet; versions are written last.

    Child tables are keyed by version, so a run that dies before the version rows are written is
    simply repeated; `read_store` keeps one copy of what it left. Returns the new version ids.
    """
    spark = tables["versions"].sparkSession
    known = read_table(spark, root, "versions", tables["versions"]).select("version_id")
    new = cut(tables["versions"].select("version_id").distinct().join(known, "version_id", "left_anti"))
    fresh = new.withColumnRenamed("version_id", "new_version")

    def of_new(df: DataFrame) -> DataFrame:
        owner = F.col("version_id") if "version_id" in df.columns else F.regexp_extract("observation_id", "^(.*)/[^/]*$", 1)
        return df.join(fresh, owner == F.col("new_version"), "left_semi")

    for name in ("document_films", "passages", "observations", "participants", "evidence_links"):
        of_new(tables[name]).write.mode("append").parquet(os.path.join(root, name))
    for name, keys in SHARED_KEYS.items():
        held = read_table(spark, root, name, tables[name]).select(*keys)
        tables[name].join(held, keys, "left_anti").write.mode("append").parquet(os.path.join(root, name))
    of_new(tables["versions"]).write.mode("append").parquet(os.path.join(root, "versions"))
    return new


def read_store(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The store's tables; repeated rows of an interrupted append count once."""
    out = {}
    for name in TABLES:
        df = spark.read.parquet(os.path.join(root, name))
        out[name] = df.distinct()
    return out


def write_snapshot(documents: DataFrame, root: str, version: str) -> bool:
    """Write `documents` below version=<version>; an existing version is left untouched."""
    path = os.path.join(root, f"version={version}")
    if _exists(documents.sparkSession, os.path.join(path, "_SUCCESS")):
        return False
    documents.repartitionByRange("version_id").sortWithinPartitions("version_id").write.mode("overwrite").parquet(path)
    return True


def write_neighbours(edges: DataFrame, root: str, corpus_version: str, model: str, dimensions: int) -> None:
    """Neighbour edges stamped with the corpus they were computed for."""
    path = os.path.join(root, f"corpus_version={corpus_version}")
    edges.withColumn("model", F.lit(model)).withColumn("dimensions", F.lit(dimensions)).write.mode("overwrite").parquet(path)


def read_neighbours(spark: SparkSession, root: str, corpus_version: str) -> DataFrame:
    """Edges of exactly this corpus; a graph of another corpus never connects it."""
    return spark.read.parquet(root).where(F.col("corpus_version") == corpus_version)
