"""Immutable versions, current pointers, corpus statistics, digests and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schemas import RIGHTS, SOURCE_TYPES


def current_versions(imports: DataFrame, order: list[str]) -> DataFrame:
    """imports(source_id, version_id, ...): the version imported last per source."""
    return imports.groupBy("source_id").agg(F.max_by("version_id", F.struct(*order)).alias("current_version"))


def deactivate_missing(sources: DataFrame, active: DataFrame) -> DataFrame:
    """sources(source_id, current_version): the pointer is cleared where this build lacks the version."""
    kept = active.select(F.col("version_id").alias("current_version")).distinct().withColumn("kept", F.lit(True))
    return sources.join(kept, "current_version", "left").select(
        "source_id", F.when(F.col("kept"), F.col("current_version")).alias("current_version")
    )


def membership(left: DataFrame, right: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Every key of either side as `equal`, `changed`, `missing_left` or `missing_right`."""
    a = left.select(key, F.struct(*values).alias("a"))
    b = right.select(key, F.struct(*values).alias("b"))
    return a.join(b, key, "full").select(
        key,
        F.when(F.col("a").isNull(), "missing_left")
        .when(F.col("b").isNull(), "missing_right")
        .when(F.col("a").eqNullSafe(F.col("b")), "equal")
        .otherwise("changed")
        .alias("status"),
    )


def require_equal(left: DataFrame, right: DataFrame, key: str, values: list[str]) -> None:
    """Abort unless both sides hold the same keys with the same values."""
    wrong = membership(left, right, key, values).where("status != 'equal'")
    example = wrong.limit(1).collect()
    if example:
        raise ValueError(f"membership differs: {example[0].asDict()}")


def zero_filled(counts: DataFrame, column: str, options: list[str]) -> DataFrame:
    """counts(column, n) completed with a zero row for every option that does not occur."""
    spark = counts.sparkSession
    dim = spark.createDataFrame([(o,) for o in options], f"{column} string")
    return dim.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def corpus_stats(documents: DataFrame, passages: DataFrame, observations: DataFrame, links: DataFrame, films: DataFrame) -> DataFrame:
    """(measure, value, n): totals, then counts by type and by rights with zeros filled in."""

    def total(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), F.lit("").alias("value"), "n")

    def spread_over(column: str, options: list[str], name: str) -> DataFrame:
        counts = documents.groupBy(column).agg(F.count("*").alias("n"))
        return zero_filled(counts, column, options).select(F.lit(name).alias("measure"), F.col(column).alias("value"), "n")

    parts = [
        total(documents, "documents"),
        total(films.select("key").distinct(), "films"),
        total(passages, "passages"),
        total(observations, "observations"),
        total(links, "evidence_links"),
        spread_over("type", SOURCE_TYPES, "by_type"),
        spread_over("rights_mode", RIGHTS, "by_rights"),
    ]
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


def corpus_digest(ids: DataFrame, label: str = "") -> DataFrame:
    """One row, one digest of a set of ids, built as a tree of fixed depth.

    Ids are placed by the first six hex digits of their hash and every level folds 256 children, so no
    step sees more than its own children: at 10^11 ids a leaf still holds about 6,000 of them.
    """
    level = ids.select(F.col(ids.columns[0]).cast("string").alias("id")).distinct().select(
        F.substring(F.sha2("id", 256), 1, 6).alias("node"), F.col("id").alias("part")
    )
    for digits in (4, 2, 0):
        folded = level.groupBy("node").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("part")), "\n"), 256).alias("digest"))
        level = folded.select(F.substring("node", 1, digits).alias("node"), F.concat("node", F.lit(":"), "digest").alias("part"))
    root = level.agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return root.select(F.sha2(F.concat(F.lit(label + "\n"), F.array_join("parts", "\n")), 256).alias("digest"))


def foreign_key_errors(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    orphans = child.where(F.col(column).isNotNull()).join(
        parent.select(F.col(parent_column).alias(column)).distinct(), column, "left_anti"
    )
    return orphans.agg(F.count("*").alias("errors"))


def integrity_counts(tables: dict[str, DataFrame], keys: list[tuple[str, str, str, str]]) -> DataFrame:
    """(check, n): rows per table, then orphans per (child, column, parent, parent column)."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(f"rows:{name}").alias("check"), "n") for name, df in tables.items()]
    parts += [
        foreign_key_errors(tables[child], column, tables[parent], target).select(
            F.lit(f"orphans:{child}.{column}").alias("check"), F.col("errors").alias("n")
        )
        for child, column, parent, target in keys
    ]
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


def related_films(observations: DataFrame, participants: DataFrame, films: DataFrame, links: DataFrame, passages: DataFrame) -> DataFrame:
    """Observations with their first passage as the quote and their films in order.

    observations(observation_id, ...), participants(observation_id, key, ordinal), films(key, title, ...),
    links(observation_id, passage_id, ordinal), passages(passage_id, text, locator).
    """
    first = links.groupBy("observation_id").agg(F.min_by("passage_id", "ordinal").alias("passage_id"))
    quotes = first.join(passages, "passage_id").select("observation_id", "passage_id", "text", "locator")
    cast = (
        participants.join(films, "key")
        .groupBy("observation_id")
        .agg(F.sort_array(F.collect_list(F.struct("ordinal", "key", "title", "year", "director"))).alias("films"))
    )
    return observations.join(quotes, "observation_id").join(cast, "observation_id", "left")
