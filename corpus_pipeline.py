"""A pipeline over `documents`: quality rules, toxicity, near-duplicates, repeated substrings, packing.

Defined results of every stage: null and empty texts are documents without words (quality rejects them), repeated
rows are documents of their own, null ids stay, extra columns pass through under any name, an empty table gives an
empty one; very long texts are read whole, and only packing changes the columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import near, packing, quality, substring, toxicity
from corpusloom.session import load, scratch_path, ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the weak supervision accept."""
    ship(spark)
    return quality.accepted(docs)


def _apart(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The documents with columns under names that clash with no operator's, and `text` beside them; and those names."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)), F.col("text")), names


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below a half; the labels of `sf_dir` and the texts of this stage's input teach it."""
    model = toxicity.fit(docs.select("doc_id", "text"), load(spark, sf_dir, "labels", "doc_id", "toxic"))
    held, names = _apart(docs)
    kept = toxicity.score(held, model, *names).where("score < 0.5")
    return kept.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    ship(spark)
    return near.one_of_each(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that repeated windows cover; a text that loses none stays as it is."""
    ship(spark)
    held, names = _apart(docs)
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return substring.dedupe(held, *names, "text").select(
        *(F.when(changed, new[c]).otherwise(F.col(n)).alias(c) if c in new else F.col(n).alias(c) for c, n in zip(docs.columns, names))
    )


# Encoded units that packing leaves in a worker: the next run's stages need the memory.
KEPT_UNITS = 20_000


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length: ids as an array, with the bucket that batches are drawn from."""
    ship(spark)
    return packing.pack(docs, kept=KEPT_UNITS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

# Boosted trees have no SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again as the next one's documents."""
    docs = load(spark, sf_dir, "documents", *COLUMNS)
    for _, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage")
        done = stage(spark, docs, sf_dir)
        schema = done.schema
        done.write.parquet(path)
        docs = spark.read.schema(schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
