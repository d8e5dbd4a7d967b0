"""Substring search over folded entity texts, many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import search_norm
from .containment import containment

RESULTS = 6


def search_entities(queries: DataFrame, entities: DataFrame, limit: int = RESULTS) -> DataFrame:
    """First `limit` entities, in id order, whose text contains the folded query.

    queries(query), entities(entity_id, text) with folded texts. Equal texts are first reduced to their
    `limit` smallest ids, which is all a query can show of them. An empty query shows the first ones.
    """
    best = F.row_number().over(W.partitionBy("text").orderBy("entity_id"))
    reduced = entities.withColumn("nth", best).where(F.col("nth") <= limit)
    asked = queries.select("query", search_norm("query").alias("needle"))
    needles = asked.where("needle != ''").select(F.col("needle").alias("needle_id"), "needle").distinct()
    hay = reduced.select(F.col("text").alias("hay_id"), F.col("text").alias("hay")).distinct()
    hits = containment(needles, hay).join(reduced.withColumnRenamed("text", "hay_id"), "hay_id").select("needle_id", "entity_id")
    everything = entities.select("entity_id").orderBy("entity_id").limit(limit)
    first = everything.agg(F.sort_array(F.collect_list("entity_id"))).scalar()
    blank = asked.where("needle = ''").select("query", F.explode(first).alias("entity_id"))
    matched = asked.join(hits, F.col("needle") == F.col("needle_id")).select("query", "entity_id")
    place = F.row_number().over(W.partitionBy("query").orderBy("entity_id"))
    return matched.unionByName(blank).withColumn("place", place).where(F.col("place") <= limit)
