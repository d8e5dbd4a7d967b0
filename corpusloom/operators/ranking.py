"""Graph-edge recommendation, diversity re-ranking and exclusions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut, dealt, keyed, lookup

# Edge qualities, list length, sources per row, similarity shares and penalties.
DIRECT, GROUNDED, OTHER = 1.0, 0.78, 0.6
LIST = 12
MIN_SOURCES = 3
SAME_DIRECTOR, SAME_COUNTRY, SAME_DECADE, SHARED_GENRE = 0.45, 0.2, 0.15, 0.2
REDUNDANCY, SEEN = 0.22, 0.025


def context_weights(context: DataFrame) -> DataFrame:
    """Equal weights 1/n over the distinct films of context(request_id, film_id)."""
    films = context.select("request_id", "film_id").distinct()
    sizes = films.groupBy("request_id").agg(F.count("*").alias("n"))
    return films.join(sizes, "request_id").select("request_id", "film_id", (1 / F.col("n")).alias("weight"))


def edge_quality(relation) -> Column:
    value = F.col(relation) if isinstance(relation, str) else relation
    return (
        F.when(value == "direct_connection", DIRECT).when(value == "grounded_interpretation", GROUNDED).otherwise(OTHER)
    )


def edge_candidates(context: DataFrame, edges: DataFrame) -> DataFrame:
    """(request_id, candidate, score, connections) over undirected edges(a, b, relation)."""
    edges = cut(edges.select("a", "b", "relation"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "relation"))
    weights = context_weights(context)
    met = lookup(both.withColumnRenamed("a", "film_id"), weights, ["film_id"]).select(
        "request_id", F.col("b").alias("candidate"), (F.col("weight") * edge_quality("relation")).alias("worth")
    )
    # An edge mostly has one end in the context.
    scored = dealt(met, edges.count(), "request_id", "candidate").groupBy("request_id", "candidate").agg(
        F.round(F.sum("worth"), 9).alias("score"), F.count("*").alias("connections")
    )
    return lookup(scored, weights.select("request_id", F.col("film_id").alias("candidate")), ["request_id", "candidate"], "left_anti")


def top_candidates(candidates: DataFrame, keep: int = LIST) -> DataFrame:
    place = F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("score"), "candidate"))
    return candidates.withColumn("place", place).where(F.col("place") <= keep)


def topped_up(evidence, own) -> Column:
    """Evidence sources, completed to three from the film's own."""
    cited = F.array_distinct(evidence)
    spare = F.array_except(F.coalesce(own, F.array().cast("array<string>")), cited)
    return F.concat(cited, F.slice(spare, 1, F.greatest(F.lit(0), F.lit(MIN_SOURCES) - F.size(cited))))


def _alike(rows: pa.Table) -> np.ndarray:
    """Similarity of every two rows: shared director, country, decade and any genre."""

    def same(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
        return (codes[:, None] == codes[None, :]) & known[:, None] & known[None, :]

    out = np.zeros((rows.num_rows, rows.num_rows))
    for column, share in (("director", SAME_DIRECTOR), ("country", SAME_COUNTRY)):
        values = pc.fill_null(rows[column].combine_chunks().cast(pa.string()), "")
        codes = values.dictionary_encode().indices.to_numpy()
        out += share * same(codes, pc.not_equal(values, "").to_numpy(zero_copy_only=False))
    decades = rows["year"].to_numpy() // 10
    out += SAME_DECADE * same(decades, np.isfinite(decades))
    genres = rows["genres"].combine_chunks()
    owner, code = pc.list_parent_indices(genres).to_numpy(), pc.list_flatten(genres).dictionary_encode()
    holds = np.zeros((rows.num_rows, len(code.dictionary) + 1))
    holds[owner, code.indices.to_numpy()] = 1
    return out + SHARED_GENRE * (holds @ holds.T > 0)


def _rerank(group: pa.Table) -> pa.Table:
    """Positions one by one: each choice raises the redundancy of all rows at once."""
    rows = group.sort_by("candidate").combine_chunks()
    relevance = rows["relevance"].to_numpy()
    share = relevance / max(relevance.max(), 0.0001)
    seen = np.where(pc.fill_null(rows["seen"], False).to_numpy(), SEEN, 0.0)
    alike, near = _alike(rows), np.zeros(rows.num_rows)
    free, chosen = np.ones(rows.num_rows, dtype=bool), []
    for _ in range(min(LIST, rows.num_rows)):
        value = np.round(share * (1 - REDUNDANCY * near) - seen, 12)
        best = int(np.where(free, value, -np.inf).argmax())
        free[best] = False
        chosen.append(best)
        near = np.maximum(near, alike[best])
    picked = rows.select(["request_id", "candidate"]).take(pa.array(chosen))
    return picked.append_column("position", pa.array(np.arange(1, len(chosen) + 1, dtype=np.int32)))


def diversity_rerank(rows: DataFrame) -> DataFrame:
    """Greedy order of a short list: relevance less redundancy to what is chosen, less a seen penalty.

    rows(request_id, candidate, relevance, director, country, year, genres, seen) come from
    top_candidates, so a group has at most twelve of them.
    """
    kinds = dict(rows.dtypes)
    schema = f"request_id {kinds['request_id']}, candidate {kinds['candidate']}, position int"
    return keyed(rows, "request_id").groupBy("request_id").applyInArrow(_rerank, schema)


def excluded(intents: DataFrame, shown: DataFrame) -> DataFrame:
    """Films a request must not repeat: intents(request_id, intent), shown(request_id, kind, film_id).

    Selected films always; on `follow` and `manual` also the previous list; on `regenerate` also
    everything seen or discovered.
    """
    applies = (
        (F.col("kind") == "selected")
        | (F.col("intent").isin("follow", "manual") & (F.col("kind") == "previous"))
        | ((F.col("intent") == "regenerate") & F.col("kind").isin("previous", "seen", "discovered"))
    )
    distinct = shown.select("request_id", "kind", "film_id").distinct()
    return distinct.join(intents, "request_id").where(applies).select("request_id", "film_id").distinct()
