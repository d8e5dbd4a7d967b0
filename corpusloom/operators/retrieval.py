"""Hit merging, neighbour expansion and budgeted context selection."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut, join_back, keyed

# Hit weights, graph floor and the context budget.
DIRECT_SCORE = 20.0
NEIGHBOUR_WEIGHT = 6.0
GRAPH_FLOOR = 0.48
PASSAGES, CHARACTERS, PER_DOCUMENT = 16, 15_000, 2
# Rows that a choice starts with; any number gives the same choice.
FIRST_POOL = 64


def expand_neighbours(direct: DataFrame, edges: DataFrame, floor: float = GRAPH_FLOOR) -> DataFrame:
    """Hits next to direct(request_id, passage_id, anchor), by edges(src, dst, score) of this corpus."""
    return (
        direct.join(edges.where(F.col("score") >= floor), F.col("passage_id") == F.col("src"))
        .select("request_id", F.col("dst").alias("passage_id"), (F.lit(NEIGHBOUR_WEIGHT) * F.col("score")).alias("score"), "anchor", F.lit(False).alias("direct"))
    )


def merge_hits(hits: DataFrame) -> DataFrame:
    """Per (request, passage): best score, anchors, direct anchors and role."""
    return hits.groupBy("request_id", "passage_id").agg(
        F.max("score").alias("score"),
        F.sort_array(F.collect_set("anchor")).alias("anchors"),
        F.sort_array(F.collect_set(F.when(F.col("direct"), F.col("anchor")))).alias("direct_anchors"),
        F.bool_or("direct").alias("direct"),
    )


def rank_value():
    return F.col("score") + F.log1p(F.size("anchors"))


def ranked_hits(merged: DataFrame) -> DataFrame:
    """Merged hits with their rank value, and the anchors whose best direct hit each is (`guaranteed`)."""
    ranked = merged.withColumn("value", F.round(rank_value(), 9))
    order = F.struct((-F.col("value")).alias("v"), "passage_id")
    first = (
        ranked.select("request_id", "passage_id", "value", F.explode("direct_anchors").alias("anchor"))
        .groupBy("request_id", "anchor").agg(F.min(order)["passage_id"].alias("passage_id"))
        .groupBy("request_id", "passage_id").agg(F.sort_array(F.collect_list("anchor")).alias("guaranteed"))
    )
    return join_back(ranked, first, ["request_id", "passage_id"], "left")


def _greedy(frame: pd.DataFrame) -> pd.DataFrame:
    """The choice from one request's pool, and whether no row outside it could have come first at any step."""
    rows = frame.sort_values(["value", "passage_id"], ascending=[False, True], ignore_index=True)
    value, size = rows["value"].to_numpy(np.float64), rows["size"].to_numpy(np.int64)
    doc, whole = pd.factorize(rows["doc_id"])[0], not rows["cut"].any()
    names = {a: i for i, a in enumerate(sorted({a for some in rows["anchors"] for a in some}))}
    held = np.zeros((len(rows), len(names)), dtype=bool)
    for i, some in enumerate(rows["anchors"]):
        held[i, [names[a] for a in some]] = True
    # What is outside the pool is worth no more than the least of the ranked rows inside, whatever was chosen.
    outside = -np.inf if whole else value[rows["place"].notna().to_numpy()].min()
    near, same, used, chosen, sure = np.zeros(len(rows)), np.zeros(len(rows)), 0, [], True

    def fits() -> np.ndarray:
        free = (same < PER_DOCUMENT) & (used + size <= CHARACTERS)
        free[chosen] = False
        return free

    def take(at: int) -> None:
        nonlocal near, same, used
        chosen.append(at)
        near = near + (held & held[at]).any(axis=1)
        same = same + (doc == doc[at])
        used += int(size[at])

    promised = sorted((anchor, at) for at, some in enumerate(rows["guaranteed"]) if some is not None for anchor in some)
    for _, at in promised:
        if len(chosen) < PASSAGES and fits()[at]:
            take(at)
    while len(chosen) < PASSAGES:
        marginal = np.where(fits(), value / (1 + near * 0.45 + same * 2), -np.inf)
        best = float(marginal.max())
        sure &= whole or best > outside
        if best == -np.inf or not sure:
            break
        take(min(np.flatnonzero(marginal == best).tolist(), key=lambda i: rows["passage_id"][i]))
    picked = rows.loc[chosen, ["request_id", "passage_id", "doc_id", "score", "size"]].assign(position=range(1, len(chosen) + 1))
    return picked.assign(sure=True) if sure else rows.loc[:0, ["request_id", "passage_id", "doc_id", "score", "size"]].assign(position=0, sure=False)


def select_context(hits: DataFrame, first: int = FIRST_POOL) -> DataFrame:
    """Greedy choice under the budget, per request, over ranked_hits rows with (doc_id, size); exact over all hits.

    A request starts with its `first` best rows and the guaranteed ones. A row is worth at most its value, so a choice
    that beats the least value in the pool beats all that is outside; a request where one does not is asked again with
    eight times as many rows. What does not fit the budget never fits later and is passed over.
    """
    kinds = dict(hits.dtypes)
    schema = (
        f"request_id {kinds['request_id']}, passage_id {kinds['passage_id']}, doc_id {kinds['doc_id']}, "
        f"score double, size {kinds['size']}, position int, sure boolean"
    )
    rows = hits.select("request_id", "passage_id", "doc_id", "score", "value", "anchors", "guaranteed", "size")
    done, most = [], first
    while True:
        place = F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("value"), "passage_id"))
        best = rows.withColumn("place", place).where(F.col("place") <= most + 1).withColumn("cut", F.col("place") > most)
        # The row after the pool's last only says that there are more.
        promised = rows.where("guaranteed IS NOT NULL").join(best.where("NOT cut").select("request_id", "passage_id"), ["request_id", "passage_id"], "left_anti")
        more = F.max("cut").over(W.partitionBy("request_id"))
        pool = best.unionByName(promised.withColumns({"place": F.lit(None).cast("int"), "cut": F.lit(False)})).withColumn("more", more)
        pool = pool.where("NOT cut").drop("cut").withColumnRenamed("more", "cut")
        chosen = cut(keyed(pool, "request_id").groupBy("request_id").applyInPandas(_greedy, schema))
        done.append(chosen.where("sure").drop("sure"))
        again = chosen.where("NOT sure").select("request_id").distinct()
        if again.isEmpty():
            break
        rows, most = join_back(rows, again, ["request_id"], "left_semi"), most * 8
    return reduce(DataFrame.unionByName, done)


def context_coverage(selected: DataFrame, passages: DataFrame) -> DataFrame:
    """Passages per selected(request_id, film_id), zero included; passages(request_id, film_ids)."""
    counts = (
        passages.select("request_id", F.explode(F.array_distinct("film_ids")).alias("film_id"))
        .groupBy("request_id", "film_id")
        .agg(F.count("*").alias("n"))
    )
    return selected.join(counts, ["request_id", "film_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
