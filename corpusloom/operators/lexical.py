"""Inverse document frequency, rarest query terms and lexical scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut, join_back, keyed, lookup

# Query terms by document frequency, and hits of a request.
RAREST_TERMS = 80
LEXICAL_HITS = 8
# Postings that a request's first candidates come from; any number gives the same hits.
PROBE = 64


def postings(passages: DataFrame) -> DataFrame:
    """(passage_id, term) from passages(passage_id, terms) with distinct terms."""
    # A plain explode makes the optimizer add a size filter that computes the terms a second time, below
    # any repartitioning; the outer form does not.
    return passages.select("passage_id", F.explode_outer("terms").alias("term")).where("term IS NOT NULL")


def retrieval_idf(df, total):
    return F.log(1 + total / (1 + df))


def document_frequency(posting: DataFrame) -> DataFrame:
    return posting.groupBy("term").agg(F.count("*").alias("df"))


def _rarity():
    return F.row_number().over(W.partitionBy("request_id").orderBy("df", "term"))


def rarest_terms(terms: DataFrame, frequency: DataFrame, keep: int = RAREST_TERMS) -> DataFrame:
    """The `keep` corpus terms of lowest document frequency per request, ties by term."""
    return (
        join_back(terms, frequency, ["term"])
        .withColumn("term_rank", _rarity())
        .where(F.col("term_rank") <= keep)
    )


def forward_index(requests: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(request_id, term, id) of the requests' terms, and (passage_id, ids) of the passages that hold some of them."""
    asked = cut(requests.select("request_id", F.explode_outer("terms").alias("term")).where("term IS NOT NULL").distinct())
    known = cut(asked.select("term").distinct().withColumn("id", F.monotonically_increasing_id()))
    found = lookup(postings(passages), known, ["term"]).select("passage_id", "id")
    found = keyed(found, "passage_id").groupBy("passage_id").agg(F.collect_list("id").alias("ids"))
    return lookup(asked, known, ["term"]), cut(found)


def bounded_terms(asked: DataFrame, forward: DataFrame, total: int, rarest: int | None = None) -> DataFrame:
    """(request_id, term, id, df, idf) with what bounds a request's scores, from rare terms to common ones.

    `before` counts the postings of the rarer terms, `reach` is what a passage without any of those can still score,
    and `last` marks the most common term. `rarest` keeps so many terms a request.
    """
    frequency = forward.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df"))
    kept = join_back(asked, frequency, ["id"])
    if rarest is not None:
        kept = kept.withColumn("place", _rarity()).where(F.col("place") <= rarest).drop("place")
    by = W.partitionBy("request_id").orderBy("df", "term")
    rest = by.rowsBetween(W.currentRow, W.unboundedFollowing)
    return kept.withColumn("idf", retrieval_idf(F.col("df"), total)).withColumns({
        "before": F.coalesce(F.sum("df").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "reach": F.sum("idf").over(rest), "last": F.count("*").over(rest) == 1,
    })


def scored_pairs(terms: DataFrame, forward: DataFrame, weights: DataFrame, min_terms: int) -> DataFrame:
    """(request_id, passage_id, raw, matched) of the passages that hold one of terms(request_id, id).

    `terms` are a request's rarest so many, so a pair is made once: at the rarest term that both sides share.
    """
    rows = lookup(forward.select("passage_id", "ids", F.explode("ids").alias("id")), terms.select("request_id", "id"), ["id"])
    # An intersection keeps the order of its first side, from rare to common.
    shared = F.array_intersect("known", "ids")
    own = lookup(rows, weights, ["request_id"]).where((F.get(shared, F.lit(0)) == F.col("id")) & (F.size(shared) >= min_terms))
    raw = F.aggregate(shared, F.lit(0.0), lambda s, i: s + F.element_at("idfs", i))
    return own.select("request_id", "passage_id", F.round(raw, 6).alias("raw"), F.size(shared).cast("bigint").alias("matched"))


def term_weights(terms: DataFrame) -> DataFrame:
    """Per request its term ids from rare to common, and their idf."""
    ordered = F.sort_array(F.collect_list(F.struct("df", "term", "id", "idf")))
    return terms.groupBy("request_id").agg(ordered.alias("w")).select(
        "request_id", F.col("w.id").alias("known"), F.map_from_arrays("w.id", "w.idf").alias("idfs")
    )


def _best(scored: DataFrame, keep: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("raw"), "passage_id"))
    return scored.withColumn("hit_rank", rank).where(F.col("hit_rank") <= keep)


def essential_terms(terms: DataFrame, forward: DataFrame, weights: DataFrame, keep: int, min_terms: int, probe: int = PROBE) -> DataFrame:
    """Terms without any of which no passage reaches a request's `keep` best.

    The rarest terms, up to `probe` postings, give first candidates; the last of their `keep` best is a score that all
    of the final ones reach. A term is needed only if it and all commoner ones together reach it too.
    """
    first = _best(scored_pairs(terms.where(F.col("before") < probe), forward, weights, min_terms), keep)
    floor = first.groupBy("request_id").agg(F.min("raw").alias("floor"), F.count("*").alias("found")).where(F.col("found") >= keep)
    # Scores are rounded to six places.
    needed = F.col("floor").isNull() | (F.col("reach") >= F.col("floor") - 1e-5)
    # With two terms to match, the most common one brings no passage that the others do not.
    return join_back(terms, floor.select("request_id", "floor"), ["request_id"], "left").where(
        needed & (~F.col("last") if min_terms > 1 else F.lit(True))
    ).select("request_id", "id")


def lexical_hits(
    requests: DataFrame, passages: DataFrame, keep: int = LEXICAL_HITS, min_terms: int = 2, rarest: int | None = None, probe: int = PROBE
) -> DataFrame:
    """The best `keep` passages per request by summed idf of the shared terms, `min_terms` at least; score min(5, sum / 3).

    Exact, but common terms make no pairs where rarer ones already decide: only passages with an essential term are
    scored, over all terms they share with the request. `rarest` asks with so many of a request's rarest terms only.
    """
    asked, forward = forward_index(requests, passages)
    total = passages.select(F.count("*")).scalar()
    terms = cut(bounded_terms(asked, forward, total, rarest))
    weights = cut(term_weights(terms))
    essential = cut(essential_terms(terms, forward, weights, keep, min_terms, probe))
    return _best(scored_pairs(essential, forward, weights, min_terms), keep).withColumn(
        "score", F.round(F.least(F.lit(5.0), F.col("raw") / 3), 6)
    )
