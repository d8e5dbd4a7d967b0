"""Blinded comparison scoring, intervals, gates, latency percentiles and model cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import lookup

# Blind salt, conditions, gate thresholds, latency target.
BLIND_SALT = "quality-v2"
CONDITIONS = ["baseline", "candidate"]
Z = 1.96
GATE = dict(reviewers=3, cases=40, score=0.6, lower=0.5, usefulness=4.0, worthwhile=8.0, errors=0)
TARGET_MS = 20_000

# Fixed values: (order, model name part, input, cached input and output price per million tokens).
RATES = [
    (1, "5.6-terra", 2.0, 0.2, 12.0),
    (2, "5.6-luna", 0.2, 0.02, 1.2),
    (3, "5.4-mini", 0.75, 0.075, 4.5),
    (4, "5.4", 2.5, 0.25, 15.0),
    (5, "4.1-mini", 0.4, 0.1, 1.6),
    (6, "", 0.15, 0.075, 0.6),
]
SEARCH_PRICE = 0.01
SEARCH_TOKENS = 8000


def blind_hash(case, repetition, condition) -> Column:
    parts = [F.lit(BLIND_SALT), case, F.col(repetition).cast("string") if isinstance(repetition, str) else repetition, condition]
    return F.sha2(F.concat_ws(":", *parts), 256)


def blind_order(comparisons: DataFrame) -> DataFrame:
    """comparisons(case_id, repetition) with the conditions shown as A and B."""
    hashes = {c: blind_hash("case_id", "repetition", F.lit(c)) for c in CONDITIONS}
    first = F.when(hashes["baseline"] <= hashes["candidate"], "baseline").otherwise("candidate")
    return comparisons.withColumn("a", first).withColumn(
        "b", F.when(F.col("a") == "baseline", "candidate").otherwise("baseline")
    )


def unblind(ratings: DataFrame, order: DataFrame) -> DataFrame:
    """ratings(comparison_id, reviewer_id, preferred in A, B, tie) with the condition each vote is for."""
    return ratings.join(order, "comparison_id").withColumn(
        "vote", F.when(F.col("preferred") == "A", F.col("a")).when(F.col("preferred") == "B", F.col("b")).otherwise("tie")
    )


def incomplete_ratings(ratings: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Reviewers who did not rate every comparison exactly once.

    Counting replaces the reviewer by comparison grid: a reviewer is complete when the rows, the
    distinct comparisons and the known comparisons all number the same.
    """
    known = ratings.join(comparisons.select("comparison_id").distinct(), "comparison_id", "left_semi")
    wanted = comparisons.select(F.count_distinct("comparison_id")).scalar()
    valid = known.groupBy("reviewer_id").agg(F.count_distinct("comparison_id").alias("known"))
    rows = ratings.groupBy("reviewer_id").agg(F.count("*").alias("rows"))
    return rows.join(valid, "reviewer_id", "left").where(
        (F.col("rows") != wanted) | (F.coalesce("known", F.lit(0)) != wanted)
    )


def pairwise_scores(votes: DataFrame) -> DataFrame:
    """Majority per comparison(comparison_id, case_id): 1, 0 or 0.5; a tie counts as a judgment."""
    counted = votes.groupBy("comparison_id", "case_id").agg(
        F.count_if(F.col("vote") == "candidate").alias("candidate_votes"),
        F.count_if(F.col("vote") == "baseline").alias("baseline_votes"),
        F.count_if(F.col("vote") == "tie").alias("ties"),
        F.count("*").alias("judgments"),
    )
    majority = F.floor(F.col("judgments") / 2) + 1
    return counted.withColumn(
        "score",
        F.when(F.col("candidate_votes") >= majority, 1.0).when(F.col("baseline_votes") >= majority, 0.0).otherwise(0.5),
    )


def case_scores(comparisons: DataFrame) -> DataFrame:
    return comparisons.groupBy("case_id").agg(F.avg("score").alias("score"), F.count("*").alias("comparisons"))


def wilson(successes, total, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the interval; fractional successes are allowed and no trials give [0, 1]."""
    s = F.col(successes) if isinstance(successes, str) else successes
    n = F.col(total) if isinstance(total, str) else total
    p = s / n
    spread = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / spread
    margin = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / spread
    return (
        F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - margin)),
        F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), centre + margin)),
    )


def listwise(lists: DataFrame, axes: list[str]) -> DataFrame:
    """Means per condition of lists(condition, <axes>, usefulness, verdicts, critical_errors)."""
    worthwhile = F.size(F.filter("verdicts", lambda v: v.isin("strong", "useful")))
    errors = F.size(F.filter("critical_errors", lambda e: e != ""))
    return lists.groupBy("condition").agg(
        *[F.avg(axis).alias(axis) for axis in axes],
        F.avg("usefulness").alias("usefulness"),
        F.avg(worthwhile).alias("worthwhile"),
        F.sum(errors).alias("critical_errors"),
    )


def quality_gate(summary: DataFrame) -> DataFrame:
    """summary(reviewers, cases, score, lower, usefulness, worthwhile, errors) with its status."""
    complete = (F.col("reviewers") >= GATE["reviewers"]) & (F.col("cases") >= GATE["cases"])
    good = (
        (F.col("score") >= GATE["score"])
        & (F.col("lower") > GATE["lower"])
        & (F.col("usefulness") >= GATE["usefulness"])
        & (F.col("worthwhile") >= GATE["worthwhile"])
        & (F.col("errors") == GATE["errors"])
    )
    return summary.withColumn("status", F.when(~complete, "incomplete").when(good, "pass").otherwise("fail"))


def nearest_rank(values: DataFrame, group: str, value: str, shares: dict[str, float | None]) -> DataFrame:
    """Nearest-rank percentiles per group: the value at position ceil(n * p), or n // 2 + 1 for None.

    Equal values are counted first and the counts accumulate in value order, so a crowded group costs
    its distinct values; latencies in whole milliseconds below the run limit are at most 65,000.
    """
    counted = values.groupBy(group, value).agg(F.count("*").alias("n"))
    running = W.partitionBy(group).orderBy(value)
    reached = counted.withColumn("upto", F.sum("n").over(running))
    totals = counted.groupBy(group).agg(F.sum("n").alias("total"))
    joined = reached.join(totals, group)

    def position(share: float | None) -> Column:
        return F.floor(F.col("total") / 2) + 1 if share is None else F.ceil(F.col("total") * share)

    return joined.groupBy(group).agg(
        *[
            F.min(F.when(F.col("upto") >= position(share), F.col(value))).alias(name)
            for name, share in shares.items()
        ]
    )


def run_summary(runs: DataFrame, group: str) -> DataFrame:
    """runs(group, ok, elapsed_ms): failures stay in the denominator, percentiles are of successes."""
    totals = runs.groupBy(group).agg(
        F.count("*").alias("attempts"),
        F.count_if("ok").alias("successes"),
        F.count_if(F.col("ok") & (F.col("elapsed_ms") <= TARGET_MS)).alias("within_target"),
    )
    ranks = nearest_rank(runs.where("ok"), group, "elapsed_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    return totals.join(ranks, group, "left").withColumns(
        {
            "success_rate": F.col("successes") / F.col("attempts"),
            "within_target_rate": F.col("within_target") / F.col("attempts"),
        }
    )


def _rate(model: Column, at: int) -> Column:
    choice = F
    for _, part, *rates in RATES[:-1]:
        choice = choice.when(F.contains(model, F.lit(part)), rates[at])
    return choice.otherwise(RATES[-1][2 + at])


def estimate_cost(usage: DataFrame) -> DataFrame:
    """usage(model, input_tokens, output_tokens, cached_tokens, search_calls) with the estimated price.

    The first name part found in the model decides the rates.
    """
    model = F.col("model")
    tokens = F.greatest(F.lit(0), F.coalesce("input_tokens", F.lit(0)))
    cached = F.least(tokens, F.greatest(F.lit(0), F.coalesce("cached_tokens", F.lit(0))))
    fixed = F.when(model.rlike("4(?:o|\\.1)-mini"), F.col("search_calls") * SEARCH_TOKENS).otherwise(0)
    searched = F.when(tokens < fixed, fixed).otherwise(0)
    output = F.greatest(F.lit(0), F.coalesce("output_tokens", F.lit(0)))
    price = (
        ((tokens - cached + searched) * _rate(model, 0) + cached * _rate(model, 1) + output * _rate(model, 2)) / 1_000_000
        + F.col("search_calls") * SEARCH_PRICE
    )
    return usage.withColumns({"search_tokens": searched, "cached_tokens": cached, "usd": price})


def usage_totals(costed: DataFrame, *by: str) -> DataFrame:
    """Sums per group; the model label joins the distinct models of the calls that used anything."""
    used = (F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)) + F.col("search_calls")) > 0
    return costed.groupBy(*by).agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cached_tokens").alias("cached_tokens"),
        F.sum("search_calls").alias("search_calls"),
        F.sum("usd").alias("usd"),
        F.array_join(F.sort_array(F.collect_set(F.when(used, F.col("model")))), " + ").alias("model"),
    )


def attribution_counts(rows: DataFrame, run: str, kind: str, kinds: list[str]) -> DataFrame:
    """One row per run with a zero-filled count per kind."""
    return rows.groupBy(run).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def best_observation(films: DataFrame, resolved: DataFrame) -> DataFrame:
    """The first observation of each request of which every film resolves.

    films(request_id, observation_id, rank, film_id), ordered by (rank, observation_id); resolved(film_id). An
    observation with a film that is null or not resolved never counts. Partial sums only, no list of a request's rows.
    """
    known = resolved.select("film_id").distinct().withColumn("_known", F.lit(True))
    whole = (
        lookup(films, known, ["film_id"], "left").groupBy("request_id", "observation_id")
        .agg(F.min("rank").alias("rank"), F.bool_and(F.coalesce("_known", F.lit(False))).alias("whole"))
    )
    first = F.min(F.struct("rank", "observation_id"))["observation_id"]
    return whole.where("whole").groupBy("request_id").agg(first.alias("observation_id"))
