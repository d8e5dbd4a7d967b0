"""Evaluation, cost and contract queries over events, labels, conversations, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import word_list
from ..operators.contract import pick, slot_verdicts, withdraw_evidence
from ..operators.evaluation import (
    attribution_counts, blind_order, case_scores, estimate_cost, listwise, pairwise_scores, quality_gate, run_summary,
    unblind, usage_totals, wilson,
)
from ..operators.ranking import excluded
from ..session import join_back, load
from .registry import query


@query(
    "run_summary",
    """WITH r AS (SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) < 90 AS ok, CAST(round(value * 100) AS INTEGER) AS ms FROM events)
    SELECT event_type, count(*) AS attempts, count(*) FILTER (ok) AS successes, count(*) FILTER (ok AND ms <= 20000) AS within_target,
      CAST(quantile_disc(ms, 0.5) FILTER (ok) AS BIGINT) AS p50_ms, CAST(quantile_disc(ms, 0.95) FILTER (ok) AS BIGINT) AS p95_ms,
      round(count(*) FILTER (ok) / count(*), 6) AS success_rate, round(count(*) FILTER (ok AND ms <= 20000) / count(*), 6) AS within_target_rate
    FROM r GROUP BY event_type""",
)
def summary(spark: SparkSession, folder: str) -> DataFrame:
    """Each event is a run: `k` below 90 succeeds, a hundredth of its value is a millisecond."""
    runs = load(spark, folder, "events", "event_type", "value", "props").select(
        "event_type",
        (F.get_json_object("props", "$.k").cast("int") < 90).alias("ok"),
        F.round(F.col("value") * 100).cast("bigint").alias("elapsed_ms"),
    )
    out = run_summary(runs, "event_type")
    return out.withColumns({c: F.round(c, 6) for c in ("success_rate", "within_target_rate")})


def _wilson_sql(s: str, n: str) -> str:
    z = 1.96
    centre = f"({s} / {n} + {z * z} / (2 * {n})) / (1 + {z * z} / {n})"
    margin = f"({z} * sqrt(({s} / {n} * (1 - {s} / {n}) + {z * z} / (4 * {n})) / {n})) / (1 + {z * z} / {n})"
    return f"round(greatest(0, {centre} - {margin}), 6) AS low, round(least(1, {centre} + {margin}), 6) AS high"


@query(
    "wilson_by_source",
    f"""WITH s AS (SELECT source, CAST(sum(quality) AS DOUBLE) AS good, CAST(count(*) AS DOUBLE) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source)
    SELECT source, CAST(n AS BIGINT) AS labelled, {_wilson_sql('good', 'n')} FROM s""",
)
def wilson_by_source(spark: SparkSession, folder: str) -> DataFrame:
    rated = load(spark, folder, "documents", "doc_id", "source").join(load(spark, folder, "labels", "doc_id", "quality"), "doc_id")
    counts = rated.groupBy("source").agg(F.sum("quality").alias("good"), F.count("*").alias("n"))
    low, high = wilson("good", "n")
    return counts.select("source", F.col("n").alias("labelled"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_VOTES = """
  c AS (SELECT doc_id, source, quality, toxic, n_chars, sha256('quality-v2:' || source || ':' || doc_id || ':baseline') <= sha256('quality-v2:' || source || ':' || doc_id || ':candidate') AS base_first
    FROM documents JOIN labels USING (doc_id)),
  v AS (SELECT doc_id, source, base_first, CASE WHEN quality = 1 THEN 'A' ELSE 'B' END AS p FROM c
    UNION ALL SELECT doc_id, source, base_first, CASE WHEN toxic = 0 THEN 'A' ELSE 'tie' END FROM c
    UNION ALL SELECT doc_id, source, base_first, CASE WHEN n_chars > 1000 THEN 'A' ELSE 'B' END FROM c),
  w AS (SELECT doc_id, source, CASE WHEN p = 'tie' THEN 'tie' WHEN (p = 'A') = base_first THEN 'baseline' ELSE 'candidate' END AS vote FROM v),
  s AS (SELECT doc_id, source, CASE WHEN count(*) FILTER (vote = 'candidate') >= 2 THEN 1.0 WHEN count(*) FILTER (vote = 'baseline') >= 2 THEN 0.0 ELSE 0.5 END AS score FROM w GROUP BY ALL)"""


def case_table(spark: SparkSession, folder: str, case) -> DataFrame:
    """Labelled documents as comparisons of their case, judged by three reviewers."""
    rated = load(spark, folder, "documents", "doc_id", "source", "lang", "n_chars").join(load(spark, folder, "labels"), "doc_id")
    order = blind_order(rated.select(case.alias("case_id"), F.col("doc_id").alias("repetition"), F.col("doc_id").alias("comparison_id")))
    preferred = F.array(
        F.when(F.col("quality") == 1, "A").otherwise("B"),
        F.when(F.col("toxic") == 0, "A").otherwise("tie"),
        F.when(F.col("n_chars") > 1000, "A").otherwise("B"),
    )
    ratings = rated.select(F.col("doc_id").alias("comparison_id"), F.posexplode(preferred).alias("reviewer_id", "preferred"))
    return case_scores(pairwise_scores(unblind(ratings, order)))


@query("pairwise_majority", f"WITH {_VOTES} SELECT source AS case_id, round(avg(score), 6) AS score, count(*) AS comparisons FROM s GROUP BY source")
def pairwise_majority(spark: SparkSession, folder: str) -> DataFrame:
    return case_table(spark, folder, F.col("source")).withColumn("score", F.round("score", 6))


@query(
    "quality_gate",
    f"""WITH {_VOTES.replace("doc_id, source, quality", "doc_id, source || '/' || lang AS source, quality").replace("source || ':' || doc_id", "source || '/' || lang || ':' || doc_id")}, k AS (SELECT source, avg(score) AS score FROM s GROUP BY source),
      t AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(score) AS good, avg(score) AS mean FROM k),
      b AS (SELECT n, mean, {_wilson_sql('good', 'n')} FROM t),
      l AS (SELECT avg(1 + 4 * quality) AS usefulness, avg(CASE WHEN n_chars > 1000 THEN 12 ELSE 6 END) AS worthwhile, sum(toxic) AS errors FROM documents JOIN labels USING (doc_id))
    SELECT CAST(n AS BIGINT) AS cases, round(mean, 6) AS score, low AS lower_bound, round(usefulness, 6) AS usefulness, round(worthwhile, 6) AS worthwhile,
      CAST(errors AS BIGINT) AS errors, CASE WHEN n < 40 THEN 'incomplete' WHEN mean >= 0.6 AND low > 0.5 AND usefulness >= 4 AND worthwhile >= 8 AND errors = 0 THEN 'pass' ELSE 'fail' END AS status FROM b, l""",
)
def gate(spark: SparkSession, folder: str) -> DataFrame:
    """Sources and languages as cases, three reviewers, the labels as list ratings."""
    low, _ = wilson("good", "cases")
    rated = load(spark, folder, "documents", "doc_id", "n_chars").join(load(spark, folder, "labels"), "doc_id")
    lists = rated.select(
        F.lit("candidate").alias("condition"),
        (1 + 4 * F.col("quality")).cast("double").alias("usefulness"),
        F.array_repeat(F.lit("useful"), F.when(F.col("n_chars") > 1000, 12).otherwise(6)).alias("verdicts"),
        F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("critical_errors"),
    )
    measured = listwise(lists, []).agg(F.first(F.struct("usefulness", "worthwhile", "critical_errors"))).scalar()
    cases = (
        case_table(spark, folder, F.concat_ws("/", "source", "lang"))
        .agg(F.count("*").alias("cases"), F.sum("score").alias("good"), F.avg("score").alias("score"))
        .withColumn("m", measured)
        .select(
            F.lit(3).alias("reviewers"), "cases", "score", F.round(low, 6).alias("lower"),
            "m.usefulness", "m.worthwhile", F.col("m.critical_errors").alias("errors"),
        )
    )
    judged = quality_gate(cases)
    return judged.select(
        "cases", F.round("score", 6).alias("score"), F.col("lower").alias("lower_bound"),
        F.round("usefulness", 6).alias("usefulness"), F.round("worthwhile", 6).alias("worthwhile"), "errors", "status",
    )


@query(
    "cost_rollup",
    """WITH u AS (SELECT conv_id, CASE WHEN turn = 0 THEN 'gpt-5.6-terra' WHEN role = 'assistant' THEN 'gpt-5.4-mini' WHEN role = 'system' THEN 'gpt-4.1-mini' ELSE 'gpt-5.4' END AS model,
        CASE WHEN role <> 'assistant' THEN length(text) ELSE 0 END AS i, CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS o,
        CASE WHEN role <> 'assistant' THEN CAST(floor(length(text) / 2) AS BIGINT) ELSE 0 END AS c, CASE WHEN role = 'system' THEN 1 ELSE 0 END AS s FROM conversations),
      r AS (SELECT *, CASE WHEN model = 'gpt-4.1-mini' AND i < s * 8000 THEN s * 8000 ELSE 0 END AS extra,
        CASE model WHEN 'gpt-5.6-terra' THEN 2.0::DOUBLE WHEN 'gpt-5.4-mini' THEN 0.75::DOUBLE WHEN 'gpt-5.4' THEN 2.5::DOUBLE ELSE 0.4::DOUBLE END AS ir,
        CASE model WHEN 'gpt-5.6-terra' THEN 0.2::DOUBLE WHEN 'gpt-5.4-mini' THEN 0.075::DOUBLE WHEN 'gpt-5.4' THEN 0.25::DOUBLE ELSE 0.1::DOUBLE END AS cr,
        CASE model WHEN 'gpt-5.6-terra' THEN 12.0::DOUBLE WHEN 'gpt-5.4-mini' THEN 4.5::DOUBLE WHEN 'gpt-5.4' THEN 15.0::DOUBLE ELSE 1.6::DOUBLE END AS orr FROM u)
    SELECT conv_id, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(c) AS BIGINT) AS cached_tokens, CAST(sum(s) AS BIGINT) AS search_calls,
      round(sum(((i - c + extra) * ir + c * cr + o * orr) / 1000000 + s * 0.01::DOUBLE), 6) AS usd,
      coalesce(string_agg(DISTINCT model, ' + ' ORDER BY model) FILTER (i + o + s > 0), '') AS model FROM r GROUP BY conv_id""",
)
def cost_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as model calls; characters stand for tokens and half of a prompt is cached."""
    length = F.length("text").cast("bigint")
    zero = F.lit(0).cast("bigint")
    assistant = F.col("role") == "assistant"
    calls = load(spark, folder, "conversations").select(
        "conv_id",
        F.when(F.col("turn") == 0, "gpt-5.6-terra").when(assistant, "gpt-5.4-mini").when(F.col("role") == "system", "gpt-4.1-mini").otherwise("gpt-5.4").alias("model"),
        F.when(~assistant, length).otherwise(zero).alias("input_tokens"),
        F.when(assistant, length).otherwise(zero).alias("output_tokens"),
        F.when(~assistant, F.floor(length / 2)).otherwise(zero).alias("cached_tokens"),
        F.when(F.col("role") == "system", 1).otherwise(0).cast("bigint").alias("search_calls"),
    )
    return usage_totals(estimate_cost(calls), "conv_id").withColumn("usd", F.round("usd", 6))


@query(
    "attribution_pivot",
    """SELECT source, count(*) FILTER (quality = 1 AND toxic = 0) AS source_explicit, count(*) FILTER (quality = 0 AND toxic = 0) AS source_supported_interpretation,
      count(*) FILTER (toxic = 1) AS model_proposal FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
)
def attribution_pivot(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "documents", "doc_id", "source").join(load(spark, folder, "labels"), "doc_id", "left")
    kind = F.when(F.col("toxic") == 1, "model_proposal").when(F.col("quality") == 1, "source_explicit").when(F.col("quality") == 0, "source_supported_interpretation")
    return attribution_counts(rows.withColumn("kind", kind), "source", "kind", ["source_explicit", "source_supported_interpretation", "model_proposal"])


@query(
    "slot_verdicts",
    """WITH x AS (SELECT l_orderkey AS o, l_linenumber AS slot, l_partkey AS part, CASE WHEN l_quantity >= 49 THEN NULL ELSE l_suppkey END AS film, l_returnflag FROM lineitem),
      b AS (SELECT DISTINCT o, film FROM x WHERE l_returnflag = 'R' AND film IS NOT NULL),
      m AS (SELECT x.*, b.film IS NOT NULL AS banned FROM x LEFT JOIN b ON b.o = x.o AND b.film = x.film),
      f AS (SELECT *, min(slot) FILTER (film IS NOT NULL AND NOT banned) OVER (PARTITION BY o, film) AS first FROM m)
    SELECT o AS order_id, CASE WHEN film IS NULL THEN 'unresolved' WHEN banned THEN 'excluded' WHEN slot = first THEN 'accepted' ELSE 'duplicate' END AS verdict, count(*) AS slots, CAST(sum(part) AS BIGINT) AS parts
    FROM f GROUP BY ALL""",
)
def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as slots: films are suppliers, large quantities unresolved, returned ones excluded."""
    film = F.when(F.col("l_quantity") < 49, F.col("l_suppkey"))
    lines = load(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag").select(
        F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("slot"), F.col("l_partkey").alias("part"), film.alias("film_id"), "l_returnflag"
    )
    returned = lines.where("l_returnflag = 'R' AND film_id IS NOT NULL").select("request_id", "film_id")
    judged = slot_verdicts(lines, returned)
    return judged.groupBy(F.col("request_id").alias("order_id"), "verdict").agg(F.count("*").alias("slots"), F.sum("part").alias("parts"))


@query(
    "best_choice",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_returnflag FROM lineitem WHERE l_returnflag <> 'R'),
      n AS (SELECT l_orderkey, l_partkey, count(*) AS uses FROM x GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, l_partkey FROM x JOIN n USING (l_orderkey, l_partkey)
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY uses, l_discount DESC, l_returnflag, l_linenumber, l_partkey) = 1""",
)
def best_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Per order the line with the rarest part, the highest discount, then the flag; by one minimum."""
    lines = load(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_returnflag").where("l_returnflag != 'R'")
    uses = lines.groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("uses"))
    order = F.struct("uses", (-F.col("l_discount")).alias("d"), "l_returnflag", "l_linenumber", "l_partkey")
    best = join_back(lines, uses, ["l_orderkey", "l_partkey"]).groupBy("l_orderkey").agg(F.min(order).alias("b"))
    return best.select("l_orderkey", "b.l_linenumber", "b.l_partkey")


@query(
    "index_choice",
    """WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS ws FROM documents),
      p AS (SELECT doc_id, list_filter(list_transform(ws, lambda w: ws[length(w) + 1]), lambda x: x IS NOT NULL) AS p FROM w)
    SELECT doc_id, CAST(len(p) AS BIGINT) AS found, sha256(array_to_string(p, ' ')) AS picked_sha FROM p""",
)
def index_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Word lengths as positions into the document's own words; positions past the end are dropped."""
    words = load(spark, folder, "documents", "doc_id", "text").select("doc_id", word_list("text").alias("ws"))
    chosen = words.select("doc_id", pick("ws", F.transform("ws", lambda w: F.length(w))).alias("p"))
    return chosen.select("doc_id", F.size("p").cast("bigint").alias("found"), F.sha2(F.array_join("p", " "), 256).alias("picked_sha"))


@query(
    "withdraw_evidence",
    """WITH l AS (SELECT l_orderkey AS o, l_partkey AS film, l_suppkey AS anchor, CASE l_linestatus WHEN 'O' THEN 'direct_connection' ELSE 'curatorial_association' END AS relation, l_returnflag <> 'R' AS ok FROM lineitem),
      f AS (SELECT o, film, bool_or(NOT ok) AS withdrew FROM l GROUP BY ALL),
      p AS (SELECT o, film, anchor, relation, bool_or(ok) AS sourced FROM l GROUP BY ALL)
    SELECT CASE WHEN NOT sourced THEN 'ai_inference' WHEN (o_orderstatus = 'F' OR withdrew) AND relation = 'direct_connection' THEN 'grounded_interpretation' ELSE relation END AS relation,
      o_orderpriority, count(*) AS connections FROM p JOIN f USING (o, film) JOIN orders ON o_orderkey = o GROUP BY ALL""",
)
def withdrawn(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as connections; returned lines lost their source, finished orders are historical."""
    orders = load(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    lines = load(spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag")
    links = lines.select(
        F.col("l_orderkey").alias("snapshot_id"),
        F.col("l_partkey").alias("film_id"),
        F.col("l_suppkey").alias("anchor_id"),
        F.when(F.col("l_linestatus") == "O", "direct_connection").otherwise("curatorial_association").alias("relation"),
        F.col("l_returnflag").alias("source_id"),
    )
    eligible = lines.select(F.col("l_returnflag").alias("source_id")).distinct().where("source_id != 'R'")
    snapshots = orders.select(F.col("o_orderkey").alias("snapshot_id"), (F.col("o_orderstatus") == "F").alias("historical"), "o_orderpriority")
    return withdraw_evidence(snapshots, links, eligible).groupBy("relation", "o_orderpriority").agg(F.count("*").alias("connections"))


@query(
    "exclusion_by_intent",
    """WITH e AS (SELECT user_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS film, ts, event_id FROM events),
      i AS (SELECT user_id, CASE arg_max(event_type, {'t': ts, 'e': event_id}) WHEN 'click' THEN 'follow' WHEN 'view' THEN 'manual' WHEN 'purchase' THEN 'regenerate' ELSE 'initial' END AS intent FROM e GROUP BY user_id)
    SELECT DISTINCT user_id, film FROM e JOIN i USING (user_id) WHERE event_type = 'purchase' OR (intent IN ('follow', 'manual') AND event_type = 'click')
      OR (intent = 'regenerate' AND event_type IN ('click', 'view', 'signup'))""",
)
def exclusion_by_intent(spark: SparkSession, folder: str) -> DataFrame:
    """Per user what the last event's intent excludes: purchases are selected, clicks the previous list."""
    events = load(spark, folder, "events", "user_id", "event_type", "ts", "event_id", "props").withColumnRenamed("user_id", "request_id")
    last = events.groupBy("request_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("t"))
    t = F.col("t")
    intents = last.select("request_id", F.when(t == "click", "follow").when(t == "view", "manual").when(t == "purchase", "regenerate").otherwise("initial").alias("intent"))
    e = F.col("event_type")
    kind = F.when(e == "purchase", "selected").when(e == "click", "previous").when(e == "view", "seen").when(e == "signup", "discovered")
    shown = events.select("request_id", kind.alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("film_id")).where("kind IS NOT NULL")
    return excluded(intents, shown).withColumnsRenamed({"request_id": "user_id", "film_id": "film"})
