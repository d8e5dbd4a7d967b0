"""Session reduction and history over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.sessions import history_context, reduce_sessions
from ..session import load
from .registry import query


def session_events(spark: SparkSession, folder: str) -> DataFrame:
    """Signups start a path, clicks and views commit the film `k`, purchases go back to step `k`, errors to the first."""
    k = F.get_json_object("props", "$.k")
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type").isin("click", "view"), "commit").otherwise("restore")
    return load(spark, folder, "events", "user_id", "event_id", "event_type", "props").select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("seq"),
        kind.alias("kind"),
        F.when(F.col("event_type") == "purchase", k.cast("bigint")).otherwise(0).alias("target"),
        F.array(k).alias("film_ids"),
        F.length("props").alias("size"),
    )


@query(
    "session_reduce",
    """WITH RECURSIVE s AS (SELECT user_id, max(event_id) FILTER (event_type = 'signup') AS start FROM events GROUP BY user_id),
      e AS (SELECT user_id, event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i
        FROM events JOIN s USING (user_id) WHERE start IS NULL OR event_id >= start),
      r(user_id, i, stack, pos, refused) AS (
        SELECT user_id, 0::BIGINT, []::BIGINT[], -1::BIGINT, 0::BIGINT FROM s
        UNION ALL
        SELECT r.user_id, e.i,
          CASE WHEN event_type IN ('signup', 'click', 'view') THEN list_slice(list_append(list_slice(stack, 1, pos + 1), event_id), greatest(1, pos + 2 - 63), pos + 2) ELSE stack END,
          CASE WHEN event_type IN ('signup', 'click', 'view') THEN least(pos + 1, 63)
            WHEN event_type = 'purchase' AND k < len(stack) THEN k WHEN event_type = 'error' AND len(stack) > 0 THEN 0 ELSE pos END,
          refused + CASE WHEN (event_type = 'purchase' AND k >= len(stack)) OR (event_type = 'error' AND len(stack) = 0) THEN 1 ELSE 0 END
        FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1),
      f AS (SELECT user_id, stack, pos, refused FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1),
      seen AS (SELECT user_id, count(DISTINCT k) FILTER (event_type IN ('signup', 'click', 'view')) AS seen FROM e GROUP BY user_id),
      live AS (SELECT user_id, count(DISTINCT k) AS live FROM (SELECT user_id, unnest(stack) AS event_id FROM f) JOIN e USING (user_id, event_id) GROUP BY user_id)
    SELECT user_id, array_to_string(stack, ',') AS snapshots, pos AS cursor, refused, coalesce(seen, 0) AS seen, coalesce(seen, 0) - coalesce(live, 0) AS archived, 'ok' AS status
    FROM f LEFT JOIN seen USING (user_id) LEFT JOIN live USING (user_id)""",
)
def session_reduce(spark: SparkSession, folder: str) -> DataFrame:
    out = reduce_sessions(session_events(spark, folder))
    return out.select(
        F.col("session_id").alias("user_id"), F.array_join("snapshots", ",").alias("snapshots"), F.col("cursor").cast("bigint").alias("cursor"), "refused", "seen", "archived", "status"
    )


@query(
    "history_context",
    """WITH e AS (SELECT user_id, event_id, event_type, json_extract_string(props, '$.k') AS film FROM events),
      f AS (SELECT user_id, film, arg_min(event_type, event_id) AS title FROM e WHERE event_type <> 'error' GROUP BY ALL),
      n AS (SELECT user_id, count(DISTINCT film) AS seen, count(DISTINCT film) FILTER (event_type <> 'error') AS discovered FROM e GROUP BY user_id)
    SELECT n.user_id, film, title, seen, discovered, seen <= 5000 AND discovered <= 768 AS within_limits FROM n LEFT JOIN f USING (user_id)""",
)
def history(spark: SparkSession, folder: str) -> DataFrame:
    """Films of a user with the event type that showed them first; errors are only archived ids."""
    events = load(spark, folder, "events", "user_id", "event_id", "event_type", "props").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), "event_type", F.get_json_object("props", "$.k").alias("film_id")
    )
    shown = events.where("event_type != 'error'").select(
        "session_id", "seq", "film_id", F.col("event_type").alias("title"), F.lit(2000).alias("year"), F.lit("").alias("director")
    )
    out = history_context(shown, events.where("event_type = 'error'").select("session_id", "film_id"))
    return out.select(F.col("session_id").alias("user_id"), F.col("film_id").alias("film"), "title", "seen", "discovered", "within_limits")
