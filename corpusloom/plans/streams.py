"""Streams over the events and documents tables, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import version_id
from ..operators.sessions import MAX_SEEN
from ..streaming.flows import ingest, latency_windows, latest_progress, orphans, seen_films, share_requests
from ..streaming.runner import event_time, file_stream
from .registry import query


def events(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    return event_time(file_stream(spark, folder, "events", files))


def _utc(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


@query(
    "stream_ingest",
    """SELECT doc_id || '@' || sha256(text) AS version_id, CASE WHEN length(trim(text, chr(10) || ' ')) < 80 THEN 'quarantined' ELSE 'completed' END AS status FROM documents""",
)
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    def judge(batch: DataFrame) -> DataFrame:
        short = F.length(F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))) < 80
        return batch.select(
            version_id(F.col("doc_id").cast("string"), F.sha2("text", 256)).alias("version_id"),
            F.when(short, "quarantined").otherwise("completed").alias("status"),
        )

    return ingest(file_stream(spark, folder, "documents"), judge)


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour FROM events")
def stream_dedupe(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """A user's requests of one kind share their work within the hour."""
    keyed = events(spark, folder, files).select("ts", "user_id", "event_type", F.date_trunc("hour", "ts").alias("h"))
    shared = share_requests(keyed, ["user_id", "event_type", "h"], "1 hour")
    return shared.select("user_id", "event_type", _utc("h").alias("hour"))


@query(
    "stream_latency",
    """WITH r AS (SELECT event_type, date_trunc('day', ts) AS d, CAST(json_extract(props, '$.k') AS INTEGER) < 90 AS ok, CAST(round(value * 100) AS BIGINT) AS ms FROM events)
    SELECT strftime(d, '%Y-%m-%d %H:%M:%S') AS started, event_type, count(*) AS attempts, count(*) FILTER (ok) AS successes, count(*) FILTER (ok AND ms <= 20000) AS within_target,
      quantile_disc(ms, 0.5) FILTER (ok) AS p50_ms, quantile_disc(ms, 0.95) FILTER (ok) AS p95_ms FROM r GROUP BY d, event_type""",
)
def stream_latency(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    runs = events(spark, folder, files).select(
        "ts", "event_type", (F.get_json_object("props", "$.k").cast("int") < 90).alias("ok"), F.round(F.col("value") * 100).cast("bigint").alias("elapsed_ms")
    )
    latest = latency_windows(runs, "1 hour", "1 day", "event_type")
    return latest.select(_utc("span.start").alias("started"), "event_type", "attempts", "successes", "within_target", "p50_ms", "p95_ms")


@query(
    "stream_progress",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS started, user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS stage,
      count(*) AS steps, count(*) FILTER (event_type IN ('purchase', 'error')) AS terminal_steps FROM events GROUP BY 1, 2""",
)
def stream_progress(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    steps = events(spark, folder, files).select(
        "ts", F.col("event_id").alias("seq"), "user_id", F.col("event_type").alias("stage"), F.col("event_type").isin("purchase", "error").alias("terminal")
    )
    latest = latest_progress(steps, "user_id", "1 hour")
    return latest.select(_utc("span.start").alias("started"), "user_id", "stage", "steps", "terminal_steps")


@query(
    "stream_sessions",
    f"""SELECT user_id, count(DISTINCT json_extract(props, '$.k')) AS seen, count(DISTINCT json_extract(props, '$.k')) > {MAX_SEEN} AS over_limit FROM events GROUP BY user_id""",
)
def stream_sessions(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """Films that a user has shown; a user idle for a week starts with an empty state, and shows nothing twice here."""
    shown = events(spark, folder, files).select("ts", "user_id", F.get_json_object("props", "$.k").alias("film"))
    seen = seen_films(shown, "user_id", "film", "1 hour", "7 days")
    return seen.groupBy("user_id").agg(F.count("film").alias("seen")).withColumn("over_limit", F.col("seen") > MAX_SEEN)


@query(
    "stream_orphans",
    """WITH o AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
      g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS abandoned, count(*) AS steps
    FROM g GROUP BY user_id, s HAVING NOT bool_or(event_type IN ('purchase', 'error')) AND max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def stream_orphans(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    steps = events(spark, folder, files).select("ts", "user_id", F.col("event_type").isin("purchase", "error").alias("terminal"))
    lost = orphans(steps, "user_id", "1 hour", "6 hours")
    return lost.select("user_id", _utc("started").alias("started"), _utc("abandoned").alias("abandoned"), "steps")
