"""Streaming forms: ingestion, request sharing, progress, seen films, latency windows, orphans."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.evaluation import TARGET_MS
from ..session import cut, join_back
from . import state
from .runner import append, keyed_state

# How long a result is shared, how long abandoned work lives.
SHARE = "60 seconds"
ORPHAN_GAP = "5 seconds"
# States that the films of one session are cut into.
SLICES = 8
# Percentiles of latency in hundredths, and the width of the value ranges that are counted first.
PERCENTILES = {"p50_ms": 50, "p95_ms": 95}
RANGE_MS = 1_024


def ingest(stream: DataFrame, judge: Callable[[DataFrame], DataFrame], root: str | None = None) -> DataFrame:
    """Admit arriving records and keep each version once.

    `judge` turns rows into rows with version_id and status. The ids that earlier batches admitted are keyed state on
    disk, so a batch looks up its own ids and reads nothing that was written before; a crash neither loses nor doubles.
    """
    return append(judge(stream).dropDuplicates(["version_id"]), "ingest", root)


def _micros(late: str) -> int:
    """Microseconds of an interval such as '60 seconds'."""
    number, unit = late.split()
    return int(float(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000)


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("us", F.unix_micros("ts"))


def _kind(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("kind") == kind)


def share_requests(events: DataFrame, key: list[str], shared_for: str = SHARE, root: str | None = None) -> DataFrame:
    """One row per started request: its key and `us`, when it started; others share it until the watermark has passed.

    The side table holds keys that came after their state had gone; a key in both is one row here, the earliest.
    """
    rows = keyed_state(_timed(events), shared_for, state.earliest(key), "us long", state.Shared(key, _micros(shared_for)), "dedupe", root)
    return rows.groupBy(*key).agg(F.min("us").alias("us"))


def latest_progress(events: DataFrame, request: str, late: str, span: str = "1 day", root: str | None = None) -> DataFrame:
    """Latest stage and step counts per request and span of events(ts, seq, stage, terminal, <request>).

    Every batch gives the state of each request it touched; rows that come after their span was closed are partial
    rows of a side table, merged here.
    """
    names = [request, "span_end"]
    timed = _timed(events).withColumn("span_end", F.unix_micros(F.window("ts", span)["end"]))
    rows = keyed_state(
        timed, late, state.latest(names), "us long, seq long, stage string, steps long, terminal_steps long", state.Progress(names), "progress", root
    ).withColumn("at", F.struct("us", "seq", "stage"))
    # Counts only grow, so the fullest row of a key is its last.
    last = _kind(rows, "row").groupBy(*names).agg(F.max(F.struct("steps", "terminal_steps", "at")).alias("_r")).select(*names, "_r.*")
    parts = last.unionByName(_kind(rows, "late").select(*names, "steps", "terminal_steps", "at"))
    merged = parts.groupBy(*names).agg(
        F.max("at")["stage"].alias("stage"), F.sum("steps").alias("steps"), F.sum("terminal_steps").alias("terminal_steps")
    )
    end = F.timestamp_micros("span_end")
    return merged.select(
        F.struct((end - F.expr(f"INTERVAL {span}")).alias("start"), end.alias("end")).alias("span"), request, "stage", "steps", "terminal_steps"
    )


def seen_films(events: DataFrame, session: str, film: str, late: str, keep: str, root: str | None = None) -> DataFrame:
    """Each film a session has shown, once. A session's films are cut into `SLICES` states, which go after `keep` idle."""
    names = [session, "slice"]
    shown = _timed(events).select(
        "ts", "us", session, F.col(film).cast("string").alias("film"), F.pmod(F.xxhash64(film), F.lit(SLICES)).cast("int").alias("slice")
    )
    rows = keyed_state(shown, late, state.ends([*names, "film"]), "film string, us long", state.Seen(names, _micros(keep)), "sessions", root)
    return rows.select(session, F.col("film").alias(film)).distinct()


def latency_windows(runs: DataFrame, late: str, span: str, by: str, root: str | None = None) -> DataFrame:
    """Tumbling windows of runs(ts, ok, elapsed_ms): failures count in the attempts, percentiles are exact.

    Every batch gives the measures so far of each window it touched. A window that got late rows is measured anew
    here, from the counts it was closed with and those of the side table.
    """
    names = [by, "span_end"]
    timed = _timed(runs).withColumn("span_end", F.unix_micros(F.window("ts", span)["end"]))
    processor = state.Latency(names, TARGET_MS, list(PERCENTILES.values()))
    rows = keyed_state(timed, late, state.tallies(names), "ok boolean, elapsed_ms long, n long", processor, "latency", root)
    measured = ["attempts", "successes", "within_target", "percentiles"]
    # Attempts only grow, so the fullest row of a window is its last.
    last = _kind(rows, "row").groupBy(*names).agg(F.max(F.struct(*measured)).alias("_r")).select(*names, "_r.*")
    behind = _kind(rows, "late").select(*names).distinct()
    alone = join_back(last, behind, names, "left_anti")
    again = join_back(rows.where("kind IN ('closed', 'late')"), behind, names, "left_semi")
    again = again.withColumn("elapsed_ms", F.when(F.col("elapsed_ms") != state.Latency.NO_TIME, F.col("elapsed_ms")))
    end = F.timestamp_micros("span_end")
    spanned = F.struct((end - F.expr(f"INTERVAL {span}")).alias("start"), end.alias("end")).alias("span")
    each = [F.get("percentiles", F.lit(i)).alias(c) for i, c in enumerate(PERCENTILES)]
    every = alone.select(*names, "attempts", "successes", "within_target", *each).unionByName(_measured(again, names))
    return every.select(spanned, by, "attempts", "successes", "within_target", *PERCENTILES)


def _measured(counts: DataFrame, names: list[str]) -> DataFrame:
    """Measures of (names, ok, elapsed_ms, n): counts accumulate over ranges of values, then inside the range asked for."""
    counted = cut(counts.groupBy(*names, "ok", "elapsed_ms").agg(F.sum("n").alias("n")))
    good = F.col("ok") & F.col("elapsed_ms").isNotNull()
    totals = counted.groupBy(*names).agg(
        F.sum("n").alias("attempts"),
        F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("successes"),
        F.sum(F.when(F.col("ok") & (F.col("elapsed_ms") <= TARGET_MS), F.col("n")).otherwise(0)).alias("within_target"),
        F.sum(F.when(good, F.col("n"))).alias("of"),
    )
    values = counted.where(good).withColumn("range", F.floor(F.col("elapsed_ms") / RANGE_MS))
    ranges = values.groupBy(*names, "range").agg(F.sum("n").alias("m"))
    ranges = ranges.withColumn("upto", F.sum("m").over(W.partitionBy(*names).orderBy("range"))).withColumn("before", F.col("upto") - F.col("m"))
    shares = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(p).alias("p")) for c, p in PERCENTILES.items()]))
    asked = totals.where("of > 0").select(*names, shares.alias("s"), "of").select(
        *(F.col(n).alias(f"a_{n}") for n in names), F.col("s.name").alias("name"), F.expr("of - (of * (100 - s.p)) div 100").alias("rank")
    )
    same = reduce(and_, (F.col(n).eqNullSafe(F.col(f"a_{n}")) for n in names))
    hit = ranges.join(asked, same & (F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("upto"))).select(
        *(f"a_{n}" for n in names), F.col("range").alias("r"), "name", (F.col("rank") - F.col("before")).alias("rank")
    )
    inside = values.withColumn("upto", F.sum("n").over(W.partitionBy(*names, "range").orderBy("elapsed_ms")))
    found = inside.join(hit, same & (F.col("r") == F.col("range")) & (F.col("upto") >= F.col("rank"))).groupBy(*(f"a_{n}" for n in names)).agg(
        *[F.min(F.when(F.col("name") == c, F.col("elapsed_ms"))).alias(c) for c in PERCENTILES]
    )
    return totals.join(found, same, "left").select(*names, "attempts", "successes", "within_target", *PERCENTILES)


def orphans(events: DataFrame, request: str, late: str, gap: str = ORPHAN_GAP, root: str | None = None) -> DataFrame:
    """Closed activity sessions of a request in which no terminal event came, closed by timers as the watermark goes on.

    Sessions that only on-time rows make up are final as they come out. Those of requests with late rows are joined
    here where they touch; what touches a session that is still open is not closed.
    """
    step = _micros(gap)
    rows = keyed_state(
        _timed(events), late, state.spans([request], step), "start long, end long, steps long, finished boolean", state.Sessions([request]),
        "orphans", root, "append",
    ).drop("batch")
    touched = rows.where("kind <> 'closed'").select(request).distinct()
    alone = join_back(_kind(rows, "closed"), touched, [request], "left_anti").select(request, "start", "end", "steps", "finished")
    order = W.partitionBy(request).orderBy("start", "end")
    covered = F.max(F.when(F.col("kind") == "closed", F.col("end"))).over(W.partitionBy(request).orderBy("start"))
    mixed = (
        join_back(rows, touched, [request], "left_semi")
        .withColumn("open", (F.col("kind") == "open") & F.coalesce(covered < F.col("end"), F.lit(True)))
        .withColumn("new", F.coalesce(F.col("start") > F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(True)).cast("int"))
        .withColumn("session", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(request, "session")
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.sum("steps").alias("steps"), F.bool_or("finished").alias("finished"),
            F.bool_or("open").alias("open"),
        )
        .where("NOT open").select(request, "start", "end", "steps", "finished")
    )
    return alone.unionByName(mixed).where("NOT finished").select(
        request, F.timestamp_micros("start").alias("started"), F.timestamp_micros("end").alias("abandoned"), "steps"
    )
