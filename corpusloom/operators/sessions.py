"""Path history: the reduced session, what was seen, and the context a next request gets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut, join_back, keyed
from .sequences import SEGMENT_ROWS, dense_positions

# Snapshots a path keeps; films and stored length beyond which it is reported.
MAX_SNAPSHOTS = 64
MAX_SEEN = 5_000
MAX_CHARS = 1_500_000

# Every (length, cursor) a path can be in when a segment starts; the empty path (0, -1) comes last.
_LENGTHS = np.concatenate([np.full(n, n) for n in range(1, MAX_SNAPSHOTS + 1)] + [[0]])
_CURSORS = np.concatenate([np.arange(n) for n in range(1, MAX_SNAPSHOTS + 1)] + [[-1]])


def _first_segment(restore: np.ndarray) -> tuple[list[int], int, int]:
    """Replay from nothing: event indexes on the stack, the cursor, refused events."""
    stack: list[int] = []
    cursor, refused = -1, 0
    for at, to in enumerate(restore):
        if to < 0:
            stack = [*stack[: cursor + 1], at][-MAX_SNAPSHOTS:]
            cursor = len(stack) - 1
        elif to < len(stack):
            cursor = int(to)
        else:
            refused += 1
    return stack, cursor, refused


def _any_segment(restore: np.ndarray) -> np.ndarray:
    """Replay from every start state at once: rows of (length, cursor, refused, slots...).

    A slot is an event index, or -1 - i for slot i of the stack the segment started with.
    """
    length, cursor = _LENGTHS.copy(), _CURSORS.copy()
    refused = np.zeros_like(length)
    slots = np.tile(-1 - np.arange(MAX_SNAPSHOTS), (len(length), 1))
    rows = np.arange(len(length))
    for at, to in enumerate(restore):
        if to < 0:
            full = cursor == MAX_SNAPSHOTS - 1
            if full.any():
                slots[full, :-1] = slots[full, 1:]
            cursor = np.minimum(cursor + 1, MAX_SNAPSHOTS - 1)
            slots[rows, cursor] = at
            length = cursor + 1
        else:
            known = to < length
            cursor = np.where(known, to, cursor)
            refused += ~known
    return np.column_stack([length, cursor, refused, slots])


def last_paths(events: DataFrame) -> DataFrame:
    """Events since the last new path of each session; what came before has no effect any more.

    events(session_id, seq, kind in start/commit/restore, target, film_ids, size).
    """
    valid = events.where((F.col("kind") == "restore") | (F.size("film_ids") > 0))
    start = valid.where("kind = 'start'").groupBy("session_id").agg(F.max("seq").alias("start_seq"))
    return join_back(valid, start, ["session_id"], "left").where(
        F.col("start_seq").isNull() | (F.col("seq") >= F.col("start_seq"))
    ).drop("start_seq")


def first_seen(path: DataFrame) -> DataFrame:
    """(session_id, film_id, seq): where each film was shown first."""
    shown = path.where("kind != 'restore'").select("session_id", "seq", F.explode("film_ids").alias("film_id"))
    return shown.groupBy("session_id", "film_id").agg(F.min("seq").alias("seq"))


def reduce_sessions(events: DataFrame) -> DataFrame:
    """Per session its snapshots in order, cursor, refused events, seen and archived film counts, status.

    A commit drops what lies behind the cursor and keeps the newest 64 snapshots; dropped films stay
    seen. The whole path is replayed; `film_limit` marks paths that showed more than 5,000 films and `size_limit`
    those whose snapshots could outgrow the stored length before they outnumber 64.
    """
    kind = dict(events.dtypes)["session_id"]
    path = cut(last_paths(events))
    seen = cut(first_seen(path))
    placed = dense_positions(
        path.select("session_id", "seq", F.when(F.col("kind") == "restore", F.col("target")).otherwise(-1).cast("bigint").alias("restore")),
        "session_id",
        "seq",
    )
    placed = cut(placed)
    length = max(SEGMENT_ROWS, math.isqrt(placed.count()))

    def describe(group: pa.Table) -> pa.Table:
        rows = group.sort_by("position")
        restore, seqs = rows["restore"].to_numpy(), rows["seq"].to_numpy()
        if rows["segment"][0].as_py() == 0:
            stack, cursor, refused = _first_segment(restore)
            table = np.array([[len(stack), cursor, refused, *stack, *[0] * (MAX_SNAPSHOTS - len(stack))]])
            which = np.zeros(1, dtype=np.int64)
        else:
            table, which = np.unique(_any_segment(restore), axis=0, return_inverse=True)
        # Event indexes become sequence numbers now; slots of the earlier stack stay negative.
        slots = table[:, 3:]
        table[:, 3:] = np.where(slots >= 0, seqs[np.maximum(slots, 0)], slots)
        return rows.select(["session_id", "segment"]).slice(0, 1).append_column(
            "which", pa.array([which.ravel()], pa.list_(pa.int64()))
        ).append_column("table", pa.array([table.ravel()], pa.list_(pa.int64())))

    steps = (
        keyed(placed.withColumn("segment", F.floor(F.col("position") / length)), "session_id", "segment")
        .groupBy("session_id", "segment")
        .applyInArrow(describe, f"session_id {kind}, segment bigint, which array<bigint>, table array<bigint>")
    )

    def chain(group: pa.Table) -> pa.Table:
        rows = group.sort_by("segment")
        stack: list[int] = []
        cursor, refused = -1, 0
        for which, flat in zip(rows["which"], rows["table"]):
            table = flat.values.to_numpy().reshape(-1, MAX_SNAPSHOTS + 3)
            state = len(stack) * (len(stack) - 1) // 2 + cursor if stack else -1
            row = table[which.values.to_numpy()[state]]
            size, cursor, refused = int(row[0]), int(row[1]), refused + int(row[2])
            stack = [int(s) if s >= 0 else stack[-1 - int(s)] for s in row[3 : 3 + size]]
        return rows.select(["session_id"]).slice(0, 1).append_column(
            "snapshots", pa.array([stack], pa.list_(pa.int64()))
        ).append_column("cursor", pa.array([cursor], pa.int32())).append_column("refused", pa.array([refused], pa.int64()))

    final = cut(
        keyed(steps, "session_id")
        .groupBy("session_id")
        .applyInArrow(chain, f"session_id {kind}, snapshots array<bigint>, cursor int, refused bigint")
    )
    shown = path.where("kind != 'restore'")
    counts = seen.groupBy("session_id").agg(F.count("*").alias("seen"))
    live = (
        final.select("session_id", F.explode("snapshots").alias("seq"))
        .join(shown.select("session_id", "seq", F.explode("film_ids").alias("film_id")), ["session_id", "seq"])
        .groupBy("session_id")
        .agg(F.count_distinct("film_id").alias("live"))
    )
    sizes = shown.groupBy("session_id").agg(F.max("size").alias("largest"))
    return (
        final.join(counts, "session_id", "left")
        .join(live, "session_id", "left")
        .join(sizes, "session_id", "left")
        .select(
            "session_id",
            "snapshots",
            "cursor",
            "refused",
            F.coalesce("seen", F.lit(0)).alias("seen"),
            (F.coalesce("seen", F.lit(0)) - F.coalesce("live", F.lit(0))).alias("archived"),
            F.when(F.col("seen") > MAX_SEEN, "film_limit")
            .when(F.col("largest") * MAX_SNAPSHOTS > MAX_CHARS, "size_limit")
            .otherwise("ok")
            .alias("status"),
        )
    )


def history_context(shown: DataFrame, archived: DataFrame) -> DataFrame:
    """First-shown identity of each film of a session, and whether the path is within its limits.

    shown(session_id, seq, film_id, title, year, director), archived(session_id, film_id).
    """
    films = shown.groupBy("session_id", "film_id").agg(F.min_by(F.struct("title", "year", "director"), "seq").alias("film"))
    ids = shown.select("session_id", "film_id").unionByName(archived.select("session_id", "film_id")).distinct()
    sizes = ids.groupBy("session_id").agg(F.count("*").alias("seen"))
    discovered = films.groupBy("session_id").agg(F.count("*").alias("discovered"))
    limits = sizes.join(discovered, "session_id", "left").select(
        "session_id",
        "seen",
        F.coalesce("discovered", F.lit(0)).alias("discovered"),
        ((F.col("seen") <= MAX_SEEN) & (F.coalesce("discovered", F.lit(0)) <= MAX_SNAPSHOTS * 12)).alias("within_limits"),
    )
    return films.select("session_id", "film_id", "film.*").join(limits, "session_id", "right")
