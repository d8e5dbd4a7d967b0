"""Order-dependent work split into segments: positions, next-fit packing, ordered reassembly.

A segment describes what it does to every state it could start in; these descriptions are chained, and
then all segments finish at once. No ordered group has to fit one task.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut, keyed, lookup
from .elements import elements, numbered, whole_elements

SEGMENT_ROWS = 4_096


def dense_positions(rows: DataFrame, shard: str, ordinal: str) -> DataFrame:
    """`position` 0, 1, 2, ... per shard in the order of a unique integer `ordinal`.

    Ranks are taken within ranges of the ordinal and shifted by the counts of the ranges before, so a
    shard that holds most of the table is ordered by many tasks.
    """
    span = rows.agg(F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi"), F.count("*").alias("n")).first()
    segments = max(1, math.ceil(span.n / SEGMENT_ROWS))
    width = max(1, ((span.hi or 0) - (span.lo or 0) + 1 + segments - 1) // segments)
    cut_up = rows.withColumn("_range", F.floor((F.col(ordinal) - F.lit(span.lo or 0)) / width))
    counts = cut_up.groupBy(shard, "_range").agg(F.count("*").alias("_n"))
    before = W.partitionBy(shard).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(shard, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy(shard, "_range").orderBy(ordinal))
    return (
        cut_up.withColumn("_rank", rank)
        .join(offsets, [shard, "_range"])
        .withColumn("position", F.col("_before") + F.col("_rank") - 1)
        .drop("_range", "_rank", "_before")
    )


def _next_starts(chars: np.ndarray, max_items: int, max_chars: int) -> np.ndarray:
    """Where the chunk that starts at each row ends; an oversize row is a chunk of its own."""
    total = np.concatenate([[0], np.cumsum(chars)])
    at = np.arange(len(chars))
    fits = np.searchsorted(total, total[at] + max_chars, side="right") - 1
    return np.maximum(at + 1, np.minimum(at + max_items, fits))


def pack(items: DataFrame, shard: str, ordinal: str, chars: str, max_items: int, max_chars: int) -> DataFrame:
    """items with `chunk`: next-fit in order, a new chunk when count or characters would overflow."""
    kinds = dict(items.dtypes)
    placed = cut(dense_positions(items.select(shard, ordinal, F.col(chars).cast("bigint").alias("chars")), shard, ordinal))
    total = placed.count()
    length = max(SEGMENT_ROWS, max_items, math.isqrt(total))
    segmented = placed.withColumn("segment", F.floor(F.col("position") / length))
    ahead = segmented.where((F.col("position") % length < max_items) & (F.col("segment") > 0))
    with_halo = segmented.unionByName(ahead.withColumn("segment", F.col("segment") - 1))

    def describe(group: pa.Table) -> pa.Table:
        rows = group.sort_by("position")
        first = rows["segment"][0].as_py() * length
        own = int((rows["position"].to_numpy() < first + length).sum())
        nxt = _next_starts(rows["chars"].to_numpy(), max_items, max_chars)
        leave, starts = np.zeros(own, dtype=np.int64), np.zeros(own, dtype=np.int64)
        for at in range(own - 1, -1, -1):
            to = int(nxt[at])
            leave[at], starts[at] = (to - own, 1) if to >= own else (leave[to], starts[to] + 1)
        entries = min(max_items, own)
        return rows.select([shard, "segment"]).slice(0, 1).append_column(
            "leave", pa.array([leave[:entries]], pa.list_(pa.int64()))
        ).append_column("starts", pa.array([starts[:entries]], pa.list_(pa.int64())))

    steps = keyed(with_halo, shard, "segment").groupBy(shard, "segment").applyInArrow(
        describe, f"{shard} {kinds[shard]}, segment bigint, leave array<bigint>, starts array<bigint>"
    )

    def chain(group: pa.Table) -> pa.Table:
        rows = group.sort_by("segment")
        entry, done, out = 0, 0, []
        for leave, starts in zip(rows["leave"], rows["starts"]):
            out.append((entry, done))
            if entry < len(leave):
                entry, done = leave[entry].as_py(), done + starts[entry].as_py()
            else:
                entry = 0
        return rows.select([shard, "segment"]).append_column(
            "entry", pa.array([e for e, _ in out], pa.int64())
        ).append_column("done", pa.array([d for _, d in out], pa.int64()))

    # One row per segment: the square root of the table at most.
    entries = keyed(steps, shard).groupBy(shard).applyInArrow(chain, f"{shard} {kinds[shard]}, segment bigint, entry bigint, done bigint")

    def assign(group: pa.Table) -> pa.Table:
        rows = group.sort_by("position")
        nxt = _next_starts(rows["chars"].to_numpy(), max_items, max_chars)
        started = np.zeros(rows.num_rows, dtype=np.int64)
        at = rows["entry"][0].as_py()
        while at < rows.num_rows:
            started[at] = 1
            at = int(nxt[at])
        chunk = rows["done"][0].as_py() - 1 + np.cumsum(started)
        return rows.select([shard, ordinal, "chars"]).append_column("chunk", pa.array(chunk, pa.int64()))

    return (
        keyed(segmented.join(entries, [shard, "segment"]), shard, "segment")
        .groupBy(shard, "segment")
        .applyInArrow(assign, f"{shard} {kinds[shard]}, {ordinal} {kinds[ordinal]}, chars bigint, chunk bigint")
    )


def reassemble(deltas: DataFrame, group: str, order: str, text: str, part_rows: int = 64) -> DataFrame:
    """Ordered text of a group in parts of `part_rows` consecutive order values.

    `order` is a whole number that is unique in its group, so a part is bounded however long the
    group is, and the parts in order are the whole text.
    """
    return (
        deltas.groupBy(group, F.floor(F.col(order) / part_rows).alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("rows"))
        .select(group, "part", F.array_join(F.col(f"rows.{text}"), "").alias("text"), F.size("rows").alias("rows"))
    )


# What a proposal row may hold.
TITLE_CHARS = 240
FIRST_YEAR, LAST_YEAR = 1888, 2100


# Years are read as decimals, so that 1990.5 is none; 1990.0 is one, as in JSON all numbers are alike.
def _field(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _proposes(v: Column) -> Column:
    """Whether an element is an object with a title, a year and a director."""

    def is_a(name: str, kinds: str) -> Column:
        return F.schema_of_variant(_field(v, name, "variant")).rlike(kinds)

    year = _field(v, "y", "double")
    return F.coalesce(
        F.schema_of_variant(v).startswith("OBJECT")
        & is_a("t", "^STRING$") & F.length(_field(v, "t", "string")).between(1, TITLE_CHARS)
        & is_a("d", "^STRING$") & F.length(_field(v, "d", "string")).between(1, TITLE_CHARS)
        & is_a("y", "^(BIGINT|DECIMAL.*|DOUBLE)$") & year.between(FIRST_YEAR, LAST_YEAR) & (year == F.floor(year)),
        F.lit(False),
    )


def _proposal(v: Column) -> list[Column]:
    return [_field(v, "t", "string").alias("t"), _field(v, "y", "double").cast("int").alias("y"), _field(v, "d", "string").alias("d")]


# What a text may hold if another parser shall read it the same way: no escaped code units, no endless numbers.
_ODD = re.compile(r"\\u|[0-9.]{100}")
_NESTED = 200
_SHORT = pa.schema([
    ("group", pa.string()), ("found", pa.list_(pa.struct([("t", pa.string()), ("y", pa.int32()), ("d", pa.string())]))), ("items", pa.list_(pa.string())),
])
_SHORT_SQL = "group string, found array<struct<t: string, y: int, d: string>>, items array<string>"


def _unique(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key repeats")
    return out


def _no_number(name: str) -> None:
    raise ValueError(name)


_STRICT = json.JSONDecoder(object_pairs_hook=_unique, parse_constant=_no_number)


def _read_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def good(text) -> bool:
        return type(text) is str and 1 <= len(text) <= TITLE_CHARS

    for batch in batches:
        texts, found, odd = batch.column("text").to_pylist(), [], []
        for at, text in enumerate(texts):
            try:
                root = None if _ODD.search(text) or text.count("{") + text.count("[") > _NESTED else _STRICT.decode(text)
            except ValueError:
                root = None
            if type(root) is not dict:
                odd.append(at)
                found.append(None)
                continue
            rows = root.get("r")
            found.append([
                (r["t"], int(r["y"]), r["d"]) for r in (rows if type(rows) is list else ())
                if type(r) is dict and good(r.get("t")) and good(r.get("d")) and type(r.get("y")) in (int, float)
                and FIRST_YEAR <= r["y"] <= LAST_YEAR and r["y"] == int(r["y"])
            ])
        items: list = [None] * len(texts)
        for at, own in zip(odd, whole_elements([texts[at] for at in odd], "r")):
            items[at] = own
        flat = [f for own in found for f in own or ()]
        offsets = np.cumsum([0, *(len(own or ()) for own in found)]).astype(np.int32)
        values = pa.StructArray.from_arrays(
            [pa.array([f[i] for f in flat], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))], ["t", "y", "d"]
        )
        missing = pa.array([own is None for own in found], pa.bool_())
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=missing)
        yield pa.RecordBatch.from_arrays([batch.column("group"), lists, pa.array(items, pa.list_(pa.string()))], schema=_SHORT)


def _short_proposals(parts: DataFrame) -> DataFrame:
    """(group, position, t, y, d) of responses that are one part: they are parsed where they stand.

    What is no plain JSON object (cut off, repeated keys, escaped code units) goes element by element, as `elements` does.
    """
    read = parts.select("group", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_read_short, _SHORT_SQL)
    parsed = F.transform("items", lambda i: F.try_parse_json(F.trim(i)))
    rest = F.transform(F.filter(parsed, _proposes), lambda v: F.struct(*_proposal(v)))
    return read.select("group", F.posexplode(F.coalesce("found", rest)).alias("position", "p")).select(
        "group", F.col("position").cast("bigint").alias("position"), "p.*"
    )


def reassemble_rows(deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """deltas(request_id, seq, delta, event) as proposals(request_id, position, t, y, d) and statuses(request_id, status).

    Proposals are the complete objects of the list under the key `r` that hold a title, a year and a director;
    others are passed over. A stream without its `completed` event is INCOMPLETE, whatever rows arrived.
    `seq` is a whole number that is unique in its request; a response is cut into parts of it, so its
    deltas may be a third of all. Most responses are one part and are parsed as they are.
    """
    delta = F.col("event") == "delta"
    streams = cut(
        deltas.groupBy("request_id").agg(
            F.when(F.bool_or(F.col("event").isin("failed", "incomplete", "error")), "INCOMPLETE")
            .when(F.bool_or(F.col("event") == "completed"), "COMPLETE")
            .otherwise("INCOMPLETE")
            .alias("status"),
            F.count_if(delta).alias("n"), F.min(F.when(delta, F.col("seq"))).alias("lo"), F.max(F.when(delta, F.col("seq"))).alias("hi"),
        )
    )
    statuses, kind = streams.select("request_id", "status"), dict(deltas.dtypes)["request_id"]
    group = F.col("request_id").cast("string").alias("group")
    texts = deltas.where(delta & F.col("request_id").isNotNull()).select(group, "seq", "delta")
    part_rows = max(64, math.isqrt(streams.agg(F.sum("n")).first()[0] or 0))
    parts = reassemble(texts, "group", "seq", "delta", part_rows).select("group", F.col("part").cast("bigint").alias("part"), "text")
    long = streams.where(F.col("request_id").isNotNull() & (F.floor(F.col("lo") / part_rows) != F.floor(F.col("hi") / part_rows))).select(group)

    def named(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("group").cast(kind).alias("request_id"), "position", "t", "y", "d")

    if long.isEmpty():
        return named(_short_proposals(parts)), statuses
    items, _ = elements(lookup(parts, long, ["group"], "left_semi"), "r")
    rows = cut(items.select("group", "part", "idx", F.try_parse_json(F.trim("item")).alias("v")))
    cut_up = numbered(rows.where(_proposes(F.col("v"))).select("group", "part", "idx", *_proposal(F.col("v"))))
    return named(_short_proposals(lookup(parts, long, ["group"], "left_anti"))).unionByName(named(cut_up)), statuses
