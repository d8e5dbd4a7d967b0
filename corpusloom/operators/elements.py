"""Elements of JSON containers whose text lies in ordered parts that are cut anywhere.

A part says for each of the four states it may start in (inside a string or not, after a backslash or not) in which
it ends and how far it changes the depth. These are chained, so each part knows its state and depth; a second chain
tells it the key it stands under and the part in which its first element began. Then all parts give their elements
at once, and only those that reach over parts are put together. No text has to fit one task, but each element does.

Defined results: null texts are empty; an element is the text between two separators, its outer white space
included; an empty container has none; an element that the text ends in is given if its brackets and strings are
closed; keys are compared as written, escapes included; a key that repeats gives the elements of all its containers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut, keyed, lookup, spread

# What is remembered of the text before a container: its key, which asked-for keys have to fit.
KEY_BYTES = 200
SCALAR = "."
# Characters after which a run of records is cut into parts: a scan takes about a hundred bytes of memory a byte.
PART_CHARS = 1 << 18
_OPEN, _CLOSE = np.frombuffer(b"{[", np.uint8), np.frombuffer(b"}]", np.uint8)
_QUOTE, _SLASH, _COMMA, _ARRAY, _ARRAY_END = b'"\\,[]'


def _scan(raw: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Per byte the change of depth and whether it is a comma outside strings; and the state behind the last byte."""
    inside, escaped = state & 1, state >> 1
    at = np.arange(len(raw))
    last = np.maximum.accumulate(np.where(raw == _SLASH, -1, at))
    # Backslashes that end at a byte; a state after a backslash is one more before the first byte.
    run = at - last + np.where(last < 0, escaped, 0)
    before = np.concatenate([[escaped], run])
    quote = (raw == _QUOTE) & (before[:-1] % 2 == 0)
    within = (np.cumsum(quote) + inside) % 2
    outside = (within == 0) & ~quote
    step = (outside & np.isin(raw, _OPEN)).astype(np.int64) - (outside & np.isin(raw, _CLOSE))
    return step, outside & (raw == _COMMA), int(within[-1]) + 2 * int(before[-1] % 2)


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        states, steps = [], []
        for text in batch.column("text").to_pylist():
            raw = _bytes(text)
            found = [_scan(raw, s) if len(raw) else (raw, raw, s) for s in range(2)]
            # A backslash before the part matters only to a quote or a backslash at its start.
            found += [_scan(raw, s) for s in (2, 3)] if len(raw) and raw[0] in (_QUOTE, _SLASH) else found if len(raw) else [(raw, raw, 2), (raw, raw, 3)]
            states.append([f[2] for f in found])
            steps.append([int(f[0].sum()) if len(raw) else 0 for f in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column("group"), batch.column("part"), pa.array(states, pa.list_(pa.int32())), pa.array(steps, pa.list_(pa.int64()))],
            ["group", "part", "states", "steps"],
        )


def _chain_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, state, depth = None, 0, 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["group"] != group:
                group, state, depth = row["group"], 0, 0
            out.append((state, depth))
            depth += row["steps"][state]
            state = row["states"][state]
        yield pa.RecordBatch.from_arrays(
            [batch.column("group"), batch.column("part"), pa.array([s for s, _ in out], pa.int32()), pa.array([d for _, d in out], pa.int64())],
            ["group", "part", "state", "depth"],
        )


def _heads(raw: np.ndarray, depth: np.ndarray, step: np.ndarray, comma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that stand at depth 1 itself, and those behind which a new key begins there."""
    return (depth == 1) & (step == 0), (depth == 1) & (comma | (step == 1))


def _tail(raw: np.ndarray, flat: np.ndarray, resets: np.ndarray, end: int, before: bytes) -> bytes:
    """The text at depth 1 between the last separator there and `end`."""
    at = int(np.searchsorted(resets, end)) - 1
    start = int(resets[at]) + 1 if at >= 0 else 0
    own = raw[start:end][flat[start:end]][: KEY_BYTES + 1].tobytes()
    return (own if at >= 0 else before + own)[: KEY_BYTES + 1]


def _bounds(base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                raw = _bytes(row["text"])
                if not len(raw):
                    out.append((row["group"], row["part"], row["state"], row["depth"], False, b"", False, row["state"], row["depth"], False, 0))
                    continue
                step, comma, state = _scan(raw, row["state"])
                depth = row["depth"] + np.cumsum(step)
                flat, reset = _heads(raw, depth, step, comma)
                resets = np.flatnonzero(reset)
                bound = ((depth == base) & (comma | (step == 1))) | ((depth == base - 1) & (step == -1))
                roots = (step == 1) & (depth == 1)
                # An array is its brackets and white space around them.
                bare = raw[(depth == 0) & (step == 0)].tobytes().strip()
                stray = bool(bare) or bool((raw[roots] != _ARRAY).any()) or bool((raw[(step == -1) & (depth == 0)] != _ARRAY_END).any()) or bool((depth < 0).any())
                out.append((
                    row["group"], row["part"], row["state"], row["depth"], bool(len(resets)), _tail(raw, flat, resets, len(raw), b""),
                    bool(bound.any()), state, int(depth[-1]), stray, int(roots.sum()),
                ))
            yield pa.RecordBatch.from_pylist([dict(zip(_BOUND.names, r)) for r in out], _BOUND)

    return run


_BOUND = pa.schema([
    ("group", pa.string()), ("part", pa.int64()), ("state", pa.int32()), ("depth", pa.int64()), ("reset", pa.bool_()), ("tail", pa.binary()),
    ("bound", pa.bool_()), ("end_state", pa.int32()), ("end_depth", pa.int64()), ("stray", pa.bool_()), ("roots", pa.int64()),
])
_BOUND_SQL = "group string, part bigint, state int, depth bigint, reset boolean, tail binary, bound boolean, end_state int, end_depth bigint, stray boolean, roots bigint"
_OWNED = pa.schema([("group", pa.string()), ("part", pa.int64()), ("state", pa.int32()), ("depth", pa.int64()), ("tail", pa.binary()), ("owner", pa.int64())])
_OWNED_SQL = "group string, part bigint, state int, depth bigint, tail binary, owner bigint"


_WHOLE = pa.schema([("group", pa.string()), ("part", pa.int64()), ("text", pa.string()), ("state", pa.int32()), ("depth", pa.int64()), ("tail", pa.binary()), ("owner", pa.int64())])


def _chain_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, tail, owner = None, b"", None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["group"] != group:
                group, tail, owner = row["group"], b"", None
            out.append(dict(group=group, part=row["part"], state=row["state"], depth=row["depth"], tail=tail, owner=owner))
            tail = row["tail"] if row["reset"] else (tail + row["tail"])[: KEY_BYTES + 1]
            owner = row["part"] if row["bound"] else owner
        yield pa.RecordBatch.from_pylist(out, _OWNED)


_PIECE = pa.schema([
    ("group", pa.string()), ("owner", pa.int64()), ("idx", pa.int64()), ("part", pa.int64()), ("key", pa.string()), ("text", pa.string()),
    ("ended", pa.bool_()), ("alone", pa.int32()),
])
_PIECE_SQL = "group string, owner bigint, idx bigint, part bigint, key string, text string, ended boolean, alone int"


def _key(head: bytes, wanted: dict[bytes, str]) -> str | None:
    head = head.strip()
    return wanted.get(head[:-1].rstrip()) if head.endswith(b":") else None


def _pieces(base: int, keys: tuple[str, ...], scalars: bool):
    wanted = {json.dumps(k, ensure_ascii=False).encode(): k for k in keys}

    def of(row: dict) -> Iterator[tuple]:
        raw, entry = _bytes(row["text"]), row["tail"]
        if not len(raw):
            return
        step, comma, _ = _scan(raw, row["state"])
        depth = row["depth"] + np.cumsum(step)
        flat, reset = _heads(raw, depth, step, comma)
        resets = np.flatnonzero(reset)
        opens, closes = (depth == base) & (step == 1), (depth == base - 1) & (step == -1)

        def key_at(end: int) -> str | None:
            return _key(_tail(raw, flat, resets, end, entry), wanted) if base == 2 else ""

        # A container that is open at the start was opened by a part before, behind what `tail` holds.
        key = (_key(entry, wanted) if base == 2 else "") if row["depth"] >= base else None
        start, owner, idx, opened = 0, row["owner"], None, 0
        for at in np.flatnonzero(opens | closes | (comma & (depth == base))).tolist():
            if opens[at]:
                key = key_at(at)
            elif key is not None:
                # Alone counts the container's own brackets around an element: blank between both is no element.
                yield row["group"], owner, idx, row["part"], key if idx is not None else None, raw[start:at].tobytes().decode(), True, opened + int(closes[at])
                if closes[at]:
                    key = None
            start, owner, opened = at + 1, row["part"], int(opens[at])
            idx = (idx if idx is not None else -1) + 1
        if key is not None:
            yield row["group"], owner, idx, row["part"], key if idx is not None else None, raw[start:].tobytes().decode(), False, opened
        if scalars:
            for at in np.flatnonzero((comma & (depth == 1)) | ((depth == 0) & (step == -1))).tolist():
                head = _tail(raw, flat, resets, at, entry).decode("utf-8", "replace")
                yield row["group"], row["part"], at - len(raw), row["part"], SCALAR, head, True, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [piece for row in batch.to_pylist() for piece in of(row)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _PIECE)], schema=_PIECE)

    return run


def elements(parts: DataFrame, *keys: str, scalars: bool = False, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """parts(group string, part bigint, text) as its elements and the verdict on each group.

    Elements are those of the root array, or with `keys` those of the containers that stand under these keys of the
    root object: (group, part, idx, key, item), in the order of part and idx; `key` is empty for a root array. The
    entries of an object are elements too, key and all. With `scalars` the entries of the root object itself come too,
    their key being `SCALAR`; they are cut after 200 bytes, and of containers only the key is there. The parts are
    gone through three times: `keep` writes them once before, for parts that cost more than reading. Verdicts are (group, is_array): whether the whole text is one
    array with nothing but white space around it; its elements may still be no JSON.
    """
    if any(len(json.dumps(k, ensure_ascii=False).encode()) > KEY_BYTES // 2 for k in keys):
        raise ValueError(f"a key takes more than {KEY_BYTES // 2} bytes")
    base = 2 if keys else 1
    held = parts.select("group", "part", "text")
    held = spread(cut(held)) if keep else held

    def in_order(rows: DataFrame) -> DataFrame:
        return keyed(rows, "group").sortWithinPartitions("group", "part")

    steps = held.mapInArrow(_describe, "group string, part bigint, states array<int>, steps array<bigint>")
    states = in_order(steps).mapInArrow(_chain_states, "group string, part bigint, state int, depth bigint")
    bounds = cut(lookup(held, cut(states), ["group", "part"]).mapInArrow(_bounds(base), _BOUND_SQL))
    owned = cut(in_order(bounds).mapInArrow(_chain_keys, _OWNED_SQL))
    ends = cut(
        bounds.groupBy("group").agg(
            F.max(F.when(F.col("bound"), F.col("part"))).alias("last"), F.max_by("end_state", "part").alias("end_state"),
            F.max_by("end_depth", "part").alias("end_depth"), F.bool_or("stray").alias("stray"), F.sum("roots").alias("roots"),
        )
    )
    pieces = cut(lookup(held, owned, ["group", "part"]).mapInArrow(_pieces(base, keys, scalars), _PIECE_SQL))
    blank: Column = F.col("text").rlike(r"^[ \t\r\n]*$")
    own = pieces.where(F.col("ended") & F.col("idx").isNotNull())
    whole = own.where(~(blank & (F.col("alone") == 2))).select("group", F.col("owner").alias("part"), "idx", "key", F.col("text").alias("item"))
    # What no later part ends is an element only if nothing in it is open at the end of the text.
    shut = (F.col("end_depth") == base) & (F.col("end_state") % 2 == 0)
    torn = lookup(pieces.where(~F.col("ended") | F.col("idx").isNull()), ends.select("group", "last", "end_depth", "end_state"), ["group"])
    joined = (
        torn.where((F.col("owner") < F.col("last")) | shut)
        .groupBy("group", "owner")
        .agg(
            F.max("idx").alias("idx"), F.max("key").alias("key"), F.sum("alone").alias("alone"), F.bool_or("ended").alias("ended"),
            F.array_join(F.sort_array(F.collect_list(F.struct("part", "text")))["text"], "").alias("text"),
        )
        .where(~(blank & ((F.col("alone") == 2) | ~F.col("ended"))))
        .select("group", F.col("owner").alias("part"), "idx", "key", F.col("text").alias("item"))
    )
    is_array = ~F.col("stray") & (F.col("roots") == 1) & (F.col("end_depth") == 0) & (F.col("end_state") == 0)
    return whole.unionByName(joined), ends.select("group", is_array.alias("is_array"))


def whole_elements(texts: list[str], key: str) -> list[list[str]]:
    """The elements under `key` of texts that are whole, in order and as `elements` would give them."""
    base, blank = 2, " \t\r\n"
    out: list[list[str]] = [[] for _ in texts]
    shut = []
    for text in texts:
        raw = _bytes(text)
        step, _, state = _scan(raw, 0) if len(raw) else (raw, raw, 0)
        shut.append(state % 2 == 0 and int(step.sum()) == base)
    rows = [dict(group=str(at), part=0, text=t, state=0, depth=0, tail=b"", owner=None) for at, t in enumerate(texts)]
    for batch in _pieces(base, (key,), False)(iter([pa.RecordBatch.from_pylist(rows, _WHOLE)])):
        for piece in batch.to_pylist():
            at, bare = int(piece["group"]), not piece["text"].strip(blank)
            if not (bare and piece["alone"] == 2) if piece["ended"] else shut[at] and not bare:
                out[at].append(piece["text"])
    return out


def numbered(items: DataFrame, name: str = "position", dense: bool = False) -> DataFrame:
    """Elements with their number in the group, from 0: counts of the parts before plus the rank in the part.

    `dense` says that no element of a root array has been left out, so that idx is the rank and only counts move.
    """
    counts = items.groupBy("group", "part").agg(F.count("*").alias("_n"))
    before = W.partitionBy("group").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("group", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if dense:
        return lookup(items, offsets, ["group", "part"]).withColumn(name, F.col("_before") + F.col("idx")).drop("_before")
    rank = F.row_number().over(W.partitionBy("group", "part").orderBy("idx"))
    return items.withColumn("_rank", rank).join(offsets, ["group", "part"]).withColumn(name, F.col("_before") + F.col("_rank") - 1).drop("_rank", "_before")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, offset = None, 0
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        values, start, out, size = batch.column("value").to_pylist(), 0, [], 0
        for i in range(1, len(values) + 1):
            size += len(values[i - 1]) + 1
            if i < len(values) and (files[i], blocks[i]) == (files[start], blocks[start]) and size < PART_CHARS:
                continue
            size = 0
            first = (files[start], blocks[start]) != at
            if first:
                at, offset = (files[start], blocks[start]), blocks[start]
            # The separator before the file's first record is none.
            text = ("" if first and blocks[start] == 0 else ",") + ",".join(values[start:i])
            if text:
                out.append((files[start], offset, text))
                offset += len(text.encode())
            start = i
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())],
                ["group", "part", "text"],
            )


def file_parts(spark, path: str, glob: str = "*.json") -> DataFrame:
    """JSON files as (group, part, text), group being the file: read in splits at commas, so no task reads a whole file.

    A part is a run of records of one split, of about PART_CHARS or of one longer record, its number the place where
    it begins. A comma at the very end of a file is not seen.
    """
    rows = spark.read.text(path, lineSep=",", pathGlobFilter=glob)
    named = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return named.mapInArrow(_runs, "group string, part bigint, text string")
