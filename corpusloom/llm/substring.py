"""Substring dedup: words covered by a window of `WINDOW` words that also starts elsewhere are removed.

Method: a count-min prefilter. Every window has an anchor, the least hash of the runs of `ANCHOR` words inside
it, so equal windows have equal anchors at equal places. Each task sketches the anchors it holds; the merged
sketch never underestimates how often an anchor, and so a window, occurs. A second pass hashes only windows
whose anchor is estimated to occur at least twice and groups these exactly (by 96 bits), so none is lost. Windows
found twice within a batch are settled there and pass on one witness, so a passage in every document adds one row a
batch to its group.

The sketch has `cells_for` cells, growing with the text up to `MOST_CELLS`. As bits ("twice or more") it is the
only thing broadcast: at most 2 * MOST_CELLS / 8 bytes. Beyond that bound it filters less; results stay the same.

Defined results: null or empty text has no words, removes none and keeps the empty string; texts with fewer than
`WINDOW` words never change; repeated rows (also of one doc_id) count as separate places; null doc_ids are kept;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import join_back, scratch_path
from . import scan

WINDOW = 35
ANCHOR = 11
# Bits of the sketch's cells: per row of cells, at least and at most, and cells merged in one array.
LEAST_CELLS, MOST_CELLS, BLOCK = 1 << 20, 1 << 28, 1 << 20
DEPTH = 2
# Windows that a task settles together.
MOST_HELD = 1 << 22
# Bytes of removals that may be broadcast to the texts.
BROADCAST_BYTES = 32 << 20

_GRAM = scan.coefficients(ANCHOR, 11)
_FULL = [scan.coefficients(WINDOW, 12), scan.coefficients(WINDOW, 13)]
_CELL = scan.coefficients(DEPTH, 14)


def _sliding(x: np.ndarray, width: int, better) -> np.ndarray:
    """Least or greatest of every `width` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        x = better(x[: len(x) - span], x[span:])
        span *= 2
    return better(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def _anchors(w: scan.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each run of ANCHOR words, anchor of each window, whether the window lies in one row)."""
    runs = scan.grams(w.hashes, _GRAM)
    windows = len(w.hashes) - WINDOW + 1
    if windows <= 0:
        return runs, runs[:0], np.zeros(0, dtype=bool)
    return runs, _sliding(runs, WINDOW - ANCHOR + 1, np.minimum), w.row[:windows] == w.row[WINDOW - 1 :]


def _chosen(runs: np.ndarray, anchors: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Hashes at every place that is the anchor of a window over it."""
    reach = WINDOW - ANCHOR
    pad = np.zeros(reach, dtype=np.uint64)
    most = _sliding(np.concatenate([pad, np.where(whole, anchors, np.uint64(0)), pad]), reach + 1, np.maximum)
    return runs[(most == runs) & (most > 0)]


def _cells(hashes: np.ndarray, cells: int) -> list[np.ndarray]:
    shift = np.uint64(64 - (cells.bit_length() - 1))
    return [scan.mix(hashes * factor) >> shift for factor in _CELL]


def _sketch(cells: int):
    """Per task: the cells it has counted, with 1 or 2 for "more", by block."""

    def flush(found: list[np.ndarray], row: int) -> Iterator[pa.RecordBatch]:
        cell, count = np.unique(np.concatenate(found), return_counts=True)
        block = (cell // np.uint64(BLOCK)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
        coded = (cell % np.uint64(BLOCK)).astype(np.uint32) * np.uint32(2) + (count > 1)
        bodies = [
            zlib.compress(np.diff(coded[a:b], prepend=np.uint32(0)).tobytes(), 1)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True)
        ]
        ids = block[cuts[:-1]] + row * (cells // BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.binary())], ["block", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
        size = 0
        for batch in batches:
            for w in scan.words(batch.column(0)):
                chosen = _chosen(*_anchors(w)) if len(w.hashes) >= WINDOW else w.hashes[:0]
                for row, cell in enumerate(_cells(chosen, cells)):
                    held[row].append(cell)
                size += len(chosen)
                if size > 1 << 21:
                    for row in range(DEPTH):
                        yield from flush(held[row], row)
                    held, size = [[] for _ in range(DEPTH)], 0
        if size:
            for row in range(DEPTH):
                yield from flush(held[row], row)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the blocks of this partition, one row at a time, and keep the bits "twice or more"."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            coded = np.cumsum(np.frombuffer(zlib.decompress(body.as_py()), dtype=np.uint32), dtype=np.uint32)
            total = sums.setdefault(block, np.zeros(BLOCK, dtype=np.uint8))
            cell = coded >> np.uint32(1)
            total[cell] = np.minimum(total[cell] + 1 + (coded & np.uint32(1)).astype(np.uint8), 2)
    for block, total in sums.items():
        bits = zlib.compress(np.packbits(total >= 2).tobytes(), 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([bits], pa.binary())], ["block", "bits"]
        )


def cells_for(text_bytes: int) -> int:
    """About four cells per expected anchor (a seventieth of the bytes), a power of two within the bounds."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << int(text_bytes // 16).bit_length()))


def repeated_cells(docs: DataFrame, cells: int) -> np.ndarray:
    """The merged sketch as bits: DEPTH * cells of them, whatever the input."""
    spark = docs.sparkSession
    blocks = DEPTH * cells // BLOCK
    tasks = max(1, min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    merged = (
        docs.select("text").mapInArrow(_sketch(cells), "block long, cells binary")
        .repartition(tasks, "block").mapInArrow(_merge, "block long, bits binary")
    )
    bits = np.zeros(DEPTH * cells // 8, dtype=np.uint8)
    for block, body in merged.collect():
        bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(zlib.decompress(body), dtype=np.uint8)
    return bits


def _repeated(anchors: np.ndarray, bits: np.ndarray, cells: int) -> np.ndarray:
    """Places of the anchors that every row of cells has seen twice."""
    at = np.arange(len(anchors))
    for row in range(DEPTH):
        cell = _cells(anchors[at], cells)[row].astype(np.int64) + row * cells
        at = at[((bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).astype(bool)]
    return at


def _settle(h1, h2, text, start, names: list[bytes], weight: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows of a batch, each hash once: those found twice here are settled here and only give witness of it.

    A row with `starts` lists all settled places of a text; other rows carry one place, or none for a witness.
    """
    order = np.lexsort((h2, h1))
    h1, h2, text, start = h1[order], h2[order], text[order], start[order]
    first = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
    group = np.cumsum(first) - 1
    seen = np.bincount(group, weights=weight[text])
    twice = seen[group] > 1
    single, witness = ~twice, twice & first
    keys = np.array(names, dtype=object)
    n, m = int(single.sum()), int(witness.sum())
    schema = pa.schema(
        [("h1", pa.int64()), ("h2", pa.int32()), ("weight", pa.int32()), ("text_key", pa.binary()),
         ("start", pa.int32()), ("starts", pa.list_(pa.int32()))]
    )
    # In the texts' order again, so that neighbouring rows are alike and compress well.
    again = np.lexsort((start[single], text[single]))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(h1[single][again].view(np.int64)), pa.array(h2[single][again]), pa.array(np.ones(n, np.int32)),
            pa.array(keys[text[single][again]], pa.binary()), pa.array(start[single][again]),
            pa.nulls(n, pa.list_(pa.int32())),
        ],
        schema=schema,
    )
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(h1[witness].view(np.int64)), pa.array(h2[witness]), pa.array(np.full(m, 2, np.int32)),
            pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.list_(pa.int32())),
        ],
        schema=schema,
    )
    order = np.lexsort((start[twice], text[twice]))
    text, start = text[twice][order], start[twice][order]
    found, begin = np.unique(text, return_index=True)
    own = np.array([int.from_bytes(names[t][:8], "little", signed=True) for t in found], dtype=np.int64)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(own), pa.array(np.full(len(found), -1, np.int32)), pa.array(np.full(len(found), 2, np.int32)),
            pa.array(keys[found], pa.binary()), pa.nulls(len(found), pa.int32()),
            pa.ListArray.from_arrays(pa.array(np.append(begin, len(text)).astype(np.int32)), pa.array(start)),
        ],
        schema=schema,
    )


def _candidates(shared, cells: int):
    """Second pass: 96-bit hashes of the windows whose anchor may repeat; equal texts of a batch go once, weighted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            weight: dict[bytes, int] = {}
            place: dict[bytes, int] = {}
            for i, key in enumerate(batch.column(1).to_pylist()):
                weight[key] = weight.get(key, 0) + 1
                place.setdefault(key, i)
            names, many = list(place), np.fromiter(weight.values(), dtype=np.int64, count=len(weight))
            held: list[list[np.ndarray]] = [[], [], [], []]
            size = 0
            for w in scan.words(batch.column(0).take(pa.array(list(place.values()), pa.int64()))):
                _, anchors, whole = _anchors(w)
                inside = np.flatnonzero(whole)
                at = inside[_repeated(anchors[inside], bits, cells)]
                if not len(at):
                    continue
                for column, factors in zip(held, _FULL):
                    total = np.zeros(len(at), dtype=np.uint64)
                    for j, factor in enumerate(factors):
                        total += w.hashes[at + j] * factor
                    column.append(scan.mix(total))
                row = w.row[at]
                held[2].append(row)
                held[3].append((at - scan.segments(w.row, w.first, w.last)[row - w.first]).astype(np.int32))
                size += len(at)
                if size > MOST_HELD:
                    yield from _settle_all(held, names, many)
                    held, size = [[], [], [], []], 0
            if size:
                yield from _settle_all(held, names, many)

    return run


def _settle_all(held, names, many) -> Iterator[pa.RecordBatch]:
    h1, h2, text, start = (np.concatenate(c) for c in held)
    return _settle(h1, (h2 >> np.uint64(33)).astype(np.int32), text, start, names, many)


def _cut(columns: list[str]):
    """Apply the removals: kept words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = batch.column("text"), batch.column("runs").to_pylist()
            n_words, n_removed, kept, untouched = [], [], [], []
            for w in scan.words(texts):
                bounds = scan.segments(w.row, w.first, w.last)
                gone = np.zeros(len(w.starts) + 1, dtype=np.int32)
                for i in range(w.first, w.last):
                    for run_ in runs[i] or ():
                        gone[bounds[i - w.first] + run_["begin"]] += 1
                        gone[bounds[i - w.first] + run_["end"]] -= 1
                stays = np.cumsum(gone)[:-1] == 0
                counts = np.add.reduceat(np.append(stays, False), bounds[:-1]) if len(bounds) > 1 else bounds[:0]
                counts = np.where(np.diff(bounds) > 0, counts, 0)
                n_words.append(np.diff(bounds))
                n_removed.append(np.diff(bounds) - counts)
                # Each kept word with the separator after it, that of a row's last word taken off again.
                starts, sizes = w.starts[stays], w.ends[stays] - w.starts[stays] + 1
                body = scan.gather(np.append(w.data, np.uint8(32)), starts, sizes)
                body[np.cumsum(sizes) - 1] = 32
                size = np.bincount(w.row[stays] - w.first, weights=sizes, minlength=w.last - w.first).astype(np.int64)
                stop = np.cumsum(size)
                for i in range(w.last - w.first):
                    kept.append(body[stop[i] - size[i] : max(stop[i] - 1, stop[i] - size[i])].tobytes())
            out = {name: batch.column(name) for name in columns}
            out["n_words"] = pa.array(np.concatenate(n_words) if n_words else [], pa.int64())
            out["n_removed"] = pa.array(np.concatenate(n_removed) if n_removed else [], pa.int64())
            out["kept_text"] = pa.array(kept, pa.binary()).cast(pa.string())
            out["kept_sha256"] = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def removals(docs: DataFrame) -> DataFrame:
    """text_key (MD5 of a text) and runs, the word ranges [begin, end) to remove from every copy of that text."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = cells_for(size)
    shared = spark.sparkContext.broadcast(repeated_cells(texts, cells))
    windows = texts.withColumn("text_key", F.unhex(F.md5("text"))).mapInArrow(
        _candidates(shared, cells),
        "h1 long, h2 int, weight int, text_key binary, start int, starts array<int>",
    )
    # A hash has at most one row a batch here, so no group is hot, however often a passage is repeated.
    seen = windows.withColumn("n", F.sum("weight").over(Window.partitionBy("h1", "h2")))
    hits = seen.where("n > 1 AND text_key IS NOT NULL").select(
        "text_key", F.explode(F.coalesce("starts", F.array("start"))).alias("start")
    )
    starts = hits.groupBy("text_key").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    # Neighbouring windows become one range: begins and ends are where the next start is over WINDOW words away.
    begins = F.filter("starts", lambda x, i: (i == 0) | (x > F.get("starts", i - 1) + WINDOW))
    ends = F.filter("starts", lambda x, i: F.get("starts", i + 1).isNull() | (F.get("starts", i + 1) > x + WINDOW))
    return starts.select(
        "text_key",
        F.arrays_zip(begins.alias("begin"), F.transform(ends, lambda x: x + WINDOW).alias("end")).alias("runs"),
    )


def dedupe(docs: DataFrame, *columns: str) -> DataFrame:
    """Rows of `docs`: `columns`, n_words, n_removed, kept_text and kept_sha256, judged on the whole input."""
    names = list(dict.fromkeys(columns or ("doc_id",)))
    held = {name: f"__c{i}" for i, name in enumerate(names)}
    path = scratch_path(docs.sparkSession, "removals")
    removals(docs).write.parquet(path)
    runs = docs.sparkSession.read.schema(
        "text_key binary, runs array<struct<begin:int,end:int>>"
    ).parquet(path)
    rows = docs.select(
        *(F.col(n).alias(h) for n, h in held.items()), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("text_key", F.unhex(F.md5("text")))
    size = runs.agg(F.sum(F.lit(64) + F.size("runs") * 16)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(runs), "text_key", "left")
    else:
        joined = join_back(rows, runs, ["text_key"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(
        [f"{h} {kinds[h]}" for h in held.values()]
        + ["n_words long", "n_removed long", "kept_text string", "kept_sha256 string"]
    )
    out = joined.select(*held.values(), "text", "runs").mapInArrow(_cut(list(held.values())), schema)
    return out.withColumnsRenamed({h: n for n, h in held.items()})
