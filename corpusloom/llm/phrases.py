"""Collocations mined from depth-truncated suffix subtrees, partitioned by prefix.

A suffix starts at every word and ends with its piece, after `DEPTH` words at most. The tree of all suffixes is cut
vertically: first by words, whose counts are taken exactly; a prefix that occurs more than `BUDGET` times does not
fit and is extended by its next word, and again, up to whole suffixes, of which equal ones of a batch are one entry.
The prefixes are dealt out to as many groups as keep each near half the budget. Only (group, suffixes) blocks move,
sorted and compressed, and every group builds its subtrees by itself: its suffixes are sorted, a node is a run of
suffixes that share their first words, and its count is the sum over its leaves. Counts of prefixes that were
extended are added up over their groups. What is left of the counting is every phrase that occurs `LEAST` times.

Scores and the removal of phrases that a longer one explains are joins over those phrases alone, in DataFrame
functions. All products that can pass 64 bits are decimals.

Words are told apart by 64-bit hashes of their bytes within a group; phrases are carried as text.

Defined results: null texts have no words; a null lang is `und`; repeated rows and equal ids count as often as they
occur; a very long text is read in parts of `STEP` suffixes; a phrase has one space between words whatever stood
there; ties in rank go by a, then by the phrase's UTF-8 bytes; an empty table, or one without frequent phrases,
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from ..session import scratch_path
from . import scan

DEPTH, LEAST = 4, 30
SCORE, INSIDE, TOP = 2_000_000, 80, 2_000
# Occurrences that a prefix may have before it is extended; a group holds about half as many.
BUDGET = 1 << 20
# Suffixes sorted at once in a text's task, and entries of one block at most.
STEP, BLOCK = 1 << 19, 1 << 16
# Most tasks that groups are dealt out to.
TASKS = 1 << 14

# White space inside a piece, and what ends a piece.
_SPACE, _BREAK = b" \t", b".,;:!?\n\x0b\x0c\r"
_MEMBER = np.ones(256, dtype=bool)
_MEMBER[list(_SPACE + _BREAK)] = False
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(_BREAK)] = True
_FACTOR = scan.coefficients(DEPTH, 900)
_BLOCKS = "part int, lang string, entries int, block binary"


class Words(NamedTuple):
    """Words of some rows: their bytes each followed by a space, bounds therein, rows, hashes, and words left in the piece."""

    text: np.ndarray
    at: np.ndarray
    row: np.ndarray
    hashes: np.ndarray
    room: np.ndarray


def words(column: pa.Array) -> Iterator[Words]:
    offsets, data = scan.buffers(column)
    for first, last in scan.rows_up_to(offsets):
        part = scan._LOWER[data[offsets[first] : offsets[last]]]
        local = offsets[first : last + 1] - offsets[first]
        starts, ends = scan.word_bounds(local, part, _MEMBER)
        if not len(starts):
            continue
        row = first + np.searchsorted(local, starts, side="right") - 1
        piece = np.cumsum(_ENDS[part], dtype=np.int64)[starts]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])]))
        lengths = np.diff(np.append(new, len(starts)))
        room = np.repeat(new + lengths, lengths) - np.arange(len(starts))
        at = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        text = np.empty(at[-1], dtype=np.uint8)
        padded = np.append(part, np.uint8(32))
        for low in range(0, len(starts), STEP):
            high = min(len(starts), low + STEP)
            text[at[low] : at[high]] = scan.gather(padded, starts[low:high], ends[low:high] - starts[low:high] + 1)
        text[at[1:] - 1] = 32
        yield Words(text, at, row, scan.word_hashes(part, starts, ends, _MEMBER), np.minimum(room, DEPTH))


def _languages(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(names, each row's name, each name's hash) of a lang column."""
    coded = column.fill_null("und").dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    names = coded.dictionary.to_pylist()
    hashes = [int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in names]
    return names, coded.indices.to_numpy(zero_copy_only=False), np.array(hashes, dtype=np.uint64)


def _keys(w: Words, low: int, high: int, lang: np.ndarray) -> list[np.ndarray]:
    """Keys of the prefixes of 1 to DEPTH words that start at the words `low` to `high`; short suffixes end in 0."""
    key, out = lang, []
    for d in range(DEPTH):
        at = np.minimum(np.arange(low, high) + d, len(w.hashes) - 1)
        word = np.where(w.room[low:high] > d, w.hashes[at], np.uint64(0))
        key = scan.mix((key ^ word) * _FACTOR[d])
        out.append(key)
    return out


def _steps(w: Words) -> Iterator[tuple[int, int]]:
    for low in range(0, len(w.row), STEP):
        yield low, min(len(w.row), low + STEP)


def _words_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, of, hashes = _languages(batch.column("lang"))
        for w in words(batch.column("text")):
            for low, high in _steps(w):
                key = _keys(w, low, high, hashes[of[w.row[low:high]]])[0]
                distinct, first, n = np.unique(key, return_index=True, return_counts=True)
                at = low + first
                size = w.at[at + 1] - 1 - w.at[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names).take(pa.array(of[w.row[at]])), scan.strings(scan.gather(w.text, w.at[at], size), size),
                        pa.array(distinct.view(np.int64)), pa.array(n),
                    ],
                    ["lang", "word", "key", "n"],
                )


def _inside(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys occur in the sorted `some`."""
    if not len(some):
        return np.zeros(len(keys), dtype=bool)
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


def _extensions(large: np.ndarray):
    """Counts of the longer prefixes of words that are too frequent for a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, of, hashes = _languages(batch.column("lang"))
            for w in words(batch.column("text")):
                for low, high in _steps(w):
                    keys = _keys(w, low, high, hashes[of[w.row[low:high]]])
                    chosen = _inside(keys[0], large)
                    for d in range(1, DEPTH - 1):
                        distinct, n = np.unique(keys[d][chosen], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(n), d + 1, dtype=np.int32)), pa.array(distinct.view(np.int64)), pa.array(n)],
                            ["depth", "key", "n"],
                        )

    return run


def _suffixes(parts: int, large: list[np.ndarray]):
    """Distinct suffixes of a step, as blocks per group and lang: text, counts, and the words that name the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            names, of, hashes = _languages(batch.column("lang"))
            for w in words(batch.column("text")):
                for low, high in _steps(w):
                    lang = of[w.row[low:high]]
                    keys = _keys(w, low, high, hashes[lang])
                    named, key, open_ = np.ones(high - low, dtype=np.uint8), keys[0].copy(), np.ones(high - low, dtype=bool)
                    for d in range(DEPTH - 1):
                        open_ &= _inside(keys[d], large[d])
                        named[open_] += 1
                        key[open_] = keys[d + 1][open_]
                    part = (key % np.uint64(parts)).astype(np.int64)
                    # Equal suffixes of one lang have equal last keys; they stand together within their group.
                    order = np.lexsort((keys[-1], keys[1], keys[0], part * len(names) + lang))
                    last, group = keys[-1][order], (part * len(names) + lang)[order]
                    new = np.flatnonzero(np.concatenate([[True], (last[1:] != last[:-1]) | (group[1:] != group[:-1])]))
                    counts = np.diff(np.append(new, len(order))).astype(np.uint32)
                    at, group, named = low + order[new], group[new], named[order[new]]
                    size = w.at[at + w.room[at]] - w.at[at]
                    for i in range(0, len(at), BLOCK):
                        j = min(len(at), i + BLOCK)
                        text = scan.gather(w.text, w.at[at[i:j]], size[i:j])
                        ends = np.cumsum(size[i:j])
                        text[ends - 1] = 10
                        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group[i:j])) + 1, [j - i]])
                        rows = ([], [], [], [])
                        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                            begin = int(ends[a - 1]) if a else 0
                            plain = counts[i + a : i + b].tobytes() + named[i + a : i + b].tobytes() + text[begin : int(ends[b - 1])].tobytes()
                            g = int(group[i + a])
                            for out, value in zip(rows, (g // len(names), names[g % len(names)], b - a, pack.compress(plain))):
                                out.append(value)
                        kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(v, k) for v, k in zip(rows, kinds)], ["part", "lang", "entries", "block"]
                        )

    return run


def _subtrees(least: int):
    """Nodes of the subtrees of each (part, lang): phrases with their counts. Rows come sorted by part and lang."""
    def nodes(lang: str, blocks: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        counts, named, sizes, texts, hashes = [], [], [], [], []
        for n, block in blocks:
            plain = unpack.decompress(block)
            counts.append(np.frombuffer(plain, dtype=np.uint32, count=n))
            named.append(np.frombuffer(plain, dtype=np.uint8, count=n, offset=4 * n))
            text = np.frombuffer(plain, dtype=np.uint8, offset=5 * n)
            marks = np.flatnonzero((text == 32) | (text == 10))
            starts = np.concatenate([[0], marks[:-1] + 1])
            entry = np.concatenate([[0], np.cumsum(text[marks] == 10)[:-1]])
            first = np.searchsorted(entry, np.arange(n))
            place = np.arange(len(marks)) - first[entry]
            own, lengths = np.zeros((DEPTH, n), dtype=np.uint64), np.zeros((DEPTH, n), dtype=np.int32)
            own[place, entry] = scan.word_hashes(text, starts, marks, _MEMBER)
            # Bytes of the first d + 1 words, spaces between them included.
            lengths[place, entry] = marks - starts[first[entry]]
            hashes.append(own)
            sizes.append(lengths)
            texts.append(text)
        count, given = np.concatenate(counts).astype(np.int64), np.concatenate(named)
        own, length, text = np.concatenate(hashes, axis=1), np.concatenate(sizes, axis=1), np.concatenate(texts)
        whole = length.max(axis=0) + 1
        begin = np.cumsum(whole) - whole
        order = np.lexsort(own[::-1])
        count, given, begin, own, length = count[order], given[order], begin[order], own[:, order], length[:, order]
        fresh = np.zeros(len(order), dtype=bool)
        fresh[0] = True
        for d in range(DEPTH):
            fresh[1:] |= own[d, 1:] != own[d, :-1]
            first = np.flatnonzero(fresh)
            total = np.add.reduceat(count, first)
            keep = (length[d, first] > 0) & ((total >= least) | (given[first] > d + 1))
            at, total = first[keep], total[keep]
            for i in range(0, len(at), BLOCK):
                some, size = at[i : i + BLOCK], length[d, at[i : i + BLOCK]].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(some), pa.string()), scan.strings(scan.gather(text, begin[some], size), size),
                        pa.array(np.full(len(some), d + 1, dtype=np.int32)), pa.array(total[i : i + BLOCK]),
                    ],
                    ["lang", "phrase", "words", "f"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        for batch in batches:
            for part, lang, n, block in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "entries", "block"))):
                if (part, lang) != name:
                    if held:
                        yield from nodes(name[1], held)
                    held, name = [], (part, lang)
                held.append((n, block))
        if held:
            yield from nodes(name[1], held)

    return run


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frequent(docs: DataFrame, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of every phrase of 1 to DEPTH words that occurs `least` times, and (lang, n)."""
    rows = docs.select("text", F.col("lang").cast("string").alias("lang"))
    counted = _stored(
        rows.mapInArrow(_words_counted, "lang string, word string, key long, n long").groupBy("lang", "word")
        .agg(F.sum("n").alias("n"), F.first("key").alias("key")),
        "words",
    )
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    total = totals.agg(F.sum("n")).first()[0] or 0

    def keys(df: DataFrame) -> np.ndarray:
        # At most one in `budget` occurrences is a prefix of its own here.
        return np.sort(np.array([r["key"] for r in df.select("key").toLocalIterator()], dtype=np.int64).view(np.uint64))

    large = [keys(counted.where(F.col("n") > budget)), *([np.zeros(0, dtype=np.uint64)] * (DEPTH - 2))]
    if len(large[0]):
        longer = _stored(
            rows.mapInArrow(_extensions(large[0]), "depth int, key long, n long").groupBy("depth", "key")
            .agg(F.sum("n").alias("n")).where(F.col("n") > budget),
            "longer",
        )
        large = [large[0], *(keys(longer.where(F.col("depth") == d)) for d in range(2, DEPTH))]
    parts = max(1, -(-total // max(1, budget // 2)))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(parts, TASKS))
    blocks = rows.mapInArrow(_suffixes(parts, large), _BLOCKS)
    nodes = blocks.repartition(tasks, "part").sortWithinPartitions("part", "lang").mapInArrow(
        _subtrees(least), "lang string, phrase string, words int, f long"
    )
    found = nodes.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.sum("f").alias("f")).where(F.col("f") >= least)
    return _stored(found, "phrases"), totals


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's `top` phrases."""
    counts, totals = frequent(docs, least, budget)
    split = F.split("phrase", " ")

    def joined(words, start, length):
        return F.array_join(F.slice(words, start, length), " ")

    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "a", "k", joined(split, 1, F.col("k")).alias("first"), joined(split, F.col("k") + 1, F.col("words") - F.col("k")).alias("rest")
    )
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(
        counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]
    )
    score = F.expr(f"({SCORE} * CAST(a AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) + r)")
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("words") - 1),
        lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: joined(split, i, m)),
    ))
    around = candidates.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a")
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(around, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {INSIDE} * a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    best = left.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score")
    )
