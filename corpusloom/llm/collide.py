"""Near-duplicate vectors by collision-counting projections.

Two vectors of cosine 0.93 lie at most D = sqrt(2 - 2 * 0.93) apart on the unit sphere, so along one of d orthonormal
directions they differ by D / sqrt(d) on average. Projections are sorted per direction; a query's window reaches
twice that difference to both sides, and every vector inside the window of a direction is one collision. A pair
whose collisions number enough is verified by its cosine in double precision. The number asked for is calibrated:
with all d directions counted, a linked pair can miss at most a quarter of them, so none is lost; with `DIRECTIONS`
of more, the miss count of a pair just at the bound is binomial and exceeds what is allowed once in 10^9.

Pairs are counted within cells. A cell starts as all vectors of one label. One with more than `LEAF` vectors is cut
at the mean of the direction that spreads it most: each vector is at home on its side, and a query also goes to the
other side if a window of 2.5 average differences reaches across, so a pair at the bound is lost at such a cut with
a probability of about 0.001, and a closer one with less. Cells that no direction spreads beyond the window (a group of near copies, however
large) stay whole. Cells are then compared in tiles of `HOME` vectors at home and `ASK` queries, which is what one
task holds at once. Every ordered pair meets in exactly one tile, that of the second one's home, so the tiles' link
counts add up, and a tile returns a count per query and a spanning forest of its links instead of its pairs.

Equal vectors of a label are one from the start and weigh as many links as there are copies.

Defined results: rows whose label or vector is null, or whose vector is zero or holds null or non-finite entries,
link with nothing and are kept; shorter vectors count as padded with 0; repeated rows and equal ids are ordinary
copies and link with each other; a null vec_id links, counts, takes the smallest id of its group and is kept only if
there is none; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import join_back, keyed, lookup, scratch_path
from .near import components

COSINE = 0.93
# Directions counted at most, and those that cells are cut along.
DIRECTIONS, CUTS = 128, 24
# Vectors of a cell that is not cut further; vectors at home and queries of one tile; queries counted together.
LEAF, HOME, ASK, TOGETHER = 8192, 4096, 4096, 256
# Half a window, in average differences of a pair at the bound: of a collision and of a cut.
REACH, CUT_REACH = 2.0, 2.5
# The least spread, in half windows, that a cut needs.
LEAST_SPREAD = 0.8
# Chance that a pair at the bound misses too often, and candidate pairs verified together.
LOST, VERIFIED = 1e-9, 1 << 15
_FOUND = "a binary, b binary, n long"


def window(width: int, cosine: float = COSINE, reach: float = REACH) -> float:
    return reach * math.sqrt((2 - 2 * cosine) / width)


def misses(width: int, counted: int) -> int:
    """Directions that a linked pair may miss of those counted."""
    if counted == width:
        return int(width / REACH**2)
    p, total = math.erfc(REACH / math.sqrt(2)), 0.0
    for k in range(counted + 1):
        total += math.comb(counted, k) * p**k * (1 - p) ** (counted - k)
        if 1 - total < LOST:
            return k
    return counted


def directions(width: int) -> np.ndarray:
    """Orthonormal directions as columns, the same in every process."""
    rotation = np.linalg.qr(np.random.default_rng(20241107).normal(size=(width, width)))[0]
    return rotation[:, : min(width, DIRECTIONS)]


def _units(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a direction, their unit vectors), padded to `width`."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = values
    usable = np.isfinite(out).all(axis=1)
    out[~usable] = 0
    # Divided by the largest entry first, so that squares neither vanish nor overflow.
    largest = np.abs(out).max(axis=1, initial=0)
    rows = np.flatnonzero(largest > 0)
    unit = out[rows] / largest[rows, None]
    return rows, unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True)) + 0.0


def _prepare(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = directions(width)[:, :CUTS]
        for batch in batches:
            n = batch.num_rows
            keys, vectors, at = [None] * n, [None] * n, [None] * n
            label = batch.column("label").to_pylist()
            rows, unit = _units(batch.column("embedding"), width)
            places = (unit @ axes).astype(np.float32)
            for row, u, place in zip(rows.tolist(), unit, places):
                if label[row] is not None:
                    # Equal vectors have equal units; vectors of one direction count as equal, which their cosine is.
                    vectors[row] = u.tobytes()
                    keys[row] = hashlib.blake2b(vectors[row] + repr(label[row]).encode(), digest_size=16).digest()
                    at[row] = place
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), pa.array(keys, pa.binary()), batch.column("label"),
                    pa.array(vectors, pa.binary()), pa.array(at, pa.list_(pa.float32())),
                ],
                ["vec_id", "key", "label", "unit", "at"],
            )

    return run


def _forest(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of the linked rows; `parent` holds each row's root."""
    while True:
        left, right = parent[a], parent[b]
        apart = left != right
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(left, right)[apart], np.minimum(left, right)[apart])
        while True:
            further = parent[parent]
            if (further == parent).all():
                break
            parent[:] = further


def _collisions(units: np.ndarray, home: np.ndarray, ask: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, homes) of verified links, as row numbers, some queries at a time."""
    width = units.shape[1]
    axes = directions(width)
    counted, reach = axes.shape[1], window(width, cosine) + 1e-9
    allowed = misses(width, counted)
    asked, held = units[ask] @ axes, units[home] @ axes
    small = np.uint16 if len(home) < 1 << 15 else np.uint32
    rank = np.empty((counted, len(home)), dtype=small)
    low, size = np.empty((counted, len(ask)), dtype=small), np.empty((counted, len(ask)), dtype=small)
    for j in range(counted):
        order = np.argsort(held[:, j], kind="stable")
        rank[j, order] = np.arange(len(home), dtype=small)
        inside = held[order, j]
        first = np.searchsorted(inside, asked[:, j] - reach, side="left")
        low[j] = first
        size[j] = np.searchsorted(inside, asked[:, j] + reach, side="right") - first
    for begin in range(0, len(ask), TOGETHER):
        end = min(len(ask), begin + TOGETHER)
        missed = np.zeros((end - begin, len(home)), dtype=np.uint8)
        for j in range(counted):
            # Unsigned: a rank below the window wraps round and is no collision either.
            missed += (rank[j] - low[j, begin:end, None]) >= size[j, begin:end, None]
        q, h = np.nonzero((missed <= allowed) & (ask[begin:end, None] != home))
        q, h = ask[begin + q], home[h]
        linked = np.zeros(len(q), dtype=bool)
        for i in range(0, len(q), VERIFIED):
            part = slice(i, i + VERIFIED)
            linked[part] = np.einsum("ij,ij->i", units[q[part]], units[h[part]]) >= cosine
        yield q[linked], h[linked]


def _tiles(cosine: float):
    def tile(rows: list[tuple[bytes, bytes, int, bool, bool]]) -> pa.RecordBatch | None:
        home = np.flatnonzero([r[3] for r in rows])
        ask = np.flatnonzero([r[4] for r in rows])
        if not len(home) or not len(ask):
            return None
        units = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.float64).reshape(len(rows), -1)
        copies = np.array([r[2] for r in rows], dtype=np.int64)
        parent, links = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64)
        for q, h in _collisions(units, home, ask, cosine):
            np.add.at(links, q, copies[h])
            _forest(parent, q, h)
        counted, joined = np.flatnonzero(links), np.flatnonzero(parent != np.arange(len(rows)))
        a = [rows[i][0] for i in counted] + [rows[i][0] for i in joined]
        b = [None] * len(counted) + [rows[parent[i]][0] for i in joined]
        n = links[counted].tolist() + [None] * len(joined)
        columns = [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("tile", "key", "unit", "copies", "home", "ask")]
            for row in zip(*columns):
                if row[0] != name:
                    if (out := tile(held)) is not None:
                        yield out
                    held, name = [], row[0]
                held.append(row[1:])
        if (out := tile(held)) is not None:
            yield out

    return run


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cells(reps: DataFrame, cuts: int, reach: float, leaf: int = LEAF) -> DataFrame:
    """(cell, key, home) of the vectors (label, key, at): cells cut until they are small or spread too little."""
    rows = reps.select(F.xxhash64("label").alias("cell"), "key", F.lit(True).alias("home"), "at")
    done = []
    while True:
        home = [F.when(F.col("home"), F.get("at", F.lit(j)).cast("double")) for j in range(cuts)]
        spreads = F.array(*(
            F.struct(F.stddev_pop(h).alias("spread"), F.lit(j).alias("axis"), F.avg(h).alias("mean")) for j, h in enumerate(home)
        ))
        best = F.array_max(spreads)
        wide = rows.groupBy("cell").agg(F.count_if("home").alias("homes"), best.alias("best")).where(
            (F.col("homes") > leaf) & (F.col("best.spread") > LEAST_SPREAD * reach)
        ).select("cell", "best.axis", "best.mean")
        wide = _stored(wide, "wide")
        if wide.isEmpty():
            done.append(rows.select("cell", "key", "home"))
            break
        known = lookup(rows, wide, ["cell"], "left")
        done.append(_stored(known.where("axis IS NULL").select("cell", "key", "home"), "cells"))
        place = F.get("at", F.col("axis")).cast("double") - F.col("mean")
        sides = F.filter(
            F.array(
                F.struct(F.lit(0).alias("side"), (F.col("home") & (place < 0)).alias("home"), (place < reach).alias("goes")),
                F.struct(F.lit(1).alias("side"), (F.col("home") & (place >= 0)).alias("home"), (place >= -reach).alias("goes")),
            ),
            lambda s: s["goes"],
        )
        cut = known.where("axis IS NOT NULL").select("cell", "key", "at", F.explode(sides).alias("s"))
        rows = _stored(cut.select(F.xxhash64("cell", "s.side").alias("cell"), "key", "s.home", "at"), "cut")
    out = done[0]
    for frame in done[1:]:
        out = out.union(frame)
    return out


def tiles(placed: DataFrame, home: int = HOME, ask: int = ASK) -> DataFrame:
    """(tile, key, home, ask) from (cell, key, home): blocks of homes against blocks of all the cell's vectors."""
    sizes = placed.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("all")).where("homes > 0 AND all > 1")
    sizes = sizes.select(
        "cell", F.ceil(F.col("homes") / home).cast("int").alias("hs"), F.ceil(F.col("all") / ask).cast("int").alias("qs")
    )
    own = lookup(placed, _stored(sizes, "sizes"), ["cell"]).withColumns({
        "h": F.pmod(F.xxhash64("key", F.lit(1)), F.col("hs")).cast("int"), "q": F.pmod(F.xxhash64("key", F.lit(2)), F.col("qs")).cast("int"),
    })
    pair = "struct({0} AS h, {1} AS q)"
    asks = F.expr(f"transform(sequence(0, hs - 1), x -> {pair.format('x', 'q')})")
    holds = F.expr(f"transform(sequence(0, qs - 1), x -> {pair.format('h', 'x')})")
    every = F.when(F.col("home"), F.array_union(asks, holds)).otherwise(asks)
    return own.select("cell", "key", "home", "h", "q", F.explode(every).alias("t")).select(
        F.xxhash64("cell", "t.h", "t.q").alias("tile"), "key", (F.col("home") & (F.col("h") == F.col("t.h"))).alias("home"),
        (F.col("q") == F.col("t.q")).alias("ask"),
    )


def link(table: DataFrame, cosine: float = COSINE, leaf: int = LEAF, home: int = HOME, ask: int = ASK) -> DataFrame:
    """vec_id, n_links, component_id and kept (vec_id is its component's smallest) of every row."""
    kind = table.schema["vec_id"].dataType.simpleString()
    label = table.schema["label"].dataType.simpleString()
    rows = table.select("vec_id", "label", F.transform("embedding", lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))).alias("embedding"))
    width = max(1, rows.agg(F.max(F.size("embedding"))).first()[0] or 0)
    prepared = _stored(
        rows.mapInArrow(_prepare(width), f"vec_id {kind}, key binary, label {label}, unit binary, at array<float>"), "vectors"
    )
    reps = _stored(
        prepared.where("key IS NOT NULL").groupBy("key").agg(
            F.count("*").alias("copies"), F.min("vec_id").alias("low"), F.first("label").alias("label"),
            F.first("unit").alias("unit"), F.first("at").alias("at"),
        ),
        "reps",
    )
    reach = window(width, cosine, CUT_REACH) + 1e-6
    placed = tiles(cells(reps.select("label", "key", "at"), min(width, CUTS), reach, leaf), home, ask)
    placed = join_back(placed, reps.select("key", "unit", "copies"), ["key"])
    found = _stored(keyed(placed, "tile").sortWithinPartitions("tile").mapInArrow(_tiles(cosine), _FOUND), "found")
    links = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "key")
    groups = components(found.where("b IS NOT NULL").select("a", "b"))
    known = reps.select("key", "copies", "low").join(links, "key", "left").join(groups, "key", "left")
    known = known.withColumn("component", F.coalesce("component", "key"))
    least = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = join_back(known, least, ["component"]).select(
        "key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"
    )
    # Rows that link with nothing get keys of another length, so that they do not gather in one partition.
    apart = F.concat(F.unhex(F.md5(F.coalesce(F.col("vec_id").cast("string"), F.lit("")))), F.lit(b"-"))
    own = F.coalesce("component_id", "vec_id")
    return join_back(prepared.select("vec_id", F.coalesce("key", apart).alias("key")), known, ["key"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
        F.coalesce(F.col("vec_id") == own, own.isNull()).alias("kept"),
    )
