"""Exact top-k by integer inner product, block at a time.

Rows are cut into blocks of consecutive rows of a scan task. A block keeps its vectors (the forward index) and, per
component ("term"), the greatest and least value, from which a query's best possible score in the block follows as
a sum over components. Each query visits blocks in the order of these bounds and stops once a bound lies below its
k-th score. Work is dealt out as cells of `CHUNK` queries and `SHARD` blocks, so no task holds more than one cell;
every cell returns at most k rows a query, from which a window takes the final k.

Defined results: rows with a null id, a null vector or null or non-finite components take no part; shorter vectors
count as padded with 0; rows that share the query's id are its own and no candidates; an id that occurs several
times among the queries asks with its least vector, while as candidates all its rows count; ties go to the smaller
id; fewer than k candidates give fewer rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import scratch_path

K = 5
BLOCK, SHARD, CHUNK = 256, 64, 2048
_BLOCKS = "block long, width int, ids binary, vectors binary"


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def usable(table: DataFrame) -> DataFrame:
    """vec_id and the integer vector of the rows that take part."""
    number = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x))
    return table.select("vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & number
    ).select("vec_id", quantised(F.col("embedding")).alias("v"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = 0
    for batch in batches:
        ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
        for low in range(0, len(ids), BLOCK):
            part = vectors[low : low + BLOCK]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([n], pa.int64()), pa.array([part.shape[1]], pa.int32()),
                    pa.array([ids[low : low + BLOCK].astype("<i8").tobytes()], pa.binary()),
                    pa.array([part.astype("<i8").tobytes()], pa.binary()),
                ],
                ["block", "width", "ids", "vectors"],
            )
            n += 1


def _padded(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _search(k: int):
    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        found = {"query_id": [], "vec_id": [], "score": []}
        if blocks.num_rows and queries.num_rows:
            ids = [np.frombuffer(b, dtype="<i8") for b in blocks.column("ids").to_pylist()]
            forward = [
                np.frombuffer(b, dtype="<i8").reshape(len(i), w)
                for b, w, i in zip(blocks.column("vectors").to_pylist(), blocks.column("width").to_pylist(), ids)
            ]
            asked = _matrix(queries.column("v").combine_chunks())
            width = max(asked.shape[1], *(f.shape[1] for f in forward))
            asked, forward = _padded(asked, width), [_padded(f, width) for f in forward]
            largest = max(int(np.abs(f).max(initial=0)) for f in forward) * int(np.abs(asked).max(initial=0)) * width
            # Doubles multiply faster and are exact up to 2^53.
            kind = np.float64 if largest < 2**53 else np.int64
            asked, forward = asked.astype(kind), [f.astype(kind) for f in forward]
            greatest, least = np.array([f.max(0) for f in forward]), np.array([f.min(0) for f in forward])
            bounds = np.maximum(asked, 0) @ greatest.T + np.minimum(asked, 0) @ least.T
            for own, q, bound in zip(queries.column("vec_id").to_numpy(), asked, bounds):
                best_id, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=kind)
                for b in np.argsort(-bound, kind="stable"):
                    if len(best) == k and bound[b] < best[-1]:
                        break
                    score = forward[b] @ q
                    other = ids[b] != own
                    if len(best) == k:
                        other &= score >= best[-1]
                    if not other.any():
                        continue
                    every, all_ids = np.concatenate([best, score[other]]), np.concatenate([best_id, ids[b][other]])
                    order = np.lexsort((all_ids, -every))[:k]
                    best, best_id = every[order], all_ids[order]
                found["query_id"] += [own] * len(best)
                found["vec_id"] += best_id.tolist()
                found["score"] += [int(s) for s in best]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in found.items()})

    return run


def search(table: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by `every`."""
    spark = table.sparkSession
    path = scratch_path(spark, "blocks")
    rows = usable(table)
    rows.mapInArrow(_blocks, _BLOCKS).write.parquet(path)
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    shards = max(1, -(-blocks.count() // SHARD))
    chunks = max(1, -(-rows.where(F.col("vec_id") % every == 0).count() // CHUNK))
    blocks = blocks.withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards))).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    )
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    )
    found = (
        blocks.groupBy("chunk", "shard").cogroup(queries.groupBy("chunk", "shard"))
        .applyInArrow(_search(k), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
