"""Whitened components of embeddings, from exact integer sums to rotated columns.

Every entry c becomes the integer x = floor(1024 * c) + 100000. One pass gives the number n of vectors and each
dimension's sum S, exactly; a second gives the scatter of x - S / n, centred before it is multiplied, as one d x d
matrix a batch that Spark adds up. The driver sees that matrix and no row: its pivoted Cholesky factor stops where
nothing is left but rounding, and one-sided Jacobi rotations make the columns of the triangular factor orthogonal.
The squared norms of the rotated columns are then the eigenvalues of the scatter, and the columns divided by their
norms its eigenvectors. A last pass projects every vector; the whitened columns are written, and their covariance,
again centred before it is multiplied, gives the distance to the identity.

Memory: d x d doubles on the driver and a batch of `ROWS` vectors in a task, whatever the number of rows.

Defined results: rows with a null vector or with null or non-finite entries are left out; a null vec_id is kept;
repeated rows count as often as they occur; shorter vectors count as padded with entries 0 to the longest length;
entries are held within +-2^40 / 1024; a deviation beyond 64 bits is null; directions without variance (fewer
distinct vectors than components, or constant dimensions) give components with explained 0 and whitened null, and
take no part in the identity error, which is null if there is no other; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path

SCALE, SHIFT, MOST = 1024, 100_000, 1 << 40
COMPONENTS = 8
# Vectors that a task turns into numbers at once.
ROWS = 4096
# Sweeps of rotations at most; a handful suffices.
SWEEPS = 60


def usable(table: DataFrame) -> DataFrame:
    """vec_id and embedding, as doubles, of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return table.where(F.col("embedding").isNotNull() & finite).select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")
    )


def integers(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """The x of every vector, padded to `width`."""
    lengths = np.asarray(column.value_lengths())
    width = int(lengths.max(initial=0)) if width is None else width
    values = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    values = np.clip(values, -MOST, MOST).astype(np.int64) + SHIFT
    if (lengths == width).all():
        return values.reshape(len(column), width)
    out = np.full((len(column), width), SHIFT, dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            yield batch.slice(low, ROWS)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and dimension the sum of x - SHIFT; padding adds nothing to it."""
    for batch in _parts(batches):
        x = integers(batch.column("embedding")) - SHIFT
        yield pa.RecordBatch.from_arrays(
            [pa.array([batch.num_rows]), pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64()))], ["n", "sums"]
        )


def _numerators(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, in 64 bits where they suffice, else as Python's integers."""
    largest = max(int(np.abs(x).max(initial=0)) * n, max((abs(int(s)) for s in sums), default=0))
    if largest < 1 << 61:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _deviations(numerators: np.ndarray) -> list[int | None]:
    largest = max(1, int(np.abs(numerators).max(initial=0)))
    if largest**2 * max(1, numerators.shape[1]) < 1 << 63:
        square = numerators.astype(np.int64)
        return (square * square).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in numerators]
    return [v if v < 1 << 63 else None for v in exact]


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """L with scatter = L L' up to rounding, one column per pivot; rows stand in the order of `scatter`."""
    size = len(scatter)
    rest, left = scatter.astype(np.float64).copy(), np.ones(size, dtype=bool)
    columns: list[np.ndarray] = []
    floor = size * np.finfo(np.float64).eps * max(float(np.diag(scatter).max(initial=0)), 0.0)
    for _ in range(size):
        at = int(np.argmax(np.where(left, np.diag(rest), -np.inf)))
        if not rest[at, at] > floor:
            break
        column = np.where(left, rest[:, at], 0.0) / np.sqrt(rest[at, at])
        rest -= np.outer(column, column)
        left[at] = False
        columns.append(column)
    return np.array(columns).T.reshape(size, len(columns))


def rotated(factor: np.ndarray) -> np.ndarray:
    """The columns of the factor made orthogonal to each other by one-sided Jacobi rotations.

    A sweep goes through all pairs in rounds of disjoint pairs, whose rotations are done at once.
    """
    count = factor.shape[1]
    w = np.array(factor, dtype=np.float64)
    if count < 2:
        return w
    least = np.finfo(np.float64).eps * len(factor)
    seats = np.arange(count + count % 2)
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(seats) - 1):
            i, j = seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1]
            real = (i < count) & (j < count)
            i, j = i[real], j[real]
            a, b = w[:, i], w[:, j]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            turn = np.abs(ab) > least * np.sqrt(aa * bb)
            if turn.any():
                turned = True
                i, j, a, b = i[turn], j[turn], a[:, turn], b[:, turn]
                zeta = (bb[turn] - aa[turn]) / (2 * ab[turn])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                w[:, i], w[:, j] = c * (a - t * b), c * (b + t * a)
            seats = np.concatenate([seats[:1], np.roll(seats[1:], 1)])
        if not turned:
            break
    return w


def components(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a scatter matrix, those without variance left out."""
    w = rotated(pivoted_cholesky(scatter))
    norms = np.linalg.norm(w, axis=0)
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order] ** 2, w[:, order] / norms[order]


def whiten(table: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: `most` rows at most a vector."""
    spark = table.sparkSession
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(table)
    partial = rows.mapInArrow(_sums, "n long, sums array<long>")
    totals = (
        partial.select("n", F.posexplode_outer("sums").alias("i", "s")).groupBy("i")
        .agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    )
    by_dimension = {r["i"]: r["s"] for r in totals if r["i"] is not None}
    width = len(by_dimension)
    if not width:
        return spark.createDataFrame([], out)
    # Every batch with a vector of full length or shorter ones reports its rows under dimension 0 or under none.
    n = sum(r["n"] for r in totals if r["i"] in (0, None))
    sums = np.array([by_dimension[i] + SHIFT * n for i in range(width)], dtype=object)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in _parts(batches):
            z = (_numerators(integers(batch.column("embedding"), width), n, sums) / n).astype(np.float64)
            total += z.T @ z
        columns = [pa.array(np.arange(width, dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["i", "row"])

    added = (
        rows.mapInArrow(scatter, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
        .groupBy("i", "j").agg(F.sum("v").alias("v")).groupBy("i")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda e: e["v"]).alias("row"))
    )
    matrix = np.zeros((width, width))
    for r in added.toLocalIterator():
        matrix[r["i"]] = r["row"]
    matrix = (matrix + matrix.T) / 2
    values, vectors = components(matrix)
    count = min(most, width)
    found = min(count, len(values))
    trace = float(np.trace(matrix))
    shares = [float(v) / trace for v in values[:found]] + [0.0] * (count - found)
    # x - S / n projected on a component, over the root of the covariance's eigenvalue, which is the scatter's over n.
    projection = vectors[:, :found] / np.sqrt(values[:found] / n)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            numerators = _numerators(integers(batch.column("embedding"), width), n, sums)
            w = (numerators / n).astype(np.float64) @ projection
            columns = [pa.array(w[:, k]) if k < found else pa.nulls(len(w), pa.float64()) for k in range(count)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(_deviations(numerators), pa.int64()), *columns],
                ["vec_id", "deviation", *(f"w{k}" for k in range(count))],
            )

    kind = table.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, deviation long" + "".join(f", w{k} double" for k in range(count))
    path = scratch_path(spark, "whitened")
    rows.mapInArrow(project, schema).write.parquet(path)
    wide = spark.read.schema(schema).parquet(path)
    error = None
    if found:
        pairs = [(a, b) for a in range(found) for b in range(a, found)]
        got = wide.agg(*(F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs)).first()
        error = max(abs(got[f"c{a}_{b}"] - (a == b)) for a, b in pairs)
    each = F.explode(
        F.array(*(
            F.struct(F.lit(k + 1).alias("component"), F.col(f"w{k}").alias("whitened"), F.lit(shares[k]).alias("explained"))
            for k in range(count)
        ))
    )
    return wide.select("vec_id", "deviation", each.alias("c")).select(
        "vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
