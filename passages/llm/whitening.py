"""Embedding whitening: vectors on the leading eigenvectors of their covariance, with variance 1.

An entry c is read as the whole number x = floor(1024 * c) + 100000, so that sums are exact.

1. Tasks add up whole numbers; Spark sums them per dimension: n and S.
2. Tasks add up the products of centred vectors x - S/n, a row of the covariance for each dimension; the rows of all tasks meet
   by dimension and are added in the order of tasks, so that a rerun gives the same sums.
3. The covariance, as wide as a vector, goes to the driver: Householder tridiagonalisation, bisection of Sturm counts
   for the leading eigenvalues, inverse iteration for the components (`eigen.py`).
4. Mean and components are broadcast (of the size of a few vectors) and each vector is projected where it lies.
5. The covariance of the projections, by Spark's own centred aggregate, shows how far it is from the identity.

Cases: rows whose vector is null, or holds a null, a non-finite entry or one of LIMIT and beyond (2^40, where
sums of x could leave 64 bits), are left out, as are vectors of another length than most (ties: the shorter; an empty vector has no entry to look at); rows are fitted and returned
one by one, whatever their vec_id (null, or equal to another's); components whose eigenvalue is below RANK of the trace
are no directions of the data and not returned, so equal vectors, or a single one, give no row, as does an empty
table; `deviation` is null where it leaves 64 bits; columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm.eigen import leading_pairs
from passages.llm.storage import stored

SCALE = 1024
SHIFT = 100_000
LIMIT = float(1 << 40)
RANK = 1e-12
COMPONENTS = 8
ROWS = 4_096


@dataclass(frozen=True)
class Whitening:
    """Of n vectors: sums S per dimension, components as rows, their eigenvalues and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float


def whole_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their x as a matrix) of the usable vectors, ROWS rows at a time and one matrix for each length."""
    for first in range(0, len(column), ROWS):
        part = column.slice(first, ROWS)
        valid = part.is_valid().to_numpy(zero_copy_only=False)
        sizes = np.where(valid, part.value_lengths().fill_null(0).to_numpy(), -1)
        entries = part.flatten().to_numpy(zero_copy_only=False).astype(float)
        ends = np.cumsum(np.maximum(sizes, 0))
        for size in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == size)
            c = entries[(ends[rows] - size)[:, None] + np.arange(size)]
            good = (np.abs(c) < LIMIT).all(axis=1)
            yield first + rows[good], np.floor(SCALE * c[good]).astype(np.int64) + SHIFT


def fitted_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """n and the sums per dimension, over vectors of the most frequent length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for _, x in whole_vectors(batch.column("embedding")):
                n, s = sums.get(x.shape[1], (0, 0))
                sums[x.shape[1]] = n + len(x), s + x.sum(axis=0).astype(object)
        for size, (n, s) in sums.items():
            fixed = [pa.array(np.full(size, v, np.int64)) for v in (size, n)]
            exact = pa.array([Decimal(v) for v in s], pa.decimal128(38, 0))
            columns = [fixed[0], pa.array(np.arange(size)), fixed[1], exact]
            yield pa.RecordBatch.from_arrays(columns, ["size", "i", "n", "s"])

    parts = vectors.select("embedding").mapInArrow(run, "size long, i long, n long, s decimal(38,0)")
    totals = stored(parts.groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    most = totals.where("i = 0 and n > 0").orderBy(F.desc("n"), "size").first()
    if most is None:
        return 0, []
    return most.n, [int(r.s) for r in totals.where(F.col("size") == most["size"]).orderBy("i").collect()]


def covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Of the usable vectors, divisor n, centred before multiplying."""
    d = len(sums)
    mean = vectors.sparkSession.sparkContext.broadcast(np.array([s / n for s in sums]))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in whole_vectors(batch.column("embedding")):
                if x.shape[1] == d:
                    y = x - mean.value
                    total = (0 if total is None else total) + y.T @ y
        if total is not None:
            rows = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), d).cast(pa.list_(pa.float64()))
            task = pa.array(np.full(d, TaskContext.get().partitionId(), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), task, rows], ["i", "task", "row"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = -1, np.zeros(0)
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row")):
                if i != number and number >= 0:
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([total])], ["i", "row"])
                total = total + row.values.to_numpy() if i == number else row.values.to_numpy()
                number = i
        if number >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([total])], ["i", "row"])

    parts = vectors.select("embedding").mapInArrow(products, "i long, task long, row array<double>")
    met = parts.repartition("i").sortWithinPartitions("i", "task").mapInArrow(added, "i long, row array<double>")
    matrix = np.array([r.row for r in sorted(met.collect(), key=lambda r: r.i)]) / n
    return (matrix + matrix.T) / 2


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of vectors (embedding); None without a usable vector."""
    n, sums = fitted_sums(vectors)
    if not n:
        return None
    matrix = covariance(vectors, n, sums)
    trace = float(np.trace(matrix))
    values, vectors_ = leading_pairs(matrix, components)
    some = values > RANK * trace
    return Whitening(n, tuple(sums), vectors_[some], values[some], trace)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum of (n * x - S)^2 for each row, from whole numbers near the mean: x = m + y, S = n * m + r."""
    m = np.array([s // n for s in sums], np.int64)
    r = np.array([s % n for s in sums], np.int64)
    y = x - m
    kind = np.int64 if int(np.abs(y).max(initial=0)) ** 2 * len(sums) < 1 << 62 and n * len(sums) < 1 << 30 else object
    y, r = y.astype(kind), r.astype(kind)
    squares, mixed, rest = (y * y).sum(axis=1).tolist(), (y * r).sum(axis=1).tolist(), int((r * r).sum())
    exact = [n * n * a - 2 * n * b + rest for a, b in zip(squares, mixed)]
    return [v if v < 1 << 63 else None for v in exact]


def transform(vectors: DataFrame, whitening: Whitening) -> DataFrame:
    """vec_id, deviation and whitened (one entry per component) of every usable vector."""
    d = len(whitening.sums)
    n, sums = whitening.n, whitening.sums
    factors = whitening.components / np.sqrt(whitening.values)[:, None]
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([s / n for s in sums]), factors))
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, turn = shared.value
        for batch in batches:
            for rows, x in whole_vectors(batch.column("embedding")):
                if x.shape[1] == d and len(x):
                    out = pa.array(((x - mean) @ turn.T).ravel())
                    columns = [
                        batch.column("vec_id").take(pa.array(rows)),
                        pa.array(deviations(x, n, sums), pa.int64()),
                        pa.FixedSizeListArray.from_arrays(out, len(turn)).cast(pa.list_(pa.float64())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "whitened"])

    schema = f"vec_id {kind}, deviation long, whitened array<double>"
    return vectors.select("vec_id", "embedding").mapInArrow(run, schema)


def identity_error(whitened: DataFrame, components: int) -> float:
    """The largest entry of the covariance of the whitened vectors less the identity."""
    pairs = [(a, b) for a in range(components) for b in range(a, components)]
    row = whitened.agg(*(F.covar_pop(F.col("whitened")[a], F.col("whitened")[b]) for a, b in pairs)).first()
    return max((abs(v - (a == b)) for (a, b), v in zip(pairs, row)), default=0.0)


def whitening_report(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    whitening = fit(vectors, components)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    if whitening is None or not len(whitening.values):
        return vectors.sparkSession.createDataFrame([], schema)
    found = stored(transform(vectors, whitening))
    error = identity_error(found, len(whitening.values))
    shares = F.array(*(F.lit(float(v / whitening.trace)) for v in whitening.values))
    rows = found.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "entry"))
    return rows.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(whitening.n).cast("long").alias("n"),
        "deviation",
        F.col("entry").alias("whitened"),
        shares[F.col("place")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
