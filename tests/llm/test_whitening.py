import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from passages.llm import eigen, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def cloud(n, d, seed=1):
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    return ((rng.standard_normal((n, d)) * np.linspace(0.5, 0.02, d)) @ turn + 0.3).astype(np.float32)


def expected(vectors, k):
    """Plain numpy: x, sums, deviations in Python integers, eigenvectors of the library."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    y = np.array(x, float) - np.array([s / n for s in sums])
    cov = y.T @ y / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, deviation, y @ axes / np.sqrt(values), values / np.trace(cov)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def check(rows, vectors, ids, k):
    n, deviation, whitened, explained = expected(vectors, k)
    found = {(r.vec_id, r.component): r for r in rows}
    assert sorted(found) == sorted((i, c + 1) for i in ids for c in range(k)) and len(rows) == len(found)
    for c in range(k):
        mine = np.array([found[i, c + 1].whitened for i in ids])
        sign = np.sign(mine @ whitened[:, c])
        assert np.abs(mine - sign * whitened[:, c]).max() < 1e-8
        assert {round(found[i, c + 1].explained / explained[c], 9) for i in ids} == {1.0}
    assert [found[i, 1].deviation for i in ids] == deviation
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1
    assert rows[0].identity_error < 1e-9


def test_report_equals_plain_numpy(spark):
    vectors = cloud(500, 24)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    unusable = [(900, None, 0), (901, [None] + [0.1] * 23, 0), (902, [float("nan")] + [0.1] * 23, 0), (903, [float("inf")] * 24, 0)]
    others = [(904, [], 0), (905, [0.5] * 23, 0), (906, [1e30] * 24, 0)]  # another length, or beyond whole numbers
    mixed = rows + unusable + others
    random.Random(1).shuffle(mixed)
    docs = table(spark, mixed).withColumn("n", F.lit("x")).withColumn("row", F.lit(0)).withColumn("whitened", F.lit(0))
    first = whitening.whitening_report(docs.repartition(6, "vec_id")).collect()
    check(first, vectors, range(500), 8)
    again = whitening.whitening_report(docs.repartition(6, "vec_id")).collect()
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, again), key=str)


def test_fewer_directions_than_components(spark):
    flat = cloud(200, 3)
    check(whitening.whitening_report(table(spark, [(i, v.tolist(), 0) for i, v in enumerate(flat)])).collect(), flat, range(200), 3)
    line = [(i, [i / 7.0, i / 7.0, 0.0, 1.0], 0) for i in range(50)]
    assert {r.component for r in whitening.whitening_report(table(spark, line)).collect()} <= {1, 2}


def test_odd_tables(spark):
    for rows in ([], [(1, None, 0)], [(1, [], 0)], [(1, [0.5, 0.5], 0)], [(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)]):
        assert whitening.whitening_report(table(spark, rows)).count() == 0
    rows = [(None, [0.0, 0.1], 0), (1, [0.5, 0.3], 0), (1, [0.5, 0.3], 0)]
    assert whitening.whitening_report(table(spark, rows)).count() == 3
    wide = [(i, [float(1 << 39) * (i % 3), float(i), -float(1 << 39)], 0) for i in range(5)]
    assert {r.deviation for r in whitening.whitening_report(table(spark, wide)).collect()} == {None}


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 40, 0], [0, 0], [3, 5]], np.int64)
    sums = tuple(x.sum(axis=0).tolist())
    exact = [sum((3 * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    assert whitening.deviations(x, 3, sums) == [v if v < 1 << 63 else None for v in exact] and None in whitening.deviations(x, 3, sums)


@pytest.mark.parametrize("d", [1, 2, 3, 10, 60, 200])
def test_leading_pairs_of_random_matrices(d):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((d, d))
    check_pairs(a @ a.T, 8)


@pytest.mark.parametrize(
    "values", [[3, 3, 3, 3, 1, 1, 0, 0], [1, 1 - 1e-13, 1 - 2e-13, 0.5, 0, 0], [1e9, 1e-3, 1e-9], [0, 0, 0], [5] * 12]
)
def test_clusters_of_equal_values(values):
    turn = np.linalg.qr(np.random.default_rng(2).standard_normal((len(values),) * 2))[0]
    check_pairs((turn * np.array(values, float)) @ turn.T, 8)
    check_pairs(np.diag(np.array(values, float)), 8)


def check_pairs(matrix, k):
    matrix = (matrix + matrix.T) / 2
    values, vectors = eigen.leading_pairs(matrix, k)
    scale = max(np.abs(matrix).max(), 1e-300)
    want = np.linalg.eigvalsh(matrix)[::-1][:k]
    assert np.abs(values - want).max() <= 1e-13 * scale * len(matrix)
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-10
    assert np.abs(matrix @ vectors.T - vectors.T * values).max() <= 1e-12 * scale * len(matrix)
