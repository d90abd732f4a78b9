import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passages.operators import quantized, topk
from passages.operators.quantized import build_quantized_index, knn_quantized, scored_candidates
from passages.operators.vector import knn_join
from test_vector import DIM, brute, data, found, points, queries  # noqa: F401


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
@pytest.mark.parametrize("k", [1, 5, 500])
def test_hits_are_those_of_the_exact_search(spark, data, metric, k):  # noqa: F811
    corpus, wanted = data
    stored, ask = points(spark, corpus).repartition(5), queries(spark, wanted)
    hits = knn_quantized(ask, build_quantized_index(stored, DIM, metric), stored, k, metric, DIM)
    assert found(hits) == brute(corpus, wanted, k, metric)
    exact = knn_join(ask, stored, k, metric, DIM)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, exact.collect()))


@pytest.mark.parametrize("cells", [topk.BROADCAST_CELLS, 3 * DIM])
def test_slices_of_queries_and_of_candidates(spark, data, cells, monkeypatch):  # noqa: F811
    monkeypatch.setattr(topk, "BROADCAST_CELLS", cells)
    monkeypatch.setattr(topk, "BROADCAST_HITS", 20)
    monkeypatch.setattr(quantized, "ROWS", 9)
    corpus, wanted = data
    stored = points(spark, corpus).coalesce(2)
    hits = knn_quantized(queries(spark, wanted), build_quantized_index(stored, DIM), stored, 5, "cosine", DIM)
    assert found(hits) == brute(corpus, wanted, 5, "cosine")


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
def test_few_rows_are_scored_twice_though_spread_evenly(spark, metric):
    vectors = np.random.default_rng(4).standard_normal((1_500, 32))
    stored, ask = points(spark, vectors.tolist()), queries(spark, vectors[:60].tolist())
    index = build_quantized_index(stored, 32, metric)
    scored = scored_candidates(ask, index, stored, 5, metric, 32)
    assert scored.count() <= 0.05 * 1_500 * 60
    hits = knn_quantized(ask, index, stored, 5, metric, 32)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, knn_join(ask, stored, 5, metric, 32).collect()))


def test_vectors_do_not_move(spark, data):  # noqa: F811
    corpus, wanted = data
    stored = points(spark, corpus)
    scored = scored_candidates(queries(spark, wanted), build_quantized_index(stored, DIM), stored, 5, "cosine", DIM)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_odd_tables(spark):
    one = points(spark, [[1.0] * DIM, None, [float("nan")] * DIM, [float("inf")] + [1.0] * (DIM - 1)])
    index = build_quantized_index(one, DIM)
    assert index.count() == 1
    assert found(knn_quantized(queries(spark, [[2.0] * DIM, None, [1.0]]), index, one, 3, "cosine", DIM)) == {0: [0]}
    assert knn_quantized(queries(spark, [[2.0] * DIM]), index, one, 0, "cosine", DIM).count() == 0
    assert knn_quantized(queries(spark, [None]), index, one, 2, "cosine", DIM).count() == 0
    none = one.limit(0)
    assert knn_quantized(queries(spark, [[2.0] * DIM]), build_quantized_index(none, DIM), none, 2, "cosine", DIM).count() == 0
    with pytest.raises(ValueError):
        build_quantized_index(one, DIM, "manhattan")


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.sampled_from(["dot", "euclid"]), st.integers(0, 10_000))
def test_scores_lie_within_their_bounds(dim, n, metric, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) * 10.0 ** rng.integers(-3, 4, (n, 1))
    x[rng.random((n, dim)) < 0.2] = 0
    q = rng.standard_normal((3, dim))
    codes, scale, error = quantized.quantized_rows(x)
    bounds = pa.py_buffer((dim * np.arange(n + 1)).astype(np.int32))
    packed = pa.Array.from_buffers(pa.binary(), n, [None, bounds, pa.py_buffer(codes)])
    columns = [packed, pa.array(scale), pa.array(error), pa.array((x * x).sum(axis=1))]
    table = pa.RecordBatch.from_arrays(columns, ["codes", "scale", "error", "square"])
    for batch in (table, table.slice(n // 2)):
        middle, reach = quantized.bounds_of(batch, q, metric)
        part = x[n - len(batch) :]
        true = part @ q.T if metric == "dot" else 2 * part @ q.T - (part * part).sum(axis=1)[:, None]
        assert (np.abs(true - middle) <= reach + 1e-9 * np.abs(true)).all()


def test_scores_of_a_task_are_bounded_however_many_queries(spark, data, monkeypatch):  # noqa: F811
    whole = quantized.bounds_of

    def small(table, q, metric):
        if table.num_rows * len(q) > 40:
            raise ValueError("too many scores at a time")
        return whole(table, q, metric)

    monkeypatch.setattr(quantized, "bounds_of", small)
    monkeypatch.setattr(quantized, "ROWS", 9)
    monkeypatch.setattr(quantized, "CELLS", 40, raising=False)
    monkeypatch.setattr(quantized, "ROOM", 12, raising=False)
    corpus, wanted = data
    stored = points(spark, corpus).coalesce(2)
    for metric in ("cosine", "euclid"):
        hits = knn_quantized(queries(spark, wanted), build_quantized_index(stored, DIM, metric), stored, 5, metric, DIM)
        assert found(hits) == brute(corpus, wanted, 5, metric)


def test_few_members_of_a_crowd_of_near_copies_are_candidates(spark):
    rng = np.random.default_rng(7)
    centre = rng.standard_normal((6, 32))
    vectors = (np.repeat(centre, 300, axis=0) + 0.05 * rng.standard_normal((1_800, 32))).tolist()
    stored, ask = points(spark, vectors), queries(spark, vectors[::20])
    for metric in ("cosine", "dot", "euclid"):
        index = build_quantized_index(stored, 32, metric)
        exact = sorted(map(tuple, knn_join(ask, stored, 5, metric, 32).collect()))
        assert sorted(map(tuple, knn_quantized(ask, index, stored, 5, metric, 32).collect())) == exact
        assert scored_candidates(ask, index, stored, 5, metric, 32).count() <= 10 * 90
        plain = index.drop("fine", "rest")
        assert sorted(map(tuple, knn_quantized(ask, plain, stored, 5, metric, 32).collect())) == exact


def test_slices_of_candidates_do_not_travel_together(spark, data, monkeypatch):  # noqa: F811
    monkeypatch.setattr(topk, "BROADCAST_HITS", 20)
    corpus, wanted = data
    stored = points(spark, corpus)
    index = build_quantized_index(stored, DIM)
    scored = scored_candidates(queries(spark, wanted), index, stored, 5, "cosine", DIM)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert scored.count() > 20 and "BroadcastHashJoin" not in plan


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.sampled_from(["dot", "euclid"]), st.integers(0, 10_000))
def test_scores_lie_within_their_finer_bounds(dim, n, metric, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) * 10.0 ** rng.integers(-3, 4, (n, 1))
    x[rng.random((n, dim)) < 0.2] = 0
    q = rng.standard_normal((3, dim))
    codes, scale, error = quantized.quantized_rows(x)
    fine, rest = quantized.fine_rows(x, codes, scale)
    assert (rest <= scale / (4 * quantized.STEPS) * np.sqrt(dim) * 1.001).all()
    ends = pa.py_buffer((dim * np.arange(n + 1)).astype(np.int32))
    packed, finer = (pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(c)]) for c in (codes, fine))
    columns = [packed, pa.array(scale), pa.array((x * x).sum(axis=1)), finer, pa.array(rest)]
    table = pa.RecordBatch.from_arrays(columns, ["codes", "scale", "square", "fine", "rest"])
    row, query = (a.ravel() for a in np.indices((n, 3)))
    middle, reach = quantized.Finer(table, dim, metric)(q, row, query)
    true = (x @ q.T if metric == "dot" else 2 * x @ q.T - (x * x).sum(axis=1)[:, None])[row, query]
    assert (np.abs(true - middle) <= reach + 1e-12 * np.abs(true)).all()
