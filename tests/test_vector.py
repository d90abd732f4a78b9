import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passages.operators import topk
from passages.operators.vector import (
    dense_scorer,
    knn_join,
    knn_lsh,
    of_length,
    semantic_search,
    split_by_dim,
    vector_topk,
)
from passages.plans.ingest import ingest_fixed

DIM = 8


def points(spark, vectors):
    rows = [(i, v, f"text {i}", None if i % 2 else "s") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, embedding array<float>, text string, source string")


def queries(spark, vectors):
    return spark.createDataFrame(list(enumerate(vectors)), "query_id long, embedding array<float>")


def value(p, q, metric):
    p, q = np.asarray(p, np.float32).astype(float), np.asarray(q, np.float32).astype(float)
    if metric == "dot":
        return float(p @ q)
    if metric == "euclid":
        return float(np.linalg.norm(p - q))
    length = np.linalg.norm(p) * np.linalg.norm(q)
    return float(p @ q / length) if length else 0.0


def brute(corpus, wanted, k, metric):
    sign = 1 if metric == "euclid" else -1
    out = {}
    for q, vector in enumerate(wanted):
        if vector is None or len(vector) != DIM:
            continue
        scored = [
            (sign * round(value(p, vector, metric), 6), i)
            for i, p in enumerate(corpus)
            if p is not None and len(p) == DIM
        ]
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def found(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
        assert r.rank == len(out[r.query_id])
    return out


@pytest.fixture
def data():
    # Whole numbers, so that there are ties; a zero vector, copies, a null and a wrong length.
    g = np.random.default_rng(3)
    corpus = [[float(x) for x in row] for row in g.integers(-2, 3, (120, DIM))]
    corpus[5], corpus[6], corpus[7] = [0.0] * DIM, None, [1.0] * (DIM - 1)
    corpus[9] = list(corpus[8])
    wanted = [[float(x) for x in row] for row in g.integers(-2, 3, (9, DIM))]
    wanted[2], wanted[3], wanted[4] = [0.0] * DIM, None, [1.0]
    return corpus, wanted


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
@pytest.mark.parametrize("k", [1, 5, 500])
def test_knn_join(spark, data, metric, k):
    corpus, wanted = data
    hits = knn_join(queries(spark, wanted), points(spark, corpus).repartition(5), k, metric, DIM)
    assert found(hits) == brute(corpus, wanted, k, metric)


def test_no_hits_for_k_zero(spark, data):
    corpus, wanted = data
    assert knn_join(queries(spark, wanted), points(spark, corpus), 0, "cosine", DIM).count() == 0


def test_small_matrices_give_the_same(spark, data, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_PER_MATRIX", 7)
    monkeypatch.setattr(topk, "QUERIES_PER_MATRIX", 2)
    corpus, wanted = data
    hits = knn_join(queries(spark, wanted), points(spark, corpus).coalesce(1), 5, "cosine", DIM)
    assert found(hits) == brute(corpus, wanted, 5, "cosine")


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
def test_slices_beyond_the_broadcast_bound(spark, data, metric, monkeypatch):
    corpus, wanted = data
    plans, ranked = [], topk.rank_hits

    def seen(partial, k):
        plans.append(partial._jdf.queryExecution().executedPlan().toString())
        return ranked(partial, k)

    monkeypatch.setattr(topk, "rank_hits", seen)
    monkeypatch.setattr(topk, "BROADCAST_CELLS", 3 * DIM)
    hits = knn_join(queries(spark, wanted), points(spark, corpus), 5, metric, DIM)
    assert len(plans) == 3 and not any("Exchange" in p or "Join" in p for p in plans)
    assert found(hits) == brute(corpus, wanted, 5, metric)


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
def test_one_query(spark, data, metric):
    corpus, wanted = data
    rows = vector_topk(points(spark, corpus), wanted[0], 5, metric).orderBy("rank").collect()
    assert [r.id for r in rows] == brute(corpus, wanted[:1], 5, metric)[0]
    assert [r.rank for r in rows] == [1, 2, 3, 4, 5]
    for r in rows:
        assert r.score == pytest.approx(value(corpus[r.id], wanted[0], metric), abs=1e-6)
        assert (r.text, r.source) == (f"text {r.id}", "Unknown" if r.id % 2 else "s")


def test_unknown_metric(spark, data):
    with pytest.raises(ValueError):
        knn_join(queries(spark, data[1]), points(spark, data[0]), 5, "manhattan", DIM)


def test_split_by_dim(spark, data):
    accepted, rejected = split_by_dim(points(spark, data[0]), DIM)
    assert {r.id for r in rejected.collect()} == {6, 7}
    assert accepted.count() == len(data[0]) - 2


def test_plan_keeps_the_corpus_in_place(spark, data):
    corpus, wanted = data
    hits = knn_join(queries(spark, wanted), points(spark, corpus), 5, "cosine", DIM)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan and "MapInArrow" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert plan.count("Exchange") == 1


def test_lsh_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    stored = table.selectExpr("vec_id as id", "embedding")
    wanted = table.selectExpr("vec_id as query_id", "embedding")
    exact = found(knn_join(wanted, stored, 5, "cosine", 64))
    near = found(knn_lsh(wanted, stored, 5, 64))
    assert near.keys() == exact.keys() and all(len(h) == 5 for h in near.values())
    kept = sum(len(set(near[q]) & set(exact[q])) for q in exact)
    assert kept / (5 * len(exact)) >= 0.9


@pytest.mark.parametrize("hits_bound", [topk.BROADCAST_HITS, 10])
def test_lsh_cuts_crowded_buckets(spark, monkeypatch, hits_bound):
    # One bucket holds copies of a vector; k best of it by id, whatever its number of parts.
    monkeypatch.setattr(topk, "BROADCAST_HITS", hits_bound)
    monkeypatch.setattr(topk, "CORPUS_BLOCK_ROWS", 16)
    same = [1.0] + [0.0] * (DIM - 1)
    corpus = [same] * 200 + [[0.0, 1.0] + [0.0] * (DIM - 2)] * 3
    hits = found(knn_lsh(queries(spark, [same] * 40), points(spark, corpus), 4, DIM))
    assert hits == {q: [0, 1, 2, 3] for q in range(40)}


def test_lsh_fills_up_with_the_exact_search(spark):
    corpus = [[1.0] + [0.0] * (DIM - 1), [-1.0] + [0.0] * (DIM - 1)]
    hits = found(knn_lsh(queries(spark, corpus[:1]), points(spark, corpus), 2, DIM, bucket_length=0.1))
    assert hits == {0: [0, 1]}


def test_semantic_search_finds_the_text_itself(spark):
    docs = spark.createDataFrame(
        [(1, "red apples and pears", "a"), (2, "green cars drive fast", None), (3, "???", "c")],
        "doc_id long, text string, source string",
    )
    ask = spark.createDataFrame([(7, "cars drive"), (8, "pears")], "query_id long, query string")
    hits = semantic_search(ask, ingest_fixed(docs), 1).collect()
    assert {(r.query_id, r.text, r.source) for r in hits} == {
        (7, "green cars drive fast", "Unknown"),
        (8, "red apples and pears", "a"),
    }


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 12), st.integers(1, 4), st.integers(1, 14), st.randoms(use_true_random=False))
def test_best_rows(n, m, k, random):
    scores = np.array([[float(random.randint(0, 3)) for _ in range(m)] for _ in range(n)])
    rows, columns = topk.best_rows(scores, k)
    for c in range(m):
        expected = sorted(range(n), key=lambda r: (-scores[r, c], r))[:k]
        assert sorted(rows[columns == c]) == sorted(expected)


def test_rounding_is_half_away_from_zero():
    found = topk.round_scores(np.array([0.0078125, -0.0078125, -0.0, 1 / 3]))
    assert found.tolist() == [0.007813, -0.007813, 0.0, 0.333333]
    assert not np.signbit(found[2])


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
def test_few_pairs_are_scored_exactly_and_copies_count_once(monkeypatch, metric):
    g = np.random.default_rng(5)
    x = g.standard_normal((6_000, DIM)).astype(np.float32)
    x[::3] = x[0]
    corpus = pa.table({"id": np.arange(6_000), "embedding": pa.array(list(x), pa.list_(pa.float32()))})
    asked = pa.table({"query_id": np.arange(40), "embedding": corpus["embedding"].slice(0, 40)})
    scorer, pairs = dense_scorer(DIM, metric), []
    exact = scorer.exact
    monkeypatch.setattr(scorer, "exact", lambda x, q, row, *more: pairs.append(len(row)) or exact(x, q, row, *more))
    best = pa.Table.from_batches(topk._kept(iter([corpus]), asked, scorer, 5, of_length(DIM)))
    hits = best.to_pandas().sort_values(["query_id", "score", "id"], ascending=[True, False, True])
    hits = {q: rows["id"].tolist() for q, rows in hits.groupby("query_id")}
    wanted = brute(x, x[:40], 5, metric)
    assert hits == wanted and (metric == "dot" or hits[0] == [0, 3, 6, 9, 12])
    assert sum(pairs) < 0.05 * 6_000 * 40
