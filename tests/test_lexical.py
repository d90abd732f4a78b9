import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passages.functions import cuts
from passages.operators import lexical, topk
from passages.operators.fuse import splice
from passages.operators.lexical import (
    LexicalIndex,
    bm25_hits,
    bm25_scores,
    build_lexical_index,
    lexical_search,
)


def ascii_words(text):
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text).lower().split()


def plain_scores(texts, query, normalize=False):
    docs = [ascii_words(t) for t in texts]
    words = ascii_words(query) if normalize else query.lower().split()
    n, avgdl = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if x < 0 else x for w, x in idf.items()}
    return [
        sum(
            idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avgdl))
            for w in words
        )
        for d in docs
    ]


@pytest.fixture
def data(rng):
    words = ["the", "cat", "dog", "Foo", "x1", "rare", "naïve", "end."]
    weights = [30, 8, 6, 4, 3, 1, 2, 2]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(0, 30))) for _ in range(60)]
    asked = ["the cat", "cat cat dog", "foo?", "foo", "zzz", "rare RARE x1", "", "na ve end"]
    return texts, asked


def items(spark, texts):
    rows = [(i, t, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id long, text string, source string").repartition(4)


def questions(spark, asked):
    return spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")


def ranking(scores, k):
    return sorted(range(len(scores)), key=lambda i: (-round(scores[i], 6), i))[:k]


def found(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


@pytest.mark.parametrize("bound", [topk.BROADCAST_CELLS, 6])
@pytest.mark.parametrize("normalize", [False, True])
def test_scores_of_matching_documents(spark, data, normalize, bound, monkeypatch):
    monkeypatch.setattr(topk, "BROADCAST_CELLS", bound)
    texts, asked = data
    rows = bm25_scores(
        questions(spark, asked), build_lexical_index(items(spark, texts)), normalize
    ).collect()
    listed = {(r.query_id, r.id): r.score for r in rows}
    for q, query in enumerate(asked):
        for i, score in enumerate(plain_scores(texts, query, normalize)):
            assert listed.get((q, i), 0.0) == pytest.approx(score, abs=2e-6)


@pytest.mark.parametrize("k", [1, 7, 100])
@pytest.mark.parametrize("bound", [topk.BROADCAST_CELLS, 6])
def test_top_k_of_all_documents(spark, data, k, bound, monkeypatch):
    monkeypatch.setattr(topk, "BROADCAST_CELLS", bound)
    monkeypatch.setattr(topk, "CORPUS_BLOCK_ROWS", 17)
    texts, asked = data
    hits = found(bm25_hits(questions(spark, asked), build_lexical_index(items(spark, texts)), k))
    for q, query in enumerate(asked):
        scores = plain_scores(texts, query)
        assert [i for i, _ in hits[q]] == ranking(scores, k)
        assert [s for _, s in hits[q]] == pytest.approx([scores[i] for i in ranking(scores, k)], abs=2e-6)


def test_a_match_can_rank_below_no_match(spark):
    # In a corpus this small every word is frequent and the mean idf is negative.
    texts = ["a b", "a b", "a b", "d"]
    scores = plain_scores(texts, "a")
    assert min(scores) < 0
    hits = found(bm25_hits(questions(spark, ["a"]), build_lexical_index(items(spark, texts)), 4))
    assert [i for i, _ in hits[0]] == ranking(scores, 4)


def test_punctuation_stays_in_query_words(spark):
    index = build_lexical_index(items(spark, ["bar baz", "qux", "quux", "foo"]))
    ask = questions(spark, ["foo?"])
    assert found(bm25_hits(ask, index, 1))[0] == [(0, 0.0)]
    assert found(bm25_hits(ask, index, 1, normalize=True))[0][0][0] == 3


def test_a_saved_index_answers_the_same(spark, data, tmp_path):
    texts, asked = data
    stored = items(spark, texts)
    index = build_lexical_index(stored)
    index.write(str(tmp_path / "index"))
    loaded = LexicalIndex.load(spark, str(tmp_path / "index"))
    ask = questions(spark, asked)
    assert found(bm25_hits(ask, loaded, 3)) == found(bm25_hits(ask, index, 3))
    best = lexical_search(ask, stored, loaded, 1).collect()
    assert {(r.text, r.source) for r in best} <= {(t, "Unknown") for t in texts}


def test_splice_puts_the_lexical_hits_between(spark, rng):
    semantic, lexical, expected = [], [], {}
    for q in range(40):
        left = [f"s{i}" for i in range(rng.randint(0, 6))]
        right = [f"l{i}" for i in range(rng.randint(0, 4))]
        semantic += [(q, i + 1, x) for i, x in enumerate(left)]
        lexical += [(q, i + 1, x) for i, x in enumerate(right)]
        expected[q] = (left, right)
    schema = "query_id long, rank int, id string"
    a, b = spark.createDataFrame(semantic, schema), spark.createDataFrame(lexical, schema)
    for k in (0, 1, 3, 9):
        spliced = {q: {} for q in expected}
        for r in splice(a, b, k).collect():
            assert r.pos not in spliced[r.query_id]
            spliced[r.query_id][r.pos] = r.id
        for q, (left, right) in expected.items():
            whole = left[:k] + right + left[k:]
            assert [spliced[q][i] for i in range(len(whole))] == whole


@pytest.mark.parametrize("cells", [1, 7, 10_000])
def test_scores_do_not_depend_on_the_piece_size(monkeypatch, rng, cells):
    monkeypatch.setattr(lexical, "SPREAD_CELLS", cells)
    docs = [rng.choices("abcde", k=rng.randint(0, 9)) for _ in range(30)] + [[]]
    asked = [(["a", "c"], [1.5, -0.5]), ([], []), (["z", "b"], [9.0, 0.25])]
    corpus = pa.table({"id": list(range(31)), "tokens": pa.array(docs, pa.list_(pa.string()))})
    queries = pa.table(
        {
            "terms": pa.array([t for t, _ in asked], pa.list_(pa.string())),
            "weights": pa.array([w for _, w in asked], pa.list_(pa.float64())),
            "avgdl": [4.0] * 3,
        }
    )
    scores = lexical.bm25_scorer(corpus, queries)
    for i, doc in enumerate(docs):
        base = 1.5 * (0.25 + 0.75 * len(doc) / 4.0)
        for q, (terms, weights) in enumerate(asked):
            plain = sum(w * doc.count(t) * 2.5 / (doc.count(t) + base) for t, w in zip(terms, weights))
            assert scores[i, q] == pytest.approx(plain, abs=1e-6)


def test_scores_move_documents_once_into_tasks_of_bounded_pairs(spark, monkeypatch):
    rows = [(i % 30, "red apple " + "green " * (i % 3)) for i in range(40)]
    index = build_lexical_index(spark.createDataFrame(rows, "id long, text string"))
    ask = spark.createDataFrame([(1, "red green"), (2, "apple apple")], "query_id long, query string")
    few = sorted(map(tuple, bm25_scores(ask, index).collect()))
    monkeypatch.setattr(lexical, "PAIRS_PER_TASK", 5)
    scores = bm25_scores(ask, index)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(query_id" not in plan.replace("#", " ").split("Subquery")[0]
    assert sorted(map(tuple, scores.collect())) == few and len(few) == 60


def test_the_texts_are_read_once_for_the_counts(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(i):
        read.add(1)
        return [None, "", "Red apple red", "naïve 9x", "é", "apple " * 40][i % 6]

    rows = spark.range(0, 60, 1, 3).select("id", seen.asNondeterministic()("id").alias("text"))
    index = build_lexical_index(rows)
    terms = {r.term: r.df for r in index.terms.collect()}
    stats = index.stats.first()
    assert terms == {"red": 10, "apple": 20, "na": 10, "ve": 10, "9x": 10}
    assert (stats.n, stats.avgdl) == (60, 46 * 10 / 60)
    assert read.value == 60
    assert index.docs.select("tokens").where("size(tokens) = 40").count() == 10


@pytest.mark.parametrize("size", [1, 40, 1 << 22])
def test_counts_do_not_depend_on_the_parts(spark, monkeypatch, size):
    monkeypatch.setattr(cuts, "CUT_BYTES", size)
    texts = ["a b a", "", "B c" * 30, "é", "c", None] * 5
    index = build_lexical_index(items(spark, texts).coalesce(1))
    assert {r.term: r.df for r in index.terms.collect()} == {"a": 5, "b": 10, "c": 10, "cb": 5}
    assert index.stats.first().n == 30


def test_an_index_of_no_texts(spark):
    index = build_lexical_index(items(spark, ["x"]).limit(0))
    assert index.terms.count() == 0 and tuple(index.stats.first()) == (0, None)
