import random

import numpy as np
import pyarrow as pa
import pytest

from passages.operators import postings, topk
from passages.operators.lexical import bm25_hits, bm25_scores, build_lexical_index
from passages.operators.postings import InvertedIndex, build_inverted_index
from test_lexical import found, items, plain_scores, questions, ranking

WORDS = ["the", "cat", "dog", "Foo", "x1", "rare", "naïve", "end."]
ASKED = ["the cat", "cat cat dog", "foo?", "foo", "zzz", "rare RARE x1", "", "na ve end"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    some = [" ".join(rng.choices(WORDS, [30, 8, 6, 4, 3, 1, 2, 2], k=rng.randint(0, 30))) for _ in range(60)]
    return some + [None, "", "..."]


@pytest.fixture(scope="module")
def stored(spark, texts, tmp_path_factory):
    """An index of blocks of seven documents."""
    patch = pytest.MonkeyPatch()
    patch.setattr(postings, "BLOCK_DOCS", 7)
    path = str(tmp_path_factory.mktemp("index") / "words")
    build_inverted_index(items(spark, texts), path)
    yield InvertedIndex.load(spark, path)
    patch.undo()


@pytest.mark.parametrize("bound", [topk.BROADCAST_CELLS, 6])
@pytest.mark.parametrize("k", [1, 7, 100])
def test_top_k_of_all_documents(spark, texts, stored, k, bound, monkeypatch):
    monkeypatch.setattr(topk, "BROADCAST_CELLS", bound)
    hits = found(bm25_hits(questions(spark, ASKED), stored, k))
    for q, query in enumerate(ASKED):
        scores = plain_scores([t or "" for t in texts], query)
        assert [i for i, _ in hits[q]] == ranking(scores, k)
        assert [s for _, s in hits[q]] == pytest.approx([scores[i] for i in ranking(scores, k)], abs=2e-6)


@pytest.mark.parametrize("normalize", [False, True])
def test_both_indexes_give_the_same(spark, texts, stored, normalize):
    ask, scanned = questions(spark, ASKED), build_lexical_index(items(spark, texts))
    assert found(bm25_hits(ask, stored, 5, normalize)) == found(bm25_hits(ask, scanned, 5, normalize))
    for candidates in (None, spark.createDataFrame([(0, 3), (0, 4), (0, 4), (1, 61), (5, 9), (9, 9)], "query_id long, id long")):
        rows = [sorted(map(tuple, bm25_scores(ask, i, normalize, candidates).collect())) for i in (stored, scanned)]
        assert rows[0] == rows[1] and rows[0]
    assert sorted(map(tuple, stored.terms.select("term", "df", "idf").collect())) == sorted(map(tuple, scanned.terms.collect()))
    assert stored.stats.first()[:2] == scanned.stats.first()[:2]


def test_many_queries_are_joined(spark, stored, monkeypatch):
    ask = questions(spark, ASKED)
    few = sorted(map(tuple, bm25_scores(ask, stored).collect()))
    monkeypatch.setattr(topk, "BROADCAST_CELLS", 6)
    assert sorted(map(tuple, bm25_scores(ask, stored).collect())) == few


def test_many_words_are_joined(spark, stored, monkeypatch):
    few = found(bm25_hits(questions(spark, ASKED), stored, 3))
    monkeypatch.setattr(postings, "LISTED_WORDS", 1)
    assert found(bm25_hits(questions(spark, ASKED), stored, 3)) == few


def test_a_match_can_rank_below_no_match(spark):
    texts = ["a b", "a b", "a b", "d"]
    scores = plain_scores(texts, "a")
    hits = found(bm25_hits(questions(spark, ["a"]), build_inverted_index(items(spark, texts)), 4))
    assert min(scores) < 0 and [i for i, _ in hits[0]] == ranking(scores, 4)


def test_text_ids_and_odd_tables(spark):
    ask = questions(spark, ["b", None])
    rows = [(f"id{k:03d}", "b " * (k % 3 if k > 40 else 0), None) for k in range(50)]
    index = build_inverted_index(spark.createDataFrame(rows, "id string, text string, source string"))
    hits = found(bm25_hits(ask, index, 2))
    assert [i for i, _ in hits[0]] == ["id041", "id044"] and hits[1] == [("id000", 0.0), ("id001", 0.0)]
    assert bm25_hits(ask, index, 0).count() == 0 and bm25_hits(ask.limit(0), index, 3).count() == 0
    empty = build_inverted_index(items(spark, ["x"]).limit(0))
    assert bm25_hits(ask, empty, 3).count() == 0 and bm25_scores(ask, empty).count() == 0
    wordless = build_inverted_index(items(spark, ["", "!", None]))
    assert found(bm25_hits(ask, wordless, 2))[0] == [(0, 0.0), (1, 0.0)]


def test_only_rows_of_asked_words_are_read(spark, stored):
    words = postings.asked_words(questions(spark, ["rare"]), stored, False).toArrow().combine_chunks()
    rows = postings.rows_of_words(stored, words)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,rare)" in plan
    assert {r.term for r in rows.collect()} == {"rare"}
    hits = bm25_hits(questions(spark, ["rare"]), stored, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in hits and "BroadcastNestedLoop" not in hits


def test_blocks_that_cannot_gain_a_hit_are_skipped():
    """Three blocks: the second cannot beat the first, the third can for one of two queries."""
    question = postings.Question(pa.array(["a", "b"]), np.array([0, 1, 2]), np.array([0, 1]), np.array([2.0, 1.0]), 2, 5.0)
    best = postings.Best(2, 1)

    def rows(*words):
        columns = list(zip(*words))
        kinds = [pa.string(), pa.float64(), *[pa.list_(pa.int32())] * 3]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["term", "best", "places", "counts", "lengths"])

    def bound(count, length):
        return count * 2.5 / (count + 1.5 * (0.25 + 0.75 * length / 5))

    strong = ("a", bound(4, 5), [1], [4], [5]), ("b", bound(2, 5), [2], [2], [5])
    assert postings.score_block(0, 3, rows(*strong), question, best) == 2
    weak = ("a", bound(1, 9), [0], [1], [9]), ("b", bound(1, 9), [0], [1], [9])
    assert postings.score_block(1, 3, rows(*weak), question, best) == 0
    assert postings.score_block(2, 3, rows(("b", bound(9, 5), [2], [9], [5]), weak[0]), question, best) == 1
    assert best.numbers[:, 0].tolist() == [1, 2 * postings.BLOCK_DOCS + 2]


def test_long_texts_make_blocks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_BYTES", 100)
    texts = ["word " * 50, "a b", "a c", "word " * 3_000, "a"]
    index = build_inverted_index(items(spark, texts).coalesce(1))
    assert index.docs.count() >= 3
    assert [i for i, _ in found(bm25_hits(questions(spark, ["word"]), index, 2))[0]] == ranking(plain_scores(texts, "word"), 2)
