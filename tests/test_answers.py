import json

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from passages.config import ASK, SERVICE, RetrievalConfig
from passages.functions.text import token_count
from passages.operators.context import answer_records, build_prompts, fit_budget, gather
from passages.operators.lexical import build_lexical_index
from passages.operators import rerank as reranking
from passages.operators.rerank import classify, rerank, reranked_indices, train_classifier
from passages.plans.answers import answer_queries, retrieve, split_blank
from passages.plans.ingest import ingest_fixed
from passages.sources.answers import read_answers, write_answers

HITS = "query_id long, pos int, id string, text string, source string, score double, tag string"


@pytest.fixture
def hits(spark):
    rows = [
        (1, 0, "a", "text a", "s2", 0.5, "y"),
        (1, 1, "b", "text b", None, 0.9, None),
        (1, 2, "a", "text a", "s2", 0.5, "x"),
        (1, 3, "c", "text c", "s1", None, "x"),
        (2, 0, "d", "text d", "s1", None, None),
    ]
    return spark.createDataFrame(rows, HITS)


def order(ranked, column="pos"):
    return [r[column] for r in ranked.where("query_id = 1").orderBy("rank").collect()]


def test_rerank_by_score_tag_and_place(hits):
    assert order(rerank(hits, F.col("score"), F.col("tag"))) == [1, 2, 0, 3]
    assert order(rerank(hits)) == [0, 1, 2, 3]
    assert order(rerank(hits, F.col("score"), F.col("tag"), top=2)) == [1, 2]
    assert rerank(hits, top=0).count() == 0


def test_equal_hits_share_the_first_index(hits):
    ranked = reranked_indices(rerank(hits, F.col("score")), ["id", "text", "source"])
    assert order(ranked, "index") == [1, 0, 0, 3]


def test_context_ids_and_sources(hits):
    row = gather(hits).where("query_id = 1").first()
    assert row.context == "text a\n\ntext b\n\ntext a\n\ntext c"
    assert row.document_ids == ["a", "b", "a", "c"]
    assert row.sources == ["Unknown", "s1", "s2"]


def test_prompt_and_record(spark, hits):
    ask = spark.createDataFrame([(2, "why?"), (3, "who?")], "query_id long, query string")
    prompts = {r.query_id: r for r in build_prompts(ask, gather(hits)).collect()}
    assert prompts[2].prompt == "Context:\ntext d\n\nUser Query:\nwhy?"
    assert (prompts[3].prompt, prompts[3].sources) == ("Context:\n\n\nUser Query:\nwho?", [])
    padded = build_prompts(ask, gather(hits)).withColumn("reply", F.lit(" \n yes\t"))
    assert {r.answer for r in answer_records(padded, "reply").collect()} == {"yes"}


def test_budget_cuts_the_first_hit_that_crosses(spark):
    rows = [(1, i, str(i), "one two three four", "s", None, None) for i in range(4)]
    kept = fit_budget(spark.createDataFrame(rows, HITS), 10).orderBy("pos").collect()
    assert [(r.pos, r.text, r.tokens) for r in kept] == [
        (0, "one two three four", 4),
        (1, "one two three four", 4),
        (2, "one two", 2),
    ]


DOCS = [
    (i, f"{'cats and mice run' if i % 2 else 'stocks and bonds rise'} number{i} " * 3, f"f{i % 5}")
    for i in range(40)
]


@pytest.fixture
def points(spark):
    return ingest_fixed(spark.createDataFrame(DOCS, "doc_id long, text string, source string"))


@pytest.fixture
def ask(spark):
    return spark.createDataFrame(
        [(1, "cats run number7"), (2, "bonds number12")], "query_id long, query string"
    )


def test_answers_with_a_model(spark, points, ask, tmp_path):
    def build():
        return lambda prompts: [f"  {len(p)} characters \n" for p in prompts]

    config = RetrievalConfig(vector_k=3, use_lexical=True, lexical_k=2)
    records = answer_queries(ask, points, build_lexical_index(points), config, build)
    rows = {r.question: r for r in records.collect()}
    assert set(rows) == {"cats run number7", "bonds number12"}
    prompts = answer_queries(ask, points, build_lexical_index(points), config).collect()
    for p in prompts:
        row = rows[p.question]
        assert row.answer == f"{len(p.answer)} characters"
        assert len(row.document_ids) == 5 and row.document_ids == p.document_ids
        assert row.sources == sorted(set(row.sources))
    write_answers(records, str(tmp_path / "new" / "answers"))
    again = read_answers(spark, str(tmp_path / "new" / "answers"))
    assert {r.question: r.answer for r in again.collect()} == {q: r.answer for q, r in rows.items()}
    line = next((tmp_path / "new" / "answers").glob("*.json")).read_text().splitlines()[0]
    assert set(json.loads(line)) == {"question", "sources", "document_ids", "answer"}


def test_the_lexical_hit_stands_at_its_place(points, ask):
    config = RetrievalConfig(vector_k=3, use_lexical=True, lexical_k=1)
    hits = retrieve(ask, points, build_lexical_index(points), config)
    texts = {(r.query_id, r.pos): r.text for r in hits.collect()}
    assert len(texts) == 8
    assert "number7 " in texts[1, 1] and "number12 " in texts[2, 1]


def test_the_command_preset_uses_vectors_only(points, ask):
    assert not ASK.use_lexical and not ASK.use_rerank and ASK.context_budget == 2048
    hits = retrieve(ask, points, None, ASK)
    assert hits.groupBy("query_id").count().where("count = 5").count() == 2


def test_the_service_preset_reranks_by_tag(spark, points, ask, tmp_path):
    labelled = spark.createDataFrame(
        [(t, float("cats" in t)) for _, t, _ in DOCS], "text string, label double"
    )
    train_classifier(labelled, 256).write().overwrite().save(str(tmp_path / "model"))
    model = PipelineModel.load(str(tmp_path / "model"))
    tagged = classify(labelled, model, ["money", "animals"], 0.5)
    assert {(r.label, r.predicted_tag) for r in tagged.collect()} == {(0.0, "money"), (1.0, "animals")}
    unsure = classify(labelled, model, ["money", "animals"], 1.1)
    assert {r.predicted_tag for r in unsure.collect()} == {"other"}
    hits = retrieve(
        ask, points, build_lexical_index(points), SERVICE, classifier=model, classes=["money", "animals"]
    )
    rows = hits.where("query_id = 2").orderBy("pos").collect()
    assert len(rows) == SERVICE.rerank_k and [r.pos for r in rows] == list(range(10))
    assert all("cats" in r.text for r in rows)


def test_the_budget_is_opt_in(points, ask):
    tight = RetrievalConfig(vector_k=5, max_context_tokens=60, apply_budget=True)
    kept = retrieve(ask, points, None, tight)
    sums = kept.groupBy("query_id").agg(F.sum(token_count(F.col("text"))).alias("n")).collect()
    assert len(sums) == 2 and all(r.n == tight.context_budget == 30 for r in sums)


def test_no_pairs_are_formed(spark, points, ask):
    config = RetrievalConfig(vector_k=3, use_lexical=True, lexical_k=2, use_rerank=True)
    records = answer_queries(ask, points, build_lexical_index(points), config)
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert plan.count("MapInArrow") == 2


def test_blank_questions_are_set_aside(spark):
    ask = spark.createDataFrame([(1, "why"), (2, " \n"), (3, None)], "query_id long, query string")
    kept, rejected = split_blank(ask)
    assert [r.query_id for r in kept.collect()] == [1]
    assert {r.query_id for r in rejected.collect()} == {2, 3}


def test_blank_questions_are_not_answered(spark, points):
    ask = spark.createDataFrame([(1, "cats run"), (2, " \n"), (3, None)], "query_id long, query string")
    records = answer_queries(ask, points, build_lexical_index(points), RetrievalConfig(use_lexical=True)).collect()
    assert [r.question for r in records] == ["cats run"] and records[0].answer


def test_a_stored_naive_bayes_scores_the_same(spark, tmp_path):
    known = spark.createDataFrame([("a a b", 0.0), ("b c", 1.0), ("c d", 2.0)], "text string, label double")
    model = reranking.train_naive_bayes(known)
    model.write(str(tmp_path / "bayes"))
    loaded = reranking.NaiveBayesTable.load(spark, str(tmp_path / "bayes"))
    texts = spark.createDataFrame([("a b x",), ("c",), (None,)], "text string")
    rows = [sorted(map(str, reranking.classify(texts, m, ["p", "q", "r"], 0.4).collect())) for m in (model, loaded)]
    assert rows[0] == rows[1] and loaded.words == model.words == 4


def test_naive_bayes_counts_every_word(spark, monkeypatch):
    """More words than 2^20, of which the rarest decide."""
    many = spark.range(110).select(
        F.expr("array_join(transform(sequence(id * 10000, id * 10000 + 9999), i -> concat('w', i, ' w', i)), ' ')").alias("text"),
        F.lit(0.0).alias("label"),
    )
    rare = " ".join(f"rare{k}" for k in range(20))
    known = many.unionByName(spark.createDataFrame([(rare, 1.0)] * 1, "text string, label double"))
    asked = spark.createDataFrame([(1, rare), (2, rare), (3, "w5 w6 w7 w8"), (4, None), (5, "unknown")], "id int, text string")
    model = reranking.train_naive_bayes(known)
    assert model.words == 1_100_020
    got = {r.id: (r.predicted_tag, r.probabilities) for r in classify(asked, model, ["low", "high"], 0.99).collect()}
    assert got[1] == got[2] and got[1][0] == "high" and got[4] == got[5]
    small = reranking.train_naive_bayes(spark.createDataFrame([("a a b", 0.0), ("b c", 1.0)], "text string, label double"))
    want = [1 / 2 * (3 / 6) * (2 / 6), 1 / 2 * (1 / 5) * (2 / 5)]
    for bound in (100, 1):
        monkeypatch.setattr(reranking, "BROADCAST_WORDS", bound)
        asked = spark.createDataFrame([("a b z",), ("a b z",)], "text string")
        for r in classify(asked, small, ["low", "high"]).collect():
            assert abs(r.probabilities[0] - want[0] / sum(want)) < 1e-9 and r.predicted_tag == "low"


def test_weights_of_rare_words_meet_in_a_join_and_the_others_travel(spark, monkeypatch):
    known = [("a a a b b c d e", 0.0), ("a a b b f g", 1.0), ("a c", 1.0)]
    model = reranking.train_naive_bayes(spark.createDataFrame(known, "text string, label double"))
    asked = spark.createDataFrame([("a c z",), ("a c z",), ("f g",), ("",), (None,), ("z",)], "text string")
    def scored():
        return sorted((r.text or "", r.probabilities) for r in classify(asked, model, ["low", "high"]).collect())

    whole = scored()
    monkeypatch.setattr(reranking, "BROADCAST_WORDS", 2)
    frequent, others = model._split()
    assert frequent.count() <= 2 and frequent.count() + others.count() == model.words == 7
    assert scored() == whole
