"""Jobs that go on where they stopped: the inference log, pages of a compacted collection, raw file streams."""

import os
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passages.config import ASK, RetrievalConfig
from passages.operators import inference_log, rerank
from passages.operators.chunk import split_recursive
from passages.operators.inference_log import infer_logged, read_log
from passages.operators.embed import embed_texts
from passages.plans.answers import answer_queries, retrieve
from passages.plans.ingest import index_folder
from passages.sources import collection
from passages.streaming.ingest import outcomes, stream_folder

DOC = "doc_id long, text string"


def counting(folder, refused="bad"):
    """A model that notes each item it is asked about in a file of its own."""

    def build():
        def model(items):
            for item in items:
                if item == refused:
                    raise ValueError("refused")
            for item in items:
                with open(f"{folder}/{os.getpid()}", "a") as notes:
                    notes.write(f"{item}\n")
            return [item.upper() for item in items]

        return model

    return build


def asked(folder):
    return sorted(line for f in folder.iterdir() for line in f.read_text().splitlines())


@pytest.mark.parametrize("slice_rows", [100_000, 2])
def test_what_is_known_is_not_asked_again(spark, tmp_path, slice_rows, monkeypatch):
    monkeypatch.setattr(inference_log, "SLICE_ROWS", slice_rows)
    notes, log = tmp_path / "notes", str(tmp_path / "log")
    notes.mkdir()
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "bad"), (6, "c"), (6, "c")]
    docs = spark.createDataFrame(rows, DOC).withColumn("key", F.lit("mine")).withColumn("value", F.lit(0))

    def run(df, model="m1", refused="bad"):
        done = infer_logged(df, counting(str(notes), refused), "text", "out", T.StringType(), log, model, 2, "error")
        assert done.columns == [*df.columns, "out", "error"]
        return sorted((r.doc_id, r.out, r.error) for r in done.collect())

    want = [(1, "A", None), (2, "B", None), (3, "A", None), (4, None, None), (5, None, "ValueError: refused"), (6, "C", None), (6, "C", None)]
    assert run(docs) == want and asked(notes) == ["a", "b", "c"]
    assert run(docs) == want and asked(notes) == ["a", "b", "c"]
    more = docs.unionByName(spark.createDataFrame([(7, "d", "mine", 0)], docs.schema))
    assert run(more, refused="other")[4:] == [(5, "BAD", None), (6, "C", None), (6, "C", None), (7, "D", None)]
    assert asked(notes) == ["a", "b", "bad", "c", "d"]
    run(docs, "m2")
    assert asked(notes) == ["a", "a", "b", "b", "bad", "c", "c", "d"]
    assert read_log(spark, log, T.StringType()).count() == 9


def test_a_lost_run_leaves_its_finished_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inference_log, "SLICE_ROWS", 2)
    notes, log = tmp_path / "notes", str(tmp_path / "log")
    notes.mkdir()
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(9)], DOC)
    calls, whole = [], inference_log.batch_infer

    def lost(*args, **kwargs):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("the driver is gone")
        return whole(*args, **kwargs)

    monkeypatch.setattr(inference_log, "batch_infer", lost)
    with pytest.raises(RuntimeError):
        infer_logged(docs, counting(str(notes)), "text", "out", T.StringType(), log, "m")
    before = asked(notes)
    assert 0 < len(before) < 9
    done = infer_logged(docs, counting(str(notes)), "text", "out", T.StringType(), log, "m")
    assert {r.out for r in done.collect()} == {f"T{k}" for k in range(9)}
    assert asked(notes) == sorted(f"t{k}" for k in range(9))


def test_answers_are_kept(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    points = spark.createDataFrame([("a", [1.0] * 4, "text", None)], "id string, embedding array<float>, text string, source string")
    ask = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one")], "query_id long, query string")

    def run():
        done = answer_queries(
            ask, points, None, build_model=counting(str(notes)), log=str(tmp_path / "log"), model="m", dim=4
        )
        return sorted((r.query_id, r.answer) for r in done.collect())

    first = run()
    assert len(first) == 3 and first[0][1] == first[2][1] and "ONE" in first[0][1]
    told = asked(notes)
    assert run() == first and asked(notes) == told


@pytest.fixture
def compacted(spark, tmp_path):
    path = str(tmp_path / "points")
    collection.ensure_collection(spark, path, 1)
    rows = [(f"{i:04d}", [1.0], f"t{i}", None) for i in range(400)]
    table = spark.createDataFrame(rows, "id string, embedding array<float>, text string, source string")
    collection.upsert(table.repartition(5), path, 0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    collection.compact(spark, path)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return path


def pages(spark, path, limit):
    seen, cursor = [], None
    while True:
        page = collection.scroll_page(spark, path, cursor, limit).orderBy("id").collect()
        assert len(page) <= limit
        seen += [r.id for r in page]
        cursor = page[0].next_cursor if page else None
        if cursor is None:
            return seen


def test_pages_of_a_compacted_collection(spark, compacted):
    assert len(spark.read.parquet(f"{compacted}/points-1-ranges").collect()) > 2
    assert pages(spark, compacted, 37) == [f"{i:04d}" for i in range(400)]
    for cursor in (None, "0000", "0123", "0399", "9"):
        page = collection.scroll_page(spark, compacted, cursor, 20)
        assert len(page.inputFiles()) <= 2
    assert collection.scroll_page(spark, compacted, "9", 20).count() == 0
    new = spark.createDataFrame([("0001x", [1.0], "new", None)], "id string, embedding array<float>, text string, source string")
    collection.upsert(new, compacted, 1)
    assert pages(spark, compacted, 150) == sorted([f"{i:04d}" for i in range(400)] + ["0001x"])


def test_a_folder_becomes_an_index_in_one_call(spark, tmp_path):
    root, path = tmp_path / "in", str(tmp_path / "points")
    (root / "deep").mkdir(parents=True)
    texts = {"one.pdf": "first paragraph here\n\n" + "word " * 150, "deep/two.pdf": "short"}
    for name, text in texts.items():
        (root / name).write_bytes(text.encode())
    (root / "bad.pdf").write_bytes(b"\xff")
    (root / "none.pdf").write_bytes(b"")
    report = index_folder(spark, str(root), path, lambda: lambda contents: [bytes(c).decode() for c in contents])
    told = {r.source: (r.n_chunks, r.n_valid, r.status) for r in report.collect()}
    parts = {k.rsplit("/", 1)[-1]: split_recursive(t, ASK.chunk_size, ASK.chunk_overlap) for k, t in texts.items()}
    assert told == {k: (len(v), len(v), "stored") for k, v in parts.items()} | {
        "bad.pdf": (0, 0, "error"), "none.pdf": (0, 0, "no text")
    }
    stored = {(r.source, r.text) for r in collection.read_points(spark, path).collect()}
    assert stored == {(k, text) for k, v in parts.items() for text in v} and len(parts["one.pdf"]) > 1


def test_a_replayed_stream_leaves_what_one_run_leaves(spark, tmp_path):
    root, path, state = tmp_path / "in", str(tmp_path / "points"), tmp_path / "state"
    (root / "deep").mkdir(parents=True)
    (root / "one.pdf").write_bytes(b"first file " * 200)
    (root / "deep" / "two.pdf").write_bytes(b"\xff\xfe no text")
    (root / "three.PDF").write_bytes(b"other suffix")

    def reader():
        return lambda contents: [bytes(c).decode() for c in contents]

    def run():
        query = stream_folder(spark, str(root), path, str(state), reader, max_files=1)
        query.awaitTermination()
        assert query.exception() is None

    def told():
        rows = outcomes(spark, path).collect()
        return sorted((r.source, r.n_chunks, r.n_valid, r.status, bool(r.error)) for r in rows)

    run()
    want = [("one.pdf", 3, 3, "stored", False), ("two.pdf", 0, 0, "error", True)]
    assert told() == want
    (root / "four.pdf").write_bytes(b"   ")
    (root / "five.pdf").write_bytes(b"late words")
    run()
    want = sorted([*want, ("five.pdf", 1, 1, "stored", False), ("four.pdf", 1, 1, "stored", False)])
    assert told() == want
    points = sorted(map(tuple, collection.read_points(spark, path).select("id", "text", "ingest_batch").collect()))
    # The driver was lost before the last batch was noted as done: it runs once more.
    last = max((f for f in (state / "commits").iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    shutil.copy(last, tmp_path / "gone")
    last.unlink()
    (state / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert told() == want
    assert sorted(map(tuple, collection.read_points(spark, path).select("id", "text", "ingest_batch").collect())) == points


def test_words_of_labelled_texts_are_made_once(spark):
    rows = [("good words", 1.0), ("", 0.0), (None, 1.0), ("bad words", 0.0)]
    labelled = spark.createDataFrame(rows, "text string, label double")
    plans = []
    seen = rerank.cut_lineage
    try:
        rerank.cut_lineage = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or seen(df)
        model = rerank.train_naive_bayes(labelled)
    finally:
        rerank.cut_lineage = seen
    assert plans[0].count("regexp_extract_all") == 1
    assert model.words == 4 and {r.term for r in model.weights.collect()} == {"good", "words", "bad", ""}


def test_hits_are_searched_once_for_a_classifier(spark):
    labelled = spark.createDataFrame([("good words", 1.0), ("bad words", 0.0)], "text string, label double")
    texts = [(f"p{i}", f"good word{i}" if i % 2 else f"bad word{i}", None) for i in range(8)]
    points = embed_texts(spark.createDataFrame(texts, "id string, text string, source string"), size=16)
    asked = spark.createDataFrame([(1, "word1 good"), (2, "word2 bad")], "query_id long, query string")
    model, config = rerank.train_naive_bayes(labelled), RetrievalConfig(use_rerank=True, rerank_k=5)
    hits = retrieve(asked, points, None, config, model, ["low", "high"], dim=16)
    assert "MapInArrow" not in hits._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.query_id, r.pos) for r in hits.collect()) == [(q, k) for q in (1, 2) for k in range(5)]
