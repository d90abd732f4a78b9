import pytest
from pyspark.sql import functions as F

from passages.config import INGEST, RetrievalConfig
from passages.operators.vector import semantic_hits, semantic_search
from passages.plans import ingest
from passages.plans.ingest import (
    build_index,
    embedded_chunks,
    ingest_fixed,
    ingest_report,
    judged_chunks,
    load_index,
)
from passages.sources import collection
from passages.sources.files import empty_files, read_texts, scan_files, split_by_suffix
from passages.sources.pages import concat_pages
from passages.sources.tables import spread
from passages.streaming.ingest import stream_ingest

POINT = "id string, embedding array<float>, text string, source string"
DOC = "doc_id long, text string, source string"


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "points")


def batch(spark, rows):
    return spark.createDataFrame([(i, v, t, None) for i, v, t in rows], POINT)


def stored(spark, path):
    rows = collection.read_points(spark, path).collect()
    found = {r.id: (r.text, r.ingest_batch) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("bound", [collection.BROADCAST_IDS, 0])
def test_upsert_latest_wins_and_retries_change_nothing(spark, path, bound, monkeypatch):
    monkeypatch.setattr(collection, "BROADCAST_IDS", bound)
    assert not collection.collection_exists(spark, path)
    with pytest.raises(ValueError):
        collection.read_points(spark, path)
    collection.ensure_collection(spark, path, 2)
    collection.ensure_collection(spark, path, 2)
    assert collection.collection_exists(spark, path) and stored(spark, path) == {}
    first = batch(spark, [("a", [1.0, 0.0], "a0"), ("b", [0.0, 1.0], "b0")])
    second = batch(spark, [("b", [1.0, 1.0], "b1"), ("c", [0.5, 0.5], "c1")])
    for points, number in ((first, 0), (second, 1), (second, 1), (first, 0)):
        collection.upsert(points, path, number)
        if number == 1:
            assert stored(spark, path) == {"a": ("a0", 0), "b": ("b1", 1), "c": ("c1", 1)}
    assert stored(spark, path) == {"a": ("a0", 0), "b": ("b1", 1), "c": ("c1", 1)}


def test_compaction_keeps_the_view(spark, path):
    collection.ensure_collection(spark, path, 1)
    collection.compact(spark, path)
    for number, text in enumerate(["x", "y", "z"]):
        collection.upsert(batch(spark, [("a", [1.0], text), (str(number), [1.0], text)]), path, number)
    before = {k: t for k, (t, _) in stored(spark, path).items()}
    collection.compact(spark, path)
    assert {k: t for k, (t, _) in stored(spark, path).items()} == before
    plan = collection.read_points(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan
    # A batch that is written once more replaces none of the compacted rows.
    collection.upsert(batch(spark, [("a", [1.0], "z"), ("2", [1.0], "z")]), path, 2)
    assert {k: t for k, (t, _) in stored(spark, path).items()} == before
    collection.upsert(batch(spark, [("a", [1.0], "later")]), path, 3)
    assert stored(spark, path)["a"] == ("later", 3)
    collection.compact(spark, path)
    assert {k: t for k, (t, _) in stored(spark, path).items()} == before | {"a": "later"}


def test_settings_are_fixed_and_dimension_is_checked(spark, path):
    collection.ensure_collection(spark, path, 2, "dot")
    with pytest.raises(ValueError):
        collection.ensure_collection(spark, path, 3, "dot")
    with pytest.raises(ValueError):
        collection.ensure_collection(spark, path, 2, "cosine")
    rejected = collection.upsert(
        batch(spark, [("a", [1.0, 2.0], "t"), ("b", [1.0], "t"), ("c", None, "t")]), path, 0
    )
    assert {r.id for r in rejected.collect()} == {"b", "c"}
    assert set(stored(spark, path)) == {"a"}


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 25])
def test_scroll_visits_every_document_once(spark, n):
    rows = [(f"{i:03d}", [1.0], f"t{i}") for i in range(n)]
    points = batch(spark, rows) if rows else spark.createDataFrame([], POINT)
    seen, cursor = [], None
    while True:
        page = collection.scroll(points, cursor, 10).orderBy("id").collect()
        assert len(page) <= 10 and all(r.source == "Unknown" for r in page)
        seen += [r.id for r in page]
        cursor = page[0].next_cursor if page else None
        if cursor is None:
            break
    assert seen == [i for i, _, _ in rows]


def test_scan_files(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "folder.pdf").mkdir()
    for name in ("one.pdf", "deep/er/two.pdf", "deep/three.PDF", "four.txt"):
        (tmp_path / name).write_bytes(b"data")
    names = {r.path.rsplit("/", 1)[1] for r in scan_files(spark, str(tmp_path)).select("path").collect()}
    assert names == {"one.pdf", "two.pdf"}
    listed = spark.createDataFrame([("a.pdf",), ("b.PDF",), ("c",)], "name string")
    kept = {r.name: r.accepted for r in split_by_suffix(listed, "name").collect()}
    assert kept == {"a.pdf": True, "b.PDF": False, "c": False}


def test_files_to_report(spark, tmp_path):
    for name, data in (("good one.pdf", b"some words"), ("bad+.pdf", b"\xff"), ("none.pdf", b""), ("blank.pdf", b" ")):
        (tmp_path / name).write_bytes(data)

    def build():
        return lambda contents: [c.decode().strip() for c in contents]

    scan = scan_files(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in empty_files(scan).collect()] == ["none.pdf"]
    texts = read_texts(scan, build)
    files = texts.select("source", F.lit(True).alias("accepted"), "failed")
    report = ingest_report(files, judged_chunks(texts.select("doc_id", "text", "source")))
    assert {tuple(r) for r in report.collect()} == {
        ("good one.pdf", 1, 1, "stored"),
        ("bad+.pdf", 0, 0, "error"),
        ("blank.pdf", 0, 0, "no text"),
    }


def test_folder_to_collection(spark, path, tmp_path):
    for name, data in (("a/x.pdf", b"some words"), ("b/x.pdf", b"\xff"), ("none.pdf", b""), ("other.txt", b"no")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)

    def build():
        return lambda contents: [c.decode() for c in contents]

    report = ingest.ingest_folder(spark, str(tmp_path / "in"), path, build, dim=16).collect()
    assert sorted((r.source, r.n_chunks, r.n_valid, r.status) for r in report) == [
        ("none.pdf", 0, 0, "no text"), ("x.pdf", 0, 0, "error"), ("x.pdf", 1, 1, "stored")
    ]
    assert [(r.text, r.source) for r in collection.read_points(spark, path).collect()] == [("some words", "x.pdf")]


def test_concat_pages(spark, rng):
    rows = [(d, n, f"<{d}.{n}>") for d in range(3) for n in range(0, 900, d + 1)]
    shuffled = rng.sample(rows, len(rows))
    found = {r.doc_id: r.text for r in concat_pages(
        spark.createDataFrame(shuffled, "doc_id long, page_no long, text string")
    ).collect()}
    assert found == {d: "".join(t for e, _, t in rows if e == d) for d in range(3)}


def test_spread_leaves_wide_scans_alone(spark):
    narrow, wide = spark.range(0, 9, 1, 1), spark.range(0, 99, 1, 64)
    assert spread(narrow, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(wide, "id") is wide


TEXTS = [(1, "alpha " * 400, "a.pdf"), (2, "", "empty.pdf"), (3, "beta bad gamma", "bad.pdf"), (4, "x" * 30, None)]


@pytest.fixture
def refusing():
    def build():
        def model(texts):
            if any("bad" in text for text in texts):
                raise ValueError("bad word")
            return [[1.0] * 16 for _ in texts]

        return model

    return build


def test_ingest_report(spark, refusing):
    docs = spark.createDataFrame(TEXTS, DOC)
    files = spark.createDataFrame(
        [("a.pdf", True), ("empty.pdf", True), ("bad.pdf", True), ("notes.txt", False)],
        "source string, accepted boolean",
    )
    report = ingest_report(files, judged_chunks(docs, INGEST, refusing, 16)).collect()
    assert {tuple(r) for r in report} == {
        ("a.pdf", 3, 3, "stored"),
        ("empty.pdf", 0, 0, "no text"),
        ("bad.pdf", 1, 0, "no valid embedding"),
        ("notes.txt", 0, 0, "skipped"),
    }


def test_failed_batches_span_the_documents_of_a_source(spark, monkeypatch, refusing):
    # 5 documents of 30 chunks in one source: a bad chunk at 100 fails batch 64..127.
    config = RetrievalConfig(chunk_size=10, chunk_overlap=0, recursive=False)
    docs = [(d, "".join(f"{d:02d}.{c:03d}    " for c in range(30)), "s") for d in range(5)]
    docs[3] = (3, docs[3][1].replace("03.010", "bad   "), "s")
    table = spark.createDataFrame(docs, DOC)
    for bound in (ingest.BROADCAST_FAILED, 0):
        monkeypatch.setattr(ingest, "BROADCAST_FAILED", bound)
        done = embedded_chunks(table, config, refusing, 16).collect()
        failed = {r.doc_id * 30 + r.chunk_no for r in done if r.embedding is None}
        assert len(done) == 150 and failed == set(range(64, 128))
        assert {r.error for r in done} == {None, "ValueError: bad word"}
    kept = ingest_fixed(table, config, refusing, 16)
    assert kept.count() == 150 - 64


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ingest_moves_no_text(spark, refusing):
    docs = spark.createDataFrame(TEXTS, DOC)
    assert "Exchange" not in plan_of(ingest_fixed(docs))
    failing = ingest_fixed(docs, INGEST, refusing, 16)
    assert "BroadcastExchange" in plan_of(failing) and "Exchange hashpartitioning" not in plan_of(failing)
    assert failing.count() == 4


def test_a_model_goes_through_the_index(spark, path, refusing):
    docs = spark.createDataFrame(TEXTS, DOC)
    rejected = build_index(docs, path, dim=16, metric="dot", build_model=refusing).collect()
    assert {(r.source, r.error) for r in rejected} == {("bad.pdf", "ValueError: bad word")}
    points = collection.read_points(spark, path)
    assert points.where("size(embedding) = 16").count() == points.count() == 7
    dim, metric = collection.settings(spark, path)
    queries = spark.createDataFrame([(1, "good"), (2, "bad")], "query_id long, query string")
    hits = semantic_search(queries, points, 2, dim, metric, refusing).collect()
    assert {r.query_id for r in hits} == {1}
    assert {r.score for r in semantic_hits(queries, points, 2, dim, metric, refusing).collect()} == {16.0}


def test_a_batch_without_rows_replaces_the_old_one(spark, path):
    collection.ensure_collection(spark, path, 1)
    collection.upsert(batch(spark, [("a", [1.0], "x")]), path, 1)
    collection.upsert(batch(spark, [("b", [1.0], "y")]), path, 2)
    rejected = collection.upsert(batch(spark, [("a", [1.0, 2.0], "x")]), path, 1)
    assert rejected.count() == 1 and stored(spark, path) == {"b": ("y", 2)}
    assert not collection.is_empty(spark, path)
    collection.upsert(spark.createDataFrame([], POINT), path, 2)
    assert collection.is_empty(spark, path)


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    for folder, data in (("a", b"some words"), ("b", b"\xff")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.pdf").write_bytes(data)

    def build():
        return lambda contents: [c.decode() for c in contents]

    texts = read_texts(scan_files(spark, str(tmp_path)), build)
    found = texts.select("path", "source", F.lit(True).alias("accepted"), "failed")
    chunks = judged_chunks(texts.select("doc_id", "text", F.col("path").alias("source")))
    report = ingest_report(found, chunks.withColumnRenamed("source", "path"), "path").collect()
    assert {(r.path[-7:], r.source, r.status) for r in report} == {("a/x.pdf", "x.pdf", "stored"), ("b/x.pdf", "x.pdf", "error")}
    assert [r.error[:18] for r in texts.where("failed").collect()] == ["UnicodeDecodeError"]


def test_unused_embeddings_are_not_computed(spark):
    stored = ingest_fixed(spark.createDataFrame(TEXTS, DOC))
    assert "ArrowEvalPython" in plan_of(stored)
    assert "ArrowEvalPython" not in plan_of(collection.all_documents(stored))


def test_load_index_builds_once(spark, path):
    docs = spark.createDataFrame(TEXTS, DOC)
    with pytest.raises(ValueError):
        load_index(spark, path, None)
    first = load_index(spark, path, docs)
    assert first.columns == ["id", "text", "source"] and first.count() == 8
    assert first.where("source = 'Unknown'").count() == 1
    build_index(docs, path)
    assert load_index(spark, path, None).count() == 8


def test_stream_equals_batch(spark, path, tmp_path):
    source = str(tmp_path / "incoming")
    docs = spark.createDataFrame([(i, f"word{i} " * (200 * i), f"f{i}") for i in range(1, 7)], DOC)
    kept = []
    for part in (docs.where("doc_id <= 2"), docs.where("doc_id in (3, 4)"), docs.where("doc_id > 4")):
        part.coalesce(1).write.mode("append").parquet(source)
        query = stream_ingest(spark, source, path, str(tmp_path / "state"), max_files=1)
        query.awaitTermination()
        assert query.exception() is None
        kept.append(collection.read_points(spark, path).count())
    assert kept[0] < kept[1] < kept[2]
    columns = ["id", "text", "source"]
    streamed = collection.read_points(spark, path)
    batched = ingest_fixed(docs)
    assert streamed.select(*columns, F.col("embedding")).exceptAll(batched.select(*columns, "embedding")).isEmpty()
    assert streamed.count() == batched.count()
    assert streamed.select("ingest_batch").distinct().count() == 3


def test_stream_keeps_what_a_model_refuses(spark, path, tmp_path, refusing):
    source = str(tmp_path / "incoming")
    spark.createDataFrame(TEXTS, DOC).coalesce(1).write.parquet(source)
    query = stream_ingest(spark, source, path, str(tmp_path / "state"), INGEST, refusing, 16)
    query.awaitTermination()
    assert query.exception() is None and collection.read_points(spark, path).count() == 4
    rejected = spark.read.parquet(f"{path}/rejected").collect()
    assert [(r.source, r.error, r.ingest_batch) for r in rejected] == [("bad.pdf", "ValueError: bad word", 1)]
