import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passages.operators import chunk
from passages.operators.chunk import (
    chunk_fixed,
    chunk_pages,
    chunk_recursive,
    fixed_chunk_count,
    split_recursive,
    with_chunk_ids,
)


def windows(text, size, overlap):
    """Drop size - overlap characters after each window, until nothing is left."""
    found = []
    while text:
        found.append(text[:size])
        text = text[size - overlap :]
    return found


def docs(spark, texts):
    return spark.createDataFrame(
        [(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string"
    )


def by_doc(chunks, n):
    found = {i: [] for i in range(n)}
    for row in chunks.orderBy("doc_id", "chunk_no").collect():
        assert row.chunk_no == len(found[row.doc_id])
        found[row.doc_id].append(row.text)
    return [found[i] for i in range(n)]


def random_texts(rng, n):
    alphabet = ["a", "B", " ", "\n", "\n\n", "é", "😀", ".", "\r"]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("size,overlap", [(10, 3), (10, 0), (7, 6), (5, 4), (1, 0), (30, 29)])
def test_fixed_windows(spark, rng, size, overlap):
    texts = random_texts(rng, 60)
    found = by_doc(chunk_fixed(docs(spark, texts), size, overlap), len(texts))
    assert found == [windows(t, size, overlap) for t in texts]


def test_fixed_counts_at_the_edges(spark):
    lengths = [0, 1, 950, 951, 1000, 1001, 1900, 1901]
    texts = ["x" * n for n in lengths]
    counts = [len(c) for c in by_doc(chunk_fixed(docs(spark, texts)), len(texts))]
    assert counts == [0, 1, 1, 2, 2, 2, 2, 3]
    rows = docs(spark, texts).orderBy("doc_id").select(fixed_chunk_count(F.col("text")).alias("n"))
    assert [r.n for r in rows.collect()] == counts


def test_a_null_text_has_no_chunks(spark):
    assert chunk_fixed(docs(spark, [None, ""])).count() == 0
    assert chunk_recursive(docs(spark, [None, "", " \n "])).count() == 0


@pytest.mark.parametrize("size,overlap", [(5, 5), (5, 6), (0, 0), (5, -1)])
def test_settings_that_cannot_move_on(spark, size, overlap):
    with pytest.raises(ValueError):
        chunk_fixed(docs(spark, ["x"]), size, overlap)


def test_ids_are_stable_and_tell_chunks_apart(spark):
    table = docs(spark, ["ab" * 700, "ab" * 700])
    first = with_chunk_ids(chunk_fixed(table)).select("chunk_id").collect()
    again = with_chunk_ids(chunk_fixed(table.repartition(3))).select("chunk_id").collect()
    assert {r.chunk_id for r in first} == {r.chunk_id for r in again}
    assert len({r.chunk_id for r in first}) == len(first) == 4


def split_by_strings(text, separators, size, overlap):
    """The same rule on lists of strings, as an independent check of the version on offsets."""
    at = next(i for i, s in enumerate(separators) if s in text)
    sep, finer = separators[at], separators[at + 1 :]
    if sep:
        parts = text.split(sep)
        parts = [p for p in [parts[0]] + [sep + p for p in parts[1:]] if p]
    else:
        parts = list(text)
    out, run = [], []

    def close():
        window = []
        for part in run:
            if len("".join(window)) + len(part) > size:
                if window:
                    out.append("".join(window))
                while window and (
                    len("".join(window)) > overlap or len("".join(window)) + len(part) > size
                ):
                    window.pop(0)
            window.append(part)
        if window:
            out.append("".join(window))
        run.clear()

    for part in parts:
        if len(part) < size or not finer:
            run.append(part)
        else:
            close()
            out.extend(split_by_strings(part, finer, size, overlap))
    close()
    return out


texts = st.text(alphabet="ab \n.é😀", max_size=120)


@settings(max_examples=400, deadline=None)
@given(texts, st.integers(2, 30), st.integers(0, 29))
def test_recursive_rule(text, size, overlap):
    overlap = min(overlap, size - 1)
    chunks = split_recursive(text, size, overlap)
    plain = split_by_strings(text, ["\n\n", "\n", " ", ""], size, overlap) if text else []
    assert chunks == [c for c in (p.strip() for p in plain) if c]
    assert all(0 < len(c) <= size and c in text for c in chunks)
    assert bool(chunks) == bool(text.strip())


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 30))
def test_recursive_without_overlap_loses_no_character(text, size):
    squeezed = "".join("".join(split_recursive(text, size, 0)).split())
    assert squeezed == "".join(text.split())


def test_recursive_prefers_coarse_separators(spark):
    found = by_doc(chunk_recursive(docs(spark, ["one two\n\nthree four", "x" * 25]), 12, 2), 2)
    assert found[0] == ["one two", "three four"]
    assert found[1] == ["x" * 12, "x" * 12, "x" * 5]


@pytest.mark.parametrize("size,overlap", [(10, 3), (10, 0), (4, 3), (50, 10)])
def test_pages_cut_like_their_concatenation(spark, rng, size, overlap):
    rows, whole = [], []
    for doc in range(12):
        pages = [t for t in random_texts(rng, rng.randint(1, 9))]
        numbers = sorted(rng.sample(range(60_000), len(pages)))
        rows += [(doc, n, t) for n, t in zip(numbers, pages)]
        whole.append("".join(pages))
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, page_no long, text string")
    assert by_doc(chunk_pages(table, size, overlap), 12) == [windows(t, size, overlap) for t in whole]


def test_chunks_are_handed_on_after_every_few_texts(spark, monkeypatch):
    texts = ["one two three four", None, "", "x" * 25, " ", "five six\n\nseven"]
    whole = sorted(map(tuple, chunk_recursive(docs(spark, texts).coalesce(1), 12, 2).select("doc_id", "chunk_no", "text").collect()))
    monkeypatch.setattr(chunk, "HELD_CHARACTERS", 10)
    assert sorted(map(tuple, chunk_recursive(docs(spark, texts).coalesce(1), 12, 2).select("doc_id", "chunk_no", "text").collect())) == whole and whole
