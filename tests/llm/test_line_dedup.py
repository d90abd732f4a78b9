import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passages.llm import line_dedup as ld
from passages.llm import ngram_join as nj
from tests_llm_samples import documents, frame

LOWER = {c: c + 32 for c in range(65, 91)}


def expected(rows):
    """(doc_id, line_no) of the removed lines."""
    lines = [
        (doc_id, k, frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.translate(LOWER))))
        for doc_id, text, *_ in sorted(rows, key=lambda r: r[0])
        for k, line in enumerate((text or "").split("\n"))
    ]
    lines = [x for x in lines if x[2]]
    return {
        (doc_id, k)
        for i, (doc_id, k, words) in enumerate(lines)
        if any(100 * len(words & other) >= 80 * len(words | other) for _, _, other in lines[:i])
    }


def found(df):
    return {(r.doc_id, r.line_no) for r in df.where("removed").collect()}


def lines(seed):
    rng = random.Random(seed)
    pool = [[f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 30))] for _ in range(25)]
    rows = []
    for k in range(50):
        text = []
        for _ in range(6):
            line = list(rng.choice(pool))
            for _ in range(rng.randrange(3)):
                line[rng.randrange(len(line))] = f"w{rng.randrange(40)}"
            text.append(" ".join(line))
        rows.append((k, "\n".join(text), "en", "a", 0))
    return rows


@pytest.mark.parametrize(("hot", "block"), [(20_000, 4_096), (8, 4)])
def test_removed_lines_equal_brute_force(spark, monkeypatch, hot, block):
    monkeypatch.setattr(ld, "HOT_WORD", hot)
    monkeypatch.setattr(ld, "BLOCK_ROWS", block)
    rows = lines(hot) + [(100 + r[0], *r[1:]) for r in documents(20)]
    assert found(ld.removed_lines(frame(spark, rows))) == expected(rows)


def test_report_and_texts(spark):
    rows = [(1, "a b\n\nc d e", "en", "s", 0), (2, "B a\nnew line\n\nc d e", "en", "s", 0), (3, None, "en", "s", 0)]
    docs = frame(spark, rows).withColumn("line_no", F.lit("x")).withColumn("gone", F.lit(1)).withColumn("row", F.lit(2))
    report = {r.doc_id: (r.n_lines, r.n_removed, r.kept_chars, r.removed_lines) for r in ld.line_report(docs).collect()}
    assert report == {1: (2, 0, 8, ""), 2: (3, 2, 8, "0,3"), 3: (0, 0, 0, "")}
    out = ld.dedup_lines(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a b\n\nc d e", 2: "new line\n", 3: None}
    assert ld.removed_lines(frame(spark, [])).count() == 0


def test_rows_of_one_document(spark):
    rows = [(1, "a b c\nx", "en", "s", 0), (1, "z\nx", "en", "s", 0), (1, "a b c", "en", "s", 0), (1, None, "en", "s", 0)]
    rows += [(None, "y\nx\ny", "en", "s", 0), (2, "A b c\nnew\nz", "en", "s", 0)]
    docs = frame(spark, rows[1:]).unionByName(frame(spark, rows[:1]))
    marked = sorted((r.doc_id or 0, r.line_no, r.n_chars, r.removed) for r in ld.removed_lines(docs).collect())
    assert marked == [
        (0, 0, 1, False), (0, 1, 1, False), (0, 2, 1, True), (1, 0, 1, False), (1, 0, 5, False), (1, 0, 5, False),
        (1, 1, 1, True), (1, 1, 1, True), (2, 0, 5, True), (2, 1, 3, False), (2, 2, 1, True),
    ]
    report = {r.doc_id: (r.n_lines, r.n_removed, r.kept_chars, r.removed_lines) for r in ld.line_report(docs).collect()}
    assert report == {None: (3, 1, 2, "2"), 1: (5, 2, 11, "1"), 2: (3, 2, 3, "0,2")}


def test_postings_are_narrow(spark):
    docs = frame(spark, documents(20))
    levels = spark.sparkContext.broadcast(np.full(1 << 8, 9, np.uint8))
    table = ld.line_table(docs, levels)
    assert ld.dealt_postings(table).dtypes == [
        ("own", "int"), ("task", "bigint"), ("a", "bigint"), ("m0", "bigint"), ("m1", "bigint"), ("place", "bigint"),
    ]
    assert table.count() == docs.count()


def test_bitmaps_tell_long_lines_apart():
    rng = np.random.default_rng(5)
    for n in (40, 200):
        sets = rng.integers(0, 1 << 62, 40 * n).astype(np.uint64)
        with np.errstate(over="ignore"):
            m0, m1 = ld.bitmaps(sets, np.full(40, n))
        differ = np.bitwise_count(m0[0] ^ m0[1:]).astype(int) + np.bitwise_count(m1[0] ^ m1[1:])
        assert ((2 * n - differ) // 2 < ld.RULE.needed(n, n)).mean() > 0.9
        near = np.r_[sets[:n], sets[:n]]
        near[n] = 7
        with np.errstate(over="ignore"):
            m0, m1 = ld.bitmaps(near, np.full(2, n))
        assert int(np.bitwise_count(m0[0] ^ m0[1]) + np.bitwise_count(m1[0] ^ m1[1])) <= 2


def test_pairs_of_one_cluster_have_one_leader():
    """However many words two sets share, they meet once; sets that only share a word do not meet."""
    n, bits = 40, 1 << 40
    one = [(w, 11, 5, n << 32 | k) for k, w in enumerate((100, 200, 300))]
    two = [(w, 12, 5, n << 32 | k) for k, w in enumerate((100, 200, 300))]
    far = [(w, 13 + k, bits * (2**20 - 1) * (k + 1), n << 32) for w in (100, 200) for k in (0,)]
    pair = [(100, 20, bits - 1, n << 32), (200, 20, bits - 1, n << 32 | 1), (100, 21, bits - 1, n << 32), (200, 21, bits - 1, n << 32 | 1)]
    rows = sorted(one + two + far + pair)
    columns = [pa.array(c) for c in zip(*[(0, w, a, m, 0, place) for w, a, m, place in rows])]
    batch = pa.RecordBatch.from_arrays(columns, ["own", "task", "a", "m0", "m1", "place"])
    out = {(r["a"], r["leader"], r["n"]) for b in ld.filtered(iter([batch])) for r in b.to_pylist()}
    assert out == {(11, 11, n), (12, 11, n), (20, 20, n), (21, 20, n)}


def test_sets_where_first_bits_are_equal():
    levels = np.zeros(1 << 8, np.uint8)
    hashes = (np.array([3, 2, 2, 1, 0, 5, 4, 5], np.uint64) << np.uint64(nj.LEVEL_BITS)) | np.uint64(1)
    numbers, sizes = ld.line_sets(hashes, np.array([5, 3]), levels)
    assert numbers.tolist() == [0, 1, 2, 3, 4, 5] and sizes.tolist() == [4, 2]


def test_words_of_any_length():
    words = ["", "a", "a\0", "b" * 8, "b" * 9, "c" * 8 + "d" * 8, "c" * 8 + "e" * 8, "f" * 64, "f" * 65, "f" * 64 + "g", "é" * 7, "É" * 7]
    text = pa.array([" ".join(words), "A " + "F" * 65 + "\n" + "B" * 9 + " é"])
    with np.errstate(over="ignore"):
        (_, first), *_ = ld.Words().of(text)
    assert len(set(first[: len(words) - 1].tolist())) == len(words) - 1
    again = first[len(words) - 1 :].tolist()
    assert again[:3] == [first[0], first[7], first[3]] and again[3] not in first[:-1].tolist()
