import hashlib
import random

import pytest
from pyspark.sql import functions as F

from passages.llm import suffix_dedup as sd
from tests_llm_samples import documents, frame


def expected(rows):
    first, out = {}, {}
    for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        covered = [False] * len(data)
        starts = range(len(data) - sd.WIDTH + 1)
        for i in starts:
            if first.get(data[i : i + sd.WIDTH], doc_id) < doc_id:
                covered[i : i + sd.WIDTH] = [True] * sd.WIDTH
        for i in starts:
            first.setdefault(data[i : i + sd.WIDTH], doc_id)
        kept = bytes(b for b, c in zip(data, covered) if not c)
        spans = sum(c and (i == 0 or not covered[i - 1]) for i, c in enumerate(covered))
        out[doc_id] = (len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


def found(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def passages(seed):
    """Documents that share passages around the width, at odd places."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcé \n") for _ in range(rng.choice([30, 49, 50, 51, 75, 120]))) for _ in range(12)]
    rows = []
    for k in range(60):
        parts = [rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice("xyz ") for _ in range(rng.randrange(60))) for _ in range(6)]
        rows.append((k, "".join(parts), "en", "a", 0))
    return rows


@pytest.mark.parametrize("many", [20_000, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, many, seed):
    monkeypatch.setattr(sd, "MANY_CONTEXTS", many)
    rows = passages(seed) + [(100 + r[0], *r[1:]) for r in documents(20, seed)]
    assert found(sd.remove_repeats(frame(spark, rows))) == expected(rows)


def test_odd_tables(spark):
    assert sd.remove_repeats(frame(spark, [])).count() == 0
    rows = [(1, "a" * 200, None, None, 0), (2, "a" * 200, None, None, 0)]
    docs = frame(spark, rows).withColumn("n_bytes", F.lit("x")).withColumn("g", F.lit(0)).withColumn("found", F.lit(0))
    assert found(sd.remove_repeats(docs)) == expected(rows)
    twice = frame(spark, rows + rows[1:])
    assert sorted(r.n_removed for r in sd.remove_repeats(twice).collect()) == [0, 200, 200]
    nameless = frame(spark, [(None, "a" * 200, None, None, 0), *rows])
    assert sorted(r.n_removed for r in sd.remove_repeats(nameless).collect()) == [0, 0, 200]


def test_kept_text(spark):
    passage = "The same long passage, word for word, in both of the texts here. "
    rows = [(1, f"x {passage}y", None, None, 0), (2, f"new {passage}end", None, None, 0)]
    kept = {r.doc_id: bytes(r.kept).decode() for r in sd.remove_repeats(frame(spark, rows)).collect()}
    assert kept == {1: f"x {passage}y", 2: "newend"}


def test_hot_ranks_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT_RANK", 4)
    monkeypatch.setattr(sd, "HOT_SHARE", 2)
    rows = passages(3)
    assert found(sd.remove_repeats(frame(spark, rows))) == expected(rows)
