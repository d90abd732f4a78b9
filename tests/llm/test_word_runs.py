import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passages.llm import text_arrays as ta
from passages.llm import word_runs
from tests_llm_samples import documents, frame


def brute_force(words):
    """Runs of every period, each stretch with its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def in_order(runs):
    return sorted(runs, key=lambda r: (r[0], r[2]))


def found_runs(texts):
    out = []
    for _, _, data, offsets in ta.slices(pa.array(texts, pa.string())):
        start, end, before = ta.words(data, offsets)
        runs = word_runs.runs_of(word_runs.word_codes(data, start, end), before)
        text = np.searchsorted(before, runs[:, 0], "right") - 1
        for k in range(len(before) - 1):
            out.append([(s - before[k], n, q) for s, n, q in runs[text == k].tolist()])
    return out


def turned(rng, n, letters):
    """Words with stretches that repeat themselves, also inside each other."""
    words = []
    while len(words) < n:
        turn = [rng.choice(letters) for _ in range(rng.randrange(1, 9))]
        if rng.random() < 0.3:
            turn = turn * rng.randrange(1, 6) + [rng.choice(letters)]
        words += turn * rng.choice([1, 1, 2, 3, 4, 5, 7, 12]) + turn[: rng.randrange(len(turn))]
    return words[:n]


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefgh"])
def test_runs_equal_brute_force(letters):
    rng = random.Random(len(letters))
    texts = [turned(rng, rng.choice([0, 1, 5, 6, 7, 30, 120, 400]), letters) for _ in range(150)]
    found = found_runs([" ".join(t) for t in texts])
    for words, runs in zip(texts, found):
        assert runs == in_order(brute_force(words)), words


def expected(rows):
    out = {}
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = in_order(brute_force(words))
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        text = " ".join(w.decode() for i, w in enumerate(words) if i not in gone)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        exponent = best[1] and 1000 * best[1] // best[2]
        out[doc_id] = (len(runs), *best, exponent, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, text)))
    return out


def report(docs):
    rows = word_runs.run_report(word_runs.find_runs(word_runs.plant_repeats(docs))).collect()
    return {
        r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in rows
    }


def test_report_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [r for r in documents(150) if len(r[1] or "") < 5_000]
    rows += [(1_000 + k, "\t\n ".join(turned(rng, 150, ["a", "é", "ccc"])), None, None, 0) for k in range(60)]
    assert report(frame(spark, rows)) == expected(rows)


def test_texts_longer_than_a_slice():
    rng = random.Random(2)
    words = [f"w{rng.randrange(5_000)}" for _ in range(60_000)]
    words[30_000:50_000] = [f"v{k % 4_000}" for k in range(20_000)]
    words[100:106] = ["x"] * 6
    found = found_runs(["before before", " ".join(words), "a b " * 4])
    assert found == [[], [(100, 6, 1), (30_000, 20_000, 4_000)], [(0, 8, 2)]]
    assert len(" ".join(words)) > ta.SLICE_BYTES


@pytest.mark.parametrize("text", ["a " * 300_000, "a b a b c " * 60_000, "x y " * 150_000 + "x " * 9])
def test_long_repetitions_take_seconds(text):
    began = time.time()
    assert max(r[1] for r in found_runs([text])[0]) >= 300_000 - 1
    assert time.time() - began < 40


def test_odd_tables(spark):
    assert report(frame(spark, [])) == {}
    rows = [(1, None, None, None, 0), (2, "", None, None, 0), (3, "a a a a a a", None, None, 0), (4, " \t ", None, None, 0)]
    docs = frame(spark, rows).withColumn("runs", F.lit("x")).withColumn("collapsed", F.lit(0)).withColumn("start", F.lit(0))
    assert report(docs) == expected(rows)
    twice = word_runs.find_runs(frame(spark, [rows[2], rows[2], (None, "b b b b b b c", None, None, 0)])).collect()
    assert sorted(r.collapsed for r in twice) == ["a", "a", "b c"]
    assert word_runs.plant_repeats(frame(spark, [(None, "a b", None, None, 0)])).first().text == "a b"
