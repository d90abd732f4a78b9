import re

import pyarrow as pa
from pyspark.sql import functions as F

from passages.llm import quality as q
from tests_llm_samples import documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return [
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)
    ]


def test_measures_equal_plain_python():
    texts = [r[1] for r in documents(60, seed=2) if len(r[1] or "") < 5_000]
    texts += ["a b c d e a b c d e f", "x\nx\n x\nx ", "<#> $% é&", "q " * 40, "\n\n", "word"]
    assert q.measure_batch(pa.array(texts)).tolist() == [measures(t) for t in texts]
    assert q.measure_batch(pa.array(texts + texts).slice(7, 20)).tolist() == [measures(t) for t in (texts + texts)[7:27]]
    assert q.measure_batch(pa.array([], pa.string())).shape == (0, 6)


def test_junk_goes_and_clean_stays(spark):
    clean = [(k, " ".join(f"word{(k * 31 + i * 7) % 997}" for i in range(60)), "en", f"s{k % 2}", 0) for k in range(200)]
    junk = [(900, " ".join(f"w{i}$$$$" for i in range(60)), "en", "s0", 0), (901, "so short", "en", "s0", 0)]
    docs = frame(spark, clean + junk).withColumn("kept", F.lit("x")).withColumn("n_words", F.lit(0)).withColumn("row", F.lit(1))
    out = q.quality_filter(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [r[0] for r in clean]


def test_small_groups_take_the_fences_of_larger_ones(spark):
    counts = spark.createDataFrame(
        [("=en", "=a", "symbols", 0, 60), ("=en", "=b", "symbols", 500, 3), ("=fr", "=c", "symbols", 900, 2)],
        "lang_key string, source_key string, measure string, bucket long, n long",
    )
    got = {(r.lang_key, r.source_key): r.high_symbols for r in q.fences(counts).collect()}
    assert got == {("=en", "=a"): 50, ("=en", "=b"): 50, ("=fr", "=c"): 50}


def test_groups_of_other_clean_levels_have_other_fences(spark):
    """Prose without symbols, and code in which every text has some: what is junk in one is plain in the other."""
    prose = [(k, " ".join(f"word{(k * 31 + i * 7) % 997}" for i in range(60)), "en", "prose", 0) for k in range(100)]
    code = [
        (1_000 + k, " ".join(f"w{(k * 17 + i * 5) % 997}" + ("=&a" if i % 6 < k % 4 else "") for i in range(60)), "en", "code", 0)
        for k in range(100)
    ]
    strange = [(900, " ".join(f"w{i}" + ("&&" if i % 3 == 0 else "") for i in range(60)), "en", s, 0) for s in ("prose",)]
    strange += [(901, strange[0][1], "en", "code", 0)]
    docs = frame(spark, prose + code + strange)
    fences = {r.source_key: r.high_symbols for r in q.fences(q.sketches(q.measure(docs))).collect()}
    assert fences["=code"] > 3 * fences["=prose"]
    kept = {r.doc_id for r in q.quality_report(docs).where("kept").collect()}
    assert kept == {r[0] for r in prose + code} | {901}


def test_odd_tables(spark):
    assert q.quality_report(frame(spark, [])).count() == 0 and q.quality_filter(frame(spark, [])).count() == 0
    got = {r.doc_id: (r.base_failed, r.kept) for r in q.quality_report(frame(spark, [(1, None, None, None, None)])).collect()}
    assert got == {1: (True, False)}
    rows = documents(30)
    twice = q.quality_report(frame(spark, rows + rows))
    assert twice.count() == 2 * len(rows) and twice.distinct().count() == len(rows)
