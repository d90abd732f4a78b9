import zlib

from pyspark.sql import functions as F

from passages.llm import sharding as sh
from tests_llm_samples import documents, frame


def test_law_of_bytes(spark):
    rows = [(k, "x" * (k % 50), "en", "a" if k % 3 else f"s{k % 7}", 0) for k in range(6_000)]
    got = sh.shard_report(frame(spark, rows)).collect()
    texts = {r[0]: r[1] for r in rows}
    totals, slots = [0] * 16, [[] for _ in range(16)]
    for r in got:
        assert r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.law == "bytes" and r.grown_shard is None
        totals[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows)
    assert max(totals) - min(totals) < 0.02 * max(totals)
    assert all(sorted(s) == list(range(len(s))) for s in slots)


def test_hot_text_is_cut_and_equal_texts_lie_together(spark):
    rows = [(k, "the same text" if k % 3 == 0 else f"text {k // 2}", "en", "a", 0) for k in range(3_000)]
    got = sh.shard_report(frame(spark, rows), 8).collect()
    shards = {}
    totals = {}
    for r in got:
        shards.setdefault(rows[r.doc_id][1], set()).add(r.shard)
        totals[r.shard] = totals.get(r.shard, 0) + r["size"]
    assert len(totals) == 8 and max(totals.values()) < 1.05 * min(totals.values())
    parted = [t for t, s in shards.items() if len(s) > 1]
    assert len(parted) <= 8


def test_odd_tables(spark):
    rows = documents(30)
    docs = frame(spark, rows + rows[:5]).withColumn("size", F.lit("x")).withColumn("node", F.lit(0)).withColumn("shard", F.lit("old"))
    out = sh.shard_documents(docs, 3)
    assert out.columns == docs.columns and out.count() == len(rows) + 5
    assert {r.shard for r in out.select("shard").distinct().collect()} == {0, 1, 2}
    assert sh.shard_report(frame(spark, [])).count() == 0 and sh.shard_documents(frame(spark, [])).count() == 0
    alone = sh.shard_report(frame(spark, [(None, None, None, None, None)])).collect()
    assert [(r["size"], r.text_crc32, r.slot) for r in alone] == [(1, 0, 0)]


def test_no_python_in_the_plan(spark):
    plan = sh.shard_report(frame(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
