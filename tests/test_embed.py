import hashlib
import math

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passages.functions import text as tx
from passages.functions.classify import softmax, threshold_label
from passages.operators import embed
from passages.operators.embed import batch_infer, embed_texts, valid_embeddings
from passages.operators.order import running_offset
from passages.operators.vector import semantic_hits


def plain_embedding(text, size):
    sums = [0] * size
    for word in "".join(c if c.isalnum() else " " for c in text.lower()).split():
        digest = hashlib.md5(word.encode()).hexdigest()
        sums[int(digest[:7], 16) % size] += -1 if digest[7] in "89abcdef" else 1
    length = math.sqrt(sum(s * s for s in sums))
    return [s / length if length else 0.0 for s in sums]


def test_hash_embedding(spark):
    texts = ["the cat and the hat", "", "!!!", "Éa é", "one", "x " * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    for size in (16, 768):
        found = {r.i: r.embedding for r in embed_texts(rows, size=size).collect()}
        for i, text in enumerate(texts):
            np.testing.assert_allclose(found[i], plain_embedding(text, size), atol=1e-7)


def test_a_failed_batch_costs_only_itself(spark):
    def build():
        def model(batch):
            if any(x % 10 == 7 for x in batch):
                raise RuntimeError("refused")
            return [float(x) for x in batch] if 40 not in batch else [1.0]

        return model

    rows = spark.range(0, 60, 1, 1).withColumnRenamed("id", "x")
    done = batch_infer(rows, build, "x", "y", T.DoubleType(), batch_size=4).orderBy("x").collect()
    for row in done:
        batch = range(row.x // 4 * 4, row.x // 4 * 4 + 4)
        failed = any(x % 10 == 7 for x in batch) or 40 in batch
        assert row.y == (None if failed else float(row.x))


def test_reasons_of_failed_items(spark):
    def build():
        def model(batch):
            if 3 in batch:
                raise RuntimeError("no threes")
            return [float(x) for x in batch]

        return model

    rows = spark.range(0, 10, 1, 1).withColumnRenamed("id", "x")
    for alone, failed in ((False, {0, 1, 2, 3}), (True, {3})):
        done = batch_infer(rows, build, "x", "y", T.DoubleType(), 4, "error", alone).collect()
        assert {r.x for r in done if r.y is None} == failed
        assert {r.x: r.error for r in done if r.error} == {x: "RuntimeError: no threes" for x in failed}


def test_words_of_any_script_find_themselves(spark):
    texts = ["привет мир", "другой текст", "ελληνικά", "中文 文本"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    points = embed_texts(rows, size=64)
    queries = rows.select(F.col("id").alias("query_id"), F.col("text").alias("query"))
    hits = semantic_hits(queries, points, 1, 64)
    assert {r.query_id: (r.id, r.score) for r in hits.collect()} == {k: (k, 1.0) for k in range(4)}


def test_valid_embeddings_drops_nulls(spark):
    table = spark.createDataFrame([(1, [0.5]), (2, None)], "i int, embedding array<float>")
    assert [r.i for r in valid_embeddings(table).collect()] == [1]


def test_running_offset(spark, rng):
    rows = []
    for group in "abc":
        for key in rng.sample(range(100), 40):
            rows.append((group, key, rng.randint(0, 9)))
    table = spark.createDataFrame(rows, "g string, k long, n int")
    expected = {(g, k): sum(n for g2, k2, n in rows if g2 == g and k2 < k) for g, k, _ in rows}
    for width in (1, 7, 1000, None):
        found = running_offset(table, "g", "k", F.col("n"), "before", width).collect()
        assert {(r.g, r.k): r.before for r in found} == expected


def test_running_offset_of_hashed_keys_has_few_blocks(spark):
    keys = spark.range(20_000).select(F.lit("s").alias("g"), F.xxhash64("id").alias("k"), F.lit(1).alias("n"))
    found = running_offset(keys, "g", "k", F.col("n"), "before")
    assert [r.before for r in found.orderBy("k").limit(5).collect()] == [0, 1, 2, 3, 4]
    assert found.agg(F.max("before")).first()[0] == 19_999


def test_threshold_label(spark):
    rows = [([0.5, 0.5],), ([0.1, 0.9],), ([0.2, 0.19],), ([0.19, 0.1],)]
    table = spark.createDataFrame(rows, "p array<double>")
    classes = F.array(F.lit("x"), F.lit("y"))
    tags = [r.t for r in table.select(threshold_label(F.col("p"), classes, 0.2).alias("t")).collect()]
    assert tags == ["x", "y", "x", "other"]


def test_softmax_of_large_logits(spark):
    table = spark.createDataFrame([([1000.0, 1001.0],), ([0.0, 0.0],)], "x array<double>")
    found = [r.p for r in table.select(softmax(F.col("x")).alias("p")).collect()]
    np.testing.assert_allclose(found, [[1 / (1 + math.e), math.e / (1 + math.e)], [0.5, 0.5]])


def test_sums_in_small_steps_are_the_same(spark, monkeypatch):
    texts = ["one two three two", None, "", "two", "four one", "x y z x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    whole = {r.id: r.embedding for r in embed_texts(rows, size=64).collect()}
    monkeypatch.setattr(embed, "SUM_CELLS", 2 * 64)
    assert {r.id: r.embedding for r in embed_texts(rows, size=64).collect()} == whole


def test_words_of_any_script_are_cut_once_from_the_text(spark):
    texts = ["Don’t “Stop” – naïve CAFÉ", "İstanbul ΣΑΣ ǅ", "日本語、テスト。x", "a\u00a0b\u2028c\u0301d", "½ ² Ⅷ ٣x_y", "😀a😀", "\x00\x7fz", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts * 3)), "i int, text string").coalesce(1)
    found = embed_texts(rows, size=64).withColumn("words", tx.words(F.col("text"))).collect()
    for row in found:
        sums = [0.0] * 64
        for word in row.words or []:
            digest = hashlib.md5(word.encode()).hexdigest()
            sums[int(digest[:7], 16) % 64] += -1 if digest[7] in "89abcdef" else 1
        length = math.sqrt(sum(s * s for s in sums))
        np.testing.assert_allclose(row.embedding, [s / length if length else 0.0 for s in sums], atol=1e-7)
    plan = embed_texts(rows, size=64)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan
