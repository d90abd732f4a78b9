import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from passages.llm import decontaminate as dc
from passages.llm import text_arrays as ta
from tests_llm_samples import documents, frame


def tiles(doc, item, m):
    """Greedy string tiling as it is defined, on lists of words."""
    in_doc, in_item, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = (m - 1, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while (
                    i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]
                    and not in_doc[i + n] and not in_item[j + n]
                ):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < m:
            return out
        out.append(n)
        in_doc[i : i + n] = [True] * n
        in_item[j : j + n] = [True] * n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=25))
def test_tiles_equal_the_definition(doc, item):
    m = 3
    seeds = [(i, j) for i in range(len(doc) - m + 1) for j in range(len(item) - m + 1) if doc[i : i + m] == item[j : j + m]]
    got = dc.tile(*(np.array(x) for x in zip(*seeds)), m) if seeds else []
    assert got == tiles(doc, item, m)


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    rows = documents(40, seed=8)
    pool = [r[1] for r in rows if r[1] and len(r[1]) > 200]
    items = []
    for k in range(12):
        parts = rng.choice(pool).split(" ")
        start = rng.randrange(max(1, len(parts) - 30))
        cut = parts[start : start + 30]
        items.append((k, " ".join(cut[15:] + cut[:15] if k % 2 else cut).upper()))
    items += [(50, None), (51, ""), (52, "too short"), (0, items[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {
        (r.doc_id, r.item_id): (r.item_words, r.matched_words, r.n_tiles)
        for r in dc.contaminated(frame(spark, rows), benchmark).collect()
    }
    want = {}
    for doc_id, text, *_ in rows:
        for item_id, item in items:
            a, b = words(text), words(item)
            if len(b) < dc.MIN_MATCH or len(a) > 2_000:
                continue
            found = tiles(a, b, dc.MIN_MATCH) if set(a) & set(b) else []
            if 2 * sum(found) >= len(b):
                want[doc_id, item_id] = (len(b), sum(found), len(found))
    assert {k: v for k, v in got.items() if len(words(dict((r[0], r[1]) for r in rows)[k[0]])) <= 2_000} == want
    assert want


def test_words_of_any_script():
    classes = dc.character_classes()
    texts = ["Ça, déjà vu — “naïve” text…", "", "日本語のテキスト と words", "हिन्दी पाठ", "x", "тест №5 ёлка", "ภาษาไทย", "a_b-c", "😀 ok", "한국어 문장"]
    column = pa.array([t.lower() for t in texts])
    got = []
    for _, _, data, offsets in ta.slices(column):
        start, end, before = dc.cut_words(data, offsets, classes)
        found = [data[a:b].tobytes().decode() for a, b in zip(start, end)]
        got += [found[a:b] for a, b in zip(before[:-1], before[1:])]
    assert got[0] == ["ça", "déjà", "vu", "naïve", "text"] and got[1] == [] and got[7] == ["a", "b", "c"] and got[8] == ["ok"]
    assert got[2] == [*"日本語のテキスト", "と", "words"] and got[6] == list("ภาษาไทย") and got[3] == ["हिन्दी", "पाठ"]
    assert got[5] == words(texts[5]) and got[9] == words(texts[9]) and got[4] == ["x"]


def test_items_of_any_script_are_found(spark):
    chinese, thai = "这是一个测试问题和它的答案", "นี่คือคำถามทดสอบ"
    quoted = "She said “never mind” and left – it was late, after all"
    plain = 'she said "never mind" and left - it was late; after all'
    rows = [(1, f"前言。{chinese}。后记", None, None, 0), (2, f"a {plain} z", None, None, 0), (3, f"x{thai} y", None, None, 0), (4, "别的文章", None, None, 0)]
    benchmark = spark.createDataFrame([(1, chinese), (2, quoted), (3, thai)], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.coverage) for r in dc.contaminated(frame(spark, rows), benchmark).collect()}
    assert found == {(1, 1, 1000), (2, 2, 1000), (3, 3, 1000)}


def test_clean_documents(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    moved = "zeta eta theta iota kappa, then: Alpha beta gamma delta epsilon"
    rows = [(1, f"before. {item} after", "en", "s", 0), (2, moved, "en", "s", 0), (3, "alpha beta", "en", "s", 0), (4, None, None, None, None)]
    docs = frame(spark, rows).withColumn("row", F.lit(7)).withColumn("item_id", F.lit("x"))
    benchmark = spark.createDataFrame([(9, item)], "item_id long, text string")
    out = dc.clean_documents(docs, benchmark)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [3, 4]
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.clean_documents(docs, none).count() == 4 and dc.contaminated(docs, none).count() == 0
    assert dc.contaminated(frame(spark, []), benchmark).count() == 0


def test_blocks_give_the_same(spark):
    items = [(k, " ".join(f"q{k}x{i}" for i in range(8))) for k in range(20)]
    docs = frame(spark, [(k, t, None, None, 0) for k, t in items])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(dc.benchmark_blocks(benchmark, block_bytes=200))
    assert len(blocks) > 3 and sorted(i for b in blocks for i in b.ids.tolist()) == list(range(20))
    assert isinstance(blocks[0], dc.Items) and pa is not None
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(docs, benchmark).collect()} == {(k, k) for k in range(20)}
