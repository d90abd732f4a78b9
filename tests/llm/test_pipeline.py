"""The pipeline at the smallest scale; what each stage does is compared with plain Python."""

import pytest

import corpus_pipeline
from passages.llm import decontaminate, mixing, quality
from test_decontaminate import tiles, words
from test_ngram_join import expected as components_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, spark.createDataFrame(docs.collect(), docs.schema), SF)
        out.append(docs.collect())
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_names_and_columns(spark, steps):
    assert len(corpus_pipeline.STAGES) == 5
    columns = steps[0][0].__fields__
    assert all(s[0].__fields__ == columns for s in steps[:5]) and steps[5][0].__fields__ == [*columns, "shard"]


def test_quality(spark, steps):
    report = quality.quality_report(spark.read.parquet(f"{SF}/documents.parquet"))
    assert ids(steps[1]) == ids(report.where("kept").collect())


def test_near_duplicates(steps):
    want = components_of([(r.doc_id, r.text) for r in steps[1]], corpus_pipeline.NEAR)
    assert ids(steps[2]) == sorted(k for k, (_, root, _) in want.items() if k == root)


def test_decontamination(spark, steps):
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    item_grams = [grams(i) for i in items]

    def holds(text):
        doc = words(text)
        mine = grams(doc)
        return any(mine & g and 2 * sum(tiles(doc, i, decontaminate.MIN_MATCH)) >= len(i) for i, g in zip(items, item_grams))

    assert ids(steps[3]) == sorted(r.doc_id for r in steps[2] if not holds(r.text))


def test_mix(steps):
    count = lambda rows: {s: sum(len(r.text.split()) for r in rows if r.source == s) for s in {r.source for r in rows}}
    had, has = count(steps[3]), count(steps[4])
    order = sorted(had, key=lambda s: (s is None, s or ""))
    want = mixing.targets([had[s] for s in order], [1 + k % 3 for k in range(len(order))])
    longest = max(len(r.text.split()) for r in steps[3])
    assert all(abs(has.get(s, 0) - t) <= 4 * longest for s, t in zip(order, want))
    assert {r.doc_id for r in steps[4]} <= {r.doc_id for r in steps[3]}


def test_shards(steps):
    assert ids(steps[5]) == ids(steps[4]) and {r.shard for r in steps[5]} <= set(range(16))


def test_run(spark, steps):
    assert ids(corpus_pipeline.run(spark, SF).collect()) == ids(steps[5])
