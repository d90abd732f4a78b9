import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from passages.llm import ngram_join as nj
from passages.llm.components import components
from tests_llm_samples import documents, frame

LOWER = {c: c + 32 for c in range(65, 91)}


def sets_of(rows, width):
    out = {}
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        n = len(words)
        out[doc_id] = {tuple(words[i : i + width]) for i in range(max(1, n - width + 1))} if n else set()
    return out


def expected(rows, rule):
    sets = sets_of(rows, rule.width)
    root = {k: k for k in sets}
    links = dict.fromkeys(sets, 0)
    ids = sorted(sets)
    changed = True
    pairs = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= rule.percent * len(sets[a] | sets[b])
    ]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return {k: (len(sets[k]), root[k], links[k]) for k in sets}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in df.collect()}


@pytest.mark.parametrize("rule", [nj.Rule(), nj.Rule(5, 80), nj.Rule(2, 60)])
def test_join_equals_brute_force(spark, rule):
    rows = documents(90, seed=rule.width)
    assert found(nj.similar_documents(frame(spark, rows), rule)) == expected(rows, rule)


def test_hot_family_is_dealt_to_several_tasks(spark, monkeypatch):
    rng = random.Random(1)
    base = [f"t{k}" for k in range(60)]
    rows = []
    for k in range(80):
        parts = list(base)
        for _ in range(rng.randrange(3)):
            parts[rng.randrange(60)] = f"z{k}"
        rows.append((k, " ".join(parts), "en", "a", 0))
    monkeypatch.setattr(nj, "BLOCK_SETS", 16)
    assert found(nj.similar_documents(frame(spark, rows))) == expected(rows, nj.Rule())


def test_empty_table_and_other_columns(spark):
    assert nj.similar_documents(frame(spark, [])).count() == 0
    docs = frame(spark, [(1, "a b c d e", "en", "s", 9), (2, "a b c d e", "en", "s", 9)])
    odd = docs.withColumn("component_id", F.lit("x")).withColumn("n", F.lit(1)).withColumn("a", F.lit(2))
    assert found(nj.similar_documents(odd)) == {1: (2, 1, 1), 2: (2, 1, 1)}
    kept = nj.one_of_each(odd)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.collect()] == [1]


def test_tree_finds_what_pairs_find():
    rng = random.Random(3)
    rule = nj.Rule(1, 70)
    sets = [np.unique([rng.randrange(40) for _ in range(rng.randrange(1, 30))]) for _ in range(60)]
    sets = [np.array(s) for s in {tuple(s.tolist()) for s in sets}]
    tree = nj.PrefixTree(sets)
    for probe in sets:
        near = [
            k for k, s in enumerate(sets)
            if 100 * len(set(s) & set(probe)) >= 70 * len(set(s) | set(probe))
        ]
        assert sorted(tree.similar(probe, rule, 40)) == near


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    root = {x: x for p in pairs for x in p}
    for _ in range(len(root)):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    got = components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {x: root[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
