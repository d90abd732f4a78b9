from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
from pyspark.sql import functions as F

from passages.llm import mixing as mx
from tests_llm_samples import documents, frame


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=7), st.integers(0, 80))
def test_seats_go_to_the_highest_quotients(votes, house):
    votes = [Fraction(v, 3) for v in votes]
    got = [0] * len(votes)
    for _ in range(house if sum(votes) else 0):
        got[max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
    assert mx.seats(votes, [house]) == [got]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(sizes):
    weights = [1 + k % 3 for k in range(len(sizes))]
    found = mx.targets(sizes, weights)
    assert sum(found) == sum(sizes) and all(t <= 3 * s for t, s in zip(found, sizes))
    free = [t / w for t, s, w in zip(found, sizes, weights) if t < 3 * s]
    assert len(set(free)) <= 1
    assert all(t / w <= free[0] for t, s, w in zip(found, sizes, weights) if free and t == 3 * s)


def rows_of(df):
    return sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken, r.source or "~") for r in df.collect())


def test_report(spark):
    rows = documents(200, seed=3)
    docs = frame(spark, rows)
    got = mx.mix_report(docs).collect()
    assert rows_of(mx.mix_report(docs.repartition(5))) == rows_of(mx.mix_report(docs)), "reruns agree"
    sizes = {r[0]: len((r[1] or "").split()) for r in rows if r[1] != "é" * 60}
    assert all(r["size"] == sizes[r.doc_id] for r in got if r.doc_id in sizes) and len(got) == len(rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    by_source = {}
    for r in got:
        total = by_source.setdefault(r.source, [0, 0, r.target, r.source_size])
        total[0] += r["size"]
        total[1] += r.taken
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    want = mx.targets([by_source[s][0] for s in order], [1 + k % 3 for k in range(len(order))])
    for source, target in zip(order, want):
        size, taken, told, of_source = by_source[source]
        assert size == of_source and abs(told - target) < 1e-6 and abs(taken - target) < 0.02 * target


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 60), st.integers(1, 50), st.integers(0, 200), st.integers(0, 200))
def test_floor_sums(n, m, a, b):
    assert mx.floor_sums(np.array([n]), np.array([m]), np.array([a]), np.array([b])).tolist() == [sum((a * j + b) // m for j in range(n))]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 9), st.integers(1, 40), st.integers(0, 200), st.integers(0, 300), st.integers(0, 130))
def test_words_on_seats_equal_counting(block, blocks, begin, size, bound):
    """Seat by seat: seat s lies on the block whose rank is s mod blocks."""
    begin, rank = begin % (block * blocks), lambda j: (1_000_003 * j + mx.SEED) % blocks
    size = min(size, block * blocks - begin)
    bound = min(bound, 3 * blocks)
    seats = {j: sum(s % blocks == rank(j) for s in range(bound)) for j in range(blocks)}
    want = sum(seats[w // block] for w in range(begin, begin + size))
    got = mx.words_on_seats(*(np.array([[x]]) for x in (begin, size, block, blocks)), np.array([[bound]]))
    assert got.tolist() == [[want]]


def test_a_document_of_very_many_blocks():
    """A hundred million words in blocks of one word, beside closed forms."""
    n = 100_000_000
    got = mx.words_on_seats(*(np.array([[x]]) for x in (0, n, 1, n)), np.array([[0, n // 3, n, 2 * n + 5, 3 * n]]))
    assert got.tolist() == [[0, n // 3, n, 2 * n + 5, 3 * n]]


def test_taken_words_equal_a_plain_mix(spark):
    """Every source laid end to end in seeded order, its words counted seat by seat."""
    docs = frame(spark, documents(120, seed=9))
    rows = mx.mix_report(docs).collect()
    sized = mx.word_counts(docs, "doc_id", "source")
    order = {r.doc_id: r.p for r in sized.select("doc_id", mx._place().alias("p")).collect()}
    totals = {}
    for r in rows:
        totals[r.source] = totals.get(r.source, 0) + r["size"]
    for source, _, _, block, blocks, seats, starts in mx.quotas(list(totals.items())):
        step = next((p for p in mx.STEPS if blocks and blocks % p), 1)
        begin = 0
        for r in sorted((r for r in rows if r.source == source), key=lambda r: (order[r.doc_id], r.doc_id)):
            ranks = [(step * (w // block) + mx.SEED) % blocks for w in range(begin, begin + r["size"])]
            often = [len(range(x, seats, blocks)) for x in ranks]
            assert r.taken == sum(often)
            shards = [sum(len(range(x, b, blocks)) - len(range(x, a, blocks)) for x in ranks) for a, b in zip(starts, starts[1:])]
            assert r.shard_words == shards
            begin += r["size"]


def test_documents(spark):
    docs = frame(spark, documents(200, seed=3)).withColumn("begin", F.lit(1)).withColumn("times", F.lit("x"))
    out = mx.mix_documents(docs)
    assert out.columns == docs.columns
    often = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert set(often.values()) <= {1, 2, 3}
    assert out.subtract(docs).count() == 0
    assert mx.mix_documents(frame(spark, [])).count() == 0 and mx.mix_report(frame(spark, [])).count() == 0
    empty = frame(spark, [(1, None, None, None, 0), (2, "", "en", "a", 0)])
    assert [r.taken for r in mx.mix_report(empty).collect()] == [0, 0] and mx.mix_documents(empty).count() == 0


def test_each_rank_falls_on_one_block(spark):
    for n in (1, 2, 7, 1000, mx.STEPS[0]):
        blocks = spark.range(n).select(F.lit(n).cast("long").alias("blocks"), F.col("id"))
        assert blocks.select(mx.rank(F.col("id")).alias("r")).agg(F.countDistinct("r"), F.min("r"), F.max("r")).first()[:] == (n, 0, n - 1)


def test_shard_quotas_add_up():
    found = mx.quotas([("a", 90_000), (None, 30_000), ("b", 50_000)])
    for _, _, _, _, blocks, seats, starts in found:
        assert len(starts) == mx.SHARDS + 1 and starts[0] == 0 and starts[-1] == seats <= 3 * blocks
        assert all(x <= y for x, y in zip(starts, starts[1:]))


def test_every_shard_has_its_quota_of_every_source(spark):
    docs = frame(spark, documents(200, seed=3))
    rows = mx.mix_report(docs).collect()
    assert all(len(r.shard_words) == mx.SHARDS and sum(r.shard_words) == r.taken for r in rows)
    totals = {}
    for r in rows:
        totals[r.source] = totals.get(r.source, 0) + r["size"]
    quotas = {q[0]: q for q in mx.quotas(list(totals.items()))}
    for source, (_, size, _, block, blocks, seats, starts) in quotas.items():
        words = [sum(r.shard_words[k] for r in rows if r.source == source) for k in range(mx.SHARDS)]
        quota = [y - x for x, y in zip(starts, starts[1:])]
        # Every seat is a block of equally many words, but for the last block of the source.
        missing = blocks * block - size
        short = [q * block - w for q, w in zip(quota, words)]
        assert all(0 <= s <= mx.LIMIT * missing and s % max(1, missing) == 0 for s in short) and sum(quota) == seats
    copies = mx.mix_shards(docs).collect()
    assert sorted(r.doc_id for r in copies) == sorted(r.doc_id for r in mx.mix_documents(docs).collect())
    for r in copies:
        starts = quotas[r.source][6]
        assert starts[r.shard] <= r.seat < starts[r.shard + 1]
    assert len({r.shard for r in copies}) == mx.SHARDS
