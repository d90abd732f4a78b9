"""A mix of sources at target weights, by Sainte-Lague apportionment.

Every source is a stream of words: its documents in seeded order, end to end, cut into blocks of
equally many words. The mix has as many block seats as the corpus has blocks. Seats go to the
sources one after the other, each to the highest quotient target / (2 * seats + 1). Shards take consecutive runs of
that row of seats, so each shard has its whole-number quota per source and, as the method never
takes a seat back when the house grows, each shard is a mix of its own. A source's seats fall on its
blocks in a seeded order, over and over if it has more seats than blocks: the block of rank r has the seats r,
r + blocks, r + 2 * blocks and so on, and each of these copies lies in the shard whose run holds the seat.

Targets: the words of all documents, shared out by weight; no source gets more than LIMIT times its
own words, and what it cannot take goes to the others by weight.

Only totals per source meet on the driver (as the weights do); the places of documents in their
source come from two-level running totals, so a source of any size is many small windows.

Cases: a null source is a source, the last; null and empty texts have size 0 and are taken 0 times;
equal rows take places one after the other; an empty table gives an empty table; other columns pass.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from passages.llm import text_arrays as ta
from passages.llm.storage import stored

LIMIT = 3
SHARDS = 16
SEED = 20
LONGEST_BLOCK = 1024
#: The smallest source has at least so many blocks (if it has so many words).
LEAST_BLOCKS = 1024
BUCKET_ROWS = 4_096
BROADCAST_SOURCES = 20_000
#: Primes; block j of n has the rank (p * j + SEED) mod n with the first p that does not divide n.
STEPS = (1_000_003, 999_983)


def word_counts(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns and size, the number of words of `text`."""
    narrow = docs.select(*columns, F.col("text").cast("string").alias("text"))
    kept = [f for f in narrow.schema if f.name in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            for first, end, data, offsets in ta.slices(batch.column("text")):
                size[first:end] = np.diff(ta.words(data, offsets)[2])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(size)], [*columns, "size"]
            )

    return narrow.mapInArrow(run, T.StructType([*kept, T.StructField("size", T.LongType())]))


def targets(sizes: list[int], weights: list[int], limit: int = LIMIT) -> list[Fraction]:
    """The words each source shall have: min(limit * size, level * weight), all sizes in sum."""
    left, weight = Fraction(sum(sizes)), sum(weights)
    out = [Fraction(0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (Fraction(limit * sizes[i], weights[i]), i)):
        out[i] = min(Fraction(limit * sizes[i]), left * weights[i] / weight)
        left -= out[i]
        weight -= weights[i]
    return out


def seats(votes: list[Fraction], houses: list[int]) -> list[list[int]]:
    """Seats per source for each house size (ascending), by the highest quotients vote / (2s + 1).

    For one divisor, rounding votes / divisor gives the seats of some house; from a house slightly
    too small the missing seats are dealt one by one, at most a few per source.
    """
    total = sum(votes)
    out = []
    for house in houses:
        if not total or not house:
            out.append([0] * len(votes))
            continue
        divisor = total / house
        # Half a seat less for each source than the rounded share: never more than the house.
        got = [max(0, -((-(v / divisor - Fraction(1, 2))) // 1) - 1) if v else 0 for v in votes]
        got = [int(g) for g in got]
        queue = [(-v / (2 * g + 1), i) for i, (v, g) in enumerate(zip(votes, got)) if v]
        heapq.heapify(queue)
        for _ in range(house - sum(got)):
            _, i = heapq.heappop(queue)
            got[i] += 1
            heapq.heappush(queue, (-votes[i] / (2 * got[i] + 1), i))
        out.append(got)
    return out


def quotas(totals: list[tuple[str | None, int]], shards: int = SHARDS, limit: int = LIMIT) -> list[tuple]:
    """(source, source_size, target, block, blocks, seats, first seats of the shards)."""
    order = sorted(totals, key=lambda t: (t[0] is None, (t[0] or "").encode()))
    sizes = [t[1] for t in order]
    wanted = targets(sizes, [1 + k % 3 for k in range(len(order))], limit)
    smallest = min((s for s in sizes if s), default=0)
    block = max(1, min(LONGEST_BLOCK, smallest // LEAST_BLOCKS))
    house = sum(sizes) // block
    steps = seats(wanted, [house * k // shards for k in range(shards + 1)])
    out = []
    for k, (source, size) in enumerate(order):
        blocks = -(-size // block)
        starts = [min(row[k], limit * blocks) for row in steps]
        out.append((source, size, float(wanted[k]), block, blocks, starts[-1], starts))
    return out


QUOTAS = "source string, source_size long, target double, block long, blocks long, seats long, starts array<long>"


@dataclass
class Plan:
    """Quotas per source, and the number of words before each bucket of a source."""

    quotas: DataFrame
    starts: DataFrame
    bits: int


def plan_mix(sized: DataFrame, shards: int = SHARDS, limit: int = LIMIT) -> Plan:
    """From sized(doc_id, source, size)."""
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).collect()
    bits = max(0, (sum(t[2] for t in totals) // BUCKET_ROWS).bit_length())
    found = spark.createDataFrame(quotas([(t[0], t[1]) for t in totals], shards, limit), QUOTAS)
    earlier = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        sized.withColumn("bucket", _bucket(bits))
        .groupBy("source", "bucket")
        .agg(F.sum("size").alias("in_bucket"))
        .withColumn("bucket_start", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)))
        .select(_key("source").alias("source_key"), "bucket", "bucket_start")
    )
    return Plan(found.select(_key("source").alias("source_key"), *found.columns[1:]), starts, bits)


def _place() -> Column:
    return F.xxhash64(F.lit(SEED), "doc_id").bitwiseAND(F.lit((1 << 62) - 1))


def _bucket(bits: int) -> Column:
    return F.shiftright(_place(), 62 - bits) if bits else F.lit(0).cast("long")


def _key(source: str) -> Column:
    """The source as a join key, in which a null equals another."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))


def place_documents(sized: DataFrame, plan: Plan) -> DataFrame:
    """sized(doc_id, source, size, ...) with the quotas of its source and `begin`, the number of
    words before the document in its source.

    Rows move once: the window and the join with the starts of the buckets have the same keys.
    """
    inside = (
        W.partitionBy("source_key", "bucket").orderBy(_place(), "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    )
    ordered = (
        sized.withColumn("bucket", _bucket(plan.bits))
        .withColumn("source_key", _key("source"))
        .withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    )
    few = plan.quotas.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    found = F.broadcast(plan.quotas) if few else plan.quotas
    return (
        ordered.join(plan.starts, ["source_key", "bucket"])
        .withColumn("begin", F.col("bucket_start") + F.col("before"))
        .join(found, "source_key")
        .drop("bucket", "before", "source_key", "bucket_start")
    )


def rank(block: Column) -> Column:
    """The seeded rank of a block among those of its source: each rank falls on one block."""
    blocks = F.greatest(F.col("blocks"), F.lit(1))
    step = F.coalesce(*(F.when(blocks % p != 0, F.lit(p)) for p in STEPS), F.lit(1))
    return F.pmod(block * step + F.lit(SEED), blocks)


def _seats_before(end: Column, first: Column) -> Column:
    """How many of a block's seats, the first of which is its rank, are smaller than `end`."""
    return F.when(end <= first, F.lit(0)).otherwise(
        F.floor((end - first - 1) / F.greatest(F.col("blocks"), F.lit(1))) + 1
    ).cast("long")


def times(block: Column) -> Column:
    """How many seats fall on the block."""
    return _seats_before(F.col("seats"), rank(block))


def shard_of(seat: Column) -> Column:
    """The shard whose run of `starts` holds the seat."""
    ends = F.slice("starts", F.lit(2), F.size("starts") - 1)
    return F.size(F.filter(ends, lambda end: end <= seat))


def floor_sums(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of (a * j + b) // m over j < n, for whole numbers from 0 (m from 1), by the steps of Euclid."""
    n, m, a, b = (np.array(x, np.int64) for x in np.broadcast_arrays(n, m, a, b))
    out = np.zeros(n.shape, np.int64)
    n, m, a, b, flat = n.ravel(), m.ravel(), a.ravel(), b.ravel(), out.reshape(-1)
    at = np.arange(len(n))
    while len(at):
        flat[at] += n * (n - 1) // 2 * (a // m) + n * (b // m)
        top = a % m * n + b % m
        go = top >= m
        at, n, m, a, b = at[go], top[go] // m[go], a[go] % m[go], m[go], top[go] % m[go]
    return out


def words_on_seats(
    begin: np.ndarray, size: np.ndarray, block: np.ndarray, blocks: np.ndarray, bound: np.ndarray
) -> np.ndarray:
    """How many words of a document lie on seats below `bound`, repeats counted, however many blocks it has.

    Block j has the rank r(j) = (p * j + SEED) mod blocks and the seats r(j), r(j) + blocks and so on. Below bound = q * blocks + rest
    each block has q seats, and one more if r(j) < rest; how many blocks of a range have that is a difference of floor sums.
    """
    n = np.maximum(blocks, 1)
    step = np.select([n % p != 0 for p in STEPS], STEPS, 1)
    rounds, rest = bound // n, bound % n
    first, last = begin // block, (begin + np.maximum(size, 1) - 1) // block
    more = lambda j: (step * j + SEED) % n < rest
    upto = lambda j: floor_sums(j, n, step, SEED % n) - floor_sums(j, n, step, SEED % n - rest + n) + j
    several = last > first
    of_first = np.where(several, (first + 1) * block - begin, size)
    of_last = np.where(several, begin + size - last * block, 0)
    between = np.where(several, upto(np.maximum(last, first + 1)) - upto(first + 1), 0)
    return size * rounds + of_first * more(first) + of_last * more(last) + block * between


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Placed documents to taken and shard_words."""
    for batch in batches:
        if not batch.num_rows:
            continue
        numbers = [batch.column(c).to_numpy()[:, None] for c in ("begin", "size", "block", "blocks")]
        starts = batch.column("starts").flatten().to_numpy().reshape(batch.num_rows, -1)
        words = words_on_seats(*numbers, starts)
        by_shard = np.diff(words, axis=1)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(by_shard.ravel()), by_shard.shape[1])
        columns = [batch.column(c) for c in ("doc_id", "size", "source_size", "target")]
        columns += [pa.array(words[:, -1]), batch.column("source"), lists.cast(pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "size", "source_size", "target", "taken", "source", "shard_words"])


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words in the mix, repeats counted), source and
    shard_words (the words taken by shard)."""
    sized = stored(word_counts(docs, "doc_id", "source"))
    placed = place_documents(sized, plan_mix(sized))
    kinds = [sized.schema[c].dataType.simpleString() for c in ("doc_id", "source")]
    columns = "size long, source_size long, target double, taken long, source {}, shard_words array<long>".format(kinds[1])
    needed = placed.select("doc_id", "size", "source_size", "target", "source", "begin", "block", "blocks", "starts")
    return needed.mapInArrow(_taken, f"doc_id {kinds[0]}, {columns}")


def _copies(docs: DataFrame) -> DataFrame:
    """row, seat and shard of every copy. Texts move once, to their bucket of the source."""
    plan = plan_mix(stored(word_counts(docs, "doc_id", "source")))
    nested = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text")
    placed = place_documents(word_counts(nested, "row", "doc_id", "source"), plan)
    first = F.expr("begin div block")
    copies = F.when(F.col("size") > 0, times(first)).otherwise(0)
    return (
        placed.withColumn("copies", copies.cast("int"))
        .where("copies > 0")
        .withColumn("round", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .withColumn("seat", rank(first) + F.col("round") * F.col("blocks"))
        .select("row", "seat", shard_of(F.col("seat")).alias("shard"))
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    """Whole documents, each as often as the block with its first word is taken."""
    return _copies(docs).select("row.*")


def mix_shards(docs: DataFrame) -> DataFrame:
    """mix_documents with the seat of every copy and the shard of the mix that holds it (columns of
    these names are replaced)."""
    columns = [c for c in docs.columns if c not in ("seat", "shard")]
    return _copies(docs).select(*(F.col("row").getField(c).alias(c) for c in columns), "seat", "shard")
