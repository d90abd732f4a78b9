"""Periodic runs: stretches of words that repeat themselves, found as maximal pairs.

A run is a stretch of words with smallest period q, at least MIN_LENGTH words and MIN_TURNS periods long, that no neighbouring
word extends. Its first and its second turn begin a maximal pair: two equal stretches, q apart and q words shorter than
the run, with different words before and behind them. So the maximal pairs whose distance is small for their
length are the runs, and nothing is extended.

1. Texts without a FLOOR-word string that comes twice have no run and go no further (FLOOR words is the shortest pair).
2. The words of the others are ranked by prefix doubling, text by text, until every suffix has a rank of its own; the
   ranks of all rounds give the longest common prefix (LCP) of neighbours in that order.
3. Neighbours with an LCP of FLOOR words and more make the LCP-interval tree. Branches whose closest positions are too far
   apart for their longest LCP are left out. The rest is walked bottom-up: an interval has the positions of its children in order,
   each of the class of its left word, and a child is merged into the larger part of its interval (smaller into
   larger). A position pairs with its nearest ones there if their left words differ and the distance fits: between the
   two turns of a run with smallest period q there is no third position, so no other pair has to be looked at.
4. Pairs of one stretch with several periods leave the smallest.

Texts stay on their row: there is no shuffle. Memory follows a slice of texts of 256 KB, or one longer text: about 60 bytes a word, and
4 more per round of ranks where the text repeats itself.

Cases: a null or empty text has no words and no run; texts of any length are taken whole; each row is a document, whatever its doc_id
(null, or equal to another's); an empty table gives an empty table; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm import text_arrays as ta

MIN_LENGTH = 6
MIN_TURNS = 4
#: The shortest pair: period 1, six words.
FLOOR = MIN_LENGTH - 1
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number per word, equal for equal words and only for them."""
    letters = np.ascontiguousarray(data[~ta.SPACE[data]])
    bounds = np.r_[0, np.cumsum(end - start)].astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def suspects(codes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """True for texts in which some FLOOR words in a row come twice (or their hashes do)."""
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    n = len(codes) - FLOOR + 1
    out = np.zeros(len(before) - 1, bool)
    if n <= 1:
        return out
    name = text[:n].astype(np.uint64) * np.uint64(ta.ROOT)
    for k, factor in enumerate(ta.numbers(FLOOR, 21)):
        name += ta.mix(codes[k : k + n].astype(np.uint64) + factor)  # sums of words in their places
        name = ta.mix(name)
    inside = np.arange(n) + FLOOR <= before[1:][text[:n]]
    name, text = name[inside], text[:n][inside]
    order = np.sort(name)
    twice = order[1:][order[1:] == order[:-1]]
    if len(twice):
        at = np.minimum(np.searchsorted(twice, name), len(twice) - 1)
        out[text[twice[at] == name]] = True
    return out


def suffix_order(codes: np.ndarray, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, text by text, and per round k the ranks by 2^k words, with one rank more for the end.

    A suffix that ends before the 2^k words are through comes before those that go on, and shares its rank with none.
    """
    n = len(codes)
    key = text * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]][:n]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = group
    levels, width = [rank.copy()], 1
    while True:
        open_ = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(open_):
            return order, levels
        p = order[open_]
        after = p + width
        second = np.where(after < ends[p], rank[np.minimum(after, n)].astype(np.int64) + 1, 0)
        key = group[open_] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        p, key = p[by], key[by]
        order[open_] = p
        fresh = np.r_[True, key[1:] != key[:-1]]
        new[open_] = fresh
        group[open_] = np.maximum.accumulate(np.where(fresh, open_, 0))
        rank[p] = group[open_]
        levels.append(rank.copy())
        width *= 2


def common_prefixes(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many words the suffixes a[k] and b[k] have in common: bit by bit, the widest ranks first."""
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = (levels[k][a + lcp] == levels[k][b + lcp]).astype(np.int64) << k
        lcp += step
    return lcp


def branches(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Places in the order whose branch (neighbours that share FLOOR words) may hold a close pair."""
    deep = lcp >= FLOOR
    inside = np.flatnonzero(deep | np.r_[deep[1:], False])
    if not len(inside):
        return inside
    branch = np.cumsum(~deep[inside]) - 1
    firsts = np.flatnonzero(np.r_[True, branch[1:] != branch[:-1]])
    by = np.lexsort((order[inside], branch))
    gaps = np.diff(order[inside][by], prepend=0)
    gaps[firsts] = np.iinfo(np.int64).max
    closest = np.minimum.reduceat(gaps, firsts)
    longest = np.maximum.reduceat(np.where(deep[inside], lcp[inside], 0), firsts)
    return inside[(closest <= longest // (MIN_TURNS - 1))[branch]]


def merged(a: list[int], b: list[int], depth: int, left: list[int], found: list[tuple]) -> list[int]:
    """The positions of two parts of an interval in order; their pairs with a common prefix of `depth` words go to `found`."""
    if len(a) < len(b):
        a, b = b, a
    widest = depth // (MIN_TURNS - 1)
    for x in b:
        k = bisect_left(a, x)
        for y in a[max(k - 1, 0) : k + 1]:
            period = abs(x - y)
            if period <= widest and depth + period >= MIN_LENGTH and left[x] != left[y]:
                found.append((min(x, y), depth + period, period))
    if 4 * len(b) > len(a):
        a += b
        a.sort()
    else:
        for x in b:
            insort(a, x)
    return a


def maximal_pairs(positions: list[int], lcps: list[int], left: list[int]) -> list[tuple]:
    """(start, length, period) of the close maximal pairs, from the suffixes of branches in order.

    lcps[k] is the common prefix of a suffix and the one before it, 0 at the start of a branch.
    """
    found: list[tuple] = []
    depths: list[int] = []
    parts: list[list[int]] = []
    last: list[int] = []
    for position, lcp in zip(positions + [-1], lcps + [0]):
        while depths and depths[-1] > lcp:
            last = merged(parts.pop(), last, depths.pop(), left, found)
        if depths and depths[-1] == lcp:
            parts[-1] = merged(parts[-1], last, lcp, left, found)
        elif lcp:
            depths.append(lcp)
            parts.append(last)
        last = [position]
    return found


def runs_of(codes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Rows (start among all words, length, period) of the runs of texts, by start and period."""
    none = np.zeros((0, 3), np.int64)
    some = suspects(codes, before)
    if not some.any():
        return none
    sizes = np.diff(before)[some]
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    shift = np.repeat(before[:-1][some] - (ends - sizes), sizes)
    codes = codes[np.arange(len(text)) + shift]
    order, levels = suffix_order(codes, text, ends[text])
    if len(levels) < 3:
        return none
    four = levels[2][order]
    near = np.flatnonzero(four[1:] == four[:-1]) + 1
    lcp = np.zeros(len(order), np.int64)
    lcp[near] = common_prefixes(order[near - 1], order[near], levels)
    use = branches(order, lcp)
    if not len(use):
        return none
    left = np.r_[-1, codes[:-1]]
    left[ends[:-1]] = -1
    lcps = np.where(lcp[use] >= FLOOR, lcp[use], 0)
    pairs = maximal_pairs(order[use].tolist(), lcps.tolist(), left.tolist())
    if not pairs:
        return none
    found = np.array(pairs, np.int64)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    found = found[np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)]]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    found[:, 0] += shift[found[:, 0]]
    return found


def collapsed(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray, runs: np.ndarray) -> pa.Array:
    """The words of each text but for the later turns of its runs, joined by one space."""
    change = np.zeros(len(start) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(change)[:-1] == 0)
    firsts = np.searchsorted(kept, before)
    spaced = np.ones(len(kept), np.int64)
    spaced[firsts[:-1][np.diff(firsts) > 0]] = 0
    size = end[kept] - start[kept] + spaced
    stops = np.r_[0, np.cumsum(size)]
    out = data[np.repeat(start[kept] - spaced - stops[:-1], size) + np.arange(stops[-1])]
    out[stops[:-1][spaced > 0]] = 0x20
    bounds = pa.py_buffer(stops[firsts].astype(np.int32))
    return pa.Array.from_buffers(pa.string(), len(before) - 1, [None, bounds, pa.py_buffer(np.ascontiguousarray(out))])


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period) and the collapsed text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, last, data, offsets in ta.slices(batch.column("text")):
                start, end, before = ta.words(data, offsets)
                with np.errstate(over="ignore"):
                    runs = runs_of(word_codes(data, start, end), before)
                lists = np.searchsorted(runs[:, 0], before).astype(np.int32)
                text = np.searchsorted(before, runs[:, 0], "right") - 1
                fields = [pa.array(runs[:, 0] - before[text]), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
                columns = [
                    batch.column("doc_id").slice(row, last - row),
                    pa.array(np.diff(before)),
                    pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays(fields, fields=list(RUN))),
                    collapsed(data, start, end, before, runs),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {FOUND}")


def run_report(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest (ties: smallest start, then period) and digests of runs and collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-best["s"]).alias("start"),
        best["length"].alias("length"),
        (-best["p"]).alias("period"),
        F.floor(1000 * best["length"] / -best["p"]).alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(doc_id: int, text: str) -> str | None:
    """The text with its tail turned into a repetition if its doc_id says so, else None."""
    h = zlib.crc32(str(doc_id).encode())
    words = text.encode().split() if h % 10 == 0 else []
    if not words:
        return None
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)]).decode()


def plant_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, about every tenth of them (by crc32 of doc_id; never a null one) ending in a repetition."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            chosen = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i in ids.to_pylist()]
            rows = np.flatnonzero(chosen).tolist()
            new = {k: planted(ids[k].as_py(), texts[k].as_py() or "") for k in rows}
            new = {k: t for k, t in new.items() if t is not None}
            mask = np.zeros(len(ids), bool)
            mask[list(new)] = True
            texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(list(new.values()), texts.type))
            yield pa.RecordBatch.from_arrays([ids, texts], ["doc_id", "text"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, text string")
