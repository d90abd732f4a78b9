"""Jaccard join of the n-gram sets of all documents, with a prefix tree.

1. Order. The occurrences of n-grams are counted in a sketch of 2^SKETCH_BITS cells, over all documents.
   An n-gram is named by a number: the level of its cell (rare first), then its hash. These numbers
   are the global order, and a document's set is the sorted array of its numbers.
2. Prefixes. Two sets of the wanted similarity share a number among their first n - ceil(t n) + 1.
   Each distinct set is posted under those numbers. In the sorted postings of a number, sets follow one
   another by size; where a size is too small for the next a new run begins. The first set of a
   run leads it, and all sets of the run meet under their leader: a set goes to a few leaders, not to
   each of its hundreds of numbers, and no pair is written anywhere.
3. Profiles. Under a leader, counts of numbers in PROFILE cells bound the overlap of two sets from above; sets
   that no other set can reach drop out, before any whole set has moved.
4. Tree. The sets that are left meet under their leaders, are put in a prefix tree (frequent numbers first, so that
   copies share long paths) and every set walks it: overlaps are carried down and shared by all
   sets below a node, and a subtree is left when the lengths that remain cannot give the overlap.
   A pair counts under one leader only, that of the first number the two sets have in common.
   Leaders with many sets are dealt to several tasks, block against block.
5. Components of the links, on the smallest document of each distinct set.

Numbers carry 56 bits of hash, which matter within a pair only; sets are told apart by 128 bits.

Cases: null and empty texts have no n-gram, link with nothing and are components of their own; a text with fewer
words than n has one gram, all its words; documents with equal sets are one set, linked to one another; rows
with one doc_id count as documents each; null doc_ids are a component of their own; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm import text_arrays as ta
from passages.llm.components import components
from passages.llm.storage import stored

SKETCH_BITS = 20
SKETCH_PARTS = 64
MERGE_TASKS = 16
LEVEL_BITS = 8
PROFILE = 256
BLOCK_NUMBERS = 1_000_000
BLOCK_SETS = 1_024
FILTER_BITS = 25
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Rule:
    """n-grams of `width` words; similar means 100 * intersection >= percent * union."""

    width: int = 4
    percent: int = 85

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - (self.percent * n + 99) // 100 + 1

    def needed(self, n, m):
        """The overlap that sets of n and m numbers need."""
        return -(-self.percent * (n + m) // (100 + self.percent))


# Sets


class Grams:
    """Hashes of the n-grams of texts, lower-cased in A to Z."""

    def __init__(self, width: int):
        self.width = width
        self.hasher = ta.Hasher(11, ta.LOWER)

    def of(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for first, _, data, offsets in ta.slices(column):
            start, end, before = ta.words(data, offsets)
            hashes = self.hasher.between(self.hasher.prefix(data), start, end)
            yield first, *ta.grams(hashes, before, self.width)


def count_sketch(docs: DataFrame, make, bits: int = SKETCH_BITS) -> np.ndarray:
    """Per cell a level from 0 (rare) to 255: four per doubling of the count.

    make() gives the source of hashes, such as Grams.
    """
    narrow = docs.select(F.col("text").cast("string").alias("text"))
    cells = 1 << bits
    size = cells // SKETCH_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = make(), np.zeros(cells, np.uint32)
        with np.errstate(over="ignore"):
            for batch in batches:
                for _, found, *_ in grams.of(batch.column("text")):
                    cell, times = np.unique(found >> np.uint64(64 - bits), return_counts=True)
                    total[cell] += times.astype(np.uint32)
        if total.any():
            yield _parts({k: total[k * size : (k + 1) * size] for k in range(SKETCH_PARTS)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts")):
                at, found = _counted(counts.as_py())
                sums.setdefault(part, np.zeros(size, np.int64))[at] += found
        if sums:
            yield _parts(sums)

    kind = "part int, counts binary"
    parts = narrow.mapInArrow(count, kind).repartition(MERGE_TASKS, "part").mapInArrow(add, kind).collect()
    levels = np.zeros(cells, np.uint8)
    for part, counts in parts:
        at, total = _counted(bytes(counts))
        levels[part * size + at] = np.minimum(255, np.floor(4 * np.log2(total + 1)))
    return levels


#: The level of a cell that was counted once.
ONCE = 4


def _parts(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
    """The cells with a count, and their counts."""
    used = [(np.flatnonzero(c), c) for c in counts.values()]
    blobs = [zlib.compress(np.r_[at, c[at].astype(np.int64)].tobytes(), 1) for at, c in used]
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(blobs, pa.binary())], ["part", "counts"])


def _counted(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(zlib.decompress(blob), np.int64).reshape(2, -1))


def in_order(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Hashes as numbers in the global order: level, then hash."""
    level = levels[hashes >> np.uint64(65 - len(levels).bit_length())].astype(np.uint64)
    return (level << np.uint64(64 - LEVEL_BITS)) | (hashes >> np.uint64(LEVEL_BITS))


def ordered_sets(column: pa.Array, grams: Grams, levels: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, numbers of all sets of a slice, set after set and each sorted, their sizes)."""
    for first, found, starts in grams.of(column):
        numbers = in_order(found, levels)
        sets = [np.unique(numbers[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        sizes = np.array([len(s) for s in sets], np.int64)
        yield first, np.concatenate(sets) if sets else numbers, sizes


def digests(numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums per set: they depend on its members alone."""
    ends = np.cumsum(sizes)
    out = []
    for salt in ta.numbers(2, 31):
        sums = np.zeros(len(numbers) + 1, np.uint64)
        np.cumsum(ta.mix(numbers ^ salt), out=sums[1:])
        out.append(sums[ends] - sums[ends - sizes])
    return out[0], out[1]


def profiles(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per set the count of numbers in each of PROFILE cells, at most 255: a full cell holds any number."""
    cell = ta.mix(numbers).astype(np.int64) & (PROFILE - 1)
    where = np.repeat(np.arange(len(sizes)), sizes) * PROFILE + cell
    counts = np.bincount(where, minlength=len(sizes) * PROFILE).reshape(len(sizes), PROFILE)
    return np.minimum(counts, 255).astype(np.uint8)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), _signed(values))


def set_table(docs: DataFrame, rule: Rule, levels) -> DataFrame:
    """doc_id, n, a, b (digest of the set), prefix and profile of every document.

    A task writes prefix and profile once for each distinct set it sees.
    """
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, seen = Grams(rule.width), set()
        for batch in batches:
            with np.errstate(over="ignore"):
                for first, numbers, sizes in ordered_sets(batch.column("text"), grams, levels.value):
                    a, b = digests(numbers, sizes)
                    new = np.array([_is_new(seen, key, n) for key, n in zip(zip(a.tolist(), b.tolist()), sizes.tolist())], bool)
                    lengths = np.where(new, rule.prefix(sizes), 0)
                    begin = np.cumsum(sizes) - sizes
                    at = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
                    shapes = profiles(numbers, sizes)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").slice(first, len(sizes)),
                            pa.array(sizes),
                            _signed(a),
                            _signed(b),
                            _lists(numbers[at], lengths),
                            pa.array([s.tobytes() if k else None for s, k in zip(shapes, new)], pa.binary()),
                        ],
                        ["doc_id", "n", "a", "b", "prefix", "profile"],
                    )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(
        run, f"doc_id {kind}, n long, a long, b long, prefix array<long>, profile binary"
    )


#: A task forgets which sets it has written when it has seen so many; the copies are dropped later.
REMEMBERED = 1_000_000


def _is_new(seen: set, key: tuple[int, int], n: int) -> bool:
    if n == 0 or key in seen:
        return False
    if len(seen) >= REMEMBERED:
        seen.clear()
    seen.add(key)
    return True


# Leaders


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of whole groups of a sorted stream, as few as the batches allow."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if cut:
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = []
        elif held and held[-1].column(column)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def lead(rule: Rule):
    """Sorted postings (w, n, a) to (a, leader, w), a batch at a time.

    Only the first member of the run and the last row are carried from batch to batch, so a
    number that a third of all sets share is read through, not held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_w = last_n = last_a = leader = None
        open_ = False  # whether the leader itself has been written
        for batch in batches:
            if not batch.num_rows:
                continue
            w, n, a = (batch.column(c).to_numpy() for c in ("w", "n", "a"))
            before_w, before_n, before_a = (
                np.r_[x[:1] if last is None else np.array([last], x.dtype), x[:-1]]
                for x, last in ((w, last_w), (n, last_n), (a, last_a))
            )
            fresh = (w != before_w) | (100 * before_n < rule.percent * n)
            if last_w is None:
                fresh[0] = True
            copy = ~fresh & (a == before_a) & (n == before_n)
            starts = np.flatnonzero(fresh)
            run_of = np.cumsum(fresh) - 1
            leaders = np.empty(len(w), np.int64)
            leaders[run_of >= 0] = a[starts][run_of[run_of >= 0]] if len(starts) else 0
            leaders[run_of < 0] = leader if leader is not None else 0
            follows = ~fresh & ~copy
            out = np.flatnonzero(follows)
            # The leader's own row goes out with its first follower.
            first = out[np.r_[True, run_of[out][1:] != run_of[out][:-1]]] if len(out) else out
            if len(first) and run_of[first[0]] < 0 and open_:
                first = first[1:]
            rows_a = np.r_[a[out], leaders[first]]
            rows_l = np.r_[leaders[out], leaders[first]]
            rows_w = np.r_[w[out], w[first]]
            if len(rows_a):
                yield pa.RecordBatch.from_arrays([pa.array(rows_a), pa.array(rows_l), pa.array(rows_w)], ["a", "leader", "w"])
            if len(starts):
                leader = int(a[starts[-1]])
                open_ = bool(len(out)) and bool((run_of[out] == run_of[-1]).any())
            else:
                open_ = open_ or bool(len(out))
            last_w, last_n, last_a = int(w[-1]), int(n[-1]), int(a[-1])

    return run


def under_leaders(sets: DataFrame, rule: Rule) -> DataFrame:
    """(a, leader, via): the sets of each leader, and the numbers by which they came to it."""
    postings = sets.select("a", "n", F.explode("prefix").alias("w"))
    ordered = postings.repartition("w").sortWithinPartitions("w", "n", "a")
    found = ordered.mapInArrow(lead(rule), "a long, leader long, w long")
    return found.groupBy("a", "leader").agg(F.collect_set("w").alias("via"))


def deal(rows: DataFrame) -> DataFrame:
    """Leaders with many or long sets are dealt to several tasks: adds task, own and parts.

    With k parts, the sets of part i go to the tasks (i, j) and (j, i); a task compares within its part (i, i) or between
    its two. Task is a hash of leader, i and j.
    """
    totals = rows.groupBy("leader").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("numbers"))
    parts = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("numbers") / BLOCK_NUMBERS))
    own = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))
    return (
        rows.join(totals.where("sets > 1").select("leader", parts.cast("int").alias("parts")), "leader")
        .withColumn("own", own)
        .withColumn("other", F.explode(others))
        .withColumn("task", F.xxhash64("leader", F.least("own", "other"), F.greatest("own", "other")))
        .withColumn("paired", F.col("own") != F.col("other"))
        .drop("other", "parts")
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables with the bounds of their tasks."""
    for table in _groups(batches, "task"):
        task = table.column("task").to_numpy()
        cuts = np.flatnonzero(np.r_[True, task[1:] != task[:-1], True])
        yield table.combine_chunks(), list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def promising(rule: Rule):
    """Sets of a task with another in it that they might be similar to, by their profiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, blocks in _blocks(batches):
            n = table.column("n").to_numpy()
            own = table.column("own").to_numpy()
            paired = table.column("paired").to_numpy()
            raw = b"".join(p.as_py() for p in table.column("profile"))
            shape = np.frombuffer(raw, np.uint8).reshape(len(n), PROFILE)
            keep = np.zeros(len(n), bool)
            for begin, end in blocks:
                _reachable(rule, n, own, paired, shape, begin, end, keep)
            kept = table.filter(pa.array(keep)).select(["a", "leader", "n", "via"])
            yield from kept.to_batches()

    return run


def _reachable(rule, n, own, paired, shape, begin, end, keep) -> None:
    """Marks the sets of a task (sorted by n) that have a partner within the bound."""
    sizes = n[begin:end]
    full = (shape[begin:end] == 255).any(axis=1)
    for i in range(begin, end - 1):
        # Later sets are as large or larger.
        stop = begin + int(np.searchsorted(sizes, 100 * n[i] // rule.percent, "right"))
        j = np.arange(i + 1, stop)
        if paired[i]:
            j = j[own[j] != own[i]]
        if not len(j):
            continue
        bound = np.minimum(shape[j], shape[i]).sum(axis=1, dtype=np.int64)
        near = (bound >= rule.needed(n[j], n[i])) | (full[i - begin] & full[j - begin])
        if near.any():
            keep[i] = True
            keep[j[near]] = True


# Tree


class PrefixTree:
    """Sorted sets in a prefix tree, stored level by level.

    Sets are arrays of ranks, the most frequent first (descending numbers ascend as ranks). An edge holds the ranks up to the
    next branch or end of a set.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.size = size = np.array([len(s) for s in sets], np.int64)
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
        shared = np.zeros(len(order), np.int64)
        for k in range(1, len(order)):
            x, y = sets[order[k - 1]], sets[order[k]]
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            shared[k] = differ[0] if len(differ) else m
        order = np.array(order)
        self.levels = []
        nodes = [(0, len(order), 0, 0)]  # first and end set in order, depth above, parent
        while nodes:
            edges, depths, ends, below = [], [], [], []
            for at, (lo, hi, above, _) in enumerate(nodes):
                one = sets[order[lo]]
                depth = len(one) if hi - lo == 1 else int(shared[lo + 1 : hi].min())
                stop = [int(order[lo])] if len(one) == depth else []
                edges.append(one[above:depth])
                depths.append(depth)
                ends.append(stop)
                start = lo + len(stop)
                if start < hi:
                    branches = start + 1 + np.flatnonzero(shared[start + 1 : hi] == depth)
                    bounds = [start, *branches.tolist(), hi]
                    below += [(p, q, depth, at) for p, q in zip(bounds[:-1], bounds[1:])]
            lengths = np.array([len(e) for e in edges], np.int64)
            self.levels.append(
                {
                    "parent": np.array([n[3] for n in nodes], np.int64),
                    "edges": np.concatenate(edges),
                    "start": np.cumsum(lengths) - lengths,
                    "length": lengths,
                    "depth": np.array(depths, np.int64),
                    "last": np.array([sets[order[n[0]]][d - 1] if d else -1 for n, d in zip(nodes, depths)], np.int64),
                    "shortest": np.array([size[order[n[0] : n[1]]].min() for n in nodes], np.int64),
                    "longest": np.array([size[order[n[0] : n[1]]].max() for n in nodes], np.int64),
                    "ends": ends,
                }
            )
            nodes = below

    def similar(self, probe: np.ndarray, rule: Rule, ranks: int) -> list[int]:
        """The sets similar to the probe, itself included."""
        mark = np.zeros(ranks + 1, np.int64)
        mark[probe] = 1
        upto = np.r_[0, np.cumsum(mark)]
        n = len(probe)
        overlap = np.zeros(1, np.int64)
        alive = np.ones(1, bool)
        found: list[int] = []
        for level in self.levels:
            run = alive[level["parent"]]
            if not run.any():
                break
            sums = np.r_[0, np.cumsum(mark[level["edges"]])]
            here = overlap[level["parent"]] + sums[level["start"] + level["length"]] - sums[level["start"]]
            # What is left of the probe behind the edge, and of the longest set below.
            left = np.minimum(n - upto[level["last"] + 1], level["longest"] - level["depth"])
            need = rule.needed(np.maximum(level["shortest"], level["depth"]), n)
            alive = run & (here + left >= need)
            for k in np.flatnonzero(alive):
                for s in level["ends"][k]:
                    if here[k] >= rule.needed(int(self.size[s]), n):
                        found.append(s)
            overlap = here
        return found


def tree_links(rule: Rule):
    """Sets of a task to (a, b, root, links): the smallest set that it hangs on here and the documents it links to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, blocks in _blocks(batches):
            names = ("node", "weight", "own", "paired")
            node, weight, own, paired = (table.column(c).to_numpy() for c in names)
            sets = table.column("numbers").combine_chunks()
            vias = table.column("via").combine_chunks()
            rows: list[tuple[int, int, int]] = []
            for begin, end in blocks:
                found = _block_links(rule, sets, vias, own, paired, begin, end)
                rows += _hang(found, node, weight, begin)
            columns = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns.T)], ["node", "root", "links"])

    return run


def _slice(lists: pa.ListArray, k: int) -> np.ndarray:
    return lists[k].values.to_numpy().view(np.uint64)


def _block_links(rule, sets, vias, own, paired, begin, end) -> list[tuple[int, int]]:
    """Pairs (places in the task) that are similar and belong to this leader."""
    numbers = [_slice(sets, k) for k in range(begin, end)]
    every, ranks = np.unique(np.concatenate(numbers), return_inverse=True)
    ranks = len(every) - 1 - ranks
    cuts = np.cumsum([len(x) for x in numbers])[:-1]
    ranked = [x[::-1].astype(np.int64) for x in np.split(ranks, cuts)]
    tree = PrefixTree(ranked)
    via = [np.sort(_slice(vias, k)) for k in range(begin, end)]
    out = []
    for i in range(len(ranked)):
        for j in tree.similar(ranked[i], rule, len(every)):
            if j <= i or paired[begin + i] and own[begin + i] == own[begin + j]:
                continue
            p = int(rule.prefix(np.int64(len(numbers[i]))))
            q = int(rule.prefix(np.int64(len(numbers[j]))))
            common = np.intersect1d(numbers[i][:p], numbers[j][:q], assume_unique=True)
            at = np.searchsorted(via[i], common[0]) if len(common) else len(via[i])
            if at < len(via[i]) and via[i][at] == common[0]:
                out.append((i, j))
    return out


def _hang(pairs, node, weight, begin) -> list[tuple[int, int, int]]:
    """Per linked set of a task: the smallest node of its component here, and the documents of its partners."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    links: dict[int, int] = {}
    for i, j in pairs:
        a, b = int(node[begin + i]), int(node[begin + j])
        links[a] = links.get(a, 0) + int(weight[begin + j])
        links[b] = links.get(b, 0) + int(weight[begin + i])
        x, y = root(a), root(b)
        if x != y:
            top[max(x, y)] = min(x, y)
    return [(x, root(x), n) for x, n in links.items()]


def whole_sets(docs: DataFrame, rule: Rule, levels, wanted) -> DataFrame:
    """(a, b, numbers) of the documents whose set may be wanted: a fixed-size filter names them."""
    narrow = docs.select(F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, seen = Grams(rule.width), set()
        for batch in batches:
            with np.errstate(over="ignore"):
                for _, numbers, sizes in ordered_sets(batch.column("text"), grams, levels.value):
                    a, b = digests(numbers, sizes)
                    maybe = passes(wanted.value, a).tolist()
                    keys = zip(a.tolist(), b.tolist())
                    keep = np.array(
                        [ok and _is_new(seen, key, n) for ok, key, n in zip(maybe, keys, sizes.tolist())], bool
                    )
                    if keep.any():
                        yield pa.RecordBatch.from_arrays(
                            [
                                _signed(a[keep]),
                                _signed(b[keep]),
                                _lists(numbers[np.repeat(keep, sizes)], sizes[keep]),
                            ],
                            ["a", "b", "numbers"],
                        )

    return narrow.mapInArrow(run, "a long, b long, numbers array<long>")


def passes(bits: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Whether the filter has the first bits of each a."""
    place = a >> np.uint64(64 - FILTER_BITS)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def filter_bits(rows: DataFrame) -> np.ndarray:
    """2^FILTER_BITS bits, set at the first bits of column a of any row."""
    parts = 64
    size = (1 << FILTER_BITS) // 8

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[batch.column("a").to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)] = True
        if bits.any():
            yield _bit_parts(np.packbits(bits, bitorder="little").reshape(parts, -1))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("bits")):
                found = np.frombuffer(zlib.decompress(blob.as_py()), np.uint8)
                merged[part] = merged[part] | found if part in merged else found
        if merged:
            blobs = [zlib.compress(x.tobytes(), 1) for x in merged.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(merged), pa.int32()), pa.array(blobs, pa.binary())], ["part", "bits"])

    kind = "part int, bits binary"
    out = np.zeros((parts, size // parts), np.uint8)
    for part, blob in rows.select("a").mapInArrow(mark, kind).repartition(MERGE_TASKS, "part").mapInArrow(merge, kind).collect():
        out[part] |= np.frombuffer(zlib.decompress(bytes(blob)), np.uint8)
    return out.reshape(-1)


def _bit_parts(rows: np.ndarray) -> pa.RecordBatch:
    full = [k for k in range(len(rows)) if rows[k].any()]
    blobs = [zlib.compress(rows[k].tobytes(), 1) for k in full]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], ["part", "bits"])


def similar_documents(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other documents linked) of every document."""
    context = docs.sparkSession.sparkContext
    levels = context.broadcast(count_sketch(docs, lambda: Grams(rule.width)))
    sets = stored(set_table(docs, rule, levels))
    classes = stored(
        sets.where("n > 0 and doc_id is not null")
        .groupBy("a", "b")
        .agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("weight"))
    )
    shaped = sets.where("profile is not null")
    led = under_leaders(shaped, rule)
    shapes = shaped.groupBy("a").agg(F.first("n").alias("n"), F.first("profile").alias("profile"))
    tasks = deal(led.join(shapes, "a")).repartition("task").sortWithinPartitions("task", "n", "a")
    led_again = tasks.mapInArrow(promising(rule), "a long, leader long, n long, via array<long>")
    kept = stored(led_again.groupBy("a", "leader").agg(F.first("n").alias("n"), F.first("via").alias("via")))
    wanted = context.broadcast(filter_bits(kept))
    found = whole_sets(docs, rule, levels, wanted).groupBy("a", "b").agg(F.first("numbers").alias("numbers"))
    # Thin rows are dealt out; whole sets follow once.
    whole = deal(kept).join(found.join(classes, ["a", "b"]), "a")
    dealt = whole.repartition("task").sortWithinPartitions("task", "n", "a")
    hung = stored(dealt.mapInArrow(tree_links(rule), "node long, root long, links long"))
    roots = components(hung.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = hung.groupBy("node").agg(F.sum("links").alias("links"))
    per_class = (
        classes.join(roots, "node", "left")
        .join(links, "node", "left")
        .select(
            "a",
            "b",
            F.coalesce("root", "node").alias("component_id"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        )
    )
    members = sets.select("doc_id", F.col("n").alias("n_shingles"), "a", "b")
    return members.join(per_class, ["a", "b"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n_shingles") > 0, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The documents without those that are not the smallest of their component; all columns stay."""
    gone = stored(similar_documents(docs, rule).where("component_id != doc_id").select("doc_id").distinct())
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
