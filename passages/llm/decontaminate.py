"""Benchmark passages in documents, by greedy string tiling.

Words (lower case; runs of letters, digits and the marks on them, in any script) are hashed; in scripts that are written
without spaces every character is a word. Every run of MIN_MATCH
words of a document is looked up among those of the benchmark (rolling hashes), which gives seeds. For
a document and an item that share seeds, the longest match of unmarked words is marked in both, again and again,
until none of MIN_MATCH words is left. The share of the item's words that the tiles cover decides,
so passages whose sentences were put in another order are caught as well.

The benchmark is a query set: it is held against all documents in blocks of at most BLOCK_BYTES of
text, one scan of the documents per block. Documents are never shuffled.

Cases: null and empty texts, and items with fewer than MIN_MATCH words, match nothing (so short a string is no
passage: it stands in clean texts); texts of any length are searched whole; repeated items are one;
rows of the same doc_id are judged each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm import text_arrays as ta

MIN_MATCH = 5
LEAST_COVERAGE = 500  # thousandths of the item's words
BLOCK_BYTES = 8_000_000
FILTER_BITS = 22

#: Classes of characters: what parts words, what words are made of, and what is a word by itself.
PARTS, WITHIN, ALONE = range(3)
#: Scripts without spaces between words, by first and last code point: Thai, Lao, Tibetan, Myanmar, Khmer, kana, ideographs.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF),
)

RESULT = "item_id long, item_words long, matched_words long, n_tiles long, longest_tile long, coverage long"


def character_classes() -> np.ndarray:
    """The class of every code point."""
    found = np.array([chr(c).isalnum() or unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)], np.uint8)
    for first, last in UNSPACED:
        found[first : last + 1] *= ALONE
    return found


def cut_words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each text (and in all)."""
    if not (data >= 0x80).any():
        return ta.runs(classes[data] > 0, offsets)
    first = np.flatnonzero(ta.code_points(data))
    padded = np.r_[data, np.zeros(3, np.uint8)].astype(np.int32)
    b = [padded[first + k] for k in range(4)]
    tail = [x & 0x3F for x in b]
    code = np.select(
        [b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0],
        [b[0], (b[0] & 0x1F) << 6 | tail[1], (b[0] & 0x0F) << 12 | tail[1] << 6 | tail[2]],
        (b[0] & 0x07) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3],
    )
    kind = classes[code]
    within = kind == WITHIN
    before, after = np.r_[False, within[:-1]], np.r_[within[1:], False]
    borders = np.searchsorted(first, offsets)
    filled = np.diff(borders) > 0
    before[borders[:-1][filled]] = False
    after[borders[1:][filled] - 1] = False
    start = first[(kind == ALONE) | within & ~before]
    end = np.r_[first[1:], len(data)][(kind == ALONE) | within & ~after]
    return start, end, np.searchsorted(start, offsets)


class Hashes:
    """Word hashes of a text column, slice by slice."""

    def __init__(self, classes: np.ndarray):
        self.hasher, self.classes = ta.Hasher(5), classes

    def of(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for first, _, data, offsets in ta.slices(pc.utf8_lower(column.fill_null(""))):
            start, end, before = cut_words(data, offsets, self.classes)
            yield first, self.hasher.between(self.hasher.prefix(data), start, end), before


class Items:
    """A block of the benchmark: for every run of words the places where it occurs."""

    VALUES = ("classes", "min_match", "sizes", "ids", "item", "place", "keys", "first", "count", "maybe")

    def __init__(self, ids: list[int], texts: pa.Array, min_match: int = MIN_MATCH):
        self.min_match, self.classes = min_match, character_classes()
        hashes, sizes = [np.zeros(0, np.uint64)], []
        with np.errstate(over="ignore"):
            for _, found, before in Hashes(self.classes).of(texts):
                hashes.append(found)
                sizes.append(np.diff(before))
            self.sizes = np.concatenate([np.zeros(0, np.int64), *sizes])
            self.ids = np.array(ids, np.int64)
            before = np.r_[0, np.cumsum(self.sizes)]
            found, starts = ta.grams(np.concatenate(hashes), before, min_match)
        item = np.repeat(np.arange(len(ids)), np.diff(starts))
        place = np.arange(len(found)) - starts[item]
        long_enough = self.sizes[item] >= min_match
        found, item, place = found[long_enough], item[long_enough], place[long_enough]
        order = np.argsort(found, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first, self.count = np.unique(found[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.keys >> np.uint64(64 - FILTER_BITS)] = True

    @classmethod
    def of_values(cls, values: tuple) -> Items:
        items = cls.__new__(cls)
        for name, value in zip(cls.VALUES, values):
            setattr(items, name, value)
        return items

    def values(self) -> tuple:
        """Plain arrays, which a task reads without this package."""
        return tuple(getattr(self, name) for name in self.VALUES)

    def seeds(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the gram, item, place in the item) of every equal pair."""
        hits = np.flatnonzero(self.maybe[grams >> np.uint64(64 - FILTER_BITS)])
        at = np.minimum(np.searchsorted(self.keys, grams[hits]), max(len(self.keys) - 1, 0))
        if len(hits):
            equal = self.keys[at] == grams[hits]
            hits, at = hits[equal], at[equal]
        times = self.count[at] if len(hits) else np.zeros(0, np.int64)
        total = int(times.sum())
        within = np.arange(total) - np.repeat(np.cumsum(times) - times, times)
        where = np.repeat(self.first[at], times) + within if total else np.zeros(0, np.int64)
        return np.repeat(hits, times), self.item[where], self.place[where]


def tile(doc_places: np.ndarray, item_places: np.ndarray, min_match: int = MIN_MATCH) -> list[int]:
    """Lengths in words of the tiles, in the order in which they are marked.

    Seeds on one diagonal at consecutive places are one match. The longest match comes first
    (of equal ones that earliest in the document, then in the item); a match that meets marked
    words goes back as its unmarked parts.
    """
    order = np.lexsort((item_places, doc_places - item_places))
    d, i = doc_places[order], item_places[order]
    fresh = np.r_[True, (np.diff(i) != 1) | (np.diff(d) != 1)]
    starts = np.flatnonzero(fresh)
    lengths = np.diff(np.r_[starts, len(d)]) + min_match - 1
    low = int(d.min())
    in_doc = np.zeros(int(d.max()) - low + min_match, bool)
    in_item = np.zeros(int(i.max()) + min_match, bool)
    queue = [(-int(n), int(d[s]) - low, int(i[s])) for s, n in zip(starts, lengths)]
    heapq.heapify(queue)
    tiles = []
    while queue:
        n, at_doc, at_item = heapq.heappop(queue)
        n = -n
        taken = in_doc[at_doc : at_doc + n] | in_item[at_item : at_item + n]
        if not taken.any():
            in_doc[at_doc : at_doc + n] = True
            in_item[at_item : at_item + n] = True
            tiles.append(n)
            continue
        edges = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))
        for begin, end in edges.reshape(-1, 2).tolist():
            if end - begin >= min_match:
                heapq.heappush(queue, (begin - end, at_doc + begin, at_item + begin))
    return tiles


def _matches(items: Items, hashes: Hashes, column: pa.Array, least: int) -> Iterator[tuple[int, ...]]:
    """(row, item_id, item_words, matched_words, n_tiles, longest_tile, coverage)."""
    for first, found, before in hashes.of(column):
        grams, starts = ta.grams(found, before, items.min_match)
        gram, item, place = items.seeds(grams)
        row = np.searchsorted(starts, gram, "right") - 1
        order = np.lexsort((item, row))
        row, item, place, at = row[order], item[order], place[order], (gram - starts[row])[order]
        cuts = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(item) != 0), True]) if len(row) else []
        for begin, end in zip(cuts[:-1], cuts[1:]):
            size = int(items.sizes[item[begin]])
            # Each seed adds at most MIN_MATCH words.
            if (end - begin) * items.min_match * 1000 < least * size:
                continue
            tiles = tile(at[begin:end], place[begin:end], items.min_match)
            covered = sum(tiles)
            if 1000 * covered >= least * size:
                yield (
                    first + int(row[begin]),
                    int(items.ids[item[begin]]),
                    size,
                    covered,
                    len(tiles),
                    tiles[0],
                    1000 * covered // size,
                )


def benchmark_blocks(benchmark: DataFrame, min_match: int = MIN_MATCH, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items in blocks that a driver and an executor can hold."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-total // block_bytes)
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        ids = part.column("item_id").fill_null(-1).to_pylist()
        yield Items(ids, part.column("text").combine_chunks().cast(pa.string()), min_match)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least: int = LEAST_COVERAGE, min_match: int = MIN_MATCH
) -> DataFrame:
    """doc_id and RESULT of every document and item of which `least` thousandths are covered."""
    spark = docs.sparkSession
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    names = ["item_id", "item_words", "matched_words", "n_tiles", "longest_tile", "coverage"]
    out = None
    for items in benchmark_blocks(benchmark, min_match):
        shared = spark.sparkContext.broadcast(items.values())

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = Items.of_values(shared.value)
            hashes = Hashes(known.classes)
            for batch in batches:
                with np.errstate(over="ignore"):
                    found = list(_matches(known, hashes, batch.column("text"), least))
                columns = np.array(found, np.int64).reshape(-1, 7)
                ids = batch.column("doc_id").take(pa.array(columns[:, 0]))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns[:, 1:].T)], ["doc_id", *names])

        part = narrow.mapInArrow(run, f"doc_id {kind}, {RESULT}")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"doc_id {kind}, {RESULT}")


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, least: int = LEAST_COVERAGE, min_match: int = MIN_MATCH
) -> DataFrame:
    """The documents that hold no item, with all their columns; each goes on where it lies."""
    spark = docs.sparkSession
    nested = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    for items in benchmark_blocks(benchmark, min_match):
        shared = spark.sparkContext.broadcast(items.values())

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = Items.of_values(shared.value)
            hashes = Hashes(known.classes)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                with np.errstate(over="ignore"):
                    for found in _matches(known, hashes, batch.column("text"), least):
                        keep[found[0]] = False
                yield batch.filter(pa.array(keep))

        nested = nested.mapInArrow(run, nested.schema)
    return nested.select("row.*")
