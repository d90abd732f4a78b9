"""Lines that repeat or nearly repeat an earlier line, by an exact set-similarity join.

A line is the set of its words (lower-cased in A to Z). Words are ordered by rarity: levels of a count sketch
over all documents, then hash. Two sets with Jaccard similarity of `percent` or more share a word among their first
n - ceil(t n) + 1 (prefix filter); at the first word they share, the rests of both must be long enough for the overlap (positional
filter), and their sizes must be near each other (length filter). A bitmap of each set bounds the
overlap once more. Sets that pass all filters with one another meet under a leader, the smallest of those that hang
together by such pairs at a word, where Jaccard is verified on whole sets. Only the first line of such a set is cut into words again for that.

A line is removed if an earlier one (by doc_id, then place in the document) has the same set, or if its set first appears
later than a similar set. Whether the earlier line is removed itself makes no difference, so the result does
not depend on any order of work.

No pair is written to a shuffle. Words that very many sets have in their prefix are dealt to several tasks, block
against block.

Cases: null and empty texts have no line; lines without a word are never removed; rows with one doc_id
count as one document, whose equal lines at equal places stay together; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm import ngram_join as nj
from passages.llm import text_arrays as ta
from passages.llm.storage import stored

PERCENT = 80
SKETCH_BITS = 24
HOT_WORD = 20_000
BROADCAST_WORDS = 10_000
BLOCK_ROWS = 4_096
WIDE = 64

#: Words of more bytes are hashed as a whole; masks of the first 0 to 8 bytes.
LONG_WORD = 64
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: Of a prefix word its level and 32 bits of hash are posted: words that share them only meet in vain.
KEY = np.uint64(0xFFFFFFFFFF000000)

LINE = ("line_no", "n_chars", "a", "b")
SET = ("a", "n", "skip", "m0", "m1", "w")
MARKED = ["line_no", "n_chars", "removed"]

RULE = nj.Rule(width=1, percent=PERCENT)


class Words:
    """Hashes of the words of texts, lower-cased in A to Z."""

    def __init__(self):
        self.hasher = ta.Hasher(13, ta.LOWER)

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hash and first byte of each word, and the number of words before each text (and in all).

        Words are hashed eight bytes at a time, very long ones as a whole.
        """
        start, end, before = ta.words(data, offsets)
        length = end - start
        folded = np.zeros(len(data) + 8, np.uint8)
        folded[:-8] = ta.LOWER[data]
        eight = np.ndarray(len(data) + 1, "<u8", folded, strides=(1,))
        hashes = ta.mix((eight[start] & FIRST[np.minimum(length, 8)]) ^ ta.mix(length.astype(np.uint64)))
        for k in range(8, LONG_WORD, 8):
            longer = np.flatnonzero(length > k)
            if not len(longer):
                break
            part = eight[start[longer] + k] & FIRST[np.minimum(length[longer] - k, 8)]
            hashes[longer] = ta.mix((hashes[longer] + np.uint64(ta.ROOT)) ^ part)
        longer = np.flatnonzero(length > LONG_WORD)
        if len(longer):
            hashes[longer] = ta.mix(self.hasher.between(self.hasher.prefix(data), start[longer], end[longer]))
        return hashes, start, before

    def of(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        for first, _, data, offsets in ta.slices(column):
            yield first, self.hashes(data, offsets)[0]


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """First byte, end, text and number in its text of each line of a slice; an empty line at the end of a text may be left out."""
    breaks = np.flatnonzero(data == 0x0A)
    # A line starts with its text or behind a line break.
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    starts = starts[starts < len(data)]
    text = np.searchsorted(offsets, starts, "right") - 1
    number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[:-1])[text]
    stop = np.minimum(np.r_[starts[1:], len(data)], offsets[1:][text])
    return starts, stop, text, number


class Lines(Words):
    """Word hashes of texts, and which words stand in which line."""

    def of(self, column: pa.Array) -> Iterator[tuple]:
        """(first row, end row, word hashes, words of each line, text of each line, number of each line in
        its text, characters of each line) of a slice; lines without a word are left out."""
        for first, end, data, offsets in ta.slices(column):
            hashes, start, _ = self.hashes(data, offsets)
            starts, stop, text, number = line_bounds(data, offsets)
            counts = np.diff(np.searchsorted(start, np.r_[starts, len(data)]))
            used = counts > 0
            starts, stop = starts[used], stop[used]
            inner = np.flatnonzero(~ta.code_points(data))
            chars = stop - starts - (data[stop - 1] == 0x0A) - (np.searchsorted(inner, stop) - np.searchsorted(inner, starts))
            yield first, end, hashes, counts[used], text[used], number[used], chars


def line_sets(hashes: np.ndarray, counts: np.ndarray, levels) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lines, line after line and each sorted without repeats, and their sizes."""
    numbers = nj.in_order(hashes, levels)
    line = np.repeat(np.arange(len(counts)), counts)
    # One sort by line and the first bits of the number; where that leaves numbers out of order, by both in full.
    bits = np.uint64(len(counts).bit_length())
    key = (line.astype(np.uint64) << (np.uint64(64) - bits)) | (numbers >> bits) if len(line) else numbers
    order = np.argsort(key)
    key, found = key[order], numbers[order]
    if (found[1:] < found[:-1])[key[1:] == key[:-1]].any():
        found = numbers[np.lexsort((numbers, line))]
    keep = np.r_[True, (found[1:] != found[:-1]) | (line[1:] != line[:-1])][: len(found)]
    return found[keep], np.bincount(line[keep], minlength=len(counts))


def line_table(docs: DataFrame, levels) -> DataFrame:
    """Per row of docs: doc_id; lines, the line_no, n_chars, a, b of every line with a word; and sets, for each distinct
    set that a task sees its size n, bitmap m0, m1 and the words w of its prefix, the first at place skip.

    Sets of which no other set can be near enough have no prefix (three words and fewer, at 80 per cent), and a
    word that was counted once in all documents is no meeting point, so it is left out of it: such words come first.
    """
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, seen = Lines(), set()
        for batch in batches:
            with np.errstate(over="ignore"):
                for first, end, hashes, counts, text, number, chars in lines.of(batch.column("text")):
                    sets, sizes = line_sets(hashes, counts, levels.value)
                    a, b = nj.digests(sets, sizes)
                    lonely = (100 * sizes // PERCENT == sizes) & ((PERCENT * sizes + 99) // 100 == sizes)
                    keys = zip(a.tolist(), b.tolist())
                    new = np.array([nj._is_new(seen, key, n) for key, n in zip(keys, sizes.tolist())], bool)
                    lengths = np.where(new & ~lonely, RULE.prefix(sizes), 0)
                    begin = np.cumsum(sizes) - sizes
                    pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                    words = sets[np.repeat(begin, lengths) + pos]
                    shared = (words >> np.uint64(64 - nj.LEVEL_BITS)) > nj.ONCE
                    left = np.bincount(np.repeat(np.arange(len(sizes)), lengths)[shared], minlength=len(sizes))
                    put = left > 0
                    m0, m1 = bitmaps(sets, sizes)
                    rows = end - first
                    columns = [pa.array(number), pa.array(chars), nj._signed(a), nj._signed(b)]
                    every = _rows(columns, LINE, text, rows)
                    columns = [nj._signed(a[put]), pa.array(sizes[put]), pa.array((lengths - left)[put])]
                    columns += [nj._signed(m0[put]), nj._signed(m1[put]), nj._lists(words[shared] & KEY, left[put])]
                    posted = _rows(columns, SET, text[put], rows)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, rows), every, posted], ["doc_id", "lines", "sets"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    line = ", ".join(f"{c}: bigint" for c in LINE)
    posted = ", ".join(f"{c}: {'array<bigint>' if c == 'w' else 'bigint'}" for c in SET)
    return narrow.mapInArrow(run, f"doc_id {kind}, lines array<struct<{line}>>, sets array<struct<{posted}>>")


def _rows(columns: list[pa.Array], names: tuple[str, ...], row: np.ndarray, rows: int) -> pa.ListArray:
    """Lists of structs: the entries of each row, which come row by row."""
    offsets = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, names))


def postings(lines: DataFrame) -> DataFrame:
    """(w, a, m0, m1, place): the prefix words of each set, with the bitmap of the set; place is its size and, in the low 32 bits, the place of the word."""
    sets = lines.select(F.explode("sets").alias("s")).select("s.*")
    each = sets.select("a", "m0", "m1", "n", "skip", F.posexplode("w").alias("k", "w"))
    place = F.shiftleft("n", 32).bitwiseOR(F.col("skip") + F.col("k"))
    return each.select("w", "a", "m0", "m1", place.alias("place"))


def bitmaps(sets: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Per set two 64-bit words: each member flips a bit, so two sets differ in as many members as bits at least.

    A set of fewer than WIDE members has its two words folded into the first.
    """
    spread = ta.mix(sets)
    bit = np.uint64(1) << (spread & np.uint64(63))
    high = (spread >> np.uint64(6)) & np.uint64(1) == 1
    high &= np.repeat(sizes >= WIDE, sizes)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = []
    for side in (~high, high):
        mask = np.zeros(len(sizes), np.uint64)
        if len(starts):
            mask[sizes > 0] = np.bitwise_xor.reduceat(np.where(side, bit, np.uint64(0)), starts)
        out.append(mask)
    return out


def dealt_postings(lines: DataFrame) -> DataFrame:
    """Postings as (own, task, a, m0, m1, place): a word is a task; a word with very many sets is one for each pair of parts,
    where own is the part of a set, from 1, in a task of two parts.

    A word in many prefixes is frequent, so only words of a high level need to be counted.
    """
    level = F.shiftrightunsigned("w", 64 - nj.LEVEL_BITS)
    often = lines.select(F.explode(F.flatten("sets.w")).alias("w")).where(level >= int(4 * math.log2(HOT_WORD + 1)))
    counts = often.groupBy("w").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT_WORD)
    hot = stored(counts.select("w", F.ceil(F.col("c") / BLOCK_ROWS).cast("int").alias("parts")))
    n_hot = hot.limit(BROADCAST_WORDS + 1).count()
    found = postings(lines)
    if not n_hot:
        return found.select(F.lit(0).alias("own"), F.col("w").alias("task"), "a", "m0", "m1", "place")
    joined = found.join(F.broadcast(hot) if n_hot <= BROADCAST_WORDS else hot, "w", "left")
    own = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("a"), F.col("parts"))).cast("int")
    others = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    task = F.when(F.col("parts").isNull(), F.col("w")).otherwise(F.xxhash64("w", low, high)).alias("task")
    part = F.when(F.col("own") != F.col("other"), F.col("own") + 1).otherwise(0).alias("own")
    dealt = joined.withColumn("own", own).withColumn("other", F.explode(others))
    return dealt.select(part, task, "a", "m0", "m1", "place")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _hang(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the components of the pairs (x, y); root has the smallest member of each one's component."""
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low != high
        if not apart.any():
            return
        x, y = x[apart], y[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root[:] = root[root]


def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by task to (a, leader, n): sets with a partner that passes all filters.

    Sets that hang together by such pairs have one leader, the smallest of them.
    """
    for table in nj._groups(batches, "task"):
        task, place, a, own, m0, m1 = (table.column(c).to_numpy() for c in ("task", "place", "a", "own", "m0", "m1"))
        order = np.lexsort((a, place >> 32, task))
        task, place, a, own, m0, m1 = (x[order] for x in (task, place, a, own, m0.view(np.uint64), m1.view(np.uint64)))
        n = place >> 32
        rest = n - (place & 0xFFFFFFFF)
        fresh = np.r_[True, (task[1:] != task[:-1]) | (100 * n[:-1] < PERCENT * n[1:])]
        run_of = np.cumsum(fresh) - 1
        ends = np.r_[np.flatnonzero(fresh)[1:], len(n)]
        end = ends[run_of]
        near = np.zeros(len(n), bool)
        root = np.arange(len(n))
        i = np.flatnonzero(np.arange(len(n)) + 1 < end)
        step = 1
        while len(i):
            j = i + step
            # Rows of a run are sorted by size: behind a partner too large for what is left of the set all are.
            need = RULE.needed(n[i], n[j])
            fits = need <= rest[i]
            i, j, need = i[fits], j[fits], need[fits]
            passed = need <= rest[j]
            passed &= a[i] != a[j]
            passed &= (own[i] == 0) | (own[i] != own[j])
            x, y, need = i[passed], j[passed], need[passed]
            d0, d1 = m0[x] ^ m0[y], m1[x] ^ m1[y]
            # The smaller set is x: where it is folded, the other is folded too.
            differ = np.where(n[x] < WIDE, _popcount(d0 ^ d1), _popcount(d0) + _popcount(d1))
            close = (n[x] + n[y] - differ) // 2 >= need
            x, y = x[close], y[close]
            near[x] = True
            near[y] = True
            _hang(root, x, y)
            step += 1
            i = i[i + step < end[i]]
        yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(a[root[near]]), pa.array(n[near])], ["a", "leader", "n"])


def wanted_lines(lines: DataFrame, wanted) -> DataFrame:
    """doc_id, line_no, a, b of the lines whose set may be wanted."""
    narrow = lines.select("doc_id", "lines.line_no", "lines.a", "lines.b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, a, b = (batch.column(c).flatten() for c in ("line_no", "a", "b"))
            at = pa.array(np.flatnonzero(nj.passes(wanted.value, a.to_numpy().view(np.uint64))))
            ids = batch.column("doc_id").take(pc.list_parent_indices(batch.column("a")).take(at))
            yield pa.RecordBatch.from_arrays([ids, number.take(at), a.take(at), b.take(at)], ["doc_id", "line_no", "a", "b"])

    kind = lines.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, line_no long, a long, b long")


def _place(doc: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A hash of a line's place, from a hash of its doc_id and its number in the text."""
    return ta.mix(doc.view(np.uint64) ^ ta.mix(number.astype(np.uint64)))


def places(lines: DataFrame) -> DataFrame:
    """a: the hash of the place of each line (doc_id, line_no)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                place = _place(batch.column("doc").to_numpy(), batch.column("line_no").to_numpy())
            yield pa.RecordBatch.from_arrays([nj._signed(place)], ["a"])

    return lines.select(F.xxhash64("doc_id").alias("doc"), "line_no").mapInArrow(run, "a long")


def wanted_sets(docs: DataFrame, levels, wanted) -> DataFrame:
    """(a, b, numbers) of the lines whose place may be wanted; only these are cut into words."""
    narrow = docs.select(F.xxhash64("doc_id").alias("doc"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), set()
        for batch in batches:
            doc = batch.column("doc").to_numpy()
            with np.errstate(over="ignore"):
                for first, _, data, offsets in ta.slices(batch.column("text")):
                    starts, stop, text, number = line_bounds(data, offsets)
                    maybe = nj.passes(wanted.value, _place(doc[first + text], number))
                    if not maybe.any():
                        continue
                    starts, length = starts[maybe], (stop - starts)[maybe]
                    cuts = np.r_[0, np.cumsum(length)]
                    some = data[np.repeat(starts - cuts[:-1], length) + np.arange(cuts[-1])]
                    hashes, _, before = words.hashes(some, cuts)
                    sets, sizes = line_sets(hashes, np.diff(before), levels.value)
                    a, b = nj.digests(sets, sizes)
                    keep = np.array([nj._is_new(seen, key, n) for key, n in zip(zip(a.tolist(), b.tolist()), sizes.tolist())], bool)
                    if keep.any():
                        columns = [nj._signed(a[keep]), nj._signed(b[keep]), nj._lists(sets[np.repeat(keep, sizes)], sizes[keep])]
                        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "numbers"])

    return narrow.mapInArrow(run, "a long, b long, numbers array<long>")


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of a task, in order of first appearance, to (a, b) of those with a similar earlier one."""
    for table, blocks in nj._blocks(batches):
        own, paired = (table.column(c).to_numpy() for c in ("own", "paired"))
        sets = table.column("numbers").combine_chunks()
        late = []
        for begin, end in blocks:
            numbers = [nj._slice(sets, k) for k in range(begin, end)]
            size = np.array([len(x) for x in numbers])
            for k in range(1, end - begin):
                for e in range(k):
                    if paired[begin + k] and own[begin + k] == own[begin + e]:
                        continue
                    n, m = int(size[k]), int(size[e])
                    if PERCENT * max(n, m) > 100 * min(n, m):
                        continue
                    both = len(np.intersect1d(numbers[k], numbers[e], assume_unique=True))
                    if both >= RULE.needed(n, m):
                        late.append(begin + k)
                        break
        picked = table.select(["a", "b"]).take(pa.array(late, pa.int64()))
        yield from picked.to_batches()


def similar_sets(docs: DataFrame, lines: DataFrame, levels) -> DataFrame:
    """(a, b) of the sets with a similar one that appears earlier."""
    context = docs.sparkSession.sparkContext
    ordered = dealt_postings(lines).repartition("task").sortWithinPartitions("task")
    kept = stored(ordered.mapInArrow(filtered, "a long, leader long, n long").distinct())
    near = wanted_lines(lines, context.broadcast(nj.filter_bits(kept)))
    classes = stored(near.groupBy("a", "b").agg(F.min(F.struct("doc_id", "line_no")).alias("first")))
    wanted = context.broadcast(nj.filter_bits(places(classes.select("first.*"))))
    whole = wanted_sets(docs, levels, wanted).groupBy("a", "b").agg(F.first("numbers").alias("numbers"))
    # Thin rows are dealt out; whole sets follow once.
    met = nj.deal(kept.join(classes, "a")).join(whole, ["a", "b"])
    tasks = met.repartition("task").sortWithinPartitions("task", "first", "a", "b")
    columns = ("task", "own", "paired", "a", "b", "numbers")
    return tasks.select(*columns).mapInArrow(verified, "a long, b long").distinct()


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their lines, and the lines of the document that stay, to rows whose lines are marked."""
    for batch in batches:
        number, chars, a = (batch.column(c).flatten() for c in ("line_no", "n_chars", "a"))
        line = pc.list_parent_indices(batch.column("line_no")).to_numpy().astype(np.int64) << 32 | number.to_numpy()
        stay = batch.column("stay").flatten()
        stay_a, stay_no = (stay.field(c).to_numpy() for c in ("a", "line_no"))
        of = pc.list_parent_indices(batch.column("stay")).to_numpy().astype(np.int64) << 32 | stay_no
        # Lines come row by row in order of their numbers; of two rows with one doc_id, one may lack the line.
        at = np.searchsorted(line, of)
        there = at < len(line)
        at, of, stay_a = at[there], of[there], stay_a[there]
        removed = np.ones(len(line), bool)
        removed[at[(line[at] == of) & (a.to_numpy()[at] == stay_a)]] = False
        marked = pa.StructArray.from_arrays([number, chars, pa.array(removed)], MARKED)
        offsets = np.r_[0, np.cumsum(pc.list_value_length(batch.column("line_no")).to_numpy())].astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), marked)], ["doc_id", "lines"])


def marked_lines(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id and lines, the line_no, n_chars and removed of every line with a word."""
    levels = docs.sparkSession.sparkContext.broadcast(nj.count_sketch(docs, Words, SKETCH_BITS))
    lines = stored(line_table(docs, levels))
    late = similar_sets(docs, lines, levels)
    each = lines.select("doc_id", F.explode("lines").alias("line")).select("doc_id", "line.line_no", "line.a", "line.b")
    classes = each.groupBy("a", "b").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    # Of a set only its first line can stay; rows with one doc_id are told apart by the set.
    stay = classes.join(late, ["a", "b"], "left_anti").select("first.doc_id", "first.line_no", "a")
    stay = stay.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "a")).alias("stay")).withColumnRenamed("doc_id", "of")
    rows = lines.select("doc_id", *(f"lines.{c}" for c in ("line_no", "n_chars", "a")))
    joined = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("of")), "left").drop("of")
    none = F.array().cast(joined.schema["stay"].dataType)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.withColumn("stay", F.coalesce("stay", none)).mapInArrow(
        judged, f"doc_id {kind}, lines array<struct<line_no: bigint, n_chars: bigint, removed: boolean>>"
    )


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, n_chars and removed of every line with a word."""
    return marked_lines(docs).select("doc_id", F.explode("lines").alias("line")).select("doc_id", "line.*")


def line_report(docs: DataFrame) -> DataFrame:
    """Per document: n_lines (with a word), n_removed, kept_chars and the numbers of the removed lines; all zero and an
    empty text for a document without such a line."""
    gone = F.filter("lines", lambda x: x["removed"])
    kept = F.filter("lines", lambda x: ~x["removed"])
    rows = marked_lines(docs).select(
        "doc_id",
        F.size("lines").alias("n"),
        F.aggregate(kept, F.lit(0).cast("long"), lambda total, x: total + x["n_chars"]).alias("chars"),
        F.transform(gone, lambda x: x["line_no"]).alias("gone"),
    )
    return rows.groupBy("doc_id").agg(
        F.sum("n").alias("n_lines"),
        F.sum(F.size("gone")).alias("n_removed"),
        F.sum("chars").alias("kept_chars"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))), ",").alias("removed_lines"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with `text` less its removed lines; all other columns stay, whatever their names are."""
    gone = removed_lines(docs).where("removed").groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    rows = docs.select(F.struct("*").alias("row"))
    joined = rows.join(gone, F.struct(F.col("row")["doc_id"]).eqNullSafe(F.struct(F.col("doc_id"))), "left")
    text = F.col("row")["text"]
    numbers = F.transform(F.split(text, "\n"), lambda line, k: F.struct(line.alias("line"), k.cast("long").alias("k")))
    left = F.filter(numbers, lambda x: ~F.array_contains(F.col("gone"), x["k"]))
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(left, lambda x: x["line"]), "\n"))
    return joined.select(*(kept.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
