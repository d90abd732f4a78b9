"""Long strings that an earlier document holds already, by sparse prefix doubling.

A byte goes if a string of WIDTH bytes covers it that also starts in a document with a smaller doc_id. Doubling
over every byte would sort rows of 30 bytes and more for each byte of text, several times over. Here it runs over a
sample of positions that equal strings share: of the GRAM-byte strings inside each WIDTH-byte window that with the
smallest hash is its anchor, so two equal windows have their anchors at the same place in them. An anchor
stands for about 17 windows in a row, whose bytes are its context.

1. Positions are ranked by the GRAM bytes at the anchor, then by the pair (rank, name of the whole context): Spark
   sorts (rank, context, doc_id). Positions whose rank no other context and no other document shares are
   unique and drop out; equal contexts leave all but the smallest document decided.
2. What is undecided, contexts that share the anchor string and differ further out, moves on to windows: each is
   named by the pair of ranks of its first and last 25 bytes, which passes the threshold; sorted again per
   anchor, the smallest document keeps the window.
3. Decided windows meet their text once, and covered bytes go.

Ranks are hashes, since only equality is asked: 48 bits for the anchor and 64 for the context inside it.
The texts are shuffled once, for steps 2 and 3 together.

Cases: a null text is empty; texts under WIDTH bytes lose nothing; a doc_id names one document, so rows that share one
must be equal and are cleaned alike; null doc_ids come first and keep all; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm import text_arrays as ta
from passages.llm.ngram_join import _groups, count_sketch
from passages.llm.storage import stored

WIDTH = 50
GRAM = 16
SPAN = WIDTH - GRAM + 1
HALF = WIDTH // 2
#: An anchor string with more undecided contexts is compared window by window through a shuffle.
MANY_CONTEXTS = 20_000
SMALL = 6  # bits for numbers below SPAN
#: A rank is dealt to several tasks if its cell of the sketch counts more than this, and this many times the mean.
HOT_RANK = 20_000
HOT_SHARE = 16
SALT_BITS = 12
PLACE_BITS = 50


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """For every run of `width` numbers the place of its smallest, the first of equal ones."""
    least, place, span = x, np.arange(len(x)), 1
    while span < width:
        step = min(span, width - span)
        if len(least) <= step:
            return np.zeros(0, np.int64)
        later = least[step:] < least[:-step]
        place = np.where(later, place[step:], place[:-step])
        least = np.where(later, least[step:], least[:-step])
        span += step
    return place


def anchors(hasher: ta.Hasher, data: np.ndarray, offsets: np.ndarray):
    """(text, first window, number of windows, anchor, rank, context) of every anchor."""
    prefix = hasher.prefix(data)
    ranks = ta.mix(hasher.windows(prefix, GRAM))
    place = sliding_least(ranks, SPAN)
    windows = np.arange(len(place))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    whole = windows + WIDTH <= offsets[text + 1]
    windows, place, text = windows[whole], place[whole], text[whole]
    fresh = np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])][: len(place)]
    starts = np.flatnonzero(fresh)
    count = np.diff(np.r_[starts, len(windows)])
    first, anchor = windows[starts], place[starts]
    shape = (anchor - first).astype(np.uint64) * np.uint64(ta.ROOT) + count.astype(np.uint64)
    context = ta.mix(hasher.between(prefix, first, first + count - 1 + WIDTH) + ta.mix(shape))
    return text[starts], first, count, anchor, ranks[anchor], context


class AnchorRanks:
    """The ranks at the anchors of texts, for the count sketch."""

    def __init__(self):
        self.hasher = ta.Hasher(3)

    def of(self, column: pa.Array) -> Iterator[tuple]:
        for row, _, data, offsets in ta.slices(column):
            yield row, anchors(self.hasher, data, offsets)[4]


def salts(levels: np.ndarray) -> np.ndarray:
    """Per cell of the sketch into how many parts its ranks are dealt: 1, but for cells far above
    HOT_RANK positions and the mean of all cells."""
    counts = np.exp2(levels / 4.0)
    most = max(HOT_RANK, HOT_SHARE * counts.mean())
    return np.minimum(np.where(counts > most, np.ceil(counts / most) + 1, 1), 1 << SALT_BITS).astype(np.int64)


def _shift(salt: np.ndarray) -> np.ndarray:
    """What a salt changes in a rank; salt 0 changes nothing."""
    spread = ta.mix(salt.astype(np.uint64) * np.uint64(ta.ROOT)) >> np.uint64(16)
    return np.where(salt > 0, spread, np.uint64(0)).astype(np.int64)


def positions(docs: DataFrame, parts) -> DataFrame:
    """(g, c, doc_id, at): rank and context of every anchor; at packs a salt, the place of its first window,
    the distance to the anchor and the number of windows. The rank of a salted row is shifted by its salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ta.Hasher(3)
        for batch in batches:
            with np.errstate(over="ignore"):
                for row, _, data, offsets in ta.slices(batch.column("text")):
                    text, first, count, anchor, rank, context = anchors(hasher, data, offsets)
                    begin = first - offsets[:-1][text]
                    at = (((begin << SMALL) | (anchor - first)) << SMALL) | count
                    ids = batch.column("doc_id").take(pa.array(row + text))
                    dealt = parts.value[rank >> np.uint64(65 - len(parts.value).bit_length())]
                    spread = (ta.mix(ids.to_numpy().astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
                    salt = np.where(dealt > 1, 1 + spread % dealt, 0)
                    at |= salt << PLACE_BITS
                    g = (rank >> np.uint64(16)).astype(np.int64) ^ _shift(salt)
                    columns = [pa.array(g), pa.array(context.view(np.int64)), ids, pa.array(at)]
                    yield pa.RecordBatch.from_arrays(columns, ["g", "c", "doc_id", "at"])

    return docs.mapInArrow(run, f"g long, c long, doc_id {_kind(docs)}, at long")


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def first_holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions sorted by (g, c, doc_id) to (g, c, number, doc_id, at).

    number is null where a smaller document has the same context; else it counts the contexts of g. Positions whose g has one
    context only and whose document is the smallest with it are unique and left out, unless they are salted. Between batches
    only the last row, and the rows of a first context whose g may end with it, are held.
    """
    last = None  # g, c, smallest document, number of the context
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g, c = batch.column("g").to_numpy(), batch.column("c").to_numpy()
        doc = batch.column("doc_id").to_numpy()
        g_before, c_before = np.r_[g[:1], g[:-1]], np.r_[c[:1], c[:-1]]
        if last:
            g_before[0], c_before[0] = last[0], last[1]
        new_g, new_c = g != g_before, (g != g_before) | (c != c_before)
        if not last:
            new_g[0] = new_c[0] = True
        at_c = np.maximum.accumulate(np.where(new_c, np.arange(len(g)), -1))
        least = np.where(at_c >= 0, doc[np.maximum(at_c, 0)], last[2] if last else 0)
        counted = np.cumsum(new_c)
        at_g = np.maximum.accumulate(np.where(new_g, np.arange(len(g)), -1))
        number = np.where(at_g >= 0, counted - counted[np.maximum(at_g, 0)], counted + (last[3] if last else 0))
        decided = doc > least
        # First contexts wait until their g is known to have a second one.
        group = np.cumsum(new_g)
        more = np.zeros(group[-1] + 1, bool)
        np.logical_or.at(more, group, number > 0)
        if more[0] or (last and last[3] > 0):
            more[0] = True
            yield from waiting
            waiting = []
        elif new_g[1:].any() or new_g[0]:
            waiting = []
        salted = batch.column("at").to_numpy() >> PLACE_BITS > 0
        out = decided | more[group] | salted
        if out.any():
            yield _picked(batch, out, number, decided)
        tail = (group == group[-1]) & ~out
        if not more[group[-1]] and tail.any():
            waiting.append(_picked(batch, tail, number, decided))
        last = (int(g[-1]), int(c[-1]), int(least[-1]), int(number[-1]))


def _picked(batch, mask, number, decided) -> pa.RecordBatch:
    part = batch.filter(pa.array(mask))
    numbers = pa.array(number[mask], pa.int64(), mask=decided[mask])
    return pa.RecordBatch.from_arrays(
        [part.column("g"), part.column("c"), numbers, part.column("doc_id"), part.column("at")],
        ["g", "c", "number", "doc_id", "at"],
    )


def unsalted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their own rank and place again."""
    for batch in batches:
        at = batch.column("at").to_numpy()
        g = batch.column("g").to_numpy() ^ _shift(at >> PLACE_BITS)
        columns = [pa.array(g), batch.column("c"), batch.column("doc_id"), pa.array(at & ((1 << PLACE_BITS) - 1))]
        yield pa.RecordBatch.from_arrays(columns, ["g", "c", "doc_id", "at"])


def ranked_positions(docs: DataFrame) -> DataFrame:
    """(g, number, doc_id, at) of all positions that are not unique.

    A rank that very many positions share, such as one in a passage of a third of all documents, is dealt to
    several tasks by document. There the smallest document with a context decides the rest of the part; only these
    smallest ones meet once more under the rank itself.
    """
    kind = _kind(docs)
    levels = count_sketch(docs, AnchorRanks)
    parts = docs.sparkSession.sparkContext.broadcast(salts(levels))
    columns = f"g long, c long, number long, doc_id {kind}, at long"
    ranked = positions(docs, parts).repartition("g").sortWithinPartitions("g", "c", "doc_id")
    found = stored(ranked.mapInArrow(first_holders, columns))
    salted = F.shiftright("at", PLACE_BITS) > 0
    here = F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("at")
    done = found.where(~salted | F.col("number").isNull()).select("g", "number", "doc_id", here)
    if not (parts.value > 1).any():
        return done
    rest = found.where(salted & F.col("number").isNotNull()).select("g", "c", "doc_id", "at")
    again = rest.mapInArrow(unsalted, f"g long, c long, doc_id {kind}, at long")
    met = again.repartition("g").sortWithinPartitions("g", "c", "doc_id").mapInArrow(first_holders, columns)
    return done.unionByName(stored(met.select("g", "number", "doc_id", "at")))


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their undecided positions to (g, doc_id, at, bytes)."""
    for batch in batches:
        texts, found = batch.column("text"), batch.column("found")
        rows = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        if not len(rows):
            continue
        places, ids, ranks, pieces = [], [], [], []
        for row in rows.tolist():
            data = (texts[row].as_py() or "").encode()
            for item in found[row].as_py():
                begin, count = item["at"] >> (2 * SMALL), item["at"] & ((1 << SMALL) - 1)
                places.append(item["at"])
                ranks.append(item["g"])
                pieces.append(data[begin : begin + count - 1 + WIDTH])
                ids.append(row)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ranks, pa.int64()),
                batch.column("doc_id").take(pa.array(ids, pa.int64())),
                pa.array(places, pa.int64()),
                pa.array(pieces, pa.binary()),
            ],
            ["g", "doc_id", "at", "bytes"],
        )


def _window_names(hasher, table: pa.Table):
    """Per window of the contexts: row, distance to the anchor, its bit, and the pair of ranks of its halves as one name."""
    at = table.column("at").to_numpy()
    count = at & ((1 << SMALL) - 1)
    distance = (at >> SMALL) & ((1 << SMALL) - 1)
    data = np.frombuffer(b"".join(p.as_py() for p in table.column("bytes")), np.uint8)
    starts = np.cumsum(count + WIDTH - 1) - (count + WIDTH - 1)
    row = np.repeat(np.arange(len(at)), count)
    bit = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = starts[row] + bit
    prefix = hasher.prefix(data)
    left = hasher.between(prefix, begin, begin + HALF)
    right = hasher.between(prefix, begin + HALF, begin + WIDTH)
    return row, distance[row] - bit, bit, ta.mix(ta.mix(left) + right * np.uint64(ta.ROOT))


def decided_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by g to (doc_id, at, mask): the windows that a smaller document has."""
    hasher = ta.Hasher(4)
    for table in _groups(batches, "g"):
        with np.errstate(over="ignore"):
            g, doc = table.column("g").to_numpy(), table.column("doc_id").to_numpy()
            row, distance, bit, name = _window_names(hasher, table)
            key = ta.mix(name ^ ta.mix(g.view(np.uint64)[row] + distance.astype(np.uint64)))
            order = np.lexsort((doc[row], key))
            key, row, bit = key[order], row[order], bit[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            least = np.repeat(doc[row[starts]], np.diff(np.r_[starts, len(key)]))
            late = doc[row] > least
            mask = np.zeros(len(g), np.int64)
            np.bitwise_or.at(mask, row[late], np.int64(1) << bit[late])
            some = pa.array(mask != 0)
            part = table.select(["doc_id", "at"]).filter(some).append_column("mask", pa.array(mask[mask != 0]))
            yield from part.to_batches()


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts to one row per window: (g, name, doc_id, at, mask)."""
    hasher = ta.Hasher(4)
    for batch in batches:
        if batch.num_rows:
            with np.errstate(over="ignore"):
                row, distance, bit, name = _window_names(hasher, pa.Table.from_batches([batch]))
                name = ta.mix(name + distance.astype(np.uint64))
            rows = pa.array(row)
            columns = [batch.column("g").take(rows), pa.array(name.view(np.int64)), batch.column("doc_id").take(rows)]
            columns += [batch.column("at").take(rows), pa.array(np.int64(1) << bit)]
            yield pa.RecordBatch.from_arrays(columns, ["g", "name", "doc_id", "at", "mask"])


def clean(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Texts with their decided windows to what is left of them."""
    for batch in batches:
        windows = batch.column("windows")
        for row, end, data, offsets in ta.slices(batch.column("text")):
            part = windows.slice(row, end - row).fill_null([])
            lists = part.flatten()
            text = np.repeat(np.arange(end - row), np.diff(part.offsets.to_numpy()))
            at, mask = (lists.field(k).to_numpy() for k in range(2))
            which, bit = np.nonzero((mask[:, None] >> np.arange(SPAN)) & 1)
            begin = offsets[text[which]] + (at[which] >> (2 * SMALL)) + bit
            change = np.zeros(len(data) + 1, np.int64)
            np.add.at(change, begin, 1)
            np.add.at(change, begin + WIDTH, -1)
            gone = np.cumsum(change)[:-1] > 0
            spans = np.diff(ta.runs(gone, offsets)[2])
            left = data[~gone]
            removed = ta.count_of(gone, offsets)
            bounds = np.r_[0, np.cumsum(np.diff(offsets) - removed)].tolist()
            kept = [left[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            columns = [
                batch.column("doc_id").slice(row, end - row),
                pa.array(np.diff(offsets)),
                pa.array(removed),
                pa.array(spans),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            ]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, unless left out, the kept bytes."""
    kind = _kind(docs)
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = ranked_positions(narrow.where("doc_id is not null"))
    # The texts are dealt out once: both joins below read the same exchange.
    texts = narrow.repartition("doc_id")
    undecided = found.where("number is not null")
    per_doc = undecided.groupBy("doc_id").agg(F.collect_list(F.struct("g", "at")).alias("found"))
    cut = texts.join(per_doc, "doc_id", "left").mapInArrow(contexts, f"g long, doc_id {kind}, at long, bytes binary")
    hot = stored(undecided.where(F.col("number") >= MANY_CONTEXTS).select("g").distinct())
    if hot.isEmpty():
        few, many = cut, None
    else:
        few, many = cut.join(hot, "g", "left_anti"), cut.join(hot, "g", "left_semi")
    masks = few.repartition("g").sortWithinPartitions("g").mapInArrow(
        decided_windows, f"doc_id {kind}, at long, mask long"
    )
    if many is not None:
        rows = many.mapInArrow(window_rows, f"g long, name long, doc_id {kind}, at long, mask long")
        least = rows.groupBy("g", "name").agg(F.min("doc_id").alias("least"))
        late = rows.join(least, ["g", "name"]).where("doc_id > least")
        masks = masks.unionByName(late.groupBy("doc_id", "at").agg(F.bit_or("mask").alias("mask")))
    every = found.where("number is null").select(
        "doc_id", "at", F.expr(f"shiftleft(1L, cast(at & {(1 << SMALL) - 1} as int)) - 1").alias("mask")
    )
    windows = every.unionByName(masks).groupBy("doc_id").agg(F.collect_list(F.struct("at", "mask")).alias("windows"))
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    joined = texts.join(windows, "doc_id", "left")
    return joined.mapInArrow(lambda b: clean(b, with_text), schema + (", kept binary" if with_text else ""))
