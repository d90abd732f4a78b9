"""Texts as token ids in grammar-compressed shards, in ascending doc_id order, and their readers.

1. Rows are dealt out by ranges of doc_id (then by a hash of the text and a row number, which parts equal ids) and
   sorted; a task encodes the texts of its range.
2. Every SHARD_TOKENS ids or so make a shard of whole documents: one Re-Pair grammar (`pair_grammar.py`). A longer document
   makes a shard of its own with several grammars of that size.
3. The file format is Parquet with a row per shard: part, number (of the shard in its part), before (ids of the part
   before it), n_tokens, documents, doc_ids, lengths (ids per document) and blocks: grammars one
   after the other, each with rules, expansion lengths and sequence (`pair_grammar.to_bytes`).
4. Readers decode shard by shard; `lookup` decodes only the symbols that cover a wanted document.

Encoding: the byte-level pattern never matches across white space that follows a plain character, nor from an ASCII letter
to a mark or digit, so a piece between such places is encoded alike wherever it stands. So a task encodes each distinct piece once
and puts texts together from pieces; two generations of PIECES of them are remembered. Other kinds of
tokenizers get whole texts.

Cases: a null or empty text has the end id alone; equal doc_ids stay neighbours, each row a document of its own, ordered by text
hash; null doc_ids come first; a text of any length is one document (its ids are held by one task); an empty
table makes no shard; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.llm import pair_grammar
from passages.llm import text_arrays as ta
from passages.llm.storage import shared_folder
from passages.operators.order import running_offset

SHARD_TOKENS = 1 << 20
SLICE_BYTES = 1 << 23
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK = np.zeros(256, bool)
MARK[0x21:0x7F] = True
MARK &= ~LETTER
#: Pieces of text that a task remembers with their ids; those of the generation before it are looked at too.
PIECES = 400_000
JOINED = 128
END = 2
DIGESTS = "n_tokens long, ids_crc32 long"


class Encoder:
    """Ids of the texts of a column."""

    def __init__(self, rules: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(rules)
        told = json.loads(rules)
        cutter = told.get("pre_tokenizer") or {}
        self.in_pieces = (
            cutter.get("type") == "ByteLevel"
            and cutter.get("use_regex", True)
            and not cutter.get("add_prefix_space")
            and not told.get("normalizer")
            and not told.get("truncation")
            and not told.get("padding")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told.get("added_tokens", []))
        )
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # In a byte-level vocabulary each character stands for one byte.
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        for token in told.get("added_tokens", []):
            self.bytes_of[token["id"]] = len(token["content"].encode())
        self.tokens = [t["content"].encode() for t in told.get("added_tokens", [])]
        self.alphabet = size
        self.known, self.older = Known(), Known()

    def of(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, number of ids of each text) slice by slice; a null is empty."""
        for row, end, data, offsets in ta.slices(column, SLICE_BYTES):
            if self.in_pieces:
                yield row, *self._from_pieces(data, offsets)
            else:
                texts = [t or "" for t in column.slice(row, end - row).to_pylist()]
                found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
                counts = np.array([len(f) for f in found], np.int64)
                yield row, np.array([i for f in found for i in f], np.int32), counts

    def _from_pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        plain = plain_ends(data)
        begins = ta.SPACE[data[1:]] & plain[:-1]
        raw = data.tobytes()
        if not any(token in raw for token in self.tokens):  # a token of its own may hold such a place
            begins |= LETTER[data[:-1]] & MARK[data[1:]]
        cut = np.r_[False, begins]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        bounds = np.r_[starts, len(data)].astype(np.int32)
        pieces = pa.Array.from_buffers(
            pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        joins = ta.SPACE[data[starts]] & plain[bounds[1:] - 1]
        place = pieces.indices.to_numpy()
        distinct = pieces.dictionary.to_pylist()
        free = np.zeros(len(distinct), bool)
        free[place] = joins
        numbers = self._numbers(distinct, free)
        ids, count = self.known.of(numbers[place])
        per_text = np.r_[0, np.cumsum(count)][np.searchsorted(starts, offsets)]
        return ids, np.diff(per_text)

    def _numbers(self, pieces: list[bytes], free: np.ndarray) -> np.ndarray:
        """The number under which each distinct piece is known; unknown ones are encoded."""
        numbers = self.known.find(pieces)
        new = np.flatnonzero(numbers < 0)
        if len(self.known.number) + len(new) > PIECES:
            self.older, self.known = self.known, Known()
            new = np.arange(len(pieces))
        if not len(new):
            return numbers
        earlier = self.older.find([pieces[k] for k in new.tolist()])
        again, new = new[earlier >= 0], new[earlier < 0]
        if len(again):
            numbers[again] = self.known.add([pieces[k] for k in again.tolist()], *self.older.of(earlier[earlier >= 0]))
        if len(new):
            alone, joins = new[~free[new]], new[free[new]]
            new = np.r_[alone, joins]
            names = [pieces[k] for k in new.tolist()]
            joined = names[len(alone) :]
            # Pieces that may stand side by side go to the tokenizer many at a time.
            texts = names[: len(alone)] + [b"".join(joined[k : k + JOINED]) for k in range(0, len(joined), JOINED)]
            found = self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)
            ids = np.array([i for e in found for i in e.ids], np.int32)
            reach = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(p) for p in names]), "left") + 1
            numbers[new] = self.known.add(names, ids, np.diff(np.r_[0, reach]))
        return numbers


class Known:
    """The ids of numbered pieces."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 16, np.int64)

    def find(self, pieces: list[bytes]) -> np.ndarray:
        """Their numbers, or -1."""
        return np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))

    def add(self, pieces: list[bytes], ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        n, more = len(self.number), len(pieces)
        used = int(self.ends[n])
        if used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids[:used], np.zeros(used + 2 * len(ids), np.int32)]
        if n + more >= len(self.ends):
            self.ends = np.r_[self.ends[: n + 1], np.zeros(n + 2 * more, np.int64)]
        self.ids[used : used + len(ids)] = ids
        self.ends[n + 1 : n + 1 + more] = used + np.cumsum(counts)
        self.number.update(zip(pieces, range(n, n + more)))
        return n + np.arange(more)

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after the other, and how many each has."""
        first, count = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        stops = np.cumsum(count)
        return self.ids[np.repeat(first - (stops - count), count) + np.arange(int(stops[-1]))], count


def plain_ends(data: np.ndarray) -> np.ndarray:
    """True at the last byte of a character that is surely not white space.

    Sure are printable ASCII and characters whose first byte is none of C2, E1, E2, E3: all
    white space above ASCII begins with one of those.
    """
    plain = (data > 0x20) & (data < 0x7F)
    lead = (data >= 0xC3) & ((data <= 0xE0) | (data >= 0xE4))
    size = 1 + (data >= 0xC0).astype(np.int8) + (data >= 0xE0) + (data >= 0xF0)
    for width in (2, 3, 4):
        at = np.flatnonzero(lead & (size == width)) + width - 1
        plain[at[at < len(plain)]] = True
    return plain


class ShardWriter:
    """Documents one after the other to shards of whole documents."""

    def __init__(self, part: int, alphabet: int, kind: pa.DataType):
        self.part, self.alphabet, self.kind = part, alphabet, kind
        self.number = self.before = self.held = 0
        self.doc_ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Documents with all their ids; yields every shard that is full."""
        ends = np.cumsum(counts)
        row = at = 0
        while row < len(counts):
            room = SHARD_TOKENS - self.held
            stop = int(np.searchsorted(ends, at + room, "right"))
            if stop == row and not self.held:
                stop = row + 1
            if stop > row:
                end = int(ends[stop - 1])
                self.doc_ids.append(doc_ids.slice(row, stop - row))
                self.lengths.append(counts[row:stop])
                self.ids.append(ids[at:end])
                self.held += end - at
                row, at = stop, end
            if row < len(counts) or self.held >= SHARD_TOKENS:
                yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if not self.lengths:
            return
        doc_ids = pa.concat_arrays(self.doc_ids)
        lengths, ids = np.concatenate(self.lengths), np.concatenate(self.ids)
        blocks = [ids[k : k + SHARD_TOKENS] for k in range(0, len(ids), SHARD_TOKENS)]
        packed = b"".join(pair_grammar.to_bytes(pair_grammar.compress(b, self.alphabet)) for b in blocks)
        n = pa.array([0, len(lengths)], pa.int32())
        columns = [
            pa.array([self.part], pa.int32()),
            pa.array([self.number], pa.int64()),
            pa.array([self.before], pa.int64()),
            pa.array([len(ids)], pa.int64()),
            pa.array([len(lengths)], pa.int64()),
            pa.ListArray.from_arrays(n, doc_ids),
            pa.ListArray.from_arrays(n, pa.array(lengths, pa.int64())),
            pa.array([packed], pa.binary()),
        ]
        names = ["part", "number", "before", "n_tokens", "documents", "doc_ids", "lengths", "blocks"]
        yield pa.RecordBatch.from_arrays(columns, names)
        self.number += 1
        self.before += len(ids)
        self.held, self.doc_ids, self.lengths, self.ids = 0, [], [], []


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids with the end id after them."""
    out = np.full(len(ids) + len(counts), end, np.int32)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(counts + 1) - 1] = False
    out[inside] = ids
    return out, counts + 1


def token_shards(docs: DataFrame, tokenizer: str | Path, end: int = END) -> DataFrame:
    """The rows of the file format: documents in ascending doc_id order, cut into shards.

    `tokenizer` is the path of a file of the tokenizers library; the driver reads it and sends it to the tasks.
    """
    rules = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    narrow = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))
    dealt = narrow.withColumn("n", F.monotonically_increasing_id()).repartitionByRange("doc_id", "h", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = writer = None
        for batch in batches:
            if encoder is None:
                encoder = Encoder(rules.value)
                alphabet = max(encoder.alphabet, end + 1)
                writer = ShardWriter(TaskContext.get().partitionId(), alphabet, batch.column("doc_id").type)
            for row, ids, counts in encoder.of(batch.column("text")):
                yield from writer.add(batch.column("doc_id").slice(row, len(counts)), *with_end(ids, counts, end))
        if writer is not None:
            yield from writer.close()

    schema = (
        f"part int, number long, before long, n_tokens long, documents long, doc_ids array<{kind}>, lengths array<long>, "
        "blocks binary"
    )
    ordered = dealt.sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return ordered.mapInArrow(run, schema)


def write_tokens(docs: DataFrame, tokenizer: str | Path, path: str | None = None, end: int = END) -> str:
    """Write the shards to a folder (by default a new one in the shared folder) and return it."""
    path = path or f"{shared_folder(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    token_shards(docs, tokenizer, end).write.parquet(path)
    return path


def decoded(blocks: bytes) -> np.ndarray:
    """All ids of a shard."""
    parts, at = [], 0
    while at < len(blocks):
        grammar, at = pair_grammar.from_bytes(blocks, at)
        parts.append(grammar.ids())
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decoded_range(blocks: bytes, first: int, end: int) -> np.ndarray:
    """The ids of a shard from place `first` up to `end`; only the symbols that cover them are expanded."""
    parts, at, before = [np.zeros(0, np.uint32)], 0, 0
    while at < len(blocks) and before < end:
        grammar, at = pair_grammar.from_bytes(blocks, at)
        parts.append(grammar.ids(first - before, end - before))
        before += int(grammar.lengths(grammar.sequence).sum())
    return np.concatenate(parts)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, part, place (ids of the part before the document) and ids of every document."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, lengths, ids in _opened(batches):
            ends = np.cumsum(lengths)
            lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, ends]), pa.array(ids.astype(np.int64)))
            yield _rows(batch, k, lengths, [lists.cast(pa.list_(pa.int64()))], ["ids"])

    return shards.mapInArrow(run, f"doc_id {kind}, part int, place long, ids array<long>")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            lengths = batch.column("lengths")[k].values.to_numpy()
            yield batch, k, lengths, decoded(batch.column("blocks")[k].as_py())


def _rows(batch: pa.RecordBatch, k: int, lengths: np.ndarray, more: list, names: list[str]) -> pa.RecordBatch:
    place = batch.column("before")[k].as_py() + np.cumsum(lengths) - lengths
    part = pa.array(np.full(len(lengths), batch.column("part")[k].as_py(), np.int32))
    columns = [batch.column("doc_ids")[k].values, part, pa.array(place), *more]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "place", *names])


def token_report(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from its shards."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, lengths, ids in _opened(batches):
            data = memoryview(ids.astype("<u4")).cast("B")
            ends = (4 * np.cumsum(lengths)).tolist()
            sums = [zlib.crc32(data[a:b]) for a, b in zip([0, *ends], ends)]
            yield _rows(batch, k, lengths, [pa.array(lengths), pa.array(sums, pa.int64())], ["n_tokens", "ids_crc32"])

    found = shards.mapInArrow(run, f"doc_id {kind}, part int, place long, {DIGESTS}")
    starts = part_starts(shards)
    return found.join(starts, "part").select(
        "doc_id", (F.col("part_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )


def part_starts(shards: DataFrame) -> DataFrame:
    """(part, part_start): the ids of all parts before it. One row per task that wrote shards."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("all", F.lit(0))
    return running_offset(totals, "all", "part", F.col("n"), "part_start", width=4_096).select("part", "part_start")


def lookup(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the documents named in `wanted` (doc_id): only their places are decoded.

    The lists of doc_ids, not the blocks, meet the wanted ids; a shard with a hit is opened once.
    """
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    spots = shards.select("part", "number", F.posexplode("doc_ids").alias("row", "doc_id"))
    hits = spots.join(wanted.select("doc_id").distinct(), "doc_id").groupBy("part", "number").agg(
        F.sort_array(F.collect_list("row")).alias("hits")
    )
    opened = shards.join(hits, ["part", "number"]).select("doc_ids", "lengths", "blocks", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = batch.column("hits")[k].values
                ends = np.cumsum(batch.column("lengths")[k].values.to_numpy())
                blocks = batch.column("blocks")[k].as_py()
                found = [
                    decoded_range(blocks, int(ends[r - 1]) if r else 0, int(ends[r])).astype(np.int64)
                    for r in rows.to_numpy().tolist()
                ]
                columns = [batch.column("doc_ids")[k].values.take(rows), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids"])

    return opened.mapInArrow(run, f"doc_id {kind}, ids array<long>")
