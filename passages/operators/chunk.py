"""Cutting documents into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.functions.keys import chunk_id
from passages.functions.vectors import bind
from passages.operators.order import running_offset

# Separators of the recursive splitter, tried in this order.
SEPARATORS = ("\n\n", "\n", " ", "")

# Characters of chunks that a task holds before it hands them on.
HELD_CHARACTERS = 1_000_000


def _check(size: int, overlap: int) -> int:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"need 0 <= overlap < size, got size={size} overlap={overlap}")
    return size - overlap


def fixed_chunk_count(text: Column, size: int = 1000, overlap: int = 50) -> Column:
    """How many chunks `chunk_fixed` makes of a text, from its length alone."""
    step = _check(size, overlap)
    return F.ceil(F.length(text) / step)


def _windows(text: Column, size: int, overlap: int) -> Column:
    # Pieces of `step` characters in one pass over the text, then each piece is completed
    # from the following ones; substring(text, offset) would rescan the text for each chunk.
    step = _check(size, overlap)
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    if overlap == 0:
        return cut
    reach = -(-overlap // step)

    def complete(piece: Column, tail: Column) -> Column:
        return F.concat(piece, F.substring(tail, 1, overlap))

    def tails(pieces: Column) -> Column:
        if reach == 1:
            return F.concat(F.slice(pieces, F.lit(2), F.size(pieces)), F.array(F.lit("")))
        return F.transform(
            pieces, lambda _, i: F.array_join(F.slice(pieces, i + 2, F.lit(reach)), "")
        )

    return bind(cut, lambda pieces: F.zip_with(pieces, tails(pieces), complete))


def chunk_fixed(
    docs: DataFrame, size: int = 1000, overlap: int = 50, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Windows of `size` characters, each starting size - overlap after the one before.

    A tail that lies wholly in the previous window is still a chunk of its own. Documents
    without text give no rows. `keep` names document columns to carry along.
    """
    return (
        docs.where(F.length("text") > 0)
        .select(
            "doc_id",
            "source",
            *keep,
            F.posexplode(_windows(F.col("text"), size, overlap)).alias("chunk_no", "text"),
        )
    )


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    key = chunk_id(F.col("source"), F.col("doc_id"), F.col("chunk_no"), F.col("text"))
    return chunks.withColumn("chunk_id", key)


def _cuts(text: str, start: int, end: int, separator: str) -> list[int]:
    """Boundaries of the pieces of text[start:end]; a separator opens the next piece."""
    if separator == "":
        return list(range(start, end + 1))
    cuts = [start]
    at = text.find(separator, start, end)
    while at >= 0:
        if at > start:
            cuts.append(at)
        at = text.find(separator, at + len(separator), end)
    cuts.append(end)
    return cuts


def _pack(cuts: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Join neighbouring pieces up to `size`, the next span keeping up to `overlap` of the last."""
    left = 0
    for right in range(1, len(cuts)):
        if cuts[right] - cuts[left] > size:
            if left < right - 1:
                yield cuts[left], cuts[right - 1]
            while left < right - 1 and (
                cuts[right - 1] - cuts[left] > overlap or cuts[right] - cuts[left] > size
            ):
                left += 1
    if left < len(cuts) - 1:
        yield cuts[left], cuts[-1]


def _spans(
    text: str, start: int, end: int, separators: tuple[str, ...], size: int, overlap: int
) -> Iterator[tuple[int, int]]:
    level = next(i for i, s in enumerate(separators) if text.find(s, start, end) >= 0)
    finer = separators[level + 1 :]
    cuts = _cuts(text, start, end, separators[level])
    run = [cuts[0]]
    for a, b in zip(cuts, cuts[1:]):
        if b - a < size or not finer:
            run.append(b)
            continue
        yield from _pack(run, size, overlap)
        yield from _spans(text, a, b, finer, size, overlap)
        run = [b]
    yield from _pack(run, size, overlap)


def split_recursive(text: str | None, size: int, overlap: int) -> list[str]:
    """Chunks of one text: blank lines first, then lines, then words, then characters."""
    if not text:
        return []
    found = (text[a:b].strip() for a, b in _spans(text, 0, len(text), SEPARATORS, size, overlap))
    return [chunk for chunk in found if chunk]


def chunk_recursive(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks that end at a paragraph, line or word where one is near enough.

    The cut of a text depends on all cuts before it, so it runs as a small helper over Arrow
    batches; each document is independent and nothing is shuffled.
    """
    _check(size, overlap)

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "source")}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, number, found, held = [], [], [], 0
            for row, text in enumerate(batch.column("text")):
                cut = split_recursive(text.as_py(), size, overlap)
                owner += [row] * len(cut)
                number += range(len(cut))
                found += cut
                held += sum(map(len, cut))
                # Handed on after every few texts, so that a task holds no more of them than it was given.
                if held >= HELD_CHARACTERS or row == batch.num_rows - 1:
                    named = [batch.column(c).take(pa.array(owner, pa.int64())) for c in kinds]
                    columns = [*named, pa.array(number, pa.int32()), pa.array(found, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, [*kinds, "chunk_no", "text"])
                    owner, number, found, held = [], [], [], 0

    named = ", ".join(f"{c} {kind}" for c, kind in kinds.items())
    texts = docs.where(F.length("text") > 0).select(*kinds, "text")
    return texts.mapInArrow(split, f"{named}, chunk_no int, text string")


def chunk_pages(pages: DataFrame, size: int = 1000, overlap: int = 50) -> DataFrame:
    """Fixed chunks of the concatenated pages of each document, without building that text.

    A running page offset tells each page which windows it takes part in; a page gives one
    fragment per window and the fragments of one window are joined. No group is larger than
    one chunk, however many pages a document has.
    """
    step = _check(size, overlap)
    placed = running_offset(
        pages.where(F.length("text") > 0), "doc_id", "page_no", F.length("text"), "_from"
    ).withColumn("_to", F.col("_from") + F.length("text"))
    first = F.greatest(F.lit(0), F.floor((F.col("_from") - size) / step) + 1)
    last = F.floor((F.col("_to") - 1) / step)
    fragments = placed.select(
        "doc_id", "page_no", "text", "_from", F.explode(F.sequence(first, last)).alias("chunk_no")
    )
    window_from = F.col("chunk_no") * step
    inside_from = F.greatest(window_from - F.col("_from"), F.lit(0))
    inside_to = window_from + size - F.col("_from")
    part = F.substring("text", (inside_from + 1).cast("int"), (inside_to - inside_from).cast("int"))
    joined = F.array_sort(F.collect_list(F.struct("page_no", F.col("part"))))
    return (
        fragments.withColumn("part", part)
        .groupBy("doc_id", F.col("chunk_no").cast("int").alias("chunk_no"))
        .agg(F.array_join(F.transform(joined, lambda x: x["part"]), "").alias("text"))
    )
