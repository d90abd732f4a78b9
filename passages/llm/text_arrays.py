"""Words, lines and rolling hashes of many texts at once, as numpy arrays.

A text column arrives as one UTF-8 buffer with offsets. The functions here work on that buffer
in slices of about SLICE_BYTES, so that memory follows the slice and not the batch; a text
longer than that makes a slice of its own. White space is the six ASCII characters
x20 and x09 to x0D, upper case is A to Z: neither occurs inside a longer UTF-8 sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ROOT = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(ROOT))


class Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, grown as texts need them."""

    def __init__(self, seed: int):
        self.base = int(numbers(1, seed)[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, SLICE_BYTES)
            self.up, self.down = (
                np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)])
                for b in (self.base, self.inverse)
            )


class Hasher:
    """Hashes of substrings of a buffer: sum of value[byte] * base^position, shifted to start 0."""

    def __init__(self, seed: int = 1, fold: np.ndarray | None = None):
        self.values = numbers(256, seed)
        if fold is not None:
            self.values = self.values[fold]
        self.powers = Powers(seed)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.powers.reach(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers.up[: len(data)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.powers.down[start]

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """The hash at every position from which `width` bytes are left."""
        n = len(prefix) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return (prefix[width:] - prefix[:n]) * self.powers.down[:n]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets in bytes) of consecutive rows; a null is empty."""
    column = column.fill_null("")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        column.offset : column.offset + len(column) + 1
    ].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    # Workers live on between tasks: what the batches before this one took goes back.
    pa.default_memory_pool().release_unused()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each text (and in all)."""
    inside = ~SPACE[data]
    return runs(inside, offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes that stay inside a text."""
    first = inside.copy()
    last = inside.copy()
    if len(inside):
        fresh = ~inside[:-1]
        borders = offsets[1:-1]
        borders = borders[(borders > 0) & (borders < len(inside))]
        begin = np.r_[True, fresh]
        begin[borders] = True
        stop = np.r_[~inside[1:], True]
        stop[borders - 1] = True
        first &= begin
        last &= stop
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def count_of(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marked bytes each text has."""
    before = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=before[1:])
    return before[offsets[1:]] - before[offsets[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each character."""
    return (data & 0xC0) != 0x80


def grams(words: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` words in a row, text by text, and the number of them before each text.

    A text with fewer words, but at least one, has one gram: all its words.
    """
    counts = np.diff(before)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    starts = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=starts[1:])
    at = np.repeat(before[:-1] - starts[:-1], n) + np.arange(starts[-1])
    length = np.repeat(np.minimum(counts, width), n)
    factors = numbers(width, 77) | np.uint64(1)
    mixed = mix(words)
    total = length.astype(np.uint64) * np.uint64(ROOT)
    for k in range(width):
        if len(at):
            total += np.where(k < length, mixed[np.minimum(at + k, len(mixed) - 1)], np.uint64(0)) * factors[k]
    return mix(total), starts
