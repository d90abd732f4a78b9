"""Words of text columns, cut on the bytes of a whole Arrow array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# ASCII letters in lower case and digits; everything else parts words.
WORD_BYTES = np.full(256, 0x20, np.uint8)
for _first, _last in ((48, 58), (97, 123)):
    WORD_BYTES[_first:_last] = np.arange(_first, _last)
WORD_BYTES[65:91] = np.arange(97, 123)

# The same, for texts whose other characters are all letters and digits.
ANY_SCRIPT = WORD_BYTES.copy()
ANY_SCRIPT[128:] = np.arange(128, 256)

#: Bytes of text that are cut at a time.
CUT_BYTES = 4 << 20


def cut_words(column: pa.Array, letter: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The document of every word of a text column without nulls, and the words."""
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    letters = letter[data[offsets[0] : offsets[-1]]]
    offsets = offsets.astype(np.int64) - offsets[0]
    inside = letters != 0x20
    before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
    filled = np.diff(offsets) > 0
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    bounds = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    words = pa.Array.from_buffers(
        pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(letters[inside]))]
    )
    return np.searchsorted(offsets, starts, "right") - 1, words.dictionary_encode()


def parts_of(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, end) of stretches of a text column of some CUT_BYTES; a longer text is one of its own."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(column):
        before = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + CUT_BYTES, "right")))
        yield first, end
        first = end
