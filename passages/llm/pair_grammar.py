"""Re-Pair grammars of id sequences: frequent pairs become nonterminals, round by round.

In a round every pair of neighbours is counted; where pairs overlap, the more frequent one goes first (a
run of one symbol is paired from its left). Pairs replaced LEAST times or more become
rules, and the next round counts the shorter sequence. Frequent pairs go before rare ones: a round takes pairs down to a
sixteenth of the most frequent one. The rounds end when no pair is found LEAST times, or when one that takes all
such pairs brings little. A rule stores
its two symbols and the length of its expansion, so any range of ids is read by expanding only the
symbols that cover it.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from passages.llm.text_arrays import numbers

#: A pair becomes a rule from this number of replacements on: below, a rule is longer than what it saves.
LEAST = 8
#: A round takes pairs down to this part of the most frequent one, and after a round of little gain this much further.
SPREAD = 16
#: A round that shortens the sequence by less than this part brings little.
GAIN = 1 / 64
CELL_BITS = 18
MAGIC = b"RPG1"
HEAD = "<4sIIII"


@dataclass
class Grammar:
    """Symbols below `alphabet` are ids; symbol alphabet + k is rule k, the pair (left[k], right[k])."""

    alphabet: int
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    sequence: np.ndarray

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        if not len(self.length):
            return np.ones(len(symbols), np.int64)
        rule = symbols >= self.alphabet
        return np.where(rule, self.length[np.where(rule, symbols - self.alphabet, 0)], 1).astype(np.int64)

    def opened(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of the symbols: rules are opened turn by turn until none is left."""
        while True:
            rule = symbols >= self.alphabet
            if not rule.any():
                return symbols
            width = rule.astype(np.int64) + 1
            at = np.cumsum(width) - width
            out = np.empty(int(at[-1] + width[-1]), symbols.dtype)
            out[at] = np.where(rule, self.left[np.where(rule, symbols - self.alphabet, 0)], symbols)
            out[at[rule] + 1] = self.right[symbols[rule] - self.alphabet]
            symbols = out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The same by one copy from the expansions of all rules, where these are shorter than the result."""
        size = self.lengths(symbols)
        total = int(size.sum())
        if int(self.length.sum()) > total:
            return self.opened(symbols)
        whole = np.empty(2 * len(self.left), np.uint32)
        whole[::2], whole[1::2] = self.left, self.right
        table = np.r_[self.opened(whole), symbols]
        starts = np.cumsum(self.length, dtype=np.int64) - self.length
        rule = symbols >= self.alphabet
        own = len(table) - len(symbols) + np.arange(len(symbols))
        first = np.where(rule, starts[np.where(rule, symbols - self.alphabet, 0)], own) if len(starts) else own
        return table[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total)]

    def ids(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from place `first` up to `end`, without expanding what lies outside."""
        if first == 0 and end is None:
            return self.expand(self.sequence)
        ends = np.cumsum(self.lengths(self.sequence))
        total = int(ends[-1]) if len(ends) else 0
        first, end = max(first, 0), total if end is None else min(end, total)
        if first >= end:
            return self.sequence[:0]
        a, b = np.searchsorted(ends, [first, end - 1], "right")
        before = int(ends[a - 1]) if a else 0
        return self.expand(self.sequence[a : b + 1])[first - before : end - before]


def _chosen(counts: np.ndarray, least: int) -> np.ndarray:
    """Places of pairs that no more frequent pair overlaps; in a run of equally frequent ones every second one."""
    starts = np.r_[0, np.flatnonzero(counts[1:] != counts[:-1]) + 1]
    level = counts[starts]
    top = level >= least
    rising = level[1:] > level[:-1]
    top[1:] &= rising
    top[:-1] &= ~rising
    size = np.diff(np.r_[starts, len(counts)])[top]
    starts = starts[top]
    if not (size > 1).any():
        return starts
    many = (size + 1) // 2
    first = np.cumsum(many) - many
    return np.repeat(starts - 2 * first, many) + 2 * np.arange(int(many.sum()))


def compress(ids: np.ndarray, alphabet: int, least: int = LEAST) -> Grammar:
    """The grammar of a sequence of ids below `alphabet`.

    Pairs are counted in a table of 2^CELL_BITS cells. Two pairs in one cell count together there, but only one
    of them is replaced, by its own number of places; the next round has other cells.
    """
    sequence = np.array(ids, np.uint32)
    lefts, rights = [], []
    length = np.zeros(0, np.int64)
    made, spread = 0, SPREAD
    factors = numbers(128, 11).astype(np.uint32) | np.uint32(1)
    first_of = np.empty(1 << CELL_BITS, np.int64)
    turn = 0
    while len(sequence) > 1:
        a, b = factors[2 * (turn % 64) : 2 * (turn % 64) + 2]
        turn += 1
        cell = (sequence[:-1] * a + sequence[1:] * b) * factors[-1] >> np.uint32(32 - CELL_BITS)
        counts = np.bincount(cell, minlength=1 << CELL_BITS).astype(np.int32)[cell]
        most = int(counts.max())
        if most < least:
            break
        floor = max(least, most // spread)
        at = _chosen(counts, floor)
        cell = cell[at]
        first_of[cell] = at
        same = first_of[cell]
        equal = (sequence[at] == sequence[same]) & (sequence[at + 1] == sequence[same + 1])
        at, cell = at[equal], cell[equal]
        times = np.bincount(cell, minlength=1 << CELL_BITS)
        cells = np.flatnonzero(times >= max(least, floor // 2))
        before = len(sequence)
        shown = first_of[cells]
        left, right = sequence[shown], sequence[shown + 1]
        number = np.zeros(1 << CELL_BITS, np.uint32)
        number[cells] = alphabet + made + np.arange(len(cells))
        new = number[cell]
        at, new = at[new > 0], new[new > 0]
        sequence[at] = new
        keep = np.ones(len(sequence), bool)
        keep[at + 1] = False
        sequence = sequence[keep]
        sizes = np.r_[length, 1]
        length = np.r_[length, sum(sizes[np.where(s >= alphabet, s - alphabet, made).astype(np.int64)] for s in (left, right))]
        lefts.append(left)
        rights.append(right)
        made += len(left)
        if before - len(sequence) < GAIN * before:
            if floor == least:
                break
            spread *= SPREAD
    none = np.zeros(0, np.uint32)
    return Grammar(alphabet, np.concatenate([none, *lefts]), np.concatenate([none, *rights]), length.astype(np.uint32), sequence)


def _put(values: np.ndarray, wide: bool) -> bytes:
    """Numbers as their low 16 bits and, where a number is larger, their high 16 bits after them."""
    low = values.astype("<u2").tobytes()
    return low + (values >> 16).astype("<u2").tobytes() if wide else low


def _take(data: memoryview, at: int, n: int, wide: bool) -> tuple[np.ndarray, int]:
    low = np.frombuffer(data, "<u2", n, at).astype(np.uint32)
    if wide:
        low |= np.frombuffer(data, "<u2", n, at + 2 * n).astype(np.uint32) << 16
    return low, at + (4 if wide else 2) * n


def to_bytes(grammar: Grammar) -> bytes:
    """MAGIC, alphabet, rules, symbols, a flag for symbols above 16 bits; left and right symbols, expansion
    lengths (32 bits) and the sequence, all little-endian."""
    wide = grammar.alphabet + len(grammar.left) > 1 << 16
    head = struct.pack(HEAD, MAGIC, grammar.alphabet, len(grammar.left), len(grammar.sequence), wide)
    parts = [_put(x, wide) for x in (grammar.left, grammar.right)]
    return b"".join([head, *parts, grammar.length.astype("<u4").tobytes(), _put(grammar.sequence, wide)])


def from_bytes(data: bytes, at: int = 0) -> tuple[Grammar, int]:
    """The grammar that begins at a place, and the place after it."""
    magic, alphabet, rules, symbols, wide = struct.unpack_from(HEAD, data, at)
    if magic != MAGIC:
        raise ValueError("not a block of a token file")
    view = memoryview(data)
    left, at = _take(view, at + struct.calcsize(HEAD), rules, bool(wide))
    right, at = _take(view, at, rules, bool(wide))
    length = np.frombuffer(view, "<u4", rules, at)
    sequence, at = _take(view, at + 4 * rules, symbols, bool(wide))
    return Grammar(alphabet, left, right, length, sequence), at
