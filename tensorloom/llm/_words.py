"""Vectorised word splitting and hashing over Arrow string columns.

Everything here works on one Arrow batch at a time: the concatenated UTF-8
buffer is treated as one byte array, so no Python loop touches a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MASK = (1 << 64) - 1

#: ASCII white space: words are runs of anything else.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Every ASCII character that is not a letter or a digit.
NON_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def lower_table() -> np.ndarray:
    """Byte map that lower-cases A-Z and leaves all other bytes alone."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


_LOWER = lower_table()


def delimiter_mask(delimiters: bytes) -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    mask[np.frombuffer(delimiters, dtype=np.uint8)] = True
    return mask


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _byte_values() -> np.ndarray:
    return mix((np.arange(256, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15))


_VALUES = _byte_values()
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base & _MASK, dtype=U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, bytes and validity of a string column; a null has no bytes."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8), np.zeros(n, bool)
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    valid = ~np.asarray(column.is_null())
    return offs - offs[0], raw, valid


class Words:
    """Words of a string column.

    ``start`` and ``end`` are byte places of each word in ``data`` (the lower-cased
    bytes), ``first`` has for each row the number of its first word, with one entry
    more at the end. Nulls and empty texts have no words.
    """

    __slots__ = ("data", "end", "first", "offsets", "start", "valid")

    def __init__(self, column: pa.Array, delimiters: bytes = SPACES):
        self.offsets, raw, self.valid = buffers(column)
        self.data = _LOWER[raw]
        inside = ~delimiter_mask(delimiters)[self.data]
        # A word never spans two rows: rows that touch are cut at their border.
        n = len(inside)
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        starts[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """One well-mixed 64-bit hash per word."""
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 19) -> np.ndarray:
    """Polynomial hash of data[start:end] for sorted, disjoint spans, by prefix sums."""
    out = np.empty(len(start), U64)
    at = 0
    while at < len(start):
        base = start[at]
        upto = max(at + 1, int(np.searchsorted(end, base + block, side="right")))
        stop = end[upto - 1]
        up, down = _power_tables(int(stop - base) + 1)
        sums = np.zeros(stop - base + 1, U64)
        np.cumsum(_VALUES[data[base:stop]] * up[:-1], out=sums[1:])
        s, e = start[at:upto] - base, end[at:upto] - base
        out[at:upto] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        at = upto
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes; entry i starts at word i."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out = out * U64(0xD1342543DE82EF95) + words[j : j + n]
    return mix(out)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """As gram_hashes, by prefix sums: its cost does not depend on k."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = _power_tables(len(words) + 1)
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[:-1], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n])
