"""Numpy kernels over the UTF-8 bytes of Arrow text columns.

Words are runs of bytes other than space, tab, LF, VT, FF and CR. A word's hash
is a difference of prefix sums of keyed byte values times powers of an odd
constant (mod 2**64), so all words of a chunk are hashed without a Python loop.
A to Z hash as a to z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _byte_values(fold: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P)) | np.uint64(1)
    if fold:
        values[65:91] = values[97:123]
    return values


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """1, p, p**2 ... and their inverses."""
    both = []
    for base in (_P, _P_INVERSE):
        row = np.full(n, base, np.uint64)
        row[:1] = 1
        both.append(np.cumprod(row))
    return both[0], both[1]


class Powers:
    """Grows to the longest chunk that was seen."""

    def __init__(self) -> None:
        self.up, self.down = powers(0)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = powers(max(n, CHUNK_BYTES + CHUNK_BYTES // 2))
        return self.up[:n], self.down[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets into them; null is empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def chunks(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text is a range of its own."""
    first, rows = 0, len(at) - 1
    while first < rows:
        last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        last = min(rows, max(first + 1, last))
        yield first, last
        first = last


class Words:
    """The words of rows first..last-1: row, start, end (in the chunk's bytes) and hash of each."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, first: int, last: int, tables: Powers, fold: bool = True, separator: np.ndarray = SEPARATOR) -> None:
        self.bytes = raw[at[first] : at[last]]
        self.at = at[first : last + 1] - at[first]
        self.rows = last - first
        n = len(self.bytes)
        gap = np.ones(n + 1, bool)
        gap[:n] = separator[self.bytes]
        begin = ~gap[:n]
        begin[1:] &= gap[: n - 1]
        end = ~gap[:n] & gap[1:]
        cut = self.at[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        begin[cut] |= ~gap[cut]
        end[cut - 1] |= ~gap[cut - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.row = np.searchsorted(self.at, self.start, side="right") - 1
        self.per_row = np.bincount(self.row, minlength=self.rows)
        self._tables, self._fold = tables, fold

    def hashes(self) -> np.ndarray:
        up, down = self._tables.get(max(1, len(self.bytes)))
        total = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum(_byte_values(self._fold)[self.bytes] * up[: len(self.bytes)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def windows(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words of a row, and each run's first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(row[:n] == row[size - 1 :])
    total, factor = np.zeros(len(first), np.uint64), 1
    for j in range(size):
        total += hashes[first + j] * np.uint64(factor)
        factor = factor * _P % (1 << 64)
    return mix(total), first
