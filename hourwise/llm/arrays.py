"""Texts of an Arrow batch as NumPy arrays: words, hashes and segment sums without a Python loop over words.

A word is a run of bytes other than 0x20 and 0x09-0x0D; none of these bytes occurs inside a multi-byte UTF-8
character, so byte positions can be used throughout. Batches are cut into pieces of about ``PIECE`` bytes (one
longer text makes a piece of its own), which bounds the size of the arrays.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A"): ord("Z") + 1] += 32
#: One random 64-bit value for each byte, so that word hashes don't follow the byte values.
BYTE = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=U64)
FOLDED_BYTE = BYTE[FOLD]

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE + 1024)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 4 * PIECE:
            _powers[base] = have
    return have[:n]


def lean(run: Callable) -> Callable:
    """``run`` for ``mapInArrow`` or ``mapInPandas``; when a task has ended, its worker, which Spark keeps for others, gives
    free memory back to the system."""

    @wraps(run)
    def ended(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return ended


def lean_group(run: Callable) -> Callable:
    """``run`` for ``applyInPandas`` over large groups; free memory goes back to the system after each of them."""

    @wraps(run)
    def ended(group):
        out = run(group)
        _give_back()
        return out

    return ended


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without it


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash (fixed multipliers of splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@dataclass
class Piece:
    """Consecutive rows ``lo:hi`` of a batch; ``off`` are the byte offsets of their texts in ``buf``."""

    lo: int
    hi: int
    buf: np.ndarray
    off: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def text_bytes(self, row: int) -> bytes:
        return self.buf[self.off[row]: self.off[row + 1]].tobytes()


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a NULL is an empty text."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + n + 1] if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[Piece]:
    buf, off = texts(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield Piece(lo, hi, buf[off[lo]: off[hi]], off[lo: hi + 1] - off[lo])
        lo = hi


@dataclass
class Words:
    """Words of a piece: byte positions ``start:end``, and ``first`` (rows + 1) the first word of each row."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def words(p: Piece) -> Words:
    return runs(BLANK[p.buf], p.off)


def runs(blank: np.ndarray, off: np.ndarray) -> Words:
    """Runs of positions that aren't ``blank``; a row's edge (``off``) ends a run too."""
    n = len(blank)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(off), np.int64))
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = blank[:-1]
    start = np.flatnonzero(~blank & (before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = blank[1:]
    end = np.flatnonzero(~blank & (after | edge[1:])) + 1
    return Words(start, end, np.searchsorted(start, off))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = BYTE) -> np.ndarray:
    """64-bit hash of each ``buf[start:end]``: differences of one running polynomial sum."""
    n = len(buf)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(values[buf] * _power(_BASE, n), out=total[1:])
    h = (total[end] - total[start]) * _power(_INVERSE, n + 1)[start]
    return mix(h ^ ((end - start).astype(U64) * U64(0xD6E8FEB86659FD93)))


_STEP = [int(x) | 1 for x in np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=U64)]


def windows(h: np.ndarray, first: np.ndarray, k: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` consecutive words, and their first positions by row.

    ``whole``: a row of 1 to k-1 words gives one window, its whole sequence. Windows never cross rows.
    """
    n, count = len(h), np.diff(first)
    made = np.maximum(count - k + 1, 0)
    if whole:
        made = np.where((count > 0) & (made == 0), 1, made)
    begin = np.zeros(len(made) + 1, dtype=np.int64)
    np.cumsum(made, out=begin[1:])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], made)  # the first word of each window
    size = np.repeat(np.minimum(count, k), made)
    out = size.astype(U64) * U64(0xA0761D6478BD642F)
    for i in range(k):
        if whole:
            out = out + np.where(i < size, h[np.minimum(at + i, n - 1)], U64(0)) * U64(_STEP[i]) if n else out
        else:
            out = out + h[at + i] * U64(_STEP[i])
    return mix(out), begin


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` by row, where row r holds ``first[r]:first[r + 1]`` (empty rows: 0)."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
