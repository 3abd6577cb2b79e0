"""Numpy primitives over the UTF-8 bytes of Arrow string batches.

Texts of a batch lie behind each other in one byte buffer. All loops run over
tiles of at most ``TILE`` bytes (longer only for one over-long word), so memory
is bounded whatever the length of a text. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

TILE = 1 << 18
U = np.uint64
_BASE = 0x5851F42D4C957F2D
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse mod 2**64, grown on demand."""

    def __init__(self) -> None:
        self.n = 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, TILE + 4096)
            self.up, self.down = _powers(_BASE, self.n), _powers(pow(_BASE, -1, 1 << 64), self.n)
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the 64-bit finaliser of a public hash)."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated bytes of a string array and the offsets of its rows (int64, one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums P of byte * base**i; the polynomial hash of [s, e) is (P[e] - P[s]) * down[s]."""
    up, down = POWERS.get(len(data) + 1)
    p = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=p[1:])
    return p, down


def word_tiles(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts [0, len) into tiles that end at a text's end or right after white space."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + TILE)
        if end < n:
            own = offsets[np.searchsorted(offsets, end, "right") - 1]
            gaps = np.flatnonzero(SPACE[data[max(at, own) : end]])
            if len(gaps):
                end = max(at, own) + int(gaps[-1]) + 1
            elif own > at:
                end = int(own)
            else:  # one word longer than a tile: up to its end
                stop = int(offsets[np.searchsorted(offsets, end, "right")])
                while end < stop:
                    gaps = np.flatnonzero(SPACE[data[end : min(stop, end + TILE)]])
                    if len(gaps):
                        end += int(gaps[0]) + 1
                        break
                    end = min(stop, end + TILE)
        yield at, end
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all white-space separated words, A-Z lower-cased, and each row's number of words."""
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for a, b in word_tiles(data, offsets):
        part = data[a:b]
        word = ~SPACE[part]
        cut = offsets[np.searchsorted(offsets, a, "left") : np.searchsorted(offsets, b, "left")] - a
        start = word.copy()
        start[1:] &= ~word[:-1]
        if len(cut):
            start[cut] = word[cut]
        stop = word.copy()
        stop[:-1] &= ~word[1:]
        if len(cut := cut[cut > 0]):
            stop[cut - 1] = word[cut - 1]
        s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
        p, down = prefix_hash(LOWER[part])
        h = (p[e] - p[s]) * down[s]
        hashes.append(mix(h ^ ((e - s).astype(U) << U(56))))
        rows = np.searchsorted(offsets, s + a, "right") - 1
        if len(rows):
            first, last = rows[0], rows[-1]
            counts[first : last + 1] += np.bincount(rows - first, minlength=last - first + 1)
    return (np.concatenate(hashes) if hashes else np.empty(0, U)), counts


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by doubling: len(x) - w + 1 values."""
    n, have = len(x) - w + 1, 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[w - have : w - have + n]) if have < w else x[:n]


def release() -> None:
    """Hands freed memory back to the system, as workers stay for later tasks (where the C library can do that)."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``f`` for groups of rows, with release() after large ones."""

    @functools.wraps(f)
    def run(table: pa.Table) -> pa.Table:
        try:
            return f(table)
        finally:
            if table.nbytes > 1 << 20:
                release()

    return run
