"""Vectorised text kernels: many texts are one byte buffer, words and lines are index arrays into it.

Used inside Arrow UDFs.  A batch is worked off in slices of about half a megabyte, so the arrays stay
in the cache and memory is bounded by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
SLICE = 1 << 19


def table_of(characters: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(characters)] = True
    return flags


BLANK = table_of(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(data: np.ndarray, at: np.ndarray, limit: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole texts in order, about ``limit`` bytes at a time."""
    begin, n = 0, len(at) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, "right")) - 1)
        end = min(end, n)
        yield data[at[begin] : at[end]], at[begin : end + 1] - at[begin]
        begin = end


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(size, BASE, U64), np.full(size, inverse, U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by one running polynomial over the buffer."""
    size = 1 << max(19, int(len(data) + 1).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + U64(BASE))


def owners(at: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The text that each byte position belongs to."""
    return np.searchsorted(at, positions, "right") - 1


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; a word ends with its text."""
    return runs(~BLANK[data], at)


def runs(solid: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of flagged bytes; a run ends with its text."""
    if not len(solid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(solid) + 1, bool)
    first[at] = True
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1] | first[1:-1]
    closes[:-1] &= ~solid[1:] | first[1:-1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each \\n-split line, empty ones included."""
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([at[:-1], breaks + 1])
    of = np.concatenate([np.arange(len(at) - 1), owners(at, breaks)])
    order = np.lexsort((starts, of))
    starts, of = starts[order], of[order]
    last = np.r_[of[1:] != of[:-1], True] if len(of) else np.zeros(0, bool)
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[last] = at[of[last] + 1]
    return starts, ends, of


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of per-byte flags in each text (or between any ascending offsets)."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def between(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def seen_before(keys: np.ndarray) -> np.ndarray:
    """True where an equal key stands earlier."""
    _, first = np.unique(keys, return_index=True)
    again = np.ones(len(keys), bool)
    again[first] = False
    return again


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where the key stands twice or more."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def keyed(of: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts."""
    return mix(hashes ^ mix(of.astype(U64) + U64(1)))


def in_repeated_windows(of: np.ndarray, hashes: np.ndarray, width: int = 8) -> np.ndarray:
    """True for words inside a window of ``width`` words that its text has twice or more."""
    n = len(hashes) - width + 1
    covered = np.zeros(len(hashes), bool)
    if n <= 0:
        return covered
    window = np.zeros(n, U64)
    for j in range(width):
        window = window * U64(BASE) + hashes[j : j + n]
    inside = np.flatnonzero(of[:n] == of[width - 1 :])
    again = inside[repeated(keyed(of[inside], mix(window[inside])))]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return np.cumsum(edge[:-1]) > 0
