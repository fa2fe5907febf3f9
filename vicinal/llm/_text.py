"""Byte-level text kernels that the Python-backed operators share.

An Arrow string column already is one byte buffer with row offsets, so words, word hashes and
rolling word hashes of thousands of documents come from a few numpy passes, without a Python
object per word. Chunks of about half a megabyte bound the memory whatever the batch size is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words between the ASCII white space characters 0x20 and 0x09 to 0x0D.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of ASCII letters and digits and of everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_GRAM = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) | 1 for k in range(64)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _PRIME), ("down", _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Chunk:
    """Rows first .. first + len(bounds) - 1 of a column: their bytes, and where each row begins."""

    __slots__ = ("first", "data", "bounds")

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds = first, data, bounds

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole rows of a string column, about `limit` bytes at a time; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = raw[column.offset : column.offset + n + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield Chunk(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


class Words:
    """Word starts and ends (bytes within the chunk) and how many words stand before each row."""

    __slots__ = ("start", "end", "rows")

    def __init__(self, start: np.ndarray, end: np.ndarray, rows: np.ndarray):
        self.start, self.end, self.rows = start, end, rows


def words(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> Words:
    if not len(data):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64))
    inside = kind[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = bounds[:-1][np.diff(bounds) > 0]
    opens[edges] = inside[edges]
    last = bounds[1:][np.diff(bounds) > 0] - 1
    closes[last] = inside[last]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(start, end, np.searchsorted(start, bounds))


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    """64 bits for each word, from one polynomial prefix sum over the chunk."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = (total[w.end] - total[w.start]) * down[w.start]
    return mix(h + (w.end - w.start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of k words; those that begin in the last k - 1 words are of shorter runs."""
    out = h * _GRAM[0]
    for j in range(1, k):
        if j < len(h):
            out[:-j] += h[j:] * _GRAM[j]
    return mix(out)


def within_rows(w: Words, k: int) -> np.ndarray:
    """True for each word whose k-word run ends within its row."""
    ok = np.ones(len(w.start), dtype=bool)
    ends = w.rows[1:]
    for j in range(1, k):
        at = ends - j
        ok[at[at >= w.rows[:-1]]] = False
    return ok


def row_of(w: Words) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(w.rows) - 1), np.diff(w.rows))
