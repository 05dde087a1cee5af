"""Array kernels over Arrow string columns: word spans, word hashes, shingles.

A word is a maximal run of bytes other than space and \\x09-\\x0D; A-Z are
lower-cased first.  All steps are whole-array numpy operations over chunks of about
half a megabyte, so the memory needed does not depend on the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        m = max(n, CHUNK + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(data: np.ndarray, off: np.ndarray, size: int = CHUNK, most: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``size`` bytes and at most ``most`` rows: first row, end row, bytes, offsets."""
    first, rows = 0, len(off) - 1
    while first < rows:
        end = int(np.searchsorted(off, off[first] + size, "right")) - 1
        end = min(rows, max(first + 1, end), first + most)
        yield first, end, data[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


class Words:
    """Words of a chunk: byte spans, 64-bit hashes, and each row's range of words."""

    def __init__(self, data: np.ndarray, off: np.ndarray, head: int = 0):
        """``head``: bytes of each word that make its ``begin`` hash; 0 for none."""
        gap = _SPACE[data]
        fresh = np.ones(len(data) + 1, bool)  # a word can't run on into this byte
        fresh[1:-1] = gap[:-1]
        fresh[off] = True
        ink = ~gap
        self.start = np.flatnonzero(ink & fresh[:-1])
        stop = fresh[1:].copy()
        stop[:-1] |= gap[1:]
        self.end = np.flatnonzero(ink & stop) + 1
        self.off = np.searchsorted(self.start, off)
        power, inverse = _powers(len(data) + 1)
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[:-1], out=run[1:])
        h = (run[self.end] - run[self.start]) * inverse[self.start]
        self.hash = mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        if head:
            self.begin = mix((run[np.minimum(self.end, self.start + head)] - run[self.start]) * inverse[self.start])

    def counts(self) -> np.ndarray:
        return np.diff(self.off)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-word shingles and row offsets into them.

    A row of fewer than n words (but one at least) has its whole sequence as one.
    """
    h, count = words.hash, words.counts()
    per = np.maximum(count - n + 1, 0)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(h) >= n:
        g = mix(h[: len(h) - n + 1] + np.uint64(n))
        for j in range(1, n):
            g = mix(g * np.uint64(0xA0761D6478BD642F) + h[j : len(h) - n + 1 + j])
        row = np.repeat(np.arange(len(count)), per)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
        g = g[words.off[row] + inside]
    else:
        g = np.zeros(0, np.uint64)
    if not len(short):
        return g, np.concatenate([[0], np.cumsum(per)])
    at = np.cumsum(per)[short]  # a short row has none of its own, so its place is its end
    alone = []
    for r in short:
        own = h[words.off[r] : words.off[r + 1]]
        v = mix(own[:1] + np.uint64(len(own)))
        for x in own[1:]:
            v = mix(v * np.uint64(0xA0761D6478BD642F) + x)
        alone.append(v[0])
    per = per.copy()
    per[short] = 1
    return np.insert(g, at, np.array(alone, np.uint64)), np.concatenate([[0], np.cumsum(per)])
