"""Whole-batch word extraction and hashing for operators that work on Arrow batches.

A batch's texts are one byte buffer. Words, their places and their hashes are
found with a constant number of numpy passes over that buffer, so no Python
loop runs per word. Texts are taken whole; a batch is cut only between rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Rows are taken together up to so many text bytes (one longer text alone).
CHUNK_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of the word class [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower case:
#: digits, a-z and every byte of a character beyond ASCII.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[48:58] = True
WORD_BYTE[65:91] = True
WORD_BYTE[97:123] = True
WORD_BYTE[128:] = True

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


#: One 64-bit value for each byte, and one odd multiplier for each place of a k-gram.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
PLACE = mix(np.arange(1001, 1001 + 64, dtype=np.uint64) * _BASE) | np.uint64(1)

class Powers:
    """B**i and B**-i modulo 2**64, kept between calls for usual sizes and never pickled."""

    def __init__(self) -> None:
        self.kept: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return {"kept": None}

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.kept is not None and len(self.kept[0]) >= n:
            return self.kept[0][:n], self.kept[1][:n]
        size = max(n, 2 * CHUNK_BYTES)
        up, down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
        up[0] = down[0] = 1
        pair = np.cumprod(up), np.cumprod(down)
        if size <= 8 * CHUNK_BYTES:
            self.kept = pair
        return pair[0][:n], pair[1][:n]


powers = Powers()


@dataclass
class Words:
    """Words of ``n`` texts: word w has bytes start[w]:end[w] of ``data``; text d has words first[d]:first[d+1]."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    _sums: np.ndarray | None = None

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def _prefix_sums(self) -> np.ndarray:
        if self._sums is None:
            up, _ = powers(len(self.data))
            sums = np.empty(len(self.data) + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(BYTE_VALUE[LOWER[self.data]] * up, out=sums[1:])
            self._sums = sums
        return self._sums

    def hashes(self, most: int | None = None) -> np.ndarray:
        """64-bit hash of each word (of its first ``most`` bytes) with A-Z lower-cased."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        sums, (_, down) = self._prefix_sums(), powers(len(self.data))
        end = self.end if most is None else np.minimum(self.end, self.start + most)
        return mix((sums[end] - sums[self.start]) * down[self.start])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and offsets (nulls are empty texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def split(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the class above in texts that lie one after another in ``data``."""
    inside = WORD_BYTE[data]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    if len(data):
        starts[1:] &= ~inside[:-1] | begins[1:-1]
        ends[:-1] &= ~inside[1:] | begins[1:-1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words) for runs of whole rows of about ``most`` bytes."""
    if not len(column):
        return
    data, offsets = buffers(column)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        stop = min(stop, len(column))
        yield row, stop, split(data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row])
        row = stop


def grams(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive words of the whole array (text ends are the caller's)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, (salt * int(_BASE)) % (1 << 64), dtype=np.uint64)
    for j in range(k):
        total += words[j:j + n] * PLACE[j]
    return mix(total)


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost smallest value in each window of w values."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    # windows of doubling size, of which the last two overlap
    low, at, size = values, np.zeros(len(values), dtype=np.int16 if w < 1 << 15 else np.int64), 1
    while size < w:
        step = min(size, w - size)
        left, right = low[:-step], low[step:]
        less = right < left
        low, at = np.where(less, right, left), np.where(less, at[step:] + at.dtype.type(step), at[:-step])
        size += step
    return np.arange(n) + at


def winnow(words: Words, hashes: np.ndarray, k: int, w: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the k-gram kept from every window of w k-grams inside one text.

    Any run of k + w - 1 words that two texts share keeps the same k-gram in both.
    """
    g = grams(hashes, k, salt)
    whole = k + w - 1
    at = window_minima(g, w)
    if not len(at):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    # a window is used if its first and last word belong to one text
    left = np.repeat(words.first[1:], words.counts)[:len(at)]
    at = at[np.arange(len(at)) + whole <= left]
    if len(at):
        at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    return at, g[at]
