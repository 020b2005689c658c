"""Words of whole texts as numpy arrays, for code that works on Arrow batches.

A batch's texts are read as one run of UTF-8 bytes. Words are ``[^\\x20\\x09-\\x0D]+``; each
gets a 64-bit hash of its bytes from running sums, so no Python object is made per word.
Batches are cut into slices of whole texts so that memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
STEP_INVERSE = pow(STEP, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers that depend on the seed alone."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(STEP))


RAW_VALUES = randoms(256, 1)
LOWER_VALUES = RAW_VALUES[LOWER]
_ODD = randoms(8, 2) | np.uint64(1)


class _Powers:
    """Powers of the step and of its inverse, as long as the longest slice so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * SLICE_BYTES)
            self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, STEP, np.uint64)])
            self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, STEP_INVERSE, np.uint64)])
        return self.up, self.down


@cache
def _powers() -> _Powers:
    return _Powers()


class Slice(NamedTuple):
    """Whole texts: rows ``first`` to ``last`` of a batch, their bytes and where each begins."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Words in order; those of text ``i`` are ``bounds[i]:bounds[i + 1]``."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut binary texts into runs of about ``limit`` bytes; a null text is empty."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if n == 0:
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield Slice(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans ``start:end``: equal for equal bytes wherever they stand."""
    up, down = _powers().upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _ODD[7])


def words(part: Slice, lower: bool = False) -> Words:
    """The words of a slice; ``lower`` folds A-Z only."""
    data, offsets = part.data, part.offsets
    solid = ~SPACE[data]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[inner] = solid[inner]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = span_hashes(data, start, end, LOWER_VALUES if lower else RAW_VALUES)
    return Words(hashes, start, end, np.searchsorted(start, offsets))


def window_hashes(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` consecutive words inside a text, and their bounds per text."""
    n = len(found.hashes)
    counts = np.maximum(found.counts - size + 1, 0)
    bounds = np.r_[0, np.cumsum(counts)]
    if n < size:
        return np.zeros(0, np.uint64), bounds
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total = total * _ODD[0] + found.hashes[k : n - size + 1 + k]
    starts = np.repeat(found.bounds[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    return mix(total[starts]), bounds


def sums_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values``; an empty run gives 0."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class HashIndex:
    """Finds 64-bit keys in a fixed set; gives their places, or -1."""

    def __init__(self, keys: np.ndarray) -> None:
        """``keys`` ascending and distinct."""
        self.keys = keys
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        out = np.full(len(wanted), -1, np.int64)
        n = len(self.keys)
        if n == 0 or len(wanted) == 0:
            return out
        place = self.starts[(wanted >> self.shift).astype(np.int64)].astype(np.int64)
        left = np.arange(len(wanted))
        while len(left):
            here = place[left]
            inside = here < n
            left, here = left[inside], here[inside]
            key, want = self.keys[here], wanted[left]
            same = key == want
            out[left[same]] = here[same]
            on = key < want
            left = left[on]
            place[left] += 1
        return out
