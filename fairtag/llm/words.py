"""Words of whole texts as numpy arrays, read straight from Arrow buffers.

A word is a maximal run of bytes other than space and \\x09-\\x0D. Words and word windows are identified by 64-bit
polynomial hashes taken from prefix sums, so the cost per byte is constant and no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are worked on in slices of about this many bytes, which bounds the memory of a task; one longer text is a slice.
SLICE_BYTES = 1 << 19

_RNG = np.random.default_rng(20240229)
_BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWERED = np.arange(256)
_LOWERED[65:91] += 32
_BYTE_VALUES_LOWERED = _BYTE_VALUES[_LOWERED]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, at least ``n`` of them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        factors = np.full(max(n, SLICE_BYTES + 64), base, np.uint64)
        factors[0] = 1
        have = _powers[base] = np.multiply.accumulate(factors)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of several texts; those of text ``i`` are ``first[i]:first[i + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def left(self) -> np.ndarray:
        """For each word, the words of its text from it on."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.hashes))


def hashed_words(data: np.ndarray, bounds: np.ndarray, lower: bool = False, marks: bool = True) -> Words:
    """Words of the texts ``data[bounds[i]:bounds[i + 1]]`` (UTF-8).

    ``lower`` takes A-Z as a-z; without ``marks`` every ASCII character but letters and digits parts words too.
    """
    n = len(data)
    solid = ~(_SPACE if marks else _NOT_ALNUM)[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | edge[1:n]
    closes = solid.copy()
    if n:
        closes[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE_VALUES_LOWERED if lower else _BYTE_VALUES)[data] * powers(_BASE, n)[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * powers(_INVERSE, n)[starts])
    return Words(data, starts, ends, np.searchsorted(starts, bounds), hashes)


def window_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each word on, and whether that many are left in its text."""
    n = len(words.hashes)
    if n < size:
        return np.zeros(n, np.uint64), np.zeros(n, bool)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words.hashes * powers(_BASE, n)[:n], out=sums[1:])
    hashes = np.zeros(n, np.uint64)
    hashes[:n - size + 1] = mix((sums[size:] - sums[:-size]) * powers(_INVERSE, n)[:n - size + 1])
    return hashes, words.left() >= size


def text_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, bounds of the rows in them); a null text is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column: row ``i`` holds ``values[bounds[i]:bounds[i + 1]]``."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))
