"""64-bit hashes of the words of a column of texts, without a Python object per word.

The hash of a word is a sum over its bytes: a fixed random number for the byte times a
power of an odd base for its place.  Running sums over a whole batch give every word's
sum as a difference, so the work is a few array operations a byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a longer word is taken whole.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15
_LETTERS = np.random.default_rng(20_011).integers(1, 1 << 63, 256, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def _powers(base: int, count: int) -> np.ndarray:
    powers = np.full(count, base, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers, dtype=np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column one after the other, and where each text begins;
    a null has none."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, none of them 0, and where each text's begin."""
    raw, bounds = text_bytes(column)
    solid = ~_BLANK[raw]
    # a word begins at a solid byte after a blank or at the start of a text
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edges = bounds[(bounds > 0) & (bounds < len(raw))]
    begins[edges] = solid[edges]
    ends[edges - 1] = solid[edges - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.empty(len(begin), np.uint64)
    at, powers, inverse = 0, np.ones(1, np.uint64), np.ones(1, np.uint64)
    while at < len(begin):
        start = begin[at]
        to = max(at + 1, int(np.searchsorted(end, start + CHUNK, "right")))
        size = int(end[to - 1] - start)
        if size >= len(powers):
            powers, inverse = _powers(BASE, size + 1), _powers(pow(BASE, -1, 1 << 64), size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_LETTERS[raw[start : start + size]] * powers[:size], out=sums[1:])
        first, last = begin[at:to] - start, end[at:to] - start
        hashes[at:to] = (sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)
        at = to
    hashes = mixed(hashes)
    hashes[hashes == 0] = 1
    return hashes, np.searchsorted(begin, bounds)
