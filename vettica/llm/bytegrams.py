"""Byte n-grams of words as 64-bit integers, counted with numpy.

A word is spelled as its UTF-8 bytes and a closing blank, after enough opening
line ends to fill the first context.  Neither byte occurs in a word.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

OPEN, CLOSE = 0x0A, 0x20


def spelled(words: Sequence[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, word numbers): for each byte and the closing blank of each word,
    the last ``order`` bytes up to it as one integer.  ``order`` is at most 7."""
    pad = bytes([OPEN]) * (order - 1)
    raw = np.frombuffer(b"".join(pad + w + b" " for w in words), np.uint8)
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    codes = raw.astype(np.int64)
    for back in range(1, order):
        codes[back:] += raw[:-back].astype(np.int64) << (8 * back)
    number = np.repeat(np.arange(len(words)), lengths)
    first = np.cumsum(lengths) - lengths
    inside = np.arange(len(number)) - first[number]
    return codes[first[number] + (number + 1) * (order - 1) + inside], number


def starts(keys: np.ndarray) -> np.ndarray:
    """Where each distinct one of sorted keys begins."""
    return np.flatnonzero(np.r_[len(keys) > 0, keys[1:] != keys[:-1]][: len(keys)])


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    start = starts(keys)
    return keys[start], np.add.reduceat(values, start)


def looked_up(keys: np.ndarray, table: np.ndarray, values: np.ndarray, missing: float) -> np.ndarray:
    """``values`` at the places of ``keys`` in the sorted ``table``."""
    if not len(table):
        return np.full(len(keys), missing)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], missing)
