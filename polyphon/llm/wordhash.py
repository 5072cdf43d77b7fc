"""Words of many texts at once, as spans over their bytes and as 64-bit hashes.

A text column is one run of UTF-8 bytes in Arrow, so words can be found and
hashed with array operations only. A word's hash is a polynomial over random
64-bit values of its bytes, mixed at the end; two different words share one
with a chance of about 2^-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 2**64))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream64(n: int, seed: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit values from a seed."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(1 << 32)) * _U(0x9E3779B97F4A7C15))


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256: true for bytes within the ranges, ends included."""
    found = np.zeros(256, bool)
    for lo, hi in ranges:
        found[lo : hi + 1] = True
    return found


BYTES = stream64(256, 7)
LOWER = np.arange(256)
LOWER[ord("A") : ord("Z") + 1] += 32
SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))

KEPT_POWERS = 5 << 18
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and its inverse; those for longer runs of bytes are not kept."""
    tables = _powers
    if len(tables[0]) < n:
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            grown = np.full(max(n, KEPT_POWERS), base, _U)
            grown[0] = 1
            tables.append(np.cumprod(grown, dtype=_U))
        if n <= KEPT_POWERS:
            _powers[:] = tables
    return tables[0][:n], tables[1][:n]


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one run, and where each text begins and the last ends; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive) and, per text, the number of words before it (one entry more than texts).

    ``cuts`` marks bytes before which a word ends in any case.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    joined = np.zeros(len(data) + 1, bool)
    joined[1:-1] = inside[1:] & inside[:-1]
    joined[offsets] = False
    if cuts is not None:
        joined[:-1] &= ~cuts
    starts = np.flatnonzero(inside & ~joined[:-1])
    ends = np.flatnonzero(inside & ~joined[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = LOWER) -> np.ndarray:
    """The hash of each span; ``fold`` maps bytes first, by default A-Z to a-z."""
    if not len(starts):
        return np.zeros(0, _U)
    powers, inverse = _power_tables(len(data))
    values = (BYTES if fold is None else BYTES[fold])[data]
    values *= powers
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(values, out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))
