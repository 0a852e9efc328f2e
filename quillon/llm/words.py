"""Words of many texts at once: 64-bit hashes computed over the raw bytes with NumPy.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which no multi-byte UTF-8 character contains. Two different
words share a hash with probability 2**-64; the hashes depend on nothing but the word, so every task agrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_KEYS = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
#: Gaps of search terms: every ASCII character but letters, digits and the low line.
TERM_GAP = np.array([b < 128 and not (chr(b).isalnum() or b == 95) for b in range(256)])
_STEP = 1 << 20
_P = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    size = max(_STEP, n)
    if size not in _POWERS:
        pair = []
        for p in (_P, pow(_P, -1, 1 << 64)):
            x = np.full(size, p, np.uint64)
            x[0] = 1
            pair.append(np.cumprod(x))
        if size > _STEP:
            return tuple(pair)
        _POWERS[size] = tuple(pair)
    return _POWERS[size]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last ends); null texts are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), bounds


def hashed(data: np.ndarray, bounds: np.ndarray, lower: bool = False, gap: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, index of each text's first word and one past the last's); `lower` folds A-Z, `gap` tells bytes between words."""
    table = _LOWER if lower else _BYTE
    hashes, starts = [], []
    at, end = int(bounds[0]), int(bounds[-1])
    while at < end:
        to = min(at + _STEP, end)
        if to < end:
            k = int(np.searchsorted(bounds, to, "right")) - 1
            if bounds[k] > at:
                to = int(bounds[k])
            elif len(gaps := np.flatnonzero(gap[data[at:to]])):
                to = at + int(gaps[-1]) + 1
            else:
                stop = int(bounds[k + 1])
                while to < stop and not gap[data[to]]:
                    to += 1
        b = data[at:to]
        word = ~gap[b]
        cut = bounds[np.searchsorted(bounds, at, "right") : np.searchsorted(bounds, to, "left")] - at
        before = np.concatenate(([False], word[:-1]))
        after = np.concatenate((word[1:], [False]))
        before[cut] = False
        after[cut - 1] = False
        s, e = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after)
        up, down = _powers(len(b))
        terms = table[b] * up[: len(b)]
        total = np.cumsum(terms)
        hashes.append(mixed((total[e] - total[s] + terms[s]) * down[s] + (e - s).astype(np.uint64) * _KEYS[63]))
        starts.append(s + at)
        at = to
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words, texts not told apart."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for t in range(k):
        out += h[t : t + n].astype(np.uint64, copy=False) * _KEYS[t]
    return mixed(out)


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, to bound what a step holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def unused(name: str, docs: DataFrame) -> str:
    """A column name that docs does not have: the given one, lengthened until it is new."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
