"""Words, word hashes and shingle sets of whole texts, a few megabytes at a time.

A word is a run of bytes other than space and \\t..\\r; A-Z count as lower case.  Hashes are 64 bits
wide: a polynomial over random byte values, then a finaliser.  They are the same in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_Q = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def _powers_of(n: int, _kept: dict = {}) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse; one table of a slice's length is kept."""
    if n > SLICE_BYTES + (1 << 20):
        return _powers(_P, n), _powers(_P_INV, n)
    if "p" not in _kept:
        m = SLICE_BYTES + (1 << 20)
        _kept["p"] = _powers(_P, m), _powers(_P_INV, m)
    p, q = _kept["p"]
    return p[:n], q[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each text begins (one more than rows); a null is empty."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges of at most ``most`` bytes; a longer text is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in order, and the first word of each text (one more than rows)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1]
    before[cuts[cuts < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = offsets[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    power, inverse = _powers_of(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[raw]] * power[:n], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * _Q)
    return h, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word windows of one text; with fewer words, of the whole text."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < k:
        x = np.full(1, n, np.uint64)
        for w in words:
            x = mix(x * _Q + w)
        return x
    x = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        x = x * _Q + words[i : n - k + 1 + i]
    x = np.sort(mix(x))
    return x[np.concatenate(([True], x[1:] != x[:-1]))]
