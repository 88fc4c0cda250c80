"""Byte-level NumPy kernels shared by the operators that read whole texts.

A batch of texts is looked at as one UTF-8 byte stream, so that splitting into words and hashing
costs a few vector passes a byte instead of a Python object a word.  A word is a longest run of
ASCII letters, digits and bytes above 0x7F; ASCII and Latin-1 capitals are folded.  A null text
counts as the empty text here; callers give nulls a meaning of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiplicative hash (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or _powers[0].size < n:
        size = max(n, 1 << 19)
        out = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string array, nulls as empty."""
    if pa.types.is_string_view(texts.type) or not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes (one row at least), to bound the memory of a pass."""
    _, offsets = raw(texts)
    n, lo = len(texts), 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of Latin-1 letters in UTF-8."""
    out = _FOLD[data]
    if out.size > 1:
        up = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][up] += 0x20
    return out


def words(data: np.ndarray, offsets: np.ndarray, piece: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, start, end) of every word of the stream, in order; start and end are bytes of it."""
    size = data.size
    if size == 0:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z
    is_word = _WORD[data]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], is_word[:-1]])
    starts = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.concatenate([is_word[1:], [False]])
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    folded = fold(data)
    hashes = np.empty(starts.size, np.uint64)
    lo = 0
    while lo < starts.size:  # pieces of whole words keep the arrays in cache
        at = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, at + piece, side="right")))
        span = int(ends[hi - 1] - at)
        power, inverse = _power(span + 1)
        total = np.zeros(span + 1, np.uint64)
        np.cumsum((folded[at : at + span].astype(np.uint64) + np.uint64(1)) * power[:span], out=total[1:])
        s, e = starts[lo:hi] - at, ends[lo:hi] - at
        hashes[lo:hi] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        lo = hi
    row = np.searchsorted(offsets, starts, side="right") - 1
    return row, mix(hashes), starts, ends


def distinct(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word once a row, sorted by row and hash."""
    if not row.size:
        return row, hashes
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    first = np.ones(row.size, bool)
    first[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[first], hashes[first]
