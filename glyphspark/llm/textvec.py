"""Words of whole texts as numpy arrays, straight from Arrow's UTF-8 buffers: no Python string per word.

A word's 64-bit hash is a polynomial in its bytes, found for all words of a piece at once from a running sum, then
mixed. Equal words have equal hashes everywhere; unequal words differ but for chance of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_K = np.uint64(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes outside of letters and digits; bytes above 127 belong to letters.
NOT_ALNUM = np.array([not (chr(b).isalnum() and b < 128 or b >= 128) for b in range(256)])
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 17)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[key] = np.multiply.accumulate(step)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(at: np.ndarray, most: int = 1 << 22):
    """Ranges of rows (i, j) of about most bytes each, one row at least."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(raw: np.ndarray, at: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of words, and for each of the n rows the index of its first word (n + 1)."""
    if len(raw) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    gap = apart[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    word = ~gap
    before = np.concatenate(([True], gap[:-1])) | edge[:-1]
    after = np.concatenate((gap[1:], [True])) | edge[1:]
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, at)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME, piece: int = 1 << 16) -> np.ndarray:
    """uint64 hash of each word raw[start:end] after folding its bytes; works in pieces that fit the processor's cache."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + piece, side="right")))
        part = fold[raw[low : ends[j - 1]]].astype(np.uint64)
        part += np.uint64(1)
        up, down = _pow(len(part) + 1)
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(part * up[: len(part)], out=total[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _K)
        i = j
    return out


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size consecutive words; runs over row borders are included, select by first."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    total = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        total *= _K
        total += h[k : len(h) - size + 1 + k]
    return mix(total + np.uint64(size))


def run_hash(h: np.ndarray) -> np.uint64:
    """Hash of one whole short row of words, apart from those of windows."""
    total = np.zeros(1, np.uint64)
    for x in h:
        total = total * _K + x
    return mix(total + np.uint64(1000 + len(h)))[0]
