"""Hashes of word shingles, for whole batches of texts at a time."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 2**64)
#: 64 random bits for each byte value, and whether it is one of the six ASCII white-space characters.
_BYTE = np.random.default_rng(11).integers(0, 2**63, 256).astype(np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base; those of the longest text so far are kept."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(1 << 16, 2 * n), base, dtype=np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def words(raw: bytes, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends of the words of raw, in order: runs of bytes that apart (a mask of byte values) leaves. A hash is a polynomial in random codes of a word's bytes, mixed with its length."""
    b = np.frombuffer(raw, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    edge = np.diff(np.concatenate(([True], apart[b], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up = _powers(_BASE, len(b))
    down = _powers(_BACK, len(b))
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[b] * up, out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _M2), start, end


def word_hashes(raw: bytes) -> np.ndarray:
    """The hashes of the words of raw that white space keeps apart."""
    return words(raw)[0]


def shingle_sets(texts, width: int):
    """For each text its distinct shingle hashes, ascending. A-Z are lower-cased; None and texts without words give none.

    A text of fewer than width words is one shingle, all its words.
    """
    weights = [mixed(np.array([i + 1], dtype=np.uint64) * _M1)[0] | np.uint64(1) for i in range(width)]
    for text in texts:
        h = word_hashes(text.encode("utf-8", "surrogatepass").lower()) if text else np.zeros(0, dtype=np.uint64)
        if not len(h):
            yield h
            continue
        take = min(width, len(h))
        n = len(h) - take + 1
        s = np.zeros(n, dtype=np.uint64)
        for i in range(take):
            s += h[i : i + n] * weights[i]
        s = np.sort(mixed(s + np.uint64(take)))
        new = np.ones(len(s), dtype=bool)
        np.not_equal(s[1:], s[:-1], out=new[1:])
        yield s[new]
