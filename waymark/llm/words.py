"""Vectorised words, word hashes and word n-grams over UTF-8 buffers."""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_MASK = (1 << 64) - 1
_INV = pow(_P, -1, 1 << 64)
SLICE = 1 << 18


def _series(step: int, n: int) -> np.ndarray:
    out = np.full(n, step, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_pw, _ipw = _series(_P, SLICE), _series(_INV, SLICE)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pw, _ipw
    if n > len(_pw):
        _pw, _ipw = _series(_P, 2 * n), _series(_INV, 2 * n)
    return _pw[:n], _ipw[:n]


def fmix(h: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


EXACT = fmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
VALUES = EXACT.copy()
VALUES[65:91] = VALUES[97:123]  # A-Z count as a-z


def _class(separators: str) -> np.ndarray:
    out = np.ones(256, bool)
    out[[ord(c) for c in separators]] = False
    return out


#: [^\x20\x09-\x0D]+ once A-Z are lower-cased
SPACED = _class(" \t\n\x0b\x0c\r")
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased: digits, letters and everything beyond ASCII
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def spans(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and where each row's words begin (length rows + 1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    mask = kind[data]
    edge = off[:-1]
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    before[edge[edge < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, mask[1:]
    last = off[1:]
    after[last[last > 0] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    return starts, np.flatnonzero(mask & ~after) + 1, np.searchsorted(starts, off)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """64-bit hash of each word; with VALUES, A-Z count as a-z."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + SLICE, "right")))
        seg = data[base : ends[j - 1]]
        pw, ipw = _powers(len(seg) + 1)
        c = np.empty(len(seg) + 1, np.uint64)
        c[0] = 0
        np.cumsum(values[seg] * pw[:-1], out=c[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (c[e] - c[s]) * ipw[s] + (e - s).astype(np.uint64)
        i = j
    return fmix(out)


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, rows = spans(data, off, kind)
    return hashes(data, starts, ends), rows, starts, ends


def word_hash(word: str) -> int:
    """The hash that words() gives this word."""
    b = np.frombuffer(word.encode(), np.uint8)
    return int(hashes(b, np.array([0]), np.array([len(b)]))[0])


_A = fmix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def combine(h: np.ndarray, at: np.ndarray, gaps: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at at + gap for each gap: order counts."""
    out = np.full(len(at), (len(gaps) * 0xA0761D6478BD642F) & _MASK, np.uint64)
    for k, g in enumerate(gaps):
        out += h[at + g] * _A[k]
    return fmix(out)


def ngrams(h: np.ndarray, rows: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each row's k-grams, their first words, and where each row's grams begin.

    With `short`, a row of 1 to k - 1 words has its whole sequence as its only gram.
    """
    n = np.diff(rows)
    full = np.maximum(n - k + 1, 0)
    out_rows = np.concatenate([[0], np.cumsum(np.where((n > 0) & (n < k) & short, 1, full))])
    out, at = np.empty(out_rows[-1], np.uint64), np.empty(out_rows[-1], np.int64)
    first = np.repeat(rows[:-1], full) + np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
    to = np.repeat(out_rows[:-1], full) + np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
    out[to], at[to] = combine(h, first, tuple(range(k))), first
    if short:
        for m in range(1, k):
            d = np.flatnonzero(n == m)
            if len(d):
                out[out_rows[d]], at[out_rows[d]] = combine(h, rows[d], tuple(range(m))), rows[d]
    return out, at, out_rows
