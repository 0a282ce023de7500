"""Vectorised hashes of words and of word windows, for use inside tasks (numpy only)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE, _WORD_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PIECE = 1 << 20


@lru_cache(maxsize=4)
def _powers(base: int, log2: int) -> np.ndarray:
    steps = np.full(1 << log2, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _power(base: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    value = pow(int(base), -1, 1 << 64) if inverse else int(base)
    return _powers(value, max(10, int(n).bit_length()))[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _sums(values: np.ndarray, base: np.uint64) -> np.ndarray:
    """s[j] - s[i] is base^i times the hash of values[i:j]."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, len(values)), out=out[1:])
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all texts in order, number of words of each text)."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    gap = _SPACE[data]
    word = ~gap
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # pieces of some 1 MB that end with a word
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + _PIECE)))
        low = starts[at]
        sums = _sums(data[low : ends[stop - 1]].astype(np.uint64) + np.uint64(1), _BASE)
        a, b = starts[at:stop] - low, ends[at:stop] - low
        hashes[at:stop] = (sums[b] - sums[a]) * _power(_BASE, len(sums), inverse=True)[a] + (b - a).astype(np.uint64)
        at = stop
    counts = np.diff(np.searchsorted(starts, np.cumsum(lengths)), prepend=0)
    return mixed(hashes), counts


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of words[i : i + size] for every i, over ends of texts too."""
    n = max(0, len(words) - size + 1)
    out = np.empty(n, np.uint64)
    for at in range(0, n, _PIECE):
        stop = min(n, at + _PIECE)
        sums = _sums(words[at : stop + size - 1], _WORD_BASE)
        out[at:stop] = (sums[size:] - sums[:-size]) * _power(_WORD_BASE, stop - at, inverse=True)
    return mixed(out)


def inside(counts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of the first n positions start a window of `size` words that stays in its text."""
    ends = np.repeat(np.cumsum(counts), counts)[:n]
    return np.arange(n) + size <= ends
