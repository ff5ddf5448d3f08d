"""Vectorised 64-bit hashes of the words of a text and of runs of words."""

from __future__ import annotations

import numpy as np

#: A-Z to a-z; other bytes stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes that separate words: blank and 0x09 to 0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _grow(n: int) -> None:
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * MIX
        x = (x ^ (x >> np.uint64(29))) * MIX
        return x ^ (x >> np.uint64(32))


def word_hashes(text: bytes | None) -> np.ndarray:
    """A hash for each word (lower-cased in ASCII, between white space), in order.

    The hash is a polynomial in the bytes of the word, read off prefix sums of
    the whole text, so that no word is handled by itself.
    """
    if not text:
        return np.empty(0, dtype=np.uint64)
    raw = np.frombuffer(text.translate(FOLD), dtype=np.uint8)
    gap = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.r_[True, gap, True].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    _grow(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers[0][: len(raw)], out=sums[1:])
        own = (sums[end] - sums[start]) * _powers[1][start]
    return mixed(own + (end - start).astype(np.uint64))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` consecutive words (of all, where there are fewer)."""
    n = min(n, len(words))
    if not n:
        return np.empty(0, dtype=np.uint64)
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = mixed(out + words[i : len(words) - n + 1 + i])
    return out
