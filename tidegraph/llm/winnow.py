"""Winnowed fingerprints of code-point streams, many texts at a time."""

from __future__ import annotations

import numpy as np

#: Fixed value: the odd multiplier of the rolling hash (2^64 over the golden ratio).
MULTIPLIER = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over the word, so that minima pick k-grams evenly."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def rolling(codes: np.ndarray, k: int, multiplier: int = MULTIPLIER) -> np.ndarray:
    """Hashes of all k-grams of a stream (as many as it has symbols less k - 1), by doubling."""
    h, size, power = codes.astype(np.uint64) + np.uint64(1), 1, multiplier
    out, done, bits = None, 0, k
    if len(codes) < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        while bits:
            if bits & 1:
                if out is None:
                    out = h
                else:
                    n = len(h) - done
                    out = out[:n] * np.uint64(power) + h[done:]
                done += size
            bits >>= 1
            if bits:
                h = h[:-size] * np.uint64(power) + h[size:]
                power, size = power * power % (1 << 64), size * 2
        return mixed(out)


def window_minima(hashes: np.ndarray, window: int, starts: np.ndarray) -> np.ndarray:
    """Sorted positions of the minimum (leftmost of equals, by the upper half of the hash) of each window at ``starts``."""
    if not len(starts):
        return np.empty(0, np.int64)
    key = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size * 2 <= window:
        key = np.minimum(key[: len(key) - size], key[size:])
        size *= 2
    low = np.minimum(key[starts], key[starts + (window - size)])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # never falls from one window to a later one
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def fingerprints(codes: np.ndarray, sizes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position in the text, hash) of the winnowed k-grams of texts laid end to end in ``codes``.

    Any stretch of ``window + k - 1`` symbols that two texts share yields a fingerprint of both at the same place in it.
    Texts shorter than that have none. No window crosses from one text to the next.
    """
    span = window + k - 1
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.empty(0, np.int64)
    h = rolling(codes, k)
    counts = np.maximum(sizes - span + 1, 0)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins, counts)
    at = window_minima(h, window, starts)
    text = np.searchsorted(begins, at, side="right") - 1
    if len(sizes):  # empty texts begin where the next one does
        text = np.searchsorted(np.cumsum(sizes), at, side="right")
    return text, at - begins[text] if len(at) else at, h[at]
