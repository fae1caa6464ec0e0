"""Word and word-shingle hashes of whole texts, in array operations.

Words are maximal runs of other bytes than space and U+0009 to U+000D, taken
unchanged. Hashes have 64 bits and wrap around.
"""

from __future__ import annotations

import numpy as np

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def step(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n-th number (from 1) of the random sequence that starts at x."""
    return mix(x + n.astype(np.uint64) * _GOLD)


def _power(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (_powers[-1:] * _BASE)])
    return _powers[:n]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word."""
    word = np.empty(len(data) + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(_SPACE[np.frombuffer(data, np.uint8)], out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = ends - starts
    if not len(n):
        return np.zeros(0, np.uint64)
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    own = np.frombuffer(data, np.uint8)[place + np.repeat(starts, n)].astype(np.uint64) + np.uint64(1)
    total = np.add.reduceat(own * _power(int(n.max()))[place], first)
    return mix(total + n.astype(np.uint64) * _GOLD)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive words (none if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = _power(k)
    total = words[:n] * p[0]
    for j in range(1, k):
        total = total + words[j:j + n] * p[j]
    return mix(total + np.uint64(k))


def window_argmin(a: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest of each w consecutive values, the first of equals."""
    if len(a) < w:
        return np.zeros(0, np.int64)
    at, have = np.arange(len(a)), 1

    def lower(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(a[y] < a[x], y, x)

    while 2 * have <= w:
        at, have = lower(at[:-have], at[have:]), 2 * have
    rest = w - have
    return lower(at[:-rest], at[rest:]) if rest else at


def shingles(text: str | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles (hashes, ascending) and their counts. A text of
    fewer words is one shingle; one without words has none."""
    data = (text or "").encode()
    words = word_hashes(data, *word_spans(data))
    if not len(words):
        return words, np.zeros(0, np.int64)
    return np.unique(gram_hashes(words, min(k, len(words))), return_counts=True)
