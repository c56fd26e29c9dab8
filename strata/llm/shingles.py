"""Word shingles of whole texts as 64-bit hash sets, and MinHash signatures of such sets.

Words are maximal runs of bytes other than space and the control characters 9 to 13, after lower-casing A-Z.
A text's set holds one hash per distinct sequence of five words; a text with one to four words has the hash of its
whole sequence; a text without words (or without text) has the empty set.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}
_rng = np.random.Generator(np.random.PCG64(20240611))
_PLACES = _rng.integers(1, 1 << 63, WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)
EMPTY = np.zeros(0, np.uint64)


def _power(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2**64."""
    known = _powers[base]
    while len(known) < n:
        known = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
        _powers[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word, in order: differences of one running polynomial over all bytes."""
    if not text:
        return EMPTY
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.diff(inside)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return EMPTY
    running = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(raw)), out=running[1:])
    return mix((running[last] - running[first]) * _power(_INVERSE, len(raw))[first])


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    words = word_hashes(text)
    if not len(words):
        return EMPTY
    if len(words) < WIDTH:
        return mix((words * _PLACES[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    n = len(words) - WIDTH + 1
    joined = words[:n] * _PLACES[0]
    for k in range(1, WIDTH):
        joined += words[k : k + n] * _PLACES[k]
    return np.unique(mix(joined))


def multipliers(n: int, seed: int = 7) -> np.ndarray:
    """``n`` odd 64-bit multipliers, the hash functions of a signature."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(items: np.ndarray, by: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """For each multiplier the upper 32 bits of the smallest product with an item of the (non-empty) set."""
    least = np.full(len(by), _MASK, np.uint64)
    for at in range(0, len(items), chunk):
        np.minimum(least, (items[at : at + chunk, None] * by).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
