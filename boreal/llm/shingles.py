"""Hashes of words and word n-grams for whole batches of texts."""

from __future__ import annotations

import numpy as np
import xxhash

MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The 64-bit hash of each word; hashing anew is cheaper than a lookup where rare words are many."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words, given the words' hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x100000001B3) + h[k : k + m] * MULTIPLIERS[k % 5]
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_set(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of words; a text of fewer words has one shingle, a text without words none."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    if len(h) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=1)], np.uint64)
    return np.unique(ngrams(h, n))
