"""Words of whole texts as numbers, for operators on shingles and passages."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str) -> list[bytes]:
    """Runs of bytes other than space, tab, line feed, vertical tab, form feed and return."""
    return text.encode().split()


def word_numbers(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scattering of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(32))


def windows(numbers: np.ndarray, n: int) -> np.ndarray:
    """One hash for each n consecutive words, by position."""
    count = len(numbers) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(count, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        out *= FACTOR
        out += numbers[k : k + count]
    return mixed(out)


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles in A-Z lower case; a shorter text is one shingle as a whole."""
    numbers = word_numbers(text.encode().lower().split())
    return np.unique(windows(numbers, min(n, max(1, len(numbers)))))
