"""Hashes of words, and of runs of words, as arrays."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multiplier of the rolling combination.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of each word, remembered for a bounded number of them."""

    def __init__(self, entries: int = 200_000):
        super().__init__()
        self.entries = entries

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.entries:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit values."""
    x = values ^ (values >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs(codes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` codes that start at each place."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(length):
        out = out * MULTIPLIER + codes[i : i + n]
    return mixed(out)


def shingles(codes: np.ndarray, length: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of `length` words; a shorter text is one run of all its words."""
    if not len(codes):
        return codes
    if len(codes) < length:
        return runs(codes, len(codes)) + np.uint64(len(codes))
    return np.unique(runs(codes, length))
