"""Word shingles as 64-bit hashes, the same in every process."""

from __future__ import annotations

import numpy as np
import xxhash

_M = np.uint64(0x9E3779B97F4A7C15)
_A = np.uint64(0xBF58476D1CE4E5B9)
_B = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased; words are runs of anything but ASCII white space."""
    words = (text or b"").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_sequence(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hash of each run of ``width`` words; of the whole sequence where it is shorter; none for no words."""
    n = len(words)
    if n == 0:
        return words
    size = min(n, width)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = out * _M + words[i : n - size + 1 + i]
    return mix(out)


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_sequence(word_hashes(text), width))
