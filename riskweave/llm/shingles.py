"""Word shingles of texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x7FB5D329728EA185)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """A hash per word; words are parted by ASCII white space and A-Z are lower-cased."""
    words = text.encode("utf-8", "replace").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words in order; of all words if there are fewer, of none if there are none."""
    n = words.size
    if n == 0:
        return words
    size = min(size, n)
    with np.errstate(over="ignore"):
        h = np.full(n - size + 1, np.uint64(size), dtype=np.uint64)
        for i in range(size):
            h = mix((h + _GOLDEN) * _PRIME + words[i : n - size + 1 + i])
    return h


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct shingles of the whole text."""
    return np.unique(shingle_hashes(word_hashes(text), size))
