"""Hashed word shingles of a text, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import mix64

KNOWN_WORDS = 400_000


class WordHashes(dict):
    """64-bit hashes of words; emptied when full, which costs time and changes nothing else."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = value
        return value


_HASHES = WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words in order: A-Z lower-cased, split at space and the characters 9 to 13."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words in order, with repeats; of fewer words, the one of all of them."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return total


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, width))
