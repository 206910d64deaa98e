"""Words and word shingles as 64-bit hashes, in numpy.

Words are the runs of bytes other than ASCII white space, with A-Z
lower-cased; a document's shingles are its distinct runs of five words, or its
whole word sequence where it has fewer.
"""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to ``limit`` of them."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _Q
    return h ^ (h >> _S)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, in text order."""
    n = len(hashes) - size + 1
    h = hashes[:n].copy()
    for j in range(1, size):
        h = (h ^ (h >> _S)) * _P + hashes[j : j + n]
    return mixed(h)


def shingle_set(text: bytes | None, known: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; empty without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    short = len(words) < size
    h = windows(known.of(words), len(words) if short else size)
    return h + np.uint64(len(words)) if short else np.unique(h)
