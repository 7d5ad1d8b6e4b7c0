"""Word and shingle hashes of whole texts, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import words

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
#: Words whose hashes a worker keeps.
KEPT = 200_000


class Hashes(dict):
    """64-bit hashes of words, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, tokens), np.uint64, len(tokens))


def joined(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    total = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        total += h[j:len(h) - n + 1 + j] * _ODD[j % len(_ODD)] * np.uint64(2 * (j // len(_ODD)) + 1)
    return mixed(total + np.uint64(n))


def shingle_set(tokens: list[bytes], n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of a shorter text the whole as one; none without words."""
    if not tokens:
        return np.zeros(0, np.uint64)
    return np.unique(joined(word_hashes(tokens), min(n, len(tokens))))


def text_hash(text: str | None) -> int:
    """Signed 64-bit hash of the lower-cased words in their order."""
    return xxhash.xxh3_64_intdigest(b" ".join(words(text))) - (1 << 63)
