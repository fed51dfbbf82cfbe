"""Words and stable hashes of words for the batch operators."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A word is a maximal run of letters or digits, lower-cased.
WORD = re.compile(r"[^\W_]+")
_CACHE_MAX = 1 << 20


class WordHash(dict):
    """word -> 64-bit hash, alike in every process. The cache is emptied when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE_MAX:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def batch_hashes(texts, cache: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts one after another, and the number of words of each text."""
    flat: list[str] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for k, t in enumerate(texts):
        if t:
            w = WORD.findall(t.lower())
            counts[k] = len(w)
            flat += w
    return np.fromiter(map(cache.__getitem__, flat), dtype=np.uint64, count=len(flat)), counts


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))
