"""Words and their hashes, batch by batch in numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A word: a maximal run of letters and digits.
WORD = re.compile(r"[^\W_]+")

_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _C1
    x = x ^ (x >> np.uint64(33))
    x = x * _C2
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """word -> 64-bit hash, computed once a word and process; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hashed_words(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts one after another, and the number of words of each text."""
    find, get = WORD.findall, hashes.__getitem__
    parts, counts = [], np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = find(t.lower())
        counts[i] = len(words)
        parts += words
    return np.fromiter(map(get, parts), np.uint64, len(parts)), counts


def multiset_features(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Each word's n-th occurrence in a text as one 64-bit feature, so that sets of features are multisets of words.

    Gives the features of all texts one after another, sorted within a text by word, and the number of each text.
    A batch may have up to 65,536 texts.
    """
    if len(texts) > 1 << 16:
        raise ValueError("more than 65,536 texts in a batch")
    h, counts = hashed_words(texts, hashes)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), counts)
    x = np.sort((doc << np.uint64(48)) | (h >> np.uint64(16)))
    if not len(x):
        return x, counts
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    run = np.diff(np.append(first, len(x)))
    occurrence = (np.arange(len(x)) - np.repeat(first, run)).astype(np.uint64)
    word = x & np.uint64((1 << 48) - 1)
    return mix(word + (occurrence << np.uint64(48)) + np.uint64(0x9E3779B97F4A7C15)), counts
