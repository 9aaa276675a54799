"""Words of a text as sparse features, shared by the classifiers."""

from __future__ import annotations

import re
import zlib

import numpy as np

_WORD = re.compile(r"[^\W\d_]+")


def weigh(count: np.ndarray, total: int) -> np.ndarray:
    """Counts damped by repetition and, less, by the text's length: a word counts in a long text too."""
    return np.sqrt(count) / max(1, total) ** 0.25


class HashedWords:
    """Counts of a text's lower-case words by hash; the hashes of words met are remembered, up to a bound."""

    def __init__(self, bits: int, max_words: int = 200_000):
        self.mask, self.max_words = (1 << bits) - 1, max_words
        self.known: dict[str, int] = {}

    def indices(self, text: str | None) -> np.ndarray:
        """One index per word, in order."""
        words = _WORD.findall((text or "").lower())
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > self.max_words:
                self.known.clear()
            for w in {w for w, i in zip(words, found, strict=True) if i is None}:
                self.known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) & self.mask
            found = [self.known.get(w, i) for w, i in zip(words, found, strict=True)]
        return np.array(found, np.int64)

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct indices and their weights."""
        index, count = np.unique(self.indices(text), return_counts=True)
        return index, weigh(count, count.sum())
