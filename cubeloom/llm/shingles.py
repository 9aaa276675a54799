"""Sets of word shingles: distinct hashes of runs of five words."""

from __future__ import annotations

import numpy as np

WORDS = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of a published generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text.

    A-Z count as a-z; words are runs of other characters than space and the controls 9 to 13. A text
    of fewer words than a shingle has one, its whole sequence; a text without words has none.
    """
    from xxhash import xxh3_64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, n)
    if n < words:
        one = np.array([n], np.uint64)
        for x in h:
            one = one * _STEP + x
        return mix(one)
    s = h[: n - words + 1].copy()
    for i in range(1, words):
        s *= _STEP
        s += h[i : n - words + 1 + i]
    return np.unique(mix(s))


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    from xxhash import xxh3_64_digest

    return int.from_bytes(xxh3_64_digest(shingles.tobytes()), "little", signed=True)
