"""Word and hash helpers shared by the operators; they run on one text inside a task."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the shingle hash, one per word of a shingle.
_MULTIPLIERS = np.random.default_rng(20240101).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], dtype=np.uint64)


def shingle_hashes(words: list[bytes], width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; a shorter sequence is one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    k = min(width, len(h))
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out += h[i : i + n] * _MULTIPLIERS[i]
    return np.unique(mix(out))
