"""Hashed word shingles of whole texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
#: Words whose hash a task keeps.
WORD_CACHE = 100_000


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class WordHashes:
    """64-bit hashes of the words of a text, lower-cased A to Z and cut at the six ASCII white spaces."""

    def __init__(self) -> None:
        self._known: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        return self.hash_words((text or "").encode("utf-8", "surrogatepass").lower().split())

    def hash_words(self, words: list[bytes]) -> np.ndarray:
        known, digest = self._known, xxhash.xxh3_64_intdigest
        if len(known) > WORD_CACHE:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = digest(w)
                if len(w) <= 64:
                    known[w] = h
            out.append(h)
        return np.array(out, dtype=_U)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of the runs of ``width`` words; a shorter text is one run, an empty one has none."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    runs = np.zeros(n, dtype=_U)
    for k in range(min(width, len(words))):
        runs = scramble(runs + words[k : k + n] + _U(k + 1))
    return np.unique(runs)


class MinHashes:
    """Signatures of ``size`` coordinates, each the least of a multiply-add hash over the set, in 64 bits."""

    def __init__(self, size: int, seed: int) -> None:
        draw = np.random.default_rng(seed).integers(0, 2**63, size=(size, 2), dtype=np.int64).astype(_U)
        self._factor, self._shift = draw[:, 0] * _U(2) + _U(1), draw[:, 1]

    def of(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row per set; none of the sets may be empty."""
        items = np.concatenate(sets)
        starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
        out = np.empty((len(sets), len(self._factor)), dtype=np.int64)
        for k, (factor, shift) in enumerate(zip(self._factor, self._shift, strict=True)):
            out[:, k] = np.minimum.reduceat(items * factor + shift, starts).view(np.int64)
        return out
