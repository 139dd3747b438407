"""Fingerprints of words and word windows, in NumPy."""

from __future__ import annotations

import numpy as np

from glyphmill.llm.common import claim

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
#: Words whose fingerprints a worker keeps; a full cache is emptied.
CACHE = 250_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (the splitmix64 finaliser)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


class WordHashes(dict):
    """64-bit fingerprints of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    claim("words", _HASHES.clear)
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all windows of n words; of the whole sequence where it is shorter; none of no words.

    Word order counts. Word fingerprints are random, so their odd-weighted sums agree by chance only, about 2**-64.
    """
    if len(h) == 0:
        return h
    size = min(n, len(h))
    count = len(h) - size + 1
    out = np.full(count, size, np.uint64)
    for k in range(size):
        out = out * _ODD + h[k : k + count]
    return mix(out)
