"""Words, word hashes and shingles of whole texts, in numpy.

Words are maximal runs without the six ASCII white-space characters, after A-Z
are lower-cased; both hold for bytes, so texts are never decoded.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Words remembered by one Python worker; the memory is emptied beyond it, results don't change.
MEMORY = 1_000_000


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(text: str | None) -> list[bytes]:
    return utf8(text).lower().split()


#: Word hashes remembered by one worker, of words up to so many bytes: some 40 MB.
HASHES, LONGEST = 200_000, 64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= HASHES:
                self.clear()
            self[word] = value
        return value


_hashes = _Hashes()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive values, by position."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = mixed(out) + h[i:i + n]
    return mixed(out)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct ``k``-word shingles; a shorter text is one shingle, no words none."""
    h = word_hashes(words(text))
    if len(h) == 0:
        return h
    return np.unique(runs(h, k if len(h) >= k else len(h)))
