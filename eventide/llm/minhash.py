"""MinHash bands over sets of 64-bit values, in numpy."""

from __future__ import annotations

import numpy as np

from eventide.llm.words import mixed

CHUNK = 4096


class Bands:
    """``bands`` keys of ``rows`` minima each.

    Two sets of Jaccard similarity s share a key with probability
    1 - (1 - s**rows)**bands.
    """

    def __init__(self, bands: int, rows: int, seed: int = 1):
        self.bands, self.rows = bands, rows
        raw = mixed(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.scale = (raw[:bands * rows] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
        self.shift = (raw[bands * rows:] >> np.uint64(32)).astype(np.uint32)[:, None]

    def keys(self, values: np.ndarray) -> np.ndarray:
        low = (values >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), CHUNK):
            part = low[None, at:at + CHUNK] * self.scale
            part += self.shift
            np.minimum(least, part.min(axis=1), out=least)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for column in least.reshape(self.bands, self.rows).T:
            key = mixed(key + column.astype(np.uint64))
        return key.view(np.int64)

    def keys_of(self, values: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
        """Keys of slices [start, end) of ``values``, one row each, none of them zero."""
        low = (values >> np.uint64(32)).astype(np.uint32)
        edges = np.array(spans, np.int64).ravel()
        least = np.empty((len(spans), self.bands * self.rows), np.uint32)
        step = max(1, (1 << 18) // max(1, len(low)))
        for at in range(0, self.bands * self.rows, step):
            part = low[None] * self.scale[at:at + step]
            part += self.shift[at:at + step]
            # A last column, so that a slice may end with the values.
            part = np.concatenate([part, part[:, -1:]], axis=1)
            least[:, at:at + step] = np.minimum.reduceat(part, edges, axis=1)[:, ::2].T
        key = np.tile(np.arange(1, self.bands + 1, dtype=np.uint64), (len(spans), 1))
        for column in least.reshape(len(spans), self.bands, self.rows).transpose(2, 0, 1):
            key = mixed(key + column.astype(np.uint64))
        return np.maximum(key, np.uint64(1)).view(np.int64)

    def missed(self, similarity: float) -> float:
        """Probability that a pair of this similarity shares no key."""
        return (1 - similarity ** self.rows) ** self.bands
