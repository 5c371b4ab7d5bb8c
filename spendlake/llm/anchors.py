"""Content-defined anchors of all windows of a fixed length, with array operations.

The anchor of a window is the place in it whose gram has the smallest hash, the leftmost of equals. It depends on the
window's bytes alone, so equal windows have their anchors at equal distances from their starts.
"""

from __future__ import annotations

import numpy as np

from spendlake.llm.words import _BASE, _INVERSE, _VALUES, mix

#: Bytes handled at once; places within a segment take so many bits of a key.
PLACE_BITS = 20
SEGMENT = 1 << PLACE_BITS


class ByteHasher:
    """Hashes of any stretch of a byte array after one pass over it."""

    _up = np.cumprod(np.full(SEGMENT, _BASE, dtype=np.uint64))
    _down = np.cumprod(np.full(SEGMENT, _INVERSE, dtype=np.uint64))

    def __init__(self, data: np.ndarray):
        self.total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[data] * self._up[: len(data)], out=self.total[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of data[start:stop]; no stretch may be empty."""
        return mix((self.total[stop] - self.total[start]) * self._down[start] + (stop - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.total) - k
        return mix((self.total[k:] - self.total[:n]) * self._down[:n])


def window_anchors(hasher: ByteHasher, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, gram hash) per anchor, for all windows of one segment."""
    n = len(hasher.total) - window
    if n <= 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty.astype(np.uint64)
    g, width = hasher.grams(gram), window - gram + 1
    key = (g & ~np.uint64(SEGMENT - 1)) | np.arange(len(g), dtype=np.uint64)
    pad = -len(key) % width
    rows = np.concatenate((key, np.full(pad, ~np.uint64(0)))).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    anchor = (least[first] & np.uint64(SEGMENT - 1)).astype(np.int64)
    return anchor, first, np.r_[first[1:], n] - 1, g[anchor]
