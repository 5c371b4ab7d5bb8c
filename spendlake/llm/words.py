"""Word and shingle hashes of whole Arrow batches with array operations.

A word's hash is a polynomial over random byte values modulo 2**64, taken as a difference of running sums, so a batch
costs a fixed number of passes over its bytes whatever its words are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed in one go; a longer text is one chunk of its own.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fold_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def spaces() -> np.ndarray:
    """Bytes that end a word: space and the control characters from tab to carriage return."""
    t = np.ones(256, dtype=bool)
    t[[32, 9, 10, 11, 12, 13]] = False
    return t


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    def __init__(self, in_word: np.ndarray | None = None):
        self.in_word = spaces() if in_word is None else in_word
        self.values = _VALUES[fold_table()]
        self._powers(CHUNK)

    def _powers(self, n: int) -> None:
        self.up = np.cumprod(np.full(n, _BASE, dtype=np.uint64))
        self.down = np.cumprod(np.full(n, _INVERSE, dtype=np.uint64))

    def words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and per document the number of words before it (one entry more than documents)."""
        n = len(data)
        if n > len(self.up):
            self._powers(n)
        inside = self.in_word[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[bounds] = True
        before = np.empty(n, dtype=bool)
        before[:1] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(n, dtype=bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.up[:n], out=total[1:])
        h = (total[ends] - total[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(np.uint64)), np.searchsorted(starts, bounds)


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, ignoring document bounds."""
    n = len(h) - size + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    if n > 0:
        for k in range(size):
            out = mix(out * np.uint64(_BASE) + h[k : k + n])
    return out


def shingle_sets(hasher: WordHasher, texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text; a text of fewer words is one shingle, a wordless one has none."""
    for data, bounds in chunks(texts):
        h, at = hasher.words(data, bounds)
        s = runs(h, size)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= size:
                yield np.unique(s[a : b - size + 1])
            elif b > a:
                yield runs(h[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield s[:0]


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, document bounds in them) for runs of whole documents of about CHUNK bytes; null is empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    values = texts.buffers()[2]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
        b = min(b, n)
        yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
