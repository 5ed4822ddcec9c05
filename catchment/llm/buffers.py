"""Arrow text columns as numpy byte buffers, and their words.

Texts stay UTF-8 bytes in one buffer with an offset per row; no Python string
is made per word.  Work runs over slices of about a megabyte, so arrays stay
in cache and memory does not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text makes a slice of its own.
SLICE = 1 << 20

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; nulls count as empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    arr = pc.fill_null(col.cast(pa.large_string()), "")
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges ``[a, b)`` of about ``size`` bytes each."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class WordHasher:
    """64-bit hashes of the words of texts: A-Z lower-cased, a word being a
    maximal run of digits, letters a-z and non-ASCII characters."""

    #: Odd multiplier and its inverse modulo 2**64.
    STEP = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        byte = np.arange(256)
        lower = np.where((byte >= 0x41) & (byte <= 0x5A), byte + 32, byte)
        self.is_word = ((byte >= 0x30) & (byte <= 0x39)) | ((lower >= 0x61) & (lower <= 0x7A)) | (byte >= 0x80)
        values = mix((lower.astype(np.uint64) + np.uint64(1)) * np.uint64(self.STEP))
        self.values = np.where(self.is_word, values, np.uint64(0))
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        def powers(base: int) -> np.ndarray:
            p = np.full(n, base, np.uint64)
            p[0] = 1
            return np.multiply.accumulate(p)

        self.up, self.down = powers(self.STEP), powers(pow(self.STEP, -1, 1 << 64))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(hash of each word, first word of each row plus the end)``."""
        n, rows = len(data), len(offsets) - 1
        if not n:
            return np.empty(0, np.uint64), np.zeros(rows + 1, np.int64)
        if n > len(self.up):
            self._grow(1 << (n - 1).bit_length())
        inside = self.is_word[data]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        at = offsets[:-1][offsets[:-1] < n]
        start[at] = inside[at]
        starts = np.flatnonzero(start)
        if not len(starts):
            return np.empty(0, np.uint64), np.zeros(rows + 1, np.int64)
        sums = np.add.reduceat(self.values[data] * self.up[:n], starts)
        return mix(sums * self.down[starts]), np.searchsorted(starts, offsets)
