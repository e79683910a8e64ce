"""Word and shingle hashes of whole Arrow string columns in NumPy.

The bytes of many texts are hashed together: a polynomial prefix sum modulo
2**64 gives each word's hash by one subtraction and one multiplication with the
inverse power of its start, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Texts are hashed in runs of about so many bytes (a longer text makes a run of its own).
RUN_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _byte_values(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[ord("A") : ord("Z") + 1] += np.uint64(32)
    return mix(codes + np.uint64(0x1234567)) | np.uint64(1)


_VALUES = {True: _byte_values(True), False: _byte_values(False)}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, RUN_BYTES + 1)
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        have = np.multiply.accumulate(factors)
        if size <= 4 * RUN_BYTES:
            _powers[base] = have
    return have[:n]


def piece_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """Hash of each piece data[start : end]; equal pieces, and in practice only they, have equal ones."""
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[lower][data] * _power(_BASE, n), out=prefix[1:])
    value = (prefix[end] - prefix[start]) * _power(_INVERSE, n + 1)[start]
    return mix(value + (end - start).astype(np.uint64))


class Words:
    """The words of a run of texts: hash, text (index in the run), first byte and end byte."""

    __slots__ = ("hash", "text", "start", "end", "first", "count", "data", "origin")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.data, self.origin = data, offsets
        n = len(data)
        inside = ~_SPACE[data]
        begins = inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            heads = offsets[:-1][offsets[:-1] < n]
            begins[heads] = inside[heads]
            ends = inside.copy()
            ends[:-1] &= ~inside[1:]
            tails = offsets[1:][offsets[1:] > 0] - 1
            ends[tails] = inside[tails]
            self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.hash = piece_hashes(data, self.start, self.end, lower)
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        texts = len(offsets) - 1
        self.count = np.bincount(self.text, minlength=texts)
        self.first = np.zeros(texts + 1, np.int64)
        np.cumsum(self.count, out=self.first[1:])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of k words in one text, and the index of its first word."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            total *= np.uint64(0xD6E8FEB86659FD93)
            total += self.hash[j : n - k + 1 + j]
        whole = np.flatnonzero(self.text[: n - k + 1] == self.text[k - 1 :])
        return mix(total[whole]), whole


def runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of about RUN_BYTES; null texts are empty."""
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + RUN_BYTES, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
