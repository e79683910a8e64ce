"""Runs of letters of whole Arrow string columns in NumPy: where they stand, their hashes, and their strings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .textvec import mix, piece_hashes, runs

#: Texts are counted in stretches of about so many bytes (a longer text makes one of its own).
STRETCH_BYTES = 8 << 20

_ASCII = np.zeros(256, bool)
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_WIDE = _ASCII.copy()
_WIDE[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def latin_mask(data: np.ndarray) -> np.ndarray:
    """Bytes of [A-Za-z\\u00C0-\\u00FF]: in UTF-8 the latter are those that begin with C3."""
    inside = _ASCII[data] | (data == 0xC3)
    inside[1:] |= data[:-1] == 0xC3
    return inside


def wide_mask(data: np.ndarray) -> np.ndarray:
    """Bytes of [^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]: ASCII letters and all that is not ASCII."""
    return _WIDE[data]


@dataclass
class Stretch:
    """Runs of letters of consecutive rows: text (row, from ``first``), first byte, end byte, hash when lower-cased (A-Z)."""

    first: int
    rows: int
    data: np.ndarray
    text_start: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def stretches(column: pa.Array, mask, size: int = STRETCH_BYTES) -> Iterator[Stretch]:
    """The runs of the bytes that ``mask`` marks, of all rows; null texts have none."""
    held: list[tuple] = []

    def joined() -> Stretch:
        base = np.cumsum([0, *[len(h[2]) for h in held]])
        cat = lambda k, shift: np.concatenate([h[k] + s for h, s in zip(held, shift)])
        return Stretch(held[0][0], held[-1][1] - held[0][0], np.concatenate([h[2] for h in held]), cat(7, base), cat(3, [h[0] - held[0][0] for h in held]), cat(4, base), cat(5, base), np.concatenate([h[6] for h in held]))

    for i, j, data, offsets in runs(column):
        inside = mask(data)
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        heads, tails = offsets[:-1][offsets[:-1] < len(data)], offsets[1:][offsets[1:] > 0] - 1
        begins[heads], ends[tails] = inside[heads], inside[tails]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        held.append((i, j, data, np.searchsorted(offsets, start, side="right") - 1, start, end, piece_hashes(data, start, end, True), offsets[:-1]))
        if sum(len(h[2]) for h in held) >= size:
            yield joined()
            held = []
    if held:
        yield joined()


def distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of equal keys (compared by 64 mixed bits): the first of each, and the class of every row."""
    key = keys[0].astype(np.uint64)
    for other in keys[1:]:
        key = mix(key + other.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    return first, which


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes of pieces one after the other, and their offsets."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], end - start)
    return _LOWER[data[at]], offsets


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The pieces, lower-cased, as an Arrow column."""
    out, offsets = gathered(data, start, end)
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.string())
