"""Words of many texts at once, as numpy arrays over the texts' UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The bytes that separate words, 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20_240_501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    """Words in text order: first and last-plus-one byte, 64-bit hash; ``bounds[i]:bounds[i + 1]`` are text i's."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and the n + 1 offsets of its texts; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes, at least one text each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to
        at = to


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1) - 1, base, np.uint64)]), dtype=np.uint64)


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, last byte plus one, and bounds per text, of the words of texts laid end to end."""
    inside = ~space[data]
    before = np.empty(len(data), bool)
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    if len(data):
        after[:-1] = inside[1:]
        last = offsets[1:] - 1
        after[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def words(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = LOWER, space: np.ndarray = SPACE) -> Words:
    """Words of texts laid end to end. The hash reads the bytes as ``fold`` maps them; equal words hash alike anywhere."""
    start, end, bounds = spans(data, offsets, space)
    if not len(start):
        return Words(start, end, np.zeros(0, np.uint64), bounds)
    size = (end - start).astype(np.int32)
    at = np.cumsum(size) - size
    within = np.arange(int(at[-1] + size[-1]), dtype=np.int32) - np.repeat(at.astype(np.int32), size)
    values = _BYTE[fold][data[~space[data]]] * powers(_BASE, int(size.max()))[within]
    return Words(start, end, mix(np.add.reduceat(values, at) + size.astype(np.uint64)), bounds)


def prefix_hashes(data: np.ndarray, found: Words, length: int, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of at least ``length`` bytes, and the hash of their first ``length`` bytes."""
    long = np.flatnonzero(found.end - found.start >= length)
    total = np.zeros(len(long), np.uint64)
    scale = powers(_BASE, length)
    for k in range(length):
        total += _BYTE[fold[data[found.start[long] + k]]] * scale[k]
    return long, mix(total + np.uint64(length * 0xD1B54A32D192ED03 % 2**64))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` words in a row; the order of the words counts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _BASE + hashes[k : k + n]
    return mix(out)


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """A text's sorted distinct shingle hashes; fewer than ``width`` words are one shingle, no words none."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(hashes, min(width, len(hashes))) + np.uint64(min(width, len(hashes)) % width))
