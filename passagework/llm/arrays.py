"""Whole Arrow text columns as NumPy arrays: words, their hashes, and slices of bounded size.

Word hashes are 64 bits wide; two different words of one task collide with odds of about n^2 / 2^65.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at a time; a longer text is handled alone and whole.
SLICE_BYTES = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of units[s:e] for each pair: the sum of a mixed value for every unit and its place in the span.

    No sums of powers: those have fixed collisions, of a Thue-Morse word and its complement for one.
    """
    size = ends - starts
    stop = np.cumsum(size)
    sums = np.zeros((int(stop[-1]) if len(stop) else 0) + 1, np.uint64)
    if len(sums) > 1:
        every = np.arange(len(sums) - 1)
        place = every - np.repeat(stop - size, size)
        value = units[place + np.repeat(starts, size)].astype(np.uint64)
        value += (place.astype(np.uint64) + np.uint64(1)) << np.uint64(21)
        np.cumsum(mixed(value * np.uint64(0x9E3779B97F4A7C15)), out=sums[1:])
    return mixed(sums[stop] - sums[stop - size] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def lean(run: Callable) -> Callable:
    """A function on batches that gives freed memory back to the system at its end: Spark keeps its workers for the tasks that follow."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
            trim(0)

    return wrapped


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) with at most `limit` bytes of text, or one longer text; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = bounds(texts)
    row = 0
    while row < len(texts):
        after = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, texts.slice(row, after - row)
        row = after


def bounds(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large_string array, and where each text begins and the last one ends."""
    at = bounds(texts)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


class Words(NamedTuple):
    """Words `[^\\x20\\x09-\\x0D]+` of all texts in order."""

    data: np.ndarray  # bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of text i, words first[i] to first[i + 1]


def words(texts: pa.Array, lower: bool = False) -> Words:
    data, at = text_bytes(texts)
    if lower:
        data = LOWER[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(at), np.int64))
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    at_text = at[:-1][at[:-1] < len(data)]
    begins[at_text] = solid[at_text]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    last = at[1:][at[1:] > 0] - 1
    closes[last] = solid[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return Words(data, starts, ends, np.searchsorted(starts, at))


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
