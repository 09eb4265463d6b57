"""Helpers inside tasks: words of whole texts as 64-bit hashes, in numpy.

A word is a run of bytes other than space and \\t \\n \\x0b \\f \\r (`[^\\x20\\x09-\\x0D]+`).
Texts of an Arrow batch are taken in runs of about a megabyte, so memory follows the longest
text and not the batch.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RUN_BYTES = 1 << 20
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[[9, 10, 11, 12, 13, 32]] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(texts: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte bounds of each row) of a column of texts; null is empty."""
    column = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        end = int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1
        end = min(max(end, start + 1), len(column))
        own = bounds[start : end + 1]
        yield start, end, raw[own[0] : own[-1]], own - own[0]
        start = end


def pieces(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each piece of `data`; pieces begin at `first` and blanks count for nothing."""
    if not len(first):
        return np.zeros(0, np.uint64)
    sizes = np.diff(np.append(first, len(data)))
    place = np.arange(first[0], len(data)) - np.repeat(first, sizes)
    powers = np.full(int(sizes.max()) + 1, _STEP)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    return mix(np.add.reduceat(_BYTE[data[first[0] :]] * powers[place], first - first[0]))


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word with the end, byte where it begins)."""
    full = ~BLANK[data]
    begins = full.copy()
    begins[1:] &= ~full[:-1]
    edge = bounds[:-1][bounds[:-1] < len(data)]
    begins[edge] = full[edge]
    starts = np.flatnonzero(begins)
    return pieces(data, starts), np.searchsorted(starts, bounds), starts


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of `width` words inside a text, index of each text's first run)."""
    counts = np.diff(first)
    starts = np.maximum(counts - width + 1, 0)
    at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(starts)[:-1]]), starts) + np.arange(starts.sum())
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        total += hashes[at + k] * _PLACE[k % 64]
    return mix(total), np.concatenate([[0], np.cumsum(starts)])


def sequence(hashes: np.ndarray) -> np.uint64:
    """Hash of a short sequence of words, told apart from every window by its length."""
    terms = np.append(hashes * _PLACE[: len(hashes)], _PLACE[63:] * np.uint64(len(hashes)))
    return mix(np.add.reduce(terms, keepdims=True))[0]


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct `width`-word shingles of each text; a shorter text is one shingle."""
    hashes, first, _ = words(LOWER[data], bounds)
    grams, own = windows(hashes, first, width)
    sets = []
    for i in range(len(bounds) - 1):
        mine = hashes[first[i] : first[i + 1]]
        if not len(mine):
            sets.append(np.zeros(0, np.uint64))
        elif len(mine) < width:
            sets.append(np.asarray([sequence(mine)]))
        else:
            sets.append(np.unique(grams[own[i] : own[i + 1]]))
    return sets


class Kept:
    """Values of recently used keys in two generations: the older goes when the newer is full,
    so what is used often stays and memory is bounded."""

    def __init__(self, most: int):
        self.new: dict = {}
        self.old: dict = {}
        self.most = most

    def missing(self, keys: set) -> list:
        """Keys without a value; the others can then be read from `new`."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        out = keys - self.new.keys()
        known = out & self.old.keys()
        self.new.update((key, self.old[key]) for key in known)
        return list(out - known)


_HELD: dict[str, tuple] = {}


def held(name: str, path: str, make: Callable[[], Any]) -> Any:
    """What `make` builds from a file, held by the Python worker for its later tasks: one value
    a name, built anew when another file is asked for or the file has changed."""
    stat = os.stat(path)
    mark = (path, stat.st_mtime_ns, stat.st_size)
    if name not in _HELD or _HELD[name][0] != mark:
        _HELD[name] = (mark, make())
    return _HELD[name][1]


def slim(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that clashing extra ones can't matter."""
    return df.select(*[df[c] for c in columns])


# Bytes of terms (digits, Latin letters in lower case, all beyond ASCII); any other is a blank.
TERM = LOWER.copy()
TERM[[b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]] = 32
