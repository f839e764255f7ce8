"""Vectorised word splitting and hashing over Arrow string columns.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing
A-Z.  Each UTF-8 byte from 0x80 belongs to a word character, so the split works
on bytes and whole batches are handled by a few numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text handled by one numpy pass; bounds the memory of a task.
SLAB_BYTES = 1 << 20

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
_IS_WORD = ((LOWER >= 0x30) & (LOWER <= 0x39)) | ((LOWER >= 0x61) & (LOWER <= 0x7A)) | (LOWER >= 0x80)
_SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
#: 0 blank, 1 word character, 2 other
_CLASS = np.where(_SPACE, 0, np.where(_IS_WORD, 1, 2)).astype(np.uint8)
_BASE = 0x9E3779B97F4A7C15
_SALT = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)[LOWER]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLAB_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Slab:
    """The words of some consecutive rows.

    ``data`` holds their bytes, ``bounds`` the byte bounds of the rows, ``start``
    and ``end`` the byte bounds of the words, ``first`` the number of the first
    word of each row (one more at the end), ``hash`` a 64-bit hash for each word.
    With ``marks`` the runs of other non-blank bytes count as words as well.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, marks: bool = False):
        self.data, self.bounds = data, bounds
        kind = _CLASS[data]
        if not marks:
            kind = (kind == 1).view(np.uint8)
        edge = np.empty(len(data) + 1, bool)
        edge[0] = edge[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
        edge[bounds] = True
        cut = np.flatnonzero(edge)
        keep = kind[cut[:-1]] > 0
        self.start, self.end = cut[:-1][keep], cut[1:][keep]
        self.first = np.searchsorted(self.start, bounds)
        n = len(data)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_SALT[data] * _power(_BASE, n + 1)[:n], out=total[1:])
        back = _power(pow(_BASE, -1, 1 << 64), n + 1)
        self.hash = mix((total[self.end] - total[self.start]) * back[self.start] + (self.end - self.start).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return LOWER[self.data[self.start[i] : self.end[i]]].tobytes()

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words inside a row, and the number of the first word of each."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = chain([self.hash[j : m + j] for j in range(n)])
        left = np.repeat(self.first[1:], np.diff(self.first))[:m] - np.arange(m)
        at = np.flatnonzero(left >= n)
        return h[at], at


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """An order-sensitive hash of parallel arrays of word hashes."""
    h = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        h = h * np.uint64(0xD6E8FEB86659FD93) + part
    return mix(h)


def hash_words(text: str | None) -> np.ndarray:
    """The word hashes of one text."""
    slab = next(slabs(pa.array([text], pa.string())), None)
    return slab[1].hash if slab else np.zeros(0, np.uint64)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slabs(column: pa.Array, marks: bool = False) -> Iterator[tuple[slice, Slab]]:
    """Slabs of about SLAB_BYTES that cover the column, with the rows of each; a longer text is a slab of its own."""
    data, bounds = string_buffers(column)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLAB_BYTES, "right")) - 1)
        yield slice(i, j), Slab(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], marks)
        i = j


def find(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each value its place in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


class Sieve:
    """Sorted 64-bit keys behind a bitmap of fixed size, for many lookups of which few succeed."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.keys, self.shift = np.unique(keys.astype(np.uint64)), np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[self.keys >> self.shift] = True

    def hits(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which values are keys, and the place of each in ``keys``."""
        maybe = np.flatnonzero(self.seen[values >> self.shift])
        at = find(self.keys, values[maybe])
        return maybe[at >= 0], at[at >= 0]
