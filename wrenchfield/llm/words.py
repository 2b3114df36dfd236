"""Vectorised words, word hashes and word windows over Arrow string columns (runs inside Spark tasks).

A word is a maximal run of bytes outside {0x20, 0x09-0x0D}; words never span two texts. Null texts have no words.
A word's 64-bit hash is a polynomial over random byte values, and a window's hash is a polynomial over its words'
hashes, so both come from prefix sums: a few nanoseconds a byte, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20_240_229).integers(1, 2**63, 256, dtype=np.uint64)
_BASE, _WINDOW_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
SLICE_BYTES = 2 << 20
#: For split(): all but letters separates; bytes of other scripts count as letters.
NOT_LETTERS = np.ones(256, dtype=bool)
NOT_LETTERS[0x80:] = NOT_LETTERS[ord("A") : ord("Z") + 1] = NOT_LETTERS[ord("a") : ord("z") + 1] = False
#: For split(): a line's end separates.
LINE_END = np.zeros(256, dtype=bool)
LINE_END[[0x0A, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 2**64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 2**64))])
        return self.up, self.down


_BYTES, _WINDOWS = _Powers(_BASE), _Powers(_WINDOW_BASE)


def _ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray, powers: _Powers) -> np.ndarray:
    """Polynomial hashes of values[start:end], the same wherever a range stands."""
    up, down = powers.get(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] ^ ((end - start).astype(np.uint64) << np.uint64(40)))


@dataclass
class Words:
    raw: np.ndarray  # bytes of all texts, as they stand
    start: np.ndarray  # of each word, in raw
    end: np.ndarray
    at: np.ndarray  # words at[i]:at[i + 1] are text i's
    hash: np.ndarray  # uint64

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.at)

    @property
    def text(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.at) - 1), self.count)

    def windows(self, k: int, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """hash, first word and text of each window of k consecutive words of one text."""
        n = np.maximum(self.count - k + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        first = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + self.at[:-1][text]
        return _ranges(self.hash if values is None else values, first, first + k, _WINDOWS), first, text

    def spans(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words first:end."""
        return _ranges(self.hash, first, end, _WINDOWS)

    def heads(self, size: int) -> np.ndarray:
        """Hashes of the words' first `size` bytes, lower-cased."""
        return _ranges(_BYTE[_FOLD[self.raw]], self.start, np.minimum(self.end, self.start + size), _BYTES)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and their n + 1 offsets."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def split(column: pa.Array, lower: bool, gaps: np.ndarray = SPACE) -> Words:
    raw, at = buffers(column)
    text = ~gaps[raw]
    begins, ends = text.copy(), text.copy()
    begins[1:] &= ~text[:-1]
    ends[:-1] &= ~text[1:]
    edge = at[(at > 0) & (at < len(raw))]
    begins[edge] = text[edge]
    ends[edge - 1] = text[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    value = _BYTE[_FOLD[raw] if lower else raw]
    return Words(raw, start, end, np.searchsorted(start, at), _ranges(value, start, end, _BYTES))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text, so that memory holds whatever a batch brings."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = buffers(batch.column(batch.schema.get_field_index(column)))[1][1:]
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def lists(values: np.ndarray, count: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = np.zeros(len(count) + 1, dtype=np.int32)
    np.cumsum(count, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, type=kind))
