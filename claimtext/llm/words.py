"""Vectorised words of text columns: numpy over Arrow's own byte buffers.

A chunk of rows is one byte array with row offsets.  Words are maximal runs
of word bytes inside a row.  UTF-8 bytes of 0x80 and more are word bytes in
every word rule used here, so words of bytes are words of characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = _IDENTITY.copy()
LOWER[65:91] += 32
BY_SPACE = np.ones(256, dtype=bool)  # [^\x20\x09-\x0D]
BY_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] of lower-cased text
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
                                  else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; at least one row each, no row is split."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """Words of rows i to j: ``text`` has each word followed by one space."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rule: np.ndarray, fold: np.ndarray = _IDENTITY):
        at = offsets - offsets[0]
        raw = data[offsets[0]:offsets[-1]]
        inside = rule[fold[raw]]
        begins = at[1:-1]
        begins = begins[(begins > 0) & (begins < len(raw))]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[begins] = False
        after[begins - 1] = False
        first = inside & ~before
        starts = np.flatnonzero(first)
        self.length = np.flatnonzero(inside & ~after) + 1 - starts
        #: index of each row's first word, then the number of words
        self.first = np.searchsorted(starts, at)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(at) - 1), self.count)
        where = np.flatnonzero(inside)
        self.text = np.full(len(where) + len(starts), 32, np.uint8)
        self.text[np.arange(len(where)) + (np.cumsum(first)[where] - 1)] = fold[raw[where]]
        self.end = np.cumsum(self.length + 1) - 1
        self.start = self.end - self.length

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, equal for equal words in any chunk."""
        return mix(spans_hash(self.text.astype(np.uint64) + np.uint64(1), self.start, self.end)
                   + self.length.astype(np.uint64))


_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), CHUNK_BYTES)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors)
    return _powers


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash modulo 2**64 of values[start:end], all spans at once."""
    up, down = _power(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=total[1:])
    return (total[end] - total[start]) * down[start]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    have, out = 1, values
    while 2 * have <= width:
        out = np.minimum(out[:len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[:len(out) - (width - have)], out[width - have:])
    return out


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mask of the n places that lie in any half-open span."""
    steps = np.bincount(start, minlength=n + 1)[:n + 1] - np.bincount(end, minlength=n + 1)[:n + 1]
    return np.cumsum(steps[:n]) > 0


def per_row(words: Words, mask: np.ndarray) -> np.ndarray:
    """How many words of each row the mask has."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[words.first[1:]] - total[words.first[:-1]]
