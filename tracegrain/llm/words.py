"""Words and word windows of whole Arrow text columns, hashed without a Python loop over words.

A word is a run of bytes other than space and tab to carriage return (`[^\\x20\\x09-\\x0D]+`). A text column is cut
into pieces of a few megabytes, so the working arrays stay bounded however many rows a batch has; one text is never cut.
Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# Breaks for normalised words: white space and ASCII punctuation.
PUNCTUATION = _SPACE.copy()
PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_BASE, _WORD_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)  # odd, so they have inverses modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits, so that sums of powers leave no pattern in the low bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """base**i and base**-i modulo 2**64, grown on demand and kept for the life of a worker."""

    def __init__(self, base: np.uint64):
        self.bases = (int(base), pow(int(base), -1, 1 << 64))
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tables[0]) < n:
            size = max(n, 1 << 16, min(2 * len(self.tables[0]), PIECE_BYTES + 1))
            for k, base in enumerate(self.bases):
                steps = np.full(size, base & (1 << 64) - 1, np.uint64)
                steps[0] = 1
                self.tables[k] = np.multiply.accumulate(steps)
        return self.tables[0][:n], self.tables[1][:n]


_BYTES, _WORDS = Powers(_BYTE_BASE), Powers(_WORD_BASE)


def span_hashes(items: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """The polynomial hash of items[starts:ends], for each pair, from prefix sums; position-free."""
    up, down = powers.upto(len(items) + 1)
    sums = np.empty(len(items) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(items * up[: len(items)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


@dataclass
class Words:
    """The words of some consecutive rows. Row i of them has words first[i] to first[i + 1]."""

    row: int  # of the first text, in the column
    data: np.ndarray  # the UTF-8 bytes of the texts, one after another
    text_at: np.ndarray  # where each text starts in data; one more at the end
    starts: np.ndarray  # of each word, in data
    ends: np.ndarray
    first: np.ndarray
    _hashes: np.ndarray | None = None

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hashes(self) -> np.ndarray:
        """64 bits for each word; the length takes part, so trailing zero bytes count."""
        if self._hashes is None:
            h = span_hashes(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, _BYTES)
            self._hashes = mix(h ^ (self.ends - self.starts).astype(np.uint64))
        return self._hashes

    def owner(self) -> np.ndarray:
        """The row of each word, from 0."""
        return np.repeat(np.arange(self.rows), self.counts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of `size` words within one text: first word, 64-bit hash, and per row where its windows start (one more at the end)."""
        counts = np.maximum(self.counts - size + 1, 0)
        at = np.concatenate([[0], np.cumsum(counts)])
        begin = np.arange(at[-1]) + np.repeat(self.first[:-1] - at[:-1], counts)
        return begin, self.span_hashes(begin, begin + size), at

    def span_hashes(self, begin: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        """64 bits for each word sequence; another salt gives an independent hash."""
        items = mix(self.hashes + np.uint64(salt)) if salt else self.hashes
        return mix(span_hashes(items, begin, end, _WORDS))


def column_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows; null rows are empty) and bytes of a string or binary column, without copying the bytes."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    return offsets, np.frombuffer(body, np.uint8) if body else np.zeros(0, np.uint8)


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most `limit` bytes, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def column_words(column: pa.Array, fold: bool = False, breaks: np.ndarray = _SPACE) -> Iterator[Words]:
    """The words of a text column, a few megabytes of text at a time. fold lower-cases A-Z; breaks says which bytes are not in words."""
    offsets, body = column_buffers(column)
    for i, j in pieces(offsets):
        data = body[offsets[i] : offsets[j]]
        if fold:
            data = _FOLD[data]
        text_at = offsets[i : j + 1] - offsets[i]
        yield Words(i, data, text_at, *bounds(data, text_at, breaks))


def bounds(data: np.ndarray, text_at: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each text. A text's end ends a word."""
    inside = ~breaks[data]
    edge = np.zeros(len(data), bool)
    edge[text_at[:-1][text_at[:-1] < len(data)]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, text_at)
