"""Count-min sketches of 64-bit keys, built by all tasks and merged, as a filter for keys that occur often enough.

A task folds its keys into sparse counters, which meet by range of cells and are added up there; only the bit "reached `times`" of
each cell is kept. Counts in a sketch are never too low, so the filter passes every key that occurs `times` or more, and
some others. Its size follows the number of keys (BITS_PER_KEY cells each in every row of the sketch) up to MAX_BITS cells a
row, 8 MB, unless the caller sets another bound; that is what is sent to the executors. Past that size it passes more keys than it
need, never fewer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.llm.words import mix
from tracegrain.session import cut_lineage

DEPTH = 2
BITS_PER_KEY = 16
MAX_BITS = 1 << 26
_SHARD_BITS = 5
_FOLD_AT = 1 << 20  # keys a task gathers before it folds them
_HOT_FOLD = 4  # the filter of hot keys has so many bits less
_SCHEMA = "line int, shard int, n int, cells binary, counts binary"


def _line(mixed: np.ndarray, line: int) -> np.ndarray:
    return (mixed >> np.uint64(32)).astype(np.uint32) if line == 0 else mixed.astype(np.uint32)


def _mixed(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ np.uint64(0x5851F42D4C957F2D))


def _fold(keys: list[np.ndarray], lines: int) -> Iterator[pa.RecordBatch]:
    """Sorted cells as packed differences, with their counts up to 255."""
    found, counts = np.unique(_mixed(np.concatenate(keys)), return_counts=True)
    counts = np.minimum(counts, 255).astype(np.uint8)
    for line in range(lines):
        cells, mine = _line(found, line), counts
        if line:
            order = np.argsort(cells)
            cells, mine = cells[order], counts[order]
        cuts = np.searchsorted(cells, (np.arange(1, 1 << _SHARD_BITS, dtype=np.uint64) << np.uint64(32 - _SHARD_BITS)).astype(np.uint32))
        for shard, (c, n) in enumerate(zip(np.split(cells, cuts), np.split(mine, cuts))):
            if len(c):
                packed = pa.compress(np.diff(c, prepend=np.uint32(0)).tobytes(), codec="zstd", asbytes=True), pa.compress(n.tobytes(), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([line], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(c)], pa.int32()), *(pa.array([p], pa.binary()) for p in packed)], ["line", "shard", "n", "cells", "counts"])


def _merge(batches: Iterator[pa.RecordBatch], bits: int, times: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by line and shard in; the bitmaps of each out. One shard's counters are held at a time."""
    now, total = None, None
    width = 1 << (bits - _SHARD_BITS)

    def done() -> pa.RecordBatch:
        high = np.packbits((total >= hot).reshape(-1, 1 << _HOT_FOLD).any(1)).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([np.packbits(total >= times).tobytes()], pa.binary()), pa.array([high], pa.binary())], ["line", "shard", "bitmap", "high"])

    for b in batches:
        for r in range(b.num_rows):
            line, shard, n = (b.column(i)[r].as_py() for i in range(3))
            if (line, shard) != now:
                if now is not None:
                    yield done()
                now, total = (line, shard), np.zeros(width, np.uint8)
            cells = np.frombuffer(pa.decompress(b.column(3)[r].as_py(), 4 * n, codec="zstd"), np.uint32).cumsum(dtype=np.uint32)
            counts = np.frombuffer(pa.decompress(b.column(4)[r].as_py(), n, codec="zstd"), np.uint8)
            at = (cells >> np.uint32(32 - bits)) - np.uint32(shard * width)
            # Equal cells are neighbours: add them up first.
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            total[at[first]] = np.minimum(total[at[first]] + np.add.reduceat(counts.astype(np.int64), first), 255)
    if now is not None:
        yield done()


class Filter:
    """Which keys may occur `times` or more."""

    def __init__(self, bits: int, bitmaps: Broadcast):
        self.bits, self.bitmaps = bits, bitmaps

    def mask(self, keys: np.ndarray) -> np.ndarray:
        out, mixed = np.ones(len(keys), bool), _mixed(keys)
        for line, bitmap in enumerate(self.bitmaps.value):
            at = _line(mixed, line) >> np.uint32(32 - self.bits)
            bitmap = np.frombuffer(bitmap, np.uint8)
            out &= (bitmap[at >> np.uint32(3)] >> (np.uint8(7) - (at & np.uint32(7)).astype(np.uint8))) & 1 == 1
        return out


def key_filters(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], times: int, hot: int = 255, bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_BITS, lines: int = DEPTH) -> tuple[Filter, Filter]:
    """Filters for the keys that may occur `times`, and `hot` times (255 at most), or more. keys_of() takes keys from the rows' Arrow
    batches, each as often as it is to count."""
    spark = rows.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for keys in keys_of(b):
                held.append(keys)
                size += len(keys)
                if size >= _FOLD_AT:
                    yield from _fold(held, lines)
                    held, size = [], 0
        if size:
            yield from _fold(held, lines)

    parts = cut_lineage(rows.mapInArrow(count, _SCHEMA))
    keys = (parts.agg(F.sum("n")).first()[0] or 0) // lines
    bits = max(16, min(max_bits.bit_length() - 1, int(keys * bits_per_key).bit_length()))
    merged = (parts.repartition("line", "shard").sortWithinPartitions("line", "shard")
              .mapInArrow(lambda b: _merge(b, bits, times, hot), "line int, shard int, bitmap binary, high binary"))
    found = merged.collect()  # max_bits / 8 bytes a line at most, and a sixteenth of that
    out = []
    for name, size in (("bitmap", bits), ("high", bits - _HOT_FOLD)):
        whole, part = [bytearray(1 << (size - 3)) for _ in range(lines)], 1 << (size - _SHARD_BITS - 3)
        for r in found:
            whole[r["line"]][r["shard"] * part : (r["shard"] + 1) * part] = r[name]
        out.append(Filter(size, spark.sparkContext.broadcast(whole)))
    return out[0], out[1]


def key_filter(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], times: int, bits_per_key: int = BITS_PER_KEY) -> Filter:
    """A filter for the keys that may occur `times` or more."""
    return key_filters(rows, keys_of, times, bits_per_key=bits_per_key)[0]
