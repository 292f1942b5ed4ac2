"""Substring dedup: words covered by a window that also starts in a document with a smaller id are removed.

1. Every window of `size` words is counted by its anchor, the least hash among the runs of ANCHOR words in it. Equal windows have equal anchors, so
   an anchor occurs in at least as many documents as any of its windows. The tasks' count-min sketches of anchors (once for each
   document) are merged; a sketch never counts too low. A window whose anchor is not estimated in two documents is in one only.
2. The other windows are grouped exactly, by 128 bits of their words, each group keeping its smallest document: a partial aggregate, so the
   many copies of a hot passage meet as one row a task.
3. A window is kept by its smallest document. These go back to the documents, as one list each, and what is estimated as repeated and not
   in a document's own list is cut from it.

Defined results: a null or empty text has no words; texts under `size` words have no windows and stay whole; rows with the same id do not remove each
other's words; rows without an id are left whole and remove nothing. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrain.llm.sketch import Filter, key_filter
from tracegrain.llm.words import Words, column_words, mix

WINDOW = 50
ANCHOR = 16


def anchors(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of `size` words: its first word, its anchor; and per row where its windows start."""
    run = min(ANCHOR, size)
    n = len(w.starts)
    counts = np.maximum(w.counts - size + 1, 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    begin = np.arange(at[-1]) + np.repeat(w.first[:-1] - at[:-1], counts)
    if not len(begin):
        return begin, np.zeros(0, np.uint64), at
    first = np.arange(n - run + 1)
    least = mix(w.span_hashes(first, first + run, salt=3))
    # The least of size - run + 1 neighbours, by doubling.
    reach, want = 1, size - run + 1
    while 2 * reach <= want:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if want > reach:
        least = np.minimum(least[: len(least) - (want - reach)], least[want - reach :])
    return begin, least[begin], at


def _anchor_keys(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Each text's anchors, once."""
    for w in column_words(column):
        _, found, at = anchors(w, size)
        if len(found):
            row = np.repeat(np.arange(w.rows), np.diff(at))
            new = np.append(True, (found[1:] != found[:-1]) | (row[1:] != row[:-1]))
            found, row = found[new], row[new]
            order = np.lexsort((found, row))
            found, row = found[order], row[order]
            yield found[np.append(True, (found[1:] != found[:-1]) | (row[1:] != row[:-1]))]


def _candidates(w: Words, size: int, repeated: Filter) -> tuple[np.ndarray, np.ndarray]:
    """First word and row of the windows that may start in two documents."""
    begin, found, at = anchors(w, size)
    if not len(begin):
        return begin, begin
    new = np.append(True, found[1:] != found[:-1])
    open_ = repeated.mask(found[new])[np.cumsum(new) - 1]
    return begin[open_], np.repeat(np.arange(w.rows), np.diff(at))[open_]


def first_windows(docs: DataFrame, size: int, repeated: Filter, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, own): of each document, hashes of the windows that may be repeated and do not start in a smaller document."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, known = b.column(0).fill_null(0).to_numpy(), b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for w in column_words(b.column(1)):
                begin, row = _candidates(w, size, repeated)
                keep = known[w.row + row]
                begin, row = begin[keep], row[keep]
                if len(begin):
                    out = [w.span_hashes(begin, begin + size).view(np.int64), w.span_hashes(begin, begin + size, salt=7).view(np.int64), ids[w.row + row]]
                    for a in range(0, len(begin), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)]) for c in out], ["wa", "wb", "doc_id"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(windows, "wa long, wb long, doc_id long")
    owned = rows.groupBy("wa", "wb").agg(F.min("doc_id").alias("_own_id"))
    return owned.groupBy("_own_id").agg(F.collect_list("wa").alias("_own"))


def _cut(w: Words, size: int, repeated: Filter, owns: pa.Array, known: np.ndarray) -> np.ndarray:
    """Which words of the texts go."""
    begin, row = _candidates(w, size, repeated)
    gone = np.zeros(len(w.starts) + 1, np.int64)
    if len(begin):
        hashes = w.span_hashes(begin, begin + size).view(np.int64)
        offsets, values = owns.offsets.to_numpy(), owns.values.to_numpy(zero_copy_only=False)
        lo, hi = offsets[w.row : w.row + w.rows], offsets[w.row + 1 : w.row + w.rows + 1]
        mine = values[lo[0] : hi[-1]]
        mine_row = np.repeat(np.arange(w.rows), hi - lo)
        # A window is its document's own if (row, hash) is in the list: compared as one key each.
        salt = mix(np.arange(w.rows, dtype=np.uint64) + np.uint64(1))
        own = np.isin(mix(hashes.view(np.uint64) ^ salt[row]), mix(mine.view(np.uint64) ^ salt[mine_row])) if len(mine) else np.zeros(len(begin), bool)
        cut = begin[~own & known[w.row + row]]
        np.add.at(gone, cut, 1)
        np.subtract.at(gone, cut + size, 1)
    return np.cumsum(gone[:-1]) > 0


def kept_text(w: Words, gone: np.ndarray, i: int) -> bytes:
    a, z = w.first[i], w.first[i + 1]
    words = bytes(w.data[w.text_at[i] : w.text_at[i + 1]]).split()
    drop = gone[a:z]
    return b" ".join(words if not drop.any() else [x for x, d in zip(words, drop) if not d])


def _with_own(docs: DataFrame, size: int, id_col: str, text_col: str) -> tuple[DataFrame, Filter]:
    repeated = key_filter(docs.select(F.col(text_col)), lambda b: _anchor_keys(b.column(0), size), 2)
    own = first_windows(docs, size, repeated, id_col, text_col)
    return docs.join(own, docs[id_col].cast("long") == F.col("_own_id"), "left"), repeated


def _owns(ids: pa.Array, own: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return own, ids.is_valid().to_numpy(zero_copy_only=False)


def digest(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of what is left: the kept words joined by one space."""
    rows, repeated = _with_own(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), size, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owns, known = _owns(b.column(0), b.column(2))
            n_words, removed, shas = [], [], []
            for w in column_words(b.column(1)):
                gone = _cut(w, size, repeated, owns, known)
                n_words.append(w.counts)
                sums = np.concatenate([[0], np.cumsum(gone)])
                removed.append(np.diff(sums[w.first]))
                shas += [hashlib.sha256(kept_text(w, gone, i)).hexdigest() for i in range(w.rows)]
            if shas:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(n_words)), pa.array(np.concatenate(removed)), pa.array(shas)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.select("doc_id", "text", "_own").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated passages cut out of the text; texts that lose nothing stay as they are. All columns are kept."""
    rows, repeated = _with_own(docs, size, id_col, text_col)

    @F.arrow_udf(T.StringType())
    def rest(ids: pa.Array, texts: pa.Array, own: pa.Array) -> pa.Array:
        owns, known = _owns(ids, own)
        out = []
        for w in column_words(texts):
            gone = _cut(w, size, repeated, owns, known)
            any_gone = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first]) > 0
            out += [spaced_rest(w, gone, i) if any_gone[i] else None for i in range(w.rows)]
        return pa.array([t if o is None else o for o, t in zip(out, texts.to_pylist())], pa.string())

    return rows.withColumn(text_col, rest(F.col(id_col).cast("long"), F.col(text_col), F.col("_own"))).select(*docs.columns)


def spaced_rest(w: Words, gone: np.ndarray, i: int) -> str:
    """The text without the words that go; the white space before a word goes with it."""
    a, z = int(w.first[i]), int(w.first[i + 1])
    lo, hi = int(w.text_at[i]), int(w.text_at[i + 1])
    keep = np.ones(hi - lo, bool)
    stops = np.concatenate([[lo], w.ends[a:z]])
    for k in np.flatnonzero(gone[a:z]):
        keep[stops[k] - lo : stops[k + 1] - lo] = False
    return w.data[lo:hi][keep].tobytes().decode("utf-8").lstrip(" \t\n\r\x0b\x0c" if a < z and gone[a] else "")
