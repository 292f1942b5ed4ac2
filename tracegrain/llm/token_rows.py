"""Token ids packed into fixed-length rows by best-fit decreasing.

Texts become ids with a byte-level BPE vocabulary; documents longer than a row are cut into full rows and a rest, without losing an
id. Pieces are taken longest first, each into the open row with the least room that still holds it: a segment tree over room
sizes finds that row's size in logarithmic time. A task packs its documents in groups of about `group_tokens` ids, so memory does not grow
with the partition, and nothing is shuffled.

Defined results: a null or empty text has no ids and no piece; repeated rows are packed one by one, null ids are kept as null;
pieces of equal length go in the order read. An empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PAD = 50256
SCHEMA = "part int, row long, ids binary, n_tokens int, cu_seqlens array<int>, positions binary, doc_ids array<bigint>, pieces array<int>"
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the vocabulary's pre-split pattern
_CACHE_WORDS = 400_000


class Encoder:
    """Little-endian 16-bit ids of texts. Words between single spaces are encoded once and remembered.

    No pre-split piece holds a space after another character, so a text's ids are those of its space-led words, one after another, as long as
    no word starts or ends with white space; other texts go through the encoder whole.
    """

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        self.encoding = tiktoken.Encoding("rows", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u2").tobytes()

    def encode(self, text: str) -> bytes:
        words = text.split(" ")
        out = [self.whole(words[0])]
        known = self.words
        for word in words[1:]:
            ids = known.get(word)
            if ids is None:
                if not word or word[0].isspace() or word[-1].isspace():
                    return self.whole(text)
                ids = self.whole(" " + word)
                if len(known) < _CACHE_WORDS:
                    known[word] = ids
            out.append(ids)
        if words[0] and words[0][-1].isspace():
            return self.whole(text)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode(ids.tolist())


class RoomTree:
    """A segment tree over room sizes 0 to size: how many rows are open at each, and the least size from a bound on that has one."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves <= size:
            self.leaves *= 2
        self.counts = [0] * (2 * self.leaves)

    def add(self, room: int, change: int) -> None:
        i = room + self.leaves
        while i:
            self.counts[i] += change
            i //= 2

    def least(self, room: int) -> int:
        """The least open room of at least `room`, or -1."""
        i, counts = room + self.leaves, self.counts
        if counts[i]:
            return room
        while i > 1:
            if not i % 2 and counts[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if counts[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return -1


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of piece numbers. Every length is 1 to capacity."""
    tree, at, rows = RoomTree(capacity), [[] for _ in range(capacity + 1)], []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[piece])
        room = tree.least(length)
        if room < 0:
            rows.append([piece])
            row, room = len(rows) - 1, capacity
        else:
            row = at[room].pop()
            tree.add(room, -1)
            rows[row].append(piece)
        if room > length:
            at[room - length].append(row)
            tree.add(room - length, 1)
    return rows


def _group(docs: list[tuple[int | None, bytes]], capacity: int, pad: int, part: int, first: int) -> pa.RecordBatch:
    pieces = [(doc, k, ids[2 * a : 2 * (a + capacity)]) for doc, ids in docs for k, a in enumerate(range(0, len(ids) // 2, capacity))]
    rows = best_fit_decreasing(np.array([len(p[2]) // 2 for p in pieces], np.int64), capacity)
    ids, tokens, lengths, positions, doc_ids, numbers = [], [], [], [], [], []
    count = np.arange(capacity, dtype="<u2").tobytes()
    for row in rows:
        mine = [pieces[i] for i in row]
        body = b"".join(p[2] for p in mine)
        tokens.append(len(body) // 2)
        ids.append(body + pad.to_bytes(2, "little") * (capacity - tokens[-1]))
        lengths.append([0, *np.cumsum([len(p[2]) // 2 for p in mine]).tolist()])
        positions.append(b"".join(count[: len(p[2])] for p in mine) + count[: 2 * (capacity - tokens[-1])])
        doc_ids.append([p[0] for p in mine])
        numbers.append([p[1] for p in mine])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(rows), part, np.int32)), pa.array(np.arange(first, first + len(rows))), pa.array(ids, pa.binary()), pa.array(tokens, pa.int32()),
         pa.array(lengths, pa.list_(pa.int32())), pa.array(positions, pa.binary()), pa.array(doc_ids, pa.list_(pa.int64())), pa.array(numbers, pa.list_(pa.int32()))],
        ["part", "row", "ids", "n_tokens", "cu_seqlens", "positions", "doc_ids", "pieces"])


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY, pad: int = PAD, group_tokens: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each packed row: ids (capacity 16-bit ids, padded), n_tokens without padding, cu_seqlens (cumulative lengths of its segments, from 0),
    positions (16 bit, starting again at 0 with each segment and with the padding), and each segment's doc_ids and pieces (the number of the cut
    within the document). (part, row) is unique in one run."""
    if not 1 <= capacity < 1 << 16:
        raise ValueError("a row holds 1 to 65,535 ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(vocabulary), TaskContext.get().partitionId()
        held, size, first = [], 0, 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                if not text:
                    continue
                ids = encoder.encode(text)
                held.append((doc, ids))
                size += len(ids) // 2
                if size >= group_tokens:
                    out = _group(held, capacity, pad, part, first)
                    first, held, size = first + out.num_rows, [], 0
                    yield from _small(out)
        if held:
            yield from _small(_group(held, capacity, pad, part, first))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)


def _small(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def write(docs: DataFrame, folder: str, **options) -> None:
    """The packed rows as Parquet files: id matrices row by row, lengths and positions beside them."""
    pack(docs, **options).write.mode("overwrite").parquet(folder)


def unpack(rows: DataFrame) -> DataFrame:
    """doc_id and its ids again (array<int>), from packed rows. Repeated or null ids cannot be told apart here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], "<u2")
                for doc, piece, a, z in zip(r["doc_ids"], r["pieces"], r["cu_seqlens"], r["cu_seqlens"][1:]):
                    out.append((doc, piece, ids[a:z].astype(np.int32).tolist()))
            columns = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.int32()))], ["doc_id", "piece", "ids"])

    pieces = rows.mapInArrow(run, "doc_id long, piece int, ids array<int>")
    return pieces.groupBy("doc_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", "ids"))), lambda s: s["ids"])).alias("ids"))
