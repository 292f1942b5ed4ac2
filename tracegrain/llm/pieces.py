"""SentencePiece encoding and decoding: the piece sequence of highest total score, by a max-plus scan.

The model file gives pieces and scores. A text is prefixed with a space, spaces become the mark U+2581, and of all ways to cut the text into pieces the
one with the highest sum of scores is taken. A character without a piece costs the lowest score less ten and becomes byte pieces. Scores are
held as whole numbers (times SCALE), so sums are exact and the result does not depend on where a text was cut for the work. Ties: at
each position, from left to right, the longest piece that ends there wins.

Texts up to `chunk` characters are encoded in one go. A longer one is split into chunks that any tasks may take:
1. A chunk's transfer matrix says, for each cut position the path may have before the chunk and each it may have at its end, the best score between
   them. Where no piece holds the mark but at its front, all paths pass all marks, and words between two are cut and scored once.
2. Matrices combine by the max-plus product, which is associative: blocks of FANOUT are multiplied level by level, then the best scores at each
   chunk's start are handed down the same levels.
3. With those scores a chunk finds, for each cut position at its end, the one at its start that the best path came through. These maps also
   combine associatively, from the right, and give each chunk the position its own path ends at.
4. Each chunk traces its part of the path back by itself.

Defined results: a null text has null ids; an empty text has none. Decoding gives the text back exactly, but for U+2581 itself, which
becomes a space. Repeated rows and null ids are encoded one by one. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.session import cut_lineage

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SCALE = 1 << 10
NEVER = -(1 << 60)
CHUNK = 1 << 15
FANOUT = 64
_CACHE_WORDS = 450_000
_UNUSED_SCORE = -1e8  # pieces with a score below are placeholders of the model, never the result of a merge


_RUNS = re.compile(r"[^\W\d_²³¹]+|[\W\d_²³¹]+")  # letters, and what stands between them


_NOTHING: tuple = (None, -1, {})  # no piece, and none that begins so


class _Memo(dict):
    """Results by argument, up to a number of them; the rest are computed again."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key: str) -> bytes:
        found = self.compute(key)
        if len(self) < self.most:
            self[key] = found
        return found


class Model:
    """Pieces and scores of a SentencePiece model file, and best cuts by them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.text = [sp.id_to_piece(i) for i in ids]
        self.byte = {int(self.text[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        normal = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {self.text[i]: (round(sp.get_score(i) * SCALE), i) for i in normal if sp.get_score(i) > _UNUSED_SCORE}
        self.unknown = min(s for s, _ in self.score.values()) - 10 * SCALE
        # A single character with a placeholder's score costs what an unknown one does, but has its id.
        self.score.update({self.text[i]: (self.unknown, i) for i in normal if len(self.text[i]) == 1 and self.text[i] not in self.score})
        self.reach = max(map(len, self.score))  # characters of the longest piece
        self.cut_at_marks = all(MARK not in p[1:] for p in self.score)
        self.raw = [self.text[i].replace(MARK, " ").encode() for i in ids]
        for value, i in self.byte.items():
            self.raw[i] = bytes([value])
        # Where no piece holds letters next to other characters (but the mark), words can be cut there, and their parts be remembered.
        self.runs = _RUNS if all(len(_RUNS.findall(p.lstrip(MARK))) <= 1 for p in self.score) else None
        self.words = _Memo(self._word, _CACHE_WORDS)
        self.parts = _Memo(self._part, _CACHE_WORDS)
        self.word_scores: dict[str, int] = {}
        # Pieces as a trie: a node is (score or None, id, nodes by the next character).
        self.trie: dict[str, tuple] = {}
        for piece, (score, i) in sorted(self.score.items()):  # beginnings come before what they begin
            nodes = self.trie
            for c in piece[:-1]:
                nodes = nodes.setdefault(c, (None, -1, {}))[2]
            nodes[piece[-1]] = (score, i, nodes.get(piece[-1], (None, -1, {}))[2])
        self.packed = [i.to_bytes(2, "little") for i in ids]

    def edges(self, text: str, start: int) -> list[tuple[int, int, int]]:
        """(end, score, id) of the pieces that begin at start; id -1 for a character without a piece."""
        node, end, out, n = self.trie.get(text[start]), start + 1, [], len(text)
        if node is None or node[0] is None:
            out.append((end, self.unknown, -1))
        while node is not None:
            if node[0] is not None:
                out.append((end, node[0], node[1]))
            if end == n:
                break
            node = node[2].get(text[end])
            end += 1
        return out

    def ids_of(self, text: str, cuts: list[tuple[int, int, int]]) -> bytes:
        """Little-endian 16-bit ids of (start, end, id), in order."""
        packed = self.packed
        return b"".join([packed[i] if i >= 0 else b"".join([packed[self.byte[b]] for b in text[start:end].encode()]) for start, end, i in cuts])

    def best(self, text: str, entry: list[int] | None = None, begin: int = 0) -> tuple[list[int], list[tuple[int, int] | None]]:
        """Best score of a path to each position, and the (start, id) of its last piece. With `entry`, scores of the positions 0 to begin are
        given, and only pieces that end after begin are added."""
        n, trie, unknown = len(text), self.trie, self.unknown
        score = [NEVER] * (n + 1)
        came: list[tuple[int, int] | None] = [None] * (n + 1)
        if entry is None:
            score[0] = 0
        else:
            score[: begin + 1] = entry
        # As edges(), in place: this is the inner loop of everything here.
        for start in range(n):
            here = score[start]
            if here <= NEVER:
                continue
            node, end = trie.get(text[start]), start + 1
            if (node is None or node[0] is None) and end > begin and here + unknown > score[end]:
                score[end], came[end] = here + unknown, (start, -1)
            while node is not None:
                s, i, nodes = node
                if s is not None and here + s > score[end] and end > begin:
                    score[end], came[end] = here + s, (start, i)
                if end == n:
                    break
                node = nodes.get(text[end])
                end += 1
        return score, came

    def path(self, came: list[tuple[int, int] | None], end: int, begin: int = 0) -> tuple[list[tuple[int, int, int]], int]:
        """The pieces back from `end` to the first position not after `begin`, and that position."""
        cuts = []
        while end > begin:
            start, i = came[end]
            cuts.append((start, end, i))
            end = start
        return cuts[::-1], end

    def _part(self, text: str) -> bytes:
        """Ids of a short text: best() and path() in one, as most of the time goes here."""
        n, trie, unknown, packed = len(text), self.trie, self.unknown, self.packed
        score, back, last = [0] + [NEVER] * n, [0] * (n + 1), [-1] * (n + 1)
        for start in range(n):
            here, end = score[start], start + 1
            s, i, nodes = trie.get(text[start], _NOTHING)
            if s is None and here + unknown > score[end]:
                score[end], back[end], last[end] = here + unknown, start, -1
            while True:
                if s is not None and here + s > score[end]:
                    score[end], back[end], last[end] = here + s, start, i
                if end == n or not nodes:
                    break
                s, i, nodes = nodes.get(text[end], _NOTHING)
                end += 1
        out, end = [], n
        while end:
            start, i = back[end], last[end]
            out.append(packed[i] if i >= 0 else b"".join([packed[self.byte[b]] for b in text[start:end].encode()]))
            end = start
        out.reverse()
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        """Ids of a word with the mark before it."""
        cut = self.runs.findall(word) if self.runs else [word]
        if len(cut) < 2:
            return self.parts[MARK + word]
        return self.parts[MARK + cut[0]] + b"".join([self.parts[c] for c in cut[1:]])

    def encode(self, text: str) -> bytes:
        """No piece holds the mark after another character, so the best path passes every mark: words can be cut one by one."""
        if self.cut_at_marks:
            return b"".join(map(self.words.__getitem__, text.replace(MARK, " ").split(" "))) if text else b""
        marked = MARK + text.replace(" ", MARK) if text else ""
        _, came = self.best(marked)
        return self.ids_of(marked, self.path(came, len(marked))[0])

    def decode(self, ids) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "replace")[1:]

    def marks(self, text: str, begin: int) -> tuple[int, int] | None:
        """The first and the last mark from begin on, if every path is cut there."""
        first = text.find(MARK, begin) if self.cut_at_marks else -1
        return None if first < 0 else (first, text.rfind(MARK))

    def between(self, text: str, first: int, last: int) -> list[str]:
        """The words from one mark to another."""
        return text[first + 1 : last].split(MARK) if last > first else []

    def word_score(self, word: str) -> int:
        score = self.word_scores.get(word)
        if score is None:
            score = self.best(MARK + word)[0][-1]
            if len(self.word_scores) < _CACHE_WORDS // 8:
                self.word_scores[word] = score
        return score

    def transfer(self, text: str, begin: int) -> np.ndarray:
        """M[i, j]: best score from `i` characters before begin to `j` before the end, by pieces that end after begin.

        Paths meet at marks: then M is the scores up to the first mark, plus those of the words between, plus those from the last mark on.
        """
        ends = self.marks(text, begin)
        if ends is None:
            return self.transfer_by_character(text, begin)
        (first, last), k = ends, self.reach
        into = np.full(k, NEVER, np.int64)
        if first == begin:
            into[0] = 0
        else:
            into = self.transfer_by_character(text[:first], begin)[:, 0]
        tail = self.best(text[last:])[0]
        out_of = np.full(k, NEVER, np.int64)
        out_of[: len(tail)] = tail[::-1][:k]
        middle = sum(map(self.word_score, self.between(text, first, last)))
        out = into[:, None] + out_of[None, :] + middle
        return np.where((into[:, None] <= NEVER) | (out_of[None, :] <= NEVER), NEVER, out)

    def transfer_by_character(self, text: str, begin: int) -> np.ndarray:
        k = self.reach
        score = np.full((len(text) + 1, k), NEVER, np.int64)
        for i in range(min(k, begin + 1)):
            score[begin - i, i] = 0
        for start in range(max(0, begin - k + 1), len(text)):
            row = score[start]
            for end, s, _ in self.edges(text, start):
                if end > begin:
                    np.maximum(score[end], row + s, out=score[end])
        out = np.full((k, k), NEVER, np.int64)
        for j in range(min(k, len(text) + 1)):
            if len(text) - j > begin:
                out[:, j] = score[len(text) - j]
            elif len(text) - j + k > begin:  # a chunk shorter than a piece: a cut before it stays a cut
                if begin - (len(text) - j) < k:
                    out[begin - (len(text) - j), j] = 0
        return np.where(out < NEVER // 2, NEVER, out)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus: (a x b)[i, j] = max over k of a[i, k] + b[k, j]."""
    out = (a[:, :, None] + b[None, :, :]).max(1)
    return np.where(out < NEVER // 2, NEVER, out)


def _ids_column(parts: list[bytes | None]) -> pa.Array:
    sizes = [0 if p is None else len(p) // 2 for p in parts]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = np.frombuffer(b"".join(p or b"" for p in parts), "<u2").astype(np.int32)
    mask = pa.array([p is None for p in parts], pa.bool_()) if parts else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=mask)


def encode_column(texts: Column, path: str = MODEL) -> Column:
    """ids (array<int>) of each text, in one go."""
    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        m = model(path)
        return _ids_column([None if (t := x.as_py()) is None else m.encode(t) for x in column])

    return run(texts)


def decode_column(ids: Column, path: str = MODEL) -> Column:
    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        m = model(path)
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        return pa.array([m.decode(values[a:z].tolist()) if ok else None for a, z, ok in zip(offsets, offsets[1:], valid)], pa.string())

    return run(ids)


def _blocks(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.int64).tobytes()


def _matrix(b: bytes, k: int) -> np.ndarray:
    return np.frombuffer(b, np.int64).reshape(-1, k)


def _split(batches: Iterator[pa.RecordBatch], path: str, chunk: int) -> Iterator[pa.RecordBatch]:
    """(rid, doc_id, k, chunks, begin, text, matrix): chunk k of a document, with as many characters before it as a piece may reach back."""
    m, part, n = model(path), TaskContext.get().partitionId(), 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            marked = MARK + text.as_py().replace(" ", MARK)
            rid, n, chunks = (part << 33) + n, n + 1, -(-len(marked) // chunk)
            for k in range(chunks):
                back = max(0, k * chunk - m.reach + 1)
                piece = marked[back : (k + 1) * chunk]
                begin = k * chunk - back
                yield pa.RecordBatch.from_pylist([{"rid": rid, "doc_id": doc, "k": k, "chunks": chunks, "begin": begin, "text": piece, "matrix": _blocks(m.transfer(piece, begin))}], schema=_CHUNK)


_CHUNK = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int64()), ("chunks", pa.int64()), ("begin", pa.int32()), ("text", pa.string()), ("matrix", pa.binary())])


def _encode_long(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    """(doc_id, n_chunks, ids) of texts that are longer than a chunk."""
    k_size = model(path).reach
    chunks = cut_lineage(docs.mapInArrow(lambda b: _split(b, path, chunk), "rid long, doc_id long, k long, chunks long, begin int, text string, matrix binary"))
    longest = chunks.agg(F.max("chunks")).first()[0]
    if longest is None:
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_chunks"), F.lit(None).cast("array<int>").alias("ids")).limit(0)

    # 2. Products of FANOUT matrices, level by level, until one is left for each document ...
    levels = [chunks.select("rid", "k", "matrix")]
    count = longest
    while count > 1:
        count = -(-count // FANOUT)
        levels.append(_fold(levels[-1], k_size, _multiply))
    # ... and the best scores at each one's start, down the levels again. A document starts with a cut at its first character.
    start = _blocks(np.array([0] + [NEVER] * (k_size - 1)))
    entry = levels[-1].select("rid", "k", F.lit(start).alias("state"))
    for level in reversed(levels[:-1]):
        entry = _hand_down(level, entry, k_size, _from_left)
    known = cut_lineage(chunks.drop("matrix").join(entry, ["rid", "k"]))

    # 3. Where each chunk's path comes from, for each end; combined from the right.
    maps = known.mapInArrow(lambda b: _origins(b, path), "rid long, k long, matrix binary")
    levels, count = [cut_lineage(maps)], longest
    while count > 1:
        count = -(-count // FANOUT)
        levels.append(_fold(levels[-1], k_size, _compose))
    # A document ends with a cut at its last character.
    leave = levels[-1].select("rid", "k", F.lit(_blocks(np.array([0]))).alias("state"))
    for level in reversed(levels[:-1]):
        leave = _hand_down(level, leave, k_size, _from_right)

    # 4. Each chunk's own part of the path.
    traced = known.withColumnRenamed("state", "entry").join(leave, ["rid", "k"]).mapInArrow(lambda b: _trace(b, path), "rid long, doc_id long, chunks long, k long, ids array<int>")
    return (traced.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("chunks").alias("n_chunks"),
            F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda s: s["ids"])).alias("ids")).drop("rid"))


def _multiply(parts: list[bytes], k: int) -> bytes:
    out = _matrix(parts[0], k)
    for p in parts[1:]:
        out = product(out, _matrix(p, k))
    return _blocks(out)


def _compose(parts: list[bytes], k: int) -> bytes:
    """Maps from end to start, applied from the last chunk to the first."""
    out = np.arange(k)
    for p in reversed(parts):
        out = np.frombuffer(p, np.int64)[out]
    return _blocks(out)


def _from_left(parts: list[bytes], state: bytes, k: int) -> list[bytes]:
    out, now = [], np.frombuffer(state, np.int64)
    for p in parts:
        out.append(_blocks(now))
        now = product(now[None, :], _matrix(p, k))[0]
    return out


def _from_right(parts: list[bytes], state: bytes, k: int) -> list[bytes]:
    out, now = [], int(np.frombuffer(state, np.int64)[0])
    for p in reversed(parts):
        out.append(_blocks(np.array([now])))
        now = int(np.frombuffer(p, np.int64)[now])
    return out[::-1]


def _fold(level: DataFrame, k: int, combine) -> DataFrame:
    """Blocks of FANOUT neighbours become one row each."""
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        return pa.table({"rid": [key[0].as_py()], "k": [key[1].as_py()], "matrix": pa.array([combine(t.column("matrix").to_pylist(), k)], pa.binary())})

    return cut_lineage(level.groupBy("rid", F.expr(f"k div {FANOUT}").alias("up")).applyInArrow(run, "rid long, k long, matrix binary"))


def _hand_down(level: DataFrame, above: DataFrame, k: int, share) -> DataFrame:
    """The state that each row of a level starts (or ends) with, from the state of its block."""
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        return pa.table({"rid": t.column("rid"), "k": t.column("k"), "state": pa.array(share(t.column("matrix").to_pylist(), t.column("state")[0].as_py(), k), pa.binary())})

    rows = level.withColumn("up", F.expr(f"k div {FANOUT}")).join(above.select("rid", F.col("k").alias("up"), "state"), ["rid", "up"])
    return rows.groupBy("rid", "up").applyInArrow(run, "rid long, k long, state binary")


def _entry(m: Model, state: bytes, begin: int) -> list[int]:
    """Scores of the positions 0 to begin, from those of 0, 1, ... characters before begin."""
    v = np.frombuffer(state, np.int64)[: begin + 1][::-1].tolist()
    return [NEVER] * (begin + 1 - len(v)) + v


def _origins(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    m = model(path)
    for b in batches:
        for r in b.to_pylist():
            text, begin, ends = r["text"], r["begin"], m.marks(r["text"], r["begin"])
            head = text if ends is None else text[: ends[0]]
            score, came = m.best(head, _entry(m, r["state"], begin), begin)
            out = np.zeros(m.reach, np.int64)
            if ends is not None:  # all paths come through the first mark
                out[:] = begin - m.path(came, ends[0], begin)[1]
            for j in range(min(m.reach, len(text) + 1) if ends is None else 0):
                end = len(text) - j
                if score[end] > NEVER:
                    out[j] = begin - m.path(came, end, begin)[1]
            yield pa.RecordBatch.from_arrays([pa.array([r["rid"]]), pa.array([r["k"]]), pa.array([_blocks(out)], pa.binary())], ["rid", "k", "matrix"])


def _trace(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    m = model(path)
    for b in batches:
        for r in b.to_pylist():
            text, begin, ends = r["text"], r["begin"], m.marks(r["text"], r["begin"])
            stop = len(text) - int(np.frombuffer(r["state"], np.int64)[0])
            head, to = (text, stop) if ends is None else (text[: ends[0]], ends[0])
            _, came = m.best(head, _entry(m, r["entry"], begin), begin)
            ids = m.ids_of(text, m.path(came, to, begin)[0])
            if ends is not None:
                tail = text[ends[1] :]
                ids += b"".join(map(m.words.__getitem__, m.between(text, *ends))) + m.ids_of(tail, m.path(m.best(tail)[1], stop - ends[1])[0])
            yield pa.RecordBatch.from_arrays([pa.array([r["rid"]]), pa.array([r["doc_id"]], pa.int64()), pa.array([r["chunks"]]), pa.array([r["k"]]), _ids_column([ids])], ["rid", "doc_id", "chunks", "k", "ids"])


def encode(docs: DataFrame, path: str = MODEL, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chunks, ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) >= chunk
    short = rows.where(~long).select("doc_id", F.lit(1).cast("long").alias("n_chunks"), encode_column(F.col("text"), path).alias("ids"))
    return short.unionByName(_encode_long(rows.where(long), path, chunk))
