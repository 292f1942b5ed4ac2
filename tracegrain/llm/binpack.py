"""Conflict-constrained best-fit packing of documents into bins of `capacity` words.

No bin holds two pieces of one source or of one duplicate cluster. Bins are kept by what room they have left; a bitmap over the bins
for each source and each cluster says which bins have it. A piece takes the tightest bin that has room and neither its source nor its
cluster: the search starts at the room the piece needs and goes on to the next room in use until a compatible bin is found. Pieces are
taken longest first. Documents over the capacity are cut into full pieces and a rest.

Packing works on lengths, not texts. Documents are dealt by a hash of their id into groups of about `group_docs`, each packed by itself,
so a hot source or cluster is dealt over all groups and no group grows with the corpus.

Defined results: a null text, or one without words, has length 0 and gets a row without a bin; a null source or cluster is in conflict with nothing; ties go
to the smaller id, then to the older bin; repeated rows are packed one by one. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrain.llm.words import column_words
from tracegrain.session import cut_lineage

CAPACITY = 2048
GROUP_DOCS = 4096
SCHEMA = "doc_id long, piece int, n_words long, bin string, position int, source string, cluster long"


@F.arrow_udf(T.LongType())
def word_counts(texts: pa.Array) -> pa.Array:
    parts = [w.counts for w in column_words(texts)]
    return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())


class Bins:
    """Open bins by room left, as bitmaps (bit b is bin b), with a bitmap of the rooms in use."""

    def __init__(self, capacity: int):
        self.capacity, self.room, self.count = capacity, [], 0
        self.by_room: dict[int, int] = {}
        self.rooms = 0
        self.of_source: dict[object, int] = {}
        self.of_cluster: dict[object, int] = {}

    def _move(self, b: int, old: int | None, new: int) -> None:
        if old is not None:
            self.by_room[old] ^= 1 << b
            if not self.by_room[old]:
                self.rooms ^= 1 << old
        if new:  # a full bin is never looked at again
            self.by_room[new] = self.by_room.get(new, 0) | 1 << b
            self.rooms |= 1 << new

    def place(self, size: int, source: object, cluster: object) -> int:
        """The bin that the piece is put into."""
        taken = (self.of_source.get(source, 0) if source is not None else 0) | (self.of_cluster.get(cluster, 0) if cluster is not None else 0)
        later, found = self.rooms >> size << size, -1
        while later:
            low = later & -later
            free = self.by_room[low.bit_length() - 1] & ~taken
            if free:
                found = (free & -free).bit_length() - 1
                break
            later ^= low
        if found < 0:
            found, old = self.count, None
            self.room.append(self.capacity)
            self.count += 1
        else:
            old = self.room[found]
        self.room[found] -= size
        self._move(found, old, self.room[found])
        for key, bitmaps in ((source, self.of_source), (cluster, self.of_cluster)):
            if key is not None:
                bitmaps[key] = bitmaps.get(key, 0) | 1 << found
        return found


def pack_group(rows: list[tuple[int, int, object, object]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(row number, piece, size, bin, position) for rows of (tie-break, size, source, cluster)."""
    pieces = []
    for i, (tie, size, _, _) in enumerate(rows):
        for k, a in enumerate(range(0, size, capacity)):
            pieces.append((-min(capacity, size - a), tie, k, i))
    pieces.sort()
    bins, filled, out = Bins(capacity), {}, []
    for negative, _, k, i in pieces:
        b = bins.place(-negative, rows[i][2], rows[i][3])
        out.append((i, k, -negative, b, filled.get(b, 0)))
        filled[b] = filled.get(b, 0) + 1
    return out


def pack(docs: DataFrame, cluster: Column, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", merged: DataFrame | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, n_words (of the piece), bin, position (in the bin), source, cluster.

    merged (cluster, into) names the clusters that are part of another one; rows that carry such a cluster count as that one's.
    """
    rows = cut_lineage(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), word_counts(F.col(text_col)).alias("n_words"),
        F.col(source_col).cast("string").alias("source"), cluster.cast("long").alias("cluster")))
    if merged is not None:  # met by the narrow rows, not by the texts
        rows = cut_lineage(rows.join(merged, "cluster", "left").select("doc_id", "n_words", "source", F.coalesce("into", "cluster").alias("cluster")))
    groups = max(1, -(-rows.count() // group_docs))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("n_words", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        sizes, sources, clusters = (table.column(c).to_pylist() for c in ("n_words", "source", "cluster"))
        packed = pack_group([(i, n, s, c) for i, (n, s, c) in enumerate(zip(sizes, sources, clusters))], capacity)
        group = table.column("_group")[0].as_py()
        out = table.take(pa.array([p[0] for p in packed], pa.int64()))
        return pa.table({
            "doc_id": out.column("doc_id"), "piece": pa.array([p[1] for p in packed], pa.int32()), "n_words": pa.array([p[2] for p in packed], pa.int64()),
            "bin": pa.array([f"{group}-{p[3]}" for p in packed], pa.string()), "position": pa.array([p[4] for p in packed], pa.int32()),
            "source": out.column("source"), "cluster": out.column("cluster")})

    # The length takes part in the deal, so that rows that repeat one id are dealt out as well as can be.
    dealt = rows.where("n_words > 0").withColumn("_group", F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(groups)))
    packed = dealt.groupBy("_group").applyInArrow(run, SCHEMA)
    empty = rows.where("n_words = 0").select("doc_id", F.lit(0).alias("piece"), "n_words", F.lit(None).cast("string").alias("bin"), F.lit(None).cast("int").alias("position"), "source", "cluster")
    return packed.unionByName(empty)
