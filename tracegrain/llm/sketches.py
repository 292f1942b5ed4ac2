"""Near duplicates by fast similarity sketches, banding and exact verification.

1. A document is its set of word shingles. Documents with equal sets are one class, named by 128 bits of the set and stood for by its smallest id.
2. A sketch has COORDINATES values. In round i every element falls into a bin and leaves (i, value) there; the least stays. The rounds from
   COORDINATES on give every element the bin of the round, so after 2 x COORDINATES rounds, and mostly after two or three, no bin is empty. The share
   of coordinates that two sketches have in common estimates their sets' similarity, concentrated at least as well as independent draws.
3. Four coordinates of 16 bits are one band of 64 bits, so a sketch is BANDS numbers and these are its own keys. Sets of similarity 0.85 agree in a
   band with probability 0.52, and in none of 24 with 2e-8.
4. Buckets with more than one class go on. One with more than HOT classes is split by second keys, its own with each of the next SHIFTS bands, so that only
   classes that agree in eight coordinates stay together; a bucket that is still large is dealt in blocks of BLOCK classes, each pair of blocks to one
   task at a time: nothing is left out.
5. In a block or a pair of blocks, pairs whose sizes fit and whose sketches agree in at least as many coordinates as all but one in 10**9 of the linked pairs
   do are candidates. A spanning forest of them leaves the task: first from the buckets of FIRST_BANDS bands, then from all buckets that still hold
   more than one component. What the candidates connect is a cluster; every link lies within one.
6. A cluster is confirmed on the full sets, in blocks like the buckets: overlaps are counted exactly and a spanning forest of the links leaves the task. A
   cluster of more than BANDS x BLOCK classes is confirmed bucket by bucket, which is less. So no group is expanded into its pairs and no link between different
   components is lost.

A sketch is 192 bytes a class; buckets carry ids, and sketches only where they have more than one class.

Defined results: a null text or one without words has an empty set, is linked with nothing and stays; one with fewer words than a shingle has one; rows that
share an id are one node whatever their texts, and n_shingles is each row's own; a row without an id is not linked, has no component and stays; an empty table has
no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.llm.components import _fold, components
from tracegrain.llm.ngram_join import shingle_sets
from tracegrain.llm.words import column_words, mix
from tracegrain.session import cut_lineage

SHINGLE = 5
PERCENT = 85
BANDS = 24
PER_BAND = 4
COORDINATES = BANDS * PER_BAND
HOT = 4096
SHIFTS = 6
FIRST_BANDS = 6
BLOCK = 512
LOST = 1e-9
BLOCK_TOKENS = 1_000_000
EDGES_PER_TASK = 20_000
_EMPTY = np.uint64((1 << 64) - 1)
_ROUND = 0x9E3779B97F4A7C15
_SCHEMA = "doc_id long, n long, high long, low long, sketch array<bigint>"


def sketch_sets(row: np.ndarray, hashes: np.ndarray, rows: int, coordinates: int = COORDINATES) -> np.ndarray:
    """(rows, coordinates) of 64-bit values; _EMPTY all along for a row without elements. `row` must be sorted."""
    out = np.full(rows * coordinates, _EMPTY, np.uint64)
    for i in range(2 * coordinates):
        if not len(row):
            break
        h = mix(hashes + np.uint64((i + 1) * _ROUND & (1 << 64) - 1))
        value = h & np.uint64(0xFFFFFFFF)
        if i < coordinates:
            at = (((h >> np.uint64(32)) * np.uint64(coordinates)) >> np.uint64(32)).astype(np.int64)
        else:
            at = np.full(len(row), i - coordinates)
        cell = row * coordinates + at
        # A bin filled in an earlier round has a lesser value already.
        free = out[cell] == _EMPTY
        if free.any():
            cell, value = cell[free], value[free]
            np.minimum.at(out, cell, np.uint64(i << 32) | value)
        open_rows = (out.reshape(rows, coordinates) == _EMPTY).any(1)
        left = open_rows[row]
        if not left.all():
            row, hashes = row[left], hashes[left]
    return out.reshape(rows, coordinates)


def least_common(coordinates: int, percent: int, lost: float) -> int:
    """The most coordinates that all but `lost` of the pairs of this similarity have in common, by the binomial tail."""
    p, below = percent / 100, 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if below > lost:
            return k
    return coordinates


def _names(hashes: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set; starts are where the sets begin, none of them empty."""
    return tuple(mix(np.add.reduceat(mix(hashes ^ np.uint64(salt)), starts) + n.astype(np.uint64)) for salt in (0x2545F4914F6CDD1D, 0x6C8E9CF570932BD5))


def _describe(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for w in column_words(b.column(1), fold=True):
            row, hashes = shingle_sets(w, size)
            n = np.bincount(row, minlength=w.rows)
            starts = np.concatenate([[0], np.cumsum(n)])
            full = n > 0
            high, low = np.zeros(w.rows, np.uint64), np.zeros(w.rows, np.uint64)
            if len(row):
                high[full], low[full] = _names(hashes, starts[:-1][full], n[full])
            # Sixteen bits of each coordinate, four of them a band.
            packed = (mix(sketch_sets(row, hashes, w.rows)) & np.uint64(0xFFFF)).astype("<u2").view("<i8").reshape(w.rows, BANDS)
            offsets = np.arange(w.rows + 1, dtype=np.int32) * BANDS
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(w.row, w.rows), pa.array(n.astype(np.int64)), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(packed.reshape(-1)))], ["doc_id", "n", "high", "low", "sketch"])


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, band, cls): the classes of every bucket that has more than one, large ones split by second keys."""
    keys = classes.select("cls", "sketch", F.posexplode("sketch").alias("band", "key")).withColumn("bucket", F.xxhash64("band", "key"))
    counts = cut_lineage(keys.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    plain = keys.join(counts.where(F.col("size") <= HOT), "bucket", "left_semi").select("bucket", "band", "cls")
    hot = counts.where(F.col("size") > HOT)
    if not hot.limit(1).count():
        return plain
    # A second number of the same sketch; the pair of numbers is the bucket.
    other = F.transform(F.sequence(F.lit(1), F.lit(SHIFTS)), lambda s: F.xxhash64("bucket", s, F.get("sketch", (F.col("band") + s) % BANDS)))
    finer = cut_lineage(keys.join(hot, "bucket", "left_semi").select("band", "cls", F.explode(other).alias("bucket")))
    shared = finer.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    return plain.unionByName(finer.join(shared, "bucket", "left_semi").select("bucket", "band", "cls"))


def _cells(members: DataFrame, sizes: DataFrame, group: str, pairs: bool) -> DataFrame:
    """The rows of each block of each group, under the cell they are compared in: a block alone (side 0) and, with `pairs`, each two blocks of a
    group (sides 1 and 2). `sizes` has the group and its blocks."""
    m = members.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks")).cast("int"))
    if not pairs:
        return m.withColumn("cell", F.xxhash64(group, "block")).withColumn("side", F.lit(0))
    m = m.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    return m.withColumn("cell", F.xxhash64(group, F.least("block", "other"), F.greatest("block", "other"))).withColumn("side", side)


def _blocks(size: Column, tokens: Column | None = None) -> Column:
    count = F.ceil(size / BLOCK)
    return (count if tokens is None else F.greatest(count, F.ceil(tokens / BLOCK_TOKENS))).cast("int").alias("blocks")


def _in_cells(cells: DataFrame, columns: list[str]) -> DataFrame:
    return cells.select("cell", "side", *columns).repartition(F.xxhash64("cell")).sortWithinPartitions("cell", "side")


def _candidates(cells: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of each cell's candidates that are in different components."""
    common = least_common(COORDINATES, percent, LOST)
    return _in_cells(cells, ["cls", "n", "component", "sketch"]).mapInArrow(lambda b: _by_cell(b, lambda c: _forest_of(c, percent, common)), "a long, b long")


def _confirmed(cells: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of each cell's links, by their full sets."""
    common = least_common(COORDINATES, percent, LOST)
    return _in_cells(cells, ["cls", "n", "sketch", "tokens"]).mapInArrow(lambda b: _by_cell(b, lambda c: _links_of(c, percent, common)), "a long, b long")


def _by_cell(batches: Iterator[pa.RecordBatch], compare: Callable[[pa.Table], Iterator[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell; a cell is two blocks at most, and is held whole."""
    held: list[pa.RecordBatch] = []
    now, out = None, []
    for b in batches:
        if not b.num_rows:
            continue
        cell = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if cell[lo] != now:
                if held:
                    out += compare(pa.Table.from_batches(held).combine_chunks())
                now, held = cell[lo], []
            held.append(b.slice(lo, hi - lo))
        if len(out) > 10_000:
            yield _edges(out)
            out = []
    if held:
        out += compare(pa.Table.from_batches(held).combine_chunks())
    if out:
        yield _edges(out)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(pairs, np.int64).T
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


class _Cell:
    """The rows of a cell, and which of them a row is compared with."""

    def __init__(self, t: pa.Table, percent: int, common: int):
        self.side, self.cls, self.n = (t.column(c).to_numpy() for c in ("side", "cls", "n"))
        self.coordinates = t.column("sketch").combine_chunks().flatten().to_numpy().view("<u2").reshape(t.num_rows, COORDINATES)
        self.percent, self.common = percent, common

    def rows(self) -> list[int]:
        return np.flatnonzero(self.side < 2).tolist()

    def others(self, i: int, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows not yet connected with row i that may link with it, and in how many coordinates they agree."""
        others = np.flatnonzero(self.side == 2) if self.side[i] else np.arange(i + 1, len(self.cls))
        n, mine = self.n[others], self.n[i]
        others = others[(100 * mine >= self.percent * n) & (100 * n >= self.percent * mine) & (tree[others] != tree[i])]
        same = (self.coordinates[others] == self.coordinates[i]).sum(1)
        good = same >= self.common
        return others[good], same[good]


def _forest_of(t: pa.Table, percent: int, common: int) -> Iterator[tuple[int, int]]:
    cell = _Cell(t, percent, common)
    tree = t.column("component").to_numpy().copy()
    for i in cell.rows():
        others, same = cell.others(i, tree)
        for j in others[np.argsort(-same, kind="stable")].tolist():
            if tree[j] != tree[i]:
                tree[tree == tree[j]] = tree[i]
                yield int(cell.cls[i]), int(cell.cls[j])


def _links_of(t: pa.Table, percent: int, common: int) -> Iterator[tuple[int, int]]:
    cell = _Cell(t, percent, common)
    tokens = t.column("tokens").combine_chunks()
    starts, sizes = tokens.offsets.to_numpy()[:-1].astype(np.int64) - tokens.offsets[0].as_py(), cell.n
    _, codes = np.unique(tokens.flatten().to_numpy(), return_inverse=True)
    tree, mark = np.arange(len(cell.cls)), np.zeros(int(codes.max()) + 1, bool)
    for i in cell.rows():
        others, _ = cell.others(i, tree)
        if not len(others):
            continue
        own = codes[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        theirs = np.concatenate([codes[starts[j] : starts[j] + sizes[j]] for j in others.tolist()])
        both = np.add.reduceat(mark[theirs].astype(np.int64), np.cumsum(sizes[others]) - sizes[others])
        mark[own] = False
        for j in others[100 * both >= percent * (sizes[i] + sizes[others] - both)].tolist():
            if tree[j] != tree[i]:
                tree[tree == tree[j]] = tree[i]
                yield int(cell.cls[i]), int(cell.cls[j])


def _token_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (cls, high, text) in, (cls, tokens) out. Rows that share an id may differ in text; a class is meant by its name."""
    for b in batches:
        for w in column_words(b.column(2), fold=True):
            row, hashes = shingle_sets(w, size)
            n = np.bincount(row, minlength=w.rows)
            starts = np.concatenate([[0], np.cumsum(n)])
            good = n > 0
            if len(row):
                high = b.column(1).slice(w.row, w.rows).to_numpy().view(np.uint64)
                good[good] = _names(hashes, starts[:-1][good], n[good])[0] == high[good]
            sets = pa.LargeListArray.from_arrays(pa.array(starts), pa.array(hashes.view(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(w.row, w.rows), sets], ["cls", "tokens"]).filter(pa.array(good))


def _connected(edges: DataFrame) -> DataFrame:
    """(node, component) of the edges (a, b). They are first folded by as many tasks as there are EDGES_PER_TASK edges: what one task holds is done with,
    and more tasks leave stars for the rounds."""
    edges = cut_lineage(edges)
    tasks = -(-edges.count() // EDGES_PER_TASK)
    stars = cut_lineage(edges.coalesce(max(tasks, 1)).mapInArrow(_fold, "a long, b long"))
    if tasks > 1:
        return components(stars)
    return stars.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(stars.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; one document of each component is kept, that with the smallest id."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = cut_lineage(docs.mapInArrow(lambda b: _describe(b, size), _SCHEMA))
    named = rows.where("n > 0 and doc_id is not null").groupBy("high", "low").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = cut_lineage(named.withColumn("cls", F.monotonically_increasing_id()))  # numbered once: the table is written
    buckets = cut_lineage(_buckets(classes))
    members = cut_lineage(classes.join(buckets.select("cls").distinct(), "cls", "left_semi").select("cls", "n", "sketch", "least", "high"))
    sketched = members.select("cls", "n", "sketch")

    # Most candidates show in the first bands; after that, all buckets that still hold more than one component.
    early = buckets.where(F.col("band") < FIRST_BANDS)
    sizes = early.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket", _blocks(F.col("size")))
    first = cut_lineage(_candidates(_cells(early.join(sketched, "cls").withColumn("component", F.col("cls")), sizes, "bucket", False), percent))
    known = _connected(first)
    placed = cut_lineage(buckets.join(known, F.col("cls") == F.col("node"), "left").select("bucket", "cls", F.coalesce("component", "cls").alias("component")))
    split = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket", _blocks(F.col("size")))
    more = cut_lineage(_candidates(_cells(placed.join(sketched, "cls"), split, "bucket", True), percent))

    # Clusters of candidates, confirmed on full sets.
    clustered = members.join(_connected(first.unionByName(more)), F.col("cls") == F.col("node")).select("cls", "n", "sketch", "least", "high", F.col("component").alias("cluster"))
    clustered = cut_lineage(clustered)
    texts = docs.join(clustered.select("cls", "high", "least"), F.col("doc_id") == F.col("least")).select("cls", "high", "text")
    sets = texts.mapInArrow(lambda b: _token_sets(b, size), "cls long, tokens array<bigint>").groupBy("cls").agg(F.first("tokens").alias("tokens"))
    full = cut_lineage(clustered.select("cls", "n", "sketch", "cluster").join(sets, "cls"))
    sizes = cut_lineage(clustered.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("tokens")))
    usual = sizes.where(F.col("size") <= BANDS * BLOCK).select("cluster", _blocks(F.col("size"), F.col("tokens")))
    links = _confirmed(_cells(full, usual, "cluster", True), percent)
    large = sizes.where(F.col("size") > BANDS * BLOCK).select("cluster")
    if large.limit(1).count():
        of_large = full.join(large, "cluster", "left_semi")
        shared = cut_lineage(buckets.join(of_large.select("cls"), "cls", "left_semi"))
        sizes = shared.join(of_large.select("cls", "n"), "cls").groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("tokens")).where("size > 1")
        by_bucket = _cells(shared.join(of_large, "cls"), sizes.select("bucket", _blocks(F.col("size"), F.col("tokens"))), "bucket", True)
        links = links.unionByName(_confirmed(by_bucket, percent))
    known = _connected(links)
    of = classes.join(known, F.col("cls") == F.col("node"), "left").where("copies > 1 or node is not null").select("high", "low", F.coalesce("component", "cls").alias("root"), "least")
    roots = of.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = cut_lineage(of.join(roots, "root").select("high", "low", "component_id"))
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    out = rows.select("doc_id", "n", "high", "low").join(labels, ["high", "low"], "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
