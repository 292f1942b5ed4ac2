"""N-gram Jaccard join with a token-group matrix.

Documents are sets of word shingles; two link when their Jaccard similarity reaches the threshold, exactly. Documents with equal sets are one
class; the work is on classes.

1. Tokens stand in one order: first those known, from a count-min sketch, to be in one document, then those of few documents, then
   frequent ones. Two linked sets of n tokens share one of the first n - ceil(t n) + 1. Tokens of one document decide nothing, so a document that is mostly its own has no
   deciding token and is done; the others are active.
2. Active classes are partitioned into groups of similar ones: those of like size whose least token of the most frequent kind is the same, in
   parts of GROUP_CLASSES at most, so near copies of one text lie in few groups however many they are.
3. The matrix holds, for each group, the union of its members' tokens in two forms. The sparse one has a row for each (token, group) over the
   deciding tokens. The dense one folds all tokens into COLUMNS columns and keeps, for each, the most any member has: the sum over
   columns of the smaller of two such counts is never less than the overlap of any two members.
4. Groups that share a deciding token, have fitting sizes and pass that bound are opened, and every group with itself. In an opened pair the
   members are compared by their own columns, in one task; pairs that the bound lets through are compared by their texts. This is done
   twice: first a spanning forest of each opened pair's candidates, the most promising first; then, with what those links have
   connected, all candidates that are still in different components. So large groups of copies are not expanded into all their pairs.

Every pair of classes is thus excluded by a bound, compared, or connected already.

Defined results: a null text or one without words has no shingles and is linked with nothing; one with fewer words than a shingle has one
shingle, all its words. Rows without an id have no component and are linked with nothing. Equal texts are one component, repeated rows
among them; rows that share an id but not a text are judged text by text. An empty table gives an empty table. Other columns are not read. Sets and shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracegrain.llm.components import components
from tracegrain.llm.sketch import Filter, key_filter, key_filters
from tracegrain.llm.words import Words, column_words, mix
from tracegrain.session import cut_lineage

SHINGLE = 4
PERCENT = 85
COLUMNS = 256
GROUP_CLASSES = 512
HOT = 16  # documents from which a token counts as frequent
SKETCH_BITS = 1 << 28  # cells of the token sketch at most: 32 MB on every executor
_CLASS_SCHEMA = "doc_id long, n long, cls long, key long, columns binary, prefix array<bigint>"


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each text's distinct shingles, ordered by row and hash."""
    begin, hashes, at = w.windows(size)
    row = np.repeat(np.arange(w.rows), np.diff(at))
    few = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(few):
        hashes = np.concatenate([hashes, w.span_hashes(w.first[few], w.first[few + 1], salt=11)])
        row = np.concatenate([row, few])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1]))[: len(row)]
    return row[new], hashes[new]


def _digests(hashes: np.ndarray, heads: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One 64-bit name for each set of shingles; heads are where the sets start, none of them empty."""
    return mix(np.add.reduceat(mix(hashes ^ np.uint64(0x632BE59BD9B4E019)), heads) + n.astype(np.uint64))


def _token_keys(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    for w in column_words(column, fold=True):
        yield shingle_sets(w, size)[1]


def _describe(batches: Iterator[pa.RecordBatch], size: int, percent: int, shared: Filter, hot: Filter) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for w in column_words(b.column(1), fold=True):
            row, hashes = shingle_sets(w, size)
            n = np.bincount(row, minlength=w.rows)
            start = np.concatenate([[0], np.cumsum(n)])
            full = n > 0
            cls = np.zeros(w.rows, np.uint64)
            if len(row):
                cls[full] = _digests(hashes, start[:-1][full], n[full])
            cells = np.bincount(row * COLUMNS + (hashes >> np.uint64(56)).astype(np.int64), minlength=w.rows * COLUMNS)
            cells = np.minimum(cells, (1 << 31) - 1).astype("<i4").reshape(w.rows, COLUMNS)
            # The order: tokens known to be in one document, then those of few, then frequent ones; by hash where equal.
            rank = shared.mask(hashes).astype(np.int8)
            rank += hot.mask(hashes) & (rank > 0)
            order = np.lexsort((hashes, rank, row))
            place = np.arange(len(row)) - start[row]
            decide = (place < (n - -(-percent * n // 100) + 1)[row]) & (rank[order] > 0)
            chosen, of = hashes[order][decide], row[decide]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=w.rows))]).astype(np.int32)
            # Similar sets have their least frequent-or-shared token in common, most of the time, and a like size.
            key, top = cls.copy(), np.zeros(w.rows, np.int8)
            np.maximum.at(top, row, rank)
            common = np.flatnonzero((rank > 0) & (rank == top[row]))
            if len(common):
                first = np.flatnonzero(np.append(True, row[common][1:] != row[common][:-1]))
                band = np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent)).astype(np.uint64)
                rows = row[common][first]
                key[rows] = mix(np.minimum.reduceat(mix(hashes[common] ^ np.uint64(0xC2B2AE3D27D4EB4F)), first) ^ mix(band[rows]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(w.row, w.rows), pa.array(n), pa.array(cls.view(np.int64)), pa.array(key.view(np.int64)),
                 pa.array([r.tobytes() if z > a else b"" for r, a, z in zip(cells, offsets, offsets[1:])], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(chosen.view(np.int64)))],
                ["doc_id", "n", "cls", "key", "columns", "prefix"])


def least_overlap(n_a: Column, n_b: Column, percent: int) -> Column:
    """The least overlap of two linked sets of these sizes."""
    return F.ceil((F.lit(percent) * (n_a + n_b)) / F.lit(100.0 + percent) - 1e-9)


@F.arrow_udf(T.LongType())
def column_overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    """The sum over columns of the smaller count: no less than the overlap."""
    return pa.array(np.minimum(_counts(a), _counts(b)).sum(1, dtype=np.int64))


def _fits(a: str, b: str, percent: int) -> Column:
    """Sizes that a linked pair may have."""
    return (F.lit(100) * F.col(a) >= F.lit(percent) * F.col(b)) & (F.lit(100) * F.col(b) >= F.lit(percent) * F.col(a))


class _Join:
    """The classes of a table, and the comparison of pairs of them."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.docs, self.size, self.percent = docs, size, percent
        shared, hot = key_filters(docs.select("text"), lambda b: _token_keys(b.column(0), size), 2, hot=HOT, bits_per_key=2, max_bits=SKETCH_BITS, lines=1)
        self.rows = cut_lineage(docs.mapInArrow(lambda b: _describe(b, size, percent, shared, hot), _CLASS_SCHEMA))
        # One row for each distinct set. Which of the equal rows gives the columns and tokens does not matter.
        self.classes = cut_lineage(
            self.rows.where("n > 0 and doc_id is not null").groupBy("cls")
            .agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.first("key").alias("key"), F.first("columns").alias("columns"), F.first("prefix").alias("prefix")))

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, rep_a, rep_b) that link, by their texts."""
        open_ = cut_lineage(pairs.distinct())
        ids = open_.select(F.explode(F.array("rep_a", "rep_b")).alias("id")).distinct()
        wanted = key_filter(ids, _long_keys, 1)

        @F.arrow_udf("boolean")
        def may_be_wanted(column: pa.Array) -> pa.Array:
            return pa.array(wanted.mask(column.fill_null(0).to_numpy().view(np.uint64)))

        some = self.docs.where(F.col("doc_id").isNotNull()).where(may_be_wanted("doc_id"))
        texts = cut_lineage(some.join(ids, some["doc_id"] == ids["id"], "left_semi").dropDuplicates(["doc_id", "text"]))
        size, percent = self.size, self.percent
        a = texts.select(F.col("doc_id").alias("rep_a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("doc_id").alias("rep_b"), F.col("text").alias("text_b"))
        rows = open_.join(a, "rep_a").join(b, "rep_b").select("a", "b", "text_a", "text_b")
        return cut_lineage(rows.mapInArrow(lambda x: _compare(x, size, percent), "a long, b long").distinct())


def _long_keys(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield b.column(0).to_numpy().view(np.uint64)


def _compare(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for at in range(0, big.num_rows, 256):
            b = big.slice(at, 256)
            sets = []
            for c in (2, 3):
                mine = []
                for w in column_words(b.column(c), fold=True):
                    row, hashes = shingle_sets(w, size)
                    mine += np.split(hashes, np.cumsum(np.bincount(row, minlength=w.rows))[:-1])
                sets.append(mine)
            good = np.zeros(b.num_rows, bool)
            names = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().view(np.uint64)
            for i, (x, y) in enumerate(zip(*sets)):
                # Rows that share an id may differ; the text of a class is the one that gives its name.
                if len(x) and len(y) and all(_digests(s, np.zeros(1, np.int64), np.array([len(s)]))[0] == names[k][i] for k, s in enumerate((x, y))):
                    spot = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    both = int((y[spot] == x).sum())
                    good[i] = 100 * both >= percent * (len(x) + len(y) - both)
            if good.any():
                keep = pa.array(good)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])


def _members(join: _Join) -> DataFrame:
    """cls, rep, n, columns, prefix and group of the active classes."""
    active = join.classes.where(F.size("prefix") > 0)
    large = cut_lineage(active.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > GROUP_CLASSES).select("key", F.ceil(F.col("members") / GROUP_CLASSES).alias("parts")))
    part = F.pmod(F.xxhash64("cls"), F.coalesce("parts", F.lit(1)))
    return cut_lineage(active.join(large, "key", "left").select("cls", "rep", "n", "columns", "prefix", F.xxhash64("key", part).alias("group")))


def _group_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(g, h), g < h: the pairs of groups that share a deciding token, have fitting sizes and pass the bound of their unions."""
    matrix = cut_lineage(members.select("group", "n", F.explode("prefix").alias("token")).groupBy("token", "group").agg(F.min("n").alias("lo"), F.max("n").alias("hi")))
    left = matrix.select("token", F.col("group").alias("g"), F.col("lo").alias("g_lo"), F.col("hi").alias("g_hi"))
    right = matrix.select("token", F.col("group").alias("h"), F.col("lo").alias("h_lo"), F.col("hi").alias("h_hi"))
    near = (F.col("g") < F.col("h")) & (100 * F.col("g_hi") >= percent * F.col("h_lo")) & (100 * F.col("h_hi") >= percent * F.col("g_lo"))
    pairs = cut_lineage(left.join(right, "token").where(near).select("g", "h").distinct())
    unions = _unions(members.join(pairs.select(F.explode(F.array("g", "h")).alias("group")).distinct(), "group", "left_semi"))
    g = unions.select(F.col("group").alias("g"), F.col("lo").alias("g_lo"), F.col("columns").alias("g_columns"))
    h = unions.select(F.col("group").alias("h"), F.col("lo").alias("h_lo"), F.col("columns").alias("h_columns"))
    both = pairs.join(g, "g").join(h, "h").withColumn("most", column_overlap("g_columns", "h_columns"))
    return cut_lineage(both.where(F.col("most") >= least_overlap(F.col("g_lo"), F.col("h_lo"), percent)).select("g", "h"))


def _unions(members: DataFrame) -> DataFrame:
    """(group, lo, columns): the least size, and per column the most tokens that any member has. A group is GROUP_CLASSES rows at most."""
    # Dealt by a hash of its own: a deal by the column itself can be left out after a join on it, and that join's parts be split when they are skewed.
    return cut_lineage(members.select("group", "n", "columns").repartition(F.xxhash64("group")).sortWithinPartitions("group").mapInArrow(_fold_columns, "group long, lo long, columns binary"))


def _fold_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, lo, top = None, 0, None
    out: list[tuple[int, int, bytes]] = []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], ["group", "lo", "columns"])

    for b in batches:
        for group, n, columns in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            x = np.frombuffer(columns.as_buffer(), "<i4")
            if group != now:
                if now is not None:
                    out.append((now, lo, top.tobytes()))
                now, lo, top = group, n, x.copy()
            else:
                lo = min(lo, n)
                np.maximum(top, x, out=top)
        if len(out) >= 4096:
            yield flush()
            out = []
    if now is not None:
        out.append((now, lo, top.tobytes()))
    if out:
        yield flush()


def _candidates(opened: DataFrame, members: DataFrame, percent: int, forest: bool) -> DataFrame:
    """(a, b, rep_a, rep_b): pairs of members of opened pairs of groups that sizes and columns let through and that are in different components;
    with `forest`, a spanning forest of them for each group. `opened` has a group (g) and what it is compared with (h), itself or a smaller one."""
    carried = members.select("group", "cls", "rep", "n", "component", "columns")
    homes = opened.select("g").distinct().withColumn("group", F.col("g")).join(carried, "group").withColumn("side", F.lit(0))
    guests = opened.where("g != h").select("g", F.col("h").alias("group")).join(carried, "group").withColumn("side", F.lit(1))
    rows = homes.unionByName(guests).select("g", "side", "cls", "rep", "n", "component", "columns")
    return rows.repartition(F.xxhash64("g")).sortWithinPartitions("g", "side").mapInArrow(lambda b: _compare_members(b, percent, forest), "a long, b long, rep_a long, rep_b long")


def _compare_members(batches: Iterator[pa.RecordBatch], percent: int, forest: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, its own members (side 0, GROUP_CLASSES at most) before the others. Others are taken batch by batch."""
    now, parts, home = None, [], None
    for b in batches:
        if not b.num_rows:
            continue
        rows = (*(b.column(i).to_numpy() for i in range(6)), _counts(b.column(6)))
        cuts = [0, *(np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            mine = tuple(x[lo:hi] for x in rows)
            if mine[0][0] != now:
                if home is None and parts:
                    yield from _pairs_of(_joined(parts), None, percent, forest)
                now, parts, home = mine[0][0], [], None
            if mine[1][0] == 0:
                parts.append(mine)
                continue
            if home is None:
                home = _joined(parts)
                yield from _pairs_of(home, None, percent, forest)
            yield from _pairs_of(home, mine, percent, forest)
    if home is None and parts:
        yield from _pairs_of(_joined(parts), None, percent, forest)


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*parts))


def _counts(column: pa.Array) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    if not len(column):
        return np.zeros((0, COLUMNS), "<i4")
    body = np.frombuffer(column.buffers()[2], np.uint8)
    return body[column.offset * 4 * COLUMNS : (column.offset + len(column)) * 4 * COLUMNS].view("<i4").reshape(len(column), COLUMNS)


def _pairs_of(home: tuple[np.ndarray, ...], guests: tuple[np.ndarray, ...] | None, percent: int, forest: bool) -> Iterator[pa.RecordBatch]:
    """Candidates among the home members, or of guests with them."""
    all_rows = home if guests is None else _joined([home, guests])
    _, _, cls, rep, n, component, counts = all_rows
    own, pairs, ratios = len(home[0]), [], []
    for i in range(own) if guests is None else range(own, len(cls)):
        others = np.arange(i + 1, own) if guests is None else np.arange(own)
        both = percent * (n[i] + n[others])
        fits = (100 * n[i] >= percent * n[others]) & (100 * n[others] >= percent * n[i]) & (component[i] != component[others])
        others, both = others[fits], both[fits]
        if len(others):
            most = np.minimum(counts[i], counts[others]).sum(1, dtype=np.int64)
            good = (100 + percent) * most >= both
            pairs.append(np.stack([np.full(int(good.sum()), i), others[good]], 1))
            ratios.append(most[good] / both[good])
    if pairs and sum(map(len, pairs)):
        found = np.concatenate(pairs)
        if forest:
            found = _forest(found, np.concatenate(ratios))
        for at in range(0, len(found), 8192):
            yield _as_rows(found[at : at + 8192], cls, rep)


def _as_rows(pairs: np.ndarray, cls: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
    swap = cls[pairs[:, 0]] > cls[pairs[:, 1]]
    a, b = np.where(swap, pairs[:, 1], pairs[:, 0]), np.where(swap, pairs[:, 0], pairs[:, 1])
    return pa.RecordBatch.from_arrays([pa.array(cls[a]), pa.array(cls[b]), pa.array(rep[a]), pa.array(rep[b])], ["a", "b", "rep_a", "rep_b"])


def _forest(pairs: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """A spanning forest of the pairs, taken by falling ratio."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    keep = []
    for e in np.argsort(-ratios, kind="stable").tolist():
        x, y = find(int(pairs[e, 0])), find(int(pairs[e, 1]))
        if x != y:
            root[x] = y
            keep.append(e)
    return pairs[keep]


def link_table(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, edges): doc_id, n and cls of every row; links between classes that connect all that are connected."""
    join = _Join(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), size, percent)
    members = _members(join)
    sizes = cut_lineage(members.groupBy("group").agg(F.count("*").alias("size")))
    alone = sizes.where("size > 1").select(F.col("group").alias("g"), F.col("group").alias("h"))
    # The smaller group of a pair goes to the larger.
    pairs = _group_pairs(members, percent)
    sized = pairs.join(sizes.select(F.col("group").alias("g"), F.col("size").alias("g_size")), "g").join(sizes.select(F.col("group").alias("h"), F.col("size").alias("h_size")), "h")
    larger = F.col("g_size") >= F.col("h_size")
    opened = cut_lineage(sized.select(F.when(larger, F.col("g")).otherwise(F.col("h")).alias("g"), F.when(larger, F.col("h")).otherwise(F.col("g")).alias("h")).unionByName(alone))
    first = join.linked(_candidates(opened, members.withColumn("component", F.col("cls")), percent, forest=True))
    known = cut_lineage(components(first))
    placed = cut_lineage(members.join(known, members["cls"] == known["node"], "left").withColumn("component", F.coalesce("component", "cls")).drop("node"))
    more = join.linked(_candidates(opened, placed, percent, forest=False))
    return join.rows.select("doc_id", "n", "cls"), first.unionByName(more)


def component_table(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, edges = link_table(docs, size, percent, id_col, text_col)
    known = cut_lineage(components(edges))
    of = rows.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("least")).join(known, F.col("cls") == F.col("node"), "left")
    of = of.select("cls", F.coalesce("component", "cls").alias("root"), "least")
    roots = cut_lineage(of.groupBy("root").agg(F.min("least").alias("component_id")))
    labels = cut_lineage(of.join(roots, "root").select(F.col("cls").alias("_cls"), "component_id"))
    own = (F.col("cls") == F.col("_cls")) & (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return rows.join(labels, own, "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_clusters(docs: DataFrame, size: int = 5, percent: int = 80, text_col: str = "text") -> DataFrame:
    """(cluster, into): xxhash64 of each text that is a near duplicate, and what stands for its component, for texts where the two differ.

    Texts are named by their hash, so rows without an id, or that share one, have a cluster like any other.
    """
    texts = docs.select(F.xxhash64(text_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = component_table(texts, size, percent).where("doc_id <> component_id")
    return cut_lineage(found.groupBy(F.col("doc_id").alias("cluster")).agg(F.min("component_id").alias("into")))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each group, with all its columns; rows that repeat an id and text count as one. Rows without an id stay."""
    kept = component_table(docs, size, percent, id_col, text_col).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).groupBy("_kept").agg(F.count("*").alias("_rows"))
    kept = cut_lineage(kept)
    first = docs.join(kept, docs[id_col].cast("long") == F.col("_kept"), "left_semi")
    if kept.where("_rows > 1").limit(1).count():
        first = first.dropDuplicates([id_col, text_col])
    return first.unionByName(docs.where(F.col(id_col).isNull()))
