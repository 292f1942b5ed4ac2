"""How far the sources of a language differ in their words: exact smoothed shares, a divergence for each pair of sources, the marked terms of each.

Frequencies come from a single-pass index.

1. A task reads its documents once and folds their terms into postings (language, term, source, occurrences, documents). When these fill
   BLOCK_BYTES they are put in term order, cut into hash shards and spilled as a run: packed chunks of CHUNK_ROWS postings, through the shuffle.
2. A shard's runs meet in one task. A heap holds the next chunk of each run by its first term; chunks are opened in that order, and all
   terms before the least one unread are complete: they are added up and leave. A language keeps the terms that enough documents have.
3. Shares need totals of the whole table, so they come after. With p the share of a source and p0 its share of a term it does not have, the
   divergence of two sources is V f(p0, p0), plus what each one's own terms change in it (a sum over the distinct counts of that source), plus a
   correction for each term that both have. The corrections are streamed over the postings in term order and held as sums of pairs.

Nothing is sampled; a frequent term, or a source with most of the rows, is one posting in each run, since runs add up before they leave. Shards
number SHARDS_PER_PARTITION times spark.sql.shuffle.partitions, so they grow with that setting. The pairs returned are all pairs of a
language's sources; nothing else here is quadratic in them but the corrections of a term, one for each pair of sources that have it.

Defined results: null language, source or text count as empty; every (language, source) that occurs is a group, even without terms, and then has
the even share of a smoothed count; without kept terms all values are 0; documents without an id or with a repeated one count like any other, since
ids are not read; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.llm.words import _BYTES, column_buffers, column_words, mix, span_hashes
from tracegrain.session import cut_lineage

SCALE = 1_000_000_000
LEAST_DOCS = 10
TOP_TERMS = 10
BLOCK_BYTES = 48_000_000  # postings a task holds before it spills a run
CHUNK_ROWS = 16_384
OPEN_ROWS = 400_000  # postings a merge gathers before it adds up those that are complete
PAIRS_AT_ONCE = 1_000_000
SHARDS_PER_PARTITION = 2

# Breaks between terms: all ASCII but letters.
_BREAKS = np.zeros(256, bool)
_BREAKS[:128] = True
_BREAKS[65:91] = _BREAKS[97:123] = False

_KEYS = ["lang", "term", "source"]
_RUN = pa.schema([("lang", pa.large_string()), ("term", pa.large_string()), ("source", pa.large_string()), ("n", pa.int64()), ("docs", pa.int64())])
_FREQUENCY = "lang string, term string, source string, n long, lang_n long, head boolean"


# Runs


def _piece_postings(b: pa.RecordBatch) -> Iterator[pa.Table]:
    """Postings of a batch of (text, lang, source), a few megabytes of text at a time."""
    names = [b.column(i).cast(pa.large_string()).fill_null("").dictionary_encode() for i in (1, 2)]
    (langs, sources), (lang, source) = [x.dictionary for x in names], [x.indices.to_numpy().astype(np.int64) for x in names]
    for w in column_words(b.column(0), fold=True, breaks=_BREAKS):
        if not len(w.starts):
            continue
        # The words one after another, without what parts them.
        ends = np.cumsum(w.ends - w.starts)
        inside = ~_BREAKS[w.data]
        body = pa.py_buffer(np.ascontiguousarray(w.data[inside]))
        offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64))
        words = pa.Array.from_buffers(pa.large_string(), len(w.starts), [None, offsets, body]).dictionary_encode()
        terms, many = words.dictionary, np.int64(len(words.dictionary))
        # Each document's terms once, then each group's.
        by_doc, tf = np.unique(w.owner() * many + words.indices.to_numpy(), return_counts=True)
        doc, term = by_doc // many + w.row, by_doc % many
        key = (lang[doc] * len(sources) + source[doc]) * many + term
        found, at, df = np.unique(key, return_inverse=True, return_counts=True)
        n = np.bincount(at, tf, len(found)).astype(np.int64)
        group = found // many
        yield pa.table([langs.take(pa.array(group // len(sources))), terms.take(pa.array(found % many)), sources.take(pa.array(group % len(sources))), pa.array(n), pa.array(df.astype(np.int64))], schema=_RUN)


def _added(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables)
    t = t.group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return t.select([*_KEYS, "n_sum", "docs_sum"]).rename_columns(_RUN.names)


def _pack(t: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t.combine_chunks())
    return out.getvalue().to_pybytes()


def _unpack(packed: bytes) -> pa.Table:
    with pa.ipc.open_stream(packed) as r:
        return r.read_all()


def _shard_of(terms: pa.ChunkedArray, shards: int) -> np.ndarray:
    """A hash of each term alone, the same in every task."""
    offsets, body = column_buffers(terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms)
    data = body[offsets[0] : offsets[-1]] if len(offsets) > 1 else body
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    out = np.empty(len(starts), np.int64)
    at = 0
    while at < len(starts):  # prefix sums over a bounded stretch of bytes
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + 1_000_000, "right")))
        piece = data[starts[at] : ends[to - 1]].astype(np.uint64) + np.uint64(1)
        h = span_hashes(piece, starts[at:to] - starts[at], ends[at:to] - starts[at], _BYTES)
        out[at:to] = (mix(h) % np.uint64(shards)).astype(np.int64)
        at = to
    return out


def _spill(t: pa.Table, shards: int, run: str) -> Iterator[pa.RecordBatch]:
    """One run: each shard's postings in the order of language, term, source, in packed chunks."""
    t = t.append_column("shard", pa.array(_shard_of(t.column("term"), shards)))
    t = t.sort_by([("shard", "ascending"), *((k, "ascending") for k in _KEYS)])
    shard = t.column("shard").to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
    t = t.drop_columns(["shard"])
    for lo, hi in zip(cuts, cuts[1:]):
        starts = range(lo, hi, CHUNK_ROWS)
        if lo == hi:
            continue
        parts = [t.slice(at, min(CHUNK_ROWS, hi - at)) for at in starts]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(shard[lo])] * len(parts), pa.int32()), pa.array([run] * len(parts)), pa.array(range(len(parts)), pa.int32()),
             *(pa.array([p.column(k)[0].as_py() for p in parts], pa.string()) for k in ("lang", "term")), pa.array([_pack(p) for p in parts], pa.binary())],
            ["shard", "run", "chunk", "lang", "term", "postings"])


def _index(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    size, floor = 0, 0  # floor: what was left after adding up
    for b in batches:
        for t in _piece_postings(b):
            held.append(t)
            size += t.nbytes
            if size - floor > BLOCK_BYTES // 2:
                held = [_added(held)]
                size = floor = held[0].nbytes
                if size > BLOCK_BYTES // 2:
                    yield from _spill(held[0], shards, uuid.uuid4().hex)
                    held, size, floor = [], 0, 0
    if held:
        yield from _spill(_added(held), shards, uuid.uuid4().hex)


# Merge


def _merge(batches: Iterator[pa.RecordBatch], least_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, run, chunk, lang, term, postings) sorted by the first three: the packed runs of one shard are held at a time."""
    now, runs = None, {}
    for b in batches:
        for shard, run, lang, term, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5)):
            if shard != now:
                yield from _merge_shard(list(runs.values()), least_docs)
                now, runs = shard, {}
            runs.setdefault(run, []).append((lang, term, packed.as_buffer()))
    yield from _merge_shard(list(runs.values()), least_docs)


def _merge_shard(runs: list[list[tuple[str, str, pa.Buffer]]], least_docs: int) -> Iterator[pa.RecordBatch]:
    """Chunks in the order of their first terms; Python orders strings by code point, which is the order of their UTF-8 bytes."""
    heap = [(run[0][0], run[0][1], r, 0) for r, run in enumerate(runs)]
    heapq.heapify(heap)
    opened: list[pa.Table] = []
    rows, limit = 0, OPEN_ROWS
    while heap:
        _, _, r, chunk = heapq.heappop(heap)
        opened.append(_unpack(runs[r][chunk][2]))
        rows += opened[-1].num_rows
        if chunk + 1 < len(runs[r]):
            heapq.heappush(heap, (*runs[r][chunk + 1][:2], r, chunk + 1))
        if rows > limit and heap:
            lang, term = heap[0][:2]
            whole = _added(opened)
            # What comes before the least term unread is complete.
            before = pc.or_(pc.less(whole["lang"], lang), pc.and_(pc.equal(whole["lang"], lang), pc.less(whole["term"], term)))
            yield from _frequencies(whole.filter(before), least_docs)
            opened = [whole.filter(pc.invert(before))]
            rows = opened[0].num_rows
            limit = max(OPEN_ROWS, 2 * rows)
    if opened:
        yield from _frequencies(_added(opened), least_docs)


def _frequencies(t: pa.Table, least_docs: int) -> Iterator[pa.RecordBatch]:
    """The postings of the terms that a language keeps, with the term's count in the language; the first one of a term is its head."""
    if not t.num_rows:
        return
    t = t.sort_by([(k, "ascending") for k in _KEYS]).combine_chunks()
    lang, term = (t.column(k).combine_chunks().dictionary_encode().indices.to_numpy() for k in ("lang", "term"))
    head = np.append(True, (lang[1:] != lang[:-1]) | (term[1:] != term[:-1]))
    starts = np.flatnonzero(head)
    sizes = np.diff(np.append(starts, len(head)))
    n, docs = t.column("n").to_numpy(), t.column("docs").to_numpy()
    keep = np.repeat(np.add.reduceat(docs, starts) >= least_docs, sizes)
    if keep.any():
        total = np.repeat(np.add.reduceat(n, starts), sizes)
        out = pa.table([*(t.column(k).cast(pa.string()) for k in _KEYS), pa.array(n), pa.array(total), pa.array(head)], names=[*_KEYS, "n", "lang_n", "head"]).filter(pa.array(keep))
        yield from out.combine_chunks().to_batches(max_chunksize=65_536)


def frequencies(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, source, n, lang_n, head: the occurrences of every kept term in every source that has it."""
    shards = SHARDS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"), F.col(source_col).cast("string"))
    runs = rows.mapInArrow(lambda b: _index(b, shards), "shard int, run string, chunk int, lang string, term string, postings binary")
    return runs.repartition("shard").sortWithinPartitions("shard", "run", "chunk").mapInArrow(lambda b: _merge(b, least_docs), _FREQUENCY)


# Shares and divergences


def share(count: Column, n: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (n + 2 kept)), exactly."""
    over = F.greatest(n + 2 * kept, F.lit(1)).cast("decimal(20,0)")
    return F.lit(1).cast("long") + _div(F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"), over)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so the square fits."""
    return _div((p - q) * (p - q), p + q)


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, term, source, p, zero) in term order in, sums (lang, a, b, value), a < b, out."""
    sums: dict[tuple[str, str, str], int] = {}
    held: list[pa.Table] = []
    rows = 0

    def flush() -> pa.RecordBatch:
        keys = list(sums)
        out = pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array(list(sums.values()), pa.int64())], ["lang", "a", "b", "value"])
        sums.clear()
        return out

    def take(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for more in _pair_sums(t):
            for k, v in more:
                sums[k] = sums.get(k, 0) + v
            if len(sums) > PAIRS_AT_ONCE:
                yield flush()

    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b]))
        rows += b.num_rows
        if rows < 100_000:
            continue
        t = pa.concat_tables(held).combine_chunks()
        lang, term = t.column(0)[-1], t.column(1)[-1]
        last = pc.and_(pc.equal(t.column(0), lang), pc.equal(t.column(1), term))
        yield from take(t.filter(pc.invert(last)))
        held = [t.filter(last)]  # the last term may go on
        rows = held[0].num_rows
    if held:
        yield from take(pa.concat_tables(held).combine_chunks())
    if sums:
        yield flush()


def _pair_sums(t: pa.Table) -> Iterator[list[tuple[tuple[str, str, str], int]]]:
    """Sums for the pairs of whole terms, at most about PAIRS_AT_ONCE pairs of postings at a time."""
    if not t.num_rows:
        return
    t = t.sort_by([("lang", "ascending"), ("term", "ascending"), ("source", "ascending")])
    langs, terms, sources = (t.column(i).combine_chunks().dictionary_encode() for i in range(3))
    lang, term, source = (x.indices.to_numpy().astype(np.int64) for x in (langs, terms, sources))
    p, zero = t.column(3).to_numpy(), t.column(4).to_numpy()
    ends = np.append(np.flatnonzero((np.diff(lang) != 0) | (np.diff(term) != 0)) + 1, len(lang))
    end = np.repeat(ends, np.diff(np.append(0, ends)))
    partners = end - np.arange(len(lang)) - 1
    upto = np.cumsum(partners)
    lo, many = 0, len(sources.dictionary)

    def f(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x - y) * (x - y) // (x + y)

    while lo < len(lang):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
        left = np.repeat(np.arange(lo, hi), partners[lo:hi])
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(partners[lo:hi]) - partners[lo:hi], partners[lo:hi])
        lo = hi
        if not len(left):
            continue
        change = f(p[left], p[right]) - f(p[left], zero[right]) - f(zero[left], p[right]) + f(zero[left], zero[right])
        key = (lang[left] * many + source[left]) * many + source[right]
        order = np.argsort(key, kind="stable")
        key, change = key[order], change[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        names = [(langs.dictionary[k // (many * many)].as_py(), sources.dictionary[k // many % many].as_py(), sources.dictionary[k % many].as_py()) for k in key[at].tolist()]
        yield list(zip(names, np.add.reduceat(change, at).tolist()))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank. Part 'pair': every other source of the language by divergence; part 'term': the `top` terms
    a source has more than its share of, by divergence from the language."""
    freq = cut_lineage(frequencies(docs, text_col, lang_col, source_col, least_docs))
    empty = F.lit("")
    groups = docs.select(F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"), F.coalesce(F.col(source_col).cast("string"), empty).alias("source")).distinct()
    of_lang = freq.groupBy("lang").agg(F.sum(F.col("head").cast("long")).alias("kept"), F.sum("n").alias("lang_total"))
    of_group = freq.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero_long = F.lit(0).cast("long")
    stats = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").select(
        "lang", "source", *(F.coalesce(c, zero_long).alias(c) for c in ("total", "kept", "lang_total")))
    stats = cut_lineage(stats.withColumn("zero", share(zero_long, F.col("total"), F.col("kept"))))

    shares = cut_lineage(freq.join(stats, ["lang", "source"]).select("lang", "term", "source", "n", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), "zero",
                                                                     share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q")))
    marked = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))

    a = stats.select("lang", F.col("source").alias("a"), F.col("kept"), F.col("zero").alias("zero_a"))
    b = stats.select("lang", F.col("source").alias("b"), F.col("zero").alias("zero_b"))
    pairs = a.join(b, "lang").where("a != b")
    # What the terms of a change against a source without any: one row for each distinct count of a.
    counts = shares.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("terms"))
    none = divergence(F.col("zero_a"), F.col("zero_b"))
    own = pairs.join(counts, ["lang", "a"]).groupBy("lang", "a", "b").agg(F.sum(F.col("terms") * (divergence(F.col("p"), F.col("zero_b")) - none)).alias("value"))
    both = shares.select("lang", "term", "source", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_corrections, "lang string, a string, b string, value long")
    base = pairs.select("lang", "a", "b", (F.col("kept") * none).alias("value"))
    flipped = [F.col("lang"), F.col("b").alias("a"), F.col("a").alias("b"), F.col("value")]
    both = cut_lineage(both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    own = cut_lineage(own)
    parts = base.unionByName(own).unionByName(own.select(*flipped)).unionByName(both).unionByName(both.select(*flipped))
    pair = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc()))
    return marked.withColumn("rank", rank).where(F.col("rank") <= top).unionByName(pair.withColumn("rank", rank))
