"""Resharding by minimum-cost flow.

Old shards hold some bytes each, new shards have capacities. Which bytes go where is a transport problem between shards: a byte
that stays costs nothing, a byte that moves costs one. It is solved on the shard sizes alone (a graph of old x new shards,
whatever the corpus). Every old shard is then read as a line of documents in a fixed order and cut into one run for each
transfer. Positions on that line come from sums over blocks of about a megabyte, so no task orders more than one
block, and the table of blocks is the only thing that is ordered by shard.

Defined results: a null text counts no bytes and has checksum 0; every row counts one byte besides its text. Documents
that lie across a cut, and LOOSE_DOCS small ones of each old shard, are given, largest first, to the shard with most room left. Repeated rows are placed one by one; a null id has a
place like any other. An empty table gives an empty table. Of other columns only a hash is kept (`row_key`), by which rewrite() finds a place's row.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracegrain.session import cut_lineage

BLOCK_BYTES = 1 << 20
LOOSE_DOCS = 64


def min_cost_flow(supply: list[int], capacity: list[int]) -> list[list[int]]:
    """Bytes from each old to each new shard that move the fewest bytes. Old shard i is new shard i where there is one.

    Successive shortest paths with edges old -> new of cost 0 (the same shard) or 1. The capacities must hold the supply.
    """
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    room: dict[tuple[int, int], int] = {}
    cost: dict[tuple[int, int], int] = {}
    for i, s in enumerate(supply):
        room[source, i], cost[source, i] = s, 0
        for j in range(m):
            room[i, n + j], cost[i, n + j] = s, int(i != j)
    for j, c in enumerate(capacity):
        room[n + j, sink], cost[n + j, sink] = c, 0
    for (u, v), c in list(cost.items()):
        room[v, u], cost[v, u] = 0, -c
    after: dict[int, list[int]] = {}
    for u, v in cost:
        after.setdefault(u, []).append(v)
    left = sum(supply)
    while left:
        best, came, queue = {source: 0}, {}, deque([source])
        while queue:
            u = queue.popleft()
            for v in after[u]:
                if room[u, v] > 0 and best[u] + cost[u, v] < best.get(v, 1 << 60):
                    best[v], came[v] = best[u] + cost[u, v], u
                    queue.append(v)
        if sink not in came:
            raise ValueError("the new shards cannot hold the old ones")
        path, v = [], sink
        while v != source:
            path.append((came[v], v))
            v = came[v]
        amount = min([left, *(room[e] for e in path)])
        for u, v in path:
            room[u, v] -= amount
            room[v, u] += amount
        left -= amount
    return [[room[n + j, i] for j in range(m)] for i in range(n)]


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def _choose(pairs: list[tuple[Column, int]], otherwise: int) -> Column:
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def row_key(docs: DataFrame, id_col: str) -> Column:
    """64 bits of all of a row but its shard. Maps are hashed as JSON; a null is told from a value by its flag."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields if f.name != "shard" or f.name == id_col}
    parts = [F.to_json(F.struct(docs[c])) if "map<" in kind else docs[c] for c, kind in sorted(kinds.items())]
    return F.xxhash64(*(x for p in parts for x in (p.isNull(), p)))


def reshard(docs: DataFrame, old_shard: Column, old_shards: int, shards: int, capacities: list[int] | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, loose_docs: int = LOOSE_DOCS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, old_shard, shard, slot (gapless from 0 in each shard), row_key.

    old_shard gives each row's shard now, 0 to old_shards - 1. capacities are the bytes each new shard takes; near equal if not given.
    """
    text = F.col(text_col)
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(old_shard, F.lit(0)).cast("int").alias("old_shard"),
        row_key(docs, id_col).alias("row_key")))
    sizes = {r["old_shard"]: r["size"] for r in rows.groupBy("old_shard").agg(F.sum("size").alias("size")).collect()}  # one row a shard
    supply = [sizes.get(i, 0) for i in range(old_shards)]
    flow = min_cost_flow(supply, capacities or even_capacities(sum(supply), shards))

    # A document's place on its old shard's line: the blocks before it, then the documents before it in its block.
    blocks = _choose([(F.col("old_shard") == i, max(1, -(-s // block_bytes))) for i, s in enumerate(supply)], 1)
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), blocks.cast("long")))
    in_block = W.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    keyed = keyed.withColumn("before", F.coalesce(F.sum("size").over(in_block), F.lit(0)))
    sums = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), blocks.cast("long"))).groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"))
    line = W.partitionBy("old_shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("old_shard", "block", F.coalesce(F.sum("bytes").over(line), F.lit(0)).alias("block_start"))
    placed = cut_lineage(
        keyed.join(starts, ["old_shard", "block"])
        .select("doc_id", "size", "text_crc32", "row_key", "old_shard", "block", (F.col("block_start") + F.col("before")).alias("start")))

    inside = [((F.col("old_shard") == i) & (F.col("start") >= a) & (F.col("start") + F.col("size") <= b), j) for i, a, b, j in _runs(flow)]
    whole = placed.withColumn("shard", _choose(inside, -1))
    # Loose documents even out what the cuts leave: those across a cut, one at most for each transfer, and the few smallest of each old shard.
    small = whole.where("shard >= 0").withColumn("slice", F.pmod(F.xxhash64("start"), F.lit(256)))
    for part in (["old_shard", "slice"], ["old_shard"]):  # the smallest of each slice first, so that no task ranks a shard
        small = small.withColumn("nth", F.row_number().over(W.partitionBy(*part).orderBy("size", "start"))).where(F.col("nth") <= loose_docs)
    small = small.drop("nth", "slice")
    loose = whole.where("shard < 0").unionByName(small).select("old_shard", "start", "size", "shard").collect()  # old shards x (new shards + loose_docs) at most
    loads = {r["shard"]: r["size"] for r in whole.where("shard >= 0").groupBy("shard").agg(F.sum("size").alias("size")).collect()}
    room = [sum(f[j] for f in flow) - loads.get(j, 0) for j in range(len(flow[0]))]
    fixed = even_out(room, [tuple(r) for r in loose])
    fixes = F.broadcast(docs.sparkSession.createDataFrame(fixed, "old_shard int, start long, fixed int"))
    whole = cut_lineage(whole.join(fixes, ["old_shard", "start"], "left").withColumn("shard", F.coalesce("fixed", "shard")).drop("fixed"))

    # Slots: the rows of the blocks before, then the row's number in its block.
    counts = whole.groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n"))
    order = W.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select("shard", "old_shard", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"))
    numbered = whole.withColumn("number", F.row_number().over(W.partitionBy("shard", "old_shard", "block").orderBy("start")) - 1)
    return numbered.join(firsts, ["shard", "old_shard", "block"]).select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("first") + F.col("number")).cast("long").alias("slot"), "row_key")


def _runs(flow: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """(old shard, from byte, to byte, new shard): what stays first, then the transfers by new shard."""
    out = []
    for i, row in enumerate(flow):
        at = 0
        for j in sorted(range(len(row)), key=lambda j: (j != i, j)):
            if row[j]:
                out.append((i, at, at + row[j], j))
                at += row[j]
    return out


def even_out(room: list[int], loose: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(old shard, start, shard) for (old shard, start, size, shard) rows; shard -1 is not placed yet. room is what each shard has left.

    What is not placed goes, largest first, to the shard with most room. Then placed ones move from the fullest shard to the emptiest, the
    largest first that takes neither past its capacity, as long as there is one.
    """
    room, out, movable = list(room), [], {j: [] for j in range(len(room))}
    for old, start, size, shard in sorted(loose, key=lambda r: (-r[2], r[0], r[1])):
        if shard < 0:
            shard = max(range(len(room)), key=lambda j: (room[j], j == old, -j))
            room[shard] -= size
            out.append((old, start, shard))
        else:
            movable[shard].append((size, old, start))
    while True:
        full, empty = min(range(len(room)), key=room.__getitem__), max(range(len(room)), key=room.__getitem__)
        found = next((m for m in movable[full] if m[0] <= min(-room[full], room[empty])), None)
        if found is None:
            return out
        movable[full].remove(found)
        room[full] += found[0]
        room[empty] -= found[0]
        out.append((found[1], found[2], empty))


def rewrite(docs: DataFrame, plan: DataFrame, folder: str, id_col: str = "doc_id") -> list[int]:
    """Write again, under `folder`/shard=N, the shards that lost or gained documents, and only those. Returns their numbers.

    `plan` is reshard()'s result for `docs`. The other shards' files are left as they are. Rows meet their places by id (null or not) and by a
    hash of all they hold, so rows that share an id are told apart; rows alike in all columns are copies, and each place gets one. Nothing is
    written unless docs has as many rows of each kind as the plan.
    """
    keyed = docs.withColumns({"_id": F.col(id_col), "_key": row_key(docs, id_col)})
    ours = keyed.select("_id", "_key", F.lit(1).alias("n"))
    counts = ours.unionByName(plan.select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), F.lit(-1).alias("n"))).groupBy("_id", "_key")
    if counts.agg(F.sum("n").alias("n")).where("n <> 0").limit(1).count():
        raise ValueError("the plan is not of these rows")
    moved = plan.where(F.col("shard") != F.col("old_shard"))
    touched = sorted({r[0] for r in moved.select(F.explode(F.array("shard", "old_shard"))).distinct().collect()})  # shard numbers
    places = plan.where(F.col("shard").isin(touched)).select(F.col("doc_id").alias("_place_id"), F.col("row_key").alias("_place_key"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    here = F.col("_id").eqNullSafe(F.col("_place_id")) & (F.col("_key") == F.col("_place_key"))
    (keyed.dropDuplicates(["_id", "_key"]).join(places, here).drop("_id", "_key", "_place_id", "_place_key", "shard").withColumnRenamed("_shard", "shard")
     .repartition("shard", F.floor(F.col("_slot") / 100_000)).sortWithinPartitions("shard", "_slot").drop("_slot")
     .write.partitionBy("shard").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(folder))
    return touched
