"""Owner graphs as node and edge tables: breadth-first reachability, cycles, owner paths, footprint."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame, functions as F

from tracegrain.operators.scan import scan, top_k
from tracegrain.session import cut_lineage


@dataclass(frozen=True)
class Reach:
    """``nodes``: run_id, node, depth, parent (null at a root), label of the step, rank among the run's nodes of that depth. ``complete``: run_id, complete, object_count."""

    nodes: DataFrame
    complete: DataFrame


SMALL_LEVEL = 100_000  # nodes of a level up to which it is sent to the edges; past that both are dealt by their keys


def reach(roots: DataFrame, edges: DataFrame, max_depth: int | None = None, max_nodes: int | None = None, ranks: bool = True) -> Reach:
    """Nodes reachable from the roots, each once with the first path that finds it, level by level.

    A level is one join of the frontier with the edges, one anti-join with the nodes seen and one reduction to the first step per new
    node; each is checkpointed, so lineage does not grow, and the loop ends when no edge leads to a new node, before the last level is ranked. The nodes
    come without their ranks, which cost an order of the last level, where ``ranks`` is not set.
    First means: fewest steps, then the path that comes first, label by label. A node keeps its parent only, and its rank among the nodes of its
    level stands for its path in that order, so a row does not grow with the depth; ``paths`` rebuilds whole paths where they are shown. All levels
    are walked unless ``max_depth`` is given. A run is complete when nothing lay beyond it, nor past ``max_nodes`` nodes in that order (dropped only when that
    is given).
    """
    def ranked(level: DataFrame, depth: int) -> DataFrame:
        """The rank is left to those who read it: it is one scan of a level that is written."""
        placed = scan(level, ["run_id"], ["__above", "label", "node"], row_number="rank")
        return placed.select("run_id", "node", F.lit(depth).alias("depth"), "parent", "label", "rank")

    first = roots.groupBy("run_id", "node").agg(F.min("label").alias("label"))
    first = cut_lineage(first.select("run_id", "node", F.lit(0).cast("long").alias("__above"), F.lit(None).cast(dict(edges.dtypes)["src"]).alias("parent"), "label"))
    columns = ["run_id", "node", "depth", "parent", "label"]
    fresh, size, seen, levels = first, first.count(), first.select("run_id", "node"), []
    for depth in count(1):
        plain = fresh.withColumn("depth", F.lit(depth - 1)).select(*columns)
        if max_depth is None or depth <= max_depth:
            ends = plain.select("run_id", F.col("node").alias("src"))
            steps = edges.join(F.broadcast(ends) if size <= SMALL_LEVEL else ends, ["run_id", "src"]).select("run_id", F.col("dst").alias("node"), "label", "src")
            steps = cut_lineage(steps.join(seen, ["run_id", "node"], "left_anti"))
            done = steps.isEmpty()
        else:
            done = True
        if done and not ranks and max_nodes is None:
            levels.append(plain)
            break
        frontier = ranked(fresh, depth - 1)
        levels.append(frontier if ranks or max_nodes is not None else frontier.select(*columns))
        if done:
            break
        above = frontier.select("run_id", F.col("node").alias("src"), F.col("rank").alias("__above"))
        found = steps.join(above, ["run_id", "src"]).groupBy("run_id", "node").agg(F.min(F.struct("__above", "label", F.col("src").alias("parent"))).alias("best"))
        fresh = cut_lineage(found.select("run_id", "node", "best.*"))
        size, seen = fresh.count(), seen.unionByName(fresh.select("run_id", "node"))
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    beyond = nodes.where(F.col("depth") == max_depth if max_depth is not None else F.lit(False)).join(
        edges.select("run_id", F.col("src").alias("node")), ["run_id", "node"], "left_semi").select("run_id").distinct().withColumn("__cut", F.lit(True))
    counts = nodes.groupBy("run_id").agg(F.count(F.lit(1)).alias("object_count")).join(beyond, "run_id", "left")
    fits = F.col("object_count") <= max_nodes if max_nodes is not None else F.lit(True)
    complete = counts.select("run_id", (F.col("__cut").isNull() & fits).alias("complete"), "object_count")
    if max_nodes is not None:
        nodes = top_k(nodes.withColumnRenamed("rank", "__rank"), ["run_id"], [F.col("depth").asc(), F.col("__rank").asc()], max_nodes).drop("rank").withColumnRenamed("__rank", "rank")
    return Reach(nodes, complete)


def _jumps(nodes: DataFrame) -> Iterator[tuple[DataFrame, bool]]:
    """(run_id, at, up): the ancestor 1, 2, 4, ... steps above each node that has one, up to the deepest node; with each, whether it is the last."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    jump, length = nodes.where(F.col("parent").isNotNull()).select("run_id", F.col("node").alias("at"), F.col("parent").alias("up")), 1
    while length <= deepest:
        last = 2 * length > deepest
        yield jump, last
        if not last:
            jump = jump.join(jump.select("run_id", F.col("at").alias("up"), F.col("up").alias("__up")), ["run_id", "up"]).select("run_id", "at", F.col("__up").alias("up"))
            jump = jump if 4 * length > deepest else cut_lineage(jump)  # the last is read once
        length *= 2


def _stems(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(run_id, node, stem): the labels from the root to each wanted node, as an array. Each round doubles the stretch above them that is known;
    nothing is built for other nodes."""
    on_path = wanted.join(nodes.select("run_id", "node"), ["run_id", "node"]).withColumn("at", F.col("node"))
    for jump, last in _jumps(nodes):
        on_path = on_path.unionByName(on_path.join(jump, ["run_id", "at"]).select("run_id", "node", F.col("up").alias("at")))
        on_path = on_path if last else cut_lineage(on_path)
    steps = on_path.join(nodes.select("run_id", F.col("node").alias("at"), "depth", "label"), ["run_id", "at"])
    whole = F.transform(F.array_sort(F.collect_list(F.struct("depth", "label"))), lambda x: x["label"])  # as long as the path that is asked for
    return steps.groupBy("run_id", "node").agg(whole.alias("stem"))


def _with_paths(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows (run_id, node, others) with path and depth of their nodes, null where these are not reached. Nodes that one node owns share what is above
    it, so that is built once for each owner, from the nodes above the deepest ones only."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    found = cut_lineage(rows.join(nodes.select("run_id", "node", "depth", "parent", "label"), ["run_id", "node"], "left"))
    owners = found.where(F.col("parent").isNotNull()).select("run_id", F.col("parent").alias("node")).distinct()
    stems = _stems(nodes.where(F.col("depth") < deepest), owners).withColumnRenamed("node", "parent")
    whole = F.concat(F.coalesce("stem", F.array().cast("array<string>")), F.array(F.col("label").cast("string")))
    path = F.when(F.col("depth").isNotNull(), F.array_join(whole, ".")).alias("path")
    return found.join(stems, ["run_id", "parent"], "left").select(*rows.columns, path, "depth")


def paths(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(run_id, node, path): the labels from the root to each target that was reached."""
    return _with_paths(nodes, targets.select("run_id", "node").distinct()).where(F.col("depth").isNotNull()).drop("depth")


def cycles(nodes: DataFrame, edges: DataFrame, shown: int | None = None) -> DataFrame:
    """Edges that lead back to an ancestor of their source (or to itself): the first ``shown`` of each run (all without one) with the total.

    The ancestor of the source at the depth of the edge's end is found by jumps of 1, 2, 4, ... steps; the edge closes a cycle when it is that end. A cycle
    is informational; it is not a leak.
    """
    at = nodes.select("run_id", F.col("node").alias("src"), F.col("depth").alias("__from"))
    to = nodes.select("run_id", F.col("node").alias("dst"), F.col("depth").alias("__to"))
    up = edges.join(at, ["run_id", "src"]).join(to, ["run_id", "dst"]).where(F.col("__to") <= F.col("__from"))
    up = cut_lineage(up.select("run_id", "src", "dst", "label", F.col("__from").alias("depth"), (F.col("__from") - F.col("__to")).alias("__gap"), F.col("src").alias("at")))
    for bit, (jump, _) in enumerate(_jumps(nodes)):
        due = F.col("__gap").bitwiseAND(1 << bit) != 0
        moved = up.where(due).join(jump, ["run_id", "at"]).withColumn("at", F.col("up")).drop("up")
        up = cut_lineage(up.where(~due).unionByName(moved))
    back = cut_lineage(up.where(F.col("at") == F.col("dst")))
    known = paths(nodes, back.select("run_id", F.col("src").alias("node"))).withColumnRenamed("node", "src")
    found = back.join(known, ["run_id", "src"]).select("run_id", F.col("dst").alias("object"), F.concat_ws(".", "path", "label").alias("path"), (F.col("depth") + 1).alias("depth"))
    totals = found.groupBy("run_id").agg(F.count(F.lit(1)).alias("cycles"))
    first = top_k(found, ["run_id"], [F.col("depth").asc(), F.col("path").asc()], shown)
    return first.join(totals, "run_id")


def owner_paths(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """The path that owns each target node; null when it is not reachable."""
    return _with_paths(nodes, targets)


def footprint(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Objects and bytes of the reached graph by type, every node counted once."""
    return nodes.select("run_id", "node").join(sizes, ["run_id", "node"]).groupBy("run_id", "type").agg(
        F.count(F.lit(1)).alias("objects"), F.sum("bytes").alias("bytes"))
