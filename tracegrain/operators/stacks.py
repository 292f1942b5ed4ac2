"""Weighted call stacks: trees, function rankings, neighbours, hottest path.

Input rows: run_id, path (outermost first) of ``struct<file,line,name,first_line,user>``, weight. Equal
paths are summed before anything is expanded, so the expansion grows with distinct stacks only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tracegrain.functions.paths import frame_origin, function_key, shown_name
from tracegrain.operators.scan import top_k, top_k_with_rest
from tracegrain.session import cut_lineage


def sample_weight(metric: str) -> Column:
    """Seconds of a stack sample under a measure: elapsed, python, native, system or unsplit."""
    if metric == "elapsed":
        return F.col("python_s") + F.col("native_s") + F.col("system_s") + F.col("unsplit_s")
    return F.col(f"{metric}_s")


def resolve_frames(ids: Column, frames: Column) -> Column:
    """Stack of frame ids to stack of frames, inside the row."""
    return F.transform(ids, lambda i: F.get(frames, i))


def stack_totals(samples: DataFrame, order: Sequence[str], cap: int | None = None, measure: str = "weight") -> DataFrame:
    """Totals per (thread, name, stack): the first ``cap`` stacks seen are kept (all without one), the rest summed as dropped."""
    totals = samples.groupBy("run_id", "thread", "thread_name", "path").agg(
        F.sum(measure).alias(measure), F.count(F.lit(1)).alias("samples"), F.min(F.struct(*order)).alias("__first"))
    kept = top_k_with_rest(totals, ["run_id"], [F.col("__first").asc(), F.to_json("path").asc(), F.col("thread").asc()], cap,
                           {"dropped": measure})
    return kept.drop("__first", "rank").withColumnRenamed("omitted_rows", "dropped_stacks")


def select_stacks(samples: DataFrame, thread: str | None = None, focus: Column | None = None, user_only: bool = False) -> DataFrame:
    """Summed distinct stacks of one measure, optionally of one thread, through one function, or user frames only."""
    s = samples.where(F.col("weight") > 0)
    if thread is not None:
        s = s.where(F.col("thread") == thread)
    if focus is not None:
        s = s.where(F.exists("path", lambda f: function_key(f) == focus))
    if user_only:
        s = s.withColumn("path", F.filter("path", lambda f: f["user"]))
    return s.where(F.size("path") > 0).groupBy("run_id", "path").agg(F.sum("weight").alias("weight"))


def _step(key: Column, name: Column, kind: Column, frames: Column) -> Column:
    return F.struct(key.alias("key"), name.alias("name"), kind.alias("kind"), frames.alias("frames"))


def display_path(path: Column, view: str = "all", inverted: bool = False) -> Column:
    """A stack as tree steps: every frame, runs of one origin merged (grouped), or user frames (mine)."""
    if view == "mine":
        path = F.filter(path, lambda f: f["user"])

    def facts(f: Column) -> Column:  # named once, so the origin rules are not repeated in the plan
        return F.struct((function_key(f) if inverted else F.to_json(f)).alias("id"), shown_name(f).alias("name"),
                        frame_origin(f["file"], f["user"], f["line"]).alias("origin"))

    known = F.transform(path, facts)

    def one(k: Column) -> Column:
        return _step(k["id"], k["name"], k["origin"]["kind"], F.array(k["id"]))

    steps = F.transform(known, one)
    if view == "grouped":
        def tag(k: Column) -> Column:
            o = k["origin"]
            return F.when(o["kind"] == "user", one(k)).otherwise(
                _step(F.concat(F.lit("group:"), o["kind"], F.lit("|"), o["label"]), o["label"], o["kind"], F.array(k["id"])))
        tagged = F.transform(known, tag)
        empty = F.slice(tagged, F.lit(1), F.lit(0))

        def fold(done: Column, step: Column) -> Column:
            last = F.get(done, F.size(done) - 1)
            same = (F.size(done) > 0) & step["key"].startswith("group:") & (last["key"] == step["key"])
            merged = _step(last["key"], last["name"], last["kind"], F.concat(last["frames"], step["frames"]))
            return F.when(same, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(merged))).otherwise(F.concat(done, F.array(step)))

        steps = F.aggregate(tagged, empty, fold)
    return F.reverse(steps) if inverted else steps


_ROOT = (0, 0)


def _root() -> Column:
    return F.struct(*[F.lit(x).cast("long").alias(n) for n, x in zip("hl", _ROOT)])


def _nodes(keys: Column) -> Column:
    """The tree nodes a stack passes, the root first: a node is named by 128 bits of its parent's name and its own step key."""
    def child(parent: Column, key: Column) -> Column:
        return F.struct(F.xxhash64(parent["h"], parent["l"], key).alias("h"), F.xxhash64(F.lit("step"), key, parent["l"], parent["h"]).alias("l"))

    return F.aggregate(keys, F.array(_root()), lambda done, key: F.concat(done, F.array(child(F.element_at(done, -1), key))))


def call_tree(samples: DataFrame, view: str = "all", inverted: bool = False, thread: str | None = None,
              focus: Column | None = None) -> DataFrame:
    """One row per tree node: node and parent (names of 128 bits; the root has no parent), depth, key, name and kind of its step, value, self.

    A row holds its own step only, so what is shuffled grows with the depth of the stacks, not with its square; ``with_paths`` puts whole paths
    to the nodes that are shown. value = self + the children's values.
    """
    s = select_stacks(samples, thread, focus)
    s = s.withColumn("__steps", display_path(F.col("path"), view, inverted))
    s = s.withColumn("__nodes", _nodes(F.transform("__steps", lambda x: x["key"])))
    n = F.size("__steps")

    def at(i: Column) -> Column:
        step = F.get("__steps", i - 1)
        return F.struct(F.get("__nodes", i).alias("node"), F.get("__nodes", i - 1).alias("parent"), i.alias("depth"), step["key"].alias("key"), step["name"].alias("name"),
                        step["kind"].alias("kind"), (i == n).alias("leaf"))

    d = s.select("run_id", "weight", F.explode(F.transform(F.sequence(F.lit(0), n), at)).alias("n")).select("run_id", "weight", "n.*")
    return d.groupBy("run_id", "node").agg(
        F.sum("weight").alias("value"), F.sum(F.when(F.col("leaf"), F.col("weight")).otherwise(F.lit(0))).alias("self"),
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("key").alias("key"), F.min("name").alias("name"), F.min("kind").alias("kind"))


def with_paths(tree: DataFrame) -> DataFrame:
    """The tree with the step keys and names from the root to each node (``path``, ``names``). Each round doubles the stretch a node knows, so
    rounds grow with the logarithm of the depth."""
    tree = cut_lineage(tree)
    one = F.when(F.col("depth") > 0, F.array(F.struct("key", "name"))).otherwise(F.expr("cast(array() as array<struct<key:string,name:string>>)"))
    known = tree.select("run_id", "node", F.col("parent").alias("up"), one.alias("steps"))
    reach, deepest = 1, tree.agg(F.max("depth")).first()[0] or 0
    while reach <= deepest:
        above = known.select("run_id", F.col("node").alias("up"), F.col("up").alias("__up"), F.col("steps").alias("__steps"))
        known = cut_lineage(known.join(above, ["run_id", "up"], "left").select(
            "run_id", "node", F.col("__up").alias("up"), F.when(F.col("__steps").isNull(), F.col("steps")).otherwise(F.concat("__steps", "steps")).alias("steps")))
        reach *= 2
    paths = known.select("run_id", "node", F.transform("steps", lambda x: x["key"]).alias("path"), F.transform("steps", lambda x: x["name"]).alias("names"))
    return tree.join(paths, ["run_id", "node"])


def group_members(samples: DataFrame, view: str = "grouped", thread: str | None = None, shown: int | None = None) -> DataFrame:
    """Frames each merged step stands for, by tree node: their count and names, the first ``shown`` where that is given."""
    s = select_stacks(samples, thread).withColumn("__steps", display_path(F.col("path"), view))
    s = s.withColumn("__nodes", _nodes(F.transform("__steps", lambda x: x["key"])))
    merged = F.filter(F.transform("__steps", lambda x, i: F.struct(F.get("__nodes", i + 1).alias("node"), x["key"].alias("key"), x["frames"].alias("frames"))), lambda x: x["key"].startswith("group:"))
    d = s.select("run_id", F.explode(merged).alias("m")).select("run_id", "m.node", F.explode("m.frames").alias("frame")).distinct()
    named = d.withColumn("member", F.coalesce(F.get_json_object("frame", "$.name"), F.lit("")))
    counts = named.groupBy("run_id", "node").agg(F.count(F.lit(1)).alias("members"))
    first = top_k(named.select("run_id", "node", "member").distinct(), ["run_id", "node"], [F.col("member").asc()], shown)
    names = first.groupBy("run_id", "node").agg(F.array_sort(F.collect_list("member")).alias("names"))
    return counts.join(names, ["run_id", "node"])


def limit_tree(tree: DataFrame, limit: int | None = None) -> DataFrame:
    """The ``limit`` largest nodes (all without one); a cut child's value is shown as ``omitted`` on its kept parent.

    Ranked by value, then depth, so every kept node's ancestors are kept. value = self + omitted + children.
    """
    if limit is None:
        return tree.withColumn("omitted", F.lit(0).cast("long"))
    tree = cut_lineage(tree)
    kept = top_k(tree, ["run_id"], [F.col("value").desc(), F.col("depth").asc(), F.col("key").asc(), F.col("node").asc()], limit).drop("rank")
    kept = cut_lineage(kept)
    cut = tree.join(kept.select("run_id", "node"), ["run_id", "node"], "left_anti").groupBy("run_id", F.col("parent").alias("node")).agg(F.sum("value").alias("omitted"))
    out = kept.join(cut, ["run_id", "node"], "left")
    return out.withColumn("omitted", F.coalesce("omitted", F.lit(0)))


def hottest_path(tree: DataFrame) -> DataFrame:
    """Nodes reached by following the biggest child while it carries at least 5% of the root and beats its parent's self.

    Every parent's choice is one row with a reference to that parent; references are doubled until they reach the root or a node that
    was not chosen, so rounds grow with the logarithm of the path.
    """
    tree = cut_lineage(tree.select("run_id", "node", "parent", "depth", "key", "name", "value", "self"))
    start = tree.where(F.col("depth") == 0).select("run_id", F.col("value").alias("__start"))
    best = tree.where(F.col("depth") > 0).groupBy("run_id", "parent").agg(
        F.min_by(F.struct("node", "value", "key", "name", "depth", "self"), F.struct((-F.col("value")).alias("v"), F.col("key"), F.col("node"))).alias("b"))
    parents = tree.select("run_id", F.col("node").alias("parent"), F.col("self").alias("__parent_self"))
    chosen = best.join(parents, ["run_id", "parent"]).join(start, "run_id").where(
        (F.col("b.value") >= 0.05 * F.col("__start")) & (F.col("__parent_self") < F.col("b.value"))).select("run_id", "parent", "b.*")
    chosen = cut_lineage(chosen)
    links = chosen.select("run_id", "node", F.col("parent").alias("up"))
    at_root = F.col("up") == _root()
    while not links.where(~at_root).isEmpty():
        above = links.select("run_id", F.col("node").alias("up"), F.col("up").alias("__up"))
        further = links.where(~at_root).join(above, ["run_id", "up"]).select("run_id", "node", F.col("__up").alias("up"))
        links = cut_lineage(links.where(at_root).unionByName(further))  # a node whose reference was not chosen is gone
    return chosen.join(links.select("run_id", "node"), ["run_id", "node"], "left_semi")


def _function_paths(samples: DataFrame, thread: str | None, view: str, focus: Column | None) -> DataFrame:
    s = select_stacks(samples, thread, focus, user_only=view == "mine")
    fns = F.transform("path", lambda f: F.struct(function_key(f).alias("key"), f.alias("frame")))
    return s.withColumn("__fns", fns).withColumn("__keys", F.transform("__fns", lambda x: x["key"])).select("run_id", "weight", "__fns", "__keys")


def top_functions(samples: DataFrame, view: str = "all", thread: str | None = None, focus: Column | None = None, limit: int | None = None,
                  functions: DataFrame | None = None) -> DataFrame:
    """Functions by self weight: self, total (once per stack, so recursion is not doubled), distinct callers.

    With ``functions`` (run_id, file, first_line, peak_mb) the user rows also carry their held memory.
    """
    s = _function_paths(samples, thread, view, focus)
    d = s.select("run_id", "weight", "__keys", F.posexplode("__fns").alias("pos", "fn"))
    key = F.col("fn.key")
    previous = F.when(F.col("pos") > 0, F.get("__keys", F.col("pos") - 1))
    first_here = F.array_position("__keys", key) == F.col("pos") + 1
    leaf = F.col("pos") == F.size("__keys") - 1
    frame = F.col("fn.frame")
    # One pass: sums by function and caller, then by function; a row of the first is a caller of the second.
    per = d.groupBy("run_id", key.alias("key"), F.when(previous != key, previous).alias("caller")).agg(
        F.sum(F.when(leaf, F.col("weight")).otherwise(F.lit(0))).alias("self"),
        F.sum(F.when(first_here, F.col("weight")).otherwise(F.lit(0))).alias("total"),
        F.min(F.struct(shown_name(frame).alias("name"), frame["file"].alias("file"), frame["first_line"].alias("first_line"),
                       frame["user"].alias("user"))).alias("__f"))
    rows = per.groupBy("run_id", "key").agg(F.sum("self").alias("self"), F.sum("total").alias("total"), F.count("caller").alias("callers"), F.min("__f").alias("__f"))
    out = rows.select("run_id", "key", "self", "total", "callers", "__f.*")
    if functions is not None:
        held = functions.select("run_id", "file", "first_line", F.col("peak_mb").alias("memory_mb"))
        out = out.join(held, ["run_id", "file", "first_line"], "left").withColumn("memory_mb", F.when(F.col("user"), F.col("memory_mb")))
    return top_k(out, ["run_id"], [F.col("self").desc(), F.col("total").desc(), F.col("key").asc()], limit)


def neighbors(samples: DataFrame, focus_key: Column, view: str = "all", thread: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows (role, key, name, value): the function itself, its self weight, its callers and its callees."""
    s = _function_paths(samples, thread, view, None).withColumn("__focus", focus_key)
    s = s.where(F.array_contains("__keys", F.col("__focus")))
    n = F.size("__keys")
    at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("__keys", i) == F.col("__focus"))
    ups = F.transform(F.filter(at, lambda i: (i > 0) & (F.get("__keys", i - 1) != F.col("__focus"))), lambda i: F.get("__fns", i - 1))
    downs = F.transform(F.filter(at, lambda i: (i + 1 < n) & (F.get("__keys", i + 1) != F.col("__focus"))), lambda i: F.get("__fns", i + 1))

    def side(role: str, fns: Column) -> DataFrame:
        return s.select("run_id", "weight", F.explode(F.array_distinct(F.transform(fns, lambda x: F.struct(
            x["key"].alias("key"), shown_name(x["frame"]).alias("name"))))).alias("x")).groupBy(
                "run_id", F.lit(role).alias("role"), F.col("x.key").alias("key")).agg(F.min("x.name").alias("name"), F.sum("weight").alias("value"))

    linked = top_k(side("caller", ups).unionByName(side("callee", downs)), ["run_id", "role"], [F.col("value").desc(), F.col("key").asc()], limit)
    own = s.groupBy("run_id").agg(
        F.sum("weight").alias("function"), F.sum(F.when(F.get("__keys", n - 1) == F.col("__focus"), F.col("weight")).otherwise(F.lit(0))).alias("self"),
        F.first("__focus").alias("key"), F.min(shown_name(F.filter("__fns", lambda x: x["key"] == F.col("__focus"))[0]["frame"])).alias("name"))
    own = own.unpivot(["run_id", "key", "name"], ["function", "self"], "role", "value")
    return (own if limit is None else own.withColumn("rank", F.lit(1))).unionByName(linked)
