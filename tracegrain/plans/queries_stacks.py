"""Catalogue: stacks, trees and function rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracegrain.functions.paths import function_key
from tracegrain.operators import stacks as ops
from tracegrain.plans import adapters as ad
from tracegrain.plans.registry import query

_LEVEL = """list_value(r_name, n_name, c_mktsegment, o_orderpriority)"""
_DISTINCT = ad.SQL_STACKS + """,
d AS (SELECT path, CAST(sum(weight) AS BIGINT) AS w FROM stacks GROUP BY path)"""


def _tree(df: DataFrame) -> DataFrame:
    """Trees with readable node text: step names from the root."""
    return ops.with_paths(df).select(F.array_join("names", ">").alias("node"), F.col("depth").cast("int").alias("depth"),
                                     F.col("value").cast("long").alias("value"), F.col("self").cast("long").alias("self_value"))


_TREE_SQL = """
SELECT array_to_string(p[1:i], '>') AS node, CAST(i AS INTEGER) AS depth, CAST(sum(w) AS BIGINT) AS value,
       CAST(sum(CASE WHEN len(p) = i THEN w ELSE 0 END) AS BIGINT) AS self_value
FROM (SELECT p, w, unnest(range(0, len(p) + 1)) AS i FROM v) GROUP BY p[1:i], i"""


@query("stack_totals_capped", f"""WITH {ad.SQL_STACKS},
s AS (SELECT thread, path, sum(weight) AS weight, count(*) AS samples, min(o_orderkey) AS f FROM stacks GROUP BY thread, path),
r AS (SELECT *, row_number() OVER (ORDER BY f, thread) AS rk, sum(weight) OVER () AS total FROM s)
SELECT thread, array_to_string(path, '>') AS stack, CAST(weight AS BIGINT) AS weight, samples,
       CAST(total - (SELECT sum(weight) FROM r WHERE rk <= 100) AS BIGINT) AS dropped,
       CAST((SELECT count(*) FROM r) - 100 AS BIGINT) AS dropped_stacks
FROM r WHERE rk <= 100""")
def stack_totals_capped(spark, folder):
    out = ops.stack_totals(ad.stacks(spark, folder), ["seq"], cap=100)
    names = F.array_join(F.transform("path", lambda f: f["name"]), ">")
    return out.select("thread", names.alias("stack"), "weight", "samples", "dropped", "dropped_stacks")


@query("call_tree", f"WITH {_DISTINCT}, v AS (SELECT path AS p, w FROM d) {_TREE_SQL}")
def call_tree(spark, folder):
    return _tree(ops.call_tree(ad.stacks(spark, folder)))


@query("call_tree_mine", f"""WITH {_DISTINCT}, v AS (SELECT [path[1], path[4]] AS p, sum(w) AS w FROM d GROUP BY 1) {_TREE_SQL}""")
def call_tree_mine(spark, folder):
    return _tree(ops.call_tree(ad.stacks(spark, folder), view="mine"))


@query("call_tree_grouped", f"""WITH {_DISTINCT},
v AS (SELECT [path[1], 'geo (installed package)', path[4]] AS p, sum(w) AS w FROM d GROUP BY 1) {_TREE_SQL}""")
def call_tree_grouped(spark, folder):
    return _tree(ops.call_tree(ad.stacks(spark, folder), view="grouped"))


@query("call_tree_inverted", f"WITH {_DISTINCT}, v AS (SELECT list_reverse(path) AS p, w FROM d) {_TREE_SQL}")
def call_tree_inverted(spark, folder):
    return _tree(ops.call_tree(ad.stacks(spark, folder), inverted=True))


@query("call_tree_thread", f"""WITH {ad.SQL_STACKS},
v AS (SELECT path AS p, sum(weight) AS w FROM stacks WHERE thread = 'F' GROUP BY path) {_TREE_SQL}""")
def call_tree_thread(spark, folder):
    return _tree(ops.call_tree(ad.stacks(spark, folder), thread="F"))


@query("focus_tree", f"WITH {_DISTINCT}, v AS (SELECT path AS p, w FROM d WHERE path[3] = 'MACHINERY') {_TREE_SQL}")
def focus_tree(spark, folder):
    frame = F.struct(F.lit("/venv/lib/site-packages/geo/mkt.py").alias("file"), F.lit(9).alias("first_line"), F.lit("MACHINERY").alias("name"))
    return _tree(ops.call_tree(ad.stacks(spark, folder), focus=function_key(frame)))


@query("group_members", f"""WITH {_DISTINCT},
m AS (SELECT DISTINCT path[1] AS region, unnest([path[2], path[3]]) AS member FROM d)
SELECT region || '>geo (installed package)' AS node, count(*) AS members,
       array_to_string(list_sort(list(member)), ',') AS names FROM m GROUP BY region""")
def group_members(spark, folder):
    stacks = ad.stacks(spark, folder)
    shown = ops.with_paths(ops.call_tree(stacks, view="grouped")).select("run_id", "node", F.array_join("names", ">").alias("text"))
    out = ops.group_members(stacks).join(shown, ["run_id", "node"])
    return out.select(F.col("text").alias("node"), "members", F.array_join("names", ",").alias("names"))


@query("call_tree_limited", f"""WITH {_DISTINCT}, v AS (SELECT path AS p, w FROM d),
t AS ({_TREE_SQL}),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC, depth, node) AS rk FROM t),
k AS (SELECT * FROM r WHERE rk <= 60),
c AS (SELECT CASE WHEN contains(node, '>') THEN regexp_replace(node, '>[^>]*$', '') ELSE '' END AS parent, sum(value) AS omitted FROM r WHERE rk > 60 GROUP BY 1)
SELECT k.node, k.depth, k.value, k.self_value, CAST(coalesce(c.omitted, 0) AS BIGINT) AS omitted
FROM k LEFT JOIN c ON c.parent = k.node""")
def call_tree_limited(spark, folder):
    out = ops.with_paths(ops.limit_tree(ops.call_tree(ad.stacks(spark, folder)), 60))
    return out.select(F.array_join("names", ">").alias("node"), F.col("depth").cast("int").alias("depth"), "value",
                      F.col("self").alias("self_value"), F.col("omitted").cast("long").alias("omitted"))


_HOTTEST = """
t AS ({tree}),
n AS (SELECT *, CASE WHEN depth = 1 THEN '' ELSE regexp_replace(node, '>[^>]*$', '') END AS parent FROM t WHERE depth > 0),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY value DESC, node) AS rk FROM n) WHERE rk = 1),
h AS (SELECT node, depth, value, self_value FROM t WHERE depth = 0
      UNION ALL SELECT b.node, b.depth, b.value, b.self_value FROM h JOIN b ON b.parent = h.node
      WHERE b.value >= 0.05 * (SELECT value FROM t WHERE depth = 0) AND h.self_value < b.value)
SELECT node, depth, value, self_value FROM h WHERE depth > 0""".format(tree=_TREE_SQL)


def _hottest(samples: DataFrame) -> DataFrame:
    tree = ops.call_tree(samples)
    on_path = ops.hottest_path(tree)
    parts = F.collect_list(F.struct("depth", "name"))
    names = F.transform(F.array_sort(parts), lambda x: x["name"])  # one path for each run
    whole = on_path.groupBy("run_id").agg(names.alias("names"))
    return on_path.join(whole, "run_id").select(F.array_join(F.slice("names", F.lit(1), F.col("depth")), ">").alias("node"), F.col("depth").cast("int").alias("depth"),
                                                F.col("value").cast("long").alias("value"), F.col("self").cast("long").alias("self_value"))


@query("hottest_path", f"""WITH RECURSIVE {_DISTINCT}, v AS (SELECT path AS p, w FROM d), {_HOTTEST}""")
def hottest_path(spark, folder):
    return _hottest(ad.stacks(spark, folder))


@query("hottest_path_deep", f"""WITH RECURSIVE v AS (SELECT [l_returnflag, l_linestatus, CASE WHEN l_quantity > 10 THEN 'many' ELSE 'few' END, CASE WHEN l_discount < 0.08 THEN 'plain' ELSE 'cut' END,
  CASE WHEN l_tax < 0.07 THEN 'low' ELSE 'high' END, 'line' || CAST(l_linenumber AS VARCHAR)] AS p, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS w FROM lineitem GROUP BY 1), {_HOTTEST}""")
def hottest_path_deep(spark, folder):
    return _hottest(ad.deep_stacks(spark, folder))


_FUNCTIONS = """
o AS (SELECT p, w, unnest(range(1, len(p) + 1)) AS i FROM v),
x AS (SELECT p[i] AS name, sum(CASE WHEN i = len(p) THEN w ELSE 0 END) AS self_value, sum(w) AS total FROM o GROUP BY 1),
e AS (SELECT name, count(DISTINCT caller) AS callers FROM (SELECT p[i] AS name, p[i - 1] AS caller FROM o WHERE i > 1) GROUP BY name)
SELECT x.name, CAST(self_value AS BIGINT) AS self_value, CAST(total AS BIGINT) AS total, coalesce(e.callers, 0) AS callers,
       row_number() OVER (ORDER BY self_value DESC, total DESC, {tie}) AS rank
FROM x LEFT JOIN e USING (name)"""
_TIE = """CASE WHEN x.name IN (SELECT r_name FROM region) THEN '/app/main.py' WHEN x.name IN (SELECT o_orderpriority FROM orders) THEN '/app/prio.py'
  WHEN x.name IN (SELECT n_name FROM nation) THEN '/v1' ELSE '/v2' END, x.name"""


@query("top_functions", f"WITH {_DISTINCT}, v AS (SELECT path AS p, w FROM d), {_FUNCTIONS.format(tie=_TIE)}")
def top_functions(spark, folder):
    return _functions(ops.top_functions(ad.stacks(spark, folder), limit=200))


@query("top_functions_mine", f"""WITH {_DISTINCT}, v AS (SELECT [path[1], path[4]] AS p, w FROM d), {_FUNCTIONS.format(tie=_TIE)}""")
def top_functions_mine(spark, folder):
    return _functions(ops.top_functions(ad.stacks(spark, folder), view="mine", limit=200))


def _functions(df):
    return df.select("name", F.col("self").cast("long").alias("self_value"), "total", "callers", F.col("rank").cast("long").alias("rank"))


@query("neighbors", f"""WITH {_DISTINCT},
f AS (SELECT * FROM d WHERE path[3] = 'BUILDING')
SELECT 'function' AS role, 'BUILDING' AS name, CAST(sum(w) AS BIGINT) AS value FROM f
UNION ALL SELECT 'self', 'BUILDING', CAST(0 AS BIGINT)
UNION ALL SELECT * FROM (SELECT 'caller', path[2], CAST(sum(w) AS BIGINT) AS v FROM f GROUP BY 2)
UNION ALL SELECT 'callee', path[4], CAST(sum(w) AS BIGINT) FROM f GROUP BY 2""")
def neighbors(spark, folder):
    frame = F.struct(F.lit("/venv/lib/site-packages/geo/mkt.py").alias("file"), F.lit(8).alias("first_line"), F.lit("BUILDING").alias("name"))
    return ops.neighbors(ad.stacks(spark, folder), function_key(frame)).select("role", "name", F.col("value").cast("long").alias("value"))
