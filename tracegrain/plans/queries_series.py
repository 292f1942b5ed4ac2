"""Catalogue: lines, series and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrain.functions.measures import READER_RULE, RECORDER_RULE
from tracegrain.operators import lines as line_ops, retention as ret, series as ops
from tracegrain.operators.scan import top_k_with_rest
from tracegrain.plans import adapters as ad
from tracegrain.plans.registry import query, table

_LINES = ad.SQL_SAMPLES + """,
lines AS (SELECT run_id, file, line, first_line, CAST(sum(weight) AS BIGINT) AS weight, count(*) AS samples FROM samples GROUP BY ALL)"""


def lines(spark, folder):
    return line_ops.line_totals(ad.samples(spark, folder), ["weight"], ["run_id", "file", "line", "first_line"])


@query("line_time", f"""WITH {_LINES} SELECT run_id, file, line, weight, samples,
round(weight / CAST(sum(weight) OVER (PARTITION BY run_id) AS DOUBLE), 9) AS share FROM lines""")
def line_time(spark, folder):
    return line_ops.with_share(lines(spark, folder), "weight").drop("first_line").withColumn("share", F.round("share", 9))


@query("function_totals", f"""WITH {_LINES} SELECT run_id, file, first_line, CAST(sum(weight) AS BIGINT) AS weight, max(weight) AS largest_line,
CAST(sum(samples) AS BIGINT) AS samples FROM lines GROUP BY ALL""")
def function_totals(spark, folder):
    l = lines(spark, folder).withColumn("largest_line", F.col("weight"))
    return line_ops.function_totals(l, ["weight"], ["largest_line"])


@query("cpu_split", """WITH t AS (SELECT event_id // 4 AS tick, event_type AS file, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 10) * 10 END AS cpu FROM events),
r AS (SELECT tick, count(*) AS running FROM t WHERE cpu > 20 GROUP BY tick),
s AS (SELECT t.*, coalesce(running, 0) AS running FROM t LEFT JOIN r USING (tick)),
n AS (SELECT *, CASE WHEN cpu IS NULL OR running > 1 THEN 0 WHEN k > 10 THEN least(cpu, k - 5) WHEN k < 2.5 THEN cpu ELSE 0 END AS native FROM s)
SELECT file, CAST(sum(native) AS BIGINT) AS native_s, CAST(sum(CASE WHEN cpu IS NULL OR running > 1 THEN 0 ELSE cpu - native END) AS BIGINT) AS python_s,
CAST(sum(CASE WHEN cpu IS NULL THEN 0 ELSE 100 - cpu END) AS BIGINT) AS system_s,
CAST(sum(CASE WHEN cpu IS NULL THEN 100 WHEN running > 1 THEN cpu ELSE 0 END) AS BIGINT) AS unsplit_s, count(*) AS samples FROM n GROUP BY file""")
def cpu_split(spark, folder):
    e = table(spark, folder, "events")
    s = e.select(F.lit("all").alias("run_id"), F.col("event_type").alias("file"), F.floor(F.col("event_id") / 4).alias("tick"), F.lit(100.0).alias("elapsed_s"),
                 F.when(F.col("event_id") % 13 != 0, (F.col("event_id") % 10) * 10.0).alias("cpu_s"),
                 F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("wait_s"))
    parts = ["native_s", "python_s", "system_s", "unsplit_s"]
    out = line_ops.line_totals(line_ops.classify_samples(s, switch_s=5.0), parts, ["file"])
    return out.withColumns({p: F.col(p).cast("long") for p in parts})


@query("threads", """SELECT o_orderstatus AS run_id, o_custkey % 100 AS thread, arg_max(o_orderpriority, o_orderkey) AS thread_name FROM orders GROUP BY ALL""")
def threads(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("run_id"), (F.col("o_custkey") % 100).alias("thread"),
                                              F.col("o_orderpriority").alias("thread_name"), "o_orderkey")
    return line_ops.threads(o, ["o_orderkey"])


@query("line_events_capped", f"""WITH {ad.SQL_SAMPLES},
c AS (SELECT run_id, file, line, count(*) AS line_events, min(event_id) AS f FROM samples GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY f, file, line) AS rk FROM c)
SELECT run_id, file, line, line_events, CAST(sum(line_events) FILTER (WHERE rk > 100) OVER (PARTITION BY run_id) AS BIGINT) AS dropped_events,
count(*) FILTER (WHERE rk > 100) OVER (PARTITION BY run_id) AS dropped_locations FROM r QUALIFY rk <= 100""")
def line_events_capped(spark, folder):
    return line_ops.line_events(ad.samples(spark, folder), "event_id", 100)


@query("top_both", f"""WITH {_LINES},
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY weight DESC, file, line) AS time_rank,
        CASE WHEN samples > 0 THEN row_number() OVER (PARTITION BY run_id ORDER BY samples DESC, file, line) END AS memory_rank FROM lines)
SELECT run_id, file, line, weight, samples, CASE WHEN time_rank <= 20 THEN time_rank END AS time_rank,
CASE WHEN memory_rank <= 20 THEN memory_rank END AS memory_rank FROM r WHERE time_rank <= 20 OR memory_rank <= 20""")
def top_both(spark, folder):
    out = line_ops.top_both(lines(spark, folder).drop("first_line"), ["run_id"], "weight", "samples", 20, ["file", "line"])
    return out.withColumns({"time_rank": F.col("time_rank").cast("long"), "memory_rank": F.col("memory_rank").cast("long")})


@query("top_lines", f"""WITH {_LINES} SELECT run_id, file, line, weight AS time_s, row_number() OVER (PARTITION BY run_id ORDER BY weight DESC, file, line) AS rank
FROM lines WHERE weight > 0 QUALIFY rank <= 10""")
def top_lines(spark, folder):
    l = lines(spark, folder).withColumnRenamed("weight", "time_s")
    return line_ops.top_lines(l).select("run_id", "file", "line", "time_s", F.col("rank").cast("long").alias("rank"))


@query("locations", f"""WITH {ad.SQL_SAMPLES} SELECT DISTINCT run_id, file, line FROM samples WHERE file <> 'error'
UNION SELECT DISTINCT run_id, file, line + 1000 FROM samples""")
def locations(spark, folder):
    s = ad.samples(spark, folder)
    return line_ops.locations(s.where(F.col("file") != "error"), s.withColumn("line", F.col("line") + 1000))


@query("inside_function", f"""WITH {ad.SQL_SAMPLES},
sp AS (SELECT run_id, file, first_line, max(line) AS last_line FROM samples WHERE weight > 15000 GROUP BY ALL),
p AS (SELECT DISTINCT run_id, file, line FROM samples)
SELECT p.run_id, p.file, p.line, EXISTS (SELECT 1 FROM sp WHERE sp.run_id = p.run_id AND sp.file = p.file AND p.line BETWEEN sp.first_line AND sp.last_line) AS inside FROM p""")
def inside_function(spark, folder):
    s = ad.samples(spark, folder)
    spans = s.where(F.col("weight") > 15000).groupBy("run_id", "file", "first_line").agg(F.max("line").alias("last_line"))
    return line_ops.inside_spans(s.select("run_id", "file", "line").distinct(), spans)


_SCOPES = """scopes AS (SELECT event_type AS file, k - k % 20 AS first_line, k - k % 20 + 5 + k % 30 AS last_line, 's' || CAST(k AS VARCHAR) AS name, k AS position
  FROM (SELECT DISTINCT event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)),
p AS (SELECT DISTINCT file, line FROM samples)"""


def _scopes(spark, folder):
    k = F.col("line")
    s = ad.samples(spark, folder).select("file", "line").distinct()
    return s.select("file", (k - k % 20).alias("first_line"), (k - k % 20 + 5 + k % 30).alias("last_line"), F.concat(F.lit("s"), k.cast("string")).alias("name"),
                    k.alias("position"), (k % 2 == 0).alias("is_function"), F.lit(False).alias("inline"))


@query("innermost_scope", f"""WITH {ad.SQL_SAMPLES}, {_SCOPES}
SELECT p.file, p.line, coalesce(arg_max(s.name, s.first_line * 1000 + s.position), '') AS scope_name, CAST(coalesce(max(s.first_line), p.line) AS BIGINT) AS scope_line
FROM p LEFT JOIN scopes s ON s.file = p.file AND p.line BETWEEN s.first_line AND s.last_line GROUP BY p.file, p.line""")
def innermost_scope(spark, folder):
    p = ad.samples(spark, folder).select("file", "line").distinct()
    return line_ops.innermost_scope(p, _scopes(spark, folder))


@query("scope_labels", f"""WITH {ad.SQL_SAMPLES}, {_SCOPES}
SELECT p.file, p.line, string_agg(s.name, '.' ORDER BY s.first_line, s.position) || CASE WHEN arg_max(s.position, s.first_line * 1000 + s.position) % 2 = 0 THEN '()' ELSE '' END AS scope
FROM p LEFT JOIN scopes s ON s.file = p.file AND p.line BETWEEN s.first_line AND s.last_line GROUP BY p.file, p.line""")
def scope_labels(spark, folder):
    p = ad.samples(spark, folder).select("file", "line").distinct()
    return line_ops.scope_labels(p, _scopes(spark, folder))


# ---- series
@query("obs_deltas", f"""WITH {ad.SQL_SERIES}
SELECT run_id, t, seq, coalesce(greatest(0, traced - lag(traced) OVER w), 0) AS traced_growth, rss - lag(rss) OVER w AS rss_change
FROM series WINDOW w AS (PARTITION BY run_id ORDER BY t, seq)""")
def obs_deltas(spark, folder):
    return ops.observation_deltas(ad.series(spark, folder), ["run_id"], ["t", "seq"]).select("run_id", "t", "seq", "traced_growth", "rss_change")


_ISLANDS = """pts AS (SELECT s.*, d.depth, row_number() OVER o AS i, lead(t) OVER o AS next_t, max(rss) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen,
    CASE WHEN len(path) > d.depth THEN array_to_string(path[1:d.depth + 1], '>') END AS prefix
  FROM series s, (SELECT unnest({depths}) AS depth) d WINDOW o AS (PARTITION BY run_id, d.depth ORDER BY t, seq)),
deep AS (SELECT *, CASE WHEN lag(prefix) OVER o = prefix AND i - lag(i) OVER o <= 3 THEN 0 ELSE 1 END AS starts FROM pts WHERE prefix IS NOT NULL
  WINDOW o AS (PARTITION BY run_id, depth ORDER BY i)),
isl AS (SELECT *, sum(starts) OVER (PARTITION BY run_id, depth ORDER BY i) AS phase FROM deep),
spans AS (SELECT run_id, depth, phase, any_value(prefix) AS prefix, min(i) AS a, max(i) AS b FROM isl GROUP BY run_id, depth, phase),
phases AS (SELECT s.run_id, s.depth, s.phase, s.prefix, min(p.t) AS t0, arg_max(coalesce(p.next_t, p.t), p.i) AS t1, max(p.traced) AS peak_traced, max(p.rss) AS peak_rss,
    greatest(0, max(p.rss) - arg_min(coalesce(p.seen, p.rss), p.i)) AS new_rss
  FROM spans s JOIN pts p ON p.run_id = s.run_id AND p.depth = s.depth AND p.i BETWEEN s.a AND s.b GROUP BY s.run_id, s.depth, s.phase, s.prefix)"""


def _phase_columns(df):
    return df.select("run_id", F.col("depth").cast("int").alias("depth"), F.col("phase").cast("long").alias("phase"), F.array_join("path", ">").alias("prefix"),
                     F.col("from").alias("t0"), F.col("to").alias("t1"), "peak_traced", "peak_rss", F.col("new_rss").cast("long").alias("new_rss"))


@query("phases_depth", f"""WITH {ad.SQL_SERIES}, {_ISLANDS.format(depths='[0, 1]')}
SELECT run_id, CAST(depth AS INTEGER) AS depth, CAST(phase AS BIGINT) AS phase, prefix, t0, t1, peak_traced, peak_rss, CAST(new_rss AS BIGINT) AS new_rss FROM phases""")
def phases_depth(spark, folder):
    return _phase_columns(ops.phases(ad.series(spark, folder), [0, 1]))


@query("phases_auto", f"""WITH {ad.SQL_SERIES}, {_ISLANDS.format(depths='[0, 1]')},
wall AS (SELECT run_id, max(t) - min(t) AS wall FROM series GROUP BY run_id),
per AS (SELECT run_id, depth, count(*) AS n, sum(t1 - t0) AS covered, max(t1 - t0) AS largest, any_value(wall) AS wall
  FROM phases JOIN wall USING (run_id) WHERE t1 - t0 >= 0.01 * wall GROUP BY run_id, depth),
best AS (SELECT run_id, coalesce(min(depth) FILTER (WHERE n BETWEEN 3 AND 12 AND largest <= 0.5 * wall), max(depth)) AS depth FROM per WHERE covered >= 0.9 * wall GROUP BY run_id)
SELECT p.run_id, CAST(p.depth AS INTEGER) AS depth, CAST(phase AS BIGINT) AS phase, prefix, t0, t1, peak_traced, peak_rss, CAST(new_rss AS BIGINT) AS new_rss
FROM phases p LEFT JOIN best b ON b.run_id = p.run_id WHERE p.depth = coalesce(b.depth, 0)""")
def phases_auto(spark, folder):
    s = ad.series(spark, folder)
    wall = s.groupBy("run_id").agg((F.max("t") - F.min("t")).alias("wall"))
    return _phase_columns(ops.phases_auto(s, wall))


@query("spikes", f"""WITH {ad.SQL_SERIES},
a AS (SELECT *, lag(traced) OVER w AS p, max(traced) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high, row_number() OVER w AS i
  FROM series WINDOW w AS (PARTITION BY run_id ORDER BY t, seq)),
b AS (SELECT *, greatest(traced, coalesce(high, traced)) AS top, max(CASE WHEN high IS NULL OR traced > high * 1.01 THEN i END) OVER (PARTITION BY run_id ORDER BY i) AS last_raise FROM a),
c AS (SELECT run_id, t, seq, traced, coalesce(traced - p > greatest(p * 0.5, 10000), false) AS spike, i - last_raise = 5 AND top > 5000 AND traced >= 0.9 * top AS plateau,
  (CASE WHEN top >= 5000 THEN floor(log2(top / 5000)) ELSE -1 END) > (CASE WHEN coalesce(high, 0) >= 5000 THEN floor(log2(high / 5000)) ELSE -1 END) AS doubling FROM b)
SELECT * FROM c WHERE spike OR plateau OR doubling""")
def spikes(spark, folder):
    return ops.spikes(ad.series(spark, folder), ["run_id"], ["t", "seq"], "traced", jump=10000, high=5000).drop("rss", "path")


def _thin_sql(keep: str) -> str:
    return f"""WITH {ad.SQL_SERIES},
s AS (SELECT run_id % 5 AS run_id, t, seq, traced FROM series),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t, seq) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM s)
SELECT run_id, t, seq, traced FROM n WHERE {keep}"""


def _five(spark, folder):
    return ad.series(spark, folder).withColumn("run_id", F.col("run_id") % 5).select("run_id", "t", "seq", "traced")


@query("thin_300", _thin_sql("i % greatest(1, CAST(ceil(n / 299.0) AS BIGINT)) = 0 OR i = n - 1"))
def thin_300(spark, folder):
    return ops.thin(_five(spark, folder), ["run_id"], ["t", "seq"])


@query("representative_60", _thin_sql("""list_contains(list_transform(range(0, CAST(least(60, n) AS BIGINT)), lambda j: CAST(round_even(j * (n - 1) / CAST(least(59, n - 1) AS DOUBLE), 0) AS BIGINT)), i)"""))
def representative_60(spark, folder):
    return ops.representative(_five(spark, folder), ["run_id"], ["t", "seq"])


@query("thin_halving", _thin_sql("i % CAST(pow(2, greatest(0, ceil(log2(n / 599.0)))) AS BIGINT) = 0 OR i = n - 1"))
def thin_halving(spark, folder):
    return ops.thin_halving(_five(spark, folder), ["run_id"], ["t", "seq"])


# ---- retention
_CHANGES = ad.SQL_RETENTION + """,
ch AS (SELECT line, t, mb, lag(mb) OVER (PARTITION BY line ORDER BY t) AS p, row_number() OVER (PARTITION BY line ORDER BY t DESC) AS back,
  count(*) OVER (PARTITION BY line) AS n FROM retention)"""


def _growing_sql(points: int, recent: int, least: str, tol: str, growth: str, unit: str = "") -> str:
    return f"""SELECT line, any_value(n) AS n, count(*) FILTER (WHERE back < {points} AND mb{unit} - p{unit} > greatest({tol}, p{unit} * 0.001)) AS rises,
    any_value(n) >= 4 AND max(mb{unit}) FILTER (WHERE back = 1) >= {least} AND count(*) FILTER (WHERE back < {points} AND mb{unit} - p{unit} > greatest({tol}, p{unit} * 0.001)) >= 3
    AND count(*) FILTER (WHERE back < {points} AND mb{unit} - p{unit} < -greatest({tol}, p{unit} * 0.001)) = 0
    AND count(*) FILTER (WHERE back <= {recent} AND mb{unit} - p{unit} > greatest({tol}, p{unit} * 0.001)) > 0
    AND max(mb{unit}) FILTER (WHERE back = 1) - max(mb{unit}) FILTER (WHERE back = least({points}, n)) >= greatest({growth}, max(mb{unit}) FILTER (WHERE back = 1) * 0.01) AS growing
  FROM ch GROUP BY line"""


@query("retention_growing", f"""WITH {_CHANGES}, g AS ({_growing_sql(5, 2, '1.048576', '0.001024', '0.065536')})
SELECT line, n AS points, CAST(rises AS INTEGER) AS rises, coalesce(growing, false) AS growing FROM g""")
def retention_growing(spark, folder):
    return ret.growing_lines(ad.retention_points(spark, folder), READER_RULE).drop("run_id", "file")


@query("retention_growing_both", f"""WITH {_CHANGES}, a AS ({_growing_sql(5, 2, '1.048576', '0.001024', '0.065536')}),
b AS ({_growing_sql(6, 3, '1048576', '1024', '65536', ' * 1000000')})
SELECT a.line, CAST(b.rises AS INTEGER) AS leak_runs, coalesce(a.growing AND b.growing, false) AS growing FROM a JOIN b USING (line)""")
def retention_growing_both(spark, folder):
    assert RECORDER_RULE.points == 6
    return ret.growing_both(ad.retention_points(spark, folder)).drop("run_id", "file")


@query("retention_trend", f"""WITH {_CHANGES} SELECT line, count(*) AS snapshots, count(*) FILTER (WHERE mb > p) AS rises, count(*) FILTER (WHERE mb < p) AS releases,
CAST(arg_max(mb, t) - arg_min(mb, t) AS DOUBLE) AS growth, CAST(max(t) - min(t) AS DOUBLE) AS observed, CAST(max(mb) AS DOUBLE) AS peak, CAST(arg_max(mb, t) AS DOUBLE) AS "end" FROM ch GROUP BY line""")
def retention_trend(spark, folder):
    return ret.trend(ad.retention_points(spark, folder)).drop("run_id", "file")


@query("retention_window", f"""WITH {ad.SQL_RETENTION},
w AS (SELECT * FROM retention WHERE t BETWEEN 23960 AND 23990),
ch AS (SELECT line, t, mb, lag(mb) OVER (PARTITION BY line ORDER BY t) AS p, row_number() OVER (PARTITION BY line ORDER BY t DESC) AS back, count(*) OVER (PARTITION BY line) AS n FROM w),
g AS ({_growing_sql(5, 2, '1.048576', '0.001024', '0.065536')}),
s AS (SELECT line, count(*) AS snapshots, count(*) FILTER (WHERE mb > p) AS rises, count(*) FILTER (WHERE mb < p) AS releases, max(mb) AS peak, arg_max(mb, t) AS e, max(t) AS last_t FROM ch GROUP BY line),
r AS (SELECT s.*, CASE WHEN g.growing THEN 'growing' WHEN e >= 1 THEN 'retained' ELSE 'released' END AS status, last_t >= (SELECT max(t) FROM retention x WHERE x.line = s.line) AS reaches_end
  FROM s JOIN g USING (line) WHERE greatest(peak, e) >= 1)
SELECT line, snapshots, rises, releases, CAST(peak AS DOUBLE) AS peak, CAST(e AS DOUBLE) AS "end", status, reaches_end,
row_number() OVER (ORDER BY CASE status WHEN 'growing' THEN 0 WHEN 'retained' THEN 1 ELSE 2 END, peak DESC, e DESC, line) AS rank FROM r QUALIFY rank <= 200""")
def retention_window(spark, folder):
    d = ret.diagnose_window(ad.retention_points(spark, folder), 23960, 23990, limit=200)
    return d.select("line", "snapshots", "rises", "releases", "peak", "end", "status", "reaches_end", F.col("rank").cast("long").alias("rank"))


@query("peak_snapshot", f"""WITH {ad.SQL_SAMPLES},
h AS (SELECT run_id, event_id // 1000 AS snapshot, CASE WHEN line % 7 <> 0 THEN file END AS file, weight FROM samples),
p AS (SELECT run_id, snapshot, CAST(coalesce(sum(weight) FILTER (WHERE file IS NOT NULL), 0) AS BIGINT) AS held, CAST(coalesce(sum(weight) FILTER (WHERE file IS NULL), 0) AS BIGINT) AS unattributed FROM h GROUP BY ALL)
SELECT run_id, snapshot, CAST(snapshot AS DOUBLE) AS t, held, unattributed, (SELECT CAST(max(snapshot) AS DOUBLE) FROM p q WHERE q.run_id = p.run_id) AS last_t
FROM p QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY held DESC, snapshot) = 1""")
def peak_snapshot(spark, folder):
    s = ad.samples(spark, folder)
    at = F.floor(F.col("event_id") / 1000)
    frame = F.struct(F.col("file"), F.col("line"), (F.col("line") % 7 != 0).alias("user"), F.lit(False).alias("own"))
    traces = s.select("run_id", at.alias("snapshot"), at.cast("double").alias("t"), F.array(frame).alias("path"), F.col("weight").alias("size"))
    return ret.peak_snapshot(ret.snapshot_totals(ret.held_by_line(traces)))


@query("holders", f"""WITH {ad.SQL_SAMPLES},
i AS (SELECT run_id, file, line, 'u' || CAST(thread AS VARCHAR) AS holder FROM samples),
m AS (SELECT run_id, file, line, holder, count(*) AS matching FROM i GROUP BY ALL), z AS (SELECT run_id, holder, count(*) AS items FROM i GROUP BY ALL)
SELECT run_id, file, line, holder, matching, items, row_number() OVER (PARTITION BY run_id, file, line ORDER BY matching DESC, holder) AS rank FROM m JOIN z USING (run_id, holder) QUALIFY rank <= 3""")
def holders(spark, folder):
    s = ad.samples(spark, folder)
    items = s.select("run_id", "file", "line", F.concat(F.lit("u"), F.col("thread").cast("string")).alias("holder"), F.lit("list").alias("type"))
    return ret.holders(items, s, shown=3).drop("type").withColumn("rank", F.col("rank").cast("long"))


@query("sized_from_sample", """SELECT o_custkey AS holder, count(*) AS items,
CAST(56 + sum(CAST(round(o_totalprice) AS BIGINT)) FILTER (WHERE pos < 10) * count(*) // count(*) FILTER (WHERE pos < 10) AS BIGINT) AS bytes, count(*) > 10 AS estimated
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders) GROUP BY 1""")
def sized_from_sample(spark, folder):
    from tracegrain.operators.scan import scan

    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("holder"), "o_orderkey", F.round("o_totalprice").cast("long").alias("bytes"))
    placed = scan(o, ["holder"], ["o_orderkey"], row_number="__i", total="items")
    items = placed.select("holder", (F.col("__i") - 1).alias("position"), "bytes", F.lit(56).alias("own_bytes"), "items")
    return ret.sized_from_sample(items, ["holder"], 10)


@query("largest_objects", """SELECT o_orderstatus AS run_id, 'o' || CAST(o_orderkey AS VARCHAR) AS holder, CAST(round(o_totalprice * 10) AS BIGINT) AS bytes,
row_number() OVER (PARTITION BY o_orderstatus ORDER BY CAST(round(o_totalprice * 10) AS BIGINT) DESC, 'o' || CAST(o_orderkey AS VARCHAR)) AS rank
FROM orders WHERE CAST(round(o_totalprice * 10) AS BIGINT) >= 1048576 QUALIFY rank <= 20""")
def largest_objects(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("run_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("holder"),
                                              F.round(F.col("o_totalprice") * 10).cast("long").alias("bytes"))
    return ret.largest_objects(o).withColumn("rank", F.col("rank").cast("long"))


@query("topk_other", f"""WITH {ad.SQL_STACKS},
d AS (SELECT thread, array_to_string(path, '>') AS stack, CAST(sum(weight) AS BIGINT) AS bytes FROM stacks GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY bytes DESC, stack) AS rank, sum(bytes) OVER (PARTITION BY thread) AS total, count(*) OVER (PARTITION BY thread) AS n FROM d),
k AS (SELECT *, sum(bytes) OVER (PARTITION BY thread) AS kept, count(*) OVER (PARTITION BY thread) AS kn FROM r WHERE rank <= 50)
SELECT thread, stack, bytes, rank, CAST(total - kept AS BIGINT) AS other_bytes, n - kn AS omitted_rows FROM k""")
def topk_other(spark, folder):
    names = F.array_join(F.transform("path", lambda f: f["name"]), ">")
    s = ad.stacks(spark, folder).groupBy("thread", names.alias("stack")).agg(F.sum("weight").alias("bytes"))
    out = top_k_with_rest(s, ["thread"], [F.col("bytes").desc(), F.col("stack").asc()], 50, {"other_bytes": "bytes"})
    return out.withColumn("rank", F.col("rank").cast("long"))
