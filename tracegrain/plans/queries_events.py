"""Catalogue: event traces, hazards, allocations, owner graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrain.operators import allocations as alloc, events as ops, graph as graph_ops, hazards
from tracegrain.plans import adapters as ad
from tracegrain.plans.registry import query, table

_PAIRS = ad.SQL_ACCESSES + """,
rw AS (SELECT * FROM accesses WHERE category <> 'shared_outcome'),
pr AS (SELECT *, lag(category) OVER w AS pc, lag(id) OVER w AS rid, lag(t) OVER w AS rt, lag(literal) OVER w AS rv, lag(acquisition) OVER w AS racq
  FROM rw WINDOW w AS (PARTITION BY key, actor ORDER BY t, id)),
pw AS (SELECT key, actor, rid, rt, rv, id AS wid, t AS wt, literal AS wv, coalesce(racq = acquisition, false) AS locked, row_number() OVER (PARTITION BY key ORDER BY t, id) AS rn
  FROM pr WHERE category = 'shared_write' AND pc = 'shared_read'),
oc AS (SELECT key, arg_max(id, t) AS id, arg_max(expected, t) AS expected, arg_max(observed, t) AS observed FROM accesses WHERE category = 'shared_outcome' GROUP BY key),
lost AS (SELECT a.key, CASE WHEN oc.expected <> oc.observed THEN 'confirmed' ELSE 'potential' END AS status, a.actor, b.actor AS other_actor, a.rid AS read_id, a.wid AS write_id,
    b.rid AS other_read_id, b.wid AS other_write_id
  FROM pw a JOIN pw b ON a.key = b.key AND b.rn < a.rn AND a.actor <> b.actor AND a.rt < b.wt AND b.rt < a.wt AND a.rv = b.rv AND a.wv = b.wv AND a.wv <> a.rv
    AND NOT (a.locked AND b.locked) LEFT JOIN oc ON oc.key = a.key)"""


@query("paired_writes", f"WITH {_PAIRS} SELECT key, actor, rid AS read_id, wid AS write_id, locked FROM pw")
def paired_writes(spark, folder):
    return hazards.paired_writes(ad.accesses(spark, folder)).select("key", "actor", "read_id", "write_id", (F.size("locks") > 0).alias("locked"))


@query("lost_updates", f"WITH {_PAIRS} SELECT * FROM lost")
def lost_updates(spark, folder):
    return hazards.lost_updates(ad.accesses(spark, folder)).drop("run_id", "confidence", "event_ids")


_WIDE = """wide AS (SELECT event_id AS id, epoch_us(ts) AS t, 'u' || CAST(user_id AS VARCHAR) AS key, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 3 AS actor,
  event_type = 'click' AS w, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) >= 80 AS locked FROM events WHERE event_type IN ('view', 'click'))"""


_OPEN = _WIDE + """,
h AS (SELECT key FROM wide GROUP BY key HAVING count(DISTINCT actor) >= 2 AND bool_or(w)),
u AS (SELECT key, id, t, row_number() OVER (PARTITION BY key ORDER BY t, id) AS position FROM wide JOIN h USING (key) WHERE NOT locked)"""


def _shared(spark, folder):
    e = table(spark, folder, "events").where(F.col("event_type").isin("view", "click"))
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    lock = F.when(k >= 80, F.array(F.struct(F.lit("L").alias("lock_id"), F.col("event_id").alias("acquisition_id")))).otherwise(
        F.expr("cast(array() as array<struct<lock_id:string,acquisition_id:bigint>>)"))
    a = e.select(F.lit("all").alias("run_id"), F.col("event_id").alias("id"), ad.micros("ts").alias("t"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"),
                 (k % 3).alias("actor"), F.when(F.col("event_type") == "view", "shared_read").otherwise("shared_write").alias("category"), F.lit("identity").alias("kind"),
                 F.col("event_id").cast("string").alias("value"), lock.alias("synchronization"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("observed"))
    return a, hazards.shared_hazards(a, hazards.lost_updates(a))


@query("shared_hazards", f"""WITH {_OPEN}
SELECT key, 'potential' AS status, count(*) AS open_accesses, max(id) FILTER (WHERE position = 1) AS first_event_id, arg_max(id, position) AS last_event_id,
string_agg(CAST(id AS VARCHAR), ',' ORDER BY position) AS events FROM u GROUP BY key""")
def shared_hazards(spark, folder):
    a, found = _shared(spark, folder)
    return hazards.with_events(a, found).drop("run_id").withColumn("events", F.array_join("event_ids", ",")).drop("event_ids")


@query("unprotected_accesses", f"""WITH {_OPEN} SELECT key, t, id AS event_id, position FROM u""")
def unprotected_accesses(spark, folder):
    return hazards.open_accesses(*_shared(spark, folder)).drop("run_id")


@query("unsupported_confirmations", f"""WITH {_PAIRS},
f AS (SELECT read_id, write_id, other_read_id, other_write_id, key FROM lost WHERE status = 'confirmed')
SELECT CAST(write_id AS VARCHAR) || '-' || CAST(other_write_id AS VARCHAR) AS finding_id, CAST(CASE WHEN write_id % 4 = 0 THEN 0 ELSE 1 END AS BIGINT) AS "both" FROM f""")
def unsupported_confirmations(spark, folder):
    """Confirmed rows with one event id taken away must be caught."""
    a = ad.accesses(spark, folder)
    found = hazards.lost_updates(a).where(F.col("status") == "confirmed")
    # Keep one actor's pair, or only the two writes.
    broken = F.when(F.col("write_id") % 4 == 0, F.array("write_id", "other_write_id")).otherwise(F.array("read_id", "write_id"))
    f = found.select("run_id", F.concat_ws("-", "write_id", "other_write_id").alias("id"), "status", "key", broken.alias("event_ids"))
    return ops.unsupported_confirmations(f, a).select("finding_id", "both")


@query("event_references", """WITH f AS (SELECT o_orderkey AS fid, o_custkey AS id FROM orders UNION ALL SELECT o_orderkey, o_orderkey FROM orders)
SELECT fid AS finding_id, id FROM f WHERE id NOT IN (SELECT event_id FROM events)""")
def event_references(spark, folder):
    o = table(spark, folder, "orders").select(F.lit("all").alias("run_id"), F.col("o_orderkey").alias("id"), F.array("o_custkey", "o_orderkey").alias("event_ids"))
    e = table(spark, folder, "events").select(F.lit("all").alias("run_id"), F.col("event_id").alias("id"))
    return ops.missing_event_ids(o, e).select("finding_id", "id")


@query("duplicate_ids", "SELECT l_orderkey * 8 + l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, folder):
    l = table(spark, folder, "lineitem").select(F.lit("all").alias("run_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    return ops.duplicate_event_ids(l).drop("run_id")


_GC = """g AS (SELECT user_id % 40 AS run_id, event_type = 'click' AS stop, event_id AS seq, epoch_us(ts) AS t, user_id % 7 AS thread, CAST(floor(value) AS BIGINT) % 3 AS generation,
  CAST(floor(value) AS BIGINT) AS collected, CAST(floor(value) AS BIGINT) % 2 AS uncollectable FROM events WHERE event_type IN ('view', 'click')),
gp AS (SELECT *, lag(stop) OVER w AS pstop, t - lag(t) OVER w AS duration FROM g WINDOW w AS (PARTITION BY run_id, thread, generation ORDER BY t, seq)),
pairs AS (SELECT run_id, thread, generation, seq, t, duration, collected, uncollectable FROM gp WHERE stop AND pstop = false)"""


def _gc(spark, folder):
    e = table(spark, folder, "events").where(F.col("event_type").isin("view", "click"))
    whole = F.floor("value").cast("long")
    return ops.gc_pairs(e.select(
        (F.col("user_id") % 40).alias("run_id"), F.when(F.col("event_type") == "view", "start").otherwise("stop").alias("phase"), F.col("event_id").alias("seq"),
        ad.micros("ts").alias("t"), (F.col("user_id") % 7).alias("thread"), (whole % 3).alias("generation"), whole.alias("collected"), (whole % 2).alias("uncollectable")))


@query("gc_pairs", f"WITH {_GC} SELECT * FROM pairs")
def gc_pairs(spark, folder):
    return _gc(spark, folder)


@query("gc_totals", f"""WITH {_GC} SELECT run_id, count(*) AS total_collections, CAST(sum(duration) AS BIGINT) AS total_pause, CAST(sum(collected) AS BIGINT) AS collected,
CAST(sum(uncollectable) AS BIGINT) AS uncollectable, greatest(0, count(*) - 20) AS dropped_events FROM pairs GROUP BY run_id""")
def gc_totals(spark, folder):
    return ops.gc_totals(_gc(spark, folder), cap=20)


@query("first_events", f"""WITH {ad.SQL_SAMPLES}, r AS (SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS rk, count(*) OVER (PARTITION BY run_id) AS n FROM samples)
SELECT run_id, event_id, greatest(0, n - 2000) AS dropped_events FROM r WHERE rk <= 2000""")
def first_events(spark, folder):
    return ops.first_events(ad.samples(spark, folder).select("run_id", "event_id"), ["event_id"], 2000)


_CHECKPOINTS = """cp AS (SELECT event_id AS id, epoch_us(ts) AS t, 'l' || CAST(user_id % 60 AS VARCHAR) AS label, CAST(floor(value * 1000) AS BIGINT) AS footprint, event_type <> 'error' AS distinct_result FROM events),
lab AS (SELECT DISTINCT label FROM cp)"""


def _checkpoints(spark, folder):
    e = table(spark, folder, "events")
    return e.select(F.lit("all").alias("run_id"), F.col("event_id").alias("id"), ad.micros("ts").alias("t"), F.concat(F.lit("l"), (F.col("user_id") % 60).cast("string")).alias("label"),
                    F.floor(F.col("value") * 1000).cast("long").alias("footprint"), (F.col("event_type") != "error").alias("distinct_result"))


@query("checkpoint_growth", f"""WITH {_CHECKPOINTS},
x AS (SELECT label, id, footprint, lag(footprint) OVER w AS before_bytes, lag(id) OVER w AS previous_id FROM cp WHERE label IN (SELECT label FROM lab) WINDOW w AS (PARTITION BY label ORDER BY t, id))
SELECT label, id, previous_id, before_bytes, footprint AS after_bytes, footprint - before_bytes AS growth_bytes, footprint > 200000 AS over_budget FROM x WHERE footprint - before_bytes >= 65536""")
def checkpoint_growth(spark, folder):
    out = ops.checkpoint_growth(_checkpoints(spark, folder), budget=F.lit(200000))
    return out.select("label", "id", "previous_id", "before_bytes", "after_bytes", "growth_bytes", "over_budget")


@query("repeated_copy", f"""WITH {_CHECKPOINTS},
x AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY t, id) AS rk FROM cp WHERE label IN (SELECT label FROM lab))
SELECT label, max(footprint) FILTER (WHERE rk = 1) AS first_bytes, max(footprint) FILTER (WHERE rk = 2) AS second_bytes, max(id) FILTER (WHERE rk = 2) AS id FROM x WHERE rk <= 2
GROUP BY label HAVING count(*) = 2 AND bool_and(distinct_result) AND max(footprint) FILTER (WHERE rk = 2) >= 65536""")
def repeated_copy(spark, folder):
    return ops.repeated_copies(_checkpoints(spark, folder)).drop("run_id")


@query("label_totals", f"""WITH {_CHECKPOINTS} SELECT label, count(*) AS requests, CAST(sum(footprint) AS BIGINT) AS requested_payload_bytes, CAST(0 AS BIGINT) AS dropped_labels
FROM cp WHERE label IN (SELECT label FROM lab) GROUP BY label""")
def label_totals(spark, folder):
    return ops.label_totals(_checkpoints(spark, folder).withColumnRenamed("footprint", "bytes"), ["t", "id"]).drop("run_id")


@query("retained_after_cleanup", """WITH e AS (SELECT event_id AS id, epoch_us(ts) AS t, user_id AS label, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events WHERE event_type IN ('signup', 'purchase')),
w AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER o AS no, max(CASE WHEN event_type = 'signup' THEN id END) OVER o AS object_id FROM e WINDOW o AS (PARTITION BY label ORDER BY t, id))
SELECT label, t, id, object_id, row_number() OVER (PARTITION BY label, no ORDER BY t, id) AS retention_observations FROM w WHERE no > 0 AND event_type = 'purchase' AND k % 2 = 0""")
def retained_after_cleanup(spark, folder):
    e = table(spark, folder, "events").select(F.lit("all").alias("run_id"), F.col("event_id").alias("id"), ad.micros("ts").alias("t"), F.col("user_id").alias("label"), "event_type",
                                              (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 2 == 0).alias("alive"))
    watches = e.where(F.col("event_type") == "signup").withColumn("object_id", F.col("id"))
    return ops.retained_after_cleanup(watches, e.where(F.col("event_type") == "purchase")).drop("run_id")


@query("costly_structures", """SELECT o_custkey AS id, count(*) AS dictionary_count, CAST(sum(round(o_totalprice)) AS BIGINT) AS dictionary_bytes FROM orders GROUP BY 1
HAVING count(*) >= 10 AND CAST(sum(round(o_totalprice)) AS BIGINT) >= 3000000""")
def costly_structures(spark, folder):
    o = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("o_totalprice").cast("long")).alias("b"))
    s = o.select("id", F.create_map(F.lit("dict"), "n").alias("type_counts"), F.create_map(F.lit("dict"), "b").alias("type_bytes"))
    return ops.costly_structures(s, 10, 3_000_000).drop("type_counts", "type_bytes")


# ---- allocations
_SITES = ad.SQL_ALLOCATIONS + """,
sites AS (SELECT thread_id, site, arg_min(domain, sequence * 10 + ascii(domain) % 10) AS domain, CAST(sum(size) AS BIGINT) AS requested_bytes, count(*) AS allocation_count, min(sequence) AS f, max(sequence) AS l
  FROM allocations GROUP BY thread_id, site)"""
_KEYS = ("run_id", "thread_id", "site")


def _sites(spark, folder):
    return alloc.sites(ad.allocations(spark, folder), _KEYS, (), count=None)


@query("alloc_sites", f"""WITH {_SITES}, r AS (SELECT *, row_number() OVER (ORDER BY f, thread_id, site) AS rk FROM sites)
SELECT thread_id, site, requested_bytes, allocation_count, f AS first_event_sequence, l AS last_event_sequence,
CAST(0 AS BIGINT) AS omitted_bytes, CAST(0 AS BIGINT) AS omitted_allocations, CAST(0 AS BIGINT) AS omitted_sites, true AS summary_complete FROM r""")
def alloc_sites(spark, folder):
    return alloc.capped_sites(_sites(spark, folder), _KEYS).drop("run_id")


@query("alloc_totals", f"""WITH {ad.SQL_ALLOCATIONS} SELECT scope, domain, CAST(grouping(scope) AS INTEGER) AS all_scopes, CAST(sum(size) AS BIGINT) AS requested_bytes, count(*) AS allocation_count
FROM allocations GROUP BY GROUPING SETS ((domain), (scope, domain))""")
def alloc_totals(spark, folder):
    a = ad.allocations(spark, folder)
    per = a.groupBy("run_id", "scope", "domain").agg(F.sum("size").alias("requested_bytes"), F.count(F.lit(1)).alias("allocation_count"))
    return alloc.totals(per).drop("run_id")


@query("alloc_outstanding", f"""WITH {ad.SQL_ALLOCATIONS},
s AS (SELECT thread_id, site, domain, min(sequence) AS f FROM allocations GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY f, thread_id, site, domain) AS rk FROM s)
SELECT o.thread_id, o.site, o.domain, CAST(sum(size) AS BIGINT) AS outstanding_bytes, count(*) AS outstanding_blocks, true AS site_kept
FROM allocations o JOIN k ON o.thread_id = k.thread_id AND o.site = k.site AND o.domain = k.domain WHERE outstanding GROUP BY o.thread_id, o.site, o.domain, k.rk""")
def alloc_outstanding(spark, folder):
    keys = ("run_id", "thread_id", "site", "domain")
    a = ad.allocations(spark, folder).withColumn("n_allocations", F.lit(1).cast("long"))
    renamed = a.withColumn("allocator", F.col("domain"))
    keys = ("run_id", "thread_id", "site", "allocator")
    kept = alloc.capped_sites(alloc.sites(renamed, keys, ("domain",)), keys).withColumn("scope", F.lit("x"))
    left = renamed.where("outstanding").withColumn("scope", F.lit("x"))
    return alloc.outstanding(left, kept, keys).select("thread_id", "site", "domain", "outstanding_bytes", "outstanding_blocks", "site_kept")


@query("alloc_budget", f"""WITH {_SITES},
u AS (SELECT *, sum(60 + length(CAST(site AS VARCHAR))) OVER (ORDER BY requested_bytes DESC, thread_id, site) AS used FROM sites)
SELECT thread_id, site, requested_bytes, allocation_count, CAST((SELECT coalesce(sum(requested_bytes), 0) FROM u WHERE used > 100000) AS BIGINT) AS omitted_bytes,
CAST((SELECT coalesce(sum(allocation_count), 0) FROM u WHERE used > 100000) AS BIGINT) AS omitted_allocations FROM u WHERE used <= 100000""")
def alloc_budget(spark, folder):
    s = _sites(spark, folder).drop("first_event_sequence", "last_event_sequence")
    return alloc.within_budget(s, ["thread_id", "site"], 100_000, row_bytes=60 + F.length(F.col("site").cast("string"))).drop("run_id")


@query("sites_innermost", f"""WITH {ad.SQL_STACKS},
s AS (SELECT thread AS which, o_orderpriority AS name, CAST(sum(weight) AS BIGINT) AS bytes FROM stacks GROUP BY ALL)
SELECT which, '/app/prio.py' AS file, name, bytes FROM s""")
def sites_innermost(spark, folder):
    s = ad.stacks(spark, folder).withColumnsRenamed({"thread": "which", "weight": "bytes"})
    return alloc.innermost_sites(s).select("which", "file", "name", "bytes")


@query("snapshot_stacks", f"""WITH {ad.SQL_STACKS},
d AS (SELECT thread AS which, array_to_string(path, '>') AS stack, CAST(sum(weight) AS BIGINT) AS bytes FROM stacks GROUP BY ALL)
SELECT which, stack, bytes, row_number() OVER (PARTITION BY which ORDER BY bytes DESC) AS rank FROM d QUALIFY rank <= 10""")
def snapshot_stacks(spark, folder):
    s = ad.stacks(spark, folder).groupBy("run_id", F.col("thread").alias("which"), "path").agg(F.sum("weight").alias("bytes"))
    _, top = alloc.snapshot_tables(s, top=10)
    return top.select("which", F.array_join(F.transform("path", lambda f: f["name"]), ">").alias("stack"), "bytes", F.col("rank").cast("long").alias("rank"))


# ---- owner graph
_BFS = """WITH RECURSIVE """ + ad.SQL_GRAPH + """,
bfs AS (SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS node, 0 AS depth, 'r' || CAST(r_regionkey AS VARCHAR) AS path FROM region
  UNION ALL SELECT e.dst, b.depth + 1, b.path || '.' || e.dst FROM bfs b JOIN edges e ON e.src = b.node WHERE b.depth < 3),
first AS (SELECT node, min(depth) AS depth, arg_min(path, depth) AS path FROM bfs GROUP BY node)"""


def _reach(spark, folder):
    roots, nodes, edges = ad.graph(spark, folder)
    return graph_ops.reach(roots, edges, ranks=False), nodes, edges


@query("owner_paths", _BFS + " SELECT node, path, CAST(depth AS INTEGER) AS depth FROM first WHERE node LIKE 'o%' OR node LIKE 'c%'")
def owner_paths(spark, folder):
    reached, nodes, _ = _reach(spark, folder)
    targets = nodes.where("type in ('order', 'customer')").select("run_id", "node")
    return graph_ops.owner_paths(reached.nodes, targets).drop("run_id")


@query("cycles", _BFS + """, c AS (SELECT e.dst AS object, f.path || '.' || e.dst AS path, f.depth + 1 AS depth FROM first f JOIN edges e ON e.src = f.node
  WHERE f.node LIKE 'o%' AND list_contains(string_split(f.path, '.'), e.dst))
SELECT object, path, CAST(depth AS INTEGER) AS depth, (SELECT count(*) FROM c) AS cycles FROM c""")
def cycles(spark, folder):
    reached, _, edges = _reach(spark, folder)
    return graph_ops.cycles(reached.nodes, edges).drop("run_id")


@query("footprint", _BFS + """ SELECT n.type, count(*) AS objects, CAST(sum(n.bytes) AS BIGINT) AS bytes, true AS complete FROM nodes n JOIN first f USING (node) GROUP BY n.type""")
def footprint(spark, folder):
    reached, nodes, _ = _reach(spark, folder)
    return graph_ops.footprint(reached.nodes, nodes).join(reached.complete, "run_id").select("type", "objects", "bytes", "complete")
