"""Catalogue: the streaming detectors over the event table, which arrives in five files.

A row of one time slice comes with its own file, one file later (every seventh), or two (every 101st). With DELAY the first are only out of order;
most of the second are late. The SQL says which rows are late and takes the batch result of the others.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracegrain.plans import adapters as ad, queries_events as qe
from tracegrain.plans.registry import query, table
from tracegrain.streaming import monitors
from tracegrain.streaming.run import drain, drain_in_order, job_folder, read_files_stream, read_table_stream, use_rocksdb

SLICES = 3
FIRST_US = 1_704_067_200_000_000  # the first day of the table
SLICE_US = 10 * 86_400_000_000
DELAY_MS = 1_036_800_000  # 1.2 slices
BUCKET_MS = 86_400_000

ARRIVED = f"""placed AS (SELECT *, least({SLICES - 1}, (epoch_us(ts) - {FIRST_US}) // {SLICE_US}) + CASE WHEN event_id % 101 = 0 THEN 2 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS file FROM events),
mark AS (SELECT file, max(max(epoch_us(ts))) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 - {DELAY_MS} AS passed FROM placed GROUP BY file),
arrived AS (SELECT p.* EXCLUDE (file), coalesce((epoch_us(ts) // 1000 // {BUCKET_MS} + 1) * {BUCKET_MS} <= passed, false) AS late FROM placed p JOIN mark USING (file)),
on_time AS (SELECT * FROM arrived WHERE NOT late)"""


def _on_time(sql: str) -> str:
    """A batch statement over the rows that are not late."""
    body = re.sub(r"FROM events\b", "FROM on_time", sql.strip())
    return f"WITH {ARRIVED}, " + body.removeprefix("WITH ")


def _arriving(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a stream of files with rows out of order, and a last row that moves the watermark past all others."""
    events = table(spark, folder, "events").withColumn("at", F.timestamp_micros(ad.micros("ts")))
    later = F.when(F.col("event_id") % 101 == 0, 2).when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    placed = events.withColumn("file", F.least(F.lit(SLICES - 1), F.floor((ad.micros("ts") - FIRST_US) / SLICE_US)).cast("int") + later)
    out = job_folder(spark)
    for file in range(SLICES + 2):
        placed.where(F.col("file") == file).drop("file").orderBy(F.xxhash64("event_id")).coalesce(1).write.parquet(f"{out}/{file}")
    end = events.limit(1).withColumn("at", F.timestamp_micros(F.lit(FIRST_US + 20 * SLICE_US))).withColumn("event_type", F.lit("end"))
    end.coalesce(1).write.parquet(f"{out}/end")
    use_rocksdb(spark)
    rows = monitors.watermarked(read_files_stream(spark, out), f"{DELAY_MS} milliseconds")
    return monitors.only(rows, F.col("event_type") != "end")


def _k():
    return F.regexp_extract("props", "([0-9]+)", 1).cast("long")


@query("stream_pressure", _on_time("""WITH p AS (SELECT user_id AS process, epoch_us(ts) AS t, event_id, CAST(round(value * 100) AS BIGINT) AS g, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events),
s AS (SELECT *, max(k) OVER w AS peak_root, max(g) OVER w AS peak_group, g >= 15000 AS a, k <= 1 AS b FROM p WINDOW w AS (PARTITION BY process ORDER BY t, event_id))
SELECT process, t, CASE WHEN a THEN 'rss_budget' ELSE 'system_reserve' END AS stop_reason, peak_root, peak_group, k AS last_available, g AS last_group
FROM s WHERE a OR b QUALIFY row_number() OVER (PARTITION BY process ORDER BY t, event_id) = 1"""))
def stream_pressure(spark, folder):
    p = _arriving(spark, folder).select(
        F.col("user_id").alias("process"), ad.micros("ts").alias("t"), F.col("event_id").alias("seq"), _k().alias("root_rss"), ad.cents("value").alias("group_rss"),
        _k().alias("available"), F.lit(15000).cast("long").alias("budget"), F.lit(1).cast("long").alias("reserve"))
    return drain_in_order(monitors.pressure(p, BUCKET_MS))[0]


def _checkpoints(spark, folder):
    return _arriving(spark, folder).select(
        F.lit("all").alias("run_id"), F.concat(F.lit("l"), (F.col("user_id") % 60).cast("string")).alias("label"), ad.micros("ts").alias("t"),
        F.col("event_id").alias("id"), F.floor(F.col("value") * 1000).cast("long").alias("footprint"))


@query("stream_checkpoint_growth", _on_time("""WITH c AS (SELECT event_id AS id, epoch_us(ts) AS t, 'l' || CAST(user_id % 60 AS VARCHAR) AS label, CAST(floor(value * 1000) AS BIGINT) AS footprint FROM events),
x AS (SELECT *, lag(footprint) OVER w AS before_bytes, lag(id) OVER w AS previous_id FROM c WINDOW w AS (PARTITION BY label ORDER BY t, id))
SELECT label, id, previous_id, before_bytes, footprint AS after_bytes, footprint - before_bytes AS growth_bytes FROM x WHERE footprint - before_bytes >= 65536"""))
def stream_checkpoint_growth(spark, folder):
    return drain_in_order(monitors.checkpoint_growth(_checkpoints(spark, folder), BUCKET_MS))[0].drop("run_id")


@query("stream_late_rows", f"""WITH {ARRIVED} SELECT 'l' || CAST(user_id % 60 AS VARCHAR) AS label, event_id AS id, epoch_us(ts) AS t FROM arrived WHERE late""")
def stream_late_rows(spark, folder):
    """What an ordered detector left aside, whole."""
    late = drain_in_order(monitors.checkpoint_growth(_checkpoints(spark, folder), BUCKET_MS))[1]
    return late.select("label", F.col("late_seq").alias("id"), F.col("late_t").alias("t"))


@query("stream_gc_pairs", _on_time(f"WITH {qe._GC} SELECT * FROM pairs"))
def stream_gc_pairs(spark, folder):
    whole = F.floor("value").cast("long")
    e = monitors.only(_arriving(spark, folder), F.col("event_type").isin("view", "click")).select(
        (F.col("user_id") % 40).alias("run_id"), (F.col("user_id") % 7).alias("thread"), (whole % 3).alias("generation"),
        F.when(F.col("event_type") == "view", "start").otherwise("stop").alias("phase"), ad.micros("ts").alias("t"), F.col("event_id").alias("seq"),
        whole.alias("collected"), (whole % 2).alias("uncollectable"))
    return drain_in_order(monitors.gc_pairs(e, bucket_ms=BUCKET_MS))[0]


@query("stream_spikes", _on_time(f"""WITH {ad.SQL_SERIES},
a AS (SELECT *, lag(traced) OVER w AS p, max(traced) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high, row_number() OVER w AS i
  FROM series WINDOW w AS (PARTITION BY run_id ORDER BY t, seq)),
b AS (SELECT *, greatest(traced, coalesce(high, traced)) AS top, max(CASE WHEN high IS NULL OR traced > high * 1.01 THEN i END) OVER (PARTITION BY run_id ORDER BY i) AS last_raise FROM a),
c AS (SELECT run_id, t, seq, traced AS value, coalesce(traced - p > greatest(p * 0.5, 10000), false) AS spike, i - last_raise = 5 AND top > 5000 AND traced >= 0.9 * top AS plateau,
  (CASE WHEN top >= 5000 THEN floor(log2(top / 5000)) ELSE -1 END) > (CASE WHEN coalesce(high, 0) >= 5000 THEN floor(log2(high / 5000)) ELSE -1 END) AS doubling FROM b)
SELECT * FROM c WHERE spike OR plateau OR doubling"""))
def stream_spikes(spark, folder):
    p = _arriving(spark, folder).select(F.col("user_id").alias("run_id"), ad.micros("ts").alias("t"), F.col("event_id").alias("seq"), ad.cents("value").alias("value"))
    return drain_in_order(monitors.spikes(p, 10_000, 5_000, BUCKET_MS))[0]


@query("stream_lost_updates", _on_time(f"WITH {qe._PAIRS} SELECT key, actor, other_actor, read_id, write_id, other_read_id, other_write_id FROM lost"))
def stream_lost_updates(spark, folder):
    e = monitors.only(_arriving(spark, folder), F.col("event_type").isin("view", "click")).withColumn("k", _k())
    lock = F.when(F.col("k") >= 80, F.concat(F.lit("L"), (F.col("k") % 10).cast("string"), F.lit("#"), F.col("user_id").cast("string"))).otherwise(F.lit(""))
    e = e.select(F.concat(F.lit("k"), (F.col("k") % 10).cast("string")).alias("key"), F.col("event_id").alias("id"), ad.micros("ts").alias("t"),
                 (F.col("user_id") % 5).alias("actor"),
                 F.when(F.col("event_type") == "view", "shared_read").otherwise("shared_write").alias("category"), F.lit("literal").alias("kind"),
                 (F.floor("value").cast("long") % 3).cast("string").alias("value"), lock.alias("locks"))
    return drain_in_order(monitors.lost_updates(e, BUCKET_MS))[0]


@query("stream_first_events", f"""WITH {ad.SQL_SAMPLES}, r AS (SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS rk, count(*) OVER (PARTITION BY run_id) AS n FROM samples)
SELECT run_id, event_id AS seq, false AS counter, CAST(0 AS BIGINT) AS dropped_events FROM r WHERE rk <= 2000
UNION ALL SELECT run_id, NULL, true, max(n) - 2000 FROM r GROUP BY run_id HAVING max(n) > 2000""")
def stream_first_events(spark, folder):
    use_rocksdb(spark)
    half = F.when(F.to_date("ts") < F.lit("2024-01-16").cast("date"), "base").otherwise("cur")
    return drain(monitors.first_events(read_table_stream(spark, folder, "events").select(half.alias("run_id"), F.col("event_id").alias("seq")), 2000))
