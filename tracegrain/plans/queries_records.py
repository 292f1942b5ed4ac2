"""Catalogue: the record workloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrain.operators import records as ops
from tracegrain.operators.series import increasing_violations
from tracegrain.plans import adapters as ad
from tracegrain.plans.registry import query, table
from tracegrain.session import spread

_RECORDS = ad.SQL_RAW + """,
records AS (
  SELECT id, amount_cents, coalesce(region, 'unknown') AS region, coalesce(quantity, 1) AS quantity, coalesce(status, 'completed') AS status,
         user_id, upper(coalesce(country, 'unknown')) AS country, coalesce(discount_bps, 0) AS discount_bps, created_at, product, note,
         coalesce(source, 'fake-api') AS source,
         amount_cents * coalesce(quantity, 1) * (10000 - coalesce(discount_bps, 0)) // 10000 AS net_amount_cents
  FROM raw WHERE coalesce(status, 'completed') = 'completed')"""
_ALL = "SELECT id, amount_cents, region, quantity, status, user_id, country, discount_bps, created_at, product, note, source, net_amount_cents FROM records"


def _plain_time(df):
    return df.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("etl_native", f"WITH {_RECORDS} {_ALL}")
def etl_native(spark, folder):
    return _plain_time(ops.native_records(ad.raw_records(spark, folder)))


@query("etl_udf", f"WITH {_RECORDS} {_ALL}")
def etl_udf(spark, folder):
    return _plain_time(ops.udf_records(ad.raw_records(spark, folder)))


@query("etl_row_loop", f"WITH {_RECORDS} {_ALL}")
def etl_row_loop(spark, folder):
    return _plain_time(ops.row_loop_records(ad.raw_records(spark, folder)))


@query("etl_udf_equal", f"WITH {_RECORDS} SELECT count(*) AS records, CAST(0 AS BIGINT) AS different FROM records")
def etl_udf_equal(spark, folder):
    native, udf = (f(ad.raw_records(spark, folder)) for f in (ops.native_records, ops.udf_records))
    counted = native.select(F.lit(1).alias("r"), F.lit(0).alias("d")).unionByName(
        ops.both_ways(native, udf).select(F.lit(0).alias("r"), F.lit(1).alias("d")))
    return counted.agg(F.sum("r").alias("records"), F.sum("d").alias("different"))


@query("etl_rollup", f"WITH {_RECORDS} SELECT region, count(*) AS records, CAST(sum(net_amount_cents) AS BIGINT) AS revenue_cents FROM records GROUP BY region")
def etl_rollup(spark, folder):
    return ops.rollup_by_region(ops.native_records(ad.raw_records(spark, folder)))


@query("etl_stats", f"""WITH {_RECORDS} SELECT count(*) AS records, CAST(sum(net_amount_cents) AS BIGINT) AS revenue_cents,
count(DISTINCT note) AS unique_ids, CAST(0 AS BIGINT) AS bad_rows FROM records""")
def etl_stats(spark, folder):
    return ops.record_stats(ops.native_records(ad.raw_records(spark, folder)), "note")


@query("except_both", """WITH a AS (SELECT l_suppkey % 50 AS k, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'A'),
b AS (SELECT l_suppkey % 50 AS k, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'R')
SELECT k, n, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT k, n, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def except_both(spark, folder):
    l = table(spark, folder, "lineitem").select((F.col("l_suppkey") % 50).alias("k"), F.col("l_linenumber").alias("n"), "l_returnflag")
    return ops.both_ways(l.where(F.col("l_returnflag") == "A").drop("l_returnflag"), l.where(F.col("l_returnflag") == "R").drop("l_returnflag"))


_SYNTHETIC = """g AS (SELECT o_orderkey AS i, 2 + o_orderkey % 11 AS w FROM orders),
s AS (SELECT i, w, i * 37 % 100000 AS cents FROM g)"""


@query("synthetic_records", f"""WITH {_SYNTHETIC} SELECT CAST(i AS VARCHAR) AS id,
CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS amount,
CASE WHEN w >= 3 THEN 'r' || CAST(i % 50 AS VARCHAR) END AS region, CASE WHEN w >= 4 THEN CAST(1 + i % 5 AS VARCHAR) END AS quantity,
CASE WHEN w >= 5 THEN CASE WHEN i % 7 = 0 THEN 'cancelled' ELSE 'completed' END END AS status,
CASE WHEN w >= 6 THEN CAST(i % 100000 AS VARCHAR) END AS user_id, CASE WHEN w >= 7 THEN ['ca', 'np', 'us'][i % 3 + 1] END AS country,
CASE WHEN w >= 8 THEN CAST(i % 6 * 100 AS VARCHAR) END AS discount_bps,
CASE WHEN w >= 9 THEN strftime(TIMESTAMP '2026-01-01' + to_seconds(i), '%Y-%m-%dT%H:%M:%S+00:00') END AS created_at,
CASE WHEN w >= 10 THEN 'product-' || CAST(i % 500 AS VARCHAR) END AS product,
CASE WHEN w >= 11 THEN 'API event ' || CAST(i AS VARCHAR) || ': ' || repeat('unused summary detail; ', 4) END AS note,
CASE WHEN w >= 12 THEN 'fake-api' END AS source FROM s""")
def synthetic_records(spark, folder):
    return ops.with_fields(table(spark, folder, "orders").select(F.col("o_orderkey").alias("id")))


@query("synthetic_rollup", f"""WITH {_SYNTHETIC} SELECT CASE WHEN w >= 3 THEN 'r' || CAST(i % 50 AS VARCHAR) ELSE 'unknown' END AS region, count(*) AS records,
CAST(sum(cents * (CASE WHEN w >= 4 THEN 1 + i % 5 ELSE 1 END) * (10000 - CASE WHEN w >= 8 THEN i % 6 * 100 ELSE 0 END) // 10000) AS BIGINT) AS revenue_cents
FROM s WHERE NOT (w >= 5 AND i % 7 = 0) GROUP BY 1""")
def synthetic_rollup(spark, folder):
    return ops.rollup_by_region(ops.native_records(synthetic_records(spark, folder)))


@query("nested_records", f"""WITH {_SYNTHETIC} SELECT i AS id, cents AS amount_cents, CASE WHEN w >= 3 THEN i % 100000 END AS user_id,
CASE WHEN w >= 4 THEN strftime(TIMESTAMP '2026-01-01' + to_seconds(i), '%Y-%m-%dT%H:%M:%S+00:00') END AS created_at, 'completed' AS status, 'USD' AS currency,
CASE WHEN w >= 7 THEN 1 + i % 5 ELSE 1 END AS quantity, CASE WHEN w >= 8 THEN 'product-' || CAST(i % 500 AS VARCHAR) END AS product,
CASE WHEN w >= 9 THEN ['CA', 'NP', 'US'][i % 3 + 1] END AS country, CASE WHEN w >= 10 THEN i % 4 <> 0 ELSE true END AS active,
CASE WHEN w >= 11 THEN 'api,cohort-' || CAST(i % 10 AS VARCHAR) ELSE '' END AS tags, CAST(0 AS INTEGER) AS violations
FROM s WHERE NOT (w >= 5 AND i % 7 = 0)""")
def nested_records(spark, folder):
    ids = spread(table(spark, folder, "orders").select(F.col("o_orderkey").alias("id")))
    out = ops.normalize_nested(ops.with_nested_fields(ids))
    return out.withColumns({"tags": F.array_join("tags", ","), "violations": F.size("violations")}).drop("metadata")


@query("nested_violations", """SELECT reason, count(*) AS rows FROM (
  SELECT unnest(list_filter([CASE WHEN l_partkey % 3 = 0 THEN 'missing id or amount' END,
    CASE WHEN l_partkey % 4 = 0 THEN 'quantity is not a positive integer' END,
    CASE WHEN l_partkey % 5 = 0 THEN 'unknown fields' END, CASE WHEN l_partkey % 7 = 0 THEN 'created_at needs a timezone' END,
    CASE WHEN l_partkey % 11 = 0 THEN 'active is not a boolean' END, CASE WHEN l_partkey % 13 = 0 THEN 'tags is not an array of strings' END,
    CASE WHEN l_partkey % 3 <> 0 AND l_partkey % 2 = 0 THEN 'amount is not a nonnegative number of cents' END], lambda x: x IS NOT NULL)) AS reason FROM lineitem)
GROUP BY reason""")
def nested_violations(spark, folder):
    p = F.col("l_partkey")
    doc = F.to_json(F.struct(
        F.col("l_orderkey").alias("id"),
        F.when(p % 3 != 0, F.when(p % 2 == 0, "1.005").otherwise("1.5")).alias("amount"),
        F.when(p % 4 == 0, "0").otherwise("3").alias("quantity"), F.when(p % 5 == 0, "x").alias("surprise"),
        F.when(p % 7 == 0, "2026-01-01T00:00:00").otherwise("2026-01-01T00:00:00+02:00").alias("created_at"),
        F.when(p % 11 == 0, "maybe").otherwise("true").alias("active")))
    tags = F.when(p % 13 == 0, F.lit(',"tags":[1,2]}')).otherwise(F.lit(',"tags":["a"]}'))
    raw = spread(table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")).select(F.concat(F.regexp_replace(doc, "}$", ""), tags).alias("value"))
    return ops.normalize_nested(raw).select(F.explode("violations").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


@query("filtered_sum", "SELECT event_type AS region, round(sum(value), 4) AS total FROM events WHERE value > 100 GROUP BY 1")
def filtered_sum(spark, folder):
    e = table(spark, folder, "events").select(F.col("event_type").alias("region"), F.col("value").alias("amount"))
    return ops.filtered_sum(e, "region", "amount", 100).withColumn("total", F.round("total", 4))


@query("even_square_total", "SELECT CAST(sum(x) AS BIGINT) AS total FROM (SELECT l_linenumber * l_partkey * l_linenumber * l_partkey AS x FROM lineitem) WHERE x % 2 = 0")
def even_square_total(spark, folder):
    l = table(spark, folder, "lineitem").select((F.col("l_linenumber") * F.col("l_partkey")).alias("i"))
    total = ops.even_square_total(l, "i")
    # One number: a bigint as in the statement while it is one, else the exact decimal.
    value = total.first()["total"]
    return spark.createDataFrame([(value,)], total.schema).select(F.col("total").cast("bigint" if value is None or value < 1 << 63 else "decimal(38,0)").alias("total"))


@query("log_sum", "SELECT CAST(sum(event_id * 7 % 997) AS BIGINT) AS total FROM events")
def log_sum(spark, folder):
    from tracegrain.sources.records import log_amounts

    e = table(spark, folder, "events")
    lines = e.select(F.concat_ws(",", "event_id", F.concat(F.lit("user"), F.col("user_id").cast("string")), F.col("event_id") * 7 % 997).alias("value"))
    return log_amounts(lines).agg(F.sum("amount").alias("total"))


@query("report_length", "SELECT CAST(sum(length('row ' || CAST(o_orderkey AS VARCHAR)) + 1) AS BIGINT) AS chars FROM orders")
def report_length(spark, folder):
    return ops.report_length(table(spark, folder, "orders"), "o_orderkey")


@query("id_monotonic", """SELECT o_orderpriority AS run_id, count(*) AS rows, count(*) FILTER (WHERE p >= o_custkey) AS violations
FROM (SELECT *, lag(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS p FROM orders) GROUP BY 1""")
def id_monotonic(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("run_id"), F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("id"))
    return increasing_violations(o, ["run_id"], ["position"], "id")


_LINEITEM = ("l_discount", "l_extendedprice", "l_linenumber", "l_linestatus", "l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_suppkey", "l_tax")


@query("dataset_digest", "SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in _LINEITEM)
       + ")), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM lineitem")
def dataset_digest(spark, folder):
    from tracegrain.sources.files import row_digest

    return row_digest(table(spark, folder, "lineitem").select(*_LINEITEM))
