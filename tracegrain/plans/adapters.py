"""Evidence-shaped views over the star-schema test tables, each with its SQL twin for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracegrain.plans.registry import table


def micros(ts: str) -> Column:
    """Microseconds since the epoch of a wall-clock timestamp, whatever the session's zone."""
    c = F.col(ts)
    return (F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + F.hour(c).cast("long") * 3_600_000_000
            + F.minute(c).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long"))


def cents(col: str) -> Column:
    return F.round(F.col(col) * 100).cast("long")


def _k() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


# ---- D1: samples of two runs
SQL_SAMPLES = """samples AS (
  SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'base' ELSE 'cur' END AS run_id, event_type AS file, k AS line,
         k // 10 * 10 AS first_line, 'f' || CAST(k // 10 AS VARCHAR) AS function, user_id AS thread, w AS weight, event_id
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
               CAST(round(value * 100) AS BIGINT) AS w FROM events))"""


def samples(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").withColumn("line", _k())
    base = F.to_date("ts") < F.lit("2024-01-16").cast("date")
    tens = F.floor(F.col("line") / 10).cast("int")
    return e.select(
        F.when(base, "base").otherwise("cur").alias("run_id"), F.col("event_type").alias("file"), "line",
        (tens * 10).alias("first_line"), F.concat(F.lit("f"), tens.cast("string")).alias("function"),
        F.col("user_id").alias("thread"), cents("value").alias("weight"), "event_id")


# ---- D2: call stacks
SQL_STACKS = """stacks AS (
  SELECT o_orderstatus AS thread, r_name, n_name, c_mktsegment, o_orderpriority,
         [r_name, n_name, c_mktsegment, o_orderpriority] AS path, CAST(round(o_totalprice * 100) AS BIGINT) AS weight, o_orderkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def stacks(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as stacks region > nation > segment > priority; the two middle frames are library code."""
    region, nation = table(spark, folder, "region"), table(spark, folder, "nation")
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 fixed rows
    buyers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(
        F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, folder, "orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"))

    def frame(file: str, line: Column, name: str, user: bool) -> Column:
        return F.struct(F.lit(file).alias("file"), line.cast("int").alias("line"), F.col(name).alias("name"),
                        line.cast("int").alias("first_line"), F.lit(user).alias("user"))

    path = F.array(
        frame("/app/main.py", F.col("r_regionkey") + 1, "r_name", True),
        frame("/venv/lib/site-packages/geo/core.py", F.col("n_nationkey") + 1, "n_name", False),
        frame("/venv/lib/site-packages/geo/mkt.py", F.length("c_mktsegment"), "c_mktsegment", False),
        frame("/app/prio.py", F.substring("o_orderpriority", 1, 1).cast("int"), "o_orderpriority", True))
    return orders.select(F.lit("all").alias("run_id"), F.col("o_orderstatus").alias("thread"),
                         F.concat(F.lit("T"), F.col("o_orderstatus")).alias("thread_name"), path.alias("path"),
                         cents("o_totalprice").alias("weight"), F.col("o_orderkey").alias("seq"))


def deep_stacks(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as stacks of six frames, each mostly one of its choices."""
    l = table(spark, folder, "lineitem")
    names = [F.col("l_returnflag"), F.col("l_linestatus"), F.when(F.col("l_quantity") > 10, "many").otherwise("few"), F.when(F.col("l_discount") < 0.08, "plain").otherwise("cut"),
             F.when(F.col("l_tax") < 0.07, "low").otherwise("high"), F.concat(F.lit("line"), F.col("l_linenumber").cast("string"))]
    frames = [F.struct(F.lit("/app/items.py").alias("file"), F.lit(i + 1).alias("line"), n.alias("name"), F.lit(i + 1).alias("first_line"), F.lit(True).alias("user")) for i, n in enumerate(names)]
    return l.select(F.lit("all").alias("run_id"), F.lit("1").alias("thread"), F.array(*frames).alias("path"), cents("l_extendedprice").alias("weight"))


# ---- D3: one series per user
SQL_SERIES = """series AS (
  SELECT user_id AS run_id, epoch_us(ts) AS t, event_id AS seq, CAST(round(value * 100) AS BIGINT) AS traced,
         CAST(round(value * 100) AS BIGINT) + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 100 AS rss,
         CASE WHEN event_type = 'error' THEN [] WHEN event_type IN ('view', 'click') THEN ['browse', event_type]
              ELSE ['convert', event_type] END AS path
  FROM events)"""


def series(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    kind = F.col("event_type")
    path = (F.when(kind == "error", F.array().cast("array<string>"))
            .when(kind.isin("view", "click"), F.array(F.lit("browse"), kind)).otherwise(F.array(F.lit("convert"), kind)))
    return e.select(F.col("user_id").alias("run_id"), micros("ts").alias("t"), F.col("event_id").alias("seq"),
                    cents("value").alias("traced"), (cents("value") + _k().cast("long") * 100).alias("rss"), path.alias("path"))


# ---- D4: declared shared accesses
SQL_ACCESSES = """accesses AS (
  SELECT 'all' AS run_id, event_id AS id, epoch_us(ts) AS t, 'k' || CAST(k % 10 AS VARCHAR) AS key, user_id % 5 AS actor,
         CASE event_type WHEN 'view' THEN 'shared_read' WHEN 'click' THEN 'shared_write' ELSE 'shared_outcome' END AS category,
         CAST(floor(value) AS BIGINT) % 3 AS literal, CASE WHEN k >= 80 THEN user_id END AS acquisition,
         CAST(floor(value) AS BIGINT) % 2 AS expected, CAST(floor(value) AS BIGINT) % 4 AS observed
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)
  WHERE event_type IN ('view', 'click', 'purchase'))"""


def accesses(spark: SparkSession, folder: str) -> DataFrame:
    """Views read, clicks write, purchases declare an outcome; keys of 80 and up hold a lock per user."""
    e = table(spark, folder, "events").where(F.col("event_type").isin("view", "click", "purchase")).withColumn("k", _k())
    whole = F.floor("value").cast("long")
    held = F.when(F.col("k") >= 80, F.array(F.struct(F.concat(F.lit("L"), (F.col("k") % 10).cast("string")).alias("lock_id"),
                                                     F.col("user_id").alias("acquisition_id"))))
    none = F.array().cast("array<struct<lock_id:string,acquisition_id:bigint>>")
    return e.select(
        F.lit("all").alias("run_id"), F.col("event_id").alias("id"), micros("ts").alias("t"),
        F.concat(F.lit("k"), (F.col("k") % 10).cast("string")).alias("key"), (F.col("user_id") % 5).alias("actor"),
        F.when(F.col("event_type") == "view", "shared_read").when(F.col("event_type") == "click", "shared_write")
        .otherwise("shared_outcome").alias("category"),
        F.lit("literal").alias("kind"), (whole % 3).cast("string").alias("value"), F.coalesce(held, none).alias("synchronization"),
        (whole % 2).cast("string").alias("expected"), (whole % 4).cast("string").alias("observed"))


# ---- D5: allocation records
SQL_ALLOCATIONS = """allocations AS (
  SELECT 'all' AS run_id, l_suppkey % 8 AS thread_id, l_returnflag AS domain, l_linestatus AS scope, l_partkey AS site,
         CAST(l_quantity AS BIGINT) AS size, l_orderkey * 8 + l_linenumber AS sequence, l_discount >= 0.08 AS outstanding
  FROM lineitem)"""


def allocations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.lit("all").alias("run_id"), (F.col("l_suppkey") % 8).alias("thread_id"), F.col("l_returnflag").alias("domain"),
        F.col("l_linestatus").alias("scope"), F.col("l_partkey").alias("site"), F.col("l_quantity").cast("long").alias("size"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sequence"), (F.col("l_discount") >= 0.08).alias("outstanding"))


# ---- D6: retained amounts per supplier and month
SQL_RETENTION = """monthly AS (
  SELECT l_suppkey AS line, year(l_shipdate) * 12 + month(l_shipdate) AS t,
         sum(CASE WHEN l_returnflag = 'R' THEN -CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END) AS net
  FROM lineitem GROUP BY ALL),
retention AS (
  SELECT line, t, CAST(sum(net) OVER (PARTITION BY line ORDER BY t) AS BIGINT) AS mb FROM monthly)"""


def retention_points(spark: SparkSession, folder: str) -> DataFrame:
    """Cumulative net quantity per supplier; months bound the length of each series."""
    from pyspark.sql import Window

    l = table(spark, folder, "lineitem")
    qty = F.col("l_quantity").cast("long")
    monthly = l.groupBy(F.col("l_suppkey").alias("line"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("t")).agg(
        F.sum(F.when(F.col("l_returnflag") == "R", -qty).otherwise(qty)).alias("net"))
    return monthly.select(F.lit("all").alias("run_id"), F.lit("supplier").alias("file"), F.col("line").cast("long").alias("line"),
                          F.col("t").cast("double").alias("t"),
                          F.sum("net").over(Window.partitionBy("line").orderBy("t")).cast("double").alias("mb"))


# ---- D7: raw string records
SQL_RAW = """raw AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS note,
         l_orderkey * 8 + l_linenumber AS id, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents,
         CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE 'r' || CAST(l_suppkey % 50 AS VARCHAR) END AS region,
         CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS quantity,
         CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_returnflag = 'R' THEN 'cancelled' ELSE 'completed' END AS status,
         CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_suppkey END AS user_id,
         CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN l_linestatus = 'F' THEN 'ca' ELSE 'np' END AS country,
         CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(round(l_discount * 10000) AS BIGINT) END AS discount_bps,
         CASE WHEN l_partkey % 2 = 0 THEN NULL ELSE l_shipdate END AS created_at,
         CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE 'product-' || CAST(l_partkey % 500 AS VARCHAR) END AS product,
         CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE 'store' END AS source
  FROM lineitem)"""


def raw_records(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem")
    part = F.col("l_partkey")
    money = cents("l_extendedprice")

    def unless(step: int, value: Column) -> Column:
        return F.when(part % step != 0, value.cast("string"))

    return l.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string").alias("id"),
        F.concat(F.floor(money / 100).cast("string"), F.lit("."), F.lpad((money % 100).cast("string"), 2, "0")).alias("amount"),
        unless(11, F.concat(F.lit("r"), (F.col("l_suppkey") % 50).cast("string"))).alias("region"),
        unless(7, F.col("l_quantity").cast("long")).alias("quantity"),
        unless(13, F.when(F.col("l_returnflag") == "R", "cancelled").otherwise("completed")).alias("status"),
        unless(5, F.col("l_suppkey")).alias("user_id"),
        unless(3, F.when(F.col("l_linestatus") == "F", "ca").otherwise("np")).alias("country"),
        unless(17, F.round(F.col("l_discount") * 10000).cast("long")).alias("discount_bps"),
        unless(2, F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).alias("created_at"),
        unless(19, F.concat(F.lit("product-"), (part % 500).cast("string"))).alias("product"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("note"),
        unless(23, F.lit("store")).alias("source"))


# ---- D9: an owner graph with back references
SQL_GRAPH = """nodes AS (
  SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS node, 'region' AS type, 64 AS bytes FROM region
  UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'nation', 72 FROM nation
  UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'customer', 100 + c_custkey % 7 FROM customer
  UNION ALL SELECT 'o' || CAST(o_orderkey AS VARCHAR), 'order', 200 + o_orderkey % 5 FROM orders),
edges AS (
  SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS src, 'n' || CAST(n_nationkey AS VARCHAR) AS dst FROM nation
  UNION ALL SELECT 'n' || CAST(c_nationkey AS VARCHAR), 'c' || CAST(c_custkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'c' || CAST(o_custkey AS VARCHAR), 'o' || CAST(o_orderkey AS VARCHAR) FROM orders
  UNION ALL SELECT 'o' || CAST(o_orderkey AS VARCHAR), 'n' || CAST(o_custkey % 25 AS VARCHAR) FROM orders WHERE o_custkey % 89 = 0
  UNION ALL SELECT 'o' || CAST(o_orderkey AS VARCHAR), 'c' || CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey % 97 = 0)"""


def graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(roots, nodes, edges): regions own nations own customers own orders; some orders point back to a nation or to their customer."""
    region, nation = table(spark, folder, "region"), table(spark, folder, "nation")
    customer, orders = table(spark, folder, "customer"), table(spark, folder, "orders")

    def name(prefix: str, key: Column | str) -> Column:
        return F.concat(F.lit(prefix), (F.col(key) if isinstance(key, str) else key).cast("string"))

    def node(df: DataFrame, prefix: str, key: str, kind: str, size: Column) -> DataFrame:
        return df.select(F.lit("all").alias("run_id"), name(prefix, key).alias("node"), F.lit(kind).alias("type"), size.cast("long").alias("bytes"))

    def edge(df: DataFrame, src: Column, dst: Column) -> DataFrame:
        return df.select(F.lit("all").alias("run_id"), src.alias("src"), dst.alias("dst"), dst.alias("label"))

    nodes = (node(region, "r", "r_regionkey", "region", F.lit(64))
             .unionByName(node(nation, "n", "n_nationkey", "nation", F.lit(72)))
             .unionByName(node(customer, "c", "c_custkey", "customer", 100 + F.col("c_custkey") % 7))
             .unionByName(node(orders, "o", "o_orderkey", "order", 200 + F.col("o_orderkey") % 5)))
    edges = (edge(nation, name("r", "n_regionkey"), name("n", "n_nationkey"))
             .unionByName(edge(customer, name("n", "c_nationkey"), name("c", "c_custkey")))
             .unionByName(edge(orders, name("c", "o_custkey"), name("o", "o_orderkey")))
             .unionByName(edge(orders.where(F.col("o_custkey") % 89 == 0), name("o", "o_orderkey"), name("n", F.col("o_custkey") % 25)))
             .unionByName(edge(orders.where(F.col("o_custkey") % 97 == 0), name("o", "o_orderkey"), name("c", "o_custkey"))))
    roots = region.select(F.lit("all").alias("run_id"), name("r", "r_regionkey").alias("node"), name("r", "r_regionkey").alias("label"))
    return roots, nodes, edges


# ---- D10: static findings
SQL_FINDINGS = """findings AS (
  SELECT d.source AS file, d.doc_id AS line, 'quality' AS code, CASE WHEN l.quality = 1 THEN 'warning' ELSE 'information' END AS severity
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def findings(spark: SparkSession, folder: str) -> DataFrame:
    d, l = table(spark, folder, "documents").select("doc_id", "source"), table(spark, folder, "labels")
    return d.join(l, "doc_id").select(
        F.lit("all").alias("run_id"), F.col("source").alias("file"), F.col("doc_id").alias("line"), F.lit("quality").alias("code"),
        F.when(F.col("quality") == 1, "warning").otherwise("information").alias("severity"))
