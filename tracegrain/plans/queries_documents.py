"""Catalogue: run documents, one per customer, through parsing, checks, tables, annotations, summary and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracegrain.operators.checks import validate_profiles
from tracegrain.plans import report, summary
from tracegrain.plans.registry import query, table
from tracegrain.session import spread, stored
from tracegrain.sources import profiles as src


def _line(time: Column, samples: Column, held: Column, end: Column, func_line: int, leak: Column | None = None) -> Column:
    zero = F.lit(0.0)
    return F.struct(
        time.alias("time_s"), (time / 10).alias("share"), time.alias("python_s"), zero.alias("native_s"), zero.alias("system_s"), samples.alias("samples"),
        zero.alias("rss_growth_mb"), zero.alias("rss_release_mb"), held.alias("peak_mb"), end.alias("end_mb"), (leak if leak is not None else F.lit(None).cast("int")).alias("leak_runs"),
        F.lit(func_line).alias("func_line"))


def _frame(name: str, line: int, first: int, user: bool = True) -> Column:
    return F.struct(F.lit("/app/main.py").alias("file"), F.lit(line).alias("line"), F.lit(name).alias("name"), F.lit(first).alias("first_line"), F.lit(user).alias("user"))


def documents(spark, folder) -> DataFrame:
    """(path, raw): a small run document per customer; some break a rule of the format, some are cut off."""
    k = F.col("c_custkey")
    mode = F.element_at(F.array(F.lit("precise"), F.lit("fast"), F.lit("off")), (k % 3 + 1).cast("int"))
    busy, held = (k % 50 + 1) / 10, (k % 40).cast("double")
    function = lambda name, time, mb: F.struct(F.lit(name).alias("name"), time.alias("time_s"), time.alias("python_s"), F.lit(0.0).alias("native_s"), F.lit(0.0).alias("system_s"), mb.alias("peak_mb"))
    sample = lambda ids, time: F.struct(
        F.lit("1").alias("thread"), F.lit("main").alias("thread_name"), F.array(*[F.lit(i) for i in ids]).alias("frames"), time.alias("python_s"), F.lit(0.0).alias("native_s"),
        F.lit(0.0).alias("system_s"), F.lit(0.0).alias("unsplit_s"), F.lit(1).alias("samples"))
    doc = F.struct(
        F.when(k % 11 == 0, 9).otherwise(3).alias("schema"), F.lit("/app/main.py").alias("script"), F.lit("3.13.0").alias("python"), F.lit(True).alias("gil_split"),
        F.when(k % 7 == 0, -1.0).otherwise(10.0).alias("wall_s"), mode.alias("memory_mode"), F.lit("current").alias("rss_kind"), F.lit(1.0).alias("rss_start_mb"), held.alias("rss_peak_mb"),
        held.alias("peak_traced_mb"), F.lit("process-observation").alias("memory_attribution"), F.lit(True).alias("memory_snapshot_at_exit"),
        F.create_map(F.lit("/app/main.py"), F.create_map(
            F.lit("5"), _line(busy, F.lit(20), held, held, 1, F.when(k % 4 == 0, 3)), F.lit("9"), _line(F.lit(0.05), F.lit(1), F.lit(0.5), F.lit(0.0), 8))).alias("files"),
        F.create_map(F.lit("/app/main.py"), F.create_map(F.lit("1"), function("main", busy, held), F.lit("8"), function("helper", F.lit(0.05), F.lit(0.5)))).alias("functions"),
        F.create_map(F.lit("/app/main.py"), F.sha1(k.cast("string"))).alias("file_hashes"),
        F.struct(F.array(_frame("main", 5, 1), _frame("helper", 9, 8), _frame("json", 3, 2, False)).alias("frames"), F.array(sample([0, 1], F.lit(0.5)), sample([0, 2], busy)).alias("samples"),
                 F.lit(0.0).alias("dropped_s"), F.lit(False).alias("depth_limited")).alias("stacks"),
        F.array(*[F.array(F.lit(float(t)), held, F.lit(float(t + 1))) for t in range(4)]).alias("timeline"), F.array(*[F.lit(i) for i in (0, 0, 1, 1)]).alias("timeline_stacks"))
    text = F.to_json(doc)
    return spread(table(spark, folder, "customer").select("c_custkey")).select(F.concat(F.lit("/runs/"), k.cast("string"), F.lit(".json")).alias("path"), F.when(k % 13 == 0, F.substring(text, 1, 200)).otherwise(text).alias("raw"))


def _key(df: DataFrame) -> DataFrame:
    return df.withColumn("run", F.regexp_extract("path", "([0-9]+)", 1).cast("long"))


_GOOD = "c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0"
_K = f"""k AS (SELECT c_custkey AS run, (c_custkey % 50 + 1) / 10 AS busy, CAST(c_custkey % 40 AS DOUBLE) AS held, c_custkey % 3 = 0 AS precise, c_custkey % 3 = 2 AS off,
  c_custkey % 3 = 0 AND c_custkey % 4 = 0 AS growing FROM customer WHERE {_GOOD})"""


@query("profile_validation", """WITH c AS (SELECT c_custkey AS k FROM customer),
r AS (SELECT 'wall_s' AS reason FROM c WHERE k % 13 = 0 OR k % 7 = 0 UNION ALL SELECT 'schema version' FROM c WHERE k % 13 = 0 OR k % 11 = 0
  UNION ALL SELECT unnest(['not a JSON object with the fixed field types', 'script, python or gil_split', 'memory_mode', 'files, functions or file_hashes']) FROM c WHERE k % 13 = 0)
SELECT reason, count(*) AS documents FROM r GROUP BY reason""")
def profile_validation(spark, folder):
    _, rejected = validate_profiles(src.parse_profiles(documents(spark, folder)))
    return rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("documents"))


def _good(spark, folder):
    return validate_profiles(src.parse_profiles(documents(spark, folder)))[0]


@query("profile_lines", f"""WITH {_K} SELECT run, 5 AS line, busy AS time_s, held AS peak_mb, CAST(20 AS BIGINT) AS samples FROM k
UNION ALL SELECT run, 9, 0.05, 0.5, CAST(1 AS BIGINT) FROM k""")
def profile_lines(spark, folder):
    good = stored(_good(spark, folder))  # parsed and checked once
    lines = src.lines(good).join(_key(good.select("run_id", "path")), "run_id")
    return lines.select("run", "line", "time_s", "peak_mb", "samples")


@query("profile_annotations", f"""WITH {_K} SELECT run, kind, count(*) AS rows, count(*) FILTER (WHERE hot) AS hot FROM (
  SELECT run, 'function' AS kind, false AS hot FROM k UNION ALL SELECT run, 'function', false FROM k
  UNION ALL SELECT run, 'line', busy / 10 >= 0.05 OR (precise AND held >= 10) OR growing FROM k WHERE busy / 10 >= 0.01 OR (precise AND held >= 1) OR growing
  UNION ALL SELECT run, 'leak', true FROM k WHERE growing) GROUP BY run, kind""")
def profile_annotations(spark, folder):
    good = stored(_good(spark, folder))
    rows = report.annotations(good).join(_key(good.select("run_id", "path")), "run_id")
    return rows.groupBy("run", "kind").agg(F.count(F.lit(1)).alias("rows"), F.count_if("hot").alias("hot"))


@query("run_summaries", f"""WITH {_K} SELECT run, 10.0::DOUBLE AS duration, CASE WHEN precise THEN held END AS peak_traced, CASE WHEN NOT off THEN held END AS rss_peak,
  CAST(2 AS INTEGER) AS functions, CASE WHEN busy >= 0.05 THEN 'main' ELSE 'helper' END AS first_function, floor(busy / (busy + 0.05) * 1000 + 0.5) / 1000 AS first_share,
  CASE WHEN precise AND held >= 1 THEN CASE WHEN growing THEN 'growing' ELSE 'retained' END END AS retention, 'unavailable' AS exit_retention, CAST(1 AS INTEGER) AS phases FROM k""")
def run_summaries(spark, folder):
    doc = summary.build_summary(_good(spark, folder), "/app", "now")
    s = F.col("summary")
    return doc.select(
        F.regexp_extract(s["profile"]["path"], "([0-9]+)", 1).cast("long").alias("run"), s["totals"]["run_duration_s"]["value"].alias("duration"),
        s["totals"]["peak_traced_mb"]["value"].alias("peak_traced"), s["totals"]["rss_peak_mb"]["value"].alias("rss_peak"), F.size(s["functions"]).alias("functions"),
        s["functions"][0]["name"].alias("first_function"), s["functions"][0]["share"].alias("first_share"), F.get(s["retention"]["findings"], F.lit(0))["status"].alias("retention"),
        s["capabilities"]["exit_retention"]["status"].alias("exit_retention"), F.size(s["phases"]).alias("phases"))


@query("run_reports", f"""WITH {_K} SELECT run, round(busy + 0.5, 6) AS root, CAST(4 AS INTEGER) AS nodes, CASE WHEN busy >= 0.5 THEN 'json' ELSE 'helper' END AS first_function,
  CASE WHEN growing AND held >= 1 THEN 1 WHEN precise AND held >= 1 THEN 0 END AS growing, CAST(4 AS INTEGER) AS points FROM k""")
def run_reports(spark, folder):
    good = stored(_good(spark, folder))
    doc = report.build_report(good).join(_key(good.select("run_id", "path")), "run_id")
    r = F.col("report")
    return doc.select("run", F.round(F.filter(r["tree"], lambda n: n["depth"] == 0)[0]["value"], 6).alias("root"), F.size(r["tree"]).alias("nodes"),
                      r["functions"][0]["name"].alias("first_function"), r["growing_count"].cast("int").alias("growing"), F.size(r["overview"]["timeline"]).alias("points"))
