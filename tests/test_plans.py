"""What the physical plans must look like."""

import os

import pytest

from tracegrain.operators.scan import scan
from tracegrain.plans.catalogue import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(QUERIES["filtered_sum"](spark, FOLDER))
    assert "GreaterThan(value,100.0)" in p and "ReadSchema: struct<event_type:string,value:double>" in p
    assert "html" not in plan(QUERIES["path_keys"](spark, FOLDER)).split("ReadSchema")[-1]


def test_aggregates_combine_before_the_shuffle(spark):
    p = plan(QUERIES["alloc_totals"](spark, FOLDER))
    assert p.count("partial_sum") >= 1 and "BatchEvalPython" not in p


def test_chained_scans_share_one_shuffle(spark):
    from pyspark.sql import functions as F

    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").alias("t"))
    a = scan(df, ["g"], ["t"], prev={"p": F.col("t")}, row_number="i")
    b = scan(a, ["g"], ["t"], run_sum={"s": F.col("p")}, fill={"f": F.col("p")})
    assert plan(b).count("Exchange hashpartitioning") == 1


def test_native_records_stay_out_of_python(spark):
    assert "Python" not in plan(QUERIES["etl_native"](spark, FOLDER)) and "ArrowEvalPython" in plan(QUERIES["etl_udf"](spark, FOLDER))


def test_no_cartesian_products(spark):
    for name in ("lost_updates", "phases_depth", "inside_function", "innermost_scope", "path_remap", "top_functions"):
        p = plan(QUERIES[name](spark, FOLDER))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_trees_and_budgets_are_read_once(spark):
    """Trees, paths and budgets are written before they meet themselves; no plan above has a product, a nested loop or a single partition."""
    for name in ("hottest_path", "hottest_path_deep", "call_tree_limited", "alloc_budget", "unprotected_accesses", "owner_paths", "cycles"):
        p = plan(QUERIES[name](spark, FOLDER))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p and "SinglePartition" not in p and p.count("FileScan") <= 3, name
