"""Catalogue entries against their SQL statements on the smallest tables. TRACEGRAIN_QUERIES=all adds those that take longest: streams, whole runs, rules."""

import os

import duckdb
import pytest

from check_queries import TABLES, rows_of
from tracegrain.plans.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
SLOW = ("stream_", "run_", "rule_")
NAMES = [n for n in sorted(ORACLES) if os.environ.get("TRACEGRAIN_QUERIES") == "all" or not n.startswith(SLOW)]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    r = con.execute(ORACLES[name])
    assert got == rows_of([d[0] for d in r.description], r.fetchall())


def test_every_statement_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
