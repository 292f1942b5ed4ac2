import os
import re

import pytest
from pyspark.sql import functions as F

from tracegrain.functions import rule_tables
from tracegrain.functions.text import render_message
from tracegrain.operators import findings, lines as line_ops, rules

HERE = os.path.dirname(os.path.abspath(__file__))
MARKER = "tracegrain: ignore"


def expected(text, word="expect"):
    out = set()
    for i, content in enumerate(text.split("\n"), 1):
        for codes in re.findall(rf"# {word}: ([\w.,\- ]+)", content):
            out |= {(i, c.strip()) for c in codes.split(",")}
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    names = ["patterns.txt", "scopes.txt"]
    return {n: open(os.path.join(HERE, "corpus", n), encoding="utf-8").read() for n in names}


@pytest.fixture(scope="module")
def found(spark, corpus):
    df = spark.createDataFrame([*corpus.items(), ("broken.py", "def (")], "path string, text string")
    return rules.scan_rules(df, marker=MARKER).cache()


def test_every_rule_fires_where_expected(found, corpus):
    for name, text in corpus.items():
        got = {(r["line"], r["code"]) for r in found.where(F.col("path") == name).collect()}
        assert got == expected(text) | expected(text, "expect-lock"), name
    assert found.where("path = 'broken.py'").count() == 0
    assert {r["code"] for r in found.select("code").distinct().collect()} == set(rule_tables.SEVERITIES)


def test_severity_scope_and_messages(found):
    rows = {(r["path"], r["line"], r["code"]): r for r in rules.with_messages(found, {"py_version": "3.13", "int_size": "28", "str_empty": "41", "ptr_size": "8"}).collect()}
    hit = next(r for k, r in rows.items() if k[2] == "heap-inflation")
    assert hit["scope"] == "build()" and hit["subject"] == "cur" and hit["severity"] == "warning" and "28 B per int" in hit["message"]
    assert hit["message"].startswith("build() › `cur` — ") and hit["status"] == "potential"
    slots = next(r for k, r in rows.items() if k[2] == "ram-fragmentation.no-slots")
    assert "{" not in slots["message"] and "instance3" not in slots["message"]
    assert all("{" not in r["message"] for r in rows.values())


def test_threads_rule_needs_a_lock(spark, corpus):
    df = spark.createDataFrame([("patterns.txt", corpus["patterns.txt"])], "path string, text string")
    got = {(r["line"], r["code"]) for r in rules.scan_rules(df, gil_disabled=True, marker=MARKER).collect()}
    assert got == expected(corpus["patterns.txt"])


def test_one_position_one_code(spark):
    df = spark.createDataFrame([("a", 1, 2, "c", None, "x", {"k": "1"}), ("a", 1, 2, "c", None, "y", {"k": "2"}), ("a", 1, 3, "c", None, "z", {})],
                               "path string, line int, col int, code string, scope string, subject string, args map<string,string>")
    assert rules.first_per_position(df).count() == 2


def test_columns_count_utf16_units(spark):
    df = spark.createDataFrame([("a.py", "x = '😀é'; cur.fetchall()\n")], "path string, text string")
    assert [(r["line"], r["col"]) for r in rules.scan_rules(df).collect()] == [(1, 15)]


def test_symbols_of_lines(spark):
    text = "@deco\ndef f(rows):\n    for r in rows:\n        self.a[i] = b = g(h(r))\n    with open(p) as q:\n        a.b(); c(); d(); e(); k()\n"
    got = {r["line"]: r for r in rules.symbols(spark.createDataFrame([("a.py", text)], "path string, text string")).collect()}
    assert got[1]["function_end"] == 6 and got[3]["assigns"] == ["r"] and got[3]["scope"] == "f()"
    assert got[4]["assigns"] == ["self.a[…]", "b"] and got[4]["calls"] == ["g", "h"] and got[5]["assigns"] == ["q"]
    assert got[6]["calls"] == ["a.b", "c", "d", "e", "k"]
    few = rules.symbols(spark.createDataFrame([("a.py", text)], "path string, text string"), most_calls=4).where("line = 6").first()
    assert few["calls"] == ["a.b", "c", "d", "e"]


def test_scopes_from_syntax(spark):
    text = "class A:\n    def f(self):\n        return [x for x in (y for y in z)]\n\n\ndef g():\n    return lambda: 1\n"
    s = rules.scopes(rules.parse(spark.createDataFrame([("a.py", text)], "path string, text string")))
    pts = spark.createDataFrame([("a.py", n) for n in (1, 2, 3, 5, 7)], "file string, line int")
    got = {r["line"]: r["scope_name"] for r in line_ops.innermost_scope(pts, s).collect()}
    assert got == {1: "A", 2: "f", 3: "<genexpr>", 5: "", 7: "<lambda>"}
    skipped = {r["line"]: r["scope_name"] for r in line_ops.innermost_scope(pts, s, skip_inline=F.lit(True)).collect()}
    assert skipped[3] == "f" and skipped[7] == "g"
    named = {r["line"]: r["scope"] for r in line_ops.scope_labels(pts, s.where("not inline")).collect()}
    assert named == {1: "A", 2: "A.f()", 3: "A.f()", 5: None, 7: "g()"}


def test_placeholders(spark):
    df = spark.createDataFrame([("size {n} of {x}", "plain {x} {y}", {"n": "1", "x": "a"}), ("size {n}", "plain {x}", {"x": "a"}), (None, "{x}", {"x": "{n}"})],
                               "sized string, neutral string, facts map<string,string>")
    got = [r[0] for r in df.select(render_message(F.col("sized"), F.col("neutral"), F.col("facts"))).collect()]
    assert got == ["size 1 of a", "plain a", "{n}"]


def test_adjusted_severity_and_freshness(spark):
    found = spark.createDataFrame([("r", "a", 1, "c", "warning"), ("r", "a", 2, "c", "warning"), ("r", "a", 5, "c", "warning"), ("r", "b", 1, "c", "warning")],
                                  "run_id string, file string, line int, code string, severity string")
    lines = spark.createDataFrame([("r", "a", 1, 50, 0.5, 0.0, False), ("r", "b", 1, 50, 0.5, 0.0, False)], "run_id string, file string, line int, samples int, share double, memory_mb double, growing boolean")
    now = spark.createDataFrame([("r", "a", "h1"), ("r", "b", "h2"), ("r", "c", "h"), ("r", "d", None)], "run_id string, file string, sha1 string")
    then = spark.createDataFrame([("r", "a", "h1"), ("r", "b", "old"), ("r", "d", "h")], "run_id string, file string, sha1 string")
    fresh = findings.freshness(now, then, then)
    assert {r["file"]: r["freshness"] for r in fresh.collect()} == {"a": "fresh", "b": "stale", "c": "absent", "d": "unverified"}
    spans = spark.createDataFrame([("r", "a", 4, 6)], "run_id string, file string, first_line int, last_line int")
    got = {(r["file"], r["line"]): (r["measured"], r["adjusted"]) for r in findings.adjusted(found, lines, fresh, 0.05, 10.0, spans).collect()}
    assert got == {("a", 1): ("hot", "error"), ("a", 2): ("cold", "hint"), ("a", 5): ("unknown", "warning"), ("b", 1): ("source changed", "warning")}


def test_prefix_remap(spark):
    m = spark.createDataFrame([("/app", "/w"), ("/app/lib/", "/l")], "source string, target string")
    p = spark.createDataFrame([("/app/a.py",), ("/app/lib/x",), ("/application",), ("/app",)], "path string")
    assert {r["path"]: r["mapped"] for r in findings.remap_by_table(p, m).collect()} == {"/app/a.py": "/w/a.py", "/app/lib/x": "/l/x", "/application": "/application", "/app": "/w"}
    with pytest.raises(Exception, match="no mapping"):
        findings.remap_by_table(p, m, strict=True).collect()
