"""Catalogue: source rules, findings against measurements, paths, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrain.functions import measures as me, paths as pa, text as tx
from tracegrain.operators import checks, findings as ops, lines as line_ops, rules
from tracegrain.plans import adapters as ad
from tracegrain.plans.registry import query, table
from tracegrain.session import spread

_SNIPPETS = [
    (2, "def load(cur):\n    return cur.fetchall()\n"),
    (3, "def grow(rows):\n    s = ''\n    for r in rows:\n        s += r\n        copy.deepcopy(r)\n    return s\n"),
    (4, "frame = pd.read_csv('x', dtype={'a': object})\n"),
    (5, "def keep(xs):\n    items = [x for x in xs]\n    for i in items:\n        print(i)\n"),
    (7, "def read(p):\n    f = open(p)\n    return f.read()\n"),
    (9, "class Node:\n    def __init__(self, parent):\n        self.parent = parent\n\ndef tree(rows):\n    for r in rows:\n        Node(r)\n"),
    (11, "def broken(:\n"),
]


def sources(spark, folder):
    """One Python file per customer, put together from snippets by the divisors of its key."""
    k = F.col("c_custkey")
    parts = [F.when(k % n == 0, F.lit(code)) for n, code in _SNIPPETS]
    return spread(table(spark, folder, "customer").select("c_custkey")).select(
        F.concat(F.lit("c"), k.cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("import copy\nimport pandas as pd\n"), F.concat_ws("", *parts)).alias("text"))


_CODES = [(2, "heap-inflation", "warning", 1), (3, "text-inflation.concat", "warning", 1), (3, "memory-swell.deepcopy-loop", "warning", 1), (4, "pointer-chasing", "warning", 1),
          (5, "memory-swell.list-once", "information", 1), (7, "resource-leak.file-handle", "warning", 1), (9, "cyclic-reference", "information", 2), (9, "ram-fragmentation.no-slots", "information", 1)]


@query("rule_counts", " UNION ALL ".join(
    f"SELECT '{code}' AS code, '{sev}' AS severity, count(*) * {per} AS findings, count(*) AS files FROM customer WHERE c_custkey % {n} = 0 AND c_custkey % 11 <> 0" for n, code, sev, per in _CODES))
def rule_counts(spark, folder):
    return rules.rule_counts(rules.scan_rules(sources(spark, folder)))


@query("source_symbols", """WITH c AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) || '.py' AS path, c_custkey AS k, 2 + CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS b0 FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 3 = 0)
SELECT path, b0 + 1 AS line, 'grow()' AS scope, '' AS assigns, '' AS calls, b0 + 6 AS function_end FROM c
UNION ALL SELECT path, b0 + 2, 'grow()', 's', '', NULL FROM c UNION ALL SELECT path, b0 + 3, 'grow()', 'r', '', NULL FROM c UNION ALL SELECT path, b0 + 4, 'grow()', 's', '', NULL FROM c
UNION ALL SELECT path, b0 + 5, 'grow()', '', 'copy.deepcopy', NULL FROM c UNION ALL SELECT path, b0 + 6, 'grow()', '', '', NULL FROM c""")
def source_symbols(spark, folder):
    s = rules.symbols(sources(spark, folder)).where(F.col("scope") == "grow()")
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return s.select("path", "line", "scope", text("assigns"), text("calls"), "function_end")


# One snippet for each code, and how often it fires; a document's own lines follow as comments.
_CODE_SNIPPETS = [
    ("heap-inflation", 1, "def load(cur):\n    return cur.fetchall()\n"),
    ("pointer-chasing", 1, "frame = pd.read_csv('x', dtype={'a': object})\n"),
    ("gc-cycle-risk", 1, "class Node:\n    def __init__(self, parent):\n        self.parent = parent\n\n    def __del__(self):\n        print(self)\n"),
    ("ram-fragmentation.append", 1, "def rows(xs, out):\n    for x in xs:\n        out.append({'a': x})\n"),
    ("text-inflation.concat", 1, "def join(xs):\n    s = ''\n    for x in xs:\n        s += x\n    return s\n"),
    ("text-inflation.whole-file", 1, "def read(p):\n    with open(p) as h:\n        return h.readlines()\n"),
    ("memory-swell.list-arg", 1, "def total(xs):\n    return sum([x for x in xs])\n"),
    ("memory-swell.list-copy", 1, "def walk(xs):\n    for x in list(xs):\n        print(x)\n"),
    ("memory-swell.list-once", 1, "def keep(xs):\n    items = [x for x in xs]\n    for i in items:\n        print(i)\n"),
    ("memory-swell.deepcopy-loop", 1, "def clone(xs):\n    for x in xs:\n        copy.deepcopy(x)\n"),
    ("memory-swell.recompile-loop", 1, "def match(xs):\n    for x in xs:\n        re.compile('a+').match(x)\n"),
    ("memory-swell.setdefault-loop", 1, "def group(xs, out):\n    for x in xs:\n        out.setdefault(x, [])\n"),
    ("memory-swell.list-extend-loop", 1, "def more(xs, out):\n    for x in xs:\n        out.extend([y for y in x])\n"),
    ("memory-swell.concat-loop", 1, "def stack(xs, frame):\n    for x in xs:\n        frame = pd.concat([frame, x])\n    return frame\n"),
    ("memory-swell.unbounded-queue", 1, "work = queue.Queue()\n"),
    ("memory-swell.fork-start-method", 1, "mp.set_start_method('fork')\n"),
    ("memory-swell.method-cache", 1, "class Service:\n    @functools.lru_cache(maxsize=None)\n    def get(self, k):\n        return k\n"),
    ("memory-swell.unbounded-cache", 1, "@functools.cache\ndef cached(k):\n    return k\n"),
    ("task-retention.asyncio-task", 1, "async def main():\n    asyncio.create_task(main())\n"),
    ("frame-retention.stored-exception", 1, "def guard(log):\n    try:\n        print(1)\n    except ValueError as e:\n        log.append(e)\n"),
    ("resource-leak.file-handle", 1, "def peek(p):\n    f = open(p)\n    return f.read(1)\n"),
    ("single-thread-stall.async-blocking", 1, "async def wait():\n    time.sleep(1)\n"),
    ("single-thread-stall.list-membership", 1, "def seen_before(xs):\n    seen = []\n    for x in xs:\n        if x in seen:\n            print(x)\n        seen.append(x)\n"),
    ("single-thread-stall.cpu-thread", 1, "def cpu(xs):\n    for x in xs:\n        y = x * 2\n\nthreading.Thread(target=cpu)\n"),
    ("cyclic-reference", 2, "class Leaf:\n    __slots__ = ('parent',)\n\n    def __init__(self, parent):\n        self.parent = parent\n\ndef tree(xs):\n    for x in xs:\n        Leaf(x)\n"),
    ("ram-fragmentation.no-slots", 1, "class Point:\n    def __init__(self, x):\n        self.x = x\n\ndef points(xs):\n    for x in xs:\n        Point(x)\n"),
    ("broken", 0, "def broken(:\n"),
]
_IMPORTS = "import asyncio\nimport copy\nimport functools\nimport multiprocessing as mp\nimport queue\nimport re\nimport threading\nimport time\nimport pandas as pd\n\n"


def code_sources(spark, folder):
    """One Python file per document: a snippet by its id, then the document's text, line by line, as comments."""
    k = F.pmod("doc_id", F.lit(len(_CODE_SNIPPETS)))
    code = F.element_at(F.array(*[F.lit(c) for _, _, c in _CODE_SNIPPETS]), (k + 1).cast("int"))
    comments = F.concat(F.lit("# "), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n\f\x0b\x00]+", "\n# "), F.lit("\n"))
    return spread(table(spark, folder, "documents").select("doc_id", "text")).select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit(_IMPORTS), code, comments).alias("text"))


@query("rule_codes", " UNION ALL ".join(
    f"SELECT '{code}' AS code, count(*) * {n} AS findings, count(*) AS files FROM documents WHERE doc_id % {len(_CODE_SNIPPETS)} = {i} HAVING count(*) > 0" for i, (code, n, _) in enumerate(_CODE_SNIPPETS) if n))
def rule_codes(spark, folder):
    """Every rule code, over files that carry whole documents."""
    return rules.rule_counts(rules.scan_rules(code_sources(spark, folder))).select("code", "findings", "files")


_HEAT = ad.SQL_FINDINGS + """,
lines AS (SELECT 'src' || CAST(l_suppkey % 20 AS VARCHAR) AS file, l_partkey AS line, count(*) AS samples, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY ALL),
tot AS (SELECT sum(w) AS total FROM lines),
x AS (SELECT f.*, l.samples, l.w / CAST((SELECT total FROM tot) AS DOUBLE) AS share, CASE WHEN CAST(substr(f.file, 4) AS INTEGER) % 4 = 0 THEN 'stale' ELSE 'fresh' END AS freshness FROM findings f LEFT JOIN lines l ON l.file = f.file AND l.line = f.line),
h AS (SELECT *, CASE WHEN freshness = 'stale' THEN NULL WHEN samples IS NULL THEN 'cold' WHEN share >= 0.0007 THEN 'hot' ELSE 'unknown' END AS heat FROM x)"""


@query("findings_adjusted", f"""WITH {_HEAT} SELECT file, line, severity, coalesce(heat, 'source changed') AS measured,
CASE WHEN heat = 'hot' THEN CASE severity WHEN 'warning' THEN 'error' ELSE 'warning' END WHEN heat = 'cold' THEN 'hint' ELSE severity END AS adjusted FROM h""")
def findings_adjusted(spark, folder):
    l = table(spark, folder, "lineitem")
    sums = l.groupBy(F.lit("all").alias("run_id"), F.concat(F.lit("src"), (F.col("l_suppkey") % 20).cast("string")).alias("file"), F.col("l_partkey").alias("line")).agg(
        F.count(F.lit(1)).alias("samples"), F.sum(F.col("l_quantity").cast("long")).alias("w"))
    measured = line_ops.with_share(sums, "w").withColumns({"memory_mb": F.lit(0.0), "growing": F.lit(False)})
    found = ad.findings(spark, folder)
    number = F.substring("file", 4, 9).cast("int")
    fresh = found.select("run_id", "file").distinct().withColumn("freshness", F.when(number % 4 == 0, "stale").otherwise("fresh"))
    return ops.adjusted(found, measured, fresh, 0.0007, 1.0).select("file", "line", "severity", "measured", "adjusted")


@query("freshness", """SELECT d.source AS file, CAST(d.doc_id AS BIGINT) AS doc_id, CASE WHEN d.doc_id % 5 = 0 THEN 'absent' WHEN d.doc_id % 7 = 0 THEN 'unverified' WHEN d.doc_id % 3 = 0 THEN 'stale' ELSE 'fresh' END AS freshness FROM documents d""")
def freshness(spark, folder):
    d = table(spark, folder, "documents")
    key = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    sha = pa.text_hash(F.col("text"))
    base = d.select(F.lit("all").alias("run_id"), key.alias("file"), "doc_id", "source", sha.alias("sha1"))
    current = base.withColumn("sha1", F.when(F.col("doc_id") % 7 != 0, F.when((F.col("doc_id") % 3 == 0), F.sha1(F.col("sha1"))).otherwise(F.col("sha1"))))
    measured = base.where(F.col("doc_id") % 5 != 0)
    return ops.freshness(current, measured, measured).select(F.col("source").alias("file"), "doc_id", "freshness")


@query("text_hashes", "SELECT doc_id, sha1(replace(text, chr(13) || chr(10), chr(10))) AS sha1 FROM documents")
def text_hashes(spark, folder):
    return table(spark, folder, "documents").select("doc_id", pa.text_hash(F.col("text")).alias("sha1"))


@query("path_remap", """WITH h AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/]+)', 1) AS host FROM pages),
m AS (SELECT DISTINCT host AS source, '/mirror/' || regexp_replace(host, '^https?://', '') AS target FROM h WHERE host LIKE 'https:%'),
m2 AS (SELECT source, target FROM m UNION SELECT source || '/en', target || '/english' FROM m)
SELECT page_id, coalesce((SELECT arg_max(target || substr(url, length(source) + 1), length(source)) FROM m2 WHERE url = source OR starts_with(url, source || '/')), url) AS mapped FROM h""")
def path_remap(spark, folder):
    p = table(spark, folder, "pages").select("page_id", F.col("url").alias("path"))
    host = F.regexp_extract("path", "^(https?://[^/]+)", 1)
    hosts = p.select(host.alias("source")).distinct().where(F.col("source").startswith("https:"))
    m = hosts.select("source", F.concat(F.lit("/mirror/"), F.regexp_replace("source", "^https?://", "")).alias("target"))
    english = m.select(F.concat("source", F.lit("/en")).alias("source"), F.concat("target", F.lit("/english")).alias("target"))
    return ops.remap_by_table(p, m.unionByName(english)).select("page_id", "mapped")


@query("path_keys", """SELECT page_id, lower(url) AS lowered, CASE WHEN starts_with(url, 'https://m.') THEN substr(url, 11) ELSE url END AS relative,
CASE WHEN starts_with(url, 'http://') THEN substr(url, 8) ELSE url END AS keyed FROM pages""")
def path_keys(spark, folder):
    p, url = table(spark, folder, "pages"), F.col("url")
    cut = pa.rel_path(F.concat(F.lit("https://m"), F.regexp_replace(url, r"^https://m\.", "/")), F.lit("https://m"))
    relative = F.when(url.startswith("https://m."), cut).otherwise(url)
    return p.select("page_id", pa.norm_path(url, True).alias("lowered"), relative.alias("relative"), pa.file_key(url, F.lit("http://main.py")).alias("keyed"))


@query("origin", """SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'user' WHEN page_id % 6 = 1 THEN 'internal' WHEN page_id % 6 = 2 THEN 'library' WHEN page_id % 6 = 3 THEN 'stdlib' WHEN page_id % 6 = 4 THEN 'internal' ELSE 'library' END AS kind,
CASE WHEN page_id % 6 = 0 THEN 'main.py:' || CAST(page_id AS VARCHAR) WHEN page_id % 6 = 1 THEN 'Python script launcher' WHEN page_id % 6 = 2 THEN 'p' || CAST(page_id AS VARCHAR) || ' (installed package)'
  WHEN page_id % 6 = 3 THEN 'json (standard library)' WHEN page_id % 6 = 4 THEN 'generated code' ELSE 'x' || CAST(page_id AS VARCHAR) || '.py (outside your project)' END AS label FROM pages""")
def origin(spark, folder):
    i, k = F.col("page_id"), F.col("page_id") % 6
    text = i.cast("string")
    file = (F.when(k == 0, "/app/main.py").when(k == 1, "<frozen runpy>").when(k == 2, F.concat(F.lit("/v/lib/site-packages/p"), text, F.lit("/core.py")))
            .when(k == 3, "/usr/lib/python3.12/json/decoder.py").when(k == 4, F.concat(F.lit("<attrs "), text, F.lit(">"))).otherwise(F.concat(F.lit("/opt/x"), text, F.lit(".py"))))
    o = table(spark, folder, "pages").select("page_id", pa.frame_origin(file, k == 0, i).alias("o"))
    return o.select("page_id", "o.kind", "o.label")


@query("enclosing_names", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Service.handle' WHEN 1 THEN '<module>' WHEN 2 THEN c_mktsegment ELSE c_mktsegment || '.run' END AS name FROM customer""")
def enclosing_names(spark, folder):
    k, seg = F.col("c_custkey") % 4, F.col("c_mktsegment")
    q = F.when(k == 0, "Service.handle.<lambda>").when(k == 1, "<genexpr>").when(k == 2, F.concat(seg, F.lit(".<listcomp>.<lambda>"))).otherwise(F.concat(seg, F.lit(".run")))
    return table(spark, folder, "customer").select("c_custkey", pa.enclosing_name(q).alias("name"))


@query("line_labels", """SELECT event_id, '⏱ ' || CASE WHEN value >= 10 THEN printf('%.1f s', CASE WHEN value * 4 % 2 = 1 THEN value + 0.01 ELSE value END) ELSE printf('%.2f s', value) END || ' ' || CASE WHEN k >= 10 THEN printf('%.0f%%', k * 1.0) ELSE printf('%.1f%%', k * 1.0) END AS label
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)""")
def line_labels(spark, folder):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    none = F.lit(None)
    label = tx.line_label(F.col("value"), k / 100, F.lit(""), F.lit(False), none.cast("double"), none.cast("array<string>"), F.lit(False), none.cast("double"), none.cast("array<string>"))
    return table(spark, folder, "events").select("event_id", label.alias("label"))


@query("messages", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'size ' || CAST(n_chars AS VARCHAR) || ' of ' || source ELSE 'about ' || source END AS message FROM documents""")
def messages(spark, folder):
    d = table(spark, folder, "documents")
    facts = F.map_filter(F.create_map(F.lit("source"), F.col("source"), F.lit("n"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("string"))), lambda _, v: v.isNotNull())
    return d.select("doc_id", tx.render_message(F.lit("size {n} of {source}"), F.lit("about {source}"), facts).alias("message"))


@query("native_residuals", """SELECT o_orderkey, CASE WHEN r > 2 * b THEN r END AS residual FROM (SELECT o_orderkey, o_custkey % 50 AS b, CAST(floor(o_totalprice / 100) AS BIGINT) - o_custkey % 1000 - o_custkey % 50 AS r FROM orders)""")
def native_residuals(spark, folder):
    o = table(spark, folder, "orders")
    c = F.col("o_custkey")
    return o.select("o_orderkey", me.native_estimate(F.floor(F.col("o_totalprice") / 100).cast("long"), F.lit(None).cast("long"), c % 1000, c % 50).alias("residual"))


@query("overhead_report", """WITH r AS (SELECT o_custkey % 20 AS size, CASE o_orderstatus WHEN 'F' THEN 'baseline' WHEN 'O' THEN 'fast' ELSE 'precise' END AS mode, o_totalprice AS wall, o_custkey AS rss FROM orders),
m AS (SELECT size, mode, median(wall) AS wall, median(rss) AS rss FROM r GROUP BY ALL), b AS (SELECT size, wall AS bw, rss AS br FROM m WHERE mode = 'baseline')
SELECT size, mode, round(wall, 6) AS median_wall_s, round(wall / bw, 6) AS wall_ratio, round(rss, 6) AS median_peak_rss_bytes,
CASE WHEN mode = 'baseline' THEN NULL ELSE round(br + greatest(20, 0.05 * br), 6) END AS rss_budget_bytes,
CASE WHEN mode = 'baseline' OR (wall / bw <= 1.01 AND rss <= br + greatest(20, 0.05 * br)) THEN 'pass' ELSE 'fail' END AS status FROM m JOIN b USING (size)""")
def overhead_report(spark, folder):
    o = table(spark, folder, "orders")
    s = F.col("o_orderstatus")
    size = F.col("o_custkey") % 20
    runs = o.select(size.alias("size"), F.when(s == "F", "baseline").when(s == "O", "fast").otherwise("precise").alias("mode"), F.lit(0).alias("exit_code"),
                    F.col("o_totalprice").alias("wall_s"), F.col("o_custkey").alias("peak_rss_bytes"), size.alias("records"), size.alias("checksum"))
    # Two budgeted modes, one row each.
    limits = runs.where("mode <> 'baseline'").select("mode").distinct().select("mode", F.lit(1.01).alias("wall_ratio_max"), F.lit(20.0).alias("rss_floor_bytes"), F.lit(0.05).alias("rss_ratio"))
    r = checks.overhead_report(runs, limits)
    return r.select("size", "mode", F.round("median_wall_s", 6).alias("median_wall_s"), F.round("wall_ratio", 6).alias("wall_ratio"), F.round("median_peak_rss_bytes", 6).alias("median_peak_rss_bytes"),
                    F.round("rss_budget_bytes", 6).alias("rss_budget_bytes"), "status")


@query("criteria", """WITH c AS (SELECT doc_id, source, CASE WHEN doc_id % 97 = 0 THEN 'failed' WHEN doc_id % 7 = 0 THEN 'skipped' ELSE 'passed' END AS status FROM documents),
s AS (SELECT 'src' || CAST(i AS VARCHAR) AS criterion, i % 2 = 0 AS limited FROM range(20) t(i)),
n AS (SELECT s.criterion, any_value(limited) AS limited, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS incomplete
  FROM s JOIN c ON c.source = s.criterion GROUP BY s.criterion)
SELECT criterion, limited, passed, failed, incomplete, CASE WHEN failed > 0 THEN 'fail' WHEN incomplete > 0 THEN CASE WHEN passed > 0 THEN 'partial' ELSE 'unsupported' END WHEN limited THEN 'partial' ELSE 'pass' END AS status FROM n""")
def criteria(spark, folder):
    d = table(spark, folder, "documents")
    i = F.col("doc_id")
    cases = d.select(F.concat_ws(":", "source", i.cast("string")).alias("id"), F.when(i % 97 == 0, "failed").when(i % 7 == 0, "skipped").otherwise("passed").alias("status"))
    names = [f"src{i}" for i in range(20)]
    return checks.criteria(cases, {n: [n + ":"] for n in names}, names[::2])


@query("finding_difference", """WITH e AS (SELECT d.source AS file, d.doc_id AS line, CASE WHEN l.quality = 1 THEN 'warning' ELSE 'information' END AS severity FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
a AS (SELECT file, line, CASE WHEN line % 50 = 0 THEN 'hint' ELSE severity END AS severity FROM e WHERE line % 30 <> 0)
SELECT *, 'missing' AS problem FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM a) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM e)""")
def finding_difference(spark, folder):
    expected = ad.findings(spark, folder).select("file", "line", "severity")
    actual = expected.where(F.col("line") % 30 != 0).withColumn("severity", F.when(F.col("line") % 50 == 0, "hint").otherwise(F.col("severity")))
    return ops.difference(expected, actual)
