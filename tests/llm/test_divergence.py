"""The source audit against exact arithmetic on whole counts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracegrain.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, shard int, term string, n long, p long"


def folded(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def corpus(seed=3, n=160):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcXYZéßñ日", k=rng.randint(1, 5))) for _ in range(120)]
    rows = []
    for i in range(n):
        ws = rng.choices(vocabulary[: 40 + 20 * (i % 5)], k=rng.randint(0, 60))
        rows.append((i % 150 if i % 11 else None, rng.choice([" ", "\n", "-", "_9 "]).join(ws), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "é"])))
    rows += [(900, None, "en", "silent"), (901, "", "xx", "only"), (902, "12 --- 34", "xx", "other"), (903, "word " * 20_000, "en", "a"), (904, "é" * 5000, "en", "b")]
    return [r + (1, "clash", 2, 3) for r in rows]


def expected(rows, least, top=10):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        text, lang, source = (x or "" for x in r[1:4])
        groups.add((lang, source))
        terms = TERM.findall(folded(text))
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, d in docs[lang].items() if d >= least)
        mine = sorted(s for l, s in groups if l == lang)
        total = {s: sum(n[lang, s][t] for t in kept) for s in mine}
        whole = {t: sum(n[lang, s][t] for s in mine) for t in kept}
        share = lambda c, t: 1 + 10**9 * (c + 2) // (t + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in mine:
            pairs = [(-sum(f(share(n[lang, s][t], total[s]), share(n[lang, o][t], total[o])) for t in kept), o) for o in mine if o != s]
            terms = []
            for t in kept:
                p, q = share(n[lang, s][t], total[s]), share(whole[t], sum(whole.values()))
                if n[lang, s][t] and p > q:
                    terms.append((-f(p, q), t))
            for part, items in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(items)]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 4, 10_000])
def test_audit_is_exact(spark, least):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in divergence.audit(df, least_docs=least).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == expected(rows, least)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert divergence.audit(df).collect() == []


def test_many_small_runs_merge_in_term_order(monkeypatch):
    """Runs of a few postings, chunks of two rows and an early flush give the counts of one pass."""
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(divergence, "CHUNK_ROWS", 2)
    monkeypatch.setattr(divergence, "OPEN_ROWS", 7)
    rows = [r for r in corpus(9, 60) if len(r[1] or "") < 2000]
    batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows[k : k + 7]], pa.string()) for i in (1, 2, 3)], ["text", "lang", "source"]) for k in range(0, len(rows), 7)]
    spilled = [r for b in divergence._index(iter(batches), 3) for r in b.to_pylist()]
    assert len({r["run"] for r in spilled}) > 5
    spilled.sort(key=lambda r: (r["shard"], r["run"], r["chunk"]))
    merged = divergence._merge(iter(pa.RecordBatch.from_pylist(spilled[k : k + 4]) for k in range(0, len(spilled), 4)), 1)
    got = [(r["lang"], r["term"], r["source"], r["n"]) for b in merged for r in b.to_pylist()]
    want = Counter((r[2] or "", t, r[3] or "") for r in rows for t in TERM.findall(folded(r[1] or "")))
    assert len(got) == len(want) and {g[:3]: g[3] for g in got} == dict(want)


def test_pairs_of_a_frequent_term_are_cut_up(monkeypatch):
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", 5)
    rng = np.random.default_rng(2)
    rows = [("l", t, f"s{s:02d}", int(rng.integers(5, 90)), 5) for t in "xyz" for s in range(12)]
    t = pa.table([pa.array(c) for c in zip(*rows)], names=["lang", "term", "source", "p", "zero"])
    got = Counter()
    for out in divergence._pair_sums(t):
        for k, v in out:
            got[k] += v
    f = lambda p, q: (p - q) ** 2 // (p + q)
    want = Counter()
    for term in "xyz":
        mine = [r for r in rows if r[1] == term]
        for i, a in enumerate(mine):
            for b in mine[i + 1 :]:
                want["l", a[2], b[2]] += f(a[3], b[3]) - f(a[3], b[4]) - f(a[4], b[3]) + f(a[4], b[4])
    assert got == want


def test_share_is_exact_beyond_64_bits(spark):
    counts = [(0, 1, 1), (7, 10**12, 10**8), (8 * 10**17, 8 * 10**17 + 5, 3), (2, 0, 0)]
    df = spark.createDataFrame(counts, "c long, n long, v long")
    got = [r.s for r in df.select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("s")).collect()]
    assert got == [1 + 10**9 * (c + 2) // max(n + 2 * v, 1) for c, n, v in counts]
