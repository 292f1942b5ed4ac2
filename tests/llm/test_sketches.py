"""Fast similarity sketches and the near duplicates they find, against all pairs of sets."""

import re
from collections import defaultdict

import numpy as np
import pytest

from tracegrain.llm import sketches
from tracegrain.llm.words import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    ws = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]
    return {" ".join(ws[i : i + size]) for i in range(len(ws) - size + 1)} if len(ws) >= size else {" ".join(ws)} if ws else set()


def expected(rows, percent=85):
    sets = [shingles(r[1]) for r in rows]
    by_set, at = defaultdict(list), {}
    for k, (r, s) in enumerate(zip(rows, sets)):
        if r[0] is not None and s:
            by_set[frozenset(s)].append(k)
    keys = list(by_set)
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if 100 * len(a & b) >= percent * len(a | b):
                up[find(a)] = find(b)
    least = {}
    for k in keys:
        least[find(k)] = min(least.get(find(k), 1 << 60), *(rows[j][0] for j in by_set[k]))
    for r, s in zip(rows, sets):
        at.setdefault((r[0], len(s)), []).append(least[find(frozenset(s))] if r[0] is not None and s else r[0])
    return {k: sorted(v, key=str) for k, v in at.items()}


def found(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id, r.n_shingles].append(r.component_id)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_every_coordinate_is_filled():
    rng = np.random.default_rng(1)
    sizes = [1, 2, 5, 30, 500, 0, 3000]
    row = np.repeat(np.arange(len(sizes)), sizes)
    s = sketches.sketch_sets(row, mix(rng.integers(0, 1 << 62, len(row)).astype(np.uint64)), len(sizes))
    assert ((s != sketches._EMPTY).all(1) == np.array([n > 0 for n in sizes])).all()


@pytest.mark.parametrize("n", [3, 40, 900])
def test_agreement_estimates_similarity(n):
    """The mean over many pairs is the similarity, and no worse spread than independent draws."""
    rng = np.random.default_rng(n)
    share, rates = 2, []
    for _ in range(150):
        common, a, b = (mix(rng.integers(0, 1 << 62, k).astype(np.uint64)) for k in (share * n, n, n))
        hashes = np.concatenate([common, a, common, b])
        s = sketches.sketch_sets(np.repeat([0, 1], (share + 1) * n), hashes, 2)
        rates.append((s[0] == s[1]).mean())
    assert abs(np.mean(rates) - 0.5) < 0.02 and np.var(rates) < 1.3 * 0.25 / sketches.COORDINATES


def test_tail_bound():
    k = sketches.least_common(96, 85, 1e-9)
    rng = np.random.default_rng(0)
    assert 50 < k < 65 and (rng.binomial(96, 0.85, 1_000_000) >= k).all()


def test_near_duplicates(docs, corpus):
    assert found(sketches.near_duplicates(docs)) == expected(corpus)


@pytest.mark.parametrize("hot,block", [(3, 512), (4096, 4), (8, 1)])
def test_hot_buckets_and_large_clusters(docs, corpus, monkeypatch, hot, block):
    """Buckets split by second keys, cells of pairs of blocks, clusters confirmed bucket by bucket: the same components."""
    monkeypatch.setattr(sketches, "HOT", hot)
    monkeypatch.setattr(sketches, "BLOCK", block)
    assert found(sketches.near_duplicates(docs)) == expected(corpus)


def test_empty_table(empty):
    assert sketches.near_duplicates(empty).collect() == []
