"""The operators on documents, against plain code."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrain.llm import binpack, components, lines, ngram_join, pieces, quality, sharding, sketch, substrings, token_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def roots(nodes, edges):
    """The least node reachable from each."""
    at = {n: n for n in nodes}

    def find(n):
        while at[n] != n:
            n = at[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        at[b] = a
    return {n: find(n) for n in nodes}


# Quality rules


def test_quality(docs, corpus):
    got = Counter((r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality.judge(docs).collect())
    def failed(t):
        ws = words(t)
        windows = [tuple(ws[k : k + 8]) for k in range(len(ws) - 7)]
        seen = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if seen[x] > 1 for j in range(8)}
        return len(ws) < 20 or 100 * len(covered) > 30 * len(ws)
    bad_hosts = {r.host for r in quality.judge(docs).where("host_failed").select("host").distinct().collect()}
    assert got == Counter((i, len(words(t)), failed(t), not failed(t) and s not in bad_hosts) for i, t, s in corpus)


def test_quality_keep_agrees_with_judge(docs):
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in quality.judge(docs).where("kept").collect())


def test_hosts_are_shrunk_by_size(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good if i % 20 else "bad", f"h{i % 50}") for i in range(1500)] + [(2000 + i, "bad", "small") for i in range(2)] + [(3000 + i, "bad", "large") for i in range(300)]
    verdicts = {r.host: r for r in quality.host_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string").select("source", quality.text_measures("text").alias("m")), "source", "m").collect()}
    assert verdicts["large"].host_failed and verdicts["small"].short_rate < verdicts["large"].short_rate
    assert not any(v.host_failed for h, v in verdicts.items() if h.startswith("h"))


def test_beta_prior_by_hand():
    assert quality.beta_prior(0, 0, 0.0, 0, 0.0) == (0.0, 1.0)
    mean, strength = quality.beta_prior(2, 20, 200.0, 10, 10.0)  # one host all bad, one all good
    assert mean == 0.5 and strength == pytest.approx(1.0)
    assert quality.beta_prior(2, 20, 200.0, 10, 5.0)[1] == pytest.approx(1e6, rel=1e-3)  # equal rates: as strong as allowed


# Substring dedup


def cut(rows, size):
    first = {}
    for i, t, _ in rows:
        ws = words(t)
        for k in range(len(ws) - size + 1):
            if i is not None:
                x = tuple(ws[k : k + size])
                first[x] = min(first.get(x, i), i)
    out = []
    for i, t, _ in rows:
        ws = words(t)
        gone = {k + j for k in range(len(ws) - size + 1) for j in range(size) if i is not None and first[tuple(ws[k : k + size])] < i}
        out.append((i, len(ws), len(gone), [w for k, w in enumerate(ws) if k not in gone]))
    return out


@pytest.mark.parametrize("size", [50, 5])
def test_substrings(docs, corpus, size):
    got = Counter(tuple(r) for r in substrings.digest(docs, size=size).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == Counter((i, n, gone, sha(" ".join(kept))) for i, n, gone, kept in cut(corpus, size))


def test_substring_removal_keeps_other_texts(docs, corpus):
    left = substrings.remove(docs)
    assert left.columns == docs.columns
    got = Counter((r.doc_id, " ".join(words(r.text))) for r in left.collect())
    assert got == Counter((i, " ".join(kept)) for i, _, _, kept in cut(corpus, 50))
    whole = {i for i, _, gone, _ in cut(corpus, 50) if not gone}
    texts = {(i, t) for i, t, _ in corpus}
    assert all((r.doc_id, r.text) in texts for r in left.collect() if r.doc_id in whole)


def test_sketch_never_counts_too_low(spark):
    rng = np.random.default_rng(3)
    keys = np.concatenate([rng.integers(0, 1 << 62, 4000, dtype=np.int64), np.repeat(rng.integers(0, 1 << 62, 300, dtype=np.int64), 2)])
    df = spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(5)
    f = sketch.key_filter(df, lambda b: iter([b.column(0).to_numpy().view(np.uint64)]), 2)
    found, counts = np.unique(keys, return_counts=True)
    mask = f.mask(found.view(np.uint64))
    assert mask[counts > 1].all() and mask[counts == 1].mean() < 0.1


# N-gram Jaccard join


def shingles(t, size):
    ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)]
    return {tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)} or ({tuple(ws)} if ws else set())


def join(rows, size, percent):
    sets = [(n, i, shingles(t, size)) for n, (i, t, _) in enumerate(rows)]
    edges = [(a, b) for a, i, x in sets for b, j, y in sets if a < b and x and y and i is not None and j is not None and 100 * len(x & y) >= percent * len(x | y)]
    root = roots(range(len(rows)), edges)
    least = defaultdict(list)
    for n, i, _ in sets:
        least[root[n]].append(i)
    return Counter((i, len(x), None if i is None else min(v for v in least[root[n]])) for n, i, x in sets)


@pytest.mark.parametrize("size,percent", [(4, 85), (2, 50)])
def test_ngram_join(docs, corpus, size, percent):
    assert Counter(tuple(r) for r in ngram_join.component_table(docs, size, percent).collect()) == join(corpus, size, percent)


def test_one_document_of_each_group_stays(docs, corpus):
    kept = ngram_join.keep_first(docs, 5, 80)
    assert kept.columns == docs.columns
    want = {i for i, _, c in join(corpus, 5, 80) if i == c and i is not None}
    got = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert Counter(got) == Counter(want)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (500, 501), (502, 501)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == roots(nodes, [e for e in edges if e[0] != e[1]])


def test_few_edges_need_no_rounds(spark, monkeypatch):
    """A chain dealt over many tasks is folded by one; where more edges are left than that, rounds give the same."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50 + i, 100) for i in range(9)], "a long, b long").repartition(7)
    want = {i: 0 for i in range(41)} | {i: 50 for i in [*range(50, 59), 100]}
    rounds, large = [], components._large
    monkeypatch.setattr(components, "_large", lambda e: rounds.append(1) or large(e))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the tasks stay as many as they are
    try:
        assert {r.node: r.component for r in components.components(edges).collect()} == want and not rounds
        monkeypatch.setattr(components, "FOLD_EDGES", 5)
        assert {r.node: r.component for r in components.components(edges).collect()} == want and rounds
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# Line dedup


def norm(line):
    return " ".join(re.findall(r"[^\x00-\x00\x20\x09-\x0D!-/:-@\[-`{-~]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = ("".join(rng.choice(list("abcé"), rng.integers(0, 12))) for _ in range(2))
        d = brute_distance(a, b)
        assert lines.edit_distance(a, b, 20) == d and lines.edit_distance(a, b, 2) == min(d, 3)


def line_words(text):
    import pyarrow as pa

    from tracegrain.llm.words import PUNCTUATION, column_words

    (w,) = column_words(pa.array([text]), fold=True, breaks=PUNCTUATION)
    return w


def test_blocks_are_the_least_runs():
    rng = np.random.default_rng(2)
    ws = [f"w{k}" for k in range(30)]
    for n in (5, 7, 10, 11, 40):
        w = line_words("\n".join(" ".join(rng.choice(ws, n)) for _ in range(5)))
        _, _, first, last = lines.line_spans(w, 5)
        got = lines.blocks(w, first, last)
        for f, e, found in zip(first, last, got):
            runs = {int(h) for size in ((2, 3) if n <= 10 else (3,)) for h in w.span_hashes(np.arange(f, e - size + 1), np.arange(f, e - size + 1) + size)}
            assert [int(x) for x in found] == (sorted(runs) + [2**64 - 1] * 5)[:5]


def test_buckets_meet_in_any_batches():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    sizes = [1, 2, 1, 3, 700, 1, 1300, 2, 1]
    keys = np.repeat(np.arange(len(sizes)) * 5 - 20, sizes)
    bits = np.where(rng.random(len(keys)) < 0.5, 7, -8) ^ (1 << rng.integers(0, 60, len(keys)))
    for step in (1, 300, 512, 513, 5000):
        parts = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + step]), pa.array(np.arange(len(keys))[i : i + step]), pa.array(bits[i : i + step]), pa.array(np.full(len(keys), 50)[i : i + step])], ["key", "line", "simhash", "size"]) for i in range(0, len(keys), step)]
        rows = [tuple(r.values()) for b in lines._meet(iter(parts), 64, 0.8) for r in b.to_pylist()]
        many = [i for i in range(len(keys)) if sizes[(keys[i] + 20) // 5] > 1]
        assert [(k, n, s) for k, n, s, _, other in rows if other is None] == [(keys[i], i, bits[i]) for i in many]
        root = roots(range(len(keys)), [(a, b) for _, a, _, _, b in rows if b is not None])
        assert len(set(root.values())) == len(sizes) and all((root[i] == root[i - 1]) == (keys[i] == keys[i - 1]) for i in range(1, len(keys)))


def within(a, b, bound):
    """Edit distance within that share of the longer one; test_edit_distance holds the distance against the plain table."""
    limit = int(bound * max(len(a), len(b)) + 1e-9)
    return lines.edit_distance(a, b, limit) <= limit


def kept_by_edit_similarity(found, bound):
    """The occurrences that stay, where found has those of each normalised line: all pairs by edit similarity alone."""
    names = sorted(found)
    edges = [(a, b) for a in names for b in names if a < b and within(a, b, bound)]
    assert edges
    root, kept = roots(names, edges), defaultdict(list)
    for x in names:
        kept[root[x]] += found[x]
    return {min(v) for v in kept.values()}


def test_lines(docs, corpus):
    found = defaultdict(set)  # normalised line -> occurrences, in the document as the operator sees it
    for i, t, _ in corpus:
        for n, line in enumerate((t or "").split("\n")):
            if i is not None and len(norm(line).split()) >= 5:
                found[norm(line)].add((i, n))
    keep = kept_by_edit_similarity(found, 0.2)
    want = Counter()
    for i, t, _ in corpus:
        ls = (t or "").split("\n")
        taking = [n for n, x in enumerate(ls) if len(norm(x).split()) >= 5]
        gone = {n for n in taking if i is not None and (i, n) not in keep}
        want[i, len(taking), len(gone), sha("\n".join(x for n, x in enumerate(ls) if n not in gone))] += 1
    assert Counter(tuple(r) for r in lines.digest(docs).collect()) == want


def test_edited_lines_are_found(spark):
    """Lines of 5 to 60 words with a fifth of their words, or less, replaced: at least 0.95 of those of edit similarity 0.8 or more go."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    rows, similar = [], set()
    for i in range(0, 1200, 2):
        ws = rng.choices(vocabulary, k=rng.randint(5, 60))
        new = list(ws)
        for k in rng.sample(range(len(ws)), rng.randint(1, max(1, len(ws) // 5))):
            new[k] = rng.choice(vocabulary)
        a, b = " ".join(ws), " ".join(new)
        rows += [(i, a), (i + 1, b)]
        if a != b and within(a, b, 0.2):
            similar.add(i + 1)
    got = {r.doc_id for r in lines.digest(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()}
    assert got <= similar and len(got) >= 0.95 * len(similar) and len(similar) > 300


def lines_edited_everywhere(rng):
    """Pairs of lines that share hardly a word: an edit every fifth letter, or so many letters put before as are taken off at the end."""
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(3, 9))) for _ in range(60)]
    texts = []
    for k in range(60):
        a = " ".join(rng.choices(vocabulary, k=rng.randint(5, 90)))
        limit, b = int((1 - 0.8) * len(a) + 1e-9), list(a)
        if k % 3 == 0:
            for at in range(0, 5 * limit, 5):
                if b[at] != " ":
                    b[at] = "x"
        elif k % 3 == 1:
            b = ["y"] * (limit // 2) + b[: len(b) - limit // 2]
        else:
            for _ in range(limit):
                at = rng.randrange(1, len(b))
                b[at : at + 1] = rng.choice([[], ["z"], [b[at], "z"]])
        texts += [a, norm("".join(b))]
    return [t for t in texts if len(t.split()) >= 5]


def test_lines_with_an_edit_in_every_word(spark):
    rows = list(enumerate(lines_edited_everywhere(random.Random(9))))
    found = defaultdict(set)
    for i, t in rows:
        found[t].add((i, 0))
    keep = kept_by_edit_similarity(found, 0.2)
    assert len(keep) < 0.7 * len(rows)
    got = {r.doc_id for r in lines.digest(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed = 0").collect()}
    assert got == {i for i, _ in keep}


def test_packs_link_what_is_similar():
    """Any cut into packs links the groups that all pairs link, and nothing of one group."""
    rng = random.Random(10)
    texts = sorted({t for _ in range(3) for t in lines_edited_everywhere(rng)}, key=lambda t: (len(t), t))
    want = roots(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if within(texts[a], texts[b], 0.2)])

    def pack(members):
        names = np.array(members, np.int64)
        return lines._Pack(names.tobytes(), (names + 7).tobytes(), "\n".join(texts[i] for i in members))

    for size in (len(texts), 50):
        packs, edges = [pack(range(at, min(at + size, len(texts)))) for at in range(0, len(texts), size)], []
        for k, x in enumerate(packs):
            for y in packs[k:]:
                edges += lines._links(x, y, 0.8, x is y)
        assert all(within(texts[a], texts[b], 0.2) for a, b in edges)
        got = roots(range(len(texts)), edges)
        assert len(set(want.values())) == len(set(got.values())) < len(texts) and len({(want[i], got[i]) for i in want}) == len(set(want.values()))
    one = lines._Pack(np.arange(2).tobytes(), np.zeros(2, np.int64).tobytes(), "a line of five words\na line of five wordy")
    assert lines._links(one, one, 0.8, True) == []


def test_pieces_rule_out_long_lines():
    """Hardly a pair of unlike lines is left to be searched, at any length, though all are of one small vocabulary; no similar pair is ruled out."""
    rng = random.Random(11)
    parts = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 4))) for _ in range(60)]
    for size in (45, 130, 400, 900):
        texts = []
        while len(texts) < 80:
            text = " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(size))[:size - len(texts) % 7].strip()
            at = rng.randrange(len(text))
            texts += [text, text[:at] + "x" * rng.randint(1, size // 6) + text[at:]]
        texts = sorted(texts, key=len)
        packs = [lines._Pack(np.array(r, np.int64).tobytes(), np.array(r, np.int64).tobytes(), "\n".join(texts[i] for i in r)) for r in (range(40), range(40, 80))]
        found = set()
        for k, x in enumerate(packs):
            for y in packs[k:]:
                i, j = lines._by_pieces(x, y, 0.8)
                found |= {(a, b) for a, b in zip(x.names[i].tolist(), y.names[j].tolist()) if a < b}
        similar = {(a, b) for b in range(80) for a in range(b) if within(texts[a], texts[b], 0.2)}
        assert similar <= found and len(similar) >= 40 and len(found - similar) < 0.1 * 80 * 79 / 2, (size, len(similar), len(found - similar))


def test_packs_are_bounded():
    import pyarrow as pa

    sizes = sorted([10] * 5000 + list(range(10, 400)) + [lines.PACK_LETTERS + 1] * 2)
    rows = pa.RecordBatch.from_arrays([pa.array(sizes), pa.array(range(len(sizes))), pa.array(range(len(sizes))), pa.array(["x" * n for n in sizes])], ["size", "line", "group", "text"])
    packs = [r for at in range(0, len(sizes), 700) for r in lines._packs(iter([rows.slice(at, 700)]))] + list(lines._packs(iter([rows.slice(at, 700) for at in range(0, len(sizes), 700)])))
    bodies = [p.column(5)[0].as_py().split("\n") for p in packs]
    assert sum(map(len, bodies)) == 2 * len(sizes) and max(map(len, bodies)) == lines.PACK_LINES
    assert all(len(b) == 1 or len(b[-1]) <= lines.PACK_RATIO * len(b[0]) and sum(map(len, b)) <= lines.PACK_LETTERS for b in bodies)


def test_short_lines_occur_once(spark, tmp_path):
    from tracegrain.llm import queries

    rows = [(1, "Read more\nfirst text of its own here\n--\nread, MORE"), (2, "x\n\nread more\nsecond body that is quite unlike it"), (3, "X!\n--"), (4, None), (None, "read more")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: (3, 1, sha("Read more\nfirst text of its own here\n--")), 2: (3, 1, sha("x\n\nsecond body that is quite unlike it")),
                   3: (1, 1, sha("--")), 4: (0, 0, sha("")), None: (1, 0, sha("read more"))}


def test_one_id_on_two_texts(spark):
    same, other, own = "one line that two documents have", "a second one for the later text", "this stands nowhere else at all today"
    rows = [(1, same), (2, f"{same}\n{other}"), (2, f"{own}\n{same}"), (3, f"{other}\n{own}")]
    got = Counter((r.doc_id, r.text) for r in lines.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(1, same): 1, (2, other): 1, (2, own): 1, (3, ""): 1})


# Packing


def test_bins(docs, corpus):
    got = binpack.pack(docs, F.xxhash64("text"), capacity=300, group_docs=40).collect()
    n = Counter((r.doc_id, r.bin is None) for r in got)
    assert sum(r.n_words for r in got) == sum(len(words(t)) for _, t, _ in corpus) and n[200, True] == 1
    bins = defaultdict(list)
    for r in got:
        if r.bin:
            bins[r.bin].append(r)
    for rows in bins.values():
        assert sum(r.n_words for r in rows) <= 300 and sorted(r.position for r in rows) == list(range(len(rows)))
        sources = [r.source for r in rows if r.source is not None]
        assert len(sources) == len(set(sources)) and len({r.cluster for r in rows}) == len(rows)


def near_apart(rows):
    """Pairs of rows (text, bin) that are near duplicates and share a bin."""
    sets = [(shingles(t, 5), b) for t, b in rows if b is not None]
    return [(x, y) for k, (x, a) in enumerate(sets) for y, b in sets[:k] if a == b and 100 * len(x & y) >= 80 * len(x | y)]


def test_near_copies_do_not_share_a_bin(spark, tmp_path):
    from tracegrain.llm import queries

    base = [f"w{i}" for i in range(120)]
    rows = [(None if i == 3 else i // 2, " ".join(base[:k] + ["other"] * (i > 0) + base[k + 1 :]), f"s{i}") for i, k in enumerate((0, 0, 119, 118, 1, 117))]
    rows += [(100 + i, " ".join(f"x{i}_{j}" for j in range(200)), f"t{i}") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    by_source = {s: t for _, t, s in rows}
    got = queries.QUERIES["op3_conflict_packing"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and len({r.cluster for r in got}) == 7
    assert not near_apart([(by_source[r.source], r.bin) for r in got])


def test_best_fit_takes_the_tightest_compatible_bin():
    packed = {i: b for i, _, _, b, _ in binpack.pack_group([(0, 70, "a", 1), (1, 60, "b", 2), (2, 30, "a", 3), (3, 30, "c", 3), (4, 25, "d", 4)], 100)}
    # The first 30 cannot join source a; the second cannot join cluster 3, and fits the bin of 70 exactly.
    assert packed == {0: 0, 1: 1, 2: 1, 3: 0, 4: 2}


def brute_best_fit(rows, capacity):
    bins, out = [], {}
    pieces_ = sorted((-min(capacity, s - a), t, k, i) for i, (t, s, _, _) in enumerate(rows) for k, a in enumerate(range(0, s, capacity)))
    for neg, _, k, i in pieces_:
        ok = [(b[0], n) for n, b in enumerate(bins) if b[0] >= -neg and rows[i][2] not in b[1] and rows[i][3] not in b[2]]
        n = min(ok)[1] if ok else len(bins)
        if not ok:
            bins.append([capacity, set(), set()])
        bins[n][0] += neg
        bins[n][1].add(rows[i][2])
        bins[n][2].add(rows[i][3])
        out[i, k] = n
    return out


def test_best_fit_against_a_scan_of_all_bins():
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(1, 140)), int(rng.integers(0, 6)), int(rng.integers(0, 60))) for i in range(300)]
    assert {(i, k): b for i, k, _, b, _ in binpack.pack_group(rows, 100)} == brute_best_fit(rows, 100)


# Token rows


def test_token_rows_round_trip(docs, corpus):
    rows = token_rows.pack(docs, capacity=128, group_tokens=3000)
    got = rows.collect()
    seen = Counter()
    for r in got:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(positions) == 128 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == token_rows.PAD).all()
        for a, z in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:z].tolist() == list(range(z - a))
        assert positions[r.n_tokens :].tolist() == list(range(128 - r.n_tokens))
        seen.update(r.doc_ids)
    encoder = token_rows.Encoder(token_rows.VOCABULARY)
    texts = Counter(i for i, t, _ in corpus if t)
    once = {i: t for i, t, _ in corpus if t and i is not None and texts[i] == 1}
    back = {r.doc_id: r.ids for r in token_rows.unpack(rows).collect()}
    assert {i: encoder.decode(np.array(back[i])) for i in once} == once and len({(r.part, r.row) for r in got}) == len(got)


def test_encoder_agrees_with_the_whole_text():
    encoder = token_rows.Encoder(token_rows.VOCABULARY)
    for t in ("a b", " a", "a ", "a  b", "x\n y", "x \n\n y z", "it's  we'll", "é ß\tñ 12 3", "  ", "", "one. Two\nthree"):
        assert np.frombuffer(encoder.encode(t), "<u2").tolist() == encoder.encoding.encode_ordinary(t)


def test_best_fit_decreasing_is_best_fit():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 65, 400)
    room, want = [], {}
    for p in np.argsort(-lengths, kind="stable").tolist():
        fit = min((x for x in room if x >= lengths[p]), default=64)
        if fit in room:
            room.remove(fit)
        room.append(fit - lengths[p])
        want[p] = fit
    rows = token_rows.best_fit_decreasing(lengths, 64)
    assert sorted(p for r in rows for p in r) == list(range(400)) and all(lengths[r].sum() <= 64 for r in rows)
    assert sorted(64 - lengths[r].sum() for r in rows) == sorted(room)


# SentencePiece


def best_score(model, marked):
    score = [0] + [-(1 << 60)] * len(marked)
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - model.reach), end):
            for stop, s, _ in model.edges(marked, start):
                if stop == end:
                    score[end] = max(score[end], score[start] + s)
    return score[-1]


def test_pieces_have_the_best_score():
    m = pieces.model(pieces.MODEL)
    for t in ("hello world", "für ßß heitlichge", "Éç la  maison", "x", " ", "日本語 ẞ\n\tq", "aaaaaaaaaaaaaaaaaaaa"):
        ids = np.frombuffer(m.encode(t), "<u2").tolist()
        marked = pieces.MARK + t.replace(" ", pieces.MARK)
        by_id = {i: s for s, i in m.score.values()}
        spent, raw = 0, []
        for i in ids:
            if i in by_id:
                spent += by_id[i]
            else:
                raw.append(i)
        unknown = sum(1 for c in marked if c not in m.score)
        assert m.decode(ids) == t and (spent + unknown * m.unknown == best_score(m, marked) or raw == [])


def test_pieces_against_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1  # the same pieces and scores, cut by score instead of by merges
    for p in proto.pieces:
        if p.score < -1e8:
            p.score, p.type = -1e8, sentencepiece_model_pb2.ModelProto.SentencePiece.UNUSED
    library, m = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), pieces.model(pieces.MODEL)
    for t in "analytics engine; reproducible für maison señor unbelievable thorough whitespace Spark".split():
        assert np.frombuffer(m.encode(t), "<u2").tolist() == library.encode(t)


@pytest.mark.parametrize("chunk", [40, 1 << 14])
def test_chunked_texts_have_the_same_pieces(docs, corpus, chunk):
    m = pieces.model(pieces.MODEL)
    got = Counter((r.doc_id, None if r.ids is None else tuple(r.ids)) for r in pieces.encode(docs.where("coalesce(length(text), 0) < 20000"), chunk=chunk).collect())
    assert got == Counter((i, None if t is None else tuple(np.frombuffer(m.encode(t), "<u2").tolist())) for i, t, _ in corpus if len(t or "") < 20000)


def test_a_long_word_over_many_chunks(spark):
    m, t = pieces.model(pieces.MODEL), "abcé" * 700
    r = pieces.encode(spark.createDataFrame([(1, t)], "doc_id long, text string"), chunk=20).first()
    _, came = m.best(pieces.MARK + t)
    want = np.frombuffer(m.ids_of(pieces.MARK + t, m.path(came, len(t) + 1)[0]), "<u2").tolist()
    assert r.n_chunks > 2 * pieces.FANOUT and r.ids == want and m.decode(want) == t


def test_decoding(docs, corpus):
    got = Counter((r.doc_id, r.t) for r in pieces.encode(docs, chunk=5000).select("doc_id", pieces.decode_column(F.col("ids")).alias("t")).collect())
    assert got == Counter((i, t) for i, t, _ in corpus)


# Sharding


def old(n):
    return F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(n))


def test_shards_are_even_and_gapless(docs, corpus):
    rows = sharding.reshard(docs, old(6), 6, 8, block_bytes=2000).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in corpus)
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    largest = max(r["size"] for r in rows)
    assert max(sizes.values()) - min(sizes[j] for j in range(8)) <= largest


def test_flow_moves_the_fewest_bytes():
    rng = np.random.default_rng(7)
    for _ in range(30):
        supply = rng.integers(0, 50, rng.integers(1, 6)).tolist()
        capacity = sharding.even_capacities(sum(supply), int(rng.integers(1, 6)))
        flow = sharding.min_cost_flow(supply, capacity)
        assert [sum(r) for r in flow] == supply and [sum(c) for c in zip(*flow)] == capacity
        moved = sum(x for i, r in enumerate(flow) for j, x in enumerate(r) if i != j)
        assert moved == sum(s - min(s, capacity[i] if i < len(capacity) else 0) for i, s in enumerate(supply))
    with pytest.raises(ValueError):
        sharding.min_cost_flow([5], [4])


def test_only_touched_shards_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(i, "x" * (i % 9), "abc"[i % 3]) for i in range(90)], "doc_id long, text string, source string")
    shard = F.when(F.col("source") == "a", 0).when(F.col("source") == "b", 1).otherwise(2)
    folder = str(tmp_path / "shards")
    rows.withColumn("shard", shard).write.partitionBy("shard").parquet(folder)
    size = dict(rows.groupBy(shard.alias("s")).agg(F.sum(F.octet_length("text") + 1)).collect())
    plan = sharding.reshard(rows, shard, 3, 3, capacities=[size[0] - 20, size[1] + 20, size[2]], loose_docs=0)
    before = {p.name for p in (tmp_path / "shards" / "shard=2").iterdir()}
    assert sharding.rewrite(rows, plan, folder) == [0, 1]
    assert {p.name for p in (tmp_path / "shards" / "shard=2").iterdir()} == before
    back = spark.read.parquet(folder)
    assert sorted(r.doc_id for r in back.collect()) == list(range(90))
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in plan.collect()}


def test_rewriting_keeps_null_and_repeated_ids(spark, tmp_path):
    rows = [(i, "x" * (i % 9), "abc"[i % 3], i) for i in range(90)]
    rows += [(None, "y" * (i % 4), "abc"[i % 3], i % 2) for i in range(12)] + [(7, "same", "abc"[i % 3], 0) for i in range(9)]
    rows += [(8, None, s, None) for s in "aabbcc"] + [(9, f"text {i}", "abc"[i % 3], i) for i in range(6)] + [(10, "swap", "a", None), (10, "swap", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long").repartition(3)
    shard = F.when(F.col("source") == "a", 0).when(F.col("source") == "b", 1).otherwise(2)
    folder = str(tmp_path / "shards")
    docs.withColumn("shard", shard).write.partitionBy("shard").parquet(folder)
    size = dict(docs.groupBy(shard.alias("s")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).collect())
    plan = sharding.reshard(docs, shard, 3, 3, capacities=[size[0] - 60, size[1] + 60, size[2]], loose_docs=0)
    before = {p.name for p in (tmp_path / "shards" / "shard=2").iterdir()}
    with pytest.raises(ValueError):
        sharding.rewrite(docs.where("doc_id is not null"), plan, folder)
    assert sharding.rewrite(docs, plan, folder) == [0, 1]
    assert {p.name for p in (tmp_path / "shards" / "shard=2").iterdir()} == before
    back = spark.read.parquet(folder).select("doc_id", "text", "source", "extra", "shard").collect()
    assert Counter(tuple(r)[:4] for r in back) == Counter(rows)
    assert Counter((r.doc_id, r.shard) for r in back) == Counter((r.doc_id, r.shard) for r in plan.collect())


def test_empty_tables(empty):
    assert quality.judge(empty).count() == 0 and quality.keep(empty).count() == 0
    assert substrings.digest(empty).count() == 0 and substrings.remove(empty).columns == empty.columns
    assert ngram_join.component_table(empty).count() == 0 and ngram_join.keep_first(empty).count() == 0
    assert lines.digest(empty).count() == 0 and lines.remove(empty).count() == 0
    assert binpack.pack(empty, F.xxhash64("text")).count() == 0 and token_rows.pack(empty).count() == 0
    assert pieces.encode(empty).count() == 0 and sharding.reshard(empty, old(6), 6, 8).count() == 0
