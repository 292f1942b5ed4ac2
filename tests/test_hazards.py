import random

from pyspark.sql import functions as F

from tracegrain.operators import events as ev, hazards

SCHEMA = ("run_id string, id long, t long, key string, actor long, category string, kind string, value string, synchronization array<struct<lock_id:string,acquisition_id:long>>, "
          "expected string, observed string")


def access(i, t, actor, category, value, locks=(), key="k", expected=None, observed=None):
    return ("r", i, t, key, actor, category, "literal", value, list(locks), expected, observed)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


OVERLAP = [access(1, 1, 1, "shared_read", "0"), access(2, 2, 2, "shared_read", "0"), access(3, 3, 1, "shared_write", "1"), access(4, 4, 2, "shared_write", "1")]


def test_confirmed_and_potential(spark):
    outcome = access(5, 5, 0, "shared_outcome", None, expected="2", observed="1")
    assert [r["status"] for r in hazards.lost_updates(frame(spark, [*OVERLAP, outcome])).collect()] == ["confirmed"]
    assert [r["status"] for r in hazards.lost_updates(frame(spark, OVERLAP)).collect()] == ["potential"]


def test_one_critical_section_protects(spark):
    locked = [access(r[1], r[2], r[4], r[5], r[7], [("L", r[4])]) for r in OVERLAP]
    assert hazards.lost_updates(frame(spark, locked)).count() == 0
    separate = [access(r[1], r[2], r[4], r[5], r[7], [("L", r[1])]) for r in OVERLAP]  # each access locked on its own
    assert hazards.lost_updates(frame(spark, separate)).count() == 1


def test_shared_state_without_a_finding(spark):
    rows = [access(1, 1, 1, "shared_read", "0", key="a"), access(2, 2, 2, "shared_write", "5", key="a"), access(3, 3, 1, "shared_read", "0", key="b"),
            access(4, 4, 1, "shared_write", "0", key="b")]
    a = frame(spark, rows)
    found = hazards.shared_hazards(a, hazards.lost_updates(a))
    assert [(r["key"], r["open_accesses"], r["first_event_id"], r["last_event_id"]) for r in found.collect()] == [("a", 2, 1, 2)]
    assert [(r["key"], r["position"], r["event_id"]) for r in hazards.open_accesses(a, found).orderBy("position").collect()] == [("a", 1, 1), ("a", 2, 2)]
    assert [r["event_id"] for r in hazards.open_accesses(a, found, shown=1).collect()] == [1]


def test_open_accesses_of_a_hot_key_stay_rows(spark, small_chunks):
    """More accesses than one task may order: positions run on over the ranges."""
    rows = [access(i, i // 3, i % 2, "shared_write" if i % 5 == 0 else "shared_read", str(i), key="hot") for i in range(120)]
    a = frame(spark, rows)
    found = hazards.shared_hazards(a, hazards.lost_updates(a))
    got = hazards.open_accesses(a, found).orderBy("position").collect()
    assert [(r["position"], r["event_id"]) for r in got] == [(i + 1, i) for i in range(120)] and found.first()["open_accesses"] == 120


def brute(rows):
    reads, writes, out = {}, {}, set()
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        _, i, t, key, actor, category, _, value, locks, _, _ = r
        if category == "shared_read":
            reads[key, actor] = r
        elif category == "shared_write" and (key, actor) in reads:
            read = reads.pop((key, actor))
            mine = {x[0] for x in set(map(tuple, read[8])) & set(map(tuple, locks))}
            for oa, oread, owrite, olocks in writes.get(key, []):
                if (oa != actor and read[2] < owrite[2] and oread[2] < t and read[7] == oread[7] and value == owrite[7] and value != read[7] and not mine & olocks):
                    out.add((i, owrite[1]))
            writes[key] = [*writes.get(key, []), (actor, read, r, mine)]
    return out


def test_hot_key_against_brute_force(spark, small_chunks):
    """One key holds most accesses; blocks and chunks are tiny, and no pair may be lost or doubled."""
    rng = random.Random(5)
    rows = [access(i, i, rng.randrange(6), rng.choice(["shared_read", "shared_write"]), str(rng.randrange(2)),
                   [("L", rng.randrange(3))] if rng.random() < 0.3 else [], key="hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}") for i in range(600)]
    got = [(r["write_id"], r["other_write_id"]) for r in hazards.lost_updates(frame(spark, rows), block=10).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and got


def test_collector_pairs(spark):
    rows = [("r", "1", 0, "stop", 0, 0), ("r", "1", 0, "start", 1, 1), ("r", "1", 0, "stop", 4, 2), ("r", "1", 0, "stop", 5, 3), ("r", "2", 0, "start", 6, 4)]
    df = spark.createDataFrame(rows, "run_id string, thread string, generation int, phase string, t long, seq long").withColumns({"collected": F.lit(1), "uncollectable": F.lit(0)})
    pairs = ev.gc_pairs(df)
    assert [(r["t"], r["duration"]) for r in pairs.collect()] == [(4, 3)]
    assert ev.gc_totals(pairs, cap=0).first()["dropped_events"] == 1


def test_label_cap_counts_the_rest(spark):
    df = spark.range(300).select(F.lit("r").alias("run_id"), F.concat(F.lit("l"), "id").alias("label"), F.col("id").alias("t"), F.col("id"), F.lit(5).alias("bytes"))
    got = ev.label_totals(df, ["t", "id"], 256).collect()
    assert len(got) == 256 and got[0]["dropped_labels"] == 44
    assert ev.label_totals(df, ["t", "id"]).count() == 300


def test_cleanup_counts_restart_with_a_new_watch(spark, small_chunks):
    watches = spark.createDataFrame([("r", "x", 0, 0, 7), ("r", "x", 10, 10, 8)], "run_id string, label string, t int, id int, object_id int")
    cleanups = spark.createDataFrame([("r", "x", t, t, alive) for t, alive in [(1, True), (2, False), (3, True), (11, True)]], "run_id string, label string, t int, id int, alive boolean")
    got = [(r["t"], r["object_id"], r["retention_observations"]) for r in ev.retained_after_cleanup(watches, cleanups).orderBy("t").collect()]
    assert got == [(1, 7, 1), (3, 7, 2), (11, 8, 1)]


def test_every_open_access_is_listed_in_event_order(spark):
    rows = [access(i, (7 * i) % 40, i % 2, "shared_write" if i % 5 == 0 else "shared_read", str(i), key="k", locks=[("L", i)] if i % 4 == 0 else ()) for i in range(40)]
    a = frame(spark, rows)
    got = hazards.with_events(a, hazards.shared_hazards(a, hazards.lost_updates(a))).collect()
    assert [r["event_ids"] for r in got] == [[i for i, _ in sorted(((r[1], r[2]) for r in rows if not r[8]), key=lambda x: (x[1], x[0]))]]
    assert got[0]["open_accesses"] == len(got[0]["event_ids"]) == 30
