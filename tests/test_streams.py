"""Detectors over rows that arrive out of order across micro-batches."""

import random

from pyspark.sql import functions as F

from tests.test_hazards import access, brute
from tracegrain.streaming import monitors
from tracegrain.streaming.run import drain, drain_in_order, job_folder, read_files_stream, use_rocksdb

MINUTE = 60_000_000
SCHEMA = "key string, actor long, id long, t long, category string, kind string, value string, locks string"


def arrive(spark, files, schema):
    """A stream of one file for each list of rows, and a last row that closes the others."""
    use_rocksdb(spark)
    out = job_folder(spark)
    for n, rows in enumerate([*files, [tuple(None if c != "t" else 10**13 for c in (x.split()[0] for x in schema.split(", ")))]]):
        spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_micros("t")).coalesce(1).write.parquet(f"{out}/{n}")
    stream = monitors.watermarked(read_files_stream(spark, out), "10 minutes")
    return monitors.only(stream, F.col("t") < 10**13)


def test_lost_updates_out_of_order(spark):
    """Rows come up to two files late; the result is that of the whole table in order."""
    rng = random.Random(8)
    rows = [access(i, i * MINUTE // 10, rng.randrange(4), rng.choice(["shared_read", "shared_write", "shared_read"]), str(rng.randrange(2)),
                   [("L", rng.randrange(2))] if rng.random() < 0.3 else [], key=rng.choice(["hot", "hot", "k1"])) for i in range(300)]
    files = [[] for _ in range(6)]
    for r in rows:
        files[min(5, r[1] // 60 + (rng.random() < 0.3))].append((r[3], r[4], r[1], r[2], r[5], r[6], r[7], ",".join(f"{a}#{b}" for a, b in r[8])))
    for f in files:
        rng.shuffle(f)
    found, late = drain_in_order(monitors.lost_updates(arrive(spark, files, SCHEMA), bucket_ms=120_000))
    got = [(r["write_id"], r["other_write_id"]) for r in found.collect()]
    assert late.count() == 0 and len(got) == len(set(got)) and set(got) == brute(rows) and got


def test_late_rows_go_aside(spark):
    points = [(1, t * MINUTE, t, 100 * t) for t in range(0, 100, 5)]
    late = [(1, 7 * MINUTE, 1000, 10**9), (2, 3 * MINUTE, 1001, 5)]  # a bucket of two minutes long released
    stream = arrive(spark, [points[:10], points[10:], late], "run_id long, t long, seq long, value long")
    found, aside = drain_in_order(monitors.spikes(stream, jump=50, high=10**6, bucket_ms=120_000))
    assert sorted((r["run_id"], r["late_t"], r["late_seq"]) for r in aside.collect()) == [(1, 7 * MINUTE, 1000), (2, 3 * MINUTE, 1001)]
    assert [r["seq"] for r in found.orderBy("t").collect()] == [t for t in range(5, 100, 5) if 500 > max(100 * (t - 5) * 0.5, 50)]


def test_state_is_released():
    """After the last timer nothing of a key is kept that has nothing to remember."""
    class Handle:
        def __init__(self):
            self.timers, self.maps, self.values = set(), {}, {}

        def getMapState(self, name, *_):
            class M(dict):
                updateValue = dict.__setitem__
                getValue = dict.__getitem__
                removeKey = dict.pop
            return self.maps.setdefault(name, M())

        def getValueState(self, name, *_):
            outer = self

            class V:
                def exists(self): return name in outer.values
                def get(self): return outer.values[name]
                def update(self, v): outer.values[name] = v
                def clear(self): outer.values.pop(name, None)
            return V()

        def registerTimer(self, at): self.timers.add(at)
        def deleteTimer(self, at): self.timers.remove(at)

    class Times:
        def __init__(self, now): self.now = now
        def getCurrentWatermarkInMs(self): return self.now

    import pandas as pd

    p, h = monitors._Pairs(60_000, None), Handle()
    p.init(h)
    rows = pd.DataFrame([(6 * MINUTE, 1, 0, "stop", 3, 0), (2 * MINUTE, 0, 0, "start", 0, 0)], columns=list(p.fields))
    assert list(p.handleInputRows((1, 2), iter([rows]), Times(0))) == []
    assert h.timers == {180_000} and len(h.maps["queue"]) == 2
    assert list(p.handleExpiredTimer((1, 2), Times(180_000), None)) == []
    h.timers.remove(180_000)
    assert h.timers == {420_000} and len(h.maps["queue"]) == 1
    (out,) = p.handleExpiredTimer((1, 2), Times(500_000), None)
    assert out.values.tolist() == [[1, 2, 0, 1, 6 * MINUTE, 4 * MINUTE, 3, 0, False, None, None]]
    assert not h.maps["queue"] and not h.values


def test_first_events_of_spread_runs(spark):
    """Two files, a cap inside the second: the first in order of file and number, the rest counted."""
    use_rocksdb(spark)
    out = job_folder(spark)
    for n, numbers in enumerate([range(0, 60, 2), range(1, 200)]):
        spark.createDataFrame([("r", i) for i in numbers], "run_id string, seq long").coalesce(1).write.parquet(f"{out}/{n}")
    got = drain(monitors.first_events(read_files_stream(spark, out), 50, parts=3)).collect()
    assert sorted(r["seq"] for r in got if not r["counter"]) == sorted([*range(0, 60, 2), *range(1, 21)])
    assert max(r["dropped_events"] for r in got) == 30 + 199 - 50


class Store:
    """A handle that keeps state in memory and counts the calls to it."""

    def __init__(self):
        self.calls, self.timers, self.values = 0, set(), {}

    def _of(self, name):
        outer = self

        def called(result=None):
            outer.calls += 1
            return result

        class Of:
            def exists(self): return called(name in outer.values)
            def get(self): return called(outer.values[name])
            def update(self, v): called(outer.values.__setitem__(name, v))
            def clear(self): called(outer.values.pop(name, None))
            def getValue(self, k): return called(outer.values[name, k])
            def updateValue(self, k, v): called(outer.values.__setitem__((name, k), v))
            def removeKey(self, k): called(outer.values.pop((name, k)))
        return Of()

    def getMapState(self, name, *_): return self._of(name)
    def getValueState(self, name, *_): return self._of(name)
    def registerTimer(self, at): self.calls += 1; self.timers.add(at)
    def deleteTimer(self, at): self.calls += 1; self.timers.remove(at)
    def getCurrentWatermarkInMs(self): return self.now


def test_keys_of_a_part_share_its_calls():
    """As many calls of the state store for 200 keys as for one; each key has its own state, from release to release."""
    import pandas as pd

    calls = {}
    for n in (1, 200):
        p, h, out = monitors._Spikes(60_000, 50, 10**6), Store(), []
        p.owner = ("run_id",)
        p.init(h)
        for turn in (0, 1):
            rows = [(k, (2 * turn + i) * MINUTE, i, 10 * k + 100 * (2 * turn + i)) for k in range(n) for i in (1, 0)]
            h.now = 2 * turn * 60_000
            assert list(p.handleInputRows((7,), iter([pd.DataFrame(rows, columns=["run_id", *p.fields])]), h)) == []
            assert len(h.timers) == 1
            h.now += 120_000
            h.timers.clear()
            out += [tuple(r[:4]) for f in p.handleExpiredTimer((7,), h, None) for r in f.values.tolist()]
        values = lambda k: [10 * k + 100 * i for i in range(4)]
        assert sorted(out) == [(k, i * MINUTE, i % 2, v) for k in range(n) for i, (u, v) in enumerate(zip([None, *values(k)], values(k))) if u is not None and v - u > max(u * 0.5, 50)]
        calls[n] = h.calls
    assert calls[1] == calls[200]


def test_null_keys_and_values_in_one_part(spark):
    """A null key is one key; a null value beside others leaves numbers over 2^53 exact."""
    big = 2**60 + 1
    rows = [(None, 0, big, 100), (None, MINUTE, big + 2, 300), (1, 0, 5, None), (1, 2 * MINUTE, 6, 100), (1, 3 * MINUTE, 7, 400), (None, 3 * MINUTE, None, 900)]
    found, aside = drain_in_order(monitors.spikes(arrive(spark, [rows], "run_id long, t long, seq long, value long"), jump=50, high=10**6, bucket_ms=120_000))
    assert aside.count() == 0
    assert {(r["run_id"], r["seq"], r["value"]) for r in found.collect()} == {(None, big + 2, 300), (1, 7, 400), (None, None, 900)}
