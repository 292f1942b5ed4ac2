"""Online detectors over streams, in event order. Each has a batch twin in ``operators``.

Rows arrive in any order. Keys are dealt over parts. Rows wait in their part's queue, by buckets of event time, until the watermark has passed the
bucket; then they are stepped through in order, each with the state of its key. A row is written once and read once, and a part has one timer, at the
end of its first waiting bucket. What a detector remembers is a few values per key, and nothing of a key that has nothing to remember. A row whose bucket the watermark had passed when it
arrived is late: it takes no part, and comes out with ``late`` set, its time and its number, so a sink can put it aside and count it
(``streaming.run.drain_in_order``). The last rows of a stream that ends wait for rows after them.
"""

from __future__ import annotations

import bisect
import json
import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracegrain.operators.events import LEAST_BYTES

BUCKET_MS = 3_600_000
PARTS = 256
FRAME_ROWS = 10_000
ABSENT = "absent_bits"
LATE = "late boolean, late_t bigint, late_seq bigint"


def watermarked(rows: DataFrame, delay: str, event_time: str = "at") -> DataFrame:
    """``rows`` with the watermark set over all of them. The event time is kept as a plain column, so late rows reach the detectors
    instead of being dropped."""
    marked = rows.withWatermark(event_time, delay)
    return marked.withColumn(event_time, F.timestamp_micros(F.unix_micros(event_time)))


def only(rows: DataFrame, wanted: Column, event_time: str = "at") -> DataFrame:
    """The wanted rows of a watermarked stream. Put so that the filter stays above the watermark: rows that a detector does not use move it too."""
    return rows.where(F.when(F.col(event_time).isNotNull(), wanted).otherwise(F.lit(False)))


class InOrder(StatefulProcessor):
    """Queues rows by event time and steps through them in order. ``fields`` begin with the time in microseconds and a number that orders rows of one time.

    A group of the stream is one key, or a part of all keys where ``owner`` names the key's columns: then its keys share their queue, their timer and their calls.
    """

    fields: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    owner: tuple[str, ...] = ()
    numbers: frozenset[str] = frozenset()

    def __init__(self, bucket_ms: int = BUCKET_MS):
        self.bucket_ms = bucket_ms

    def start(self):
        """What is remembered of a key before its first row: any JSON value."""
        return None

    def step(self, key: tuple, state, row: list, out: list[tuple]):
        """Take the next row: append output rows, return what is remembered."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getMapState("queue", "bucket bigint, part bigint", "rows string")
        self.waiting = handle.getValueState("waiting", "waiting string")
        self.states = handle.getValueState("states", "states string")

    def _end(self, bucket: int) -> int:
        return (bucket + 1) * self.bucket_ms

    def _load(self) -> dict[int, int]:
        return dict(json.loads(self.waiting.get()[0])) if self.waiting.exists() else {}

    def _store(self, waiting: dict[int, int]) -> None:
        if waiting:
            self.waiting.update((json.dumps(sorted(waiting.items())),))
        else:
            self.waiting.clear()

    def _rows(self, key: tuple, frame: pd.DataFrame) -> Iterator[list]:
        """The key's values and the fields of each row. A number that is null is NaN, as it is in a frame."""
        names = [*self.owner, *self.fields]
        absent = frame[ABSENT].tolist() if ABSENT in frame else [0] * len(frame)
        for row, nulls in zip(map(list, zip(*(frame[c].astype(object).tolist() for c in names))), absent):
            if nulls:
                for i, c in enumerate(names):
                    if nulls >> i & 1:
                        row[i] = math.nan if c in self.numbers else None
            yield row if self.owner else [*key, *row]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, late, fresh, at = timerValues.getCurrentWatermarkInMs(), [], {}, len(self.owner or key)
        for frame in rows:
            for row in self._rows(key, frame):
                bucket = row[at] // 1000 // self.bucket_ms
                if self._end(bucket) <= passed:
                    late.append((*row[:at], *[None] * len(self.columns), True, row[at], row[at + 1]))
                else:
                    fresh.setdefault(bucket, []).append(row)
        if fresh:
            waiting = self._load()
            before = min(waiting, default=None)
            for bucket, new in fresh.items():
                part = waiting.get(bucket, 0)
                self.queue.updateValue((bucket, part), (json.dumps(new),))
                waiting[bucket] = part + 1
            first = min(waiting)
            if first != before:
                if before is not None:
                    self.handle.deleteTimer(self._end(before))
                self.handle.registerTimer(self._end(first))
            self._store(waiting)
        if late:
            yield self._frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, done, at = timerValues.getCurrentWatermarkInMs(), [], len(self.owner or key)
        waiting = self._load()
        states = {tuple(who): state for who, state in json.loads(self.states.get()[0])} if self.states.exists() else {}
        touched = set()
        for bucket in sorted(b for b in waiting if self._end(b) <= passed):
            rows = []
            for part in range(waiting.pop(bucket)):
                rows += json.loads(self.queue.getValue((bucket, part))[0])
                self.queue.removeKey((bucket, part))
            for row in sorted(rows, key=lambda r: (r[at], r[at + 1])):
                who, out = tuple(row[:at]), []
                touched.add(who)
                states[who] = self.step(who, states[who] if who in states else self.start(), row[at:], out)
                done += [(*who, *r, False, None, None) for r in out]
            if len(done) >= FRAME_ROWS:
                yield self._frame(done)
                done = []
        if waiting:
            self.handle.registerTimer(self._end(min(waiting)))
        self._store(waiting)
        for who in touched:
            states[who] = self.rest(states[who])
            if states[who] == self.start():
                del states[who]
        if states:
            self.states.update((json.dumps([*states.items()]),))
        else:
            self.states.clear()
        if done:
            yield self._frame(done)

    def rest(self, state):
        """What still has to be remembered when all released rows are done with."""
        return state

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        # Objects, so that whole numbers beside nulls stay whole.
        return pd.DataFrame(rows, dtype=object)

    def close(self) -> None:
        pass


def _run(rows: DataFrame, keys: list[str], processor: InOrder, key_types: str, types: str, parts: int = PARTS) -> DataFrame:
    """Keys are dealt over ``parts`` parts, each with one state: a call, a timer or a write of the store serves all keys of a part, so their number does
    not set the price. A part holds its keys' small states in one value; ``parts`` bounds how many those are.
    """
    names = [*keys, *processor.fields]
    processor.owner = tuple(keys)
    processor.numbers = frozenset(c for c in processor.fields if isinstance(rows.schema[c].dataType, T.NumericType))
    # Nulls come as bits of their own, as a frame would make all whole numbers beside one into floats.
    absent = reduce(Column.bitwiseOR, (F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(names)))
    filled = [F.coalesce(c, F.lit(0).cast(rows.schema[c].dataType)).alias(c) if isinstance(rows.schema[c].dataType, T.NumericType) else F.col(c) for c in names]
    packed = rows.select(F.pmod(F.xxhash64(*keys), F.lit(parts)).alias("state_part"), absent.alias(ABSENT), *filled)
    return packed.groupBy("state_part").transformWithStateInPandas(processor, f"{key_types}, {types}, {LATE}", "Append", "EventTime")


class _Pressure(InOrder):
    """First breach of a memory budget or reserve, with the peaks up to it."""

    fields = ("t", "seq", "root_rss", "group_rss", "budget", "available", "reserve")
    columns = ("t", "stop_reason", "peak_root", "peak_group", "last_available", "last_group")

    def start(self):
        return [False, 0, 0]

    def step(self, key, state, row, out):
        stopped, root, group = state
        t, _, root_rss, group_rss, budget, available, reserve = row
        if stopped:
            return state
        root, group = max(root, root_rss), max(group, group_rss)
        reason = "rss_budget" if group_rss >= budget else "system_reserve" if available <= reserve else None
        if reason:
            out.append((t, reason, root, group, available, group_rss))
        return [reason is not None, root, group]


def pressure(points: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``points``: process, t, seq, root_rss, group_rss, budget, available, reserve. One row per process that crossed its budget or reserve."""
    return _run(points, ["process"], _Pressure(bucket_ms), "process bigint", "t bigint, stop_reason string, peak_root bigint, peak_group bigint, last_available bigint, last_group bigint")


class _Growth(InOrder):
    fields = ("t", "id", "footprint")
    columns = ("id", "previous_id", "before_bytes", "after_bytes", "growth_bytes")

    def step(self, key, state, row, out):
        _, number, footprint = row
        if state and footprint - state[1] >= LEAST_BYTES:
            out.append((number, state[0], state[1], footprint, footprint - state[1]))
        return [number, footprint]


def checkpoint_growth(checkpoints: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``checkpoints``: run_id, label, t, id, footprint. Growth of 64 KiB or more since the label's previous checkpoint."""
    return _run(checkpoints, ["run_id", "label"], _Growth(bucket_ms), "run_id string, label string", "id bigint, previous_id bigint, before_bytes bigint, after_bytes bigint, growth_bytes bigint")


class _Pairs(InOrder):
    """Open starts per generation; a start that never stops is forgotten after the time to live, where one is given."""

    fields = ("t", "seq", "generation", "phase", "collected", "uncollectable")
    columns = ("generation", "seq", "t", "duration", "collected", "uncollectable")

    def __init__(self, bucket_ms: int, ttl_us: int | None):
        super().__init__(bucket_ms)
        self.ttl_us = ttl_us

    def start(self):
        return {}

    def step(self, key, state, row, out):
        t, seq, generation, phase, collected, uncollectable = row
        if phase == "start":
            state[str(generation)] = t
        else:
            begun = state.pop(str(generation), None)
            if begun is not None and (self.ttl_us is None or t - begun <= self.ttl_us):
                out.append((generation, seq, t, t - begun, collected, uncollectable))
        if self.ttl_us is not None:
            state = {g: begun for g, begun in state.items() if t - begun <= self.ttl_us}
        return state


def gc_pairs(events: DataFrame, ttl_ms: int | None = None, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``events``: run_id, thread, generation, phase, t, seq, collected, uncollectable. Unmatched stops are ignored."""
    processor = _Pairs(bucket_ms, None if ttl_ms is None else ttl_ms * 1000)
    return _run(events, ["run_id", "thread"], processor, "run_id bigint, thread bigint", "generation bigint, seq bigint, t bigint, duration bigint, collected bigint, uncollectable bigint")


class _Spikes(InOrder):
    fields = ("t", "seq", "value")
    columns = ("t", "seq", "value", "spike", "plateau", "doubling")

    def __init__(self, bucket_ms: int, jump: int, high: int):
        super().__init__(bucket_ms)
        self.jump, self.high = jump, high

    def _level(self, x: int) -> int:
        return (x // self.high).bit_length() - 1 if x >= self.high else -1

    def step(self, key, state, row, out):
        t, seq, v = row
        prev, before, stalled = state or (None, None, 0)
        stalled = 0 if before is None or v > before * 1.01 else stalled + 1
        top = v if before is None else max(v, before)
        spike = prev is not None and v - prev > max(prev * 0.5, self.jump)
        plateau = stalled == 5 and top > self.high and v >= 0.9 * top
        doubling = self._level(top) > self._level(before or 0)
        if spike or plateau or doubling:
            out.append((t, seq, v, spike, plateau, doubling))
        return [v, top, stalled]


def spikes(points: DataFrame, jump: int = 10 << 20, high: int = 5 << 20, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``points``: run_id, t, seq, value. Alert rows as in ``operators.series.spikes``."""
    return _run(points, ["run_id"], _Spikes(bucket_ms, jump, high), "run_id bigint", "t bigint, seq bigint, value bigint, spike boolean, plateau boolean, doubling boolean")


class _Accesses(InOrder):
    """Pairs each write with its actor's read before it. Every read opens, and is closed by the actor's next access."""

    fields = ("t", "id", "category", "kind", "value", "locks")
    columns = ("read_value", "mark", "t", "id", "read_id", "read_t", "write_value", "locks", "literal")

    def step(self, key, state, row, out):
        t, number, category, kind, value, locks = row
        if category not in ("shared_read", "shared_write"):
            return state
        if category == "shared_read":
            if state:
                out.append((state[4], "close", t, number, state[1], state[0], None, None, None))
            out.append((value, "open", t, number, number, t, None, None, None))
            return row
        if state:
            held = {x.split("#")[0] for x in set(filter(None, state[5].split(","))) & set(filter(None, locks.split(",")))}
            out.append((state[4], "write", t, number, state[1], state[0], value, ",".join(sorted(held)), state[3] == "literal" and kind == "literal"))
        return None


class _Overlaps(StatefulProcessor):
    """Marks of one key and read value; the marks of a micro-batch are later than all before them.

    A write is kept only while a read from before it is open: later reads cannot overlap it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.facts = handle.getValueState("facts", "open string, kept string")

    def handleInputRows(self, key, rows, timerValues):
        reads, kept = map(json.loads, self.facts.get()) if self.facts.exists() else ({}, {})
        marks, out = [], []
        for frame in rows:
            for row in frame[["t", "id", "mark", "actor", "read_id", "read_t", "write_value", "locks", "literal", "late", "late_t", "late_seq"]].astype(object).values.tolist():
                if row[9]:
                    out.append((key[0], row[3], None, None, None, None, None, True, row[10], row[11]))
                else:
                    marks.append(row[:9])
        for n, row in enumerate(sorted(marks, key=lambda m: (m[0], m[1], m[2] != "close"))):
            self._take(key[0], key[1], row, reads, kept, out)
            if n % 1024 == 1023:
                self._forget(reads, kept)
        self._forget(reads, kept)
        if reads or kept:
            self.facts.update((json.dumps(reads), json.dumps(kept)))
        else:
            self.facts.clear()
        if out:
            yield pd.DataFrame(out, dtype=object)

    @staticmethod
    def _take(key, value, mark: list, reads: dict, kept: dict, out: list) -> None:
        t, number, what, actor, read_id, read_t, write_value, locks, literal = mark
        if what == "open":
            reads[str(actor)] = t
            return
        reads.pop(str(actor), None)
        if what == "close" or not literal or write_value == value:
            return
        mine = set(filter(None, locks.split(",")))
        others = kept.setdefault(write_value, [])  # in the order of their times
        for o in others[bisect.bisect_right(others, int(read_t), key=lambda o: o[0]):]:
            if o[2] != actor and o[4] < t and not mine & set(filter(None, o[5].split(","))):
                out.append((key, actor, o[2], int(read_id), number, o[3], o[1], False, None, None))
        others.append([t, number, actor, int(read_id), int(read_t), locks])

    @staticmethod
    def _forget(reads: dict, kept: dict) -> None:
        since = min(reads.values(), default=None)
        for value in list(kept):
            left = [] if since is None else kept[value][bisect.bisect_right(kept[value], since, key=lambda o: o[0]):]
            if left:
                kept[value] = left
            else:
                del kept[value]

    def close(self) -> None:
        pass


def lost_updates(events: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Conflicting pairs of paired writes. ``events``: key, actor, id, t, category, kind, value, locks (``lock#acquisition`` joined by commas).

    Other categories are passed over. Accesses are put in order and paired by key and actor; pairs meet by key and value read, so a hot key spreads over its actors and values.
    """
    paired = _run(events, ["key", "actor"], _Accesses(bucket_ms), "key string, actor bigint",
                  "read_value string, mark string, t bigint, id bigint, read_id bigint, read_t bigint, write_value string, locks string, literal boolean")
    return paired.groupBy("key", "read_value").transformWithStateInPandas(
        _Overlaps(), f"key string, actor bigint, other_actor bigint, read_id bigint, write_id bigint, other_read_id bigint, other_write_id bigint, {LATE}", "Append", "None")


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple]:
    """A micro-batch's rows of one key in event order. Source rate limits bound how many there are."""
    frames = list(rows)
    if frames:
        yield from pd.concat(frames).sort_values(by, kind="stable").itertuples(index=False)


class _FirstOfPart(StatefulProcessor):
    """The first ``cap`` events of one part of a run pass; the others are counted."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows, timerValues):
        n = self.count.get()[0] if self.count.exists() else 0
        passed, dropped = [], 0
        for r in _in_order(rows, ["seq"]):
            if n < self.cap:
                passed.append((key[0], int(r.seq), 0))
                n += 1
            else:
                dropped += 1
        self.count.update((n,))
        if dropped:
            passed.append((key[0], None, dropped))
        yield pd.DataFrame(passed, columns=["run_id", "seq", "dropped"]).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


class _Capped(StatefulProcessor):
    """The first ``cap`` of the events that the parts of a run have let pass."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "kept bigint, dropped bigint")

    def handleInputRows(self, key, rows, timerValues):
        kept, dropped = self.count.get() if self.count.exists() else (0, 0)
        numbers = []
        for frame in rows:
            dropped += int(frame["dropped"].sum())
            numbers += frame["seq"].dropna().astype("int64").tolist()
        numbers.sort()
        room = max(self.cap - kept, 0)
        out = [(key[0], n, False, 0) for n in numbers[:room]]
        kept += len(out)
        dropped += len(numbers) - len(out)
        self.count.update((kept, dropped))
        if dropped:
            out.append((key[0], None, True, dropped))
        yield pd.DataFrame(out, columns=["run_id", "seq", "counter", "dropped_events"]).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def first_events(events: DataFrame, cap: int, parts: int = 64) -> DataFrame:
    """``events``: run_id, seq. The first ``cap`` events of a run, and counter rows with the number dropped so far.

    A run is spread over ``parts``, each of which lets ``cap`` events pass at most, so what comes together for a run is bounded whatever its length.
    """
    spread = events.select("run_id", "seq", F.pmod(F.xxhash64("seq"), F.lit(parts)).alias("part"))
    passed = spread.groupBy("run_id", "part").transformWithStateInPandas(_FirstOfPart(cap), "run_id string, seq bigint, dropped bigint", "Append", "None")
    return passed.groupBy("run_id").transformWithStateInPandas(_Capped(cap), "run_id string, seq bigint, counter boolean, dropped_events bigint", "Append", "None")
