"""Lost updates and unprotected shared state in declared access events.

Input rows: run_id, id, t, key, actor, category (shared_read, shared_write, shared_outcome), kind, value,
synchronization (array of lock_id, acquisition_id), expected, observed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracegrain.operators.scan import scan, top_k
from tracegrain.session import cut_lineage

BLOCK = 1024  # consecutive paired writes that meet in one key of the join


def paired_writes(accesses: DataFrame) -> DataFrame:
    """Writes whose actor's directly preceding access of the key was a read, with that read."""
    used = accesses.where(F.col("category").isin("shared_read", "shared_write"))
    columns = F.struct("category", "id", "t", "kind", "value", "synchronization")
    s = scan(used, ["run_id", "key", "actor"], ["t", "id"], prev={"r": columns})
    s = s.where((F.col("category") == "shared_write") & (F.col("r")["category"] == "shared_read"))
    # A lock protects the pair only when one acquisition covers both accesses.
    held = F.transform(F.array_intersect(F.col("r")["synchronization"], F.col("synchronization")), lambda x: x["lock_id"])
    literal = (F.col("kind") == "literal") & (F.col("r")["kind"] == "literal")
    return s.select("run_id", "key", "actor", F.col("r")["id"].alias("read_id"), F.col("r")["t"].alias("read_t"), F.col("r")["value"].alias("read_value"),
                    F.col("id").alias("write_id"), F.col("t").alias("write_t"), F.col("value").alias("write_value"), held.alias("locks"), literal.alias("literal"))


def overlapping_pairs(pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Two paired writes of one key by different actors that overlap, read the same and wrote the same changed literal.

    The partners of a write are the writes before it that came after its read: with the writes of one key, read value and
    written value numbered in order, a contiguous run of numbers. Where the run starts is the count of writes up to the read, from
    one ordered scan. Runs meet the writes by blocks of consecutive numbers, so a hot key spreads over many tasks, and rows that share a
    block but are not in the run are at most two blocks for each write.
    """
    group = ["run_id", "key", "read_value", "write_value"]
    used = pairs.where(F.col("literal") & (F.col("write_value") != F.col("read_value")))
    marks = used.select(*group, F.col("write_t").alias("t"), F.lit(0).alias("kind"), "write_id").unionByName(
        used.select(*group, F.col("read_t").alias("t"), F.lit(1).alias("kind"), "write_id"))
    counted = scan(marks, group, ["t", "kind", "write_id"], run_sum={"n": 1 - F.col("kind")})
    places = counted.groupBy(*group, "write_id").agg(F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("rn"), F.max(F.when(F.col("kind") == 1, F.col("n"))).alias("seen"))
    fields = ["actor", "read_id", "read_t", "read_value", "write_id", "write_t", "write_value", "locks", "literal"]
    placed = cut_lineage(used.join(places, [*group, "write_id"]))
    first, last = F.floor(F.col("seen") / block).cast("long"), F.floor((F.col("rn") - 2) / block).cast("long")
    after = placed.where(F.col("rn") - F.col("seen") > 1).withColumn("__block", F.explode(F.sequence(first, last)))
    before = placed.select(*group, F.col("rn").alias("__rn"), F.floor((F.col("rn") - 1) / block).cast("long").alias("__block"), F.struct(*fields).alias("other"))
    met = after.join(before, [*group, "__block"]).where(
        (F.col("__rn") > F.col("seen")) & (F.col("__rn") < F.col("rn")) & (F.col("other.actor") != F.col("actor")) & ~F.arrays_overlap("other.locks", "locks"))
    return met.select("run_id", "key", *fields, "other")


def last_outcomes(accesses: DataFrame) -> DataFrame:
    """The last declared outcome of every key."""
    o = accesses.where(F.col("category") == "shared_outcome")
    return o.groupBy("run_id", "key").agg(F.max_by(F.struct("id", "expected", "observed"), F.struct("t", "id")).alias("outcome"))


def lost_updates(accesses: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conflicting pair: confirmed where the key's last outcome differs from the expected one, else potential."""
    found = overlapping_pairs(paired_writes(accesses), block)
    out = found.join(last_outcomes(accesses), ["run_id", "key"], "left")
    wrong = F.col("outcome").isNotNull() & ~F.col("outcome")["observed"].eqNullSafe(F.col("outcome")["expected"])
    ids = F.array(F.col("read_id"), F.col("other")["read_id"], F.col("other")["write_id"], F.col("write_id"))
    return out.select(
        "run_id", "key", F.when(wrong, "confirmed").otherwise("potential").alias("status"),
        F.when(wrong, "high").otherwise("medium").alias("confidence"), "actor", F.col("other")["actor"].alias("other_actor"),
        "read_id", "write_id", F.col("other")["read_id"].alias("other_read_id"), F.col("other")["write_id"].alias("other_write_id"),
        F.when(wrong, F.concat(ids, F.array(F.col("outcome")["id"]))).otherwise(ids).alias("event_ids"))


def shared_hazards(accesses: DataFrame, found: DataFrame) -> DataFrame:
    """Keys with two or more actors and a write, no lost update found, and an access outside any critical section: how many such accesses,
    the first and the last. ``open_accesses`` has them one by one."""
    used = accesses.where(F.col("category").isin("shared_read", "shared_write"))
    free = F.size("synchronization") == 0
    at = F.when(free, F.struct("t", "id"))
    keys = used.groupBy("run_id", "key").agg(
        F.min("actor").alias("__a"), F.max("actor").alias("__b"), F.max((F.col("category") == "shared_write").cast("int")).alias("__w"),
        F.count_if(free).alias("open_accesses"), F.min(at)["id"].alias("first_event_id"), F.max(at)["id"].alias("last_event_id"))
    shared = keys.where((F.col("__a") != F.col("__b")) & (F.col("__w") == 1) & (F.col("open_accesses") > 0)).drop("__a", "__b", "__w")
    return shared.join(found.select("run_id", "key").distinct(), ["run_id", "key"], "left_anti").withColumn("status", F.lit("potential"))


def with_events(accesses: DataFrame, hazards: DataFrame) -> DataFrame:
    """The keys of ``shared_hazards`` with ``event_ids``, all their accesses outside any critical section in event order. Such a list is one value; ``open_accesses``
    has the same as rows."""
    used = accesses.where(F.col("category").isin("shared_read", "shared_write") & (F.size("synchronization") == 0))
    listed = used.groupBy("run_id", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "id"))), lambda x: x["id"]).alias("event_ids"))
    return hazards.join(listed, ["run_id", "key"], "left")


def open_accesses(accesses: DataFrame, hazards: DataFrame, shown: int | None = None) -> DataFrame:
    """One row for each access outside any critical section of the keys of ``shared_hazards``, with its position (from 1) in event order; the first
    ``shown`` of a key where that is given. A key with any number of accesses stays rows, in as many tasks as it needs."""
    used = accesses.where(F.col("category").isin("shared_read", "shared_write") & (F.size("synchronization") == 0))
    rows = used.join(hazards.select("run_id", "key"), ["run_id", "key"], "left_semi").select("run_id", "key", "t", F.col("id").alias("event_id"))
    if shown is not None:
        return top_k(rows, ["run_id", "key"], [F.col("t").asc(), F.col("event_id").asc()], shown, "position")
    return scan(cut_lineage(rows), ["run_id", "key"], ["t", "event_id"], row_number="position")
