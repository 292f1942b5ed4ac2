"""Event traces: pairing, caps, checkpoints, copies, cleanup."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracegrain.operators.scan import parts, plan_scan, scan, top_k, top_k_with_rest

LEAST_BYTES = 65536


def gc_pairs(events: DataFrame, order: Sequence[str] = ("t", "seq")) -> DataFrame:
    """Collections from start/stop callbacks: a stop pairs with a directly preceding start of its thread and generation.

    Columns used: run_id, thread, generation, phase, the order columns, collected, uncollectable. Other stops are ignored.
    """
    keys = ["run_id", "thread", "generation"]
    s = scan(events, keys, order, prev={"__before": F.struct("phase", F.col(order[0]).alias("t"))})
    stops = s.where((F.col("phase") == "stop") & (F.col("__before")["phase"] == "start"))
    return stops.withColumn("duration", F.col(order[0]) - F.col("__before")["t"]).drop("__before", "phase")


def gc_totals(pairs: DataFrame, cap: int | None = None) -> DataFrame:
    """Collections, pause and object counts of each run; events past ``cap``, where one is given, are counted as dropped but still summed."""
    out = pairs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_collections"), F.sum("duration").alias("total_pause"),
        F.sum("collected").alias("collected"), F.sum("uncollectable").alias("uncollectable"))
    return out.withColumn("dropped_events", F.greatest(F.lit(0), F.col("total_collections") - cap) if cap is not None else F.lit(0).cast("long"))


def first_events(events: DataFrame, order: Sequence[str], cap: int | None = None) -> DataFrame:
    """The first ``cap`` events of each run (all without one), with the number dropped."""
    out = top_k_with_rest(events, ["run_id"], [F.col(c).asc() for c in order], cap, {})
    return out.withColumnRenamed("omitted_rows", "dropped_events").drop("rank")


def known_labels(events: DataFrame, order: Sequence[str], cap: int | None = None) -> DataFrame:
    """The first ``cap`` labels of each run in order of appearance (all without one), with how many were not admitted."""
    seen = events.groupBy("run_id", "label").agg(F.min(F.struct(*order)).alias("__first"))
    out = top_k_with_rest(seen, ["run_id"], [F.col("__first").asc(), F.col("label").asc()], cap, {})
    return out.select("run_id", "label", F.col("omitted_rows").alias("dropped_labels"))


def _admitted(events: DataFrame, order: Sequence[str], cap: int | None) -> DataFrame:
    if cap is None:
        return events
    return events.join(known_labels(events, order, cap), ["run_id", "label"])


def checkpoint_growth(checkpoints: DataFrame, order: Sequence[str] = ("t", "id"), budget: Column | None = None, cap: int | None = None) -> DataFrame:
    """Checkpoints whose owner graph grew by 64 KiB or more since the same label's previous one.

    With ``budget`` also whether the new size passes the declared memory budget (a projected risk, not an observed one).
    """
    admitted = _admitted(checkpoints, order, cap)
    s = scan(admitted, ["run_id", "label"], order, prev={"__b": F.struct(F.col("footprint").alias("bytes"), F.col("id").alias("id"))})
    before = F.col("__b")["bytes"]
    out = s.where(F.col("footprint") - before >= LEAST_BYTES).withColumns({
        "before_bytes": before, "after_bytes": F.col("footprint"), "growth_bytes": F.col("footprint") - before, "previous_id": F.col("__b")["id"]})
    risk = F.col("footprint") > budget if budget is not None else F.lit(False)
    return out.withColumn("over_budget", F.coalesce(risk, F.lit(False))).drop("__b", "footprint")


def checkpoint_cycles(checkpoints: DataFrame) -> DataFrame:
    """Checkpoints whose owner graph has cycles; informational, a cycle alone is not a leak."""
    return checkpoints.where(F.size("cycles") > 0).withColumn("severity", F.lit("information"))


def repeated_copies(copies: DataFrame, order: Sequence[str] = ("t", "id"), cap: int | None = None) -> DataFrame:
    """Labels whose first two copies were both distinct objects, the second of at least 64 KiB."""
    two = top_k(_admitted(copies, order, cap), ["run_id", "label"], [F.col(c).asc() for c in order], 2)
    per = two.groupBy("run_id", "label").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("distinct_result").alias("__d"), F.min_by("footprint", "rank").alias("first_bytes"),
        F.max_by("footprint", "rank").alias("second_bytes"), F.max_by("id", "rank").alias("id"))
    return per.where((F.col("n") == 2) & F.col("__d") & (F.col("second_bytes") >= LEAST_BYTES)).drop("n", "__d")


def retained_after_cleanup(watches: DataFrame, cleanups: DataFrame, order: Sequence[str] = ("t", "id")) -> DataFrame:
    """Watched objects still alive at a cleanup that expected them released, with a running count per watch.

    ``watches``: run_id, label, object_id and the order columns; ``cleanups``: run_id, label (one row per expected label),
    alive and the order columns. A later watch of the same label starts a new count.
    """
    rows = watches.select("run_id", "label", *order, F.lit(1).alias("__watch"), "object_id", F.lit(None).cast("boolean").alias("alive")).unionByName(
        cleanups.select("run_id", "label", *order, F.lit(0).alias("__watch"), F.lit(None).cast(watches.schema["object_id"].dataType).alias("object_id"), "alive"))
    keys = ["run_id", "label"]
    done = []
    for part, plan in parts(rows, plan_scan(rows, keys, order)):
        s = scan(part, keys, order, plan=plan, run_sum={"__no": F.col("__watch")}, fill={"__object": F.col("object_id")})
        s = s.where((F.col("__no") > 0) & (F.col("__watch") == 0) & F.col("alive"))
        s = scan(s, [*keys, "__no"], order, plan=plan, row_number="retention_observations")
        done.append(s.select(*keys, *order, F.col("__object").alias("object_id"), "retention_observations"))
    return reduce(DataFrame.unionByName, done)


def costly_structures(structures: DataFrame, dicts: int = 1000, dict_bytes: int = 100_000) -> DataFrame:
    """Structures with at least 1,000 dictionaries taking 100,000 bytes, from their per-type maps."""
    count, size = F.try_element_at("type_counts", F.lit("dict")), F.try_element_at("type_bytes", F.lit("dict"))
    out = structures.withColumns({"dictionary_count": count, "dictionary_bytes": size})
    return out.where((F.col("dictionary_count") >= dicts) & (F.col("dictionary_bytes") >= dict_bytes))


def uncollectable(results: DataFrame) -> DataFrame:
    """Declared collections that left garbage behind, unless the debug switch keeps everything."""
    return results.where((F.size("gc_garbage") > 0) & ~F.col("gc_debug_saveall"))


def collection_confirmed(watched: DataFrame) -> DataFrame:
    """Per watched label of a collection result: collected only when tracked, not alive and not registered any more."""
    return watched.withColumn("collected_confirmed", F.col("gc_registry_available") & ~F.col("weak_reference_alive") & ~F.col("gc_object_present"))


def label_totals(requests: DataFrame, order: Sequence[str], cap: int | None = None) -> DataFrame:
    """Requests and payload bytes per label; labels past the cap, where one is given, are only counted."""
    if cap is None:
        return requests.groupBy("run_id", "label").agg(F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("requested_payload_bytes"), F.lit(0).cast("long").alias("dropped_labels"))
    known = known_labels(requests, order, cap)
    sums = requests.groupBy("run_id", "label").agg(F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("requested_payload_bytes"))
    return sums.join(known, ["run_id", "label"])


def missing_event_ids(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Cited event ids that no event of the run has."""
    cited = findings.select("run_id", F.col("id").alias("finding_id"), F.explode("event_ids").alias("id"))
    return cited.join(events.select("run_id", "id"), ["run_id", "id"], "left_anti")


def duplicate_event_ids(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id", "id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def unsupported_confirmations(findings: DataFrame, accesses: DataFrame) -> DataFrame:
    """Confirmed hazards whose cited events do not show them.

    Needs two actors that both read and wrote the key, and a cited outcome that differs from what was expected.
    """
    confirmed = findings.where(F.col("status") == "confirmed").select("run_id", F.col("id").alias("finding_id"), "key", F.explode("event_ids").alias("id"))
    seen = confirmed.join(accesses.select("run_id", "key", "id", "actor", "category", "expected", "observed"), ["run_id", "key", "id"], "left")
    per_actor = seen.groupBy("run_id", "finding_id", "actor").agg(
        F.max((F.col("category") == "shared_read").cast("int")).alias("r"), F.max((F.col("category") == "shared_write").cast("int")).alias("w"),
        F.max(((F.col("category") == "shared_outcome") & (F.col("expected") != F.col("observed"))).cast("int")).alias("o"))
    per = per_actor.groupBy("run_id", "finding_id").agg(F.sum(F.coalesce(F.col("r") * F.col("w"), F.lit(0))).alias("both"), F.max(F.coalesce("o", F.lit(0))).alias("outcome"))
    return per.where((F.col("both") < 2) | (F.col("outcome") == 0))
