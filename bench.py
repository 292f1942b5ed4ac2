"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. A query has a limit, so that one that hangs costs its own figure only."""

from __future__ import annotations

import json
import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracegrain.plans.catalogue import QUERIES  # noqa: E402
from tracegrain.session import build_session  # noqa: E402

HEADLINE = [
    "etl_native", "etl_rollup", "etl_udf", "etl_row_loop", "line_time", "function_totals", "top_functions", "call_tree", "call_tree_grouped", "neighbors", "phases_depth", "phases_auto",
    "retention_trend", "retention_growing_both", "obs_deltas", "spikes", "thin_300", "lost_updates", "shared_hazards", "gc_totals", "alloc_sites", "alloc_totals", "alloc_budget",
    "compare_functions", "compare_lines", "owner_paths", "path_remap", "findings_adjusted", "overhead_report", "cycles", "footprint", "stack_totals_capped", "call_tree_limited",
    "rule_counts", "run_summaries", "run_reports", "stream_first_events", "stream_lost_updates"]


LIMIT_S = float(os.environ.get("BENCH_LIMIT_S", "90"))  # for one query
TOTAL_S = float(os.environ.get("BENCH_TOTAL_S", "900"))  # after that no query is begun


def timed(spark, name: str, folder: str) -> float | None:
    """Seconds of one query, its whole result produced and thrown away; None where it took more than LIMIT_S and was stopped."""
    failed: list[BaseException] = []

    def run() -> None:
        try:
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        except BaseException as e:  # noqa: BLE001 - told to the caller
            failed.append(e)

    start = time.perf_counter()
    worker = threading.Thread(target=run, daemon=True)
    worker.start()
    worker.join(LIMIT_S)
    if worker.is_alive():
        for _ in range(50):  # a query may begin one job after another
            for stream in spark.streams.active:
                stream.stop()
            spark.sparkContext.cancelAllJobs()
            worker.join(0.2)
            if not worker.is_alive():
                break
        return None
    if failed:
        raise failed[0]
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    begun = time.perf_counter()
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["etl_udf"](spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM's code paths and the Python workers
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    seconds, unfinished = {}, []
    for name in names:
        if time.perf_counter() - begun > TOTAL_S:
            unfinished.append(name)
            continue
        if os.path.isdir(small) and not name.startswith(("stream_", "run_", "rule_")):
            timed(spark, name, small)  # compile the plan before timing it
        took = timed(spark, name, folder)
        if took is None:
            unfinished.append(name)
        else:
            seconds[name] = took
        print(name, took, file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "unfinished": unfinished,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}), flush=True)
    os._exit(0)  # a stopped query may still hold a thread


if __name__ == "__main__":
    main()
