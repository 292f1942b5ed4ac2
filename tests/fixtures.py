"""Small run documents rebuilt from the format's schema."""

from __future__ import annotations

import json

LINE = {"time_s": 0.0, "share": 0.0, "python_s": 0.0, "native_s": 0.0, "system_s": 0.0, "cpu_unsplit_s": 0.0, "samples": 0, "rss_growth_mb": 0, "rss_release_mb": 0}
FRAMES = [
    {"file": "/app/main.py", "line": 3, "name": "main", "first_line": 1, "user": True},
    {"file": "/app/main.py", "line": 9, "name": "left", "first_line": 8, "user": True},
    {"file": "/app/main.py", "line": 14, "name": "right", "first_line": 13, "user": True},
    {"file": "/app/util.py", "line": 2, "name": "leaf", "first_line": 1, "user": True}]


def line(**values):
    return {**LINE, **values}


def stack(frames, seconds, thread="1", **values):
    return {"thread": thread, "thread_name": "T" + thread, "frames": frames, "python_s": seconds, "native_s": 0, "system_s": 0, "unsplit_s": 0, "samples": 1, **values}


def profile(**values):
    """Three lines, four frames, two stacks; precise mode with an exit snapshot."""
    points = [[0, 1], [1, 10], [2, 20], [3, 40], [4, 50], [5, 60]]
    doc = {
        "schema": 3, "script": "/app/main.py", "python": "3.13.0", "gil_split": True, "wall_s": 5.0, "cpu_s": 4.0, "memory_mode": "precise", "samples": 300, "interval_s": 0.01,
        "rss_kind": "current", "rss_start_mb": 20, "rss_end_mb": 70, "rss_peak_mb": 70, "peak_traced_mb": 61, "native_untraced_mb": 3, "unattributed_peak_mb": 2, "frames": 4,
        "memory_attribution": "process-observation", "memory_snapshot_at_exit": True, "file_hashes": {"/app/main.py": "aa"},
        "files": {"/app/main.py": {
            "3": line(time_s=2.0, share=0.66, python_s=1.5, native_s=0.5, samples=200, peak_mb=60, end_mb=60, leak_runs=4, func_line=1, scope="main()", assigns=["rows"], calls=["load"],
                      held_by=[{"holder": "global rows", "type": "list", "items": 10, "matching": 9}],
                      retention={"snapshots": 6, "rises": 5, "releases": 0, "growth_mb": 59, "observed_s": 5, "peak_mb": 60, "points": points}),
            "9": line(time_s=1.0, share=0.33, python_s=1.0, samples=5, peak_mb=5, end_mb=5, func_line=8, scope="left()"),
            "14": line(time_s=0.01, share=0.003, samples=1, peak_mb=30, end_mb=0, func_line=13, scope="right()")}},
        "functions": {"/app/main.py": {"1": {"name": "main", "time_s": 2.0, "python_s": 1.5, "native_s": 0.5, "system_s": 0, "peak_mb": 60, "end_line": 6},
                                       "8": {"name": "left", "time_s": 1.0, "python_s": 1.0, "native_s": 0, "system_s": 0, "peak_mb": 5, "end_line": 11}}},
        "stacks": {"frames": FRAMES, "dropped_s": 0, "depth_limited": False, "samples": [stack([0, 1, 3], 1), stack([0, 2, 3], 2, thread="2")]},
        "memory_stacks": {"depth": 4, "frames": FRAMES, "peak": {"t": 4, "total_bytes": 61_000_000, "other_bytes": 0, "stacks": [
            {"frames": [0, 1], "bytes": 60_000_000, "truncated": False}, {"frames": [0, 2], "bytes": 1_000_000, "truncated": True}]},
            "exit": {"t": 5, "total_bytes": 60_000_000, "other_bytes": 0, "stacks": [{"frames": [0, 1], "bytes": 60_000_000, "truncated": False}]}},
        "timeline": [[0, 5, 20], [1, 40, 50], [2, 2, 50], [3, 3, 60], [4, 30, 70], [5, 0, 70]], "timeline_stacks": [0, 0, 1, 1, 0, -1],
        "run": {"argv": ["--n", "5"], "started_at": "2026-01-02T03:04:05+00:00", "platform": "linux", "command": ["python", "main.py"], "cwd": "/app"},
        "gc": {"supported": True, "events": [{"t": 1, "duration_s": 0.1, "generation": 2, "collected": 3, "uncollectable": 0, "thread": 7}], "dropped_events": 0,
               "total_collections": 1, "total_pause_s": 0.1, "collected": 3, "uncollectable": 0}}
    doc.update(values)
    return {k: v for k, v in doc.items() if v is not ...}


def frame_of(spark, docs):
    """Parsed documents of (path, document or text) pairs."""
    from tracegrain.sources.profiles import parse_profiles

    rows = [(p, d if isinstance(d, str) else json.dumps(d)) for p, d in docs]
    return parse_profiles(spark.createDataFrame(rows, "path string, raw string"))
