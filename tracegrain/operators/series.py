"""Time series of a run: deltas, phases, alerts, thinning."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracegrain.operators.scan import ScanPlan, parts, plan_scan, scan
from tracegrain.session import cut_lineage, rows_per_chunk

PIECE = 1 << 16  # consecutive points of a run whose stretches one task finds at a time
MIB = 1 << 20


def observation_deltas(points: DataFrame, keys: Sequence[str], order: Sequence[str], traced: str = "traced", rss: str = "rss",
                       interval_peak: str | None = None) -> DataFrame:
    """Growth of traced memory (never negative) and signed change of RSS; null when either point was not measured.

    With ``interval_peak`` also the transient part: the peak between two points above both of them.
    """
    s = scan(points, keys, order, prev={"__t": F.col(traced), "__r": F.col(rss)}, row_number="__i")
    first = F.col("__i") == 1
    grown = F.when(first, F.lit(0)).otherwise(F.greatest(F.lit(0), F.col(traced) - F.col("__t")))
    out = s.withColumn("traced_growth", F.when(F.col(traced).isNotNull() & (first | F.col("__t").isNotNull()), grown))
    out = out.withColumn("rss_change", F.col(rss) - F.col("__r"))
    if interval_peak:
        above = F.col(interval_peak) - F.greatest(F.col(traced), F.coalesce("__t", F.lit(0)))
        out = out.withColumn("transient", F.when(F.col(traced).isNotNull(), F.greatest(F.lit(0), above)))
    return out.drop("__t", "__r", "__i")


def phases(points: DataFrame, depth: int | Sequence[int] | None, keys: Sequence[str] = ("run_id",), order: Sequence[str] = ("t", "seq"),
           traced: str = "traced", rss: str = "rss", start_rss: str | None = None) -> DataFrame:
    """Stretches of the run in one function at a depth of the main thread's path.

    ``path`` is an array of function keys, outermost first. A stretch continues over up to two points whose
    path is too short, and those points count for its peaks. new_rss is the memory above everything earlier.
    ``depth`` may name several depths, or all that occur (None).

    A point needs only the three before it to know at which depths it goes on with a stretch: the lengths they share with its path. So one ordered scan
    serves every depth, rows are not multiplied by depth, and what is shuffled after it are pieces of stretches.
    """
    depths = depth if depth is None else [depth] if isinstance(depth, int) else sorted(set(depth))
    plan = plan_scan(points, keys, order)
    return _in_parts(points, plan, lambda rows, part: _joined_pieces(_pieces(rows, list(keys), order, depths, traced, rss, start_rss, part), [*keys, "depth"], part))


def phases_all_depths(points: DataFrame, keys: Sequence[str] = ("run_id",), **columns) -> DataFrame:
    """Phases at every depth that occurs in the run."""
    return phases(points, None, keys, **columns)


def _in_parts(df: DataFrame, plan: ScanPlan, run) -> DataFrame:
    return reduce(DataFrame.unionByName, [run(rows, part) for rows, part in parts(df, plan)])


def _shared(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.coalesce(F.when(differs == 0, F.size(a)).otherwise(differs - 1), F.lit(0)).cast("int")


def _pieces(p: DataFrame, keys: list[str], order: Sequence[str], depths: list[int] | None, traced: str, rss: str, start_rss: str | None, plan: ScanPlan) -> DataFrame:
    """Stretches of every depth within blocks of consecutive points; ``opens`` is 0 where one goes on from an earlier block."""
    lead = order[0]
    s = scan(p, keys, order, plan=plan, row_number="__i", next={"__next": F.col(lead)}, before_max={"__seen": F.col(rss)},
             prev={"__p1": F.col("path"), "__t1": F.col(traced), "__r1": F.col(rss)})
    s = scan(s, keys, order, plan=plan, prev={"__p2": F.col("__p1"), "__t2": F.col("__t1"), "__r2": F.col("__r1")})
    s = scan(s, keys, order, plan=plan, prev={"__p3": F.col("__p2")})
    resident = F.coalesce("__seen", *([F.col(start_rss)] if start_rss else []), F.col(rss))
    if start_rss:
        resident = F.greatest(resident, F.col(start_rss))
    size = min(PIECE, rows_per_chunk(p.sparkSession))
    length = {n: F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0))).alias(n) for n, c in (("l0", "path"), ("l1", "__p1"), ("l2", "__p2"))}
    shared = [_shared(F.col("path"), F.col(f"__p{j}")).alias(f"c{j}") for j in (1, 2, 3)]
    rows = s.select(*keys, F.floor((F.col("__i") - 1) / size).cast("long").alias("block"), F.col("__i").alias("i"), F.col(lead).alias("from"),
                    F.coalesce("__next", lead).alias("to"), F.col(traced).alias("t0"), F.col("__t1").alias("t1"), F.col("__t2").alias("t2"),
                    F.col(rss).alias("r0"), F.col("__r1").alias("r1"), F.col("__r2").alias("r2"), resident.alias("resident"), *length.values(), *shared, "path")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "depth int", "opens int", "first bigint", "last bigint", f"`from` {types['from']}", f"`to` {types['to']}",
                        f"path {types['path']}", f"resident {types['resident']}", f"peak_traced {types['t0']}", f"peak_rss {types['r0']}"])
    found = rows.groupBy(*keys, "block").applyInArrow(lambda table: block_pieces(table, keys, depths), schema)
    return found.withColumn("path", F.slice("path", F.lit(1), F.col("depth") + 1))


def block_pieces(table, keys: Sequence[str], depths: Sequence[int] | None):
    """The pieces of one block of consecutive points: at each depth the points whose path reaches it, cut where one does not go on with an earlier one."""
    import numpy as np
    import pyarrow as pa

    table = table.sort_by("i")
    number = {c: table[c].to_numpy() for c in ("i", "l0", "l1", "l2", "c1", "c2", "c3")}
    values, lagged = {}, {}
    for v in ("t", "r"):
        values[v], lagged[v] = _measured(table[f"{v}0"]), [_measured(table[f"{v}{j}"]) for j in (1, 2)]
    reach = np.arange(table.num_rows)
    out = {"depth": [], "opens": [], "first": [], "last": [], "t": [], "r": []}
    deepest = int(number["l0"].max(initial=0))
    for d in range(deepest) if depths is None else [d for d in depths if d < deepest]:
        reach = reach[number["l0"][reach] > d]
        l1, l2, c1, c2, c3 = (number[c][reach] for c in ("l1", "l2", "c1", "c2", "c3"))
        near = [d < c1, (d >= l1) & (d < c2), (d >= l1) & (d >= l2) & (d < c3)]  # goes on with the point 1, 2 or 3 before
        fresh = ~(near[0] | near[1] | near[2])
        begins = fresh.copy()
        begins[0] = True
        at = np.flatnonzero(begins)
        first, last = reach[at], reach[np.append(at[1:], len(reach)) - 1]
        for v in ("t", "r"):
            ends = np.stack([first, last + 1], 1).ravel()
            peak = np.maximum.reduceat(np.append(values[v], values[v][:1]), ends)[::2]
            if not fresh[0]:  # too short paths between the earlier block's piece and this one's first point
                for gap in (1, 2):
                    if near[gap][0]:
                        peak[0] = max([peak[0], *[lagged[v][j][first[0]] for j in range(gap)]])
            out[v].append(peak)
        out["depth"].append(np.full(len(at), d, np.int32))
        out["opens"].append(fresh[at].astype(np.int32))
        out["first"].append(first)
        out["last"].append(last)
    merged = {c: np.concatenate(x) if x else np.empty(0, np.int64) for c, x in out.items()}
    first, last = table.take(pa.array(merged["first"], pa.int64())), table.take(pa.array(merged["last"], pa.int64()))
    columns = {**{k: first[k] for k in keys}, "depth": pa.array(merged["depth"], pa.int32()), "opens": pa.array(merged["opens"], pa.int32()), "first": first["i"],
               "last": last["i"], "from": first["from"], "to": last["to"], "path": first["path"], "resident": first["resident"],
               "peak_traced": _column(merged["t"], table["t0"].type), "peak_rss": _column(merged["r"], table["r0"].type)}
    return pa.table(columns)


def _measured(column):
    """Numbers of a column with the lowest value for null."""
    import numpy as np
    import pyarrow as pa

    whole = pa.types.is_integer(column.type)
    lowest = np.iinfo(np.int64).min if whole else -np.inf
    return column.cast(pa.int64() if whole else pa.float64()).fill_null(lowest).to_numpy()


def _column(numbers, kind):
    import numpy as np
    import pyarrow as pa

    if pa.types.is_integer(kind):
        return pa.array(numbers, pa.int64(), mask=numbers == np.iinfo(np.int64).min).cast(kind)
    return pa.array(numbers, pa.float64(), mask=numbers == -np.inf).cast(kind)


def _joined_pieces(pieces: DataFrame, keys: list[str], part: ScanPlan) -> DataFrame:
    if part.splits is None:  # a run that is no longer than a chunk has no more pieces of a depth than that
        s = scan(pieces, keys, ["first"], plan=ScanPlan(tuple(keys), ("first",), None), run_sum={"phase": F.col("opens")})
    else:
        s = scan(cut_lineage(pieces), keys, ["first"], run_sum={"phase": F.col("opens")})
    out = s.groupBy(*keys, "phase").agg(
        F.min_by("path", "first").alias("path"), F.min_by("from", "first").alias("from"), F.max_by("to", "last").alias("to"), F.max("peak_traced").alias("peak_traced"),
        F.max("peak_rss").alias("peak_rss"), F.min_by("resident", "first").alias("__resident"), (F.max("last") - F.min("first") + 1).alias("points"))
    return out.select(*keys, "phase", "path", "from", "to", (F.col("to") - F.col("from")).alias("seconds"),
                      "peak_traced", "peak_rss", F.greatest(F.lit(0), F.col("peak_rss") - F.col("__resident")).alias("new_rss"), "points")


def choose_depth(found: DataFrame, wall: DataFrame, keys: Sequence[str] = ("run_id",), few: int = 3, many: int = 12) -> DataFrame:
    """The depth of each run whose phases divide it best.

    The shallowest depth with 3 to 12 long phases (at least 1% of ``wall``) that cover 90% of the run with none over
    half of it; else the deepest covering 90%; else 0.
    """
    long = found.join(wall, list(keys)).where(F.col("seconds") >= 0.01 * F.col("wall"))
    per = long.groupBy(*keys, "depth").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("covered"),
                                           F.max("seconds").alias("largest"), F.first("wall").alias("wall"))
    covering = per.where(F.col("covered") >= 0.9 * F.col("wall"))
    good = F.col("n").between(few, many) & (F.col("largest") <= 0.5 * F.col("wall"))
    best = covering.groupBy(*keys).agg(F.min(F.when(good, F.col("depth"))).alias("__good"), F.max("depth").alias("__deep"))
    return wall.join(best, list(keys), "left").select(*keys, F.coalesce("__good", "__deep", F.lit(0)).alias("depth"))


def phases_auto(points: DataFrame, wall: DataFrame, keys: Sequence[str] = ("run_id",), **columns) -> DataFrame:
    """Phases at the automatically chosen depth. ``wall``: (keys, wall) with the run's duration."""
    found = cut_lineage(phases_all_depths(points, keys, **columns))  # read by the choice and its result
    return found.join(choose_depth(found, wall, keys), [*keys, "depth"])


def spikes(points: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, jump: int = 10 * MIB, high: int = 5 * MIB) -> DataFrame:
    """Alert rows of a memory series.

    spike: a jump since the previous point over half of it and ``jump`` bytes. plateau: the fifth point in a row
    without a new high (1% over the running maximum) while still within 10% of it. doubling: the running maximum passes
    twice the power-of-two multiple of ``high`` it last passed.
    """
    return _in_parts(points, plan_scan(points, keys, order), lambda rows, part: _alerts(rows, keys, order, F.col(value), jump, high, part))


def _alerts(points: DataFrame, keys: Sequence[str], order: Sequence[str], v: Column, jump: int, high: int, plan: ScanPlan) -> DataFrame:
    s = scan(points, keys, order, plan=plan, prev={"__prev": v}, before_max={"__high": v}, row_number="__i")
    raised = F.col("__high").isNull() | (v > F.col("__high") * 1.01)
    s = s.withColumns({"__raised": raised, "__top": F.greatest(v, F.col("__high"))})
    s = scan(s, keys, order, plan=plan, run_max={"__last_raise": F.when(F.col("__raised"), F.col("__i"))})
    stalled = F.col("__i") - F.col("__last_raise")

    def level(x: Column) -> Column:
        return F.when(x >= high, F.floor(F.log2(x / high))).otherwise(F.lit(-1))

    out = s.withColumns({
        "spike": F.coalesce(v - F.col("__prev") > F.greatest(F.col("__prev") * 0.5, F.lit(jump)), F.lit(False)),
        "plateau": (stalled == 5) & (F.col("__top") > high) & (v >= 0.9 * F.col("__top")),
        "doubling": level(F.col("__top")) > level(F.coalesce("__high", F.lit(0)))})
    return out.where("spike or plateau or doubling").drop("__prev", "__high", "__i", "__raised", "__top", "__last_raise")


def thin(points: DataFrame, keys: Sequence[str], order: Sequence[str], most: int = 300) -> DataFrame:
    """At most ``most`` evenly spaced points of each series, the last one always among them."""
    s = scan(points, keys, order, row_number="__i", total="__n")
    stride = F.greatest(F.lit(1), F.ceil(F.col("__n") / (most - 1))).cast("long")
    return s.where(((F.col("__i") - 1) % stride == 0) | (F.col("__i") == F.col("__n"))).drop("__i", "__n")


def representative(points: DataFrame, keys: Sequence[str], order: Sequence[str], most: int = 60) -> DataFrame:
    """At most ``most`` points including both ends, at half-even rounded even spacing."""
    s = scan(points, keys, order, row_number="__i", total="__n")
    last = F.col("__n") - 1
    steps = F.least(F.lit(most - 1), last)
    # A position is kept when some step index rounds to it; only the two nearest can.
    at = F.col("__i") - 1
    near = F.floor(at * steps / last)
    hit = F.lit(False)
    for k in (near - 1, near, near + 1):
        valid = (k >= 0) & (k <= steps)
        hit = hit | (valid & (F.bround(k * last / steps) == at))
    return s.where(F.when(F.col("__n") <= 1, F.lit(True)).otherwise(hit)).drop("__i", "__n")


def thin_halving(points: DataFrame, keys: Sequence[str], order: Sequence[str], cap: int = 600) -> DataFrame:
    """The points an online recorder keeps that halves its list whenever it reaches ``cap``; the end point always stays."""
    s = scan(points, keys, order, row_number="__i", total="__n")
    last = F.col("__n") - 1
    # Smallest power of two 2^k with floor(last / 2^k) + 1 < cap.
    k = F.greatest(F.lit(0), F.ceil(F.log2((last + 1) / (cap - 1)))).cast("int")
    stride = F.call_function("shiftleft", F.lit(1).cast("long"), k)
    return s.where(((F.col("__i") - 1) % stride == 0) | (F.col("__i") == F.col("__n"))).drop("__i", "__n")


def increasing_violations(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows per group whose value does not exceed the previous row's."""
    s = scan(df, keys, order, prev={"__p": F.col(value)})
    return s.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("__p") >= F.col(value)).alias("violations"))
