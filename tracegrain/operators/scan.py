"""Ordered scans and rankings that stay distributed when one group holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(t)`` sends a whole group to one task. ``plan_scan`` counts rows per
group first (a map-side combined count of the key columns). Where no group exceeds
``spark.tracegrain.rowsPerChunk`` the scan is that plain window, and chained scans over the same groups share its
one shuffle and sort. Larger groups are cut into consecutive ranges of the order column (quantile cut points); each
range is scanned on its own, and what crosses a boundary (counts, sums, maxima, last values) comes from a table with
one row per range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracegrain.session import cut_lineage, rows_per_chunk

CHUNK = "__chunk"
MAX_SPLITS = 2048
_FAN = 32
BROADCAST_POINTS = 1_000_000  # cut points, 16 MB or less, up to which the table of splits is broadcast; past that it is joined like any other


@dataclass(frozen=True)
class ScanPlan:
    """The groups that must be split, with their cut points; ``splits`` is None when there are none.

    ``all_split`` says that the rows hold only such groups.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    splits: DataFrame | None
    all_split: bool = False
    small: bool = True

    def table(self, *columns: str) -> DataFrame:
        chosen = self.splits.select(*columns) if columns else self.splits
        return F.broadcast(chosen) if self.small else chosen


def parts(df: DataFrame, plan: ScanPlan) -> list[tuple[DataFrame, ScanPlan]]:
    """The rows of whole and of split groups with a plan for each, so a chain of scans separates them once."""
    if plan.splits is None:
        return [(df, plan)]
    large = plan.table(*plan.keys)
    return [(df.join(large, list(plan.keys), "left_anti"), replace(plan, splits=None)),
            (df.join(large, list(plan.keys), "left_semi"), replace(plan, all_split=True))]


def plan_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> ScanPlan:
    """Find groups too large for one task. Runs one counting job, and a quantile job only when such groups exist.

    The table of cut points has at most 2 * rows / rowsPerChunk entries in total; it is broadcast where it is counted to be small.
    """
    keys, lead, limit = list(keys), order[0], rows_per_chunk(df.sparkSession)
    df = df.select(*keys, lead)
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)
    if not keys:
        large = df.agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)
    if large.isEmpty():
        return ScanPlan(tuple(keys), tuple(order), None)
    if not keys:
        keys, df, large = ["__all"], df.withColumn("__all", F.lit(0)), large.withColumn("__all", F.lit(0))
    quantiles = F.expr("array(" + ",".join(f"{i / MAX_SPLITS}D" for i in range(1, MAX_SPLITS)) + ")")
    found = df.join(large, keys).groupBy(*keys).agg(
        F.first("__n").alias("__n"), F.percentile_approx(lead, quantiles, F.lit(20000)).alias("__q"))
    pieces = F.least(F.lit(MAX_SPLITS), F.ceil(F.col("__n") / F.lit(limit)).cast("int"))
    cuts = F.array_distinct(F.transform(
        F.sequence(F.lit(1), pieces - 1),
        lambda i: F.element_at("__q", F.greatest(F.lit(1), F.floor(i * MAX_SPLITS / pieces).cast("int")))))
    splits = found.select(*keys, cuts.alias("__cuts"))
    splits = splits.withColumn("__coarse", F.filter("__cuts", lambda x, i: (i + 1) % _FAN == 0))
    splits = cut_lineage(splits)
    points = splits.agg(F.sum(F.size("__cuts"))).first()[0] or 0
    return ScanPlan(tuple(keys), tuple(order), splits, small=points <= BROADCAST_POINTS)


def _range_of(value: Column) -> Column:
    """Index of the range holding ``value``: two short searches instead of one long one."""
    coarse = F.size(F.filter("__coarse", lambda c: c < value))
    fine = F.size(F.filter(F.slice("__cuts", coarse * _FAN + 1, F.lit(_FAN - 1)), lambda c: c < value))
    return coarse * _FAN + fine


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    plan: ScanPlan | None = None,
    prev: Mapping[str, Column] | None = None,
    next: Mapping[str, Column] | None = None,
    fill: Mapping[str, Column] | None = None,
    backfill: Mapping[str, Column] | None = None,
    run_sum: Mapping[str, Column] | None = None,
    run_max: Mapping[str, Column] | None = None,
    before_max: Mapping[str, Column] | None = None,
    row_number: str | None = None,
    total: str | None = None,
) -> DataFrame:
    """Add ordered-scan columns to ``df``. Keys must not be null; ``order`` must be a total order.

    prev / next: the neighbouring row's value. fill / backfill: nearest non-null value strictly before / after.
    run_sum, run_max: running aggregate including the row; before_max: excluding it. row_number: 1-based.
    total: rows in the group. The first order column must be numeric or a timestamp. ``plan`` is shared by scans over
    the same rows; its keys may be a subset of ``keys``.
    """
    groups = {"prev": prev, "next": next, "fill": fill, "backfill": backfill, "run_sum": run_sum, "run_max": run_max, "before_max": before_max}
    wanted = [(kind, name, expr) for kind, columns in groups.items() for name, expr in (columns or {}).items()]
    keys, order = list(keys), list(order)
    plan = plan or plan_scan(df, keys, order)
    added = [name for _, name, _ in wanted] + [n for n in (row_number, total) if n]
    keep = [c for c in df.columns if c not in added]
    rows = df.select("*", *[expr.alias(f"__in_{name}") for _, name, expr in wanted])
    if plan.splits is None:
        out = _whole(rows, keys, order, wanted, row_number, total)
        return out.select(*keep, *[F.col(f"__out_{n}").alias(n) for n in added])
    if "__all" in plan.keys:
        rows, keys = rows.withColumn("__all", F.lit(0)), ["__all", *keys]
    large = rows.join(plan.table(), list(plan.keys)).withColumn(CHUNK, _range_of(F.col(order[0]))).drop("__cuts", "__coarse")
    large = _split(large, keys, order, wanted, row_number, total)
    columns = [*keep, *[F.col(f"__out_{n}").alias(n) for n in added]]
    if plan.all_split:
        return large.select(*columns)
    small = _whole(rows.join(plan.table(*plan.keys), list(plan.keys), "left_anti"), keys, order, wanted, row_number, total)
    return small.select(*columns).unionByName(large.select(*columns))


def _windows(part: list[str], order: list[str]):
    forward = Window.partitionBy(*part).orderBy(*[F.col(c).asc() for c in order])
    backward = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
    return forward, backward


def _over(kind: str, name: str, forward, backward) -> Column:
    x = F.col(f"__in_{name}")
    if kind == "prev":
        return F.lag(x).over(forward)
    if kind == "next":
        return F.lead(x).over(forward)
    if kind == "fill":
        return F.last(x, ignorenulls=True).over(forward.rowsBetween(Window.unboundedPreceding, -1))
    if kind == "backfill":  # in reverse order, as a frame open towards the end would be rescanned for every row
        return F.last(x, ignorenulls=True).over(backward.rowsBetween(Window.unboundedPreceding, -1))
    if kind == "before_max":
        return F.max(x).over(forward.rowsBetween(Window.unboundedPreceding, -1))
    return (F.sum if kind == "run_sum" else F.max)(x).over(forward.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _whole(rows: DataFrame, keys: list[str], order: list[str], wanted: list, row_number: str | None, total: str | None) -> DataFrame:
    forward, backward = _windows(keys, order)
    out = {f"__out_{name}": _over(kind, name, forward, backward) for kind, name, _ in wanted}
    if row_number:
        out[f"__out_{row_number}"] = F.row_number().over(forward).cast("long")
    if total:
        out[f"__out_{total}"] = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.withColumns(out)


def _split(rows: DataFrame, keys: list[str], order: list[str], wanted: list, row_number: str | None, total: str | None) -> DataFrame:
    part = [*keys, CHUNK]
    forward, backward = _windows(part, order)
    local: dict[str, Column] = {}
    for kind, name, _ in wanted:
        if kind in ("prev", "next"):  # a struct tells a null neighbour from no neighbour
            x = F.struct(F.col(f"__in_{name}").alias("v"))
            local[f"__l_{name}"] = (F.lag if kind == "prev" else F.lead)(x).over(forward)
        else:
            local[f"__l_{name}"] = _over(kind, name, forward, backward)
    if row_number:
        local["__l_rn"] = F.row_number().over(forward)
    rows = cut_lineage(rows.withColumns(local))  # read twice below

    rank = F.struct(*order)
    parts = [F.count(F.lit(1)).alias("__n")]
    for kind, name, _ in wanted:
        x = F.col(f"__in_{name}")
        known = F.when(x.isNotNull(), rank)
        parts.append({
            "prev": lambda: F.max_by(F.struct(x.alias("v")), rank), "next": lambda: F.min_by(F.struct(x.alias("v")), rank),
            "fill": lambda: F.max_by(x, known), "backfill": lambda: F.min_by(x, known),
            "run_sum": lambda: F.sum(x), "run_max": lambda: F.max(x), "before_max": lambda: F.max(x)}[kind]().alias(f"__s_{name}"))
    summary = rows.groupBy(*part).agg(*parts)  # one row per range
    ahead = Window.partitionBy(*keys).orderBy(F.col(CHUNK).asc()).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum("__n").over(ahead).alias("__c_before"), F.sum("__n").over(Window.partitionBy(*keys)).alias("__c_total")]
    for kind, name, _ in wanted:
        x = F.col(f"__s_{name}")
        carried.append({
            "prev": lambda: F.last(x, ignorenulls=True).over(ahead), "fill": lambda: F.last(x, ignorenulls=True).over(ahead),
            "next": lambda: F.last(x, ignorenulls=True).over(behind), "backfill": lambda: F.last(x, ignorenulls=True).over(behind),
            "run_sum": lambda: F.sum(x).over(ahead), "run_max": lambda: F.max(x).over(ahead),
            "before_max": lambda: F.max(x).over(ahead)}[kind]().alias(f"__c_{name}"))
    joined = rows.join(summary.select(*part, *carried), part)

    out: dict[str, Column] = {}
    for kind, name, _ in wanted:
        l, c = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        out[f"__out_{name}"] = {
            "prev": lambda: F.coalesce(l, c)["v"], "next": lambda: F.coalesce(l, c)["v"], "fill": lambda: F.coalesce(l, c),
            "backfill": lambda: F.coalesce(l, c), "run_sum": lambda: F.when(l.isNull(), c).when(c.isNull(), l).otherwise(l + c),
            "run_max": lambda: F.greatest(l, c), "before_max": lambda: F.greatest(l, c)}[kind]()
    if row_number:
        out[f"__out_{row_number}"] = (F.col("__l_rn") + F.coalesce("__c_before", F.lit(0))).cast("long")
    if total:
        out[f"__out_{total}"] = F.col("__c_total")
    return joined.withColumns(out)


_PUSHED_LIMIT = 999  # Spark prunes ranked rows before the shuffle up to this many per group


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group by a total order, with their 1-based rank; all rows, unranked, without a ``k``.

    Small k relies on Spark's group limit below the shuffle; larger k first ranks inside hash slices
    of the group, so no task orders a whole large group.
    """
    keys = list(keys)
    if k is None:
        return df
    if k > _PUSHED_LIMIT:
        slices = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        slice_of = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t]), F.lit(slices))
        inner = Window.partitionBy(*keys, "__slice").orderBy(*order)
        df = df.withColumn("__slice", slice_of).withColumn("__r", F.row_number().over(inner))
        df = df.where(F.col("__r") <= k).drop("__slice", "__r")
    outer = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= k)


def top_k_with_rest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None, measures: Mapping[str, str]) -> DataFrame:
    """``top_k`` plus, on every kept row, the count and sums of what was left out of its group: nothing without a ``k``.

    The remainder is the group total minus the kept rows, so the full group is never ranked.
    """
    keys = list(keys)
    if k is None:
        types = dict(df.dtypes)
        zero = {name: F.lit(0).cast("double" if types[src] in ("double", "float") else "long") for name, src in measures.items()}
        return df.withColumns({"omitted_rows": F.lit(0).cast("long"), **zero})
    kept = top_k(df, keys, order, k)
    totals = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__rows"), *[F.sum(src).alias(f"__t_{name}") for name, src in measures.items()])
    # The row of totals joins the kept rows of its group as one more row of the window, whatever the keys are.
    both = kept.withColumn("__keep", F.lit(True)).unionByName(totals.withColumn("__keep", F.lit(False)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys)
    both = both.withColumns({
        "omitted_rows": F.max("__rows").over(inside) - F.count_if("__keep").over(inside),
        **{name: F.max(f"__t_{name}").over(inside) - F.sum(F.when(F.col("__keep"), F.col(src))).over(inside) for name, src in measures.items()}})
    return both.where("__keep").drop("__keep", "__rows", *[f"__t_{n}" for n in measures])


BINS = 256
LAST_ROWS = 10_000  # rows around the cut that one task puts in order


def prefix_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str, limit: int) -> DataFrame:
    """The rows of each group, in ascending order, whose running sum of ``weight`` stays within ``limit``.

    ``order`` starts with one or more whole-number columns and may end with others. Nothing is sorted to find the cut: a histogram of the
    first column over each group's range says in which of BINS bins the sum passes the limit, and that bin is cut up again, then the next
    number column where all its rows have one value, until it has LAST_ROWS rows or fewer, or no number column is left. Only those rows are put in order. A
    round is one aggregate over the rows of the open bins; rounds grow with the logarithm of the range. Weights must be positive.
    """
    keys, order = list(keys), list(order)
    types = dict(df.dtypes)
    numbers = []
    for c in order:
        if types[c] not in ("tinyint", "smallint", "int", "bigint"):
            break
        numbers.append(c)
    rows = df.withColumn("__code", F.array(*[F.col(c).cast("long") for c in numbers]))
    rows = cut_lineage(rows)  # every round reads it
    last = len(numbers) - 1
    none = F.expr("cast(array() as array<bigint>)")

    # The open bin of a group: codes equal to `fixed` up to a level, and between lo and hi there; `base` is the weight before it.
    cuts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum(weight).alias("__all"), F.min(F.col("__code")[0]).alias("__lo"), F.max(F.col("__code")[0]).alias("__hi"))
    cuts = cuts.select(*keys, "__n", "__lo", "__hi", none.alias("__fixed"), F.lit(0).cast("long").alias("__base"), (F.col("__all") <= limit).alias("__whole"),
                       (F.col("__n") > LAST_ROWS).alias("__many"))
    cuts = cut_lineage(cuts)

    def inside(level: Column) -> Column:
        value = F.get("__code", level)
        return (F.slice("__code", F.lit(1), level) == F.col("__fixed")) & (value >= F.col("__lo")) & (value <= F.col("__hi"))

    finished = (F.col("__n") <= LAST_ROWS) | F.col("__whole") | ((F.col("__lo") == F.col("__hi")) & (F.size("__fixed") >= last))
    while not cuts.where(~finished).isEmpty():
        # A bin of one value goes on with the next column.
        deeper = F.col("__lo") == F.col("__hi")
        open_ = cuts.where(~finished).withColumn("__fixed", F.when(deeper, F.concat("__fixed", F.array("__lo"))).otherwise(F.col("__fixed"))).withColumn("__deeper", deeper)
        # A group that is still open had more than LAST_ROWS rows, so there are few of them; a join by key would put each whole group into one task.
        here = rows.join(F.broadcast(open_.withColumn("__lo", F.when(F.col("__deeper"), F.lit(None)).otherwise(F.col("__lo")))), keys)
        value = F.get("__code", F.size("__fixed"))
        same = F.slice("__code", F.lit(1), F.size("__fixed")) == F.col("__fixed")
        here = here.where(same & (F.col("__lo").isNull() | ((value >= F.col("__lo")) & (value <= F.col("__hi"))))).withColumn("__v", value)
        # Bins by the width of the known range; at a new column, by its leading bits until the range is known.
        width = F.greatest(F.ceil((F.col("__hi") - F.col("__lo") + 1) / F.lit(BINS)).cast("long"), F.lit(1))
        bin_ = F.when(F.col("__lo").isNull(), F.shiftright(F.col("__v"), 56)).otherwise(F.floor((F.col("__v") - F.col("__lo")) / width).cast("long"))
        bins = here.groupBy(*keys, "__fixed", "__base", bin_.alias("__bin")).agg(
            F.count(F.lit(1)).alias("__n"), F.sum(weight).alias("__w"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        ahead = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # BINS rows of a group at most
        placed = bins.withColumn("__upto", F.col("__base") + F.sum("__w").over(ahead))
        crossing = placed.where((F.col("__upto") > limit) & (F.col("__upto") - F.col("__w") <= limit))
        crossing = crossing.select(*keys, "__n", "__lo", "__hi", "__fixed", (F.col("__upto") - F.col("__w")).alias("__base"), F.lit(False).alias("__whole"), F.lit(True).alias("__many"))
        cuts = cut_lineage(cuts.where(finished).unionByName(crossing))

    # Groups of up to LAST_ROWS rows meet their cut by key; the few larger ones, which one task need not hold, have theirs sent to the rows.
    many = F.broadcast(cut_lineage(cuts.where("__many")))
    few = cuts.where(~F.col("__many"))
    known = rows.join(many, keys).unionByName(rows.join(many.select(*keys), keys, "left_anti").join(few, keys)).drop("__many")
    before = known.where(F.col("__whole") | (F.col("__code") < F.concat("__fixed", F.array("__lo")))).select(*df.columns)
    at_cut = known.where(~F.col("__whole") & inside(F.size("__fixed")))
    running = F.sum(weight).over(Window.partitionBy(*keys, "__lo").orderBy(*[F.col(c).asc() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return before.unionByName(at_cut.withColumn("__used", F.col("__base") + running).where(F.col("__used") <= limit).select(*df.columns))
