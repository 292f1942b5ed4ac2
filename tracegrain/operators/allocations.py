"""Allocation records: sites, exact totals, outstanding blocks, bounded site lists, snapshot sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tracegrain.functions.paths import allocator_domain, enclosing_name, shown_name, site_source
from tracegrain.operators.scan import prefix_within, top_k, top_k_with_rest
from tracegrain.session import cut_lineage

SITE = ("run_id", "thread_id", "allocator", "stack_id", "native_stack_id", "native_segment_generation")


def classify(records: DataFrame, root: str, profiler_prefixes: Sequence[str] = ()) -> DataFrame:
    """Add domain, scope and source to raw allocation records."""
    r = records.withColumn("domain", allocator_domain(F.col("allocator"), F.col("native_stack")))
    r = r.withColumn("__s", site_source(F.col("python_stack"), F.lit(root), F.col("domain"), list(profiler_prefixes)))
    return r.withColumns({"scope": F.col("__s")["scope"], "source": F.col("__s")["source"]}).drop("__s")


def sites(requests: DataFrame, keys: Sequence[str] = SITE, carry: Sequence[str] = ("domain", "scope"), size: str = "size",
          count: str | None = "n_allocations", sequence: str = "sequence") -> DataFrame:
    """Requested bytes and counts per site, with the first and last event."""
    n = F.sum(count) if count else F.count(F.lit(1))
    return requests.groupBy(*keys).agg(
        *[F.min_by(c, sequence).alias(c) for c in carry], F.sum(size).alias("requested_bytes"), n.alias("allocation_count"),
        F.min(sequence).alias("first_event_sequence"), F.max(sequence).alias("last_event_sequence"))


def capped_sites(all_sites: DataFrame, keys: Sequence[str] = SITE, cap: int | None = None, group: Sequence[str] = ("run_id",)) -> DataFrame:
    """The first ``cap`` sites to appear in each run (all without one); the others only add to the omitted totals on every kept row."""
    order = [F.col("first_event_sequence").asc(), *[F.col(k).asc() for k in keys if k not in group]]
    out = top_k_with_rest(all_sites, group, order, cap, {"omitted_bytes": "requested_bytes", "omitted_allocations": "allocation_count"})
    return out.withColumnRenamed("omitted_rows", "omitted_sites").drop("rank").withColumn("summary_complete", F.col("omitted_sites") == 0)


def totals(all_sites: DataFrame) -> DataFrame:
    """Exact totals by domain and by scope and domain (scope null on the domain rows), whatever was left out of the list."""
    return all_sites.groupingSets([["run_id", "domain"], ["run_id", "scope", "domain"]], "run_id", "scope", "domain").agg(
        F.grouping("scope").cast("int").alias("all_scopes"), F.sum("requested_bytes").alias("requested_bytes"), F.sum("allocation_count").alias("allocation_count"))


def outstanding(left: DataFrame, kept: DataFrame, keys: Sequence[str] = SITE, size: str = "size", count: str = "n_allocations") -> DataFrame:
    """Blocks still allocated at the end, by their site; where the site was left out, by the record's own classification."""
    blocks = left.groupBy(*keys, "domain", "scope").agg(F.sum(size).alias("outstanding_bytes"), F.sum(count).alias("outstanding_blocks"))
    known = kept.select(*keys, F.col("domain").alias("__d"), F.col("scope").alias("__s"))
    out = blocks.join(known, list(keys), "left")
    return out.withColumns({"site_kept": F.col("__d").isNotNull(), "domain": F.coalesce("__d", "domain"), "scope": F.coalesce("__s", "scope")}).drop("__d", "__s")


def within_budget(all_sites: DataFrame, ties: Sequence[str], budget: int | None = None, group: Sequence[str] = ("run_id",),
                  row_bytes: Column | None = None) -> DataFrame:
    """The largest sites whose JSON fits the byte budget (all without one), stopping at the first that does not; the rest as omitted totals.

    Row sizes are positive, so the kept prefix is exactly the rows whose running size is within the budget. The totals left out are those of
    the group minus those of the kept rows. ``ties`` that are whole numbers help to find the cut among sites of equal size.
    """
    if budget is None:
        return all_sites.withColumns({"omitted_bytes": F.lit(0).cast("long"), "omitted_allocations": F.lit(0).cast("long")})
    group = list(group)
    size = row_bytes if row_bytes is not None else F.octet_length(F.to_json(F.struct(*[F.col(c) for c in all_sites.columns]))) + 2
    s = cut_lineage(all_sites.withColumns({"__down": -F.col("requested_bytes"), "__size": size.cast("long")}))
    kept = cut_lineage(prefix_within(s, group, ["__down", *ties], "__size", budget).drop("__down", "__size"))
    sums = [F.sum("requested_bytes").alias("__b"), F.sum("allocation_count").alias("__a")]
    parts = s.groupBy(*group).agg(*sums).unionByName(kept.groupBy(*group).agg(*sums).withColumns({"__b": -F.col("__b"), "__a": -F.col("__a")}))
    left_out = parts.groupBy(*group).agg(F.sum("__b").alias("omitted_bytes"), F.sum("__a").alias("omitted_allocations"))
    return kept.join(left_out, group)


def innermost_sites(stacks: DataFrame, keys: Sequence[str] = ("run_id", "which"), file: Column | None = None) -> DataFrame:
    """Memory held at a snapshot by the innermost user function of each stack; stacks without one count as outside.

    ``file`` maps the frame column ``f`` to the file identity used for matching (its path unless given).
    """
    inner = F.get(F.filter(F.reverse("path"), lambda f: f["user"]), F.lit(0))
    s = stacks.withColumn("f", inner)
    name = F.when(F.col("f").isNull(), F.lit("outside your code")).otherwise(enclosing_name(shown_name(F.col("f"))))
    where = F.coalesce(file if file is not None else F.col("f")["file"], F.lit(""))
    return s.groupBy(*keys, where.alias("file"), name.alias("name")).agg(
        F.min(F.col("f")["first_line"]).alias("line"), F.sum("bytes").alias("bytes"))


def snapshot_tables(stacks: DataFrame, functions: int | None = None, top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The largest sites and the largest stacks of every snapshot; all of them without a number."""
    by_function = top_k(innermost_sites(stacks), ["run_id", "which"], [F.col("bytes").desc(), F.col("file").asc(), F.col("name").asc()], functions)
    text = F.to_json("path")
    return by_function, top_k(stacks.withColumn("__t", text), ["run_id", "which"], [F.col("bytes").desc(), F.col("__t").asc()], top).drop("__t")


def memory_tables(by_stack: DataFrame, cap: int | None = None) -> DataFrame:
    """The ``cap`` largest stacks of a snapshot (all without one), the rest summed as other bytes; stacks start at their outermost user frame."""
    users = F.transform("path", lambda f: f["user"])
    first = F.greatest(F.array_position(users, True), F.lit(1)).cast("int")
    s = by_stack.withColumn("path", F.slice("path", first, F.size("path"))).withColumn("__t", F.to_json("path"))
    out = top_k_with_rest(s, ["run_id", "which"], [F.col("bytes").desc(), F.col("__t").asc()], cap, {"other_bytes": "bytes"})
    return out.drop("__t")
