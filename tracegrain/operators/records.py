"""Typed record workloads: normalisation, net amounts, rollups, exact comparison."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tracegrain.functions.measures import net_cents
from tracegrain.schemas import DEFAULTS, NESTED_FIELDS, RECORDS


def normalize_records(raw: DataFrame) -> DataFrame:
    """Completed rows, typed and defaulted. The status filter runs before any cast."""
    def defaulted(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(DEFAULTS[name]))

    kept = raw.where(defaulted("status") == "completed")
    return kept.select(
        F.col("id").cast("long").alias("id"),
        (F.col("amount").cast("decimal(18,2)") * 100).cast("long").alias("amount_cents"),
        defaulted("region").alias("region"), defaulted("quantity").cast("long").alias("quantity"),
        defaulted("status").alias("status"), F.col("user_id").cast("long").alias("user_id"),
        F.upper(defaulted("country")).alias("country"), defaulted("discount_bps").cast("long").alias("discount_bps"),
        F.to_timestamp("created_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"),
        "product", "note", defaulted("source").alias("source"))


def native_records(raw: DataFrame) -> DataFrame:
    """Normalised records with the net amount, all in built-in expressions."""
    return normalize_records(raw).withColumn(
        "net_amount_cents", net_cents(F.col("amount_cents"), F.col("quantity"), F.col("discount_bps")))


def udf_records(raw: DataFrame) -> DataFrame:
    """The same records through an Arrow-batched Python function."""
    @F.pandas_udf(T.LongType())
    def net(amount: pd.Series, quantity: pd.Series, bps: pd.Series) -> pd.Series:
        return amount * quantity * (10_000 - bps) // 10_000

    return normalize_records(raw).withColumn("net_amount_cents", net("amount_cents", "quantity", "discount_bps"))


def row_loop_records(raw: DataFrame) -> DataFrame:
    """The same contract as a per-batch Python loop, the slow yardstick of the workload."""
    typed = normalize_records(raw)

    def loop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["net_amount_cents"] = [
                a * q * (10_000 - d) // 10_000
                for a, q, d in zip(batch["amount_cents"], batch["quantity"], batch["discount_bps"])]
            yield batch

    return typed.mapInPandas(loop, RECORDS)


def normalize_nested(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Nested records from a JSON column ``value``; broken rules are listed per row, or raised when strict.

    Cancelled rows are dropped after validation. Rows with violations keep null fields in lenient mode.
    """
    # One-element explodes keep the optimizer from repeating a step in every expression that reads its result: text, fields, rules.
    once = lambda c: F.explode(F.array(c))
    doc = raw.select(once(F.struct(F.try_parse_json("value").alias("v"), F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")).alias("keys"))).alias("__p"))
    read: dict[str, Column] = {"keys": F.col("__p.keys")}

    def field(kind: str, name: str, c: Column) -> Column:
        read[f"{kind}_{name}"] = c
        return F.col("__f")[f"{kind}_{name}"]

    def get(name: str, kind: str) -> Column:
        return field(kind.strip("<>").replace("<", "_"), name, F.try_variant_get("__p.v", f"$.{name}", kind))

    def kind_of(name: str) -> Column:
        return field("kind", name, F.schema_of_variant(F.try_variant_get("__p.v", f"$.{name}", "variant")))

    def cast(name: str, kind: str) -> Column:
        return field("cast", name, F.try_variant_get("__p.v", f"$.{name}", "string").try_cast(kind))

    keys = F.col("__f.keys")
    has = {f: F.array_contains(keys, f) for f in NESTED_FIELDS}
    present = {f: has[f] & (kind_of(f) != "VOID") for f in NESTED_FIELDS}
    amount = cast("amount", "decimal(38,10)")
    cents_exact = amount * 100
    number = {n: cast(n, "bigint") for n in ("id", "quantity", "user_id")}
    stamp_text = get("created_at", "string")
    zoned = stamp_text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    stamp = F.try_to_timestamp(stamp_text)
    status = F.lower(F.coalesce(get("status", "string"), F.lit("completed")))
    active_text = get("active", "string")
    tags_ok = kind_of("tags").isin("ARRAY<STRING>", "ARRAY<VOID>") | F.coalesce(F.to_json(get("tags", "variant")) == "[]", F.lit(False))
    meta_ok = kind_of("metadata").startswith("OBJECT")
    checks = {
        "not an object": ~F.coalesce(field("kind", "document", F.schema_of_variant("__p.v")).startswith("OBJECT"), F.lit(False)),
        "missing id or amount": ~(has["id"] & has["amount"]),
        "unknown fields": F.size(F.array_except(keys, F.array(*[F.lit(f) for f in NESTED_FIELDS]))) > 0,
        "amount is not a nonnegative number of cents": has["amount"] & ~F.coalesce((amount >= 0) & (cents_exact == F.floor(cents_exact)), F.lit(False)),
        "id is not a nonnegative integer": has["id"] & ~F.coalesce(number["id"] >= 0, F.lit(False)),
        "quantity is not a positive integer": has["quantity"] & ~F.coalesce(number["quantity"] >= 1, F.lit(False)),
        "user_id is not a nonnegative integer": present["user_id"] & ~F.coalesce(number["user_id"] >= 0, F.lit(False)),
        "created_at needs a timezone": present["created_at"] & ~F.coalesce(zoned & stamp.isNotNull(), F.lit(False)),
        "unknown status": ~F.coalesce(status.isin("completed", "cancelled"), F.lit(False)),
        "active is not a boolean": present["active"] & ~F.coalesce(active_text.isin("true", "false"), F.lit(False)),
        "tags is not an array of strings": has["tags"] & ~F.coalesce(tags_ok, F.lit(False)),
        "metadata is not an object": has["metadata"] & ~F.coalesce(meta_ok, F.lit(False)),
        **{f"{f} is not a string": has[f] & ~F.coalesce(kind_of(f) == "STRING", F.lit(False)) for f in ("product", "country", "currency")},
    }
    values = {
        "id": number["id"], "amount_cents": cents_exact.cast("long"), "user_id": number["user_id"],
        "created_at": F.when(present["created_at"], F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")), "status": status,
        "currency": F.upper(F.coalesce(get("currency", "string"), F.lit("USD"))), "quantity": F.coalesce(number["quantity"], F.lit(1)), "product": get("product", "string"),
        "country": F.upper(get("country", "string")), "active": F.coalesce(active_text == "true", F.lit(True)),
        "tags": F.coalesce(get("tags", "array<string>"), F.array().cast("array<string>")), "metadata": F.coalesce(F.to_json(get("metadata", "variant")), F.lit("{}"))}
    violations = F.array_compact(F.array(*[F.when(c, F.lit(m)) for m, c in checks.items()]))
    if strict:
        violations = F.transform(F.array(violations), lambda v: F.when(F.size(v) > 0, F.raise_error(
            F.concat(F.lit("bad record: "), F.array_join(v, "; "))).cast("array<string>")).otherwise(v))[0]
    fields = doc.select(once(F.struct(*[c.alias(n) for n, c in read.items()])).alias("__f"))
    out = fields.select("__f", once(violations).alias("violations"))
    good = F.size("violations") == 0
    out = out.where(~(good & (status == "cancelled")))
    return out.select(*[F.when(good, c).alias(n) for n, c in values.items()], "violations")


def rollup_by_region(records: DataFrame) -> DataFrame:
    return records.groupBy("region").agg(F.count(F.lit(1)).alias("records"), F.sum("net_amount_cents").alias("revenue_cents"))


def record_stats(records: DataFrame, id_col: str = "id") -> DataFrame:
    """Whole-set statistics: rows, revenue, distinct ids, rows missing a required value."""
    required = [f.name for f in RECORDS if f.name not in ("user_id", "created_at", "product", "note")]
    bad = F.col("status") != "completed"
    for name in required:
        bad = bad | F.col(name).isNull()
    return records.agg(
        F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("net_amount_cents"), F.lit(0)).alias("revenue_cents"),
        F.count_distinct(id_col).alias("unique_ids"), F.coalesce(F.sum(F.when(bad, 1).otherwise(0)), F.lit(0)).alias("bad_rows"))


def filtered_sum(df: DataFrame, key: str, value: str, above: float) -> DataFrame:
    """Sum of the values above a threshold per key."""
    return df.where(F.col(value) > above).groupBy(key).agg(F.sum(value).alias("total"))


def even_square_total(df: DataFrame, col: str) -> DataFrame:
    """Sum of the even squares of a whole-number column, exact to 38 digits: neither a square nor the sum need fit 64 bits."""
    number = F.col(col).cast("decimal(19,0)")
    return df.select((number * number).alias("x")).where(F.col("x") % 2 == 0).agg(F.sum("x").cast("decimal(38,0)").alias("total"))


def report_length(df: DataFrame, col: str) -> DataFrame:
    """Length of the text report ``row <i>`` per line, without building it."""
    return df.agg(F.sum(F.length(F.concat(F.lit("row "), F.col(col).cast("string"))) + 1).alias("chars"))


def both_ways(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in one side only, duplicates counted, tagged with the side that holds them."""
    right = right.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in left.schema])
    only_left = left.exceptAll(right).withColumn("side", F.lit("left"))
    return only_left.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def with_fields(ids: DataFrame, width: int | None = None, id_col: str = "id") -> DataFrame:
    """Deterministic API rows for given ids: all strings, 2 to 12 fields present (``2 + id % 11`` when mixed)."""
    i = F.col(id_col)
    w = F.lit(width) if width else (2 + i % 11)
    money = i * 37 % 100_000

    def from_width(n: int, value: Column) -> Column:
        return F.when(w >= n, value.cast("string"))

    day = F.timestamp_add("SECOND", F.col(id_col), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return ids.select(
        i.cast("string").alias("id"),
        F.concat(F.floor(money / 100).cast("string"), F.lit("."), F.lpad((money % 100).cast("string"), 2, "0")).alias("amount"),
        from_width(3, F.concat(F.lit("r"), (i % 50).cast("string"))).alias("region"),
        from_width(4, 1 + i % 5).alias("quantity"),
        from_width(5, F.when(i % 7 == 0, "cancelled").otherwise("completed")).alias("status"),
        from_width(6, i % 100_000).alias("user_id"),
        from_width(7, F.element_at(F.array(F.lit("ca"), F.lit("np"), F.lit("us")), (i % 3 + 1).cast("int"))).alias("country"),
        from_width(8, (i % 6) * 100).alias("discount_bps"),
        from_width(9, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).alias("created_at"),
        from_width(10, F.concat(F.lit("product-"), (i % 500).cast("string"))).alias("product"),
        from_width(11, F.concat(F.lit("API event "), i.cast("string"), F.lit(": "), F.repeat(F.lit("unused summary detail; "), 4))).alias("note"),
        from_width(12, F.lit("fake-api")).alias("source"))


def with_nested_fields(ids: DataFrame, width: int | None = None, id_col: str = "id") -> DataFrame:
    """Deterministic nested API rows as JSON text in ``value``; absent fields are left out."""
    i = F.col(id_col)
    w = F.lit(width) if width else (2 + i % 11)
    money = i * 37 % 100_000
    day = F.timestamp_add("SECOND", F.col(id_col), F.lit("2026-01-01 00:00:00").cast("timestamp"))

    def from_width(n: int, value: Column) -> Column:
        return F.when(w >= n, value)

    return ids.select(F.to_json(F.struct(
        i.cast("string").alias("id"),
        F.concat(F.floor(money / 100).cast("string"), F.lit("."), F.lpad((money % 100).cast("string"), 2, "0")).alias("amount"),
        from_width(3, (i % 100_000).cast("string")).alias("user_id"),
        from_width(4, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).alias("created_at"),
        from_width(5, F.when(i % 7 == 0, "cancelled").otherwise("completed")).alias("status"),
        from_width(6, F.lit("usd")).alias("currency"), from_width(7, (1 + i % 5).cast("string")).alias("quantity"),
        from_width(8, F.concat(F.lit("product-"), (i % 500).cast("string"))).alias("product"),
        from_width(9, F.element_at(F.array(F.lit("ca"), F.lit("np"), F.lit("us")), (i % 3 + 1).cast("int"))).alias("country"),
        from_width(10, F.when(i % 4 == 0, "false").otherwise("true")).alias("active"),
        from_width(11, F.array(F.lit("api"), F.concat(F.lit("cohort-"), (i % 10).cast("string")))).alias("tags"),
        from_width(12, F.struct(F.lit("fake-api").alias("source"), (i % 20).alias("campaign"))).alias("metadata"))).alias("value"))


def synthetic_records(spark: SparkSession, n: int, width: int | None = None) -> DataFrame:
    """``n`` deterministic API rows made on the executors."""
    return with_fields(spark.range(n), width)
