import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from tracegrain.operators import records as ops
from tracegrain.schemas import RECORDS
from tracegrain.sources import files, paged, records as io


def expected(n, width=None):
    """Integer recomputation of the rollup."""
    groups = {}
    for i in range(n):
        w = width or 2 + i % 11
        if w >= 5 and i % 7 == 0:
            continue
        net = (i * 37 % 100_000) * (1 + i % 5 if w >= 4 else 1) * (10_000 - ((i % 6) * 100 if w >= 8 else 0)) // 10_000
        g = groups.setdefault(f"r{i % 50}" if w >= 3 else "unknown", [0, 0])
        g[0] += 1
        g[1] += net
    return groups


@pytest.mark.parametrize("width", [None, 2, 12])
def test_rollup_equals_integer_recomputation(spark, width):
    native = ops.native_records(ops.synthetic_records(spark, 2000, width))
    assert [(f.name, f.dataType) for f in native.schema] == [(f.name, f.dataType) for f in RECORDS]
    assert {r["region"]: [r["records"], r["revenue_cents"]] for r in ops.rollup_by_region(native).collect()} == expected(2000, width)
    stats = ops.record_stats(native).first()
    assert stats["records"] == stats["unique_ids"] and stats["bad_rows"] == 0


def test_three_ways_agree(spark):
    raw = ops.synthetic_records(spark, 500)
    native = ops.native_records(raw)
    assert ops.both_ways(native, ops.udf_records(raw)).count() == 0 and ops.both_ways(native, ops.row_loop_records(raw)).count() == 0
    double = native.limit(1).unionByName(native)
    assert [r["side"] for r in ops.both_ways(native, double).collect()] == ["right"]


def test_filter_runs_before_casts(spark):
    raw = spark.createDataFrame([("x", "bad", "cancelled"), ("1", "3.70", None)], "id string, amount string, status string")
    for c in ("region", "quantity", "user_id", "country", "discount_bps", "created_at", "product", "note", "source"):
        raw = raw.withColumn(c, F.lit(None).cast("string"))
    r = ops.native_records(raw).first()
    assert (r["amount_cents"], r["country"], r["region"], r["net_amount_cents"]) == (370, "UNKNOWN", "unknown", 370)


def test_nested_rules(spark):
    docs = {
        "ok": {"id": "1", "amount": "5.25", "active": "false", "tags": ["a"], "metadata": {"k": 1}, "created_at": "2026-01-01T02:00:00+02:00", "currency": "eur"},
        "plain": {"id": 2, "amount": 7}, "missing": {"id": "1"}, "unknown": {"id": "1", "amount": "1", "zz": 1}, "cents": {"id": "1", "amount": "1.005"},
        "negative": {"id": "1", "amount": "-1"}, "quantity": {"id": "1", "amount": "1", "quantity": "0"}, "zone": {"id": "1", "amount": "1", "created_at": "2026-01-01T00:00:00"},
        "status": {"id": "1", "amount": "1", "status": "odd"}, "active": {"id": "1", "amount": "1", "active": "yes"}, "tags": {"id": "1", "amount": "1", "tags": [1]},
        "metadata": {"id": "1", "amount": "1", "metadata": [1]}, "product": {"id": "1", "amount": "1", "product": 5}, "cancelled": {"id": "1", "amount": "1", "status": "Cancelled"}}
    df = spark.createDataFrame([(json.dumps(d),) for d in docs.values()], "value string")
    out = ops.normalize_nested(df).collect()
    assert len(out) == len(docs) - 1
    good = [r for r in out if not r["violations"]]
    assert [(r["id"], r["amount_cents"], r["active"], r["tags"], r["currency"], r["created_at"], r["quantity"]) for r in good] == [
        (1, 525, False, ["a"], "EUR", "2026-01-01T00:00:00+00:00", 1), (2, 700, True, [], "USD", None, 1)]
    assert sorted(r["violations"][0] for r in out if r["violations"]) == sorted([
        "missing id or amount", "unknown fields", "amount is not a nonnegative number of cents", "amount is not a nonnegative number of cents", "quantity is not a positive integer",
        "created_at needs a timezone", "unknown status", "active is not a boolean", "tags is not an array of strings", "metadata is not an object", "product is not a string"])
    with pytest.raises(Exception, match="bad record"):
        ops.normalize_nested(df, strict=True).collect()


def test_small_aggregates(spark):
    ids = spark.range(1000)
    assert ops.even_square_total(ids, "id").first()["total"] == sum(i * i for i in range(1000) if i % 2 == 0)
    assert ops.report_length(ids, "id").first()["chars"] == sum(len(f"row {i}\n") for i in range(1000))


def test_files_round_trip(spark, tmp_path):
    raw = ops.synthetic_records(spark, 300)
    folder = str(tmp_path / "pages")
    assert paged.ingest_pages(spark, folder, 300, 64) == 300
    assert sorted(d for d in os.listdir(folder) if d.startswith("page=")) == [f"page={i}" for i in range(5)]
    back = spark.read.schema(io.RAW).json(folder).select(*io.RAW_FIELDS)
    assert ops.both_ways(raw, back).count() == 0
    io.write_parquet(ops.native_records(raw), str(tmp_path / "out"), max_records_per_file=100)
    pruned = io.read_columns(spark, str(tmp_path / "out"), ["id", "region"])
    assert pruned.count() == ops.native_records(raw).count() and "ReadSchema: struct<id:bigint,region:string>" in pruned._jdf.queryExecution().toString()
    io.write_sharded_jsonl(raw.coalesce(1), str(tmp_path / "shards"), 100)
    shards = [f for f in os.listdir(tmp_path / "shards") if f.endswith(".json.gz")]
    assert len(shards) == 3 and all(sum(1 for _ in gzip.open(tmp_path / "shards" / f)) == 100 for f in shards)
    assert files.file_digest(spark, str(tmp_path / "shards"), "*.gz").count() == 3
    assert files.row_digest(raw).first()["digest"] == files.row_digest(back.repartition(7)).first()["digest"]


def test_malformed_input_fails(spark, tmp_path):
    (tmp_path / "page-0.jsonl").write_text('{"id": "1", "amount": "1"}\n{"id": \n')
    with pytest.raises(Exception):
        io.read_raw(spark, str(tmp_path)).collect()
    other = tmp_path / "strict"
    other.mkdir()
    (other / "page-0.jsonl").write_text('{"id": "1", "amount": "1", "odd": "x"}\n')
    assert io.read_raw(spark, str(other)).count() == 1
    with pytest.raises(Exception, match="unknown fields"):
        io.read_raw_strict(spark, str(other)).collect()


def test_csv_and_log(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,region,amount,note\n" + "".join(f"{i},r{i % 50},{i % 977 * 0.5},n\n" for i in range(2000)))
    got = ops.filtered_sum(io.read_csv_summary(spark, str(tmp_path / "a.csv")), "region", "amount", 100).agg(F.sum("total")).first()[0]
    assert got == sum(i % 977 * 0.5 for i in range(2000) if i % 977 * 0.5 > 100)
    (tmp_path / "a.log").write_text("".join(f"{i},user{i % 1000},{i * 7 % 997}\n" for i in range(500)))
    assert io.read_log(spark, str(tmp_path / "a.log")).agg(F.sum("amount")).first()[0] == sum(i * 7 % 997 for i in range(500))


def test_source_files(spark, tmp_path):
    for name in ("a.py", "b.pyw", "c.txt", ".hid/d.py", "node_modules/e.py", "sub/f.py"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x = 1\r\ny = 2\r\n")
    got = files.scan_sources(spark, str(tmp_path)).collect()
    assert sorted(r["path"].split("/")[-1] for r in got) == ["a.py", "b.pyw", "f.py"]
    import hashlib

    assert {r["sha1"] for r in got} == {hashlib.sha1(b"x = 1\ny = 2\n").hexdigest()}


def test_event_traces(spark, tmp_path):
    from tracegrain.operators.hazards import lost_updates
    from tracegrain.sources import traces

    def event(i, t, actor, category, value):
        return {"id": f"1:{i}", "timestamp_s": t, "elapsed_s": t, "t": t, "pid": 1, "thread": actor, "thread_name": "T", "actor_kind": "thread", "actor_id": str(actor), "source": None, "stack": [],
                "category": category, "payload": {"key": "k", "value": {"kind": "literal", "value": value}} if category != "shared_outcome" else {"key": "k", "expected": 2, "observed": 1}}

    (tmp_path / "one.jsonl").write_text("\n".join(json.dumps(e) for e in [event(1, 1.0, 1, "shared_read", 0), event(3, 3.0, 1, "shared_write", 1)]))
    (tmp_path / "two.jsonl").write_text("\n".join(json.dumps(e) for e in [event(2, 2.0, 2, "shared_read", 0), event(4, 4.0, 2, "shared_write", 1), event(5, 5.0, 2, "shared_outcome", None)]))
    merged = traces.merge_traces(spark, str(tmp_path))
    assert [r["id"] for r in merged.collect()] == ["1:1", "1:2", "1:3", "1:4", "1:5"]
    assert [r["status"] for r in lost_updates(traces.accesses(merged)).collect()] == ["confirmed"]


def test_even_squares_beyond_64_bits(spark):
    numbers = spark.createDataFrame([(4_000_000_000,), (-4_000_000_002,), (3_000_000_001,), (None,)], "id long")
    assert ops.even_square_total(numbers, "id").first()["total"] == 4_000_000_000**2 + 4_000_000_002**2
    assert ops.even_square_total(numbers.where("id is null"), "id").first()["total"] is None
