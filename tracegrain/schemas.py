"""Schemas of the run document, traces, allocation records and workload records."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_FIELDS = ("id", "amount", "region", "quantity", "status", "user_id", "country", "discount_bps", "created_at", "product", "note", "source")
RAW = T.StructType([T.StructField(f, T.StringType()) for f in RAW_FIELDS])
# Defaults of absent raw fields.
DEFAULTS = {"region": "unknown", "quantity": "1", "status": "completed", "country": "unknown", "discount_bps": "0", "source": "fake-api"}
RECORDS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("amount_cents", T.LongType()), T.StructField("region", T.StringType()),
    T.StructField("quantity", T.LongType()), T.StructField("status", T.StringType()), T.StructField("user_id", T.LongType()),
    T.StructField("country", T.StringType()), T.StructField("discount_bps", T.LongType()), T.StructField("created_at", T.TimestampType()),
    T.StructField("product", T.StringType()), T.StructField("note", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("net_amount_cents", T.LongType())])
NESTED_FIELDS = ("id", "amount", "user_id", "created_at", "status", "currency", "quantity", "product", "country", "active", "tags", "metadata")
CSV_SUMMARY = "id LONG, region STRING, amount DOUBLE, note STRING"

FRAME = "struct<file:string,line:int,name:string,first_line:int,user:boolean>"
_LINE = ("struct<time_s:double,share:double,python_s:double,native_s:double,system_s:double,cpu_unsplit_s:double,samples:bigint,"
         "rss_growth_mb:double,rss_release_mb:double,line_events:bigint,alloc_mb:double,transient_peak_mb:double,peak_mb:double,end_mb:double,"
         "profiler_mb:double,leak_runs:int,func_line:int,scope:string,assigns:array<string>,calls:array<string>,"
         "held_by:array<struct<holder:string,type:string,items:bigint,matching:bigint>>,"
         "retention:struct<snapshots:bigint,rises:bigint,releases:bigint,growth_mb:double,observed_s:double,peak_mb:double,points:array<array<double>>>>")
_FUNCTION = ("struct<name:string,time_s:double,python_s:double,native_s:double,system_s:double,peak_mb:double,transient_peak_mb:double,"
             "alloc_mb:double,rss_growth_mb:double,profiler_mb:double,end_line:int>")
_TABLE = "struct<t:double,total_bytes:bigint,other_bytes:bigint,stacks:array<struct<frames:array<int>,bytes:bigint,truncated:boolean>>>"
_SOURCE = "struct<file:string,line:int,function:string>"
_EVENT_FIELDS = (
    ("id", "string"), ("timestamp_s", "double"), ("elapsed_s", "double"), ("t", "double"), ("pid", "bigint"), ("thread", "string"),
    ("thread_name", "string"), ("task", "string"), ("task_name", "string"), ("actor_kind", "string"), ("actor_id", "string"),
    ("source", _SOURCE), ("stack", f"array<{_SOURCE}>"), ("category", "string"), ("payload", "string"))
_EVENT = "struct<" + ",".join(f"{n}:{t}" for n, t in _EVENT_FIELDS) + ">"
_FINDING = (f"struct<id:string,category:string,severity:string,confidence:string,status:string,source:{_SOURCE},workload:string,evidence:string,"
            "reproduction:string,summary:string,pid:bigint,thread:string,actor_kind:string,actor_id:string>")
_SITE = (f"struct<process_id:bigint,thread_id:bigint,domain:string,scope:string,requested_bytes:bigint,allocation_count:bigint,"
         f"outstanding_at_capture_end_bytes:bigint,outstanding_at_capture_end_blocks:bigint,allocation_timestamp_ns:bigint,"
         f"source:struct<file:string,line:int,function:string,role:string>,python_stack:array<{_SOURCE}>,native_stack:array<{_SOURCE}>>")

# One run document; version 2 has no stacks. Unknown fields are ignored, as the format allows.
PROFILE = (
    "schema INT, script STRING, python STRING, gil_split BOOLEAN, wall_s DOUBLE, cpu_s DOUBLE, memory_mode STRING, samples BIGINT, interval_s DOUBLE, "
    "snapshots BIGINT, rss_kind STRING, rss_start_mb DOUBLE, rss_end_mb DOUBLE, timeline ARRAY<ARRAY<DOUBLE>>, peak_traced_mb DOUBLE, rss_peak_mb DOUBLE, "
    "native_untraced_mb DOUBLE, unattributed_peak_mb DOUBLE, frames INT, memory_tracing_lost_s DOUBLE, sampler_error STRING, "
    "stack_sampling STRUCT<active:BOOLEAN,reason:STRING>, file_hashes MAP<STRING,STRING>, "
    f"files MAP<STRING,MAP<STRING,{_LINE}>>, functions MAP<STRING,MAP<STRING,{_FUNCTION}>>, "
    f"stacks STRUCT<frames:ARRAY<{FRAME}>,samples:ARRAY<STRUCT<thread:STRING,thread_name:STRING,frames:ARRAY<INT>,python_s:DOUBLE,native_s:DOUBLE,"
    "system_s:DOUBLE,unsplit_s:DOUBLE,samples:BIGINT,alloc_bytes:BIGINT>>,dropped_s:DOUBLE,depth_limited:BOOLEAN>, "
    f"memory_stacks STRUCT<depth:INT,frames:ARRAY<{FRAME}>,peak:{_TABLE},exit:{_TABLE}>, "
    "largest_objects STRUCT<objects:ARRAY<STRUCT<holder:STRING,type:STRING,mb:DOUBLE,items:BIGINT,estimated:BOOLEAN>>,complete:BOOLEAN,scope:STRING,"
    "max_depth:BIGINT,max_nodes:BIGINT,visited:BIGINT,truncated:BOOLEAN,sizing:STRING>, "
    "monitoring STRUCT<requested:STRING,active:BOOLEAN,reason:STRING,dropped_line_events:BIGINT>, timeline_stacks ARRAY<INT>, tracemalloc_peak_mb DOUBLE, "
    "trace_function STRUCT<name:STRING,calls:BIGINT,traced_s:DOUBLE>, "
    "run STRUCT<argv:ARRAY<STRING>,started_at:STRING,platform:STRING,command:ARRAY<STRING>,cwd:STRING>, process_id BIGINT, memory_attribution STRING, "
    "memory_snapshot_at_exit BOOLEAN, memory_observations ARRAY<STRUCT<t:DOUBLE,traced_bytes:BIGINT,traced_growth_bytes:BIGINT,transient_bytes:BIGINT,"
    "rss_bytes:BIGINT,rss_change_bytes:BIGINT,bookkeeping_bytes:BIGINT>>, "
    "native_memory STRUCT<status:STRING,reason:STRING,rss_residual_mb:DOUBLE>, "
    "gc STRUCT<supported:BOOLEAN,events:ARRAY<STRUCT<t:DOUBLE,duration_s:DOUBLE,generation:INT,collected:BIGINT,uncollectable:BIGINT,thread:STRING,"
    "process:BIGINT,traced_bytes:BIGINT>>,dropped_events:BIGINT,total_collections:BIGINT,total_pause_s:DOUBLE,collected:BIGINT,uncollectable:BIGINT>, "
    f"diagnostics STRUCT<schema:INT,instrumentation:STRING,trace_path:STRING,trace_sha256:STRING,events:ARRAY<{_EVENT}>,findings:ARRAY<{_FINDING}>,"
    "dropped_events:BIGINT,dropped_findings:BIGINT,dropped_labels:BIGINT,scan_limits:STRUCT<max_nodes:BIGINT,max_depth:BIGINT>,"
    "capabilities:MAP<STRING,STRUCT<status:STRING,reason:STRING>>>, "
    "allocation_backend STRUCT<backend:STRING,available:BOOLEAN,reason:STRING,errors:ARRAY<STRING>,domain_totals_additive:BOOLEAN,notes:ARRAY<STRING>,"
    "availability:MAP<STRING,STRING>,files:ARRAY<STRUCT<process_id:BIGINT,artifact:STRUCT<path:STRING,sha256:STRING,bytes:BIGINT,format:STRING>,"
    f"python_allocator_requests_traced:BOOLEAN,sites:ARRAY<{_SITE}>>>>, "
    "memory_guard STRUCT<status:STRING,budget_bytes:BIGINT,reserve_bytes:BIGINT,stop_reason:STRING,scope:STRING,supervisor_pid:BIGINT,profiled_pid:BIGINT,"
    "child_exit_code:BIGINT,peak_root_rss_bytes:BIGINT,peak_group_rss_bytes:BIGINT,last_available_bytes:BIGINT,last_group_rss_bytes:BIGINT,"
    "poll_interval_s:DOUBLE,coverage:STRING,hard_limit:STRING,hard_limit_bytes:BIGINT,supervisor_peak_rss_bytes:BIGINT,"
    "initial_memory:STRUCT<available_bytes:BIGINT,total_bytes:BIGINT,host_available_bytes:BIGINT,container_available_bytes:BIGINT,container_status:STRING>,"
    "notes:ARRAY<STRING>,raw_artifacts:ARRAY<STRUCT<path:STRING,bytes:BIGINT,integrity:STRING>>>, "
    "baseline STRUCT<name:STRING,saved_at:STRING,git_commit:STRING,git_dirty:BOOLEAN>"
)
# One line of an event trace.
EVENT = ", ".join(f"{n} {t}" for n, t in _EVENT_FIELDS)
FINDING_ROW = ("path string, line int, col int, code string, severity string, scope string, subject string, args map<string,string>")
ALLOCATION = (f"process_id LONG, thread_id LONG, allocator STRING, stack_id LONG, native_stack_id LONG, native_segment_generation LONG, "
              f"n_allocations LONG, size LONG, python_stack ARRAY<{_SOURCE}>, native_stack ARRAY<{_SOURCE}>, kind STRING, sequence LONG")
