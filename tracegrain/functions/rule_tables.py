"""Fixed values of the source rules: names they look for, rule codes, severities and messages."""

from __future__ import annotations

PANDAS_LOADERS = ("read_csv", "read_json", "read_table", "read_sql", "read_sql_query", "read_sql_table", "read_excel", "read_fwf")
PANDAS_OBJECTS = (*PANDAS_LOADERS, "DataFrame", "Series")
LINK_ATTRS = ("parent", "prev", "previous", "next", "left", "right", "sibling", "owner", "back", "peer", "twin", "partner", "container", "root")
WEAKREF_CALLS = ("ref", "proxy", "WeakValueDictionary", "WeakKeyDictionary", "WeakSet")
BLOCKING_CALLS = (
    "time.sleep", "requests.get", "requests.post", "requests.put", "requests.patch", "requests.delete", "requests.head", "requests.request",
    "urllib.request.urlopen", "subprocess.run", "subprocess.call", "subprocess.check_call", "subprocess.check_output", "socket.create_connection")
AGGREGATORS = ("sum", "any", "all", "min", "max")
ITERATING_CALLS = (*AGGREGATORS, "iter", "enumerate", "zip")
THREAD_CTORS = ("threading.Thread",)
EXECUTOR_CTORS = ("concurrent.futures.ThreadPoolExecutor", "multiprocessing.pool.ThreadPool", "multiprocessing.dummy.Pool")
EXECUTOR_METHODS = ("submit", "map", "apply", "apply_async", "imap", "imap_unordered", "starmap")
IO_PREFIXES = ("requests.", "urllib.", "http.", "socket.", "subprocess.", "httpx.", "boto3.", "ftplib.", "smtplib.", "sqlite3.", "psycopg2.", "pymysql.", "shutil.")
IO_NAMES = ("open", "input", "time.sleep")
IO_ATTRS = (
    "read", "readline", "readlines", "write", "writelines", "recv", "recv_into", "send", "sendall", "connect", "execute", "executemany", "fetchone", "fetchmany",
    "fetchall", "commit", "urlopen", "read_text", "read_bytes", "write_text", "write_bytes", "download_file", "upload_file", "get_object", "put_object")
NATIVE_PREFIXES = ("numpy.", "polars.", "pyarrow.", "hashlib.", "zlib.", "bz2.", "lzma.", "duckdb.", "scipy.", "numexpr.")
SLOTS_EXEMPT_BASES = ("NamedTuple", "Enum", "IntEnum", "StrEnum", "Flag", "IntFlag", "TypedDict", "Protocol", "Exception", "BaseException")
QUEUE_CTORS = ("queue.Queue", "queue.LifoQueue", "queue.PriorityQueue", "asyncio.Queue", "asyncio.LifoQueue", "asyncio.PriorityQueue",
               "multiprocessing.Queue", "multiprocessing.JoinableQueue")
START_METHOD_CALLS = ("multiprocessing.set_start_method", "multiprocessing.get_context")
CONCAT_SEQUENCE_CALLS = ("pandas.concat", "numpy.concatenate", "numpy.vstack", "numpy.hstack")
CONCAT_FIRST_ARG_CALLS = ("numpy.append",)
STORE_METHODS = ("append", "appendleft", "add")
LIST_TYPES = ("list", "deque", "set", "tuple", "frozenset")

# Rule code -> severity.
SEVERITIES = {
    "heap-inflation": "warning",
    "pointer-chasing": "warning",
    "cyclic-reference": "information",
    "gc-cycle-risk": "information",
    "ram-fragmentation.append": "warning",
    "ram-fragmentation.no-slots": "information",
    "text-inflation.concat": "warning",
    "text-inflation.whole-file": "warning",
    "memory-swell.list-arg": "warning",
    "memory-swell.list-copy": "warning",
    "memory-swell.list-once": "information",
    "memory-swell.deepcopy-loop": "warning",
    "memory-swell.recompile-loop": "information",
    "memory-swell.setdefault-loop": "information",
    "memory-swell.list-extend-loop": "information",
    "memory-swell.concat-loop": "warning",
    "memory-swell.unbounded-queue": "information",
    "memory-swell.fork-start-method": "information",
    "memory-swell.method-cache": "warning",
    "memory-swell.unbounded-cache": "information",
    "task-retention.asyncio-task": "warning",
    "frame-retention.stored-exception": "information",
    "resource-leak.file-handle": "warning",
    "single-thread-stall.async-blocking": "warning",
    "single-thread-stall.list-membership": "warning",
    "single-thread-stall.cpu-thread": "information",
}

# Rule code -> (text used when every placeholder is known, or None; text used otherwise). Own wording.
MESSAGES = {
    "heap-inflation": (
        "fetchall() builds every remaining row at once (about {int_size} B per int, {str_empty} B per empty str and {ptr_size} B per tuple slot on {py_version}); iterate or fetch in batches.",
        "fetchall() builds every remaining row at once; iterate or fetch in batches."),
    "pointer-chasing": (None, "This call asks for object dtype, which stores pointers to Python objects; name the real type where semantics allow."),
    "cyclic-reference": (None, "Links in both directions form reference cycles that wait for the cyclic collector; use indexes or a weak reference for the back link."),
    "gc-cycle-risk": (None, "This class has a back reference and a finalizer, so finalization may wait for the cyclic collector; use close() or a context manager."),
    "ram-fragmentation.append": (
        "Appending a fresh container per iteration: a 3-key dict takes about {dict3} B and a 3-tuple {tuple3} B before values ({py_version}, {allocator}); consider one list per column.",
        "Appending a fresh container per iteration creates one object per row; consider one list per column."),
    "ram-fragmentation.no-slots": (
        "Class {name} has no __slots__ and is created in a loop; a 3-attribute instance takes about {instance3} B, with slots {slots3} B ({py_version}).",
        "Class {name} has no __slots__ and is created in a loop; consider slots when its attributes are fixed."),
    "text-inflation.concat": (None, "Adding to a str in a loop can copy everything built so far each time; collect the pieces and join them once."),
    "text-inflation.whole-file": (
        "{call} decodes the whole file and then makes one str per piece ({str_empty} B each when empty; 1,000 characters take {str_ascii_1000} to {str_wide_1000} B on {py_version}); iterate lazily.",
        "{call} decodes the whole file and then makes one str per piece; iterate lazily."),
    "memory-swell.list-arg": (None, "{call}([...]) builds the whole list before {call} sees its first item; pass a generator expression."),
    "memory-swell.list-copy": (None, "Iterating {call} builds a full copy before the loop starts; iterate the original unless a snapshot is needed."),
    "memory-swell.list-once": (None, "`{name}` holds every item of {call} but is used once, by {use}; pass a generator unless the list is needed."),
    "memory-swell.deepcopy-loop": (None, "copy.deepcopy() copies compound objects on every iteration; copy only what needs isolation."),
    "memory-swell.recompile-loop": (None, "re.compile() receives a literal pattern inside a loop; compile it once before."),
    "memory-swell.setdefault-loop": (None, "A bare setdefault(key, []) makes a new list on every iteration; consider defaultdict(list)."),
    "memory-swell.list-extend-loop": (None, "extend() builds a whole list first on every iteration; pass a generator expression."),
    "memory-swell.concat-loop": (None, "{call} rebuilds `{name}` from itself on every iteration; collect the pieces and concatenate once."),
    "memory-swell.unbounded-queue": (None, "{call} has no positive maxsize, so items added faster than removed stay in memory; set maxsize."),
    "memory-swell.fork-start-method": (None, "{call}(\"fork\") shares memory only until either side writes, and reference counts are writes; prefer spawn or forkserver and shared memory."),
    "memory-swell.method-cache": (None, "An unbounded cache on a method keeps every instance it has seen alive; cache per instance or set a bound."),
    "memory-swell.unbounded-cache": (None, "This cache never evicts; set maxsize when the inputs come from data."),
    "task-retention.asyncio-task": (None, "The result of asyncio.create_task() is discarded; keep a reference, await it, or use a task group."),
    "frame-retention.stored-exception": (None, "The exception `{name}` is stored beyond its block and keeps its frames alive; store text, or clear the frames of {name} first."),
    "resource-leak.file-handle": (None, "This open() has no visible context manager or close() in its scope."),
    "single-thread-stall.async-blocking": (None, "{call} blocks the event loop inside async code; use an async equivalent or a thread."),
    "single-thread-stall.list-membership": (None, "`in {name}` can scan the list on every iteration; a set index may help when semantics allow."),
    "single-thread-stall.cpu-thread": (
        "{func}() loops over its input in Python without I/O or native calls, so its threads take turns ({py_version}, interpreter lock {gil_state}); use processes or native code.",
        "{func}() loops over its input in Python without I/O or native calls, so its threads take turns under an interpreter lock; use processes or native code."),
}
