"""Source rules as queries over syntax rows.

``parse`` turns files into one row per syntax node (the only Python step). Names are resolved by joining uses with the bindings
of the scopes around them, and what a name holds at a use is the last assignment before it in an ordered scan, so neither a huge
file nor a much-used name is ever handled as one group. Every rule then selects rows; ``findings`` unites them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracegrain.functions import rule_tables as rt
from tracegrain.functions.syntax import SYNTAX, parser
from tracegrain.functions.text import render_message, subject_prefix
from tracegrain.operators.scan import scan, top_k
from tracegrain.session import cut_lineage, stored

AT = ("path", "node")
SCOPE_KINDS = ("Module", "FunctionDef", "AsyncFunctionDef", "Lambda", "ClassDef")
FUNCTION_KINDS = ("FunctionDef", "AsyncFunctionDef")
LOCAL = "<local>"


def parse(sources: DataFrame) -> DataFrame:
    """Syntax rows of (path, text), parsed where the text is read: no source text is shuffled."""
    schema = T.StructType.fromDDL(SYNTAX)
    return sources.select("path", "text").mapInArrow(parser(to_arrow_schema(schema)), schema)


# ---- small expressions over a row's children

def _kids(field: str) -> Column:
    return F.filter("kids", lambda k: k["field"] == field)


def _kid(field: str, i: int = 0) -> Column:
    return F.get(_kids(field), F.lit(i))


def _keyword(name: str) -> Column:
    return F.get(F.filter("kids", lambda k: (k["field"] == "keywords") & (k["name"] == name)), F.lit(0))


def _n(field: str) -> Column:
    return F.size(_kids(field))


def _is(kind: str | Sequence[str]) -> Column:
    return F.col("kind") == kind if isinstance(kind, str) else F.col("kind").isin(*kind)


def _receiver(text: Column) -> Column:
    """``a.b`` of ``a.b.c``."""
    return F.when(text.contains("."), F.regexp_replace(text, r"\.[^.]*$", ""))


def _maxsize_none() -> Column:
    first, key = _kid("args"), _keyword("maxsize")
    return F.coalesce(first["const"] == "NoneType", F.lit(False)) | F.coalesce(key["const"] == "NoneType", F.lit(False))


# ---- names

def bindings(s: DataFrame) -> DataFrame:
    """Per scope and name: import target, function and class defined, whether bound, and the end of the first plain assignment."""
    statements = s.where(_is(("Import", "ImportFrom"))).select("path", F.col("node").alias("parent"), F.col("kind").alias("__kind"), F.col("module").alias("__from"))
    alias = s.where(_is("alias")).join(statements, ["path", "parent"])
    top = F.substring_index("name", ".", 1)
    plain_import = F.col("__kind") == "Import"
    imported = alias.select(
        "path", "scope", F.coalesce("module", F.when(plain_import, top).otherwise(F.col("name"))).alias("name"), "node",
        F.when(plain_import, F.when(F.col("module").isNotNull(), F.col("name")).otherwise(top))
        .when(F.col("__from").isNotNull(), F.concat_ws(".", "__from", "name")).alias("import"))
    none = F.lit(None)

    def rows(df: DataFrame, name: Column | str, scope: Column | str = "scope", **columns: Column) -> DataFrame:
        cols = {"import": none.cast("string"), "func": none.cast("int"), "cls": none.cast("int"), "assigned": none.cast("int"), "bound": F.lit(True), **columns}
        return df.select("path", (F.col(scope) if isinstance(scope, str) else scope).alias("scope"), (F.col(name) if isinstance(name, str) else name).alias("name"),
                         "node", *[c.alias(n) for n, c in cols.items()])

    assigned = s.where(_is("Assign")).select("path", "scope", "node", "last", F.explode(_kids("targets")).alias("t")).where(F.col("t.kind") == "Name")
    parts = [
        rows(imported, "name", **{"import": F.col("import")}),
        rows(s.where(_is(FUNCTION_KINDS)), "name", func=F.col("node")), rows(s.where(_is("ClassDef")), "name", cls=F.col("node")),
        rows(s.where(_is("Name") & F.col("ctx").isin("Store", "Del")), "name"), rows(s.where(_is("ExceptHandler") & F.col("name").isNotNull()), "name"),
        rows(s.where(_is("arg")), "name", "grand"), rows(assigned, "t.name", assigned=F.col("last"), bound=F.lit(False))]
    every = reduce(DataFrame.unionByName, parts)
    outside = s.where(_is(("Global", "Nonlocal"))).select("path", "scope", F.explode(F.split("name", ",")).alias("name")).distinct().withColumn("__outside", F.lit(True))

    def last(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("node"))).alias(column)

    out = every.groupBy("path", "scope", "name").agg(last("import"), last("func"), last("cls"), F.min("assigned").alias("assigned"), F.max("bound").alias("bound"))
    out = out.join(outside, ["path", "scope", "name"], "left")
    return out.withColumn("bound", F.col("bound") & F.col("__outside").isNull()).drop("__outside")


def resolve(uses: DataFrame, bound: DataFrame) -> DataFrame:
    """What the first part of a dotted use means: ``qual`` (full import path), ``func`` and ``cls`` (node defined in the file).

    The innermost scope that binds the name decides; a plain assignment before the use makes it local.
    """
    u = uses.select("path", "node", "dotted", F.substring_index("dotted", ".", 1).alias("name"), F.posexplode("chain").alias("hop", "scope"))
    met = u.join(bound, ["path", "scope", "name"])
    hidden = F.coalesce(F.col("assigned") < F.col("node"), F.lit(False))
    module = F.col("scope") == 0
    decides = met.where(module | F.col("bound") | hidden)
    value = F.struct(
        F.when(hidden, F.lit(LOCAL)).when(F.col("import").isNotNull(), F.col("import")).when(~module, F.lit(LOCAL)).alias("import"),
        F.when(~hidden, F.col("func")).alias("func"), F.when(~hidden, F.col("cls")).alias("cls"))
    best = decides.groupBy(*AT).agg(F.min_by(value, "hop").alias("v"))
    out = uses.select("path", "node", "dotted").join(best, list(AT), "left")
    root = F.substring_index("dotted", ".", 1)
    rest = F.substr("dotted", F.length(root) + 1)
    return out.select(*AT, F.concat(F.coalesce(F.col("v")["import"], root), rest).alias("qual"), F.col("v")["func"].alias("func"), F.col("v")["cls"].alias("cls"))


def held_state(uses: DataFrame, events: DataFrame, bound: DataFrame, flags: Sequence[str]) -> DataFrame:
    """What a name held when it was used, from the assignments before the use in the innermost scope that has any.

    ``events``: path, scope, name, pos and one boolean column per flag (null: says nothing about it).
    """
    u = uses.select("path", "node", "name", F.posexplode("chain").alias("hop", "scope"))
    none = [F.lit(None).cast("boolean").alias(f) for f in flags]
    rows = events.select("path", "scope", "name", F.col("pos").cast("long").alias("pos"), F.lit(1).alias("__event"), F.lit(None).cast("int").alias("node"),
                         F.lit(None).cast("int").alias("hop"), *flags).unionByName(
        u.select("path", "scope", "name", F.col("node").cast("long").alias("pos"), F.lit(0).alias("__event"), "node", "hop", *none))
    s = scan(rows, ["path", "scope", "name"], ["pos", "__event", "hop"], fill={f"__{f}": F.col(f) for f in flags}).where(F.col("__event") == 0)
    s = s.join(bound.select("path", "scope", "name", "bound"), ["path", "scope", "name"], "left")
    shut = (F.col("scope") != 0) & F.coalesce("bound", F.lit(False))
    out = [F.coalesce(F.min_by(F.coalesce(F.col(f"__{f}"), F.lit(False)), F.when(F.col(f"__{f}").isNotNull() | shut, F.col("hop"))), F.lit(False)).alias(f) for f in flags]
    return s.groupBy(*AT).agg(*out)


# ---- classes

def class_facts(s: DataFrame, quals: DataFrame) -> DataFrame:
    """Per class: its first back reference (in breadth-first order), whether slots would pay, and whether it has a finalizer."""
    def is_self(k: Column) -> Column:
        return (k["kind"] == "Name") & (k["name"] == "self")

    inside = s.where(F.size("classes") > 0)
    value = _kid("value")
    weak = (value["kind"] == "Call") & F.coalesce(F.element_at(F.split(value["callee"], r"\."), -1).isin(*rt.WEAKREF_CALLS), F.lit(False))
    targets = F.when(_is("Assign"), _kids("targets")).otherwise(_kids("target"))
    owner_self = lambda t: F.coalesce(t["dotted"].rlike(r"^self\.[^.]+$"), F.lit(False))
    edge_target = F.exists(targets, lambda t: (t["kind"] == "Attribute") & (
        (is_self(value) & ~owner_self(t)) | (owner_self(t) & t["name"].isin(*rt.LINK_ATTRS) & (value["kind"] != "Constant"))))
    stores = _is(("Assign", "AnnAssign")) & value.isNotNull() & ~weak & edge_target
    adds = _is("Call") & (_kid("func")["kind"] == "Attribute") & _kid("func")["name"].isin("append", "add", "insert") & F.exists(_kids("args"), is_self)
    edges = inside.where(stores | adds).select("path", F.explode("classes").alias("cls"), F.struct("depth", "node").alias("at"),
                                               F.struct("node", "line", "col", "label").alias("edge"))
    first = edges.groupBy("path", "cls").agg(F.min_by("edge", "at").alias("edge"))

    open_dict = _is("Attribute") & F.coalesce(F.col("dotted") == "self.__dict__", F.lit(False))
    calls = inside.where(_is("Call")).join(quals.select("path", F.col("node").alias("__f"), "qual"), (inside["path"] == quals["path"]) & (_kid("func")["node"] == F.col("__f"))).drop(quals["path"])
    set_self = calls.where(F.col("qual").isin("setattr", "builtins.setattr") & F.coalesce(is_self(_kid("args")), F.lit(False)))
    dynamic = inside.where(open_dict).select("path", F.explode("classes").alias("cls")).unionByName(set_self.select("path", F.explode("classes").alias("cls")))
    slots = s.where(_is(("Assign", "AnnAssign")) & (F.col("parent_kind") == "ClassDef") & (F.col("field") == "body") & F.exists(
        targets, lambda t: (t["kind"] == "Name") & (t["name"] == "__slots__"))).select("path", F.col("parent").alias("cls"))
    decorated = s.where(_is("Call") & (F.col("parent_kind") == "ClassDef") & (F.col("field") == "decorator_list") & F.coalesce(_keyword("slots")["text"] == "True", F.lit(False)))
    decorated = decorated.withColumn("__f", _kid("func")["node"]).join(quals.select("path", F.col("node").alias("__f"), "qual"), ["path", "__f"]).where(
        F.col("qual").endswith("dataclass")).select("path", F.col("parent").alias("cls"))
    exempt = dynamic.unionByName(slots).unionByName(decorated).distinct().withColumn("__exempt", F.lit(True))
    base = lambda b: F.coalesce(b["name"], F.lit(""))
    special = F.exists(_kids("bases"), lambda b: b["kind"].isin("Name", "Attribute") & (base(b).isin(*rt.SLOTS_EXEMPT_BASES) | base(b).rlike("(Error|Exception|Warning)$")))
    finalizers = s.where(_is(FUNCTION_KINDS) & (F.col("name") == "__del__") & (F.col("parent_kind") == "ClassDef") & (F.col("field") == "body")).select(
        "path", F.col("parent").alias("cls")).distinct().withColumn("__del", F.lit(True))
    c = s.where(_is("ClassDef")).select("path", F.col("node").alias("cls"), F.col("name").alias("class_name"), "line", "col", "label", special.alias("__special"))
    c = c.join(first, ["path", "cls"], "left").join(exempt, ["path", "cls"], "left").join(finalizers, ["path", "cls"], "left")
    return c.select("path", "cls", "class_name", "line", "col", "label", "edge", F.col("__del").isNotNull().alias("finalizer"),
                    (~F.col("__special") & F.col("__exempt").isNull()).alias("needs_slots"))


# ---- rules

def _finding(df: DataFrame, code: str, line: Column | str = "line", col: Column | str = "col", subject: Column | None = None,
             args: dict[str, Column] | None = None, label: Column | str = "label") -> DataFrame:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    pairs = [x for k, v in (args or {}).items() for x in (F.lit(k), v)]
    values = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
    return df.select("path", c(line).alias("line"), c(col).alias("col"), F.lit(code).alias("code"), c(label).alias("scope"),
                     (subject if subject is not None else F.lit(None).cast("string")).alias("subject"), values.alias("args"))


def _at(k: Column) -> dict:
    return {"line": k["line"], "col": k["col"]}


def _attr_span(f: Column) -> dict:
    return {"line": f["end_line"], "col": f["end_col"] - F.length(f["name"])}


def call_rules(calls: DataFrame) -> list[DataFrame]:
    """Rules decided by one call row (``qual`` resolved)."""
    f, q, first = _kid("func"), F.coalesce("qual", F.lit("")), _kid("args")
    attr, loop = f["kind"] == "Attribute", F.col("loop") > 0
    args = _n("args")
    named = attr & f["name"].isNotNull()
    receiver = _receiver(f["dotted"])
    statement = F.col("parent_kind") == "Expr"
    text_call = F.concat(q, F.lit("()"))
    out = [
        _finding(calls.where(named & (f["name"] == "fetchall")), "heap-inflation", **_attr_span(f), subject=receiver),
        _finding(calls.where(named & (f["name"] == "readlines") & (args == 0)), "text-inflation.whole-file", **_attr_span(f), subject=receiver, args={"call": F.lit("readlines()")}),
        _finding(calls.where(named & (f["name"] == "append") & loop & (args == 1) & (first["kind"].isin("Dict", "Tuple", "List") | ((first["kind"] == "Call") & (first["callee"] == "dict")))),
                 "ram-fragmentation.append", **_at(first), subject=receiver),
        _finding(calls.where(named & (f["name"] == "setdefault") & loop & (args >= 2) & (_kid("args", 1)["kind"] == "List") & (_kid("args", 1)["n_elts"] == 0) & statement),
                 "memory-swell.setdefault-loop", subject=receiver),
        _finding(calls.where(named & (f["name"] == "extend") & loop & (first["kind"] == "ListComp")), "memory-swell.list-extend-loop", **_at(first), subject=receiver),
        _finding(calls.where((f["kind"] == "Name") & f["name"].isin(*rt.AGGREGATORS) & (args == 1) & (first["kind"] == "ListComp")), "memory-swell.list-arg", **_at(first), args={"call": f["name"]}),
        _finding(calls.where(loop & (q == "copy.deepcopy")), "memory-swell.deepcopy-loop"),
        _finding(calls.where(loop & (q == "re.compile") & first["const"].isin("str", "bytes")), "memory-swell.recompile-loop"),
        _finding(calls.where((q == "asyncio.create_task") & statement), "task-retention.asyncio-task"),
        _finding(calls.where(F.col("in_async") & q.isin(*rt.BLOCKING_CALLS)), "single-thread-stall.async-blocking", **_at(f), args={"call": text_call}),
    ]
    size = F.coalesce(first, _keyword("maxsize"))
    unknown = F.exists(_kids("args"), lambda a: a["kind"] == "Starred") | F.exists(_kids("keywords"), lambda k: k["name"].isNull())
    endless = ~unknown & (size.isNull() | ((size["const"] == "int") & (size["text"] == "0")))
    out.append(_finding(calls.where(q.isin(*rt.QUEUE_CTORS) & endless), "memory-swell.unbounded-queue", args={"call": text_call}))
    method = F.coalesce(first, _keyword("method"))
    out.append(_finding(calls.where(q.isin(*rt.START_METHOD_CALLS) & (method["const"] == "str") & (method["text"] == "fork")), "memory-swell.fork-start-method", args={"call": q}))
    return out


def whole_file_split(s: DataFrame) -> DataFrame:
    """``x.read().split()`` and its relatives."""
    f = _kid("func")
    outer = s.where(_is("Call") & F.col("live") & (f["kind"] == "Attribute") & f["name"].isin("split", "splitlines", "rsplit")).select(
        "path", "node", "label", f.alias("f"))
    inner = s.where(_is("Call") & (f["kind"] == "Attribute") & (f["name"] == "read") & (_n("args") == 0) & (F.col("field") == "value")
                    & (F.col("parent_kind") == "Attribute") & (F.col("parent_field") == "func")).select("path", F.col("grand").alias("node"), f["dotted"].alias("reader"))
    return _finding(outer.join(inner, list(AT)), "text-inflation.whole-file", **_attr_span(F.col("f")), subject=_receiver(F.col("reader")),
                    args={"call": F.concat(F.lit("read()."), F.col("f")["name"], F.lit("()"))})


def object_dtype(s: DataFrame, calls: DataFrame, quals: DataFrame) -> DataFrame:
    """Pandas calls that ask for object dtype, directly or as a value of a dict display."""
    q, f = F.col("qual"), _kid("func")
    last = F.element_at(F.split(q, r"\."), -1)
    asked = calls.where(q.startswith("pandas.") & last.isin(*rt.PANDAS_OBJECTS) & F.exists(_kids("keywords"), lambda k: k["name"] == "dtype"))
    words = s.where(_is("keyword") & (F.col("name") == "dtype")).select("path", F.col("node").alias("slot"), F.col("parent").alias("call"))
    values = s.where((F.col("slot_field") == "value")).select("path", "slot", "node", "const", "text", "dotted")
    named = values.join(words, ["path", "slot"]).join(quals.select(*AT, "qual"), list(AT), "left")
    evidence = named.where(((F.col("const") == "str") & (F.col("text") == "object")) | F.col("qual").isin("object", "builtins.object")).select(
        "path", F.col("call").alias("node")).distinct()
    hit = asked.join(evidence, list(AT), "left_semi")
    at = {"line": F.when(f["kind"] == "Attribute", f["end_line"]).otherwise(f["line"]),
          "col": F.when(f["kind"] == "Attribute", f["end_col"] - F.length(f["name"])).otherwise(f["col"])}
    return _finding(hit, "pointer-chasing", **at, subject=f["dotted"])


def class_rules(calls: DataFrame, classes: DataFrame) -> list[DataFrame]:
    """Classes created in loops, and classes with a back reference and a finalizer."""
    f = _kid("func")
    made = calls.where((f["kind"] == "Name") & (F.col("loop") > 0) & F.col("cls").isNotNull()).select(
        "path", "cls", F.col("node"), f.alias("f"), F.col("label").alias("scope_label")).join(
            classes.select("path", "cls", "needs_slots", "edge"), ["path", "cls"])
    name = F.col("f")["name"]
    cyclic = made.where(F.col("edge").isNotNull())
    # Once per class name and file, at the edge of the class the first creation names.
    once = cyclic.groupBy("path", name.alias("made_name")).agg(F.min_by("edge", "node").alias("e"))
    return [
        _finding(made.where("needs_slots"), "ram-fragmentation.no-slots", **_at(F.col("f")), subject=name, args={"name": name}, label="scope_label"),
        _finding(cyclic, "cyclic-reference", **_at(F.col("f")), subject=name, label="scope_label"),
        _finding(once, "cyclic-reference", line=F.col("e")["line"], col=F.col("e")["col"], subject=F.col("made_name"), label=F.col("e")["label"]),
        _finding(classes.where(F.col("edge").isNotNull() & F.col("finalizer")), "gc-cycle-risk", subject=F.col("class_name"))]


def loop_copies(s: DataFrame) -> DataFrame:
    it = _kid("iter")
    loops = s.where(_is(("For", "AsyncFor")) & F.col("live"))
    copied = (it["kind"] == "Call") & (it["callee"] == "list") & (it["n_args"] > 0)
    call = F.when(copied, F.lit("list(...)")).otherwise(F.lit("a list comprehension"))
    return _finding(loops.where(copied | (it["kind"] == "ListComp")), "memory-swell.list-copy", **_at(it), subject=_kid("target")["dotted"], args={"call": call})


def text_like(s: DataFrame) -> DataFrame:
    """(path, node) of statements whose ``value`` is text: a literal, an f-string, str(...) or a sum with one."""
    leaf = (_is("Constant") & (F.col("const") == "str")) | _is("JoinedStr") | (_is("Call") & (_kid("func")["kind"] == "Name") & (_kid("func")["name"] == "str"))
    return s.where(leaf & (F.col("sum_field") == "value")).select("path", F.col("sum_slot").alias("node")).distinct()


def assignment_events(s: DataFrame, calls: DataFrame, text: DataFrame) -> DataFrame:
    """What plain assignments and with-items leave in names: text, a list, a thread executor."""
    v = _kid("value")
    listish = v["kind"].isin("List", "ListComp") | ((v["kind"] == "Call") & (v["callee"] == "list"))
    executors = calls.where(F.col("qual").isin(*rt.EXECUTOR_CTORS)).select("path", F.col("node").alias("__value"), F.lit(True).alias("__pool"))
    a = s.where(_is("Assign")).select(*AT, "scope", "last", listish.alias("is_list"), v["node"].alias("__value"), F.explode(_kids("targets")).alias("t")).where(F.col("t.kind") == "Name")
    a = a.join(text.withColumn("__text", F.lit(True)), list(AT), "left").join(executors, ["path", "__value"], "left")
    plain = a.select("path", "scope", F.col("t.name").alias("name"), F.col("last").alias("pos"), F.col("__text").isNotNull().alias("is_text"), F.coalesce("is_list", F.lit(False)).alias("is_list"),
                     F.col("__pool").isNotNull().alias("is_pool"))
    w = s.where(_is("withitem") & (_kid("optional_vars")["kind"] == "Name")).select(
        "path", "scope", _kid("optional_vars")["name"].alias("name"), F.col("parent").alias("pos"), _kid("context_expr")["node"].alias("__value"))
    entered = w.join(executors, ["path", "__value"]).select("path", "scope", "name", "pos", F.lit(None).cast("boolean").alias("is_text"), F.lit(None).cast("boolean").alias("is_list"),
                                                             F.lit(True).alias("is_pool"))
    return plain.unionByName(entered)


def state_rules(s: DataFrame, text: DataFrame, events: DataFrame, bound: DataFrame) -> list[DataFrame]:
    """Growing text and list membership in loops: rules that need what a name holds."""
    grown = s.where(_is("AugAssign") & (F.col("name") == "Add") & F.col("live") & (F.col("loop") > 0)).withColumn("t", _kid("target"))
    member = s.where(_is("Compare") & F.col("live") & (F.col("loop") > 0)).withColumn("pairs", F.arrays_zip(_kids("ops").alias("op"), _kids("comparators").alias("right")))
    member = member.withColumn("pair", F.explode("pairs")).where(F.col("pair.op.kind").isin("In", "NotIn") & (F.col("pair.right.kind") == "Name"))
    uses = grown.where(F.col("t.kind") == "Name").select("path", "node", F.col("t.name").alias("name"), "chain").unionByName(
        member.select("path", F.col("pair.right.node").alias("node"), F.col("pair.right.name").alias("name"), "chain"))
    state = held_state(uses, events, bound, ["is_text", "is_list"])
    grown = grown.join(state.select(*AT, "is_text"), list(AT), "left").join(text.withColumn("__text", F.lit(True)), list(AT), "left")
    member = member.withColumn("right", F.col("pair.right.node")).join(state.select("path", F.col("node").alias("right"), "is_list"), ["path", "right"])
    name = F.col("pair.right.name")
    return [_finding(grown.where(F.coalesce("is_text", F.lit(False)) | F.col("__text").isNotNull()), "text-inflation.concat", subject=F.col("t.dotted")),
            _finding(member.where("is_list"), "single-thread-stall.list-membership", subject=name, args={"name": name})]


def cache_rules(s: DataFrame, calls: DataFrame, quals: DataFrame) -> list[DataFrame]:
    """Unbounded caches, as decorators and as calls."""
    deco = s.where((F.col("field") == "decorator_list") & F.col("parent_kind").isin(*FUNCTION_KINDS) & F.col("live"))
    plain = deco.join(quals.select(*AT, "qual"), list(AT)).where(F.col("qual") == "functools.cache").select(*AT, "parent", "line", "col", "label")
    made = calls.where((F.col("field") == "decorator_list") & F.col("parent_kind").isin(*FUNCTION_KINDS) & (F.col("qual") == "functools.lru_cache") & _maxsize_none()).select(
        *AT, "parent", "line", "col", "label")
    fn = s.where(_is(FUNCTION_KINDS)).select("path", F.col("node").alias("parent"), F.col("name").alias("fn"), ((F.col("parent_kind") == "ClassDef") & (F.col("field") == "body")).alias("in_class"))
    first_arg = s.where(_is("arg") & F.col("field").isin("posonlyargs", "args")).groupBy("path", F.col("grand").alias("parent")).agg(F.min_by("name", "node").alias("first_arg"))
    d = plain.unionByName(made).join(fn, ["path", "parent"]).join(first_arg, ["path", "parent"], "left")
    method = F.col("in_class") & F.coalesce(F.col("first_arg") == "self", F.lit(False))
    form = calls.where(~((F.col("field") == "decorator_list") & F.col("parent_kind").isin(*FUNCTION_KINDS, "ClassDef")))
    cache = form.where((F.col("qual") == "functools.cache") & (_n("args") == 1))
    lru = form.where((F.col("qual") == "functools.lru_cache") & _maxsize_none()).select(*AT, "parent", "field", "parent_kind", "line", "col", "label")
    around = s.where(_is(("Call", "Assign", "AnnAssign"))).select(
        "path", F.col("node").alias("parent"), F.when(_is("Call"), _kid("args")["dotted"]).when(_is("Assign"), F.element_at(_kids("targets"), -1)["dotted"])
        .otherwise(_kid("target")["dotted"]).alias("__subject"), F.when(_is("Call"), F.lit("func")).otherwise(F.lit("value")).alias("field"))
    lru = lru.join(around, ["path", "parent", "field"], "left")
    return [_finding(d.where(method), "memory-swell.method-cache", subject=F.col("fn")), _finding(d.where(~method), "memory-swell.unbounded-cache", subject=F.col("fn")),
            _finding(cache, "memory-swell.unbounded-cache", subject=_kid("args")["dotted"]), _finding(lru, "memory-swell.unbounded-cache", subject=F.col("__subject"))]


def concat_loops(s: DataFrame, calls: DataFrame) -> DataFrame:
    """A name rebuilt from itself by a copying call in a loop."""
    first = _kid("args")
    c = calls.where((F.col("loop") > 0) & F.col("qual").isin(*rt.CONCAT_SEQUENCE_CALLS, *rt.CONCAT_FIRST_ARG_CALLS) & (F.col("parent_kind") == "Assign") & (F.col("field") == "value") & (_n("args") > 0))
    c = c.select(*AT, "parent", "qual", "line", "col", "label", first.alias("first"))
    target = s.where(_is("Assign") & (_n("targets") == 1)).select("path", F.col("node").alias("parent"), _kid("targets")["dotted"].alias("name")).where(F.col("name").isNotNull())
    c = c.join(target, ["path", "parent"])
    pieces = s.where((F.col("field") == "elts") & F.col("parent_kind").isin("List", "Tuple") & F.col("dotted").isNotNull()).select(
        "path", F.col("parent").alias("__list"), F.col("dotted").alias("name")).distinct()
    listed = c.where(F.col("qual").isin(*rt.CONCAT_SEQUENCE_CALLS)).withColumn("__list", F.col("first")["node"]).join(pieces, ["path", "__list", "name"], "left_semi").drop("__list")
    direct = c.where(F.col("qual").isin(*rt.CONCAT_FIRST_ARG_CALLS) & (F.col("first")["dotted"] == F.col("name")))
    hit = listed.select(*direct.columns).unionByName(direct)
    return _finding(hit, "memory-swell.concat-loop", subject=F.col("name"), args={"call": F.concat(F.col("qual"), F.lit("()")), "name": F.col("name")})


def stored_exceptions(s: DataFrame) -> DataFrame:
    """``except ... as e`` whose e is kept in an attribute, an item or a collection."""
    handlers = s.where(_is("ExceptHandler") & F.col("name").isNotNull()).select("path", F.col("node").alias("handler"), F.col("name").alias("exc"), F.col("scope").alias("__scope"))
    near = s.where(F.col("handler").isNotNull())
    words = _binding_words(near)
    rebound = words.select("path", "handler", F.col("word").alias("exc")).distinct()
    handlers = handlers.join(rebound, ["path", "handler", "exc"], "left_anti")
    loads = near.where(_is("Name") & (F.col("ctx") == "Load")).select(*AT, "handler", F.col("name").alias("exc"), "scope", "parent", "parent_kind", "field", "grand", "parent_field", "line", "col", "label")
    l = loads.join(handlers, ["path", "handler", "exc"]).where(F.col("scope") == F.col("__scope"))
    display = F.col("parent_kind").isin("Tuple", "List")
    l = l.withColumns({"place": F.when(display, F.col("grand")).otherwise(F.col("parent")), "held_as": F.when(display, F.col("parent")).otherwise(F.col("node"))})
    target, f = _kid("targets"), _kid("func")
    assigns = s.where(_is("Assign") & (_n("targets") == 1) & target["kind"].isin("Attribute", "Subscript")).select(
        "path", F.col("node").alias("place"), _kid("value")["node"].alias("held_as"), F.when(target["kind"] == "Attribute", target["dotted"]).alias("__subject"),
        F.when(target["kind"] == "Subscript", target["node"]).alias("__item"))
    items = s.where(F.col("parent_kind").eqNullSafe("Subscript") & (F.col("field") == "value")).select("path", F.col("parent").alias("__item"), F.col("dotted").alias("__owner"))
    assigns = assigns.join(items, ["path", "__item"], "left").select("path", "place", "held_as", F.coalesce("__subject", "__owner").alias("subject"))
    adds = s.where(_is("Call") & (f["kind"] == "Attribute") & f["name"].isin(*rt.STORE_METHODS) & (_n("keywords") == 0) & (_n("args") == 1)).select(
        "path", F.col("node").alias("place"), _kid("args")["node"].alias("held_as"), _receiver(f["dotted"]).alias("subject"))
    hit = l.join(assigns.unionByName(adds), ["path", "place", "held_as"])
    return _finding(hit, "frame-retention.stored-exception", subject=F.col("subject"), args={"name": F.col("exc")})


def _binding_words(s: DataFrame) -> DataFrame:
    """Every word a row binds or rebinds, one row per word; any part of an import's dotted names counts."""
    parts = lambda c: F.split(F.coalesce(c, F.lit("")), r"\.")
    words = (F.when(_is("Name") & F.col("ctx").isin("Store", "Del", "Comp"), F.array("name")).when(_is("arg") | _is(("FunctionDef", "AsyncFunctionDef", "ClassDef")), F.array("name"))
             .when(_is("alias"), F.array_append(parts(F.col("name")), F.col("module"))).when(_is("ImportFrom"), parts(F.col("module")))
             .when(_is("ExceptHandler"), F.array("name")).when(_is(("Global", "Nonlocal")), F.split("name", ",")))
    return s.withColumn("word", F.explode(words)).where(F.coalesce("word", F.lit("")) != "")


def open_files(s: DataFrame, calls: DataFrame, quals: DataFrame) -> DataFrame:
    """open() whose handle is neither managed, closed in its scope, nor handed over."""
    f = _kid("func")
    direct = calls.where(F.col("qual").isin("open", "builtins.open", "io.open")).select(*AT)
    path_calls = calls.where((F.col("qual") == "pathlib.Path") & (F.col("field") == "value") & (F.col("parent_kind") == "Attribute") & (F.col("parent_field") == "func")).select(
        "path", F.col("grand").alias("node"))
    by_path = s.where(_is("Call") & (f["kind"] == "Attribute") & (f["name"] == "open")).join(path_calls, list(AT), "left_semi").select(*AT)
    opened = s.where(_is("Call") & F.col("live")).join(direct.unionByName(by_path).distinct(), list(AT), "left_semi")
    handed = (F.col("holder_kind") == "withitem") | ((F.col("holder_kind") == "Call") & (F.col("holder_field") == "args")) | F.col("holder_kind").isin("Return", "Yield", "YieldFrom")
    kept = opened.where(~F.coalesce(handed, F.lit(False)))
    target = F.when(_is("Assign"), _kids("targets")).otherwise(_kids("target"))
    names = s.where(_is(("Assign", "AnnAssign"))).select("path", F.col("node").alias("holder"), F.col("fscope").alias("__in"), F.explode(target).alias("t")).where(F.col("t.kind") == "Name").select(
        "path", "holder", F.col("t.name").alias("word"), "__in")
    closes = s.where(_is("Call") & (f["kind"] == "Attribute") & (f["name"] == "close") & f["dotted"].rlike(r"^[^.]+\.close$")).select(
        "path", F.col("scope").alias("__in"), _receiver(f["dotted"]).alias("word")).distinct()
    closed = names.join(closes, ["path", "__in", "word"], "left_semi").select("path", "holder").distinct().withColumn("holder_field", F.lit("value"))
    return _finding(kept.join(closed, ["path", "holder", "holder_field"], "left_anti"), "resource-leak.file-handle")


def _direct_iteration() -> Column:
    """How a load only iterates its value once; null for any other use. Needs ``callee`` of a parent call."""
    builtin = (F.col("parent_kind") == "Call") & (F.col("field") == "args") & F.col("callee").isin(*rt.ITERATING_CALLS)
    return (F.when(F.col("parent_kind").isin("For", "AsyncFor") & (F.col("field") == "iter"), F.lit("a for loop"))
            .when((F.col("parent_kind") == "comprehension") & (F.col("field") == "iter"), F.lit("a comprehension"))
            .when(builtin, F.concat(F.col("callee"), F.lit("()"))))


def lists_used_once(s: DataFrame) -> DataFrame:
    """A list assigned to a name whose single use in the scope only iterates it."""
    v, target = _kid("value"), _kid("targets")
    whole = (v["kind"] == "Call") & (v["callee"] == "list") & (v["n_args"] == 1)
    made = s.where(_is("Assign") & (_n("targets") == 1) & (target["kind"] == "Name") & (F.col("scope") == F.element_at("within", -1)) & (whole | (v["kind"] == "ListComp"))).select(
        *AT, "scope", "line", "col", "label", v.alias("v"), target["name"].alias("word"), whole.alias("whole"))
    simple = s.where(_is("Call") & (_n("keywords") == 0) & (_kid("args")["kind"] != "Starred")).select("path", F.col("node").alias("__v"))
    made = made.withColumn("__v", F.col("v")["node"])
    made = made.where("not whole").unionByName(made.where("whole").join(simple, ["path", "__v"], "left_semi").select(*made.columns))
    # Only words that name such a list, or a parameter, are counted; a load counts in every body around it.
    binds = _binding_words(s).select("path", F.explode("within").alias("scope"), "word").groupBy("path", "scope", "word").agg(F.count(F.lit(1)).alias("binds"))
    parent_calls = s.where(_is("Call")).select("path", F.col("node").alias("parent"), _kid("func")["kind"].alias("fk"), _kid("func")["dotted"].alias("fd"),
                                               F.exists(_kids("args"), lambda a: a["kind"] == "Starred").alias("starred"))
    loads = s.where(_is("Name") & (F.col("ctx") == "Load")).join(parent_calls, ["path", "parent"], "left").withColumn("callee", F.when(F.col("fk") == "Name", F.col("fd")))
    loads = loads.withColumn("use", _direct_iteration())
    single = loads.select("path", F.explode("within").alias("scope"), F.col("name").alias("word"), F.struct(
        "node", "scope", "use", "callee", "field", "idx", "starred").alias("load")).groupBy("path", "scope", "word").agg(
            F.count(F.lit(1)).alias("loads"), F.first("load").alias("load")).where(F.col("loads") == 1)
    m = made.join(binds.where(F.col("binds") == 1).drop("binds"), ["path", "scope", "word"], "left_semi").join(single, ["path", "scope", "word"]).where(
        (F.col("load.node") > F.col("node")) & (F.col("load.scope") == F.col("scope")))
    # Passed on to a function of the module whose parameter is itself only iterated once.
    fn = s.where(_is(FUNCTION_KINDS) & (F.col("parent") == 0) & (F.col("field") == "body")).groupBy("path", F.col("name").alias("callee")).agg(F.max("node").alias("fn"))
    params = s.where(_is("arg") & F.col("field").isin("posonlyargs", "args")).select("path", F.col("grand").alias("fn"), "node", F.col("name").alias("param"), "field", "idx")
    pos = params.where(F.col("field") == "posonlyargs").groupBy("path", "fn").agg(F.count(F.lit(1)).alias("__pos"))
    params = params.join(pos, ["path", "fn"], "left").withColumn("idx", F.col("idx") + F.when(F.col("field") == "args", F.coalesce("__pos", F.lit(0))).otherwise(F.lit(0)))
    one = single.where(F.col("load.use").isNotNull()).select("path", F.col("scope").alias("fn"), F.col("word").alias("param"))
    eager = params.join(one, ["path", "fn", "param"], "left_semi").join(
        binds.select("path", F.col("scope").alias("fn"), F.col("word").alias("param")), ["path", "fn", "param"], "left_anti").join(fn, ["path", "fn"]).select(
            "path", "callee", "idx", F.concat(F.col("callee"), F.lit("(), which only iterates it")).alias("__passed"))
    m = m.withColumns({"callee": F.when((F.col("load.field") == "args") & ~F.col("load.starred"), F.col("load.callee")), "idx": F.col("load.idx")}).join(eager, ["path", "callee", "idx"], "left")
    m = m.withColumn("use", F.coalesce("load.use", "__passed")).where(F.col("use").isNotNull())
    call = F.when(F.col("whole"), F.lit("list(...)")).otherwise(F.lit("a list comprehension"))
    return _finding(m, "memory-swell.list-once", **_at(F.col("v")), subject=F.col("word"), args={"name": F.col("word"), "call": call, "use": F.col("use")})


def function_work(s: DataFrame, calls: DataFrame) -> DataFrame:
    """Per function: does it loop over its input in Python, and does it or anything it calls in the file do I/O or native work?"""
    f, q = _kid("func"), F.coalesce("qual", F.lit(""))
    begins = lambda prefixes: q.rlike("^(" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")")
    io = q.isin(*rt.IO_NAMES) | begins(rt.IO_PREFIXES) | ((f["kind"] == "Attribute") & f["name"].isin(*rt.IO_ATTRS))
    own = calls.groupBy("path", F.col("scope").alias("fn")).agg(F.max(F.coalesce(io | begins(rt.NATIVE_PREFIXES), F.lit(False))).alias("busy"))
    edges = calls.where((f["kind"] == "Name") & F.col("func").isNotNull()).select("path", F.col("scope").alias("caller"), F.col("func").alias("fn")).distinct()
    # Functions that reach a busy one: walk the calls backwards, level by level.
    busy = cut_lineage(own.where("busy").select("path", "fn"))
    seen = busy
    while True:
        step = busy.join(edges, ["path", "fn"]).select("path", F.col("caller").alias("fn")).distinct().join(seen, ["path", "fn"], "left_anti")
        busy = cut_lineage(step)
        if busy.isEmpty():
            break
        seen = seen.unionByName(busy)
    params = s.where(_is("arg") & (F.col("name") != "self")).select("path", F.col("grand").alias("fn"), F.col("name").alias("word")).distinct()
    inputs = s.where(_is("Name")).select("path", F.col("name").alias("word"), F.explode("iters").alias("loop_node"))
    loops = s.where(_is(("For", "AsyncFor", "While", "comprehension"))).select("path", F.col("node").alias("loop_node"), F.col("scope").alias("fn"))
    over_input = inputs.join(loops, ["path", "loop_node"]).join(params, ["path", "fn", "word"], "left_semi").select("path", "fn").distinct()
    return over_input.join(seen, ["path", "fn"], "left_anti")


def thread_targets(s: DataFrame, calls: DataFrame, quals: DataFrame, events: DataFrame, bound: DataFrame) -> DataFrame:
    """Functions handed to threads that only loop over their input in Python."""
    f = _kid("func")
    threads = calls.where(F.col("qual").isin(*rt.THREAD_CTORS)).withColumn("t", F.explode(F.filter("kids", lambda k: (k["field"] == "keywords") & (k["name"] == "target"))))
    handed = calls.where((f["kind"] == "Attribute") & f["name"].isin(*rt.EXECUTOR_METHODS) & (_n("args") > 0)).withColumn("t", _kid("args"))
    receivers = s.where(_is("Name") & (F.col("field") == "value") & (F.col("parent_kind") == "Attribute") & (F.col("parent_field") == "func")).select("path", "node", "name", "chain", "grand")
    pools = receivers.join(handed.select("path", F.col("node").alias("grand")), ["path", "grand"], "left_semi")
    named = pools.join(held_state(pools, events, bound, ["is_pool"]).where("is_pool"), list(AT), "left_semi").select("path", F.col("grand").alias("node"))
    made = calls.where(F.col("qual").isin(*rt.EXECUTOR_CTORS) & (F.col("field") == "value") & (F.col("parent_kind") == "Attribute") & (F.col("parent_field") == "func")).select(
        "path", F.col("grand").alias("node"))
    handed = handed.join(named.unionByName(made).distinct(), list(AT), "left_semi")
    columns = ["path", "label", "t"]
    targets = threads.select(*columns).unionByName(handed.select(*columns)).where(F.col("t.kind") == "Name")
    # A keyword's summary names its value; the value's own row carries the resolution.
    direct = targets.withColumn("node", F.col("t.node")).join(quals.select(*AT, "func"), list(AT)).where(F.col("func").isNotNull())
    word = s.where(_is("keyword")).select("path", "node", _kid("value")["node"].alias("__v"))
    keyed = targets.withColumn("node", F.col("t.node")).join(word, list(AT)).drop("node").withColumnRenamed("__v", "node").join(quals.select(*AT, "func"), list(AT)).where(F.col("func").isNotNull())
    both = direct.select(*columns, "func").unionByName(keyed.select(*columns, "func"))
    hit = both.withColumnRenamed("func", "fn").join(function_work(s, calls), ["path", "fn"], "left_semi")
    name = F.col("t.dotted")
    return _finding(hit, "single-thread-stall.cpu-thread", **_at(F.col("t")), subject=name, args={"func": name})


def scan_rules(sources: DataFrame, gil_disabled: bool = False, marker: str | None = None) -> DataFrame:
    """All findings of (path, text) files: path, line, col, code, severity, scope, subject, args.

    One finding per position and code. Lines that contain ``marker`` are left out. Files that do not parse have none.
    """
    s = stored(parse(sources))
    bound = stored(bindings(s))
    chained = F.col("dotted").isNotNull() & (F.col("ctx") == "Load") & ~((F.col("parent_kind") == "Attribute") & (F.col("field") == "value"))
    quals = stored(resolve(s.where(chained), bound))
    of_call = quals.select("path", F.col("node").alias("__f"), "qual", "func", "cls")
    calls = s.where(_is("Call") & F.col("live")).withColumn("__f", _kid("func")["node"]).join(of_call, ["path", "__f"], "left").drop("__f")
    calls = stored(calls.withColumn("qual", F.coalesce("qual", F.lit(""))))
    text = text_like(s)
    events = assignment_events(s, calls, text)
    parts = [*call_rules(calls), whole_file_split(s), object_dtype(s, calls, quals), *class_rules(calls, stored(class_facts(s, quals))), loop_copies(s),
             *state_rules(s, text, events, bound), *cache_rules(s, calls, quals), concat_loops(s, calls), stored_exceptions(s), open_files(s, calls, quals), lists_used_once(s)]
    if not gil_disabled:
        parts.append(thread_targets(s, calls, quals, events, bound))
    found = reduce(DataFrame.unionByName, [p.withColumn("rule", F.lit(i)) for i, p in enumerate(parts)])
    if marker:
        lines = sources.select("path", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("i", "content")).where(F.col("content").contains(marker))
        found = found.join(lines.select("path", (F.col("i") + 1).alias("line")), ["path", "line"], "left_anti")
    return with_severity(first_per_position(found))


def first_per_position(found: DataFrame) -> DataFrame:
    """One finding per (path, line, col, code): that of the first rule that found it, then the smallest subject."""
    rule = F.col("rule") if "rule" in found.columns else F.lit(0)
    return found.groupBy("path", "line", "col", "code").agg(F.min_by(F.struct("scope", "subject", "args"), F.struct(
        rule, F.coalesce("subject", F.lit("")), F.to_json("args"))).alias("f")).select("path", "line", "col", "code", "f.*")


def with_severity(found: DataFrame) -> DataFrame:
    """Severity and the fixed metadata of static findings."""
    levels = F.create_map(*[F.lit(x) for pair in rt.SEVERITIES.items() for x in pair])
    return found.withColumns({"severity": F.try_element_at(levels, F.col("code")), "category": F.substring_index("code", ".", 1),
                              "status": F.lit("potential"), "confidence": F.lit("static")})


def with_messages(found: DataFrame, facts: dict[str, str] | None = None, catalogue: dict[str, tuple] | None = None) -> DataFrame:
    """The message of each finding, from the catalogue, the interpreter's facts and the finding's own values."""
    entries = rt.MESSAGES if catalogue is None else catalogue
    sized = F.create_map(*[x for code, (s, _) in entries.items() for x in (F.lit(code), F.lit(s).cast("string"))])
    neutral = F.create_map(*[x for code, (_, n) in entries.items() for x in (F.lit(code), F.lit(n))])
    known = F.create_map(*[F.lit(x) for pair in (facts or {}).items() for x in pair]) if facts else F.expr("cast(map() as map<string,string>)")
    own_wins = F.map_concat(F.map_filter(known, lambda k, _: ~F.array_contains(F.map_keys("args"), k)), F.col("args"))
    text = render_message(F.try_element_at(sized, F.col("code")), F.try_element_at(neutral, F.col("code")), own_wins)
    return found.withColumn("message", F.concat(subject_prefix(F.col("scope"), F.col("subject")), text))


def rule_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("path").alias("files"))


def symbols(sources: DataFrame, most_calls: int | None = None) -> DataFrame:
    """Per line: enclosing scope, assigned names, called names (the first ``most_calls`` where that is given), and the end line of a function that starts there."""
    s = stored(parse(sources)) if "kids" not in sources.columns else sources
    on_line = s.where(F.col("line").isNotNull())
    scope = on_line.groupBy("path", "line").agg(F.max_by("label", "node").alias("scope"))
    held = (_is("Name") | _is("Attribute")) & F.col("ctx").isin("Store", "Comp")
    assigned = on_line.where(held & F.col("dotted").isNotNull()).select("path", "line", "node", F.col("dotted").alias("word"))
    items = on_line.where(_is("Subscript") & (F.col("ctx") == "Store") & _kid("value")["dotted"].isNotNull()).select(
        "path", "line", "node", F.concat(_kid("value")["dotted"], F.lit("[…]")).alias("word"))
    called = on_line.where(_is("Call") & _kid("func")["dotted"].isNotNull()).select("path", "line", "node", _kid("func")["dotted"].alias("word"))

    def listed(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
        first = df.groupBy("path", "line", "word").agg(F.min("node").alias("node"))
        if most:
            first = top_k(first, ["path", "line"], [F.col("node").asc()], most).drop("rank")
        return first.groupBy("path", "line").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "word"))), lambda x: x["word"]).alias(name))

    decorators = s.where(F.col("field") == "decorator_list").groupBy("path", F.col("parent").alias("node")).agg(F.min("line").alias("__first"))
    ends = s.where(_is(FUNCTION_KINDS)).join(decorators, list(AT), "left").groupBy("path", F.least(F.col("line"), F.coalesce("__first", "line")).alias("line")).agg(
        F.max_by("end_line", "node").alias("function_end"))
    out = scope.join(listed(assigned.unionByName(items), "assigns"), ["path", "line"], "left").join(listed(called, "calls", most_calls), ["path", "line"], "left")
    return out.join(ends, ["path", "line"], "left")


def scopes(s: DataFrame) -> DataFrame:
    """Classes, functions and inline scopes of syntax rows, for the scope operators."""
    inline = ("Lambda", "GeneratorExp")
    shown = F.when(_is("Lambda"), F.lit("<lambda>")).when(_is("GeneratorExp"), F.lit("<genexpr>")).otherwise(F.col("name"))
    return s.where(_is((*FUNCTION_KINDS, "ClassDef", *inline))).select(
        F.col("path").alias("file"), F.col("line").alias("first_line"), F.col("end_line").alias("last_line"), shown.alias("name"), F.col("node").alias("position"),
        (~_is("ClassDef")).alias("is_function"), _is(inline).alias("inline"))
