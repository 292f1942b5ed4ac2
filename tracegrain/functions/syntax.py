"""Python source text to one row per syntax node. Rules over the rows are Spark queries (``operators.rules``)."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa

_KID = ("struct<field:string,idx:int,node:int,kind:string,name:string,dotted:string,const:string,text:string,callee:string,n_args:int,n_elts:int,"
        "line:int,col:int,end_line:int,end_col:int>")
SYNTAX = (
    "path string, node int, last int, depth int, parent int, field string, idx int, kind string, name string, module string, ctx string, const string, text string, "
    "dotted string, line int, col int, end_line int, end_col int, scope int, fscope int, chain array<int>, loop int, in_async boolean, live boolean, label string, "
    "parent_kind string, parent_field string, grand int, slot int, slot_field string, sum_slot int, sum_field string, holder int, holder_kind string, holder_field string, "
    f"handler int, within array<int>, classes array<int>, iters array<int>, kids array<{_KID}>")

_SCOPES = (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_FUNCS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
_COMPS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


def dotted(n: ast.AST | None) -> str | None:
    """``a.b.c`` of a name or attribute chain, else None."""
    parts = []
    while isinstance(n, ast.Attribute):
        parts.append(n.attr)
        n = n.value
    return ".".join([n.id, *reversed(parts)]) if isinstance(n, ast.Name) else None


def _name(n: ast.AST) -> str | None:
    for attribute in ("id", "attr", "name", "arg"):
        v = getattr(n, attribute, None)
        if isinstance(v, str):
            return v
    return ",".join(n.names) if isinstance(n, (ast.Global, ast.Nonlocal)) else None


def _brief(n: ast.AST, columns) -> dict:
    """What a parent's row says about a child; a keyword speaks for its value."""
    v = n.value if isinstance(n, ast.keyword) else n
    constant = isinstance(v, ast.Constant)
    line, col, end_line, end_col = columns(v)
    return {
        "kind": type(v).__name__, "name": _name(n), "dotted": dotted(v), "const": type(v.value).__name__ if constant else None,
        "text": str(v.value) if constant else None, "callee": dotted(v.func) if isinstance(v, ast.Call) else None,
        "n_args": len(v.args) if isinstance(v, ast.Call) else None, "n_elts": len(v.elts) if hasattr(v, "elts") else None,
        "line": line, "col": col, "end_line": end_line, "end_col": end_col}


def _columns(text: str):
    """Positions of a node with columns counted in UTF-16 units, as editors do."""
    lines = text.encode("utf-8").splitlines() or [b""]

    def units(line: int | None, col: int | None) -> int | None:
        if line is None or line > len(lines) or lines[line - 1].isascii():
            return col
        return len(lines[line - 1][:col].decode("utf-8", "ignore").encode("utf-16-le")) // 2

    def of(n: ast.AST) -> tuple:
        at = [getattr(n, a, None) for a in ("lineno", "col_offset", "end_lineno", "end_col_offset")]
        return at[0], units(at[0], at[1]), at[2], units(at[2], at[3])

    return of


def syntax_rows(path: str, text: str) -> list[dict]:
    """Rows of one file in document order; none when it does not parse.

    Besides the node itself a row holds where it stands: lexical scope and the scopes its names resolve through, loop depth,
    the enclosing classes, function bodies, named handlers and loop inputs, and where its value goes (``slot`` through dict
    displays, ``sum_slot`` through additions, ``holder`` through access chains).
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    columns = _columns(text)
    rows: list[dict] = []
    top = {"parent": None, "field": None, "idx": 0, "depth": 0, "scope": 0, "fscope": 0, "chain": [0], "bases": [], "loop": 0, "in_async": False, "live": True,
           "names": (), "comp": False, "handler": None, "within": [], "classes": [], "iters": []}
    stack: list[tuple[ast.AST, dict]] = [(tree, top)]
    while stack:
        n, c = stack.pop()
        i, up = len(rows), rows[c["parent"]] if c["parent"] is not None else None
        if isinstance(n, _DEFS):
            c = {**c, "names": c["names"] + ((n.name, not isinstance(n, ast.ClassDef)),)}
        pk = up["kind"] if up else None
        through = {
            "slot": pk == "Dict" and c["field"] == "values", "sum_slot": pk == "BinOp" and up["name"] == "Add",
            "holder": pk in ("Attribute", "Await", "Subscript") or (pk == "Call" and c["field"] == "func")}
        row = {k: c[k] for k in ("parent", "field", "idx", "depth", "scope", "fscope", "chain", "loop", "in_async", "live", "handler", "within", "classes", "iters")}
        line, col, end_line, end_col = columns(n)
        row |= {
            "path": path, "node": i, "last": i, "kind": type(n).__name__, "name": type(n.op).__name__ if hasattr(n, "op") else _name(n),
            "module": n.module if isinstance(n, ast.ImportFrom) and not n.level else getattr(n, "asname", None),
            "ctx": "Comp" if c["comp"] and isinstance(getattr(n, "ctx", None), ast.Store) else type(n.ctx).__name__ if hasattr(n, "ctx") else None,
            "const": type(n.value).__name__ if isinstance(n, ast.Constant) else None, "text": str(n.value) if isinstance(n, ast.Constant) else None,
            "dotted": dotted(n), "line": line, "col": col, "end_line": end_line, "end_col": end_col,
            "label": ".".join(x for x, _ in c["names"]) + ("()" if c["names"][-1][1] else "") if c["names"] else None,
            "parent_kind": pk, "parent_field": up["field"] if up else None, "grand": up["parent"] if up else None,
            "slot": up["slot"] if through["slot"] else c["parent"], "slot_field": up["slot_field"] if through["slot"] else c["field"],
            "sum_slot": up["sum_slot"] if through["sum_slot"] else c["parent"], "sum_field": up["sum_field"] if through["sum_slot"] else c["field"],
            "holder": up["holder"] if through["holder"] else c["parent"], "holder_kind": up["holder_kind"] if through["holder"] else pk,
            "holder_field": up["holder_field"] if through["holder"] else c["field"], "kids": []}
        rows.append(row)
        below = []
        for field, value in ast.iter_fields(n):
            for k, child in enumerate(value if isinstance(value, list) else [value]):
                if isinstance(child, ast.AST) and not isinstance(child, (ast.expr_context, ast.operator, ast.unaryop, ast.boolop)):
                    row["kids"].append({"field": field, "idx": k, "node": None, **_brief(child, columns)})
                    below.append((child, _step(n, i, field, k, c)))
        stack.extend(reversed(below))
    for row in reversed(rows):
        if row["parent"] is not None:
            up = rows[row["parent"]]
            up["last"] = max(up["last"], row["last"])
            for kid in up["kids"]:
                if kid["field"] == row["field"] and kid["idx"] == row["idx"]:
                    kid["node"] = row["node"]
    return rows


def _step(n: ast.AST, i: int, field: str, k: int, c: dict) -> dict:
    """The surroundings of a child of ``n`` in a field."""
    d = {**c, "parent": i, "field": field, "idx": k, "depth": c["depth"] + 1}
    if isinstance(n, _SCOPES) and field == "body":
        inside_class = c["bases"] and not isinstance(n, ast.ClassDef)
        outer = c["bases"][0] if inside_class else c["chain"]
        d |= {"scope": i, "chain": [i, *outer] if i else [0], "loop": c["loop"] if isinstance(n, ast.ClassDef) else 0}
        d["bases"] = (c["bases"] or [c["chain"]]) if isinstance(n, ast.ClassDef) else []
        if not isinstance(n, ast.ClassDef):
            d["fscope"] = i
            d["in_async"] = isinstance(n, ast.AsyncFunctionDef)
        if not isinstance(n, (ast.ClassDef, ast.Lambda)):
            d["within"] = [*c["within"], i]
    if isinstance(n, ast.ClassDef):
        d["classes"] = [*c["classes"], i]
    if isinstance(n, _DEFS) and field == "decorator_list":
        d["names"] = c["names"][:-1]
    if (isinstance(n, _FUNCS) and field in ("returns", "type_params")) or (isinstance(n, ast.arg) and field == "annotation"):
        d["live"] = False
    if (isinstance(n, (ast.For, ast.AsyncFor, ast.While)) and field == "body") or isinstance(n, _COMPS):
        d["loop"] = d["loop"] + 1
    if isinstance(n, (ast.For, ast.AsyncFor, ast.comprehension)) and field == "iter" or isinstance(n, ast.While) and field == "test":
        d["iters"] = [*c["iters"], i]
    if isinstance(n, ast.comprehension) and field == "target":
        d["comp"] = True
    if isinstance(n, ast.ExceptHandler) and n.name:
        d["handler"] = i if field == "body" else None
    return d


ROWS_PER_BATCH = 20_000


def parser(schema: pa.Schema):
    """A ``mapInArrow`` body from (path, text) to syntax rows."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for path, text in zip(batch.column("path"), batch.column("text")):
                rows += syntax_rows(path.as_py(), text.as_py())
                if len(rows) >= ROWS_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return parse
