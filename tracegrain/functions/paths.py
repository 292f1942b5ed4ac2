"""Path, name and frame-origin expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FRAME = "struct<file:string,line:int,name:string,first_line:int,user:boolean>"

# Interpreter-internal modules and the labels they are reported under.
FROZEN_MODULES = {
    "importlib._bootstrap": ("Python import system", "loading a module (import)"),
    "importlib._bootstrap_external": ("Python import system", "finding and reading module files (import)"),
    "zipimport": ("Python import system", "importing from a zip archive"),
    "runpy": ("Python script launcher", "starting your script"),
}
INSTALL_FOLDERS = ("site-packages", "dist-packages", ".venv", "node_modules")
# Native symbols that mark an interpreter arena request.
ARENA_SYMBOLS = ("new_arena", "_PyObject_Arena", "pymalloc_alloc", "allocateArena")


def norm_path(path: Column, windows: bool = False) -> Column:
    """Forward slashes; lower case where the file system ignores case."""
    out = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.lower(out) if windows else out


def rel_path(path: Column, root: Column, windows: bool = False) -> Column:
    """Path relative to ``root`` when inside it, else with slashes normalised only."""
    slashed = norm_path(path)
    base = F.regexp_replace(norm_path(root), "/?$", "/")
    inside = norm_path(path, windows).startswith(norm_path(base, windows))
    return F.when(inside, F.substr(slashed, F.length(base) + 1)).otherwise(slashed)


def file_key(path: Column, script: Column, windows: bool = False) -> Column:
    """Path relative to the folder of the run's script, so another checkout still matches."""
    full = norm_path(path, windows)
    folder = F.regexp_replace(norm_path(script, windows), "/[^/]*$", "/")
    return F.when(full.startswith(folder), F.substr(full, F.length(folder) + 1)).otherwise(full)


def enclosing_name(qualname: Column) -> Column:
    """Drop trailing ``<lambda>``-like parts, so an inline scope counts in its enclosing function."""
    trimmed = F.regexp_replace(qualname, r"(?:(?:^|\.)<[^.]*)+$", "")
    return F.when(trimmed == "", F.lit("<module>")).otherwise(trimmed)


def shown_name(frame: Column) -> Column:
    """A frame's name, or its line when the code has no name."""
    named = F.coalesce(frame["name"], F.lit("")) != ""
    return F.when(named, frame["name"]).otherwise(F.concat(F.lit("line "), frame["line"].cast("string")))


def function_key(frame: Column) -> Column:
    """Identity of a function across its call sites."""
    return F.to_json(F.struct(frame["file"].alias("file"), frame["first_line"].alias("first_line"), frame["name"].alias("name")))


# Labels and details of frame origins in the tree's output.
INTERNALS, BUILT_IN = "Python internals", "built into the interpreter ("
YOURS = "your code"
EVALUATED, NO_FILE = "code run with exec() or eval()", "compiled at runtime, so there is no file to open"
GENERATED, AT_RUNTIME = "generated code", "created at runtime ("
INSTALLED, STANDARD, OUTSIDE, MODULE = " (installed package)", " (standard library)", " (outside your project)", "module "


def frame_origin(file: Column, user: Column, line: Column) -> Column:
    """struct(kind, label, detail): whose code a frame is, judged from its path alone."""
    path = norm_path(file)
    base = F.element_at(F.split(path, "/"), -1)
    shown = F.when(base == "__init__.py", F.regexp_extract(path, r"((?:[^/]*/)?[^/]*)$", 1)).otherwise(base)
    frozen = F.regexp_extract(path, r"^<frozen ([\w.]+)>$", 1)
    package = F.regexp_extract(path, r"/(?:site|dist)-packages/([^/]+)", 1)
    std = F.regexp_extract(path, r"(?i)/(?:lib/python\d+(?:\.\d+)?t?|Lib)/(.+)\.py$", 1)
    module = F.replace(F.regexp_replace(std, "/__init__$", ""), F.lit("/"), F.lit("."))
    top = F.element_at(F.split(module, r"\."), 1)

    def made(kind: str, label: Column, detail: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), label.alias("label"), detail.alias("detail"))

    known_label, known_detail = F.lit(INTERNALS), F.concat(F.lit(BUILT_IN), frozen, F.lit(")"))
    for name, (label, detail) in FROZEN_MODULES.items():
        known_label = F.when(frozen == name, F.lit(label)).otherwise(known_label)
        known_detail = F.when(frozen == name, F.lit(detail)).otherwise(known_detail)
    nothing = F.lit("")
    return (
        F.when(user, made("user", F.concat(shown, F.lit(":"), line.cast("string")), F.lit(YOURS)))
        .when(frozen != "", made("internal", known_label, known_detail))
        .when(path == "<string>", made("internal", F.lit(EVALUATED),
                                       F.lit(NO_FILE)))
        .when(path.startswith("<"), made("internal", F.lit(GENERATED),
                                         F.concat(F.lit(AT_RUNTIME), F.regexp_replace(path, "^<|.$", ""), F.lit(")"))))
        .when(package != "", made("library", F.concat(F.regexp_replace(package, r"\.py$", ""), F.lit(INSTALLED)), nothing))
        .when(std != "", made("stdlib", F.concat(top, F.lit(STANDARD)),
                              F.when(module == top, nothing).otherwise(F.concat(F.lit(MODULE), module))))
        .otherwise(made("library", F.concat(base, F.lit(OUTSIDE)), nothing))
    )


def is_user(file: Column, root: Column, excluded: list[str] = ()) -> Column:
    """Under the root, and neither generated, excluded nor installed."""
    path = norm_path(file)
    keep = ~path.startswith("<") & path.startswith(F.regexp_replace(norm_path(root), "/?$", "/")) & ~path.contains("site-packages")
    for folder in excluded:
        keep = keep & ~path.startswith(folder.rstrip("/") + "/")
    return keep


def allocator_domain(allocator: Column, native_stack: Column) -> Column:
    """Which allocator answered a request."""
    arena = F.exists(native_stack, lambda f: f["function"].rlike("|".join(ARENA_SYMBOLS)))
    return (F.when(allocator.startswith("PYMALLOC_"), F.lit("python_allocator"))
            .when(F.coalesce(arena, F.lit(False)), F.lit("interpreter_arena"))
            .otherwise(F.lit("system_allocator")))


def site_source(stack: Column, root: Column, domain: Column, profiler_prefixes: list[str] = ()) -> Column:
    """struct(scope, source): the innermost frame that decides whose request an allocation is.

    Frames are innermost first. A profiler frame decides at once; installed code under the root is passed over.
    """
    base = F.regexp_replace(norm_path(root), "/?$", "/")
    installed = "(^|/)(" + "|".join(f.replace(".", r"\.") for f in INSTALL_FOLDERS) + ")(/|$)"

    def own(f: Column) -> Column:
        hit = F.lit(False)
        for prefix in profiler_prefixes:
            hit = hit | f["file"].startswith(prefix)
        return hit

    def target(f: Column) -> Column:
        return ~f["file"].startswith("<") & f["file"].startswith(base) & ~f["file"].rlike(installed)

    tagged = F.transform(F.coalesce(stack, F.expr("cast(array() as array<struct<file:string,line:int,function:string>>)")),
                         lambda f, i: F.struct(f["file"].alias("file"), f["line"].alias("line"), f["function"].alias("function"),
                                               i.alias("i"), own(f).alias("own"), target(f).alias("target")))
    first = F.get(F.filter(tagged, lambda f: f["own"] | f["target"]), F.lit(0))
    role = F.when((domain == "python_allocator") & (first["i"] == 0), F.lit("allocation_frame")).otherwise(F.lit("traced_user_callsite"))
    source = F.struct(first["file"].alias("file"), first["line"].alias("line"), first["function"].alias("function"), role.alias("role"))
    return F.struct(
        F.when(first.isNull(), F.lit("external")).when(first["own"], F.lit("profiler")).otherwise(F.lit("target")).alias("scope"),
        F.when(first.isNotNull() & ~first["own"], source).alias("source"),
    )


def remap_path(path: Column, mappings: list[tuple[str, str]]) -> Column:
    """Rebase a path by the longest configured prefix; unmapped paths stay as they are."""
    slashed = norm_path(path)
    out = path
    for source, target in sorted(((s.rstrip("/"), t.rstrip("/")) for s, t in mappings), key=lambda m: len(m[0])):
        inside = (slashed == source) | slashed.startswith(source + "/")
        out = F.when(inside, F.concat(F.lit(target), F.substr(slashed, F.lit(len(source) + 1)))).otherwise(out)
    return out


def text_hash(text: Column) -> Column:
    """SHA-1 of the text with CRLF line ends normalised."""
    return F.sha1(F.replace(text, F.lit("\r\n"), F.lit("\n")))
