"""Functions on Python source code; a parser has no column expression, so these are Arrow-batched UDFs."""

from __future__ import annotations

import ast
import difflib
import hashlib
import json
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSPECTION = T.StructType([*[T.StructField(n, T.BooleanType()) for n in ("syntax_ok", "has_entry", "reached", "falls_back")], T.StructField("n_functions", T.IntegerType())])
MUTATION = T.StructType([T.StructField("mutated", T.StringType()), T.StructField("spec", T.StringType()), T.StructField("similarity", T.DoubleType())])
#: Letters up to which longest blocks are looked for in sets of slices, whose size is the square of it at most.
SLICED = 4096
_COUNTS = ("calls", "imports", "spec_calls", "reversed_calls", "unknown_calls")
AUDIT = T.StructType(
    [
        *[T.StructField(n, T.IntegerType()) for n in _COUNTS],
        *[T.StructField(n, T.BooleanType()) for n in ("parses", "placeholder", "has_entry")],
        T.StructField("imported", T.ArrayType(T.StringType())),
    ]
)


def _parse(source: str | None) -> ast.Module | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _unparse(tree: ast.Module) -> str | None:
    """None where a tree is nested too deeply, or a number too long, to be written."""
    try:
        return ast.unparse(tree)
    except (RecursionError, ValueError):
        return None


def _normal(source: str) -> str:
    tree = _parse(source)
    written = None if tree is None else _unparse(tree)
    return " ".join(source.split()) if written is None else written


@F.pandas_udf(T.StringType())
def normalized_code(source: pd.Series) -> pd.Series:
    """The parsed and unparsed source; text that isn't Python loses its extra white space."""
    return source.map(_normal, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def parses(source: pd.Series) -> pd.Series:
    return source.map(lambda s: s is not None and _parse(s) is not None)


def _family(category: str, source: str, signals: tuple[str, ...]) -> str:
    tree = _parse(source)
    names = sorted({n.func.attr for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute)}) if tree else []
    names = names or sorted(s for s in signals if s in source)
    return hashlib.sha256(json.dumps([category, names], separators=(",", ":")).encode()).hexdigest()[:16]


def family_id(category, source, signals: tuple[str, ...] = ()):
    """16 hex digits of a category and the names of methods that a source calls, or else of the signals in it."""

    @F.pandas_udf(T.StringType())
    def family(c: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([_family(x or "", y or "", signals) for x, y in zip(c, s, strict=True)])

    return family(category, source)


def _block(a: str, b: str) -> tuple[int, int, int]:
    """Place and length of the longest string in both: the first in ``a``, then in ``b``. Found by its length, in sets of slices."""
    n = min(len(a), len(b))
    low = next((k for k in range(n) if a[k] != b[k]), n)
    low, high = max(low, next((k for k in range(n) if a[-1 - k] != b[-1 - k]), n)), n
    size = low + 1
    while low < high:
        held = {b[k : k + size] for k in range(len(b) - size + 1)}
        if any(a[k : k + size] in held for k in range(len(a) - size + 1)):
            low = size
        else:
            high = size - 1
        size = (low + high + 1) // 2
    if not low:
        return 0, 0, 0
    held = {b[k : k + low] for k in range(len(b) - low + 1)}
    at = next(k for k in range(len(a) - low + 1) if a[k : k + low] in held)
    return at, b.index(a[at : at + low]), low


def _ratio(a: str, b: str) -> float:
    """The ratio of ``difflib.SequenceMatcher`` without junk; it counts places letter by letter, which takes ten times as long on programs."""
    if max(len(a), len(b)) > SLICED:
        return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    same, todo = 0, [(a, b)]
    while todo:
        x, y = todo.pop()
        i, j, size = _block(x, y) if x and y else (0, 0, 0)
        if size:
            same += size
            todo += [(x[:i], y[:j]), (x[i + size :], y[j + size :])]
    return 2.0 * same / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's ratio of two sources after normalization."""
    return pd.Series([_ratio(_normal(x or ""), _normal(y or "")) for x, y in zip(a, b, strict=True)])


def _live(body: list[ast.stmt]) -> Iterator[ast.AST]:
    """Statements and expressions that can run, at every level: branches and loops on constants are decided, what follows a
    return is dead, and functions defined inside wait for a call."""
    for node in body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            continue
        if isinstance(node, ast.If | ast.While) and isinstance(node.test, ast.Constant):
            yield from _live(node.body if node.test.value else node.orelse)
            if isinstance(node, ast.If):
                continue
            if node.test.value and not any(isinstance(x, ast.Break) for x in ast.walk(node)):
                return
            continue
        blocks = [x for x in ast.iter_child_nodes(node) if isinstance(x, ast.stmt | ast.ExceptHandler | ast.match_case)]
        for part in ast.iter_child_nodes(node):
            if part not in blocks:
                yield from ast.walk(part)
        for name in ("body", "orelse", "finalbody"):
            yield from _live(getattr(node, name, []))
        for inner in (*getattr(node, "handlers", []), *getattr(node, "cases", [])):
            yield from _live(inner.body)
        if isinstance(node, ast.Return | ast.Raise | ast.Break | ast.Continue):
            return


def _calls(body: list[ast.stmt]) -> set[str]:
    return {ast.unparse(node.func) for node in _live(body) if isinstance(node, ast.Call)}


def _names(call: str, wanted: str) -> bool:
    """Whether a dotted name is ``wanted`` or ends in it as a whole name."""
    return call == wanted or call.endswith("." + wanted) or (wanted.endswith(".") and call.startswith(wanted))


def _inspect(source: str | None, entry: str, wanted: str, fallback: str) -> dict:
    tree = _parse(source)
    if tree is None:
        return {"syntax_ok": False, "has_entry": False, "reached": False, "falls_back": False, "n_functions": 0}
    aliases = {a.asname or a.name: (f"{n.module}.{a.name}" if isinstance(n, ast.ImportFrom) else a.name) for n in ast.walk(tree) if isinstance(n, ast.Import | ast.ImportFrom) for a in n.names}
    functions = {n.name: n.body for n in tree.body if isinstance(n, ast.FunctionDef)}
    seen, todo, calls = set(), [entry], set()
    while todo:
        name = todo.pop()
        if name in seen or name not in functions:
            continue
        seen.add(name)
        for call in _calls(functions[name]):
            head, _, rest = call.partition(".")
            calls.add(".".join(filter(None, (aliases.get(head, head), rest))))
            todo.append(head)
    return {"syntax_ok": True, "has_entry": entry in functions, "reached": any(_names(c, wanted) for c in calls), "falls_back": any(_names(c, fallback) for c in calls), "n_functions": len(functions)}


def inspect_source(source, entry: str, wanted: str, fallback: str):
    """Whether a call of the name ``wanted`` can be reached from ``entry``, through aliases and live branches only, and one of
    ``fallback`` (a name, or a module with a dot behind it). Both are hints: whether a result is used isn't followed."""

    @F.pandas_udf(INSPECTION)
    def inspect(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_inspect(x, entry, wanted, fallback) for x in s], columns=["syntax_ok", "has_entry", "reached", "falls_back", "n_functions"])

    return inspect(source)


def _mutate(source: str, seed: int) -> str | None:
    """One arithmetic or comparison operator is replaced, or one constant is raised by one."""
    tree = _parse(source)
    return None if tree is None else _mutate_tree(tree, seed)


def _mutate_tree(tree: ast.Module, seed: int) -> str | None:
    swaps = {ast.Add: ast.Sub, ast.Sub: ast.Add, ast.Mult: ast.Add, ast.Lt: ast.GtE, ast.Gt: ast.LtE, ast.Eq: ast.NotEq}
    spots = [n for n in ast.walk(tree) if (isinstance(n, ast.BinOp) and type(n.op) in swaps) or (isinstance(n, ast.Compare) and type(n.ops[0]) in swaps) or (isinstance(n, ast.Constant) and type(n.value) is int)]
    if not spots:
        return None
    spot = spots[seed % len(spots)]
    if isinstance(spot, ast.BinOp):
        spot.op = swaps[type(spot.op)]()
    elif isinstance(spot, ast.Compare):
        spot.ops[0] = swaps[type(spot.ops[0])]()
    else:
        spot.value += 1
    return _unparse(tree)


@F.pandas_udf(T.StringType())
def mutated(source: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series([_mutate(s, int(k)) if s is not None else None for s, k in zip(source, seed, strict=True)])


def _spec(source: str) -> str | None:
    tree = _parse(source)
    if tree is None:
        return None
    kept: list[ast.stmt] = []
    for node in tree.body:
        if isinstance(node, ast.Import | ast.ImportFrom) or (isinstance(node, ast.Assign) and isinstance(node.value, ast.Constant)):
            kept.append(node)
        elif isinstance(node, ast.FunctionDef):
            doc = ast.get_docstring(node)
            node.body = [ast.Expr(ast.Constant(doc if doc else ...))]
            kept.append(node)
    return _unparse(ast.Module(kept, []))


@F.pandas_udf(T.StringType())
def spec_only(source: pd.Series) -> pd.Series:
    """Imports, constants and signatures with their docstrings."""
    return source.map(_spec, na_action="ignore")


def _mutation(source: str | None, seed: float) -> tuple[str | None, str | None, float | None]:
    tree = None if source is None else _parse(source)
    if tree is None:
        return None, None, None
    written = _unparse(tree)
    changed = _mutate_tree(tree, int(seed))
    if changed is None:
        return None, _spec(source), None
    normal = " ".join(source.split()) if written is None else written
    return changed, _spec(source), _ratio(normal, _normal(changed))


@F.pandas_udf(MUTATION)
def mutation(source: pd.Series, seed: pd.Series) -> pd.DataFrame:
    """``mutated``, ``spec`` and ``similarity`` of a source and its mutation, as the functions of their own give them, in one pass."""
    return pd.DataFrame([_mutation(s, k) for s, k in zip(source, seed, strict=True)], columns=MUTATION.names)


def _audit(source: str | None, call: str, entry: str) -> dict:
    tree = _parse(source)
    nodes = list(ast.walk(tree)) if tree else []
    imports = [n for n in nodes if isinstance(n, ast.Import | ast.ImportFrom)]
    # a call that takes a value and then a function: which of its two first arguments is the function?
    specs = [n.args for n in nodes if isinstance(n, ast.Call) and len(n.args) > 1 and isinstance(n.func, ast.Attribute) and n.func.attr == call]
    swapped = [isinstance(first, ast.Lambda) for first, *_ in specs]
    return {
        "calls": sum(isinstance(n, ast.Call) for n in nodes),
        "imports": len(imports),
        "spec_calls": len(specs),
        "reversed_calls": sum(swapped),
        "unknown_calls": sum(not s and not isinstance(args[1], ast.Lambda) for s, args in zip(swapped, specs, strict=True)),
        "parses": tree is not None and source is not None,
        "placeholder": any(isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) and n.value.value is ... for n in nodes),
        "has_entry": any(isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef) and n.name == entry for n in (tree.body if tree else ())),
        "imported": sorted({a.asname or (a.name if isinstance(n, ast.ImportFrom) else a.name.split(".")[0]) for n in imports if n in tree.body for a in n.names}),
    }


def source_audit(source, call: str = "BlockSpec", entry: str = "run"):
    """Counts of calls and imports, calls of ``call`` with their arguments in the wrong or an unknown order, what is imported, placeholders."""

    @F.pandas_udf(AUDIT)
    def audit(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_audit(x, call, entry) for x in s], columns=AUDIT.names)

    return audit(source)


def required_block(df: DataFrame, text: str, name: str, into: str = "code") -> DataFrame:
    """Adds the first fenced block, or unfinished last one, that defines ``name`` and parses; failing that, the first that defines it; else null."""
    fence = r"```(?:python|py)?\n"
    pieces = F.split(F.col(text), fence, -1)
    tail = F.when(F.size(pieces) > 1, F.array(F.element_at(pieces, -1))).otherwise(F.array().cast("array<string>"))
    blocks = F.concat(F.regexp_extract_all(F.col(text), F.lit(rf"(?s){fence}(.*?)```"), F.lit(1)), tail)
    cleaned = F.transform(blocks, lambda b: F.concat(F.regexp_replace(b, r"^\s+|\s+$", ""), F.lit("\n")))
    wanted = F.filter(cleaned, lambda b: F.contains(b, F.lit(f"def {name}")))
    keyed = df.withColumn("_blocks", F.coalesce(wanted, F.array().cast("array<string>")))
    # of the few blocks of a text, the parser sees the first ones; a column for each place keeps one row a text
    first = F.when(F.size("_blocks") == 1, F.element_at("_blocks", 1))

    @F.pandas_udf(T.StringType())
    def preferred(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda found: next((b for b in found if _parse(b) is not None), found[0] if len(found) else None))

    return keyed.withColumn(into, F.coalesce(first, preferred("_blocks"))).drop("_blocks")


def static_contract(df: DataFrame, text: str, entry: str, call: str, wanted: str, fallback: str) -> DataFrame:
    """Adds ``code, stage, passed, feedback``: how far a reply gets without being run.

    Stages: ``output_contract`` (one complete module that defines ``entry``), ``call_contract`` (``call`` is used with its arguments in
    order, ``wanted`` can be reached and ``fallback`` can't), ``static_complete``.
    """
    found = required_block(df, text, entry).withColumn("_a", source_audit(F.col("code"), call, entry)).withColumn("_i", inspect_source(F.col("code"), entry, wanted, fallback))
    a, i = (lambda n: F.col(f"_a.{n}")), (lambda n: F.col(f"_i.{n}"))
    feedback = (
        F.when(F.col("code").isNull(), F.lit(f"The reply holds no module that defines {entry}."))
        .when(~a("parses"), F.lit("The module has a syntax error."))
        .when(a("placeholder") | ~a("has_entry"), F.lit(f"The module is incomplete or {entry} is not at its top level."))
        .when((a("spec_calls") == 0) | (a("reversed_calls") > 0) | (a("unknown_calls") > 0), F.lit(f"{call} takes a value first and a function second."))
        .when(~i("reached") | i("falls_back"), F.lit(f"{wanted} must be reachable, without a fallback."))
    )
    incomplete = F.col("code").isNull() | ~a("parses") | a("placeholder") | ~a("has_entry")
    stage = F.when(incomplete, F.lit("output_contract")).when(feedback.isNotNull(), F.lit("call_contract")).otherwise(F.lit("static_complete"))
    return found.withColumn("stage", stage).withColumn("passed", feedback.isNull()).withColumn("feedback", F.coalesce(feedback, F.lit("Static checks passed."))).drop("_a", "_i")
