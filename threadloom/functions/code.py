"""Syntax-level analysis of Python source columns.

One parse a row feeds all counters and collectors (`analysed`); the rest are single UDFs. All of them
are Arrow-batched, return only what is asked for, and look at equal texts once (`_each_text`), as what
they find depends on the text alone. Source that doesn't parse gives nulls and `parse_error`, or raises
with fail=True.
"""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

NODES: dict[str, tuple[type, ...]] = {
    "IfStatement": (ast.If,),
    "ForLoop": (ast.For, ast.AsyncFor),
    "WhileLoop": (ast.While,),
    "TryExcept": (ast.Try,),
    "WithStatement": (ast.With, ast.AsyncWith),
    "LambdaFunction": (ast.Lambda,),
    "GlobalStatement": (ast.Global,),
    "NonlocalStatement": (ast.Nonlocal,),
    "ListComprehension": (ast.ListComp,),
    "DictComprehension": (ast.DictComp,),
    "SetComprehension": (ast.SetComp,),
    "GeneratorExpression": (ast.GeneratorExp,),
    "Yield": (ast.Yield, ast.YieldFrom),
    "Await": (ast.Await,),
    "Return": (ast.Return,),
    "Break": (ast.Break,),
    "Continue": (ast.Continue,),
    "Raise": (ast.Raise,),
    "Assert": (ast.Assert,),
    "Pass": (ast.Pass,),
}
COMPOUND = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.With, ast.AsyncWith, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Match)
NODE_COUNTERS = ["FunctionCall", "ArgumentType", "Import", "BaseCompoundStatement", *NODES]
#: Counters that count_node_types leaves out.
UNREGISTERED_NODES = {"Yield"}
COLLECTED_NODES: dict[str, tuple[type, ...]] = {
    **{k: v for k, v in NODES.items() if k not in ("Await",)},
    "With": (ast.With, ast.AsyncWith),
    "TryStatement": (ast.Try,),
    "VariableDeclaration": (ast.Assign,),
    "ExceptClause": (ast.ExceptHandler,),
}
NODE_COLLECTORS = ["Docstring", "FunctionCall", "Import", "BaseCompoundStatement", *COLLECTED_NODES]

UNARY = {ast.Invert: ("BitInvert", "~"), ast.USub: ("Minus", "-"), ast.Not: ("Not", "not"), ast.UAdd: ("Plus", "+")}
BOOLEAN = {ast.And: ("And", "and"), ast.Or: ("Or", "or")}
BINARY = {
    ast.Add: ("Add", "+"), ast.BitAnd: ("BitAnd", "&"), ast.BitOr: ("BitOr", "|"), ast.BitXor: ("BitXor", "^"), ast.Div: ("Divide", "/"), ast.FloorDiv: ("FloorDivide", "//"), ast.LShift: ("LeftShift", "<<"),
    ast.MatMult: ("MatrixMultiply", "@"), ast.Mod: ("Modulo", "%"), ast.Mult: ("Multiply", "*"), ast.Pow: ("Power", "**"), ast.RShift: ("RightShift", ">>"), ast.Sub: ("Subtract", "-"),
}
COMPARED = {
    ast.Eq: ("Equal", "=="), ast.Gt: ("GreaterThan", ">"), ast.GtE: ("GreaterThanEqual", ">="), ast.In: ("In", "in"), ast.Is: ("Is", "is"), ast.Lt: ("LessThan", "<"), ast.LtE: ("LessThanEqual", "<="),
    ast.NotEq: ("NotEqual", "!="), ast.IsNot: ("IsNot", "is not"), ast.NotIn: ("NotIn", "not in"),
}
MISC = {"AssignEqual": "=", "Colon": ":", "Comma": ",", "Dot": ".", "ImportStar": "*", "Semicolon": ";"}
OPERATORS = [v[0] for t in (UNARY, BOOLEAN, BINARY, COMPARED) for v in t.values()] + [f"{v[0]}Assign" for v in BINARY.values()] + list(MISC)
UNREGISTERED_OPERATORS = {"ImportStar", "Semicolon"}
OPERATOR_GROUPS = ["Unary", "Boolean", "Binary", "Comparison", "AugmentedAssignment", "Miscellaneous"]
ANALYSIS = {"counts": "map<string, int>", "operators": "map<string, int>", "nodes": "map<string, array<string>>", "tokens": "map<string, array<string>>", "argument_types": "array<array<string>>"}


@cache
def _fields(kind: type) -> tuple[str, ...]:
    """Fields that may hold nodes to visit; operators and contexts are read from the nodes they belong to."""
    return tuple(f for f in kind._fields if f not in ("ctx", "op", "ops"))


@cache
def _names(kind: type) -> tuple[list[str], list[str]]:
    """Names under which nodes of a class are counted and collected."""
    counted, collected = ([name for name, kinds in table.items() if issubclass(kind, kinds)] for table in (NODES, COLLECTED_NODES))
    return counted, collected


def preorder(node: ast.AST) -> Iterator[ast.AST]:
    """The nodes but for operators and contexts."""
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        below: list[ast.AST] = []
        for f in _fields(type(n)):
            v = getattr(n, f, None)
            if isinstance(v, ast.AST):
                below.append(v)
            elif isinstance(v, list):
                below += [x for x in v if isinstance(x, ast.AST)]
        below.reverse()
        stack += below


def _definitions(nodes: Iterable[ast.AST]) -> list[ast.FunctionDef | ast.AsyncFunctionDef]:
    """All functions; those directly in a class body a second time."""
    out: list = []
    for n in nodes:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(n)
        elif isinstance(n, ast.ClassDef):
            out += [m for m in n.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
    return out


class _Source:
    """Source segments by position, without splitting the text anew for each node."""

    def __init__(self, code: str):
        self.lines = [line.encode() for line in io.StringIO(code)]

    def of(self, n: ast.AST) -> str:
        a, b = n.lineno - 1, n.end_lineno - 1
        if a == b:
            return self.lines[a][n.col_offset : n.end_col_offset].decode()
        return b"".join([self.lines[a][n.col_offset :], *self.lines[a + 1 : b], self.lines[b][: n.end_col_offset]]).decode()


def _token_operators(code: str) -> list[tuple[tuple[int, int], str]]:
    """(position, name) of commas, dots, semicolons, colons of slices and lambdas, and `=` inside f-strings."""
    out: list[tuple[tuple[int, int], str]] = []
    brackets, lambdas, in_from, fstrings = [""], [0], False, 0
    tokens = [t for t in tokenize.generate_tokens(io.StringIO(code).readline) if t.type not in (tokenize.COMMENT, tokenize.NL)]
    for t, after in pairwise(tokens):
        if t.type == tokenize.NAME:
            if t.string == "lambda":
                lambdas[-1] += 1
            in_from = t.string == "from" and t.line[: t.start[1]].rsplit(";", 1)[-1].strip() in ("", ">>>") or in_from and t.string != "import"
        elif t.type == tokenize.FSTRING_START:
            fstrings += 1
        elif t.type == tokenize.FSTRING_END:
            fstrings -= 1
        if t.type != tokenize.OP:
            continue
        s = t.string
        if s in "([{":
            brackets.append(s)
            lambdas.append(0)
        elif s in ")]}":
            brackets.pop()
            lambdas.pop()
        elif s == ",":
            out.append((t.start, "Comma"))
        elif s == ";":
            out.append((t.start, "Semicolon"))
        elif s == "." or s == "..." and in_from:
            out += [(t.start, "Dot")] * len(s)
        elif s == ":":
            if lambdas[-1]:
                lambdas[-1] -= 1
                out.append((t.start, "Colon"))
            elif brackets[-1] == "[":
                out.append((t.start, "Colon"))
        elif s == "=" and fstrings and brackets[-1] == "{" and after.string in ("}", "!", ":"):
            out.append((t.start, "AssignEqual"))
    return out


def operators(code: str, nodes: Iterable[ast.AST]) -> dict[str, list[str]]:
    """Tokens by operator name, and names (for the miscellaneous ones, tokens) by group, in source order."""
    out: dict[str, list[str]] = {k: [] for k in [*OPERATORS, *OPERATOR_GROUPS]}

    def add(kind: tuple[str, str], group: str, times: int = 1, suffix: str = "") -> None:
        out[kind[0] + suffix] += [kind[1] + ("=" if suffix else "")] * times
        out[group] += [kind[0] + suffix] * times

    misc = _token_operators(code)
    for n in nodes:
        if isinstance(n, ast.UnaryOp):
            add(UNARY[type(n.op)], "Unary")
        elif isinstance(n, ast.BoolOp):
            add(BOOLEAN[type(n.op)], "Boolean", len(n.values) - 1)
        elif isinstance(n, ast.BinOp):
            add(BINARY[type(n.op)], "Binary")
        elif isinstance(n, ast.MatchOr):
            out["BitOr"] += ["|"] * (len(n.patterns) - 1)
        elif isinstance(n, ast.Compare):
            for op in n.ops:
                add(COMPARED[type(op)], "Comparison")
        elif isinstance(n, ast.AugAssign):
            add(BINARY[type(n.op)], "AugmentedAssignment", suffix="Assign")
        elif isinstance(n, ast.keyword) and n.arg is not None:
            misc.append(((n.lineno, n.col_offset), "AssignEqual"))
        elif isinstance(n, ast.arguments):
            misc += [((d.lineno, d.col_offset), "AssignEqual") for d in [*n.defaults, *n.kw_defaults] if d is not None]
        elif isinstance(n, ast.AnnAssign) and n.value is not None:
            misc.append(((n.value.lineno, n.value.col_offset), "AssignEqual"))
        elif isinstance(n, ast.ImportFrom) and n.names[0].name == "*":
            misc.append(((n.end_lineno, n.end_col_offset), "ImportStar"))
    for _, name in sorted(misc):
        out[name].append(MISC[name])
        out["Miscellaneous"].append(MISC[name])
    return out


def analyse(code: str, strict: bool = True) -> dict:
    """Counts, operator tokens and collected sources of one text; strict=False also counts compound statements and module docstrings."""
    nodes = list(preorder(ast.parse(code)))
    source = _Source(code)
    found: dict[str, list[str]] = {k: [] for k in NODE_COLLECTORS}
    counts = dict.fromkeys(NODE_COUNTERS, 0)
    defs = _definitions(nodes)
    counts["ArgumentType"] = sum(len(d.args.args) for d in defs)
    for n in nodes:
        if isinstance(n, ast.Call):
            counts["FunctionCall"] += 1
            if isinstance(n.func, ast.Name):
                found["FunctionCall"].append(n.func.id)
        elif isinstance(n, (ast.Import, ast.ImportFrom)):
            counts["Import"] += 1
            found["Import"] += [source.of(n)] * len(n.names)
        if isinstance(n, COMPOUND) and not strict:
            counts["BaseCompoundStatement"] += 1
            found["BaseCompoundStatement"].append(source.of(n))
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef) if strict else (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and (doc := ast.get_docstring(n)):
            found["Docstring"].append(doc)
        counted, collected = _names(type(n))
        for name in counted:
            counts[name] += 1
        for name in collected:
            found[name].append(source.of(n))
    ops = operators(code, nodes)
    types = [[None if a.annotation is None else ast.unparse(a.annotation) for a in d.args.args] for d in defs]
    return {"parse_error": None, "counts": counts, "operators": {k: len(ops[k]) for k in OPERATORS}, "nodes": found, "tokens": ops, "argument_types": types}


_ERRORS = (SyntaxError, ValueError, RecursionError, MemoryError, tokenize.TokenError)


#: Characters of the texts whose results a worker keeps; beyond it, it starts anew.
KEPT = 4 << 20
#: By the name of the function and its settings: results by text, and the characters of the texts.
_kept: dict[tuple, tuple[dict[str, object], list[int]]] = {}


def results(name: tuple, f: Callable[[str], object], texts: Iterable[str]) -> list:
    """f of each text. Equal texts have equal results, so those that this process still holds aren't made again."""
    held, size = _kept.setdefault(name, ({}, [0]))
    out = []
    for t in texts:
        if t not in held:
            if size[0] + len(t) > KEPT:
                held.clear()
                size[0] = 0
            if len(t) > KEPT:
                out.append(f(t))
                continue
            held[t] = f(t)
            size[0] += len(t)
        out.append(held[t])
    return out


def _each_text(name: tuple, f: Callable[[str], object], kind: str, null: object = None) -> Callable[[Column], Column]:
    """A UDF of one source column, `null` for null: f is called for the different texts of a batch, as far as `results` doesn't hold them."""

    def made(column: Column) -> Column:  # on use: a worker that imports this has no session
        of = to_arrow_type(DataType.fromDDL(kind))

        def run(s: pa.Array) -> pa.Array:
            coded = s.dictionary_encode()
            found = pa.array([*results(name, f, coded.dictionary.to_pylist()), null], of)
            return found.take(coded.indices.fill_null(len(found) - 1))

        return F.arrow_udf(run, kind)(column)

    return made


def _guarded(name: str, f: Callable, kind: str, empty: object = None) -> Callable[[Column], Column]:
    """A UDF of one source column: null for null, `empty` where the source doesn't parse. No two have one name."""

    def each(code: str) -> object:
        try:
            return f(code)
        except _ERRORS:
            return empty

    return _each_text((name,), each, kind)


def analysed(code: Column, strict: bool = True, fail: bool = False, parts: Sequence[str] = tuple(ANALYSIS)) -> Column:
    """What `analyse` finds, as one struct of parse_error and these parts."""

    def each(c: str) -> dict:
        try:
            found = analyse(c, strict)
        except _ERRORS as e:
            if fail:
                raise
            return {"parse_error": str(e) or type(e).__name__}
        return {"parse_error": None} | {p: list(found[p].items()) if isinstance(found[p], dict) else found[p] for p in parts}

    kind = ", ".join(["parse_error: string", *[f"{p}: {ANALYSIS[p]}" for p in parts]])
    return _each_text(("analysed", strict, fail, *parts), each, f"struct<{kind}>", {})(code)


#: Keys of the maps of an analysis, in their order.
_KEYS = {"counts": NODE_COUNTERS, "operators": OPERATORS, "nodes": NODE_COLLECTORS, "tokens": [*OPERATORS, *OPERATOR_GROUPS]}


def _value(analysis: Column, part: str, name: str) -> Column:
    """The value of a key by its place: a map is searched from its start for each key."""
    return F.map_values(analysis[part])[_KEYS[part].index(name)]


def _with(df: DataFrame, column: str, strict: bool, fail: bool, parts: Sequence[str], made: Callable[[Column], dict[str, Column]]) -> DataFrame:
    whole = df.withColumn("_analysed", analysed(F.col(f"`{column}`"), strict, fail, parts))
    a = F.col("_analysed")
    return whole.withColumns({**made(a), f"{column}_parse_error": a["parse_error"]}).drop("_analysed")


def count_node_types(df: DataFrame, column: str, prefix: str = "node_count", strict: bool = True, fail: bool = False) -> DataFrame:
    """A column `<column>_<prefix>|<Name>Counter` for each registered node counter."""
    return _with(df, column, strict, fail, ["counts"], lambda a: {f"{column}_{prefix}|{n}Counter": _value(a, "counts", n) for n in NODE_COUNTERS if n not in UNREGISTERED_NODES})


def count_all(df: DataFrame, column: str, strict: bool = True, fail: bool = False) -> DataFrame:
    """The columns of `count_node_types` and `count_operators`, from one parse."""
    nodes = {f"{column}_node_count|{n}Counter": ("counts", n) for n in NODE_COUNTERS if n not in UNREGISTERED_NODES}
    found = {f"{column}_operator_count|{n}OperatorCounter": ("operators", n) for n in OPERATORS if n not in UNREGISTERED_OPERATORS}
    return _with(df, column, strict, fail, ["counts", "operators"], lambda a: {name: _value(a, kind, n) for name, (kind, n) in {**nodes, **found}.items()})


def count_operators(df: DataFrame, column: str, prefix: str = "operator_count", fail: bool = False) -> DataFrame:
    """A column `<column>_<prefix>|<Name>OperatorCounter` for each registered operator."""
    return _with(df, column, True, fail, ["operators"], lambda a: {f"{column}_{prefix}|{n}OperatorCounter": _value(a, "operators", n) for n in OPERATORS if n not in UNREGISTERED_OPERATORS})


def collect_nodes(df: DataFrame, column: str, names: Iterable[str] | None = None, prefix: str = "node", strict: bool = True) -> DataFrame:
    """`<column>_<prefix>|<Name>Collector`: array of sources for each collector, nested for ArgumentType."""
    names = [*NODE_COLLECTORS, "ArgumentType"] if names is None else list(names)
    parts = [p for p, asked in (("nodes", any(n != "ArgumentType" for n in names)), ("argument_types", "ArgumentType" in names)) if asked]
    return _with(df, column, strict, False, parts, lambda a: {f"{column}_{prefix}|{n}Collector": a["argument_types"] if n == "ArgumentType" else _value(a, "nodes", n) for n in names})


def collect_operators(df: DataFrame, column: str, names: Iterable[str] | None = None, prefix: str = "operator") -> DataFrame:
    """`<column>_<prefix>|<Name>OperatorCollector`: array of tokens, or of names for the six groups."""
    names = [*OPERATORS, *OPERATOR_GROUPS] if names is None else list(names)
    return _with(df, column, True, False, ["tokens"], lambda a: {f"{column}_{prefix}|{n}OperatorCollector": _value(a, "tokens", n) for n in names})


def apply_visitor(df: DataFrame, column: str, visitor: Callable[[str], object], returns: str, prefix: str | None = None) -> DataFrame:
    """A column with visitor(code).collect() for a class of the caller's; `returns` is its SQL type."""

    @F.pandas_udf(returns)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda c: None if c is None else visitor(c).collect())

    return df.withColumn(f"{column}_{prefix}|{visitor.__name__}", run(F.col(f"`{column}`")))


# --- definitions -----------------------------------------------------------------------------


def _entities(code: str) -> list[dict]:
    source = _Source(code)
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    tree = ast.parse(code)
    top = {id(n) for n in tree.body}
    return [{"kind": kinds[type(n)], "name": n.name, "code": source.of(n), "position": i, "top": id(n) in top} for i, n in enumerate(x for x in preorder(tree) if type(x) in kinds)]


entities = _guarded("entities", _entities, "array<struct<kind: string, name: string, code: string, position: int, top: boolean>>", [])


def _body_docstring(code: str) -> str | None:
    f = next((n for n in preorder(ast.parse(code)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))), None)
    if f is None:
        return None
    for s in f.body:
        if isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str):
            return s.value.value.strip("\"'").strip()
    return f"No docstring provided for function {f.name!r}. " + "Please add a docstring to describe this function."


docstring = _guarded("docstring", _body_docstring, "string")


class _Strip(ast.NodeTransformer):
    """Drops string statements of functions and classes."""

    def _clean(self, node: ast.AST) -> ast.AST:
        self.generic_visit(node)
        node.body = [s for s in node.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str))] or [ast.Pass()]
        return node

    visit_FunctionDef = visit_AsyncFunctionDef = visit_ClassDef = _clean  # noqa: N815


class _Skeleton(ast.NodeTransformer):
    """Function bodies become `pass`, after the docstring if there is one."""

    def _hollow(self, node: ast.AST) -> ast.AST:
        node.body = [*(node.body[:1] if ast.get_docstring(node, clean=False) is not None else []), ast.Pass()]
        return node

    visit_FunctionDef = visit_AsyncFunctionDef = _hollow  # noqa: N815


def _rewritten(*steps: type[ast.NodeTransformer]) -> Callable[[str], str]:
    def run(code: str) -> str:
        tree = ast.parse(code)
        for s in steps:
            tree = s().visit(tree)
        return ast.unparse(ast.fix_missing_locations(tree))

    return run


class _Smaller(ast.NodeTransformer):
    """Without annotations, `object` bases and needless `pass`; imports in a row are one."""

    def generic_visit(self, node: ast.AST) -> ast.AST:
        super().generic_visit(node)
        for name in ("body", "orelse", "finalbody"):
            rows = getattr(node, name, None)
            if isinstance(rows, list) and rows:
                left = [s for s in rows if not isinstance(s, ast.Pass)] or rows[:1]
                joined: list[ast.stmt] = []
                for s in left:
                    if joined and type(s) is type(joined[-1]) is ast.Import:
                        joined[-1] = ast.Import([*joined[-1].names, *s.names])
                    else:
                        joined.append(s)
                setattr(node, name, joined)
        return node

    def visit_arg(self, node: ast.arg) -> ast.AST:
        return ast.arg(node.arg)

    def visit_FunctionDef(self, node: ast.AST) -> ast.AST:  # noqa: N802
        node.returns = None
        return self.generic_visit(node)

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    def visit_ClassDef(self, node: ast.ClassDef) -> ast.AST:  # noqa: N802
        # annotations in a class body make its fields: they stay
        node.bases = [b for b in node.bases if not (isinstance(b, ast.Name) and b.id == "object")]
        node.body = [s if isinstance(s, ast.AnnAssign) else self.visit(s) for s in node.body]
        kept = [s for s in node.body if not isinstance(s, ast.Pass)]
        node.body = kept or node.body[:1]
        return node

    def visit_AnnAssign(self, node: ast.AnnAssign) -> ast.AST:  # noqa: N802
        return node if node.value is None else ast.Assign([node.target], self.visit(node.value))


def _minified(code: str) -> str:
    """The smaller tree, with one blank an indent and blanks only between words."""
    text = ast.unparse(ast.fix_missing_locations(_Smaller().visit(ast.parse(code))))
    rows, out, depth, held, fresh, last, quoted = text.splitlines(keepends=True), [], 0, 0, True, "", None
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type == tokenize.INDENT:
            depth += 1
        elif t.type == tokenize.DEDENT:
            depth -= 1
        if t.type in (tokenize.INDENT, tokenize.DEDENT, tokenize.NL, tokenize.ENDMARKER):
            continue
        string = t.string
        if t.type == tokenize.FSTRING_START:
            quoted, held = (t.start if not held else quoted), held + 1
            continue
        if t.type == tokenize.FSTRING_END:
            held -= 1
            if not held:  # an f-string stays as it is written
                (a, b), (c, d) = quoted, t.end
                string = rows[a - 1][b:d] if a == c else rows[a - 1][b:] + "".join(rows[a : c - 1]) + rows[c - 1][:d]
        if held:
            continue
        if t.type == tokenize.NEWLINE:
            out.append("\n")
            fresh, last = True, ""
            continue
        if fresh:
            out.append(" " * depth)
            fresh = False
        elif last and string and (last[-1].isalnum() or last[-1] in "_\"'" or not last[-1].isascii()) and (string[0].isalnum() or string[0] in "_\"'" or not string[0].isascii()):
            out.append(" ")
        elif last in (".", "...") and string[:1].isdigit() or last[-1:].isdigit() and string[:1] == ".":
            out.append(" ")
        out.append(string)
        last = string
    return "".join(out).rstrip("\n")


without_docstrings = _guarded("without_docstrings", _rewritten(_Strip), "string")
minified = _guarded("minified", _minified, "string")
skeleton = _guarded("skeleton", _rewritten(_Skeleton), "string")
normalised = _guarded("normalised", lambda c: ast.dump(ast.parse(c)), "string")


def same_structure(a: Column, b: Column) -> Column:
    """Equal but for comments and layout; null where either doesn't parse."""
    return normalised(a) == normalised(b)


is_valid_python = _guarded("is_valid_python", lambda c: bool(ast.parse(c).body), "boolean", False)
main_entity = _guarded("main_entity", lambda c: next((n.name for n in ast.parse(c).body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))), None), "string")


def _calls(code: str) -> list[dict]:
    source = _Source(code)
    return [{"name": ast.unparse(n.func), "line": n.lineno, "col": n.col_offset, "args": [source.of(a) for a in n.args]} for n in preorder(ast.parse(code)) if isinstance(n, ast.Call)]


calls = _guarded("calls", _calls, "array<struct<name: string, line: int, col: int, args: array<string>>>", [])


def _products(code: str) -> dict:
    source, by, total = _Source(code), {}, 0

    def is_product(n: ast.AST) -> bool:
        if isinstance(n, ast.BinOp):
            return isinstance(n.op, (ast.Mult, ast.BitAnd))
        if isinstance(n, ast.Call):
            f = n.func
            return isinstance(f, ast.Attribute) and f.attr == "dot" or isinstance(f, ast.Name) and f.id == "dot" and len(n.args) + len(n.keywords) == 2
        return False

    def visit(n: ast.AST, inside: str | None) -> str | None:
        nonlocal total
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            by.setdefault(n.name, [])
            here: str | None = n.name
            for c in ast.iter_child_nodes(n):
                here = visit(c, here)
            return None  # after a function ends, none is current
        if is_product(n):
            total += 1
            if inside is not None:
                by[inside].append(source.of(n))
        for c in ast.iter_child_nodes(n):
            inside = visit(c, inside)
        return inside

    visit(ast.parse(code), None)
    return {"count": total, "by_function": by}


def multiplications(column: Column) -> Column:
    """`*`, `&`, `.dot()` and two-argument dot(), in all and by the function they are in."""
    made = _guarded("multiplications", lambda c: (p := _products(c)) | {"by_function": list(p["by_function"].items())}, "struct<count: int, by_function: map<string, array<string>>>", {})
    return made(column)


def _signatures(code: str) -> list[dict]:
    out: list[dict] = []

    def visit(n: ast.AST, path: tuple[str, ...]) -> None:
        for c in ast.iter_child_nodes(n):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append({"name": ".".join((*path, c.name)), "params": ast.unparse(c.args), "returns": None if c.returns is None else ast.unparse(c.returns)})
            else:
                visit(c, (*path, c.name) if isinstance(c, ast.ClassDef) else path)

    visit(ast.parse(code), ())
    return out


#: Functions by qualified name; functions inside functions are not entered.
signatures = _guarded("signatures", _signatures, "array<struct<name: string, params: string, returns: string>>", [])


def _bases(code: str) -> list[dict]:
    return [{"cls": n.name, "bases": [ast.unparse(b) for b in n.bases]} for n in preorder(ast.parse(code)) if isinstance(n, ast.ClassDef)]


def _ancestors(code: str) -> list[dict]:
    direct = {r["cls"]: r["bases"] for r in _bases(code)}
    out = []
    for cls in direct:
        seen, todo = [], list(direct[cls])
        while todo:
            b = todo.pop(0)
            if b not in seen:
                seen.append(b)
                todo += direct.get(b, [])
        out.append({"cls": cls, "ancestors": seen})
    return out


bases = _guarded("bases", _bases, "array<struct<cls: string, bases: array<string>>>", [])
ancestors = _guarded("ancestors", _ancestors, "array<struct<cls: string, ancestors: array<string>>>", [])
