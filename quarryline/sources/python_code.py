"""Python source as a table of tree nodes.

A node is numbered in pre-order; the nodes below it are (nid, last]. owner is the function that a
node belongs to (itself for a function's own node), so what a function holds without the functions
in it is one group.
"""

from __future__ import annotations

import ast
import hashlib
import io
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = """file string, nid long, last long, parent long, depth int, type string, concepts array<string>, owner long, row int, end_row int,
name string, text string, hash long, size int, paths long"""

_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
ARROW = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in SCHEMA.split(","))])

#: Rows of files that are handed on together.
BATCH = 20_000
#: Fixed value: paths are not counted beyond.
MOST_PATHS = 1_000_000_000

_PLAIN = {
    ast.If: ("decision", "nesting", "conditional"),
    ast.For: ("decision", "nesting", "loop"),
    ast.AsyncFor: ("decision", "nesting", "loop"),
    ast.While: ("decision", "nesting", "loop"),
    ast.Try: ("nesting", "try"),
    ast.TryStar: ("nesting", "try"),
    ast.With: ("nesting",),
    ast.AsyncWith: ("nesting",),
    ast.IfExp: ("decision", "ternary"),
    ast.Return: ("return", "terminal"),
    ast.Break: ("terminal",),
    ast.Continue: ("terminal",),
    ast.Raise: ("terminal",),
    ast.Call: ("call",),
    ast.Compare: ("binary_expr",),
    ast.BinOp: ("binary_expr",),
    ast.Match: ("conditional",),
    ast.Pass: ("trivial",),
    ast.Module: ("scope",),
    ast.ClassDef: ("scope", "class"),
    ast.Lambda: ("scope",),
    ast.Attribute: ("mention",),
    ast.keyword: ("mention",),
    ast.alias: ("mention", "imported"),
    ast.ImportFrom: ("mention", "import"),
    ast.Global: ("mention",),
    ast.Nonlocal: ("mention",),
    ast.MatchAs: ("mention",),
    ast.MatchStar: ("mention",),
}


def in_turn(parts) -> int:
    """Acyclic paths through nodes that follow each other."""
    total = 1
    for p in parts:
        total = min(MOST_PATHS, total * paths(p))
    return total


def joints(test) -> int:
    """How many times a condition goes on at an "and" or "or"; each is a path more."""
    return sum(len(n.values) - 1 for n in ast.walk(test) if isinstance(n, ast.BoolOp))


def paths(node) -> int:
    """Acyclic paths through a node (npath): what follows multiplies, what is chosen from adds; functions
    in it have their own."""
    match node:
        case ast.FunctionDef() | ast.AsyncFunctionDef():
            return 1
        case ast.If():
            total = in_turn(node.body) + in_turn(node.orelse) + joints(node.test)
        case ast.While():
            total = in_turn([*node.body, *node.orelse]) + joints(node.test) + 1
        case ast.For() | ast.AsyncFor():
            total = in_turn([*node.body, *node.orelse]) + joints(node.iter) + 1
        case ast.Match():
            total = sum(in_turn(ast.iter_child_nodes(c)) for c in node.cases)
        case ast.Try() | ast.TryStar():
            arms = [node.body, *(h.body for h in node.handlers), node.orelse, node.finalbody]
            total = sum(in_turn(a) for a in arms if a)
        case ast.IfExp():
            total = sum(paths(x) + joints(x) for x in (node.test, node.body, node.orelse)) - 1
        case _:
            total = in_turn(ast.iter_child_nodes(node))
    return min(MOST_PATHS, total)


class _Rows:
    def __init__(self, file: str):
        self.file, self.rows, self.targets = file, [], set()

    def add(self, node, kind: str, concepts, parent: int, depth: int, owner: int | None, name="", text="") -> int:
        nid = len(self.rows)
        row, end = getattr(node, "lineno", 0), getattr(node, "end_lineno", 0) or 0
        self.rows.append([self.file, nid, nid, parent, depth, kind, list(concepts), nid if owner == -2 else owner, row, end, name, text, 0, 1, None])
        return nid

    def close(self, nid: int, kids: list[int]) -> None:
        row = self.rows[nid]
        row[2] = len(self.rows) - 1
        row[13] = 1 + sum(self.rows[k][13] for k in kids)
        key = "|".join([row[5], *(str(self.rows[k][12]) for k in kids)])
        row[12] = int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "little", signed=True)

    def block(self, statements, parent: int, depth: int, owner, concept: str, node) -> int:
        nid = self.add(statements[0] if statements else node, "block", ["body", concept], parent, depth, owner, text="\n".join(ast.unparse(s) for s in statements))
        self.close(nid, [self.visit(s, nid, depth + 1, owner) for s in statements])
        return nid

    def visit(self, node, parent: int, depth: int, owner, bare: bool = False) -> int:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            if node.decorator_list and not bare:
                nid = self.add(node.decorator_list[0], "decorated", [], parent, depth, owner)
                self.close(nid, [*(self.visit(d, nid, depth + 1, owner) for d in node.decorator_list), self.visit(node, nid, depth + 1, owner, True)])
                return nid
            nid = self.add(node, "function", ["function", "scope"], parent, depth, -2, node.name)
            self.rows[nid][14] = in_turn([node.args, *node.body])
            kids = []
            plain = [*node.args.posonlyargs, *node.args.args]
            given = dict(zip(reversed(plain), reversed(node.args.defaults), strict=False)) | dict(zip(node.args.kwonlyargs, node.args.kw_defaults, strict=True))
            for a in [*plain, *([node.args.vararg] if node.args.vararg else []), *node.args.kwonlyargs, *([node.args.kwarg] if node.args.kwarg else [])]:
                k = self.add(a, "parameter", ["parameter", *(["positional"] if a in plain else [])], nid, depth + 1, nid, a.arg)
                self.close(k, [self.visit(x, k, depth + 2, nid) for x in (a.annotation, given.get(a)) if x])
                kids.append(k)
            if node.returns:
                kids.append(self.visit(node.returns, nid, depth + 1, nid))
            first = node.body[0]
            documented = isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)
            kids.append(self.block(node.body[1:] if documented and len(node.body) > 1 else node.body, nid, depth + 1, nid, "function_body", node))
            self.close(nid, kids)
            return nid
        if isinstance(node, ast.If):
            return self.branch(node, parent, depth, owner)
        if isinstance(node, ast.BoolOp):  # a and b and c is (a and b) and c
            return self.boolean(node.values, "and" if isinstance(node.op, ast.And) else "or", node, parent, depth, owner)
        if isinstance(node, (ast.Try, ast.TryStar)):
            nid = self.add(node, "try", _PLAIN[type(node)], parent, depth, owner)
            kids = [self.block(node.body, nid, depth + 1, owner, "try_body", node)]
            for h in node.handlers:
                names = [ast.unparse(x) for x in (h.type.elts if isinstance(h.type, ast.Tuple) else [h.type])] if h.type else []
                broad = ["broad_catch"] if not names or "BaseException" in names else []
                k = self.add(h, "except", ["decision", "catch", "mention", *broad], nid, depth + 1, owner, h.name or "")
                caught = [self.visit(h.type, k, depth + 2, owner)] if h.type else []
                self.close(k, [*caught, self.block(h.body, k, depth + 2, owner, "catch_body", h)])
                kids.append(k)
            if node.orelse:
                kids.append(self.block(node.orelse, nid, depth + 1, owner, "else_body", node))
            if node.finalbody:
                k = self.add(node.finalbody[0], "finally", ["finally"], nid, depth + 1, owner)
                self.close(k, [self.block(node.finalbody, k, depth + 2, owner, "finally_body", node)])
                kids.append(k)
            self.close(nid, kids)
            return nid
        kind = type(node).__name__.lower()
        name = text = ""
        concepts = list(_PLAIN.get(type(node), ()))
        if isinstance(node, ast.Name):
            name, concepts = node.id, ["reference" if isinstance(node.ctx, ast.Load) else "binding", *(["assigned"] if node in self.targets else [])]
        elif isinstance(node, ast.Call):
            name = getattr(node.func, "attr", getattr(node.func, "id", ""))
        elif isinstance(node, ast.Compare) and len(node.ops) == 1:
            text = f"{type(node.ops[0]).__name__}\x1f{ast.unparse(node.left)}\x1f{ast.unparse(node.comparators[0])}"
        elif isinstance(node, ast.BinOp):
            text = f"{type(node.op).__name__}\x1f{ast.unparse(node.left)}\x1f{ast.unparse(node.right)}"
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            self.targets |= {t for t in getattr(node, "targets", None) or [node.target] if isinstance(t, ast.Name)}
        elif isinstance(node, ast.alias):
            name, text = node.name, node.asname or ""
        elif isinstance(node, ast.ImportFrom):
            name, text = node.module or "", "." * node.level
        elif isinstance(node, (ast.Global, ast.Nonlocal)):
            name = ".".join(node.names)
        elif "mention" in concepts or "class" in concepts:
            name = getattr(node, "attr", getattr(node, "arg", getattr(node, "name", ""))) or ""
        nid = self.add(node, kind, concepts, parent, depth, owner, name, text)
        kids = []
        for field, value in ast.iter_fields(node):
            if isinstance(value, list) and value and isinstance(value[0], ast.stmt) and not isinstance(node, ast.Module):
                kids.append(self.block(value, nid, depth + 1, owner, f"{field}_block", node))
            else:
                for x in value if isinstance(value, list) else [value]:
                    if isinstance(x, ast.AST) and not isinstance(x, (ast.expr_context, ast.operator, ast.cmpop, ast.unaryop, ast.boolop)):
                        kids.append(self.visit(x, nid, depth + 1, owner))
        self.close(nid, kids)
        return nid

    def branch(self, node: ast.If, parent: int, depth: int, owner) -> int:
        nid = self.add(node, "if", _PLAIN[ast.If], parent, depth, owner)
        kids = [self.visit(node.test, nid, depth + 1, owner), self.block(node.body, nid, depth + 1, owner, "branch_body", node)]
        rest = node.orelse
        while len(rest) == 1 and isinstance(rest[0], ast.If) and rest[0].col_offset == node.col_offset:
            k = self.add(rest[0], "elif", ["decision", "continuation"], nid, depth + 1, owner)
            self.close(k, [self.visit(rest[0].test, k, depth + 2, owner), self.block(rest[0].body, k, depth + 2, owner, "branch_body", node)])
            kids.append(k)
            rest = rest[0].orelse
        if rest:
            kids.append(self.block(rest, nid, depth + 1, owner, "branch_body", node))
        self.close(nid, kids)
        return nid

    def boolean(self, values, op: str, node, parent: int, depth: int, owner) -> int:
        nid = self.add(node, "boolean", ["short_circuit", "binary_expr"], parent, depth, owner, op, f"{op}\x1f{ast.unparse(values[-2])}\x1f{ast.unparse(values[-1])}" if len(values) == 2 else "")
        left = self.boolean(values[:-1], op, node, nid, depth + 1, owner) if len(values) > 2 else self.visit(values[0], nid, depth + 1, owner)
        self.close(nid, [left, self.visit(values[-1], nid, depth + 1, owner)])
        return nid


def parse(file: str, source: str) -> list[list]:
    """Rows of SCHEMA; a file that can't be parsed has none."""
    try:
        tree = ast.parse(source)
        tokens = list(tokenize.generate_tokens(io.StringIO(source).readline))
    except (SyntaxError, ValueError, tokenize.TokenError):
        return []
    rows = _Rows(file)
    rows.visit(tree, -1, 0, None)
    for t in tokens:
        if t.type == tokenize.COMMENT:
            nid = len(rows.rows)
            rows.rows.append([file, nid, nid, 0, 1, "comment", ["comment"], None, t.start[0], t.start[0], "", t.string, 0, 1, None])
    return rows.rows


def nodes(files: DataFrame) -> DataFrame:
    """SCHEMA of all Python files; files: file, lang, source.

    Files are dealt out by their names before they are parsed: a table of many small ones may well be
    one partition.
    """

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        for part in parts:
            for file, source in zip(part["file"].to_pylist(), part["source"].to_pylist(), strict=True):
                rows += parse(file, source or "")
                if len(rows) >= BATCH:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.filter("lang = 'python'").select("file", "source").repartition(parts, "file").mapInArrow(run, SCHEMA)
