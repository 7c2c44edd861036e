import textwrap

import pytest

from quarryline.operators import bindings, code_metrics, linkage
from quarryline.sources import files, python_code

CODE = textwrap.dedent('''
    def busy(a, b, c, *rest, key=None):
        """Words."""
        total = 0
        for x in a:
            if x and b or c:
                total += 1
            elif x:
                while b:
                    return key
            else:
                return rest
        return total if total else None


    def careless(n, unread):
        spare = 1
        try:
            risky(n)
        except:
            pass
        finally:
            return n == n
        n = 2  # TODO later


    def one(items):
        out = []
        for i in items:
            if i > 3:
                out.append(i * 2)
        return out


    def two(things):
        got = []
        for t in things:
            if t > 3:
                got.append(t * 2)
        return got  # quarry: ignore


    def same(q):
        if q:
            run(q)
        else:
            run(q)
''')


def _nodes(spark, code=CODE):
    return python_code.nodes(spark.createDataFrame([("m.py", "python", code), ("bad.py", "python", "def ("), ("x.c", "c", "int x;")], "file string, lang string, source string"))


def test_scalars(spark):
    got = {(r.name, r.metric): r.value for r in code_metrics.scalars(_nodes(spark), True).collect()}
    # for, if, elif, while, conditional expression; and, or
    assert got["busy", "cyclomatic"] == 8
    # for 1, if 2, elif 1, while 3, expression 1, two boolean runs
    assert got["busy", "cognitive_complexity"] == 10
    assert got["busy", "nesting_depth"] == 3
    assert got["busy", "parameter_count"] == 3
    assert got["busy", "boolean_complexity"] == 2
    assert got["busy", "return_count"] == 3
    assert got["busy", "function_length"] == 12
    assert got["careless", "fan_out"] == 1
    assert got["one", "local_count"] == 2


def test_flags(spark):
    got = {(r.metric, r.line) for r in code_metrics.flags(_nodes(spark)).collect()}
    line = lambda part: next(k for k, x in enumerate(CODE.split("\n"), 1) if part in x)
    assert ("broad_catch", line("except:")) in got and ("empty_catch", line("except:")) in got
    assert ("identical_operands", line("n == n")) in got and ("return_in_finally", line("n == n")) in got
    assert ("stub_marker", line("TODO")) in got and "unreachable_after_jump" not in {m for m, _ in got}
    assert ("unused_parameter", line("def careless")) in got and ("unused_local", line("spare = 1")) in got
    assert ("duplicate_branches", line("if q:")) in got
    assert {m for m, _ in got} >= {"duplicate_branches"} and ("unused_parameter", line("def busy")) not in got


@pytest.mark.parametrize(
    ("body", "many"),
    [
        ("pass", 1), ("if x:\n  a()", 2), ("if x:\n  a()\nelse:\n  b()", 2), ("if x and y or z:\n  a()", 4), ("if x:\n  a()\nelif y and z:\n  b()\nelse:\n  c()", 4),
        ("while x or y:\n  a()", 3), ("for i in x:\n  if i:\n    a()", 3), ("if x:\n  a()\nif y:\n  b()\nfor i in x:\n  c()", 8),
        ("match x:\n  case 1:\n    a()\n  case _:\n    b()", 2), ("try:\n  a()\nexcept E:\n  b()\nfinally:\n  c()", 3), ("return a() if x > 0 and x < 9 else b()", 3),
        ("def g():\n  if x:\n    a()\nreturn g", 1), ("if x:\n  a()\n" * 40, 1_000_000_000), ("with x:\n  if y:\n    a()", 2),
    ],
)
def test_paths(body, many):
    rows = python_code.parse("f.py", "def f(x):\n" + textwrap.indent(body, "  "))
    assert next(r[14] for r in rows if r[5] == "function") == many


def test_trivial_wrappers(spark):
    code = "def a(x):\n    'Words.'\n    return b(x)\n\ndef b(x):\n    c(x)\n\ndef c(x):\n    y = a(x)\n    return y\n\ndef d(x):\n    return a(x) + 1\n\ndef e(x):\n    a(x)\n    pass\n"
    got = code_metrics.flags(_nodes(spark, code), True).filter("metric = 'trivial_wrapper'").collect()
    assert sorted((r.unit, r.line) for r in got) == [("a", 1), ("b", 5), ("e", 15)]
    assert code_metrics.flags(_nodes(spark, code)).filter("metric = 'trivial_wrapper'").count() == 0


def test_findings_and_directives(spark):
    got = code_metrics.analyze(_nodes(spark), cut=2.0).collect()
    clones = {(r.unit, r.value) for r in got if r.metric == "duplicate"}
    assert clones == {("one", 2), ("two", 2)}
    quiet = code_metrics.analyze(_nodes(spark, "# quarry: ignore-file[stub_marker]\n" + CODE), cut=2.0)
    assert {r.metric for r in quiet.filter("suppressed").collect()} == {"stub_marker"}


SCOPED = textwrap.dedent("""
    import os.path as place
    from .near import far as nigh
    size = 1
    @wrap(size)
    def outer(size=size, *rest: Kind) -> Kind:
        kept = [kept for kept in rest]
        def inner():
            kept = size
            Kind.outer = late
            _size = _size
            return lambda: inner(key=kept)
        a, late = 1, 2
        return inner
    class Kind:
        size = 2
        def size_of(self):
            self.size = place
            return self.inner
    late = size
    late = 3
""")


def test_maximal_duplicates(spark):
    part = "        total = x + 1\n        total = total * x\n        total = total - x\n        total = total / x\n        return total\n"
    whole = "def {0}(x):\n    if x:\n" + part + "    return x\n\n"
    code = whole.format("a") + whole.format("b") + "def c(x):\n    for y in x:\n" + part + "def d(x):\n    return f(x, x, x, x, x, x)\n\ndef e(x):\n    return f(x, x, x, x, x, x)\n"
    got = [(r.name, r.line, r.members) for r in code_metrics.duplicates(_nodes(spark, code)).collect()]
    # the block is in three functions, two of which are alike: both are told; d and e have no control flow
    assert sorted(got) == [("", 3, 3), ("", 12, 3), ("", 21, 3), ("a", 1, 2), ("b", 10, 2)]
    small = [(r.name, r.members) for r in code_metrics.duplicates(_nodes(spark, code), 5).collect()]
    assert {("d", 2), ("e", 2)} <= set(small)


def test_bindings(spark):
    line = lambda part: next(k for k, x in enumerate(SCOPED.split("\n"), 1) if part in x)
    nodes = _nodes(spark, SCOPED)
    got = {(r.row, r.name): r.def_row for r in bindings.bindings(nodes).collect()}
    assert {n for r, n in got if r == line("import os")} == {"os", "path", "place"}
    assert {n for r, n in got if r == line("from .near")} == {"near", "far", "nigh"}
    assert got[line("@wrap"), "size"] == line("size = 1") and got[line("@wrap"), "wrap"] is None
    assert got[line("def outer"), "size"] == line("size = 1") and got[line("def outer"), "Kind"] == line("class Kind")
    assert got[line("kept = ["), "kept"] == line("kept = [")
    assert got[line("kept = size"), "size"] == line("size = 1")
    assert got[line("Kind.outer"), "outer"] == line("def outer") and got[line("Kind.outer"), "late"] == line("late = size")
    assert got[line("lambda"), "inner"] == line("def inner") and got[line("lambda"), "kept"] == line("kept = size") and got[line("lambda"), "key"] is None
    assert got[line("self.size"), "size"] == line("size = 2") and got[line("self.size"), "place"] is None
    assert got[line("self.inner"), "inner"] is None
    assert (line("late = 3"), "late") not in got
    hidden = {(r.row, r.name) for r in bindings.shadowing(nodes).collect()}
    assert hidden == {(line("kept = size"), "kept"), (line("size = 2"), "size")}
    flagged = code_metrics.flags(nodes, True).filter("metric = 'shadowed_variable'").collect()
    assert {r.line for r in flagged} == {r for r, _ in hidden}


def test_cohesion(spark):
    code = "\n".join(f"def f{k}(x):\n    return x\n" for k in range(4)) + "\ndef g(x):\n    return f1(x) + f2(x)\n"
    nodes = _nodes(spark, code)
    got = bindings.cohesion(nodes, bindings.bindings(nodes)).collect()
    assert [tuple(r) for r in got] == [("m.py", 3, 1, "f0")]
    assert code_metrics.low_cohesion(nodes, bindings.bindings(nodes), 0.95).count() == 0
    assert bindings.cohesion(_nodes(spark, "x = 1\n"), bindings.bindings(_nodes(spark, "x = 1\n"))).count() == 0


TREE = {
    "pkg/__init__.py": "from .low import _deep\n",
    "pkg/low.py": "def _deep():\n    return _deeper()\n\ndef _deeper():\n    def inner():\n        return _deepest()\n    return inner\n\ndef _deepest():\n    pass\n\ndef _round():\n    _turn()\n\ndef _turn():\n    _round()\n",
    "pkg/sub/far.py": "from ..low import _round as spin\nfrom pkg import *\n\nclass _Odd:\n    def go(self):\n        return _own()\n\ndef _own():\n    pass\n\ndef _own():\n    return 1\n",
    "other/low.py": "def _deep():\n    pass\n",
    "use.py": "from pkg.sub.far import _Odd\nfrom nowhere import x\nfrom low import _turn\n",
}


def test_linkage(spark):
    rows = [(f, "python", c) for f, c in TREE.items()]
    nodes = python_code.nodes(spark.createDataFrame(rows, "file string, lang string, source string"))
    defined = linkage.symbols(nodes)
    assert {(r.name, r.kind) for r in defined.filter("file = 'pkg/sub/far.py'").collect()} == {("_Odd", "class"), ("_own", "function")}
    found = {(r.file, r.level, r.module, tuple(r.names), r.path) for r in linkage.targets(linkage.imports(nodes), nodes.select("file")).collect()}
    assert found == {
        ("pkg/__init__.py", 1, "low", ("_deep",), "pkg/low.py"), ("pkg/sub/far.py", 2, "low", (), "pkg/low.py"), ("pkg/sub/far.py", 0, "pkg", (), "pkg/__init__.py"),
        ("use.py", 0, "pkg.sub.far", ("_Odd",), "pkg/sub/far.py"), ("use.py", 0, "low", ("_turn",), "pkg/low.py"), ("use.py", 0, "low", ("_turn",), "other/low.py"),
    }
    bound = bindings.bindings(nodes)
    lost = {(r.file, r.unit) for r in linkage.unreferenced(nodes, bound).collect()}
    # _round is named by its import and _turn by its own; the other _deep is named by nobody
    assert lost == {("other/low.py", "_deep")}
    seen = linkage.visible(nodes, defined)
    counts = {(r.def_file, r.reach) for r in linkage.reach(nodes, seen.filter("file = 'pkg/sub/far.py'")).collect()}
    assert counts == {("pkg/low.py", 3)}
    bare = python_code.nodes(spark.createDataFrame([("a.py", "python", "from .b import *\n"), ("b.py", "python", "def _f():\n    _g()\n\ndef _g():\n    _f()\n")], "file string, lang string, source string"))
    assert {r.unit for r in linkage.unreferenced(bare, bindings.bindings(bare)).collect()} == {"_f", "_g"}


def test_changed_lines():
    diff = "--- a/f x.py\n+++ b/f x.py\n@@ -1,2 +1,3 @@\n a\n+b\n+--- not a header\n-c\n@@ -9 +10,2 @@\n-x\n+y\n+z\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-q\n"
    assert files.changed_lines(diff) == [("f x.py", 2, 3), ("f x.py", 10, 11)]


def test_read_sources(spark, tmp_path):
    for name in ("a.py", "sub/b.PY", ".hidden/c.py", "skip/d.py", "e.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x = 1\n")
    got = files.read_sources(spark, str(tmp_path), ["skip/**"]).collect()
    assert sorted((r.file, r.lang, r.source) for r in got) == [("a.py", "python", "x = 1\n"), ("sub/b.PY", "python", "x = 1\n")]


def test_files_are_dealt_out_before_they_are_parsed(spark):
    rows = [(f"{k}.py", "python", f"def f{k}(x):\n    return x\n") for k in range(40)]
    nodes = python_code.nodes(spark.createDataFrame(rows, "file string, lang string, source string").coalesce(1))
    parts = nodes.selectExpr("spark_partition_id() AS p", "file").distinct().collect()
    assert len(parts) == 40 and len({r.p for r in parts}) > 1


@pytest.mark.parametrize("name", ["code_bindings", "code_cohesion", "code_own_affinity", "code_unreferenced", "code_cross_references", "code_flags", "code_shadowed", "code_definition_reach"])
def test_joins_of_code_tables_merge(spark, name):
    from quarryline.plans import code_queries, table_queries  # noqa: F401

    plan = table_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
