"""Code metrics on source text that is written from the suppliers' keys, so that SQL knows every result.

Of each supplier k there are three files with one function each: g (a guards, b + 1 parameters), d
(c + 1 nested conditions) and c (b calls and a condition of two operators), with a = k % 7, b = k % 5
and c = k % 3. The queries on bindings have a file m of each supplier: two functions that share a
definition, in even ones with a local that hides it, and b functions that share nothing. Those on
files that import have two of each supplier: b with four functions, a with one of b's imported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators import bindings, clones, code_metrics, graph, linkage
from quarryline.plans.table_queries import query, table
from quarryline.sources import python_code


def _sources(spark, sf_dir) -> DataFrame:
    """file, lang, source."""
    k = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 7).cast("int").alias("a"), (F.col("s_suppkey") % 5).cast("int").alias("b"), (F.col("s_suppkey") % 3).cast("int").alias("c"))
    many = lambda n, line: F.array_join(F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n), line), "")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    name = F.col("k").cast("string")
    s = lambda i: i.cast("string")
    more = many(F.col("b"), lambda i: F.concat(F.lit(", p"), s(i + 1)))
    guards = text("def guards_", name, "(p0", more, "):\n", many(F.col("a"), lambda i: F.concat(F.lit("    if p0 == "), s(i), F.lit(":\n        return "), s(i), F.lit("\n"))), "    return p0\n")
    nest = many(F.col("c") + 1, lambda i: F.concat(F.repeat(F.lit("    "), i + 1), F.lit("if x:\n")))
    note = F.when(F.col("k") % 2 == 0, "# quarry: ignore[nesting_depth, cyclomatic]\n").otherwise("# quarry: ignore-file\n")
    deep = text("def deep_", name, "(x):\n", nest, F.repeat(F.lit("    "), F.col("c") + 2), "total = x\n    return total\n", note)
    todo = F.when(F.col("k") % 4 == 0, "  # TODO later").otherwise("")
    calls = text("def calls_", name, "(x):\n", many(F.col("b"), lambda i: F.concat(F.lit("    f"), s(i), F.lit("(x)\n"))), "    return x and 1 or 0", todo, "\n")
    files = F.array(*(F.struct(F.concat(F.lit(kind), name, F.lit(".py")).alias("file"), body.alias("source")) for kind, body in (("g", guards), ("d", deep), ("c", calls))))
    return k.select(F.explode(files).alias("f")).select("f.file", F.lit("python").alias("lang"), "f.source")


def _nodes(spark, sf_dir) -> DataFrame:
    return python_code.nodes(_sources(spark, sf_dir))


_K = "k AS (SELECT s_suppkey AS k, s_suppkey % 7 AS a, s_suppkey % 5 AS b, s_suppkey % 3 AS c FROM supplier)"
#: metric: its value in g, d and c files.
_VALUES = {
    "cyclomatic": ("a + 1", "c + 2", "3"),
    "cognitive_complexity": ("a", "(c + 1) * (c + 2) // 2", "2"),
    "function_length": ("2 * a + 2", "c + 4", "b + 2"),
    "nesting_depth": ("CASE WHEN a > 0 THEN 1 ELSE 0 END", "c + 1", "0"),
    "parameter_count": ("b + 1", "1", "1"),
    "boolean_complexity": ("0", "0", "2"),
    "return_count": ("a + 1", "1", "1"),
    "local_count": ("0", "1", "0"),
    "fan_out": ("0", "0", "b"),
    "npath": ("pow(2, a)", "c + 2", "1"),
}
_NAMES = {"g": "guards_", "d": "deep_", "c": "calls_"}
_SCALARS = " UNION ALL ".join(
    f"SELECT '{kind}' || k || '.py' AS file, '{name}' || k AS name, 1 AS line, '{metric}' AS metric, ({values[n]})::BIGINT AS value FROM k"
    for metric, values in _VALUES.items()
    for n, (kind, name) in enumerate(_NAMES.items())
)


@query(f"WITH {_K} {_SCALARS}")
def code_scalars(spark, sf_dir):
    return code_metrics.scalars(graph.cut(_nodes(spark, sf_dir)), True).select("file", "name", "line", "metric", "value")


@query(f"""WITH {_K} SELECT 'g' || k || '.py' AS file, 1 AS line, '' AS unit, 'unused_parameter' AS metric FROM (SELECT k, unnest(range(b)) FROM k)
UNION ALL SELECT 'c' || k || '.py', b + 2, '', 'stub_marker' FROM k WHERE k % 4 = 0""")
def code_flags(spark, sf_dir):
    return code_metrics.flags(graph.cut(_nodes(spark, sf_dir)))


_SIZES = """SELECT 'g' || k || '.py' AS file, 'guards_' || k AS name, (5 + b + 7 * a)::INT AS size, 'g' || a || '-' || b AS shape FROM k
UNION ALL SELECT 'd' || k || '.py', 'deep_' || k, (8 + 3 * (c + 1))::INT, 'd' || c FROM k UNION ALL SELECT 'c' || k || '.py', 'calls_' || k, (9 + 4 * b)::INT, 'c' || b FROM k"""


@query(f"WITH {_K}, s AS ({_SIZES}) SELECT file, name, size FROM s")
def code_units(spark, sf_dir):
    return code_metrics.units(_nodes(spark, sf_dir)).select("file", "name", "size")


@query(f"WITH {_K}, s AS ({_SIZES}) SELECT min(file) AS first, count(*) AS members FROM s WHERE size >= 10 GROUP BY shape HAVING count(*) >= 2")
def code_duplicates(spark, sf_dir):
    u = code_metrics.units(_nodes(spark, sf_dir)).filter(F.col("size") >= code_metrics.CLONE_SIZE).withColumn("lang", F.lit("python"))
    return clones.exact_clusters(u, "lang", "hash", "file").select("first", "members")


@query(f"""WITH {_K} SELECT 'd' || k || '.py' AS file, (c + 5)::INT AS line, unnest(['nesting_depth', 'cyclomatic']) AS metric FROM k WHERE k % 2 = 0
UNION ALL SELECT 'd' || k || '.py', NULL, NULL FROM k WHERE k % 2 = 1""")
def code_directives(spark, sf_dir):
    return code_metrics.directives(_nodes(spark, sf_dir)).select("file", "line", "metric")


def _modules(spark, sf_dir) -> DataFrame:
    k = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    name = F.when(F.col("k") % 2 == 0, "limit").otherwise("other")
    alone = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("k") % 5).cast("int")), lambda i: F.when(i > 0, F.concat(F.lit("def alone_"), i.cast("string"), F.lit("(x):\n    return x * unknown\n"))).otherwise("")), "")
    head = "limit = 1\ndef first(x):\n    return x + limit\ndef second(x):\n    "
    source = F.concat(F.lit(head), name, F.lit(" = x\n    return first(limit)\n"), alone)
    return graph.cut(python_code.nodes(k.select(F.concat(F.lit("m"), F.col("k").cast("string"), F.lit(".py")).alias("file"), F.lit("python").alias("lang"), source.alias("source"))))


@query("""WITH k AS (SELECT 'm' || s_suppkey || '.py' AS file, s_suppkey % 2 = 0 AS hides, s_suppkey % 5 AS b FROM supplier),
u AS (SELECT file, unnest(range(b)) AS i FROM k)
SELECT file, r.name, r.line::INT AS line, (CASE r.def WHEN -1 THEN CASE WHEN hides THEN 5 ELSE 1 END ELSE r.def END)::INT AS def_line
FROM k, (VALUES ('x', 2, NULL), ('x', 3, NULL), ('limit', 3, 1), ('x', 4, NULL), ('x', 5, NULL), ('first', 6, 2), ('limit', 6, -1)) r(name, line, def)
UNION ALL SELECT file, n.name, (7 + 2 * i + n.line)::INT, NULL FROM u, (VALUES ('x', 0), ('x', 1), ('unknown', 1)) n(name, line)""")
def code_bindings(spark, sf_dir):
    return bindings.bindings(_modules(spark, sf_dir)).select("file", "name", F.col("row").alias("line"), F.col("def_row").alias("def_line"))


@query("SELECT 'm' || s_suppkey || '.py' AS file, 'limit' AS name, 5 AS line FROM supplier WHERE s_suppkey % 2 = 0")
def code_shadowed(spark, sf_dir):
    return bindings.shadowing(_modules(spark, sf_dir)).select("file", "name", F.col("row").alias("line"))


@query("""WITH k AS (SELECT s_suppkey AS k, 'm' || s_suppkey || '.py' AS file FROM supplier)
SELECT file, 'first' AS name, 1::BIGINT AS own FROM k UNION ALL SELECT file, 'second', 1 + k % 2 FROM k UNION ALL SELECT file, 'alone_' || (i + 1), 0 FROM (SELECT file, unnest(range(k % 5)) AS i FROM k)""")
def code_own_affinity(spark, sf_dir):
    nodes = _modules(spark, sf_dir)
    names = nodes.filter(code_metrics.has("function")).select("file", F.col("nid").alias("unit"), "name")
    return bindings.own_affinity(nodes, bindings.bindings(nodes)).join(names.hint("merge"), ["file", "unit"]).select("file", "name", "own")


@query("SELECT 'm' || s_suppkey || '.py' AS file, 2 AS line, 'first' AS unit, 1 + s_suppkey % 5 AS components FROM supplier")
def code_cohesion(spark, sf_dir):
    nodes = _modules(spark, sf_dir)
    return bindings.cohesion(nodes, bindings.bindings(nodes)).select("file", "line", "unit", "components")


def _packages(spark, sf_dir) -> DataFrame:
    k = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").cast("string").alias("name"), F.concat(F.lit("p"), (F.col("s_suppkey") % 5).cast("string")).alias("p"))
    b = F.lit("def _used(x):\n    return _helper(x)\ndef _helper(x):\n    return x\ndef _lost(x):\n    return _helper(_lost_too(x))\ndef _lost_too(x):\n    return x\n")
    way = F.when(F.col("k") % 3 == 0, F.concat("p", F.lit(".b"), "name", F.lit(" import _used"))).when(F.col("k") % 3 == 1, F.concat(F.lit(".b"), "name", F.lit(" import _used")))
    way = way.otherwise(F.concat(F.lit(".."), "p", F.lit(".b"), "name", F.lit(" import *")))
    a = F.concat(F.lit("from "), way, F.lit("\ndef run(x):\n    return "), F.when(F.col("k") % 2 == 0, "_used(x)\n").otherwise("x\n"))
    files = F.explode(F.array(F.struct(F.lit("a").alias("kind"), a.alias("source")), F.struct(F.lit("b").alias("kind"), b.alias("source"))))
    rows = k.withColumn("f", files).select(F.concat(F.lit("src/"), "p", F.lit("/"), "f.kind", "name", F.lit(".py")).alias("file"), F.lit("python").alias("lang"), "f.source")
    return graph.cut(python_code.nodes(rows))


_P = "k AS (SELECT s_suppkey AS k, 'src/p' || s_suppkey % 5 || '/a' || s_suppkey || '.py' AS a, 'src/p' || s_suppkey % 5 || '/b' || s_suppkey || '.py' AS b FROM supplier)"


@query(f"""WITH {_P} SELECT a AS file, 1 AS line, '_used' AS name, b AS def_file FROM k WHERE k % 3 <> 2 UNION ALL SELECT a, 3, '_used', b FROM k WHERE k % 2 = 0""")
def code_cross_references(spark, sf_dir):
    nodes = _packages(spark, sf_dir)
    seen = linkage.visible(nodes, linkage.symbols(nodes))
    return linkage.references(bindings.bindings(nodes), seen).select("file", F.col("row").alias("line"), "name", "def_file")


@query(f"""WITH {_P} SELECT b AS file, 5 AS line, '_lost' AS unit FROM k UNION ALL SELECT b, 7, '_lost_too' FROM k
UNION ALL SELECT b, n.line, n.unit FROM k, (VALUES (1, '_used'), (3, '_helper')) n(line, unit) WHERE k % 3 = 2 AND k % 2 = 1""")
def code_unreferenced(spark, sf_dir):
    nodes = _packages(spark, sf_dir)
    return linkage.unreferenced(nodes, graph.cut(bindings.bindings(nodes)))


@query(f"""WITH {_P} SELECT b AS def_file, count(*) FILTER (k % 3 = 2 OR n.unit = '_used') AS seen, 1::BIGINT AS most FROM k, (VALUES ('_used'), ('_helper'), ('_lost'), ('_lost_too')) n(unit) GROUP BY ALL""")
def code_definition_reach(spark, sf_dir):
    nodes = _packages(spark, sf_dir)
    found = linkage.reach(nodes, linkage.visible(nodes, linkage.symbols(nodes)))
    return found.groupBy("def_file").agg(F.count(F.lit(1)).alias("seen"), F.max("reach").alias("most"))
