"""References across the files of a Python tree, and definitions that nothing reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators import graph
from quarryline.operators.bindings import every_definition, has
from quarryline.operators.intervals import containing


def symbols(nodes: DataFrame) -> DataFrame:
    """file, name, kind, d_id, row, last, public: functions and classes of modules; an underscore in front makes one private."""
    roots = nodes.filter("type = 'module'").select("file", F.col("nid").alias("s_id"))
    named = every_definition(nodes).filter("kind <> 'local'").join(roots.hint("merge"), ["file", "s_id"])
    return named.select("file", "name", "kind", "d_id", "row", "last", (~F.col("name").startswith("_")).alias("public"))


def imports(nodes: DataFrame) -> DataFrame:
    """file, level (leading dots), module, names: the from-imports; names are those that keep their own, none brings in all."""
    froms = nodes.filter(has("import")).select("file", F.col("nid").alias("parent"), F.length("text").alias("level"), F.col("name").alias("module"))
    names = nodes.filter(has("imported") & (F.col("text") == "") & (F.col("name") != "*")).select("file", "parent", "name")
    brought = froms.join(names.hint("merge"), ["file", "parent"], "left").groupBy("file", "parent", "level", "module").agg(F.collect_set("name").alias("names"))
    return brought.drop("parent")


def targets(found: DataFrame, files: DataFrame) -> DataFrame:
    """found (file, level, module, ...) with path: the files (file) that a module may be.

    Dots count folders up from the importing file's; without them every path that ends in the
    module counts. Paths are joined by each of their ends, so no name that many files have is a hot key.
    """
    folder = F.slice(F.split("file", "/"), F.lit(1), F.greatest(F.size(F.split("file", "/")) - F.greatest(F.col("level"), F.lit(1)), F.lit(0)))
    parts = F.filter(F.split("module", r"\."), lambda x: x != "")
    whole = F.when(F.col("level") > 0, F.concat(folder, parts)).otherwise(parts)
    module = F.array_join(whole, "/")
    package = F.array_join(F.concat(whole, F.array(F.lit("__init__.py"))), "/")
    asked = found.withColumn("__end", F.explode(F.array(F.concat(module, F.lit(".py")), package)))
    steps = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(F.array_join(F.slice(steps, k, F.size(steps)), "/").alias("end"), (k == 1).alias("whole")))
    known = files.select(F.col("file").alias("path")).distinct().select("path", F.explode(ends).alias("e"))
    joined = asked.join(known.hint("merge"), asked["__end"] == known["e.end"])
    return joined.filter((F.col("level") == 0) | F.col("e.whole")).drop("__end", "e").distinct()


def visible(nodes: DataFrame, defined: DataFrame) -> DataFrame:
    """file, name, def_file, def: the symbols of other files that a file's imports bring in; defined: symbols()."""
    found = targets(imports(nodes), nodes.filter("type = 'module'").select("file"))
    there = defined.select(F.col("file").alias("path"), "name", F.col("d_id").alias("def"))
    brought = found.join(there.hint("merge"), "path").filter((F.col("path") != F.col("file")) & ((F.size("names") == 0) | F.array_contains("names", F.col("name"))))
    return brought.select("file", "name", F.col("path").alias("def_file"), "def").distinct()


def references(bound: DataFrame, seen: DataFrame) -> DataFrame:
    """file, ref, owner, row, name, def_file, def: references that their own file doesn't define, with every candidate; seen: visible()."""
    free = bound.filter("def IS NULL").select("file", "ref", "owner", "row", "name")
    return free.join(seen.hint("merge"), ["file", "name"]).select("file", "ref", "owner", "row", "name", "def_file", "def")


def reach(nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """def_file, def, reach: how many functions are in the files that see a definition."""
    functions = nodes.filter(has("function")).groupBy("file").agg(F.count(F.lit(1)).alias("m"))
    return seen.select("file", "def_file", "def").distinct().join(functions.hint("merge"), "file").groupBy("def_file", "def").agg(F.sum("m").alias("reach"))


def reach_graph(defined: DataFrame, bound: DataFrame, across: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (x, y) between symbols (file, def), and the roots (node).

    A reference counts for the function of the module that it is in, of whatever depth; one in no
    such function makes a root of what it names, and public symbols are roots. What is named in its
    own file stands for all symbols of that name there.
    """
    node = lambda file, d: F.struct(F.col(file).alias("file"), F.col(d).alias("def"))
    named = defined.select("file", F.col("d_id").alias("def"), "name").join(defined.select("file", "name", F.col("d_id").alias("same")).hint("merge"), ["file", "name"])
    inside = bound.filter("def IS NOT NULL").select("file", "ref", "def").join(named.drop("name").hint("merge"), ["file", "def"])
    uses = inside.select("file", "ref", node("file", "same").alias("y")).union(across.select("file", "ref", node("def_file", "def").alias("y")))
    uses = graph.cut(uses.distinct())
    spans = defined.filter("kind = 'function'").select("file", F.col("d_id").alias("s_id"), F.col("d_id").alias("s_lo"), F.col("last").alias("s_hi"))
    held = containing(uses.select("file", "ref").distinct(), spans, "file", "ref", "ref").select("file", "ref", node("file", "s_id").alias("x"))
    placed = graph.cut(uses.join(held.hint("merge"), ["file", "ref"], "left").select("x", "y").distinct())
    roots = defined.filter("public").select(node("file", "d_id").alias("node")).union(placed.filter("x IS NULL").select("y"))
    return placed.filter("x IS NOT NULL"), roots.distinct()


def unreferenced(nodes: DataFrame, bound: DataFrame) -> DataFrame:
    """file, line, unit: symbols that no path of references from the roots leads to."""
    defined = graph.cut(symbols(nodes))
    edges, roots = reach_graph(defined, bound, references(bound, visible(nodes, defined)))
    alive = graph.reachable(edges, roots).select("node.file", F.col("node.def").alias("d_id"))
    return defined.join(alive.hint("merge"), ["file", "d_id"], "left_anti").select("file", F.col("row").alias("line"), F.col("name").alias("unit"))
