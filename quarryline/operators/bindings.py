"""Scopes, definitions and references of the node table, and what they bind to.

A node's position is its pre-order number, so a scope is the span [nid, last]. Joins of positions
with scopes are those of intervals.py, with equal keys only, and like those merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators import graph
from quarryline.operators.intervals import containing, nearest_definition, owning


def has(concept: str):
    return F.array_contains("concepts", concept)


def scopes(nodes: DataFrame) -> DataFrame:
    """file, s_id, s_lo, s_hi of modules, classes, functions and lambdas."""
    return nodes.filter(has("scope")).select("file", F.col("nid").alias("s_id"), F.col("nid").alias("s_lo"), F.col("last").alias("s_hi"))


def every_definition(nodes: DataFrame) -> DataFrame:
    """file, name, kind, d_id, owner (function around it), row, last and its scope (s_id, s_lo, s_hi).

    The names of functions and classes belong to the scope around their own; assigned names are locals.
    """
    kind = F.when(has("function"), "function").when(has("class"), "class").when(has("assigned"), "local")
    named = nodes.withColumn("kind", kind).filter("kind IS NOT NULL").select("file", "name", "kind", F.col("nid").alias("d_id"), "owner", "row", "last")
    named = named.withColumn("at", F.struct("file", "d_id")).withColumn("hoisted", F.col("kind") != "local")
    inside = scopes(nodes)
    home = owning(named, inside, "file", "at", "d_id", "d_id", "hoisted").select("at.*", F.col("scope").alias("s_id"))
    return named.drop("at", "hoisted").join(home.hint("merge"), ["file", "d_id"]).join(inside.hint("merge"), ["file", "s_id"])


def definitions(nodes: DataFrame) -> DataFrame:
    """every_definition without last; of several of a name in a scope the first."""
    first = F.min(F.struct("d_id", "kind", "owner", "row")).alias("f")
    return every_definition(nodes).groupBy("file", "name", "s_id", "s_lo", "s_hi").agg(first).select("file", "name", "f.*", "s_id", "s_lo", "s_hi")


def references(nodes: DataFrame) -> DataFrame:
    """file, ref, name, owner, row: every use of an identifier but those that define.

    Attributes, keywords, parameters and the parts of dotted and of imported names are uses, too.
    """
    used = has("reference") | (has("binding") & ~has("assigned")) | has("parameter") | has("mention")
    parts = F.when(has("mention"), F.concat(F.split("name", r"\."), F.when(has("imported"), F.array("text")).otherwise(F.array().cast("array<string>")))).otherwise(F.array("name"))
    found = nodes.filter(used).select("file", F.col("nid").alias("ref"), "owner", "row", F.explode(F.array_distinct(parts)).alias("name"))
    return found.filter("name NOT IN ('', '*')")


def bindings(nodes: DataFrame) -> DataFrame:
    """references with def, def_owner and def_row of what each is bound to; null where no definition of the file is."""
    defs = graph.cut(definitions(nodes))
    refs = references(nodes).withColumn("at", F.struct("file", "ref", "name"))
    found = nearest_definition(refs, defs.select("file", "name", "d_id", "s_id", "s_lo", "s_hi"), "file", "name", "at", "ref", "ref").select("at.*", "def")
    where = defs.select("file", F.col("d_id").alias("def"), F.col("owner").alias("def_owner"), F.col("row").alias("def_row"))
    return refs.drop("at").join(found.join(where.hint("merge"), ["file", "def"]).hint("merge"), ["file", "ref", "name"], "left")


def shadowing(nodes: DataFrame) -> DataFrame:
    """Local definitions (file, name, d_id, row) whose name a scope around theirs defines as well."""
    defs = graph.cut(definitions(nodes))
    local = defs.filter((F.col("kind") == "local") & ~F.col("name").startswith("_")).select("file", "name", "d_id", "row", F.col("s_id").alias("own"), F.col("s_lo").alias("lo"), F.col("s_hi").alias("hi"))
    around = containing(local, defs.select("file", "name", "s_id", "s_lo", "s_hi"), "file", "lo", "hi", ("name",))
    return around.filter("s_id <> own").select("file", "name", "d_id", "row").distinct()


def own_affinity(nodes: DataFrame, bound: DataFrame) -> DataFrame:
    """file, unit, own: how many references of a function are bound to definitions of its file outside it."""
    away = bound.filter("def IS NOT NULL AND owner IS NOT NULL AND NOT (def_owner <=> owner)").groupBy("file", F.col("owner").alias("unit")).agg(F.count(F.lit(1)).alias("own"))
    units = nodes.filter(has("function")).select("file", F.col("nid").alias("unit"))
    return units.join(away.hint("merge"), ["file", "unit"], "left").select("file", "unit", F.coalesce("own", F.lit(0)).alias("own"))


def cohesion(nodes: DataFrame, bound: DataFrame) -> DataFrame:
    """file, components, line, unit: groups of functions that share no definition, and the first function.

    Functions that use one definition are joined, with the function that it stands in; files with
    fewer than two functions are left out.
    """
    node = lambda unit: F.struct("file", F.col(unit).alias("unit"))
    used = bound.filter("def IS NOT NULL AND owner IS NOT NULL").select("file", "def", "owner", "def_owner")
    members = used.select("file", "def", node("owner").alias("unit")).union(used.filter("def_owner IS NOT NULL").select("file", "def", node("def_owner").alias("unit")))
    functions = nodes.filter(has("function")).select("file", F.col("nid").alias("n"), "row", "name")
    groups = graph.low_cohesion(functions.select("file", node("n").alias("unit")), graph.binding_edges(members))
    first = functions.groupBy("file").agg(F.min(F.struct(F.col("row").alias("line"), "n", F.col("name").alias("unit"))).alias("f"))
    return groups.join(first.hint("merge"), "file").select("file", "components", "f.line", "f.unit")
