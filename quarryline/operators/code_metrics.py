"""Function metrics and flags over the node table, and the findings of a source tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryline.functions.scoring import percentiles, severity
from quarryline.operators import bindings, graph, linkage
from quarryline.operators.clones import exact_clusters, maximal
from quarryline.operators.findings import suppressed
from quarryline.operators.intervals import containing

# Bands (warn, high), both inclusive.
BANDS = {
    "cyclomatic": (11, 21),
    "cognitive_complexity": (15, 25),
    "function_length": (50, 100),
    "nesting_depth": (4, 6),
    "parameter_count": (5, 8),
    "boolean_complexity": (4, 6),
}
OPTIONAL_BANDS = {"return_count": (4, 8), "local_count": (10, 15), "fan_out": (12, 20), "npath": (200, 1000)}
# Operators that may well have equal operands.
IDEMPOTENT = ("Add", "Mult", "Pow", "LShift", "RShift", "Div", "NotEq")
OPTIONAL_FLAGS = ("unreachable_after_jump", "trivial_wrapper", "shadowed_variable")
FLAGS = (
    "stub_marker", "broad_catch", "empty_catch", "empty_body", "identical_operands", "duplicate_branches", "return_in_finally",
    "unused_parameter", "unused_local", *OPTIONAL_FLAGS,
)
CLONE_SIZE = 10
COHESION_BAND, COHESION_FILES = (4, 6), 5


def has(concept: str):
    return F.array_contains("concepts", concept)


def units(nodes: DataFrame) -> DataFrame:
    return nodes.filter(has("function")).select("file", F.col("nid").alias("unit"), "name", F.col("row").alias("line"), "end_row", "last", "hash", "size", "paths")


def _above(nodes: DataFrame, inner, outer, strict: bool) -> DataFrame:
    """Pairs of a unit's nodes: inner ones with the outer ones around them. The join has equi keys (file, owner)."""
    i = nodes.filter(inner).select("file", "owner", "nid", F.col("name").alias("own"), "concepts")
    o = nodes.filter(outer).select(F.col("file").alias("f"), F.col("owner").alias("w"), F.col("nid").alias("o_nid"), F.col("last").alias("o_last"), F.col("name").alias("o_name"))
    edge = (o["o_nid"] < i["nid"]) if strict else (o["o_nid"] <= i["nid"])
    return i.join(o.hint("merge"), (i["file"] == o["f"]) & (i["owner"] == o["w"]) & edge & (i["nid"] <= o["o_last"]), "left")


def scalars(nodes: DataFrame, optional: bool = False) -> DataFrame:
    """file, unit, metric, value of every function."""
    own = nodes.filter("owner IS NOT NULL")
    key = ["file", F.col("owner").alias("unit")]
    count = lambda c: F.sum(c.cast("long"))
    flat = own.groupBy(*key).agg(
        (1 + count(has("decision") | has("short_circuit"))).alias("cyclomatic"),
        count(has("positional")).alias("parameter_count"),
        count(has("return")).alias("return_count"),
        F.count_distinct(F.when(has("binding") & ~F.col("name").startswith("_"), F.col("name"))).alias("local_count"),
    )
    deep = _above(own, has("nesting"), has("nesting"), False).groupBy("file", "owner", "nid").agg(F.count("o_nid").alias("d"))
    deep = deep.groupBy(*key).agg(F.max("d").alias("nesting_depth"))
    cost = _above(own, has("decision"), has("nesting"), True).groupBy("file", "owner", "nid").agg(F.count("o_nid").alias("d"), F.first(has("continuation")).alias("more"))
    cost = cost.groupBy(*key).agg(F.sum(F.when(F.col("more"), 1).otherwise(1 + F.col("d"))).alias("cost"))
    ops = _above(own, has("short_circuit"), has("short_circuit"), False)
    widest = ops.groupBy("file", "owner", "o_nid").agg(F.count(F.lit(1)).alias("m")).groupBy(*key).agg(F.max("m").alias("boolean_complexity"))
    runs = _above(own, has("short_circuit"), has("short_circuit"), True).groupBy("file", "owner", "nid", "own").agg(F.max_by("o_name", "o_nid").alias("up"))
    runs = runs.groupBy(*key).agg(count(F.col("up").isNull() | (F.col("up") != F.col("own"))).alias("runs"))
    u = units(nodes)
    calls = own.filter(has("call") & (F.col("name") != "")).select("file", F.col("owner").alias("unit"), F.col("name").alias("callee")).join(u.select("file", "unit", "name").hint("merge"), ["file", "unit"])
    calls = calls.groupBy("file", "unit").agg(F.count_distinct(F.when(F.col("callee") != F.col("name"), F.col("callee"))).alias("fan_out"))
    out = u
    for part in (flat, deep, cost, widest, runs, calls):
        out = out.join(part.hint("merge"), ["file", "unit"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = out.select(
        "file", "unit", "name", "line", F.col("cyclomatic"), (zero("cost") + zero("runs")).alias("cognitive_complexity"), (F.col("end_row") - F.col("line") + 1).cast("long").alias("function_length"),
        *(zero(c).alias(c) for c in ("nesting_depth", "parameter_count", "boolean_complexity", "return_count", "local_count", "fan_out")), F.col("paths").alias("npath"),
    )
    chosen = [*BANDS, *(OPTIONAL_BANDS if optional else [])]
    return out.unpivot(["file", "unit", "name", "line"], chosen, "metric", "value")


def wrappers(nodes: DataFrame) -> DataFrame:
    """Functions whose body is one call, alone or returned."""
    inside = nodes.filter(F.array_contains("concepts", "function_body")).select("file", F.col("nid").alias("parent"), F.col("parent").alias("function"))
    parts = nodes.filter(~has("trivial") & ~has("comment")).join(inside.hint("merge"), ["file", "parent"])
    alone = parts.groupBy("file", "function").agg(F.count(F.lit(1)).alias("m"), F.first("nid").alias("parent"), F.first("type").alias("kind"))
    alone = alone.filter((F.col("m") == 1) & F.col("kind").isin("expr", "return"))
    called = nodes.filter(has("call")).select("file", "parent").join(alone.hint("merge"), ["file", "parent"]).select("file", F.col("function").alias("nid"))
    return nodes.join(called.hint("merge"), ["file", "nid"], "left_semi")


def flags(nodes: DataFrame, optional: bool = False) -> DataFrame:
    """file, line, unit (name of a flagged function, else empty), metric."""
    mark = lambda df, metric, name=F.lit(""): df.select("file", F.col("row").alias("line"), name.alias("unit"), F.lit(metric).alias("metric"))
    n = nodes
    kids = n.filter("parent >= 0").groupBy("file", F.col("parent").alias("nid")).agg(F.sum((~has("trivial") & ~has("comment")).cast("int")).alias("real"))
    bodies = n.filter(has("body")).join(kids.hint("merge"), ["file", "nid"], "left").filter("coalesce(real, 0) = 0")
    up = n.select("file", F.col("nid").alias("parent"), F.col("row").alias("up_row"), F.col("concepts").alias("up"), F.col("name").alias("up_name"))
    of = bodies.join(up.hint("merge"), ["file", "parent"]).withColumn("row", F.col("up_row"))
    empty_catch = mark(of.filter(F.array_contains("up", "catch")), "empty_catch")
    empty_body = mark(of.filter(~F.array_contains("up", "catch") & ~F.array_contains("up", "function")), "empty_body")
    operands = n.filter(has("binary_expr") & (F.col("text") != "")).withColumn("p", F.split("text", "\x1f"))
    operands = operands.filter((F.get("p", F.lit(1)) == F.get("p", F.lit(2))) & ~F.get("p", F.lit(0)).isin(*IDEMPOTENT))
    # the blocks of a conditional: its own, and those of its elif parts
    part = n.filter(F.col("type") == "elif").select("file", F.col("nid").alias("parent"), F.col("parent").alias("top"))
    blocks = n.filter(F.array_contains("concepts", "branch_body")).join(part.hint("merge"), ["file", "parent"], "left").withColumn("top", F.coalesce("top", "parent"))
    same = blocks.groupBy("file", F.col("top").alias("nid")).agg(F.count(F.lit(1)).alias("m"), F.count_distinct("text").alias("d")).filter("m >= 2 AND d = 1")
    near = n.filter(has("finally") | has("function")).select(F.col("file").alias("f"), F.col("nid").alias("a"), F.col("last").alias("b"), has("finally").alias("fin"))
    back = n.filter(has("return"))
    back = back.join(near.hint("merge"), (back["file"] == near["f"]) & (near["a"] < back["nid"]) & (back["nid"] <= near["b"])).groupBy("file", "nid", "row").agg(F.max_by("fin", "a").alias("fin"))
    before = W.partitionBy("file", "parent").orderBy("nid").rowsBetween(W.unboundedPreceding, -1)
    inside = n.join(n.filter(has("body")).select("file", F.col("nid").alias("parent")).hint("merge"), ["file", "parent"], "left_semi").withColumn("ended", F.sum(has("terminal").cast("int")).over(before))
    dead = inside.withColumn("row_of", F.row_number().over(W.partitionBy("file", "parent", F.col("ended") > 0).orderBy("nid"))).filter("ended > 0 AND row_of = 1")
    names = n.filter(has("reference")).select(F.col("file").alias("f"), F.col("name").alias("r"), F.col("nid").alias("at"))
    span = units(n).select("file", F.col("unit").alias("owner"), "last")
    given = n.filter(has("parameter") & ~F.col("name").startswith("_") & ~F.col("name").isin("self", "cls")).drop("last").join(span.hint("merge"), ["file", "owner"])
    full = n.filter(F.array_contains("concepts", "function_body")).join(kids.filter("real > 0").select("file", "nid").hint("merge"), ["file", "nid"], "left_semi").select("file", F.col("parent").alias("owner"))
    used = (given["file"] == names["f"]) & (given["name"] == names["r"]) & (given["owner"] < names["at"]) & (names["at"] <= given["last"])
    unused = given.join(full.hint("merge"), ["file", "owner"], "left_semi").join(names.hint("merge"), used, "left_anti")
    bound = n.filter(has("binding") & F.col("owner").isNotNull() & ~F.col("name").startswith("_")).groupBy("file", "owner", "name").agg(F.min("row").alias("row")).join(span.hint("merge"), ["file", "owner"])
    unbound = bound.join(names.hint("merge"), (bound["file"] == names["f"]) & (bound["name"] == names["r"]) & (bound["owner"] < names["at"]) & (names["at"] <= bound["last"]), "left_anti")
    found = [
        mark(n.filter(has("comment") & F.col("text").rlike(r"(?i)\b(?:TODO|FIXME|XXX|HACK)\b")), "stub_marker"),
        mark(n.filter(has("broad_catch")), "broad_catch"),
        empty_catch, empty_body,
        mark(operands, "identical_operands"),
        mark(n.join(same.hint("merge"), ["file", "nid"], "left_semi"), "duplicate_branches"),
        mark(back.filter("fin"), "return_in_finally"),
        mark(unused, "unused_parameter"), mark(unbound, "unused_local"),
        *([mark(dead, "unreachable_after_jump"), mark(wrappers(n), "trivial_wrapper", F.col("name")), mark(bindings.shadowing(n), "shadowed_variable")] if optional else []),
    ]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def directives(nodes: DataFrame, keyword: str = "quarry") -> DataFrame:
    """file, line (null: whole file), metric (null: all) from comments like "# quarry: ignore[a, b]" and "# quarry: ignore-file"."""
    c = nodes.filter(has("comment")).select("file", "row", F.regexp_extract("text", rf"(?i){keyword}:\s*(ignore(?:-file)?)(?:\[([^\]]*)\])?", 1).alias("k"), F.regexp_extract("text", rf"(?i){keyword}:\s*ignore(?:-file)?\[([^\]]*)\]", 1).alias("m"))
    c = c.filter("k <> ''").withColumn("metric", F.explode(F.when(F.col("m") == "", F.array(F.lit(None).cast("string"))).otherwise(F.transform(F.split("m", ","), lambda x: F.trim(x)))))
    return c.select("file", F.when(F.lower("k") == "ignore", F.col("row")).alias("line"), "metric")


def anchors(nodes: DataFrame, least: int = CLONE_SIZE) -> DataFrame:
    """file, nid, line, name, hash, up (hash of the nearest anchor around): what may be a clone.

    Functions of least nodes; those without control flow, and blocks (which have no name), need twice as many.
    """
    functions = nodes.filter(has("function")).select("file", F.col("nid").alias("s_id"), F.col("nid").alias("s_lo"), F.col("last").alias("s_hi"))
    control = nodes.filter(has("decision") | has("nesting")).select("file", F.col("nid").alias("at"))
    steered = containing(control, functions, "file", "at", "at").select("file", F.col("s_id").alias("nid")).distinct().withColumn("steered", F.lit(True))
    large = nodes.filter(has("function") | has("body")).join(steered.hint("merge"), ["file", "nid"], "left")
    large = large.filter(F.col("size") >= F.when(has("function") & F.col("steered"), least).otherwise(2 * least))
    large = graph.cut(large.select("file", "nid", "last", F.col("row").alias("line"), "name", "hash"))
    spans = large.select("file", F.col("nid").alias("s_id"), F.col("nid").alias("s_lo"), F.col("last").alias("s_hi"), F.col("hash").alias("s_hash"))
    up = containing(large.select("file", "nid"), spans, "file", "nid", "nid").filter("s_id < nid").groupBy("file", "nid").agg(F.max_by("s_hash", "s_id").alias("up"))
    return large.drop("last").join(up.hint("merge"), ["file", "nid"], "left")


def duplicates(nodes: DataFrame, least: int = CLONE_SIZE) -> DataFrame:
    """file, line, name, hash, members: exact clones that no clone of as many members holds, a row for each place."""
    found = graph.cut(anchors(nodes, least).withColumn("lang", F.lit("python")))
    groups = exact_clusters(found, "lang", "hash", "file")
    return maximal(found, groups, "up", "hash").join(groups.select("hash", "members"), "hash").select("file", "line", "name", "hash", "members")


def low_cohesion(nodes: DataFrame, bound: DataFrame, cut: float, band: tuple[int, int] = COHESION_BAND) -> DataFrame:
    """file, line, unit, value, absolute, percentile of files whose functions fall into unconnected groups.

    The place is the file's first function; with fewer than COHESION_FILES files there is no percentile.
    """
    groups = bindings.cohesion(nodes, bound).select("file", "line", "unit", F.col("components").cast("long").alias("value"))
    scored = percentiles(groups, [], "value", least=COHESION_FILES).withColumn("absolute", severity(F.col("value"), *band))
    return scored.filter((F.col("absolute") != "ok") | (F.col("percentile") >= cut))


def analyze(
    nodes: DataFrame, cut: float = 0.95, optional: bool = False, bands: dict[str, tuple[int, int]] | None = None, rules: dict[str, bool] | None = None, clone_size: int = CLONE_SIZE
) -> DataFrame:
    """Findings: metric, file, line, unit, value, absolute, percentile, kind, suppressed.

    bands takes the place of single limits; rules turns metrics and flags on or off, the optional ones
    included. The node table is written once, so that every file is parsed once for all passes.
    """
    nodes = graph.cut(nodes)
    bound = graph.cut(bindings.bindings(nodes))
    bands, rules = bands or {}, rules or {}
    every = {m: bands.get(m, b) for m, b in (BANDS | OPTIONAL_BANDS).items() if rules.get(m, optional or m in BANDS)}
    flagged = [m for m in FLAGS if rules.get(m, optional or m not in OPTIONAL_FLAGS)]
    limits = F.struct(F.lit(None).cast("int").alias("warn"), F.lit(None).cast("int").alias("high"))
    for m, (w, h) in every.items():
        limits = F.when(F.col("metric") == m, F.struct(F.lit(w).alias("warn"), F.lit(h).alias("high"))).otherwise(limits)
    s = percentiles(scalars(nodes, True).filter(F.col("metric").isin(list(every))), ["metric"], "value").withColumn("b", limits)
    s = s.withColumn("absolute", severity(F.col("value"), F.col("b.warn"), F.col("b.high"))).filter((F.col("absolute") != "ok") | (F.col("percentile") >= cut))
    s = s.select("metric", "file", "line", F.col("name").alias("unit"), "value", "absolute", "percentile", F.lit("scalar").alias("kind"))
    none = lambda t: F.lit(None).cast(t)
    f = flags(nodes, any(m in flagged for m in OPTIONAL_FLAGS)).filter(F.col("metric").isin(flagged)).select("metric", "file", "line", "unit", none("long").alias("value"), F.lit("high").alias("absolute"), none("double").alias("percentile"), F.lit("flag").alias("kind"))
    d = duplicates(nodes, clone_size)
    d = d.select(F.lit("duplicate").alias("metric"), "file", "line", F.col("name").alias("unit"), F.col("members").alias("value"), F.lit("high").alias("absolute"), none("double").alias("percentile"), F.lit("flag").alias("kind"))
    c = low_cohesion(nodes, bound, cut, bands.get("low_cohesion", COHESION_BAND)).withColumn("metric", F.lit("low_cohesion")).withColumn("kind", F.lit("scalar"))
    r = linkage.unreferenced(nodes, bound)
    r = r.select(F.lit("unreferenced").alias("metric"), "file", "line", "unit", none("long").alias("value"), F.lit("high").alias("absolute"), none("double").alias("percentile"), F.lit("flag").alias("kind"))
    return suppressed(s.unionByName(f).unionByName(d).unionByName(c).unionByName(r), directives(nodes))
