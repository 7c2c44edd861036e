import numpy as np
import pytest

from quarryline.functions import scoring
from quarryline.operators import clones, findings, graph, text


def test_percentile_counts_values_no_greater(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 2, 3)] + [("b", 1)], "lang string, v int")
    got = {(r.lang, r.v): r.percentile for r in scoring.percentiles(df, ["lang"], "v", least=2).collect()}
    assert got == {("a", 1): 0.25, ("a", 2): 0.75, ("a", 3): 1.0, ("b", 1): None}


@pytest.mark.parametrize(
    ("name", "parts"),
    [("parseHTTPResponse", ["parse", "http", "response"]), ("read_file2", ["read", "file2"]), ("x", []), ("is_a_42", ["is"]), ("fooBar", ["foo", "bar"]), ("", []), ("ABC1d", ["abc1d"]), ("ABcD2Ef", ["bc", "d2", "ef"]), ("__x1__HTTP", ["x1", "http"])],
)
def test_subtokens(spark, name, parts):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(name,)], "n string").select(text.subtokens(F.col("n")).alias("t")).first()[0] == parts


def test_lcs_against_table():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(0, 12)), rng.integers(0, 4, rng.integers(0, 12))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert clones.lcs_length(a, b) == table[-1, -1]


def test_near_clone_lcs_query(spark):
    import re

    import duckdb

    from quarryline.plans import table_queries as t

    sf = "/root/testdata/sf0.001"
    got = {(r.x, r.y): r.similarity for r in t.QUERIES["near_clone_lcs"](spark, sf).collect()}
    tags = {p: re.findall(r"</?[a-z][a-z0-9]*", h)[:400] for p, h in duckdb.sql(f"SELECT page_id, html FROM '{sf}/pages.parquet'").fetchall()}
    near = t.QUERIES["near_clone_candidates"](spark, sf).collect()
    want = {}
    for r in near:
        a, b = tags[r.x], tags[r.y]
        code = {s: k for k, s in enumerate(set(a + b))}
        s = clones.lcs_length(np.array([code[v] for v in a]), np.array([code[v] for v in b])) / max(len(a), len(b))
        if s >= 0.85:
            want[r.x, r.y] = s
    assert got == pytest.approx(want)


def test_components_are_brute_force(spark):
    import duckdb

    from quarryline.plans import table_queries as t

    sf = "/root/testdata/sf0.001"
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for c, o in duckdb.sql(f"SELECT o_custkey, o_orderkey FROM '{sf}/orders.parquet'").fetchall():
        a, b = top(c), top((c * 31 + o) % 4000)
        up[max(a, b)] = min(a, b)
    assert {r.node: r.component for r in t.QUERIES["connected_components"](spark, sf).collect()} == {x: top(x) for x in list(up)}


def test_intervals_are_brute_force(spark):
    from quarryline.operators import intervals

    rng = np.random.default_rng(4)
    spans = [(1, k, int(a), int(a + n)) for k, (a, n) in enumerate(zip(rng.integers(-50, 5000, 300), rng.integers(0, 3000, 300), strict=True), 1)]
    points = [(1, k, int(a), int(a) + 3) for k, a in enumerate(rng.integers(-60, 8000, 200))]
    got = {r.p: r.unit for r in intervals.innermost(spark.createDataFrame(points, "file int, p long, lo long, hi long"), spark.createDataFrame(spans, "file int, s_id long, s_lo long, s_hi long"), "file", "p", "lo", "hi").collect()}
    want = {p: min(((h - l, s) for _, s, l, h in spans if l <= lo and hi <= h), default=(0, 0))[1] for _, p, lo, hi in points}
    assert got == want


def test_rules_and_gate(spark):
    from pyspark.sql import functions as F

    from quarryline.operators import gate

    lines = gate.Rule("lines", "scalar", lambda n: n.groupBy("file").agg(F.count(F.lit(1)).alias("value")).withColumn("unit", F.lit("")), 2, 3)
    empty = gate.Rule("empty", "flag", lambda n: n.limit(0))
    assert [r.name for r in gate.chosen([lines, empty], "scalar")] == ["lines"] and gate.metric_names([lines, empty]) == {"lines", "empty"}
    assert gate.chosen([lines], bands={"lines": (5, 9)})[0].high == 9
    for bad in (lambda: gate.chosen([lines], only={"other"}), lambda: gate.Rule("x", "scalar", lambda n: n), lambda: gate.Rule("x", "sum", lambda n: n)):
        with pytest.raises(ValueError):
            bad()
    n = spark.createDataFrame([("a",), ("a",), ("b",)], "file string")
    assert sorted((r.file, r.value, r.high) for r in gate.measured(n, [lines, empty]).collect()) == [("a", 2, 3), ("b", 1, 3)]
    f = spark.createDataFrame([("m", "a", 1, 9, "high", False), ("m", "a", 2, 8, "high", True), ("n", "b", 1, 7, "warn", False), ("n", "b", 3, 9, "high", None)], "metric string, file string, line int, value int, absolute string, suppressed boolean")
    assert [(r.metric, r.line) for r in gate.ordered(gate.errors(f, None, ["metric"], ["line"]), ["n", "m"]).collect()] == [("n", 3), ("m", 1)]


def test_pairs_that_were_reported(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 2), (4, 5)], "x int, y int")
    assert [(r.x, r.y) for r in clones.unreported(pairs, spark.createDataFrame([(2, 1), (2, 3)], "x int, y int")).collect()] == [(4, 5)]


def test_every_clone_is_a_member(spark):
    units = spark.createDataFrame([(1, "html", "a"), (2, "html", "a"), (3, "html", "b"), (4, "html", "b"), (5, "html", "c"), (6, "html", "c")], "id long, lang string, d string")
    clusters = spark.createDataFrame([(1, 1), (3, 1)], "node long, component long")
    got = sorted(tuple(r) for r in clones.members(units, clusters, "lang", "id", "d").collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 3, 1), (5, 5, 5), (6, 5, 5)]


def test_communities_stay_local(spark):
    star = [(1, k, 4.0) for k in range(2, 8)] + [(8, 9, 1.0), (10, 1, 3.0), (10, 8, 2.0)]
    for padding in (0, 20):
        pairs = [(100 + 2 * k, 101 + 2 * k, 20.0) for k in range(padding)]
        got = {}
        for r in graph.louvain(spark.createDataFrame(star + pairs, "x long, y long, w double")).collect():
            if r.node < 100:
                got.setdefault(r.community, set()).add(r.node)
        assert sorted(map(sorted, got.values())) == [[1, 2, 3, 4, 5, 6, 7], [8, 9, 10]]


def test_reachability_ends_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "x long, y long")
    assert sorted(r.node for r in graph.reachable(e, spark.createDataFrame([(1,)], "node long")).collect()) == [1, 2, 3]


@pytest.mark.parametrize(
    ("patterns", "path", "out"),
    [(["*.log"], "a/b.log", True), (["/b.log"], "a/b.log", False), (["a/**"], "a/x/y", True), (["*.log", "!keep.log"], "keep.log", False), (["a/*/c"], "a/b/c", True), (["a/*/c"], "a/b/d/c", False), (["**/x"], "q/r/x", True), (["fo?"], "foo", True), (["# c", ""], "c", False)],
)
def test_ignore_patterns(spark, patterns, path, out):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(findings.ignored(F.col("p"), patterns)).first()[0] is out


def test_interval_joins_merge(spark):
    from quarryline.plans import table_queries as t

    for name in ("nearest_definition", "innermost_interval", "owning_scope_hoisted"):
        plan = t.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_points_look_into_orders_of_size_that_spans_have(spark):
    from quarryline.operators import intervals

    points = spark.range(100).selectExpr("1 AS file", "id AS p", "id AS lo", "id AS hi")
    spans = spark.range(100).selectExpr("1 AS file", "id AS s_id", "id - 20 AS s_lo", "id + 20 AS s_hi")
    found = intervals.containing(points, spans, "file", "lo", "hi")
    assert found.count() == sum(abs(a - b) <= 20 for a in range(100) for b in range(100))
    # a row for each point, not one for each of 13 orders; spans that reach below 0 have two bins
    assert sorted(_join_inputs(found)) == [100, 120]


def _join_inputs(df):
    """Rows that the exchanges of df's plan were given."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    rows, todo = [], [plan]
    while todo:
        p = todo.pop()
        if p.nodeName() == "Exchange" and "hashpartitioning" in p.toString().split("\n")[0]:
            rows.append(p.metrics().apply("shuffleRecordsWritten").value())
        todo += [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in p.nodeName() else [p.children().apply(k) for k in range(p.children().size())]
    return rows


def test_vocabularies_are_brute_force(spark):
    import math

    rng = np.random.default_rng(5)
    docs = [sorted({f"w{int(x)}" for x in rng.zipf(1.3, 30) % 400}) for _ in range(60)]
    docs += [d[:-1] for d in docs[:20]] + [docs[0]] * 12
    rows = [(k, "t", d, " ".join(d)) for k, d in enumerate(docs)]
    df = {w: sum(w in d for d in docs) for w in set().union(*docs)}
    idf = {w: math.log2((len(docs) + 1) / (n + 1)) for w, n in df.items()}
    weigh = lambda s: sum(idf[w] for w in s)
    want = {}
    for a in range(len(docs)):
        for b in range(a + 1, len(docs)):
            both = set(docs[a]) & set(docs[b])
            if docs[a] != docs[b] and sum(df[w] == 2 for w in both) >= 2 and weigh(both) >= 0.5 * weigh({*docs[a], *docs[b]}):
                want[a, b] = weigh(both) / weigh({*docs[a], *docs[b]})
    got = text.shared_vocabulary(spark.createDataFrame(rows, "id long, lang string, w array<string>, d string"), "id", "lang", "w", "d", 0.5).collect()
    assert want and {(r.x, r.y): r.score for r in got} == pytest.approx(want)


def test_fronts_leave_common_terms_out(spark):
    v = spark.createDataFrame([(1, [7, 8, 9], [4.0, 3.0, 1.0], [True, False, True], 8.0), (2, [9], [1.0], [True], 1.0)], "u long, tids array<long>, idfs array<double>, shared array<boolean>, total double")
    assert sorted((r.u, r.tid, r.rest) for r in text.fronts(v, 0.5).collect()) == [(1, 7, 8.0), (2, 9, 1.0)]


def test_trigrams_move_once(spark):
    docs = spark.createDataFrame([(1, "a", "f", "x y x y".split()), (2, "a", "g", ["x"])], "id long, lang string, file string, t array<string>")
    for df in (text.model(text.trigrams(docs.select("lang", "t"), "t"), ["lang"]), text.cross_entropy(docs, "t", "id", "lang", "file")):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[-1].count("hashpartitioning(lang") == 1
