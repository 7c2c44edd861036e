"""Components, reachability, neighbourhoods, communities, mass and placement.

Loops write their tables to the folder of spark.checkpoint.dir and delete those that no later step
reads. Only the last table of a loop stays, since the result is read from it. Joins of tables that grow
are told to merge: Spark would broadcast by the size of a file, and the driver holds the table unpacked.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rounds of local moving after which communities are taken as they are.
ROUNDS = 24


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = getattr(spark.sparkContext, "_quarryline_graph", None) or "file://" + tempfile.mkdtemp(prefix="quarryline-graph")
    spark.sparkContext._quarryline_graph = base
    return base


def cut(df: DataFrame) -> DataFrame:
    """df from a table in the folder of spark.checkpoint.dir (a temporary one only where that is unset and Spark is local)."""
    spark = df.sparkSession
    path = f"{_folder(spark).rstrip('/')}/quarryline-{spark.sparkContext.applicationId}/graph-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarryline_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what cut() has written for tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_quarryline_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node) for edges (x, y): least labels along edges, then labels of labels."""
    both = cut(edges.select("x", "y").union(edges.select("y", "x")).distinct())
    table = cut(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("component")))
    labels = table
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "component").hint("merge"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near.hint("merge"), "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        step = cut(step.join(jump.hint("merge"), "component", "left").select("node", "old", F.least("component", F.coalesce("up", "component")).alias("component")))
        drop(table)
        table, labels = step, step.select("node", "component")
        if step.filter("old <> component").limit(1).count() == 0:
            drop(both)
            return labels


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node: everything that edges (x, y) lead to from roots (node), roots included; cycles end."""
    seen = cut(roots.select("node").distinct())
    front = cut(seen)
    while front.limit(1).count():
        step = cut(front.join(edges.hint("merge"), front["node"] == edges["x"]).select(F.col("y").alias("node")).distinct().join(seen.hint("merge"), "node", "left_anti"))
        more = cut(seen.union(step))
        drop(front, seen)
        front, seen = step, more
    return seen


def neighbourhood(edges: DataFrame, focus: DataFrame, hops: int) -> DataFrame:
    """node, hop: nodes within so many undirected steps of focus (node)."""
    both = edges.select("x", "y").union(edges.select("y", "x")).distinct()
    seen = focus.select("node").distinct().withColumn("hop", F.lit(0))
    for k in range(1, hops + 1):
        step = seen.filter(F.col("hop") == k - 1).join(both, F.col("node") == F.col("x")).select(F.col("y").alias("node")).distinct()
        more = cut(seen.union(step.join(seen, "node", "left_anti").withColumn("hop", F.lit(k))))
        drop(seen)
        seen = more
    return seen


def reference_mass(refs: DataFrame, breadth_floor: int = 3, breadth_share: float = 0.05) -> DataFrame:
    """src, file, mass from refs (ref, src, def, file): each reference spreads 1 over its candidates.

    Definitions that more sources use than breadth_floor, and than breadth_share of all sources,
    are utilities: they are no candidates.
    """
    breadth = refs.groupBy("def").agg(F.countDistinct("src").alias("breadth"))
    reach = refs.select("src").distinct().agg(F.count(F.lit(1)).alias("reach"))
    kept = breadth.join(F.broadcast(reach)).filter(F.col("breadth") <= F.greatest(F.lit(breadth_floor), F.ceil(F.col("reach") * breadth_share))).select("def")  # reach: one row
    refs = refs.join(kept, "def")
    k = refs.groupBy("ref").agg(F.count(F.lit(1)).alias("k"))
    return refs.join(k, "ref").groupBy("src", "file").agg(F.sum(1.0 / F.col("k")).alias("mass"))


def envy(mass: DataFrame, home: DataFrame) -> DataFrame:
    """src, own, best_file, envy: percentage of a source's mass in the file that draws it most but its own.

    home: src, own_file, own (references that stay inside). Ties go to the smallest file.
    """
    away = mass.join(home, "src").filter("file <> own_file")
    total = away.groupBy("src").agg(F.sum("mass").alias("total"), F.max(F.struct(F.col("mass"), (-F.col("file")).alias("minus"))).alias("b"))
    out = total.join(home, "src")
    return out.select("src", "own", "total", (-F.col("b.minus")).alias("best_file"), F.bround(100 * F.col("b.mass") / (F.col("own") + F.col("total"))).cast("long").alias("envy"))


def plurality(members: DataFrame, community: str, file: str) -> DataFrame:
    """community, file: the file most members have, the smallest of equals."""
    counts = members.groupBy(community, file).agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(W.partitionBy(community).orderBy(F.desc("n"), file))
    return counts.withColumn("__r", first).filter("__r = 1").select(community, file, "n")


def misplaced(mass: DataFrame, home: DataFrame, communities: DataFrame, least_total: int = 3) -> DataFrame:
    """src, best_file, envy of sources that are drawn to another file than theirs.

    A source counts when its mass is least_total or more and most of its community (node, community)
    lives in another file. home as in envy().
    """
    members = communities.select(F.col("node").alias("src"), "community").join(home, "src")
    most = plurality(members, "community", "own_file").select("community", F.col("own_file").alias("most"))
    apart = members.join(most, "community").filter("most <> own_file").select("src")
    return envy(mass, home).filter(F.col("total") >= least_total).join(apart, "src", "left_semi").select("src", "best_file", "envy")


def scattered(members: DataFrame) -> DataFrame:
    """file, communities: how many communities that live in another file the members (node, file, community) of a file belong to."""
    most = plurality(members, "community", "file").select("community", F.col("file").alias("most"))
    away = members.join(most, "community").filter("most <> file")
    return away.groupBy("file").agg(F.countDistinct("community").alias("communities"))


def binding_edges(refs: DataFrame) -> DataFrame:
    """x, y: units (file, unit) that use the same definition (def), each tied to the first that does."""
    used = refs.select("file", "def", "unit").distinct()
    first = used.groupBy("file", "def").agg(F.min("unit").alias("x"))
    return used.join(first.hint("merge"), ["file", "def"]).filter("unit <> x").select("x", F.col("unit").alias("y")).distinct()


def representatives(members: DataFrame, group: str, line: str, unit: str) -> DataFrame:
    """group, unit: the member of each group with the least line, the first of equal ones."""
    return members.groupBy(group).agg(F.min(F.struct(F.col(line).alias("l"), F.col(unit).alias("u"))).alias("m")).select(group, F.col("m.u").alias(unit))


def low_cohesion(units: DataFrame, edges: DataFrame) -> DataFrame:
    """file, components: unconnected groups of units (file, unit) of each file with two or more; edges (x, y) join units of one file."""
    joined = components(edges)
    labelled = units.join(joined.hint("merge"), units["unit"] == joined["node"], "left").withColumn("component", F.coalesce("component", "unit"))
    return labelled.groupBy("file").agg(F.count(F.lit(1)).alias("units"), F.countDistinct("component").alias("components")).filter("units >= 2").select("file", "components")


def louvain(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """node, community for weighted undirected edges (x, y, w): one level of local moving in each component.

    Each round is a few joins over the edge table: what a node's edges weigh by the communities at
    their other ends, less what chance would give (the node's weight times the community's, over the
    component's), is its gain there. Of the nodes that gain elsewhere, those that a coin by hash
    picks go there (ties to the least label); the coin falls less often in later rounds, so that
    neighbours don't change places for ever. It ends when no node gains by moving, or after rounds.
    """
    tidy = edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "w").groupBy("x", "y").agg(F.sum("w").alias("w")).filter("x <> y")
    tidy = cut(tidy)
    both = cut(tidy.union(tidy.select(F.col("y").alias("x"), F.col("x").alias("y"), "w")))
    part = components(tidy)
    weighed = both.groupBy(F.col("x").alias("node")).agg(F.sum("w").alias("degree")).join(part, "node")
    whole = weighed.groupBy("component").agg(F.sum("degree").alias("whole"))
    labels = cut(weighed.join(whole, "component").select("node", "degree", "whole", F.col("node").alias("community")))
    for turn in range(rounds):
        held = labels.groupBy("community").agg(F.sum("degree").alias("held"))
        links = both.join(labels.select(F.col("node").alias("y"), "community"), "y").groupBy(F.col("x").alias("node"), "community").agg(F.sum("w").alias("inside"))
        own = labels.select("node", "community").withColumn("inside", F.lit(0.0))
        links = links.unionByName(own).groupBy("node", "community").agg(F.sum("inside").alias("inside"))
        mine = labels.select("node", "degree", "whole", F.col("community").alias("own"))
        stays = F.col("own") == F.col("community")
        seen = links.join(mine, "node").join(held, "community")
        gain = F.col("inside") - (F.col("held") - F.when(stays, F.col("degree")).otherwise(0.0)) * F.col("degree") / F.col("whole")
        best = seen.select("node", "degree", "whole", "own", "community", stays.alias("stays"), gain.alias("gain")).groupBy("node", "degree", "whole", "own").agg(
            F.max(F.when(F.col("stays"), F.col("gain"))).alias("here"), F.max(F.struct(F.round("gain", 9).alias("gain"), (-F.col("community")).alias("minus"))).alias("best")
        )
        wants = F.col("best.gain") > F.col("here") + 1e-9
        odds = 2 if turn < rounds // 2 else 4
        coin = F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(odds)) == 0
        step = best.select("node", "degree", "whole", F.when(wants & coin, -F.col("best.minus")).otherwise(F.col("own")).alias("community"), wants.alias("wants"))
        step = cut(step)
        drop(labels)
        labels = step
        if labels.filter("wants").limit(1).count() == 0:
            break
    drop(tidy, both)
    return labels.select("node", "community")
