"""Exact and near clones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: elements of a sequence that are compared.
CAP = 400


def exact_clusters(units: DataFrame, lang: str, digest: str, key: str) -> DataFrame:
    """lang, digest, members, first: digests that two units or more have."""
    return units.groupBy(lang, digest).agg(F.count(F.lit(1)).alias("members"), F.min(key).alias("first")).filter("members >= 2")


def maximal(anchors: DataFrame, buckets: DataFrame, parent: str, digest: str) -> DataFrame:
    """Anchors whose nearest anchor above is in a smaller bucket or in none."""
    sizes = buckets.select(F.col(digest).alias("__d"), F.col("members").alias("__m"))
    own = anchors.join(sizes, anchors[digest] == sizes["__d"]).drop("__d").withColumnRenamed("__m", "__own")
    above = buckets.select(F.col(digest).alias("__p"), F.col("members").alias("__up"))
    joined = own.join(above, own[parent] == above["__p"], "left")
    return joined.filter(F.col("__up").isNull() | (F.col("__up") < F.col("__own"))).drop("__own", "__up", "__p")


def candidates(units: DataFrame, histogram: DataFrame, lang: str, key: str, digest: str, radius: float = 0.5) -> DataFrame:
    """lang, x, y, distance: units of like size whose histograms differ by a bounded number of nodes.

    units: lang, key, digest, size; histogram: key, type, n. Sizes are compared in bands of powers of
    two (equal or next), the distance is size + size - 2 * overlap. Only units of one digest's class
    are paired once: representatives go in, so copies make no pairs.
    """
    first = units.groupBy(lang, digest, "size").agg(F.min(key).alias(key)).withColumn("band", F.floor(F.log2("size")).cast("int"))
    near = first.select(lang, F.col(key).alias("y"), F.col("size").alias("sy"), F.explode(F.array(F.col("band"), F.col("band") - 1, F.col("band") + 1)).alias("band"), F.col("band").alias("by"))
    pairs = first.select(lang, F.col(key).alias("x"), F.col("size").alias("sx"), "band", F.col("band").alias("bx")).join(near, [lang, "band"]).filter("x < y")
    limit = radius * F.pow(F.lit(2.0), F.least("bx", "by") + 1)
    pairs = pairs.filter(F.abs(F.col("sx") - F.col("sy")) <= limit).withColumn("__limit", limit)
    hx = histogram.select(F.col(key).alias("x"), "type", F.col("n").alias("nx"))
    hy = histogram.select(F.col(key).alias("y"), "type", F.col("n").alias("ny"))
    shared = pairs.join(hx, "x").join(hy, ["y", "type"]).groupBy(lang, "x", "y", "sx", "sy", "__limit").agg(F.sum(F.least("nx", "ny")).alias("o"))
    out = shared.withColumn("distance", F.col("sx") + F.col("sy") - 2 * F.col("o"))
    return out.filter(F.col("distance") <= F.col("__limit")).select(lang, "x", "y", "distance")


def members(units: DataFrame, clusters: DataFrame, lang: str, key: str, digest: str) -> DataFrame:
    """key, representative, component: a row for every unit; clusters (node, component) hold representatives."""
    first = units.groupBy(lang, digest).agg(F.min(key).alias("representative"))
    first = first.join(clusters, first["representative"] == clusters["node"], "left").withColumn("component", F.coalesce("component", "representative"))
    return units.join(first, [lang, digest]).select(key, "representative", "component")


def weakest(pairs: DataFrame, clusters: DataFrame, score: str) -> DataFrame:
    """component, value: 100 times the least score among the pairs (x, y, score) of each cluster (node, component)."""
    inside = pairs.join(clusters.select(F.col("node").alias("x"), "component"), "x")
    return inside.groupBy("component").agg(F.bround(100 * F.min(score)).cast("long").alias("value"))


def unreported(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """pairs (x, y, ...) that known (x, y) doesn't have in either order."""
    told = known.select(F.least("x", "y").alias("__a"), F.greatest("x", "y").alias("__b")).distinct()
    return pairs.join(told, (F.least("x", "y") == F.col("__a")) & (F.greatest("x", "y") == F.col("__b")), "left_anti")


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row of the table at a time."""
    row = np.zeros(len(b) + 1, np.int64)
    for v in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], (row[:-1] + 1) * (b == v)))
    return int(row[-1]) if len(b) else 0


def similarity(a: Column, b: Column, cap: int = CAP) -> Column:
    """Common subsequence over the longer one's length, both cut at cap; 0 for an empty one."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([lcs_length(np.asarray(p), np.asarray(q)) / max(len(p), len(q), 1) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(F.slice(a, F.lit(1), F.lit(cap)), F.slice(b, F.lit(1), F.lit(cap)))
