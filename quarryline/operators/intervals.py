"""Joins of positions with nested intervals.

A span is filed in bins of its own order of size (powers of 16, LEVELS of them): it touches two of
them at most. A position looks into the one bin of each order that it lies in, of those orders that
some span has. So joins have the equal keys (file, order, bin), and a file with very many spans is no
product. They are told to merge: what a table weighs in its file, or in a shuffle, says little of what
it takes in the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Orders of size: spans are shorter than 16 ** (LEVELS - 1).
LEVELS = 13


def _binned_points(points: DataFrame, levels: DataFrame, lo: str) -> DataFrame:
    points = points.crossJoin(F.broadcast(levels)).withColumn("__level", F.explode("__levels")).drop("__levels")  # levels: one row
    return points.withColumn("__bin", F.expr(f"shiftright(cast(`{lo}` as bigint), 4 * __level)"))


def _level():
    size = F.ceil(F.log2(F.greatest(F.col("s_hi") - F.col("s_lo"), F.lit(0)) + 1) / 4).cast("int")
    return F.least(size, F.lit(LEVELS - 1))


def _binned_spans(spans: DataFrame) -> DataFrame:
    spans = spans.withColumn("__level", _level())
    ends = F.expr("sequence(shiftright(cast(s_lo as bigint), 4 * __level), shiftright(cast(greatest(s_lo, s_hi) as bigint), 4 * __level))")
    return spans.withColumn("__bin", F.explode(ends))


def containing(points: DataFrame, spans: DataFrame, file: str, lo: str, hi: str, also: tuple[str, ...] = ()) -> DataFrame:
    """points joined with all spans (file, s_id, s_lo, s_hi) that contain [lo, hi] and agree in the columns of also."""
    levels = spans.agg(F.collect_set(_level()).alias("__levels"))
    p, s = _binned_points(points, levels, lo), _binned_spans(spans)
    inside = p.join(s.hint("merge"), [file, *also, "__level", "__bin"])
    return inside.filter((F.col("s_lo") <= F.col(lo)) & (F.col(hi) <= F.col("s_hi"))).drop("__level", "__bin")


def innermost(points: DataFrame, spans: DataFrame, file: str, key: str, lo: str, hi: str) -> DataFrame:
    """key and unit: the smallest span that contains the point, the first of equal ones, 0 if none does."""
    inside = containing(points, spans, file, lo, hi)
    best = inside.groupBy(key).agg(F.min(F.struct((F.col("s_hi") - F.col("s_lo")).alias("w"), F.col("s_id").alias("id"))).alias("b"))
    return points.select(key).join(best.select(key, "b.id").hint("merge"), key, "left").select(key, F.coalesce("id", F.lit(0)).alias("unit"))


def owning(defs: DataFrame, scopes: DataFrame, file: str, key: str, lo: str, hi: str, hoisted: str) -> DataFrame:
    """key and scope: the smallest span around a definition; of a hoisted one the smallest that is larger than that."""
    inside = containing(defs, scopes, file, lo, hi).withColumn("__w", F.col("s_hi") - F.col("s_lo"))
    sized = inside.withColumn("__r", F.dense_rank().over(W.partitionBy(key).orderBy("__w")))
    sized = sized.withColumn("__most", F.max("__r").over(W.partitionBy(key)))
    want = F.when(F.col(hoisted), F.least(F.lit(2), F.col("__most"))).otherwise(F.lit(1))
    return sized.filter(F.col("__r") == want).groupBy(key).agg(F.min("s_id").alias("scope"))


def nearest_definition(refs: DataFrame, defs: DataFrame, file: str, name: str, key: str, lo: str, hi: str) -> DataFrame:
    """key and def: for a reference, the definition (d_id) of its name in the nearest scope (s_lo, s_hi) around it.

    Of several definitions in a scope the first counts; references without one are left out.
    """
    first = defs.groupBy(file, name, "s_id", "s_lo", "s_hi").agg(F.min("d_id").alias("d_id"))
    found = containing(refs, first, file, lo, hi, (name,)).groupBy(key).agg(F.min(F.struct((F.col("s_hi") - F.col("s_lo")).alias("w"), F.col("s_id"), F.col("d_id"))).alias("b"))
    return found.select(key, F.col("b.d_id").alias("def"))


def coalesce_ranges(df: DataFrame, parts: list[str], at: str) -> DataFrame:
    """Runs of consecutive numbers: parts, lo, hi."""
    w = W.partitionBy(*parts).orderBy(at)
    numbered = df.select(*parts, at).distinct().withColumn("__g", F.col(at) - F.row_number().over(w))
    return numbered.groupBy(*parts, "__g").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).drop("__g")


def overlaps(df: DataFrame, ranges: DataFrame, file: str, lo: str, hi: str) -> DataFrame:
    """Rows of df whose [lo, hi] meets one of ranges (file, r_lo, r_hi)."""
    r = ranges.withColumnRenamed(file, "__f")
    return df.join(r, (df[file] == r["__f"]) & (r["r_lo"] <= df[hi]) & (df[lo] <= r["r_hi"]), "left_semi")


def running_flag(flag: Column, part: list[str], order: list[str]) -> Column:
    """Whether the flag was set in a row before."""
    return F.coalesce(F.max(flag.cast("int")).over(W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 1
