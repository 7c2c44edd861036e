"""Suppression, ratchet, ignore patterns and the text forms of findings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def suppressed(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """findings (file, line, metric, ...) with suppressed: a directive for the whole file (null line), the
    same line or the line above covers the metric (null: all)."""
    named = findings.withColumn("__id", F.monotonically_increasing_id())
    d = directives.select(F.col("file").alias("__f"), F.col("line").cast("long").alias("__l"), F.col("metric").alias("__m")).distinct()
    # each finding asks for all (line, metric) keys that would cover it, so the join has equal keys only
    lines = F.array(F.col("line").cast("long"), F.col("line").cast("long") - 1, F.lit(None).cast("long"))
    keys = F.array_distinct(F.flatten(F.transform(lines, lambda x: F.array(F.struct(x.alias("l"), F.col("metric").alias("m")), F.struct(x.alias("l"), F.lit(None).cast("string").alias("m"))))))
    asked = named.withColumn("__k", F.explode(keys))
    hit = (asked["file"] == d["__f"]) & asked["__k.l"].eqNullSafe(d["__l"]) & asked["__k.m"].eqNullSafe(d["__m"])
    marked = asked.join(d, hit, "left").groupBy("__id", *findings.columns).agg(F.max(F.col("__f").isNotNull()).alias("suppressed"))
    return marked.drop("__id")


def ratchet(head: DataFrame, base: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of head beyond as many of their key as base has; the later ones count as new."""
    known = base.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    numbered = head.withColumn("__k", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    return numbered.join(known, key, "left").filter(F.col("__k") > F.coalesce("__n", F.lit(0))).select(*head.columns)


def glob_regex(pattern: str) -> tuple[bool, bool, str]:
    """(negated, only directories, regex) of an ignore pattern.

    "*" and "?" stay inside a name, "**" spans names; a slash at the front or inside ties the
    pattern to the root, else it holds for a name at any depth.
    """
    negated = pattern.startswith("!")
    pattern = pattern[negated:]
    folder = pattern.endswith("/")
    pattern = pattern.rstrip("/")
    tied = "/" in pattern
    out = "".join(
        {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p) or re.escape(p)
        for p in re.findall(r"\*\*/|/\*\*$|\*\*|.", pattern.lstrip("/"))
    )
    return negated, folder, ("^" if tied else "(?:^|.*/)") + out + "$"


def ignored(path: Column, patterns: list[str], folder: Column | None = None) -> Column:
    """Whether the last pattern that fits a path leaves it out."""
    verdict = F.lit(False)
    for p in patterns:
        if not p.strip() or p.startswith("#"):
            continue
        negated, only_folders, regex = glob_regex(p.strip())
        fits = path.rlike(regex)
        if only_folders:
            fits = fits & (folder if folder is not None else F.lit(False))
        verdict = F.when(fits, F.lit(not negated)).otherwise(verdict)
    return verdict


def report_line(file: Column, line: Column, unit: Column, metric: Column, value: Column, band: Column, percentile: Column) -> Column:
    """file:line  unit  metric value (band; pNN)"""
    rank = F.when(percentile.isNotNull(), F.concat(F.lit("; p"), F.bround(100 * percentile).cast("int").cast("string"))).otherwise("")
    return F.concat(file, F.lit(":"), line.cast("string"), F.lit("  "), unit, F.lit("  "), metric, F.lit(" "), value.cast("string"), F.lit(" ("), band, rank, F.lit(")"))


def _escaped(text: Column, more: bool) -> Column:
    pairs = [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")] + ([(":", "%3A"), (",", "%2C")] if more else [])
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def annotation(file: Column, line: Column, title: Column, message: Column, band: Column) -> Column:
    """A workflow command: an error for a high band, else a warning."""
    kind = F.when(band == "high", "error").otherwise("warning")
    return F.concat(F.lit("::"), kind, F.lit(" file="), _escaped(file, True), F.lit(",line="), line.cast("string"), F.lit(",title="), _escaped(title, True), F.lit("::"), _escaped(message, False))


def flow_edge(x: Column, y: Column, weight: Column) -> Column:
    """An edge of a flowchart, with its weight to one decimal."""
    return F.concat(F.lit("    "), x, F.lit(" -- "), F.format_string("%.1f", weight), F.lit(" --> "), y)
