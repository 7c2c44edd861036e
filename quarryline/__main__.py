"""Command line: python -m quarryline [options] path..."""

from __future__ import annotations

import argparse
import os
import subprocess
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline import __version__
from quarryline.operators import code_metrics, findings, gate
from quarryline.operators.intervals import overlaps
from quarryline.settings import SettingsError, discover, top_folder
from quarryline.sources import files, python_code

PASSES = [*code_metrics.BANDS, *code_metrics.OPTIONAL_BANDS, *code_metrics.FLAGS, "duplicate", "low_cohesion", "unreferenced"]


class UsageError(ValueError):
    """Arguments that make no run."""


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise UsageError(message)


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = _Parser(prog="quarryline", description="Structural analysis of source trees.", allow_abbrev=False)
    parser.add_argument("paths", nargs="+", metavar="path")
    parser.add_argument("--base", help="only findings on lines that are changed against this commit")
    parser.add_argument("--config", help="read this file in place of the tree's settings")
    parser.add_argument("--no-config", action="store_true", help="built-in settings only")
    parser.add_argument("--cut", type=float, help="percentile from which a value is reported")
    parser.add_argument("--format", choices=("text", "github"), default="text")
    parser.add_argument("--check", action="store_true", help="report the high floor only, and exit with 1 if there is any of it")
    parser.add_argument("--version", action="version", version=f"quarryline {__version__}")
    given = parser.parse_args(argv)
    if given.config and given.no_config:
        raise UsageError("--config and --no-config exclude each other")
    for path in given.paths:
        if not os.path.exists(path):
            raise UsageError(f"no such path: {path}")
        if os.path.isfile(path) and path.rpartition(".")[2].lower() not in files.LANGUAGES:
            raise UsageError(f"no language for {path}")
    return given


def _folder(path: str) -> tuple[str, str]:
    """The folder that a given path is or is in, and how names of files in it begin."""
    folder = os.path.normpath(path if os.path.isdir(path) else os.path.dirname(path) or ".")
    return folder, "" if folder == "." else folder.rstrip("/") + "/"


def sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file (the path given and what is below it), lang, source; a file that several paths hold comes once."""
    out = None
    for path in paths:
        folder, prefix = _folder(path)
        found = files.read_sources(spark, "file://" + os.path.abspath(folder))
        if not os.path.isdir(path):
            found = found.filter(F.col("file") == os.path.basename(path))
        found = found.withColumn("file", F.concat(F.lit(prefix), "file"))
        out = found if out is None else out.unionByName(found)
    return out.dropDuplicates(["file"])


def changed(spark: SparkSession, found: DataFrame, nodes: DataFrame, base: str, paths: list[str]) -> DataFrame:
    """Findings whose line, or one of whose function's lines, is changed since base, in the work tree of the first path."""
    top = top_folder(paths[0])
    diff = subprocess.run(["git", "-C", str(top), "diff", "--no-color", "--no-ext-diff", "-U0", base, "--"], capture_output=True, text=True)
    if diff.returncode:
        raise UsageError(diff.stderr.strip() or f"no diff against {base}")
    ranges = set()
    for folder, prefix in map(_folder, paths):
        for name, a, b in files.changed_lines(diff.stdout):
            ranges.add((prefix + os.path.relpath(os.path.realpath(top / name), os.path.realpath(folder)), a, b))
    ends = code_metrics.units(nodes).groupBy("file", "line", F.col("name").alias("unit")).agg(F.max("end_row").alias("__end"))
    spans = found.join(ends, ["file", "line", "unit"], "left").withColumn("__end", F.coalesce("__end", "line"))
    return overlaps(spans, spark.createDataFrame(sorted(ranges), "file string, r_lo int, r_hi int"), "file", "line", "__end").drop("__end")


def lines(found: DataFrame, form: str) -> DataFrame:
    rank = F.when(F.col("percentile").isNotNull(), F.concat(F.lit("; p"), F.bround(100 * F.col("percentile")).cast("int").cast("string"))).otherwise("")
    value = F.coalesce(F.concat(F.lit(" "), F.col("value").cast("string")), F.lit(""))
    told = F.concat(F.col("metric"), value, F.lit(" ("), "absolute", rank, F.lit(")"))
    if form == "github":
        return found.select(findings.annotation(F.col("file"), F.col("line"), F.col("metric"), F.concat_ws(" ", F.nullif("unit", F.lit("")), told), F.col("absolute")).alias("text"))
    return found.select(F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit("  "), "unit", F.lit("  "), told).alias("text"))


def run(given: argparse.Namespace) -> int:
    settings = discover(given.paths, given.config, not given.no_config)
    spark = SparkSession.builder.appName("quarryline").getOrCreate()
    nodes = python_code.nodes(sources(spark, given.paths))
    cut = settings.cut if given.cut is None else given.cut
    found = code_metrics.analyze(nodes, cut, bands=settings.bands, rules=settings.rules, clone_size=int(settings.clones["min_size"]))
    if given.base:
        found = changed(spark, found, nodes, given.base, given.paths)
    found = gate.errors(found, None, [], []) if given.check else gate.unsuppressed(found)
    many = 0
    for row in lines(gate.ordered(found, PASSES), given.format).toLocalIterator():
        many += 1
        print(row.text)
    if not many and given.format == "text":
        print("No findings.")
    return int(given.check and many > 0)


def main(argv: list[str]) -> int:
    try:
        return run(arguments(argv))
    except (UsageError, SettingsError) as e:
        print(f"quarryline: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
