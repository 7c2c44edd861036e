"""Source files as a table, languages by extension, and changed lines of a diff."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.findings import ignored

# Extensions (lower case) and their languages.
LANGUAGES = {
    "bash": "bash", "sh": "bash", "zsh": "bash", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "go": "go", "java": "java", "js": "javascript",
    "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "jl": "julia", "php": "php", "py": "python", "rb": "ruby", "rs": "rust", "ts": "typescript", "tsx": "typescript",
}


def language(path):
    """Language of a path by its extension; null if there is none for it."""
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return known[F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))]


def read_sources(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """file (below root), lang, source: all files of a known language, but for dot folders and ignored paths.

    Paths are listed without content; only the files that stay are opened, in the tasks that their
    paths are dealt to.
    """
    base = root.rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path", "length")
    file = F.regexp_replace(F.col("path"), "^.*?" + re.escape(re.sub("^[a-z]+:/*", "/", base)) + "/", "")
    listed = listed.withColumn("file", file).withColumn("lang", language(F.col("file")))
    listed = listed.filter(F.col("lang").isNotNull() & ~F.col("file").rlike(r"(^|/)\.[^/]+/") & ~ignored(F.col("file"), patterns or []))
    paths = [r["path"] for r in listed.select("path").distinct().collect()]  # names only, as the driver lists them anyway
    if not paths:
        return listed.select("file", "lang", F.lit("").alias("source"))
    found = spark.read.format("binaryFile").load(paths).withColumn("file", file).withColumn("lang", language(F.col("file")))
    return found.select("file", "lang", F.decode("content", "UTF-8").alias("source"))


_HUNK = re.compile(r"@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def changed_lines(diff: str) -> list[tuple[str, int, int]]:
    """(file, first, last) runs of added or changed lines, on the new side of a unified diff.

    The diff is split at its hunks (no line of a body begins with "@"). Running counts of a body's
    old and new lines tell where it ends and number its added lines; names are looked for between.
    """
    lines = diff.split("\n")
    found: list[tuple[str, int]] = []
    name, after = "", 0
    for at in (k for k, x in enumerate(lines) if _HUNK.match(x)):
        old, first, new = (int(x) if x else 1 for x in _HUNK.match(lines[at]).groups())
        name = next((x[4:].split("\t")[0] for x in reversed(lines[after:at]) if x.startswith("+++ ")), name)
        body = [x[:1] or " " for x in lines[at + 1 : at + 3 + old + new]]
        olds = list(itertools.accumulate(c in " -" for c in body))
        news = list(itertools.accumulate(c in " +" for c in body))
        size = next((k + 1 for k in range(len(body)) if olds[k] >= old and news[k] >= new), len(body)) if old or new else 0
        after = at + 1 + size
        if name and name != "/dev/null":
            found += [(name.removeprefix("b/"), first + news[k] - 1) for k in range(size) if body[k] == "+"]
    runs = itertools.groupby(enumerate(found), key=lambda x: (x[1][0], x[1][1] - x[0]))
    spans = [[line for _, (_, line) in run] for _, run in ((key, list(run)) for key, run in runs)]
    names = [key[0] for key, _ in itertools.groupby(enumerate(found), key=lambda x: (x[1][0], x[1][1] - x[0]))]
    return [(file, span[0], span[-1]) for file, span in zip(names, spans, strict=True)]
