"""Licence scans: TF-IDF cosine to templates, and inheritance along paths. Built-in expressions only.

The passages of a file are all its lines with a term, all runs of such lines that follow each other
(of no more lines than the longest short notice has terms, and twice its terms), its paragraphs
(lines without a term, as bare comment marks, part them; copyright lines are left out) and its whole
text. The SQL knows only the first HEADER_LINES lines and the last one: it gives the same rows where
notices stand there. Terms are runs of letters and digits, folded; only terms of the templates have
weight in a dot product, all others lengthen the passage's vector as a term that one file holds.
Document frequencies are counted over all files. The best template of a passage with a cosine of
LEAST_COSINE or more is declared; ties go to the first name. A file with a declaration is a licence
file by its name, or when the matched passage has NOTICE_SHARE of its terms.

A file without a declaration takes that of the licence file in its nearest ancestor directory: every
path is joined with its ancestors, the deepest match wins. Licence files of a directory that declare
different licences give the first by name.

Defined results: a null text declares nothing, but may inherit; a null path neither gives nor takes;
repeated rows each get a row; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import collections
import functools
import math
import operator
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import materialize, read_table, salt, salts
from quarryline.llm.license_texts import TEXTS

# Short notices, and the licences that they name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Each with its own vocabulary, so that the weights of one don't depend on the others.
SPACES = [list(TEMPLATES.items()), TEXTS]
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"
HEADER_LINES = 3
LEAST_COSINE = 0.8
NOTICE_SHARE = 0.5
WORD = r"[^\x20\x09-\x0D]"
BREAK = r"[^a-z0-9]+"
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(?:copyright|c\)|all rights reserved|spdx-)[^\n]*$"
PARAGRAPH = r"\n[^a-z0-9]*\n"


def _terms(text: str) -> list[str]:
    return [x for x in re.split(BREAK, text.lower()) if x]


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BREAK), "")


def vocabulary() -> list[str]:
    return sorted({t for templates in SPACES for _, x in templates for t in _terms(x)})


def _map(values: dict) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v))))


def weights(files: DataFrame, text: str) -> tuple[dict[str, float], float]:
    """Inverse document frequency of each term of the templates over all files, and of a term that one file holds."""
    known = F.array(*map(F.lit, vocabulary()))
    held = files.select(F.array_append(F.array_intersect(terms(F.coalesce(text, F.lit(""))), known), F.lit("")).alias("t"))
    df = {r[0]: r[1] for r in held.select(F.explode("t").alias("t")).groupBy("t").count().collect()}  # a row a term
    n = df.get("", 0)
    idf = lambda d: math.log((n + 1) / (d + 1)) + 1
    return {t: idf(df.get(t, 0)) for t in vocabulary()}, idf(1)


def _counts(ordered: Column, distinct: Column) -> Column:
    """How often each of the distinct values stands in the ordered array."""
    ends = lambda i: F.when(i + 1 < F.size(distinct), F.array_position(ordered, F.get(distinct, i + 1))).otherwise(F.size(ordered) + 1)
    return F.transform(distinct, lambda t, i: ends(i) - F.array_position(ordered, t))


class _Space:
    """Templates with a vocabulary of their own; terms outside of it weigh as one that one file holds."""

    def __init__(self, templates: list[tuple[str, str]], idf: dict[str, float], rare: float):
        self.rare = rare
        self.terms = sorted({t for _, x in templates for t in _terms(x)})
        self.known = F.array(*map(F.lit, self.terms))
        self.idf = _map({t: idf[t] for t in self.terms})
        self.parts = []
        for name, template in templates:
            mine = collections.Counter(_terms(template))
            squares = {t: (c * idf[t]) ** 2 for t, c in sorted(mine.items())}
            length = math.sqrt(sum(squares.values()))
            by = _map({t: c * idf[t] * idf[t] for t, c in mine.items()})
            self.parts.append((name, squares, length, by))

    def anchors(self) -> set[str]:
        """Terms of which any passage that is alike holds one: of each template, all but what falls short."""
        out = set()
        for _, squares, length, _ in self.parts:
            left = length**2
            for t in sorted(squares, key=lambda t: (-squares[t], t)):
                if left < LEAST_COSINE**2 * length**2 - 1e-6:
                    break
                out.add(t)
                left -= squares[t]
        return out

    def near(self, values: Column) -> Column:
        """Whether the values can be alike: a cosine is at most the share that the held terms have of a template's length."""
        held = lambda squares: F.aggregate(F.array_intersect(F.array(*map(F.lit, squares)), values), F.lit(0.0), lambda a, t: a + _map(squares)[t])
        return functools.reduce(operator.or_, (held(squares) >= LEAST_COSINE**2 * length**2 - 1e-6 for _, squares, length, _ in self.parts))

    def best(self, passages: Column) -> Column:
        """minus (the cosine), licence and size of the passages for the templates that are most alike.

        Step by step, so that nothing is worked out twice; few passages reach the last one.
        """
        split = lambda x: F.struct(
            F.size(x).alias("size"),
            F.array_sort(F.filter(x, lambda t: F.array_contains(self.known, t))).alias("own"),
            F.array_sort(F.filter(x, lambda t: ~F.array_contains(self.known, t))).alias("foreign"),
        )
        distinct = lambda p: F.struct(p["size"], p["own"], p["foreign"], F.array_distinct(p["own"]).alias("terms"))
        counted = lambda p: F.struct(p["size"], p["foreign"], F.map_from_arrays(p["terms"], _counts(p["own"], p["terms"])).alias("n"))
        out = F.transform(F.filter(passages, self.near), split)
        out = F.transform(F.transform(out, distinct), counted)
        inside = lambda n: F.aggregate(F.map_entries(n), F.lit(0.0), lambda a, e: a + F.pow(e["value"] * self.idf[e["key"]], F.lit(2.0)))
        dot = lambda n, by: F.aggregate(F.map_entries(n), F.lit(0.0), lambda a, e: a + e["value"] * F.coalesce(by[e["key"]], F.lit(0.0)))
        dots = lambda n: F.array(*(dot(n, by) / length for _, _, length, by in self.parts))
        out = F.transform(out, lambda p: F.struct(p["size"], p["foreign"], inside(p["n"]).alias("inside"), dots(p["n"]).alias("dots")))
        # each other term weighs at least as much as if all were different
        out = F.filter(out, lambda p: F.array_max(p["dots"]) >= (LEAST_COSINE - 1e-4) * F.sqrt(p["inside"] + F.size(p["foreign"]) * self.rare**2))
        out = F.transform(out, lambda p: F.struct(p["size"], p["foreign"], p["inside"], p["dots"], F.array_distinct(p["foreign"]).alias("terms")))
        others = lambda p: F.aggregate(_counts(p["foreign"], p["terms"]), F.lit(0.0), lambda a, c: a + F.pow(c * F.lit(self.rare), F.lit(2.0)))
        out = F.transform(out, lambda p: F.struct(p["size"], p["dots"], F.sqrt(p["inside"] + others(p)).alias("norm")))
        found = lambda p: F.array_min(F.array(*(F.struct((-F.round(p["dots"][k] / p["norm"], 4)).alias("minus"), F.lit(name).alias("licence"), p["size"].alias("size")) for k, (name, *_) in enumerate(self.parts))))
        return F.transform(out, found)


def _passages(text: Column) -> tuple[Column, Column]:
    """The term lists of a text's lines (to be __lines), and of these, runs of them, paragraphs and the text itself."""
    most = max(len(_terms(x)) for x in TEMPLATES.values())
    known = F.array(*map(F.lit, sorted({t for x in TEMPLATES.values() for t in _terms(x)})))
    lines = F.filter(F.transform(F.split(text, "\n"), terms), lambda x: F.size(x) > 0)
    # the best run begins and ends with a line that holds a term of a notice: another one only lengthens it
    runs = lambda x, i: F.when(
        F.arrays_overlap(x, known),
        F.transform(F.sequence(F.lit(2), F.lit(most)), lambda k: F.flatten(F.slice(F.col("__lines"), i + 1, k))),
    ).otherwise(F.array().cast("array<array<string>>"))
    short = F.filter(F.flatten(F.transform("__lines", runs)), lambda x: F.size(x) <= 2 * most)
    paragraphs = F.transform(F.split(F.regexp_replace(F.lower(text), COPYRIGHT, ""), PARAGRAPH), terms)
    return lines, F.concat("__lines", short, paragraphs, F.array(terms(text)))


def declarations(files: DataFrame) -> DataFrame:
    """files (__id, __path, __text) with __declared, __cosine and __notice (it is a licence file); a row per row."""
    idf, rare = weights(files, "__text")
    spaces = [_Space(x, idf, rare) for x in SPACES]
    text = F.coalesce("__text", F.lit(""))
    files = files.withColumn("__named", F.coalesce(F.element_at(F.split("__path", "/"), -1).rlike(LICENCE_FILE), F.lit(False)))
    # a passage that is alike makes its whole text hold an anchor, and most of a template
    anchors = F.array(*map(F.lit, sorted(set().union(*(x.anchors() for x in spaces)))))
    files = files.withColumn("__held", F.array_intersect(terms(text), F.array(*map(F.lit, vocabulary()))))
    near = functools.reduce(operator.or_, (x.near(F.col("__held")) for x in spaces))
    files = files.withColumn("__near", F.when(F.arrays_overlap("__held", anchors), near).otherwise(F.lit(False))).drop("__held")
    lines, passages = _passages(text)
    nothing = F.array().cast("array<array<string>>")
    files = files.withColumn("__lines", F.when(F.col("__near"), lines).otherwise(nothing))
    files = files.withColumn("__p", F.when(F.col("__near"), passages).otherwise(nothing))
    found = F.concat(*(x.best(F.col("__p")) for x in spaces))
    files = files.withColumn("__best", F.array_min(F.filter(found, lambda b: b["minus"] <= -LEAST_COSINE)))
    words = F.when(F.col("__best").isNotNull(), F.size(terms(text)))
    return files.select(
        "__id",
        "__path",
        F.col("__best.licence").alias("__declared"),
        (-F.col("__best.minus")).alias("__cosine"),
        F.coalesce(F.col("__best").isNotNull() & (F.col("__named") | (F.col("__best.size") >= NOTICE_SHARE * words)), F.lit(False)).alias("__notice"),
    )


def _parent(path: Column) -> Column:
    """The directory of a path: "" at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def scan(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """key, declared, cosine, licence (declared or inherited), inherited_from (a directory), per row."""
    rows = files.select(F.col(key).alias("__id"), F.col(path).alias("__path"), F.col(text).alias("__text"))
    rows = materialize(declarations(rows).withColumn("__dir", _parent(F.col("__path"))), "licences")
    notices = rows.filter(F.col("__notice") & F.col("__dir").isNotNull()).groupBy(F.col("__dir").alias("__above")).agg(F.min("__declared").alias("__given"))
    # every directory is joined with its ancestors, itself included; the deepest with a licence file counts
    folders = rows.filter(F.col("__declared").isNull() & F.col("__dir").isNotNull()).select("__dir").distinct()
    steps = F.split("__dir", "/")
    above = F.concat(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/")), F.array(F.lit("")))
    up = folders.select("__dir", F.explode(F.array_distinct(above)).alias("__above")).join(notices, "__above")
    near = up.groupBy("__dir").agg(F.max_by(F.struct("__above", "__given"), F.length("__above")).alias("__near"))
    near = near.select(F.col("__dir").alias("__of"), "__near", F.explode(salts()).alias("__s"))
    rows = rows.withColumn("__salt", salt(F.col("__id"), F.col("__path")))
    out = rows.join(near, (rows["__dir"] == near["__of"]) & (rows["__salt"] == near["__s"]) & rows["__declared"].isNull(), "left")
    return out.select(
        F.col("__id").alias(key),
        F.col("__declared").alias("declared"),
        F.col("__cosine").alias("cosine"),
        F.coalesce("__declared", "__near.__given").alias("licence"),
        F.col("__near.__above").alias("inherited_from"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: a source is a top directory, a language one below it."""
    docs = read_table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", path.alias("path"), "text"), "doc_id", "path", "text")


def _sql() -> str:
    rows = ", ".join(f"('{n}', '{t}')" for n, t in TEMPLATES.items())
    return f"""
WITH templates(licence, t) AS (VALUES {rows}),
d AS (SELECT doc_id, coalesce(source, '-') || '/' || coalesce(lang, '-') AS dir, coalesce(text, '') AS t FROM documents),
tt AS (SELECT licence, term, count(*) AS c FROM (SELECT licence, unnest(regexp_split_to_array(lower(t), '[^a-z0-9]+')) AS term FROM templates) WHERE term <> '' GROUP BY ALL),
known AS (SELECT DISTINCT term FROM tt),
n AS (SELECT count(*) AS n FROM d),
df AS (SELECT term, count(*) AS c FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(t), '[^a-z0-9]+')) AS term FROM d) JOIN known USING (term) GROUP BY term),
idf AS (SELECT term, ln((n + 1) / (coalesce(c, 0) + 1)) + 1 AS w FROM known LEFT JOIN df USING (term), n),
l AS (SELECT doc_id, list_filter(str_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS x FROM d),
p AS (SELECT DISTINCT doc_id, unnest(list_distinct(x[1:{HEADER_LINES}] || x[len(x):len(x)])) AS line FROM l),
pt AS (SELECT doc_id, line, term, count(*) AS c FROM (SELECT doc_id, line, unnest(regexp_split_to_array(lower(line), '[^a-z0-9]+')) AS term FROM p) WHERE term <> '' GROUP BY ALL),
pw AS (SELECT doc_id, line, term, c, coalesce(w, ln((n + 1) / 2) + 1) AS w FROM pt LEFT JOIN idf USING (term), n),
pn AS (SELECT doc_id, line, sqrt(sum(pow(c * w, 2))) AS norm, sum(c) AS size FROM pw GROUP BY doc_id, line),
tn AS (SELECT licence, sqrt(sum(pow(c * w, 2))) AS norm FROM tt JOIN idf USING (term) GROUP BY licence),
dots AS (SELECT doc_id, line, licence, sum(pw.c * pw.w * tt.c * pw.w) AS dot FROM pw JOIN tt USING (term) GROUP BY doc_id, line, licence),
cs AS (SELECT doc_id, licence, round(dot / (pn.norm * tn.norm), 4) AS cosine, size FROM dots JOIN pn USING (doc_id, line) JOIN tn USING (licence)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, licence, size) AS k FROM cs WHERE cosine >= {LEAST_COSINE}) WHERE k = 1),
s AS (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda x: x <> '')) AS words FROM d),
f AS (SELECT d.doc_id, d.dir, best.licence AS declared, cosine, best.licence IS NOT NULL AND size >= {NOTICE_SHARE} * words AS notice FROM d LEFT JOIN best USING (doc_id) JOIN s USING (doc_id)),
g AS (SELECT dir AS above, min(declared) AS given FROM f WHERE notice GROUP BY dir),
o AS (SELECT DISTINCT dir FROM f),
u AS (SELECT dir, above, given, row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) AS k FROM o JOIN g ON dir = above OR starts_with(dir, above || '/') OR above = '')
SELECT doc_id, declared, cosine, coalesce(declared, given) AS licence, CASE WHEN declared IS NULL THEN above END AS inherited_from
FROM f LEFT JOIN (SELECT * FROM u WHERE k = 1) USING (dir)
"""


ORACLE = _sql()
