"""Removal of repeated passages by overlapping three-line windows.

A text is split at newlines; every run of three lines that holds a word is a window. So that a
passage of a line or two is not missed, one or two lines that hold LONG_WORDS words or more are
windows as well, and a text of fewer than three lines is one window of all its lines. The first
occurrence of a window (least key, text hash, line) stays; the lines that later occurrences cover
are merged and removed. A removed line always stays at an earlier place.

Windows are compared by 128-bit hashes. First places are found with map-side minima; the places are
joined back with salts, so a window that a third of all texts share is spread out.

Defined results: a null text has no lines and stays null; windows without a word are never
removed; null keys come first; rows with the same key and text are one document and get the same
result; an empty table gives an empty result; other columns, however named, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import read_table, salt, salts

WORD = r"[^\x20\x09-\x0D]+"
LONG_WORDS = 50


def windows(rows: DataFrame) -> DataFrame:
    """__key, __th, at, len, a, b of each window; rows: __key, __th, __text."""
    lines = F.transform(F.split("__text", "\n"), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(11), x).alias("b"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    rows = rows.select("__key", "__th", lines.alias("l"))
    n = F.size("l")
    at = lambda i, k: F.get("l", i + k)

    def window(i, size: int):
        parts = [at(i, k) for k in range(size)]
        total = sum((p["w"] for p in parts[1:]), parts[0]["w"])
        whole = (i + size <= n) & (total > 0)
        if size < 3:
            whole = whole & ((total >= LONG_WORDS) | (n == size))
        return F.when(whole, F.struct(i.alias("at"), F.lit(size).alias("len"), F.xxhash64(F.lit(size), *(p["a"] for p in parts)).alias("a"), F.xxhash64(F.lit(size), *(p["b"] for p in parts)).alias("b")))

    found = F.flatten(F.transform("l", lambda _, i: F.array(*(window(i, size) for size in (1, 2, 3)))))
    return rows.select("__key", "__th", F.explode(F.array_compact(found)).alias("w")).select("__key", "__th", "w.*")


def repeats(rows: DataFrame) -> DataFrame:
    """__key, __th, spans: the (at, len) of all windows of a document that are not the first of their kind."""
    w = windows(rows)
    first = w.groupBy("a", "b").agg(F.min(F.struct("__key", "__th", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = first.select("a", "b", "first", F.explode(salts()).alias("__s"))
    w = w.withColumn("__s", salt(F.col("__key"), F.col("__th"), F.col("at")))
    later = w.join(first, ["a", "b", "__s"]).filter(~F.struct("__key", "__th", "at").eqNullSafe(F.col("first")))
    return later.groupBy("__key", "__th").agg(F.collect_set(F.struct("at", "len")).alias("spans"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """__row (all columns of docs), __lines, __removed (line counts), __clean (the text that is left)."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(key).alias("__key"), F.col(text).alias("__text"))
    rows = rows.withColumn("__th", F.xxhash64(F.coalesce("__text", F.lit(""))))
    spans = repeats(rows.select("__key", "__th", "__text"))
    spans = spans.select(F.col("__key").alias("__k"), F.col("__th").alias("__t"), F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1)))).alias("__gone"))
    out = rows.join(spans, rows["__key"].eqNullSafe(spans["__k"]) & (rows["__th"] == spans["__t"]), "left")
    out = out.withColumn("__all", F.split("__text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__all") - 1), "__gone")
    clean = F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("__all", i)), "\n"))
    return out.select(
        "__row",
        F.coalesce(F.when(F.col("__text").isNotNull(), F.size("__all")), F.lit(0)).cast("long").alias("__lines"),
        F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias("__removed"),
        clean.alias("__clean"),
    )


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated passages taken out of text; a document of which no word is left goes."""
    found = dedup(docs, key, text)
    found = found.filter((F.col("__removed") == 0) | F.col("__clean").rlike(WORD))
    keep = lambda c: F.col("__clean").alias(c) if c == text else F.length("__clean").cast("long").alias(c) if c == "n_chars" else F.col("__row")[c].alias(c)
    return found.select(*(keep(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("__row.doc_id").alias("doc_id"),
        F.col("__lines").alias("n_lines"),
        F.col("__removed").alias("n_removed"),
        F.sha2(F.encode(F.coalesce("__clean", F.lit("")), "UTF-8"), 256).alias("kept_sha256"),
    )


ORACLE = rf"""
WITH d AS (SELECT doc_id, text FROM documents),
l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS p, len(x) AS n FROM (SELECT doc_id, str_split(text, chr(10)) AS x FROM d WHERE text IS NOT NULL)),
c AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l),
s AS (SELECT *, lead(line, 1) OVER o AS l2, lead(line, 2) OVER o AS l3, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
w AS (SELECT doc_id, p, 1 AS n, line AS g FROM s WHERE w > 0 AND (w >= {LONG_WORDS} OR n = 1)
      UNION ALL SELECT doc_id, p, 2, line || chr(10) || l2 FROM s WHERE p + 2 <= n AND w + w2 > 0 AND (w + w2 >= {LONG_WORDS} OR n = 2)
      UNION ALL SELECT doc_id, p, 3, line || chr(10) || l2 || chr(10) || l3 FROM s WHERE p + 3 <= n AND w + w2 + w3 > 0),
r AS (SELECT doc_id, p, n, row_number() OVER (PARTITION BY n, g ORDER BY doc_id, p) AS k FROM w),
x AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS p FROM r WHERE k > 1),
k AS (SELECT doc_id, count(*) AS n_lines, sum((x.p IS NOT NULL)::INT) AS n_removed, string_agg(line, chr(10) ORDER BY p) FILTER (x.p IS NULL) AS kept FROM l LEFT JOIN x USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
