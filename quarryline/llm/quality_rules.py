"""Host-level quality rules, on built-in expressions only.

Each text is measured once; rule failures are added up by host; each host's failure rates are
shrunk towards the corpus by an empirical beta prior; hosts whose shrunk rate of any rule is over
``host_limit`` are rejected and that verdict is joined back to their documents.

Defined results: a null text has no words (all measures 0, base_failed); a null host is no host,
so only the document's own rules decide; repeated rows each get their own row; an empty table
gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import materialize, salt, salts

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: A host is rejected when the shrunk failure rate of a rule is over this.
HOST_LIMIT = 0.5
#: Least and greatest weight of the prior, in documents.
PRIOR_LEAST, PRIOR_MOST = 2.0, 1e6
RULES = ("short", "repeat", "symbol", "dup_line")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with __words, __chars, __symbols, __dup_lines and __repeat (all long) added.

    Each step is a projection of its own, so that an array that is looked at by position is made
    once for a row. Repeated windows are found by sorting (hash, position): n log n in a text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    first = df.columns
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    # only the first and the last part of a split by spaces can be empty
    df = df.select(*first, F.array_remove(F.split(t, SPACE), "").alias("__split"), lines.alias("__lines"))
    df = df.withColumn("__hashes", F.transform("__split", lambda w: F.xxhash64(w)))
    h = F.col("__hashes")
    windows = F.when(
        F.size(h) >= 5,
        F.transform(F.slice(h, F.lit(1), F.size(h) - 4), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, 5)))),
    ).otherwise(F.array().cast("array<long>"))
    df = df.withColumn("__windows", windows)
    w = F.col("__windows")
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    twice = F.size(w) != F.size(F.array_distinct(w))
    df = df.withColumn("__at", F.when(twice, F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(empty))
    at = F.col("__at")
    # a window counts when its neighbour in hash order is the same
    starts = F.transform(at, lambda x, i: F.when((F.get(at, i - 1)["h"] == x["h"]) | (F.get(at, i + 1)["h"] == x["h"]), x["i"]))
    df = df.withColumn("__starts", F.sort_array(F.array_compact(starts)))
    repeat = F.aggregate(
        "__starts",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).cast("int").alias("last")),
        lambda acc, s: F.struct((acc["n"] + F.least(F.lit(5), s - acc["last"])).alias("n"), s.alias("last")),
        lambda acc: acc["n"],
    )
    made = F.struct(
        F.size("__hashes").cast("long").alias("__words"),
        F.length(F.array_join("__split", "")).cast("long").alias("__chars"),
        F.regexp_count(t, F.lit(SYMBOL)).cast("long").alias("__symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__dup_lines"),
        repeat.alias("__repeat"),
    )
    # a generator of one row: filters on the measures stay above it instead of being unfolded into it
    return df.select(*first, F.explode(F.array(made)).alias("__made")).select(*first, "__made.*")


def failures(words: Column, symbols: Column, dup_lines: Column, repeat: Column) -> dict[str, Column]:
    return {
        "short": words < 10,
        "repeat": 100 * repeat > 20 * words,
        "symbol": 10 * symbols > 10 * words,
        "dup_line": 5 * dup_lines > words,
    }


def host_verdicts(measured: DataFrame, host: str, limit: float = HOST_LIMIT) -> DataFrame:
    """Rejected hosts: one row (host) for each whose shrunk rate of any rule is over the limit."""
    by_host = (
        measured.filter(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("__host"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("__n"),
            *(F.sum(F.col(f"__fail_{r}").cast("int")).cast("double").alias(f"__f_{r}") for r in RULES),
        )
    )
    total = by_host.agg(F.sum("__n").alias("__total"), *(F.sum(f"__f_{r}").alias(f"__sum_{r}") for r in RULES))
    total = total.select("__total", *((F.col(f"__sum_{r}") / F.col("__total")).alias(f"__m_{r}") for r in RULES))
    joined = by_host.join(F.broadcast(total))  # one row
    spread = joined.agg(
        F.first("__total").alias("__total"),
        *(F.first(f"__m_{r}").alias(f"__m_{r}") for r in RULES),
        *((F.sum(F.col("__n") * F.pow(F.col(f"__f_{r}") / F.col("__n") - F.col(f"__m_{r}"), 2)) / F.first("__total")).alias(f"__v_{r}") for r in RULES),
    )
    kappa = {}
    for r in RULES:
        m, v = F.col(f"__m_{r}"), F.col(f"__v_{r}")
        kappa[r] = F.when(v > 1e-12, F.least(F.greatest(m * (1 - m) / v - 1, F.lit(PRIOR_LEAST)), F.lit(PRIOR_MOST))).otherwise(F.lit(PRIOR_MOST))
    prior = spread.select(*(F.col(f"__m_{r}") for r in RULES), *(kappa[r].alias(f"__k_{r}") for r in RULES))
    rates = by_host.join(F.broadcast(prior))  # one row
    over = F.lit(False)
    for r in RULES:
        over = over | ((F.col(f"__f_{r}") + F.col(f"__m_{r}") * F.col(f"__k_{r}")) / (F.col("__n") + F.col(f"__k_{r}")) > limit)
    return rates.filter(over).select("__host")


def assess(docs: DataFrame, keys: list[str], host: str = "source", text: str = "text", limit: float = HOST_LIMIT) -> DataFrame:
    """keys, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed, kept per row."""
    named = docs.select(*(F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)), F.col(host).alias("__of"), F.col(text).alias("__text"))
    m = measure(named, "__text").drop("__text")
    f = failures(F.col("__words"), F.col("__symbols"), F.col("__dup_lines"), F.col("__repeat"))
    m = materialize(m.select("*", *(c.alias(f"__fail_{r}") for r, c in f.items())), "quality")
    bad = host_verdicts(m, "__of", limit).select("__host", F.explode(salts()).alias("__s"))
    bad = bad.withColumn("__bad", F.lit(True))
    m = m.withColumn("__salt", salt(*(F.col(f"__key_{i}") for i in range(len(keys))), F.col("__chars")))
    out = m.join(bad, (m["__of"] == bad["__host"]) & (m["__salt"] == bad["__s"]), "left")
    base = F.col("__fail_short") | F.col("__fail_repeat")
    host_bad = F.coalesce("__bad", F.lit(False))
    return out.select(
        *(F.col(f"__key_{i}").alias(k) for i, k in enumerate(keys)),
        F.col("__words").alias("n_words"),
        F.col("__chars").alias("word_chars"),
        F.col("__symbols").alias("n_symbols"),
        F.col("__dup_lines").alias("n_dup_lines"),
        F.col("__repeat").alias("n_repeat_words"),
        base.alias("base_failed"),
        host_bad.alias("host_failed"),
        (~base & ~host_bad).alias("kept"),
    )


def keep_good(docs: DataFrame, host: str = "source", text: str = "text", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of docs, with all their columns, that neither their own rules nor their host reject.

    Texts are measured twice rather than shuffled: once for the hosts, whose rejected ones are
    written down (so that their size is known to the planner), once for the rows themselves.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    m = measure(rows.select("__row", F.col(f"__row.{host}").alias("__of"), F.col(f"__row.{text}").alias("__text")), "__text")
    fails = failures(F.col("__words"), F.col("__symbols"), F.col("__dup_lines"), F.col("__repeat"))
    bad = materialize(host_verdicts(m.select("__of", *(c.alias(f"__fail_{r}") for r, c in fails.items())), "__of", limit), "hosts")
    good = m.filter(~(fails["short"] | fails["repeat"])).select("__row", "__of", salt(F.col("__text")).alias("__salt"))
    bad = bad.select("__host", F.explode(salts()).alias("__s"))
    good = good.join(bad, (good["__of"] == bad["__host"]) & (good["__salt"] == bad["__s"]), "left_anti")
    return good.select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from quarryline.llm.common import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return assess(docs, ["doc_id"]).drop("host_failed")


_FAILS = {"short": "n_words < 10", "repeat": "100 * n_repeat_words > 20 * n_words", "symbol": "10 * n_symbols > 10 * n_words", "dup_line": "5 * n_dup_lines > n_words"}


def _sql() -> str:
    sums = ", ".join(f"sum(f_{r}) AS s_{r}" for r in RULES)
    flags = ", ".join(f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END AS f_{r}" for r, c in _FAILS.items())
    means = ", ".join(f"sum(s_{r}) / sum(n) AS m_{r}" for r in RULES)
    spread = ", ".join(f"sum(n * pow(s_{r} / n - m_{r}, 2)) / sum(n) AS v_{r}" for r in RULES)
    kappa = ", ".join(f"CASE WHEN v_{r} > 1e-12 THEN least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, {PRIOR_LEAST}), {PRIOR_MOST}) ELSE {PRIOR_MOST} END AS k_{r}" for r in RULES)
    over = " OR ".join(f"(s_{r} + m_{r} * k_{r}) / (n + k_{r}) > {HOST_LIMIT}" for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(x) AS w, unnest(range(len(x))) AS i
      FROM (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS x FROM d)),
v AS (SELECT rid, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS g,
             lead(w, 4) OVER o IS NOT NULL AS whole FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, i, CASE WHEN whole AND count(*) OVER (PARTITION BY rid, g, whole) > 1 THEN 1 ELSE 0 END AS twice FROM v),
k AS (SELECT rid, max(twice) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM c),
r AS (SELECT rid, sum(hit) AS n_repeat_words FROM k GROUP BY rid),
l AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT rid, unnest(str_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
n AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY rid),
b AS (SELECT d.rid, doc_id, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d LEFT JOIN n USING (rid) LEFT JOIN l USING (rid) LEFT JOIN r USING (rid)),
f AS (SELECT *, {flags} FROM b),
h AS (SELECT source, count(*)::DOUBLE AS n, {sums} FROM f WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT {means} FROM h), s AS (SELECT {spread} FROM h, m), p AS (SELECT m.*, {kappa} FROM m, s),
bad AS (SELECT source FROM h, p WHERE {over})
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
           AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM f
"""


ORACLE = _sql()
