"""The kernels bound to the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryline.functions import scoring
from quarryline.operators import clones, findings, gate, graph, intervals, text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- scores


_DUAL = """SELECT l_orderkey, l_linenumber, l_returnflag, value, absolute, percentile FROM (
  SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity::BIGINT AS value,
         CASE WHEN l_quantity::BIGINT >= 48 THEN 'high' WHEN l_quantity::BIGINT >= 40 THEN 'warn' ELSE 'ok' END AS absolute,
         cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity::BIGINT) AS percentile FROM lineitem)
WHERE absolute <> 'ok' OR percentile >= 0.95"""


def _dual(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("long").alias("value"), F.lit("quantity").alias("metric"))
    bands = spark.range(1).select(F.lit("quantity").alias("metric"), F.lit(40).alias("warn"), F.lit(48).alias("high"))
    return scoring.dual_score(rows, "l_returnflag", "metric", "value", bands, 0.95).drop("metric")


@query(_DUAL)
def dual_score_quantity(spark, sf_dir):
    return _dual(spark, sf_dir)


@query("""SELECT l_returnflag, metric, count(*) AS samples, min(v) AS least, max(v) AS most FROM (
  SELECT l_returnflag, 'quantity' AS metric, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, 'discount', l_discount FROM lineitem
  UNION ALL SELECT l_returnflag, 'tax', l_tax FROM lineitem) GROUP BY l_returnflag, metric""")
def baseline_samples(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return scoring.baseline(t.unpivot("l_returnflag", ["quantity", "discount", "tax"], "metric", "v"), "l_returnflag", "metric", "v")


@query("""SELECT s_suppkey, s_nationkey, CASE WHEN count(*) OVER (PARTITION BY s_nationkey) >= 5
  THEN cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) END AS percentile FROM supplier""")
def relational_percentile_guarded(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return scoring.percentiles(t, ["s_nationkey"], "s_acctbal", least=5).drop("s_acctbal")


# ---- text


_TOKENS = "tok AS (SELECT doc_id, lang, source, unnest(x) AS w, unnest(range(len(x))) AS pos FROM (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '[a-z0-9]+') AS x FROM documents))"
_GRAMS = _TOKENS + ", g AS (SELECT *, coalesce(lag(w, 2) OVER o, '<s>') AS w1, coalesce(lag(w, 1) OVER o, '<s>') AS w2 FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY pos))"
_ENTROPY = _GRAMS + """,
tl AS (SELECT lang, w1, w2, w, count(*) AS n FROM g GROUP BY ALL), cl AS (SELECT lang, w1, w2, sum(n) AS c FROM tl GROUP BY ALL), vl AS (SELECT lang, count(DISTINCT w) AS v FROM g GROUP BY lang),
tf AS (SELECT lang, source, w1, w2, w, count(*) AS n FROM g GROUP BY ALL), cf AS (SELECT lang, source, w1, w2, sum(n) AS c FROM tf GROUP BY ALL), vf AS (SELECT lang, source, count(DISTINCT w) AS v FROM g GROUP BY lang, source),
h AS (SELECT doc_id, g.lang, count(*) AS tokens, avg(-log2(0.5 * (tl.n + 1) / (cl.c + vl.v) + 0.5 * (tf.n + 1) / (cf.c + vf.v))) AS h FROM g
  JOIN tl USING (lang, w1, w2, w) JOIN cl USING (lang, w1, w2) JOIN vl USING (lang) JOIN tf USING (lang, source, w1, w2, w) JOIN cf USING (lang, source, w1, w2) JOIN vf USING (lang, source) GROUP BY doc_id, g.lang)"""


def _tokens(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("x"))


@query(f"WITH {_GRAMS} SELECT lang, w1, w2, w, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang, w1, w2)::BIGINT AS context FROM g GROUP BY lang, w1, w2, w")
def trigram_model(spark, sf_dir):
    return text.model(text.trigrams(_tokens(spark, sf_dir), "x").select("lang", "w1", "w2", "w"), ["lang"]).select("lang", "w1", "w2", "w", "n", "context")


@query(f"WITH {_ENTROPY} SELECT doc_id, tokens, round(h, 6) AS h FROM h")
def naturalness_entropy(spark, sf_dir):
    h = text.cross_entropy(_tokens(spark, sf_dir), "x", "doc_id", "lang", "source")
    return h.select("doc_id", "tokens", F.round("h", 6).alias("h"))


@query(f"""WITH {_ENTROPY}, s AS (SELECT lang FROM tok GROUP BY lang HAVING count(*) >= 1000),
r AS (SELECT doc_id, lang, round_even(100 * round(h, 6), 0)::BIGINT AS value, cume_dist() OVER (PARTITION BY lang ORDER BY round(h, 6)) AS percentile FROM h JOIN s USING (lang))
SELECT doc_id, value, CASE WHEN value >= 1100 THEN 'high' WHEN value >= 1050 THEN 'warn' ELSE 'ok' END AS absolute, percentile FROM r WHERE value >= 1050 OR percentile >= 0.95""")
def unnatural_findings(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    enough = tokens.groupBy("lang").agg(F.sum(F.size("x")).alias("m")).filter("m >= 1000").select("lang")
    h = text.cross_entropy(tokens, "x", "doc_id", "lang", "source").join(enough, "lang").withColumn("h", F.round("h", 6))
    h = graph.cut(h)  # percentiles read it twice
    h = scoring.percentiles(h, ["lang"], "h").withColumn("value", F.bround(100 * F.col("h")).cast("long"))
    h = h.withColumn("absolute", scoring.severity(F.col("value"), F.lit(1050), F.lit(1100)))
    return h.filter((F.col("absolute") != "ok") | (F.col("percentile") >= 0.95)).select("doc_id", "value", "absolute", "percentile")


_TERMS = "term AS (SELECT DISTINCT doc_id, lang, w FROM (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) WHERE length(w) > 1)"
_IDF = _TERMS + """, n AS (SELECT lang, count(DISTINCT doc_id) AS units FROM term GROUP BY lang),
f AS (SELECT lang, w, count(*) AS df, log2((units + 1) / (count(*) + 1)) AS idf, count(*) >= 2 AND count(*) <= greatest(2, ceil(units / 50)) AS rare FROM term JOIN n USING (lang) GROUP BY lang, w, units)"""


def _terms(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("w"))
    return d.filter(F.length("w") > 1)


@query(f"WITH {_IDF} SELECT lang, w, df, round(idf, 6) AS idf FROM f")
def term_idf(spark, sf_dir):
    return text.idf(_terms(spark, sf_dir), "doc_id", "lang", "w").select("lang", "w", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_IDF} SELECT lang, count(*) AS terms, sum(df)::BIGINT AS postings FROM f WHERE rare GROUP BY lang")
def rare_terms(spark, sf_dir):
    return text.idf(_terms(spark, sf_dir), "doc_id", "lang", "w").filter("rare").groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"))


@query(f"""WITH {_IDF}, k AS (SELECT doc_id, lang, w, idf, rare FROM term JOIN f USING (lang, w)), t AS (SELECT doc_id, sum(idf) AS total, count(*) AS size FROM k GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y FROM k a JOIN k b ON a.lang = b.lang AND a.w = b.w AND a.doc_id < b.doc_id WHERE a.rare AND b.rare GROUP BY ALL HAVING count(*) >= 2),
s AS (SELECT x, y, sum(a.idf) AS sh FROM c JOIN k a ON a.doc_id = x JOIN k b ON b.doc_id = y AND a.w = b.w GROUP BY x, y)
SELECT x, y, round(sh / (p.total + q.total - sh), 6) AS score FROM s JOIN t p ON p.doc_id = x JOIN t q ON q.doc_id = y
  JOIN documents dx ON dx.doc_id = x JOIN documents dy ON dy.doc_id = y
WHERE round(sh / (p.total + q.total - sh), 6) >= 0.6 AND dx.text <> dy.text AND 2 * least(p.size, q.size) >= greatest(p.size, q.size)""")
def reimplementation_pairs(spark, sf_dir):
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))), lambda w: F.length(w) > 1)
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", words.alias("words"), F.md5(F.encode("text", "UTF-8")).alias("d"))
    pairs = text.shared_vocabulary(d, "doc_id", "lang", "words", "d", 0.5999995)
    return pairs.withColumn("score", F.round("score", 6)).filter("score >= 0.6 AND 2 * least(nx, ny) >= greatest(nx, ny)").select("x", "y", "score")


# ---- clones


_TAGS = "regexp_extract_all(html, '</?[a-z][a-z0-9]*')"


def _tags(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit("</?[a-z][a-z0-9]*"), F.lit(0)).alias("tags"))
    return t.select("page_id", "tags", F.md5(F.array_join("tags", " ")).alias("digest"), F.size("tags").cast("long").alias("size"), F.lit("html").alias("lang"))


@query(f"SELECT 'html' AS lang, digest, count(*) AS members, min(page_id) AS first FROM (SELECT page_id, md5(array_to_string({_TAGS}, ' ')) AS digest FROM pages) GROUP BY digest HAVING count(*) >= 2")
def exact_clone_clusters(spark, sf_dir):
    return clones.exact_clusters(_tags(spark, sf_dir), "lang", "digest", "page_id")


_NEAR = f"""p AS (SELECT page_id, {_TAGS} AS tags FROM pages), u AS (SELECT min(page_id) AS page_id, any_value(tags) AS tags, len(any_value(tags)) AS size FROM p GROUP BY md5(array_to_string(tags, ' '))),
hist AS (SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(tags) AS tag FROM u) GROUP BY ALL),
pr AS (SELECT a.page_id AS x, b.page_id AS y, a.size AS sx, b.size AS sy, 0.5 * pow(2, least(floor(log2(a.size)), floor(log2(b.size))) + 1) AS lim
  FROM u a JOIN u b ON a.page_id < b.page_id AND abs(floor(log2(a.size)) - floor(log2(b.size))) <= 1),
o AS (SELECT x, y, sx, sy, lim, sum(least(h.n, k.n)) AS o FROM pr JOIN hist h ON h.page_id = x JOIN hist k ON k.page_id = y AND k.tag = h.tag GROUP BY ALL),
near AS (SELECT x, y, (sx + sy - 2 * o)::BIGINT AS distance, sx, sy FROM o WHERE sx + sy - 2 * o <= lim)"""


def _near(spark, sf_dir) -> DataFrame:
    t = _tags(spark, sf_dir)
    hist = t.select("page_id", F.explode("tags").alias("type")).groupBy("page_id", "type").agg(F.count(F.lit(1)).alias("n"))
    return clones.candidates(t, hist, "lang", "page_id", "digest")


@query(f"WITH {_NEAR} SELECT x, y, distance FROM near")
def near_clone_candidates(spark, sf_dir):
    return _near(spark, sf_dir).select("x", "y", "distance")


@query()
def near_clone_lcs(spark, sf_dir):
    """Candidates whose tag sequences are similar by common subsequence: no SQL, tested by brute force."""
    t = _tags(spark, sf_dir).select("page_id", F.transform("tags", lambda x: F.xxhash64(x)).alias("s"), "size")
    pairs = _near(spark, sf_dir).join(t.select(F.col("page_id").alias("x"), F.col("s").alias("a"), F.col("size").alias("na")), "x").join(t.select(F.col("page_id").alias("y"), F.col("s").alias("b"), F.col("size").alias("nb")), "y")
    pairs = pairs.filter("least(least(na, 400), least(nb, 400)) >= 0.85 * greatest(least(na, 400), least(nb, 400))")
    return pairs.select("x", "y", clones.similarity(F.col("a"), F.col("b")).alias("similarity")).filter("similarity >= 0.85")


@query(f"""WITH RECURSIVE {_NEAR}, e AS (SELECT x, y FROM near WHERE 20 * distance <= sx + sy), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(node, to_) AS (SELECT x, x FROM b UNION SELECT r.node, b.y FROM r JOIN b ON r.to_ = b.x) SELECT node, min(to_) AS component FROM r GROUP BY node""")
def near_clone_clusters(spark, sf_dir):
    size = _tags(spark, sf_dir).select("page_id", "size")
    e = _near(spark, sf_dir).join(size.select(F.col("page_id").alias("x"), F.col("size").alias("sx")), "x").join(size.select(F.col("page_id").alias("y"), F.col("size").alias("sy")), "y")
    return graph.components(e.filter("20 * distance <= sx + sy").select("x", "y"))


@query(f"""WITH RECURSIVE {_NEAR}, e AS (SELECT x, y FROM near WHERE 20 * distance <= sx + sy), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(node, to_) AS (SELECT x, x FROM b UNION SELECT r.node, b.y FROM r JOIN b ON r.to_ = b.x), c AS (SELECT node, min(to_) AS component FROM r GROUP BY node),
k AS (SELECT page_id, min(page_id) OVER (PARTITION BY md5(array_to_string(tags, ' '))) AS representative FROM p)
SELECT page_id, representative, coalesce(component, representative) AS component FROM k LEFT JOIN c ON node = representative""")
def near_clone_members(spark, sf_dir):
    """Every page with the representative of its digest, that the pairs name, and its cluster."""
    return clones.members(_tags(spark, sf_dir), near_clone_clusters(spark, sf_dir), "lang", "page_id", "digest")


@query("""WITH l AS (SELECT doc_id, md5(text) AS whole, md5(line) AS part FROM (SELECT doc_id, text, unnest(str_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 40),
b AS (SELECT part, count(*) AS m FROM l GROUP BY part HAVING count(*) >= 2), w AS (SELECT md5(text) AS whole, count(*) AS m FROM documents GROUP BY ALL HAVING count(*) >= 2)
SELECT part, count(*) AS members FROM l JOIN b USING (part) LEFT JOIN w USING (whole) WHERE w.m IS NULL OR w.m < b.m GROUP BY part HAVING count(*) >= 2""")
def clone_maximality(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("t").alias("lang"), F.md5("text").alias("whole"), "text")
    lines = d.select("lang", "doc_id", "whole", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") >= 40).withColumn("part", F.md5("line"))
    parts = clones.exact_clusters(lines, "lang", "part", "doc_id").select(F.col("part").alias("digest"), "members")
    wholes = clones.exact_clusters(d, "lang", "whole", "doc_id").select(F.col("whole").alias("digest"), "members")
    own = lines.join(parts.withColumnRenamed("digest", "part").withColumnRenamed("members", "m"), "part")
    up = own.join(wholes.select(F.col("digest").alias("whole"), F.col("members").alias("up")), "whole", "left").filter("up IS NULL OR up < m")
    return up.groupBy("part").agg(F.count(F.lit(1)).alias("members")).filter("members >= 2")


# ---- intervals


_SPANS = "s AS (SELECT o_custkey AS file, o_orderkey AS s_id, (epoch(o_orderdate) / 86400)::BIGINT AS s_lo, (epoch(o_orderdate) / 86400)::BIGINT + 30 + o_orderkey % 300 AS s_hi FROM orders)"


def _spans(spark, sf_dir) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("s_id"), day.alias("s_lo"), (day + 30 + F.col("o_orderkey") % 300).alias("s_hi"))


@query(f"WITH {_SPANS}, p AS (SELECT s_id AS p_id, file, s_lo + 20 AS lo, s_lo + 25 AS hi FROM s), i AS (SELECT p_id, s_id, row_number() OVER (PARTITION BY p_id ORDER BY s_hi - s_lo, s_id) AS k FROM p JOIN s ON p.file = s.file AND s_lo <= lo AND hi <= s_hi) SELECT p.p_id, coalesce(s_id, 0) AS unit FROM p LEFT JOIN i ON p.p_id = i.p_id AND k = 1")
def innermost_interval(spark, sf_dir):
    s = _spans(spark, sf_dir)
    p = s.select(F.col("s_id").alias("p_id"), "file", (F.col("s_lo") + 20).alias("lo"), (F.col("s_lo") + 25).alias("hi"))
    return intervals.innermost(p, s, "file", "p_id", "lo", "hi")


@query(f"""WITH {_SPANS}, p AS (SELECT s_id AS p_id, file, s_lo + 20 AS lo, s_lo + 25 AS hi, s_id % 3 = 0 AS hoisted FROM s),
i AS (SELECT p_id, hoisted, s_id, dense_rank() OVER (PARTITION BY p_id ORDER BY s_hi - s_lo) AS r FROM p JOIN s ON p.file = s.file AND s_lo <= lo AND hi <= s_hi),
m AS (SELECT *, max(r) OVER (PARTITION BY p_id) AS most FROM i) SELECT p_id, min(s_id) AS scope FROM m WHERE r = CASE WHEN hoisted THEN least(2, most) ELSE 1 END GROUP BY p_id""")
def owning_scope_hoisted(spark, sf_dir):
    s = _spans(spark, sf_dir)
    p = s.select(F.col("s_id").alias("p_id"), "file", (F.col("s_lo") + 20).alias("lo"), (F.col("s_lo") + 25).alias("hi"), (F.col("s_id") % 3 == 0).alias("hoisted"))
    return intervals.owning(p, s, "file", "p_id", "lo", "hi", "hoisted")


@query(f"""WITH {_SPANS}, d AS (SELECT file, s_id % 5 AS name, s_id, s_lo, s_hi, s_id AS d_id FROM s), p AS (SELECT s_id AS p_id, file, (s_id * 7) % 5 AS name, s_lo + 3 AS lo, s_lo + 4 AS hi FROM s),
i AS (SELECT p_id, d_id, row_number() OVER (PARTITION BY p_id ORDER BY s_hi - s_lo, s_id) AS k FROM p JOIN d ON p.file = d.file AND p.name = d.name AND s_lo <= lo AND hi <= s_hi) SELECT p_id, d_id AS def FROM i WHERE k = 1""")
def nearest_definition(spark, sf_dir):
    s = _spans(spark, sf_dir)
    d = s.select("file", (F.col("s_id") % 5).alias("name"), "s_id", "s_lo", "s_hi", F.col("s_id").alias("d_id"))
    p = s.select(F.col("s_id").alias("p_id"), "file", ((F.col("s_id") * 7) % 5).alias("name"), (F.col("s_lo") + 3).alias("lo"), (F.col("s_lo") + 4).alias("hi"))
    return intervals.nearest_definition(p, d, "file", "name", "p_id", "lo", "hi")


@query("""WITH d AS (SELECT DISTINCT user_id, (epoch(date_trunc('day', ts)) / 86400)::BIGINT AS day FROM events), g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS k FROM d)
SELECT user_id, min(day) AS lo, max(day) AS hi FROM g GROUP BY user_id, k""")
def coalesced_ranges(spark, sf_dir):
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return intervals.coalesce_ranges(table(spark, sf_dir, "events").select("user_id", day.alias("day")), ["user_id"], "day")


@query(f"WITH {_SPANS}, r AS (SELECT file, s_lo + 5 AS r_lo, s_lo + 9 AS r_hi FROM s WHERE s_id % 10 = 0) SELECT s_id FROM s WHERE EXISTS (SELECT 1 FROM r WHERE r.file = s.file AND r_lo <= s_hi AND s_lo <= r_hi)")
def diff_scope_overlap(spark, sf_dir):
    s = _spans(spark, sf_dir)
    r = s.filter("s_id % 10 = 0").select("file", (F.col("s_lo") + 5).alias("r_lo"), (F.col("s_lo") + 9).alias("r_hi"))
    return intervals.overlaps(s, r, "file", "s_lo", "s_hi").select("s_id")


# ---- findings


_FINDINGS = "f AS (SELECT source AS file, doc_id % 50 AS line, lang AS metric, doc_id FROM documents), d AS (SELECT DISTINCT source AS file, CASE WHEN l.doc_id % 40 = 0 THEN NULL ELSE l.doc_id % 50 END AS line, CASE WHEN quality = 1 THEN lang END AS metric FROM labels l JOIN documents USING (doc_id))"


@query(f"WITH {_FINDINGS} SELECT doc_id, EXISTS (SELECT 1 FROM d WHERE d.file = f.file AND (d.line IS NULL OR d.line = f.line OR d.line = f.line - 1) AND (d.metric IS NULL OR d.metric = f.metric)) AS suppressed FROM f")
def suppression_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    f = docs.select(F.col("source").alias("file"), (F.col("doc_id") % 50).alias("line"), F.col("lang").alias("metric"), "doc_id")
    d = table(spark, sf_dir, "labels").join(docs, "doc_id")
    d = d.select(F.col("source").alias("file"), F.when(F.col("doc_id") % 40 != 0, F.col("doc_id") % 50).alias("line"), F.when(F.col("quality") == 1, F.col("lang")).alias("metric"))
    return findings.suppressed(f, d).select("doc_id", "suppressed")


_PATTERNS = ["*.html", "!m.*/**", "/www.*/en/**", "*.example.com/de/*", "?.tht*/**"]


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)
SELECT page_id, CASE WHEN regexp_matches(path, '^[^/]\.tht[^/]*/.*$') THEN true WHEN regexp_matches(path, '^[^/]*\.example\.com/de/[^/]*$') THEN true WHEN regexp_matches(path, '^www\.[^/]*/en/.*$') THEN true
  WHEN regexp_matches(path, '^m\.[^/]*/.*$') THEN false WHEN regexp_matches(path, '(^|.*/)[^/]*\.html$') THEN true ELSE false END AS ignored FROM p""")
def ignore_last_match(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", findings.ignored(path, _PATTERNS).alias("ignored"))


@query("""WITH h AS (SELECT event_id, event_type, user_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS k FROM events WHERE event_id % 2 = 1),
b AS (SELECT event_type, user_id, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY ALL) SELECT event_id FROM h LEFT JOIN b USING (event_type, user_id) WHERE k > coalesce(n, 0)""")
def ratchet_multiset(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return findings.ratchet(e.filter("event_id % 2 = 1"), e.filter("event_id % 2 = 0"), ["event_type", "user_id"], ["event_id"]).select("event_id")


@query(f"SELECT 'order' || l_orderkey || ':' || l_linenumber || '  ' || l_returnflag || '  quantity ' || value || ' (' || absolute || '; p' || round_even(100 * percentile, 0)::INT || ')' AS line FROM ({_DUAL})")
def text_report(spark, sf_dir):
    d = _dual(spark, sf_dir)
    return d.select(findings.report_line(F.concat(F.lit("order"), F.col("l_orderkey").cast("string")), F.col("l_linenumber"), F.col("l_returnflag"), F.lit("quantity"), F.col("value"), F.col("absolute"), F.col("percentile")).alias("line"))


@query(f"SELECT '::' || CASE WHEN absolute = 'high' THEN 'error' ELSE 'warning' END || ' file=order%3A' || l_orderkey || ',line=' || l_linenumber || ',title=quantity%2C value::100%25 of ' || value AS line FROM ({_DUAL})")
def github_annotations(spark, sf_dir):
    d = _dual(spark, sf_dir)
    return d.select(findings.annotation(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")), F.col("l_linenumber"), F.lit("quantity, value"), F.concat(F.lit("100% of "), F.col("value").cast("string")), F.col("absolute")).alias("line"))


# ---- sequences


@query("""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '</?(?:nav|ul|li|div|article|footer)\\b')) AS tag, unnest(range(len(regexp_extract_all(html, '</?(?:nav|ul|li|div|article|footer)\\b')))) AS i FROM pages),
d AS (SELECT page_id, sum(CASE WHEN tag LIKE '</%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM t) SELECT page_id, max(depth)::BIGINT AS nesting FROM d GROUP BY page_id""".replace("\\\\", "\\"))
def nesting_depth_pages(spark, sf_dir):
    tags = F.regexp_extract_all("html", F.lit(r"</?(?:nav|ul|li|div|article|footer)\b"), F.lit(0))
    steps = F.transform(tags, lambda t: F.when(t.startswith("</"), -1).otherwise(1))
    run = F.aggregate(steps, F.struct(F.lit(0).alias("d"), F.lit(-999).alias("m")), lambda a, s: F.struct((a["d"] + s).alias("d"), F.greatest(a["m"], a["d"] + s).alias("m")), lambda a: a["m"])
    return table(spark, sf_dir, "pages").filter(F.size(tags) > 0).select("page_id", run.cast("long").alias("nesting"))


@query("""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '<!--[^>]*-->')) AS c FROM pages) SELECT page_id, count(*) AS markers FROM c WHERE regexp_matches(c, '(?i)\\b(?:ad|todo|fixme)\\b') GROUP BY page_id""".replace("\\\\", "\\"))
def stub_markers_comments(spark, sf_dir):
    c = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<!--[^>]*-->"), F.lit(0))).alias("c"))
    return c.filter(F.col("c").rlike(r"(?i)\b(?:ad|todo|fixme)\b")).groupBy("page_id").agg(F.count(F.lit(1)).alias("markers"))


@query("""WITH l AS (SELECT doc_id, unnest(str_split(text, chr(10))) AS x, unnest(range(len(str_split(text, chr(10))))) AS i FROM documents),
n AS (SELECT doc_id, i, regexp_replace(trim(x), ' +', ' ', 'g') AS x FROM l), p AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM n) SELECT doc_id, i::BIGINT AS line FROM p WHERE x <> '' AND x = before""")
def identical_adjacent_lines(spark, sf_dir):
    n = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(F.trim(x), " +", " "))
    d = table(spark, sf_dir, "documents").select("doc_id", n.alias("n"))
    same = F.filter(F.transform("n", lambda x, i: F.when((i > 0) & (x != "") & (x == F.get("n", i - 1)), i)), lambda i: i.isNotNull())
    return d.select("doc_id", F.explode(same).alias("line")).withColumn("line", F.col("line").cast("long"))


@query("""WITH e AS (SELECT event_id, user_id, date_trunc('day', ts) AS day, event_type, coalesce(max((event_type = 'click')::INT) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM events) SELECT event_id FROM e WHERE done = 1""")
def unreachable_after_terminal(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    return e.withColumn("done", intervals.running_flag(F.col("event_type") == "click", ["user_id", "day"], ["event_id"])).filter("done").select("event_id")


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) SELECT user_id, event_type, first FROM f WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = f.user_id AND e.event_type = f.event_type AND e.event_id > f.first)""")
def first_binding(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    return e.filter("first = last").drop("last")


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS fan_out FROM lineitem GROUP BY l_orderkey")
def fan_out(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("fan_out"))


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, unnest(regexp_extract_all(html, 'href="/([^"/]*)"', 1)) AS name FROM pages)
SELECT name, count(*) AS uses FROM h WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.lang = h.name) GROUP BY name""")
def unbound_references(spark, sf_dir):
    h = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="/([^"/]*)"'), F.lit(1))).alias("name"))
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("name")).distinct()
    return h.join(d, "name", "left_anti").groupBy("name").agg(F.count(F.lit(1)).alias("uses"))


# ---- graphs


_REFS = "refs AS (SELECT l_orderkey * 10 + l_linenumber AS ref, l_suppkey AS src, l_partkey % 400 AS def, (l_partkey % 400) % 25 AS file FROM lineitem UNION ALL SELECT l_orderkey * 10 + l_linenumber, l_suppkey, l_partkey % 377, (l_partkey % 377) % 25 FROM lineitem)"
_MASS = _REFS + """, b AS (SELECT def, count(DISTINCT src) AS breadth FROM refs GROUP BY def), n AS (SELECT count(DISTINCT src) AS reach FROM refs), kept AS (SELECT def FROM b, n WHERE breadth <= greatest(3, ceil(reach * 0.78))),
r AS (SELECT refs.* FROM refs JOIN kept USING (def)), k AS (SELECT ref, count(*) AS k FROM r GROUP BY ref), mass AS (SELECT src, file, sum(1.0::DOUBLE / k) AS mass FROM r JOIN k USING (ref) GROUP BY src, file)"""


def _mass(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    ref = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref")
    part = lambda m: li.select(ref, F.col("l_suppkey").alias("src"), (F.col("l_partkey") % m).alias("def"), ((F.col("l_partkey") % m) % 25).alias("file"))
    return graph.reference_mass(part(400).unionByName(part(377)), 3, 0.78)


@query(f"WITH {_MASS} SELECT src, file, round(mass, 6) AS mass FROM mass")
def reference_mass(spark, sf_dir):
    return _mass(spark, sf_dir).select("src", "file", F.round("mass", 6).alias("mass"))


@query(f"""WITH {_MASS}, h AS (SELECT s_suppkey AS src, s_nationkey AS own_file, (s_suppkey % 7)::BIGINT AS own FROM supplier), a AS (SELECT mass.src, file, round(mass, 6) AS mass, own FROM mass JOIN h USING (src) WHERE file <> own_file),
t AS (SELECT src, own, sum(mass) AS total FROM a GROUP BY src, own), top AS (SELECT src, file, mass, row_number() OVER (PARTITION BY src ORDER BY mass DESC, file) AS k FROM a)
SELECT src, own, file AS best_file, round_even(100 * mass / (own + total), 0)::BIGINT AS envy FROM t JOIN top USING (src) WHERE k = 1""")
def envy_score(spark, sf_dir):
    home = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("own_file"), (F.col("s_suppkey") % 7).alias("own"))
    return graph.envy(_mass(spark, sf_dir).withColumn("mass", F.round("mass", 6)), home).drop("total")


@query("SELECT community, file, n FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, file) AS k FROM (SELECT c_mktsegment AS community, c_nationkey AS file, count(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey)) WHERE k = 1")
def community_plurality(spark, sf_dir):
    return graph.plurality(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("community"), F.col("c_nationkey").alias("file")), "community", "file")


_EDGES = "e AS (SELECT o_custkey AS x, (o_custkey * 31 + o_orderkey) % 4000 AS y FROM orders)"


def _edges(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("x"), ((F.col("o_custkey") * 31 + F.col("o_orderkey")) % 4000).alias("y"))


@query()
def connected_components(spark, sf_dir):
    """SQL takes the square of a component here, and one holds nearly all nodes; tested by brute force."""
    return graph.components(_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {_EDGES}, r(node) AS (SELECT DISTINCT x FROM e WHERE x % 50 = 0 UNION SELECT e.y FROM r JOIN e ON r.node = e.x) SELECT node FROM r")
def reachability(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graph.reachable(e, e.filter("x % 50 = 0").select(F.col("x").alias("node")))


@query(f"WITH RECURSIVE {_EDGES}, r(node) AS (SELECT DISTINCT x FROM e WHERE x % 50 = 0 UNION SELECT e.y FROM r JOIN e ON r.node = e.x) SELECT DISTINCT node FROM (SELECT x AS node FROM e UNION SELECT y FROM e) WHERE node NOT IN (SELECT node FROM r)")
def unreferenced(spark, sf_dir):
    e = _edges(spark, sf_dir)
    nodes = e.select(F.col("x").alias("node")).union(e.select("y")).distinct()
    return nodes.join(graph.reachable(e, e.filter("x % 50 = 0").select(F.col("x").alias("node"))), "node", "left_anti")


@query(f"""WITH {_EDGES}, b AS (SELECT x, y FROM e UNION SELECT y, x FROM e), h0 AS (SELECT DISTINCT x AS node, 0 AS hop FROM e WHERE x % 97 = 0), h1 AS (SELECT DISTINCT y AS node, 1 AS hop FROM h0 JOIN b ON node = x),
h2 AS (SELECT DISTINCT y AS node, 2 AS hop FROM h1 JOIN b ON node = x) SELECT node, min(hop) AS hop FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY node""")
def k_hop(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graph.neighbourhood(e, e.filter("x % 97 = 0").select(F.col("x").alias("node")), 2)


@query()
def louvain_communities(spark, sf_dir):
    """Communities of suppliers' mass graph: sequential in a component, so no SQL; tested on a golden."""
    m = _mass(spark, sf_dir)
    return graph.louvain(m.select(F.col("src").cast("long").alias("x"), (F.col("file") + 1_000_000).cast("long").alias("y"), F.round("mass", 6).alias("w")))


@query("""WITH n AS (SELECT a.n_name AS x, b.n_name AS y, count(*) / 4.0 AS w FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey GROUP BY ALL)
SELECT '    ' || x || ' -- ' || format('{:.1f}', w::DOUBLE) || ' --> ' || y AS line FROM n""".replace("count(*) / 4.0", "count(*) / 2.0"))
def mermaid_file_edges(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    m = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    n = m.groupBy("c_nationkey", "s_nationkey").agg((F.count(F.lit(1)) / 2.0).alias("w"))
    name = lambda key, out: t("nation").select(F.col("n_nationkey").alias(key), F.col("n_name").alias(out))
    n = n.join(name("c_nationkey", "x"), "c_nationkey").join(name("s_nationkey", "y"), "s_nationkey")
    return n.select(findings.flow_edge(F.col("x"), F.col("y"), F.col("w")).alias("line"))


_HOMES = "m AS (SELECT c_custkey AS node, c_nationkey AS file, c_custkey % 60 AS community FROM customer), t AS (SELECT community, file, count(*) AS n FROM m GROUP BY ALL), p AS (SELECT community, file AS most FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, file) AS k FROM t) WHERE k = 1)"


@query(f"WITH {_HOMES} SELECT file, count(DISTINCT community) AS communities FROM m JOIN p USING (community) WHERE most <> file GROUP BY file")
def scattered_files(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return graph.scattered(c.select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("file"), (F.col("c_custkey") % 60).alias("community")))


@query(f"""WITH {_MASS}, h AS (SELECT s_suppkey AS src, s_nationkey AS own_file, (s_suppkey % 7)::BIGINT AS own, s_suppkey % 9 AS community FROM supplier),
mp AS (SELECT community, own_file AS most FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, own_file) AS k FROM (SELECT community, own_file, count(*) AS n FROM h GROUP BY ALL)) WHERE k = 1),
a AS (SELECT mass.src, file, round(mass, 6) AS mass, own FROM mass JOIN h USING (src) WHERE file <> own_file),
t AS (SELECT src, own, sum(mass) AS total FROM a GROUP BY src, own), top AS (SELECT src, file, mass, row_number() OVER (PARTITION BY src ORDER BY mass DESC, file) AS k FROM a)
SELECT src, file AS best_file, round_even(100 * mass / (t.own + total), 0)::BIGINT AS envy FROM t JOIN top USING (src) JOIN h USING (src) JOIN mp USING (community) WHERE k = 1 AND total >= 3 AND most <> own_file""")
def misplaced_sources(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    home = s.select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("own_file"), (F.col("s_suppkey") % 7).alias("own"))
    return graph.misplaced(_mass(spark, sf_dir).withColumn("mass", F.round("mass", 6)), home, s.select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 9).alias("community")))


@query("SELECT o_custkey AS file, count(DISTINCT o_orderpriority) AS components FROM orders GROUP BY o_custkey HAVING count(*) >= 2")
def low_cohesion_files(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("def"))
    return graph.low_cohesion(o.select("file", "unit"), graph.binding_edges(o))


@query("SELECT c_nationkey AS component, c_custkey AS unit FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS k FROM customer) WHERE k = 1")
def component_representatives(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("component"), F.col("c_acctbal").alias("line"), F.col("c_custkey").alias("unit"))
    return graph.representatives(c, "component", "line", "unit")


@query(f"""WITH d AS ({_DUAL}), h AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, value ORDER BY l_orderkey, l_linenumber) AS k FROM d WHERE absolute = 'high' AND l_linenumber <> 2 AND l_orderkey % 2 = 1),
b AS (SELECT l_returnflag, value, count(*) AS n FROM d WHERE absolute = 'high' AND l_linenumber <> 2 AND l_orderkey % 2 = 0 GROUP BY ALL)
SELECT l_orderkey, l_linenumber FROM h LEFT JOIN b USING (l_returnflag, value) WHERE k > coalesce(n, 0)""")
def gate_errors(spark, sf_dir):
    """Odd orders as the head and even ones as the base, both whole; line 2 is suppressed."""
    d = _dual(spark, sf_dir).withColumn("suppressed", F.col("l_linenumber") == 2)
    head, base = d.filter("l_orderkey % 2 = 1"), d.filter("l_orderkey % 2 = 0")
    return gate.errors(head, base, ["l_returnflag", "value"], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query(f"""WITH RECURSIVE {_NEAR}, e AS (SELECT x, y, 1 - distance / (sx + sy) AS s FROM near WHERE 20 * distance <= sx + sy), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r(node, to_) AS (SELECT x, x FROM b UNION SELECT r.node, b.y FROM r JOIN b ON r.to_ = b.x), c AS (SELECT node, min(to_) AS component FROM r GROUP BY node)
SELECT component, round_even(100 * min(s), 0)::BIGINT AS value FROM e JOIN c ON node = x GROUP BY component""")
def near_clone_weakest(spark, sf_dir):
    size = _tags(spark, sf_dir).select("page_id", "size")
    e = _near(spark, sf_dir).join(size.select(F.col("page_id").alias("x"), F.col("size").alias("sx")), "x").join(size.select(F.col("page_id").alias("y"), F.col("size").alias("sy")), "y")
    e = e.filter("20 * distance <= sx + sy").withColumn("s", 1 - F.col("distance") / (F.col("sx") + F.col("sy")))
    return clones.weakest(e, graph.components(e.select("x", "y")), "s")
