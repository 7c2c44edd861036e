"""Benchmark decontamination by winnowing.

Of every 4 consecutive hashes of 5 words the least ones are kept as fingerprints, so two texts that
share 8 consecutive words share a fingerprint. Fingerprints of documents are tested against a
bitmap of fixed size of the items' fingerprints; those that hit are extended to the 8-word windows
around them, and these are joined with the items' windows by 128-bit hashes. An item of fewer than
8 words, but not none, is one window of its own length, which documents are searched for directly.

Items that hold a window are kept apart from windows: windows with the same set of items share a
set id (a sum of hashes), a document has a set of set ids, and items are listed once for each
distinct set of set ids. So a passage in many items and many documents makes no pairs.

Defined results: null or wordless texts have no words and no hits; a null item_id cannot be named,
so such items are left out; rows of one item_id are one item; each row of documents gets its own
result row (repeated rows the same one); empty tables give no hits or no rows; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import vectors as V
from quarryline.llm.common import SALTS, materialize, read_table, salts, ship

WINDOW = 8
GRAM = 5
#: The bitmaps' size, whatever the size of the tables: 2**26 bits are 8 MB.
BITS = 26


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _fingerprints(word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept hashes of 5 words, and the hashes; row: of each word."""
    g = V.grams(word, GRAM, 2)
    span = WINDOW - GRAM + 1
    if len(g) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.flatnonzero(row[: len(g) - span + 1] == row[WINDOW - 1 : WINDOW - 1 + len(g) - span + 1])
    least = g[: len(g) - span + 1].copy()
    for k in range(1, span):
        np.minimum(least, g[k : len(g) - span + 1 + k], out=least)
    kept = np.zeros(len(g), dtype=bool)
    for k in range(span):
        at = starts + k
        kept[at[g[at] == least[starts]]] = True
    places = np.flatnonzero(kept)
    return places, g[places]


def _windows(hashes: list[np.ndarray], starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of the windows of size words from starts on."""
    out = []
    for kind in (0, 1):
        total = np.full(len(starts), np.uint64(size), dtype=np.uint64)
        for j in range(size):
            total += hashes[kind][starts + j] * V._COEFF[kind][j]
        out.append(V.mix(total))
    return out[0], out[1]


_WINDOW_TYPE = pa.struct([("start", pa.int32()), ("len", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, len, h1, h2, prints (hashes of the fingerprints in it, for whole windows)."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for first, _, data, offsets in V.slices(batch.column(1)):
            hashes, at = V.words(data, offsets, V.ALNUM, 2)
            row = V.row_of(at)
            sizes = np.diff(at)
            out: list[tuple] = []
            whole = np.flatnonzero(row[: max(len(row) - WINDOW + 1, 0)] == row[WINDOW - 1 :]) if len(row) >= WINDOW else np.zeros(0, np.int64)
            h1, h2 = _windows(hashes, whole, WINDOW)
            places, prints = _fingerprints(hashes[0], row)
            lo, hi = np.searchsorted(places, whole), np.searchsorted(places, whole + WINDOW - GRAM, side="right")
            for s, a, b, x, y in zip(whole.tolist(), _as_long(h1).tolist(), _as_long(h2).tolist(), lo.tolist(), hi.tolist(), strict=True):
                out.append((ids[first + int(row[s])], WINDOW, a, b, _as_long(prints[x:y]).tolist()))
            for r in np.flatnonzero((sizes > 0) & (sizes < WINDOW)).tolist():
                h1, h2 = _windows(hashes, at[r : r + 1], int(sizes[r]))
                out.append((ids[first + r], int(sizes[r]), int(_as_long(h1)[0]), int(_as_long(h2)[0]), []))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.list_(pa.int64()))],
                names=["item_id", "len", "h1", "h2", "prints"],
            )


def _bitmap(df: DataFrame, column: str) -> np.ndarray:
    """A bitmap of 2**BITS bits of the column's low bits: never larger, however many rows there are."""
    low = F.pmod(F.col(column), F.lit(1 << BITS)) + 1  # buckets of 32768 values begin at 1
    parts = df.select(low.alias("v")).groupBy(F.expr("bitmap_bucket_number(v)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(v))").alias("m"))
    found = np.zeros(1 << BITS >> 3, dtype=np.uint8)
    for r in parts.collect():
        part = np.frombuffer(bytes(r["m"]), dtype=np.uint8)
        found[(r["b"] - 1) * 4096 :][: len(part)] = part
    return found


def _in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    low = h & np.uint64((1 << BITS) - 1)
    return (bitmap[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _candidates(prints, windows, lengths: list[int], columns: list[str]):
    """Of documents: n_words and the windows that may be in an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_print, by_window = prints.value, windows.value
        for batch in batches:
            for first, n, data, offsets in V.slices(batch.column("__text")):
                hashes, at = V.words(data, offsets, V.ALNUM, 2)
                row = V.row_of(at)
                found = []
                if len(row) >= WINDOW:
                    places, g = _fingerprints(hashes[0], row)
                    places = places[_in(by_print, g)]
                    starts = np.unique((places[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
                    starts = starts[(starts >= 0) & (starts <= len(row) - WINDOW)]
                    starts = starts[row[starts] == row[starts + WINDOW - 1]]
                    found.append((starts, WINDOW))
                for size in lengths:
                    if len(row) >= size:
                        found.append((np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :]), size))
                parts = []
                for starts, size in found:
                    h1, h2 = _windows(hashes, starts, size)
                    sure = _in(by_window, h1)
                    parts.append((starts[sure], np.full(int(sure.sum()), size, np.int32), h1[sure], h2[sure]))
                starts = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
                rows = row[starts]
                order = np.argsort(rows, kind="stable")
                take = lambda k, kind: np.concatenate([p[k] for p in parts])[order].astype(kind) if parts else np.zeros(0, kind)  # noqa: B023, E731
                ends = np.searchsorted(rows[order], np.arange(n + 1)).astype(np.int32)
                values = pa.StructArray.from_arrays(
                    [pa.array((starts[order] - at[rows[order]]).astype(np.int32)), pa.array(take(1, np.int32)), pa.array(_as_long(take(2, np.uint64))), pa.array(_as_long(take(3, np.uint64)))],
                    fields=list(_WINDOW_TYPE),
                )
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, n) for c in columns), pa.array(np.diff(at).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), values)],
                    names=[*columns, "n_words", "found"],
                )

    return run


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, __th (hash of the text), n_words, n_hit, n_items, items_sha256, contaminated: a row per row of docs."""
    spark = docs.sparkSession
    ship(spark)
    chosen = items.filter(F.col(item_key).isNotNull()).select(F.col(item_key).cast("string").alias("item_id"), F.col(item_text).alias("text"))
    windows = materialize(chosen.mapInArrow(_item_windows, "item_id string, len int, h1 long, h2 long, prints array<long>"), "windows")
    prints = spark.sparkContext.broadcast(_bitmap(windows.select(F.explode("prints").alias("p")), "p"))
    known = spark.sparkContext.broadcast(_bitmap(windows, "h1"))
    lengths = sorted(r[0] for r in windows.filter(F.col("len") < WINDOW).select("len").distinct().collect())  # at most 7

    # windows with equal sets of items share a set; of each set one window stands for it
    window = ["len", "h1", "h2"]
    held = windows.select(*window, "item_id").distinct()
    sums = [F.sum(F.xxhash64(F.lit(k), "item_id").cast("decimal(20,0)")).cast("string") for k in (1, 2)]
    sets = held.groupBy(*window).agg(F.xxhash64(F.lit(1), *sums, F.count(F.lit(1))).alias("s1"), F.xxhash64(F.lit(2), *sums, F.count(F.lit(1))).alias("s2"))
    sets = materialize(sets.select(*window, F.struct("s1", "s2").alias("set")), "sets")
    shown = sets.groupBy("set").agg(F.min(F.struct(*window)).alias("w")).select("set", "w.*")
    items_of = shown.join(held, window).select("set", "item_id")

    source = docs.select(F.col(key).alias("__key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__th"), F.col(text).alias("__text"))
    kind = source.schema["__key"].dataType.simpleString()
    found = source.mapInArrow(
        _candidates(prints, known, lengths, ["__key", "__th"]),
        f"__key {kind}, __th long, n_words long, found array<struct<start:int,len:int,h1:long,h2:long>>",
    )
    # a row that matches nothing stands for the document itself
    own = F.array(F.struct(F.lit(-1).alias("start"), F.lit(0).alias("len"), F.col("__th").alias("h1"), F.col("__th").alias("h2")))
    found = found.select("__key", "__th", "n_words", F.explode(F.concat(own, "found")).alias("f"))
    found = found.select("__key", "__th", "n_words", "f.*", F.pmod("__th", F.lit(SALTS)).cast("int").alias("__s"))
    side = sets.select(*window, "set", F.explode(salts()).alias("__s"))
    hits = found.join(side, [*window, "__s"], "left").filter((F.col("start") < 0) | F.col("set").isNotNull())
    per_doc = hits.groupBy("__key", "__th").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.when(F.col("start") < 0, 1).otherwise(0)).cast("int").alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("start") >= 0, F.struct("start", "len")))).alias("spans"),
        F.sort_array(F.collect_set("set")).alias("sets"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(acc["end"], x["start"]))).alias("n"),
            F.greatest(acc["end"], x["start"] + x["len"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    combo = F.struct(F.xxhash64("sets").alias("c1"), F.xxhash64(F.lit(7), "sets").alias("c2"))
    per_doc = materialize(per_doc.select("__key", "__th", "n_words", "copies", covered.alias("n_hit"), F.when(F.size("sets") > 0, combo).alias("combo"), "sets"), "hits")
    combos = per_doc.filter(F.col("combo").isNotNull()).groupBy("combo").agg(F.first("sets").alias("sets"))
    listed = combos.select("combo", F.explode("sets").alias("set")).join(items_of, "set").select("combo", "item_id").distinct()
    listed = listed.groupBy("combo").agg(F.sort_array(F.collect_list("item_id")).alias("i"))
    listed = listed.select("combo", F.size("i").cast("long").alias("n_items"), F.sha2(F.array_join("i", ","), 256).alias("items_sha256"))
    out = per_doc.drop("sets").join(materialize(listed, "items"), "combo", "left")
    none = F.sha2(F.lit(""), 256)
    return out.select(
        F.col("__key").alias(key),
        "__th",
        "n_words",
        "n_hit",
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"),
        (F.coalesce("n_items", F.lit(0)) >= 2).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy"),
    ).drop("__copy")


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that hold no window of any item.

    One item's window is a leak; the flag contaminated of find() asks for two items and is not used.
    """
    bad = find(docs, items, key, text).filter("n_items > 0").select(F.col(key).alias("__key"), F.col("__th").alias("__bad")).distinct()
    bad = materialize(bad, "leaks")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    rows = rows.select("__row", F.xxhash64(F.coalesce(F.col(f"__row.{text}"), F.lit(""))).alias("__th"))
    return rows.join(bad, rows["__row"][key].eqNullSafe(bad["__key"]) & (rows["__th"] == bad["__bad"]), "left_anti").select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, read_table(spark, sf_dir, "benchmark")).drop("__th")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
lens AS (SELECT DISTINCT least(len(w), 8) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 8) AS n, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
h AS (SELECT rid, s, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
p AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(s, s + n)) AS i FROM (SELECT DISTINCT rid, s, n FROM h)) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN i USING (rid)
"""
