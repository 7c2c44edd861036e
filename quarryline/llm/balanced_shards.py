"""Sharding by balanced label propagation.

Every row starts in the shard that its hash names. In each round a linked row looks at the shards
of the rows that it is linked with (by a histogram of each link group, never by pairs) and asks to
move to the one that holds most of them. Moves between two shards are let through up to what comes
the other way plus the room left, as a share of the requests, drawn by hash: small groups as a
whole, large ones row by row. After the last round each small group goes as a whole to the shard
that holds most of it. Then rows over a shard's exact quota go to the shards that have too few, so
the row counts of any two shards differ by one at most: rows without links first, then rows of large
groups, then small groups one after the other, so that one is cut at each border at most.

Ranks (quotas, slots) are taken within bins of hashes with running totals over the bins, so no
shard is ever sorted in one task.

Defined results: a null text is empty (size 1, crc 0), and one of any length is read once; null
keys are rows like any others; equal rows each have their slot, and are told apart by a number of
their own where they are many; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryline.llm.common import hash128, materialize, read_table, salt, salts

SHARDS = 8
ROUNDS = 6
#: Room over a shard's quota while labels move, as a share.
SLACK = 0.05
#: Groups of more rows move and are ranked row by row.
SMALL = 64
#: Rows of a bin, about, and the least number of bins.
BIN_ROWS, LEAST_BINS = 20_000, 64


def _unit(*cols: Column) -> Column:
    """A number from 0 to 1 by hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _chosen(table: dict, *cols: Column, default=0.0) -> Column:
    """table[(a, b)] for columns a and b; the table has SHARDS * SHARDS entries at most."""
    if not table:
        return F.lit(default)
    pairs = [x for (k, v) in table.items() for x in (F.lit("-".join(map(str, k))), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[F.concat_ws("-", *cols)], F.lit(default))


def dense_rank_in(df: DataFrame, part: str, bin_cols: list[str], order: list[str], name: str) -> DataFrame:
    """df with a gapless rank from 0 within part, by bin_cols and then order."""
    counts = df.groupBy(part, *bin_cols).agg(F.count(F.lit(1)).alias("__m"))
    # rows here are bins, so this window is over a small table
    before = F.sum("__m").over(W.partitionBy(part).orderBy(*bin_cols).rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(F.col(part).alias("__p"), *(F.col(b).alias(f"__b_{b}") for b in bin_cols), F.coalesce(before, F.lit(0)).alias("__off"))
    ranked = df.withColumn("__rn", F.row_number().over(W.partitionBy(part, *bin_cols).orderBy(*order)) - 1)
    on = (ranked[part] == offsets["__p"]) & F.lit(True)
    for b in bin_cols:
        on = on & (ranked[b] == offsets[f"__b_{b}"])
    return ranked.join(offsets, on).select(*df.columns, (F.col("__off") + F.col("__rn")).cast("long").alias(name))


def propagate(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """rows (__id, __key, __group, __n of the group, ...) with __shard; row counts at most one apart."""
    n = rows.count()
    start = F.xxhash64("__key", "__group", "size", F.when(F.col("__n") > SMALL, F.col("__id")).otherwise(0))
    rows = rows.withColumn("__shard", F.pmod(start, F.lit(shards)).cast("int"))
    alone, linked = rows.filter("__n = 1"), materialize(rows.filter("__n > 1"), "linked")
    quota = {s: n // shards + (s < n % shards) for s in range(shards)}
    count = lambda df: {r[0]: r[1] for r in df.groupBy("__shard").count().collect()}  # noqa: E731  one row a shard
    free = count(alone)
    for turn in range(rounds):
        cells = linked.groupBy("__group", "__shard").agg(F.count(F.lit(1)).alias("m"))
        best = cells.groupBy("__group").agg(F.max_by("__shard", F.struct("m", F.xxhash64("__group", "__shard"))).alias("__want"))
        best = best.select("__group", "__want", F.explode(salts()).alias("__s"))
        asked = linked.withColumn("__s", salt(F.col("__id"))).join(best, ["__group", "__s"]).drop("__s")
        asked = materialize(asked, "asked")
        wishes = {(r[0], r[1]): r[2] for r in asked.filter("__want <> __shard").groupBy("__shard", "__want").count().collect()}
        if not wishes:
            break
        held = count(linked)
        size = {s: free.get(s, 0) + held.get(s, 0) for s in range(shards)}
        share = {}
        for (a, b), m in wishes.items():
            into = sum(v for (_, t), v in wishes.items() if t == b)
            room = max(0.0, quota[b] * (1 + SLACK) - size[b]) * m / into
            # rows without links can make way later, so their number is room too, except for a part that stays
            room += 0.8 * free.get(b, 0) * m / into
            share[a, b] = min(1.0, (wishes.get((b, a), 0) + room) / m)
        drawn = F.when(F.col("__n") <= SMALL, _unit(F.lit(turn), F.col("__group"))).otherwise(_unit(F.lit(turn), F.col("__key"), F.col("__id")))
        go = (F.col("__want") != F.col("__shard")) & (drawn < _chosen(share, F.col("__shard"), F.col("__want")))
        linked = asked.withColumn("__shard", F.when(go, F.col("__want")).otherwise(F.col("__shard"))).drop("__want")
        linked = materialize(linked, "linked")
    rows = materialize(alone.unionByName(_gathered(linked)), "gathered")
    return _even_out(rows, count(rows), quota, n)


def _gathered(linked: DataFrame) -> DataFrame:
    """linked with each small group in the one shard that holds most of it."""
    small = linked.filter(F.col("__n") <= SMALL)
    cells = small.groupBy("__group", "__shard").agg(F.count(F.lit(1)).alias("m"))
    most = cells.groupBy("__group").agg(F.max_by("__shard", F.struct("m", F.xxhash64("__group", "__shard"))).alias("__most"))
    small = small.join(most, "__group").withColumn("__shard", F.col("__most")).drop("__most")
    return linked.filter(F.col("__n") > SMALL).unionByName(small.select(*linked.columns))


def _binned(rows: DataFrame, n: int) -> DataFrame:
    bins = max(LEAST_BINS, n // BIN_ROWS)
    # rows without links make way first, then large groups, which are likely cut already
    kind = F.when(F.col("__n") == 1, 0).when(F.col("__n") <= SMALL, 2).otherwise(1)
    by = F.when(F.col("__n") <= SMALL, F.xxhash64("__group")).otherwise(F.xxhash64("__id", "__group"))
    return rows.withColumn("__kind", kind).withColumn("__bin", F.pmod(by, F.lit(bins)).cast("int"))


def _even_out(rows: DataFrame, size: dict, quota: dict, n: int) -> DataFrame:
    over = {s: size.get(s, 0) - q for s, q in quota.items() if size.get(s, 0) > q}
    if not over:
        return rows
    ranked = dense_rank_in(_binned(rows, n), "__shard", ["__kind", "__bin"], ["__group", "__key", "__id"], "__rank")
    # the first rows of shards with too many, numbered through, fill the shards with too few
    start, at, to = {}, 0, []
    for s, m in sorted(over.items()):
        start[s], at = at, at + m
    end = 0
    for s in sorted(quota):
        if quota[s] > size.get(s, 0):
            end += quota[s] - size.get(s, 0)
            to.append((end, s))
    shard = F.col("__shard")
    pick = lambda table, other: F.coalesce(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v))))[shard], F.lit(other))
    number = pick(start, 0) + F.col("__rank")
    moved = F.lit(to[-1][1])
    for end, s in reversed(to):
        moved = F.when(number < end, F.lit(s)).otherwise(moved)
    out = ranked.withColumn("__shard", F.when(F.col("__rank") < pick(over, 0), moved).otherwise(shard).cast("int"))
    return out.drop("__rank", "__kind", "__bin")


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard: a row per row of docs. Rows with equal texts are linked."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("__id"), F.col(key).alias("__key"), hash128(t).alias("__group"), (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(F.encode(t, "UTF-8")).cast("long").alias("text_crc32"))
    rows = materialize(rows, "rows")
    groups = rows.groupBy("__group").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    groups = groups.select("__group", "__n", F.explode(salts()).alias("__s"))
    rows = rows.withColumn("__s", salt(F.col("__id"))).join(groups, ["__group", "__s"], "left").drop("__s")
    rows = materialize(rows.withColumn("__n", F.coalesce("__n", F.lit(1))), "grouped")
    n = rows.count()
    placed = materialize(propagate(rows, shards, rounds), "placed")
    out = dense_rank_in(_binned(placed, n), "__shard", ["__kind", "__bin"], ["__group", "__key", "__id"], "slot")
    return out.select(
        F.col("__key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), F.col("__shard").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
