"""Near-duplicates by min-max hashing.

A document's set holds its distinct runs of 3 words (one run of all words when there are fewer).
Documents with equal sets are one class. Each of PERMS linear permutations of a class's shingles
gives two values, its least and its greatest: both agree between two sets with the probability of
their similarity, so PERMS permutations give 2 * PERMS unbiased values. They are read in bands of so
many values that a pair at the threshold shares no band with a probability of MISS at most (40
bands of 6 values at 0.85, 48 of 5 at 0.8).

Buckets are not expanded into pairs. Each member of a bucket is compared with the bucket's centre,
links are confirmed on the full sets, and linked classes become components. Buckets that then
still hold several components are gone through in blocks, which carry the full sets: members are
compared with those of other components, by sketches of a byte for each of the 2 * PERMS values,
and what is within SIGMAS standard deviations of the threshold is confirmed on the full sets in the
same task, which gives out one link for each two components that it joins. So no pairs are written;
only pairs inside a component are left out, which cannot change it. A group that is alike but not
alike enough still takes comparisons by the square of its size, spread over blocks.

Defined results: null or wordless texts have an empty set and are linked with nothing; rows with
equal sets (so repeated rows too) are linked; a text's length has no bound (a very long one is a
batch of its own); each row gets a result row; a null key is never the
smallest (a component of null keys only has a null id, and its rows are not kept); an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import vectors as V
from quarryline.llm.common import drop_materialized, materialize, read_table, ship
from quarryline.llm.winnowing import _as_long, _bitmap, _in

PERMS = 120
MISS = 1e-8
LINK, OF = 85, 100
#: A pair is given up when its sketches agree in so many standard deviations less than at the threshold.
SIGMAS = 6
#: Members of a bucket, and shingles of theirs, that are compared with as many others in one task.
BLOCK, BLOCK_SHINGLES = 4096, 4 << 20

_rng = np.random.Generator(np.random.PCG64(7))
_MULTIPLY = _rng.integers(0, 2**63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, PERMS, dtype=np.uint64)
#: The order in which the 2 * PERMS values are dealt to bands.
_DEAL = _rng.permutation(2 * PERMS)



def bands_for(link: int, of: int) -> int:
    """Values of a band: as many as keep the chance of missing a pair at the threshold under MISS."""
    fits = [r for r in range(1, 13) if (1 - (link / of) ** r) ** (2 * PERMS // r) <= MISS]
    return max(fits, default=1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the runs of size words of each row, by row, and their rows."""
    (word,), at = V.words(data, offsets, V.SPACED)
    row = V.row_of(at)
    g = V.grams(word, size)
    inside = row[: len(g)] == row[size - 1 : size - 1 + len(g)]
    h, r = g[inside], row[: len(g)][inside]
    counts = np.diff(at)
    extra_h, extra_r = [], []
    for n in range(1, size):
        few = np.flatnonzero(counts == n)
        if len(few):
            total = np.full(len(few), np.uint64(n), dtype=np.uint64)
            for j in range(n):
                total += word[at[few] + j] * V._COEFF[3][j]
            extra_h.append(V.mix(total))
            extra_r.append(few)
    if extra_h:
        h, r = np.concatenate([h, *extra_h]), np.concatenate([r, *extra_r])
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[fresh], r[fresh]


def _signatures(columns: list[str], size: int, per_band: int):
    n_bands = 2 * PERMS // per_band
    deal = _DEAL[: n_bands * per_band].reshape(n_bands, per_band)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data, offsets in V.slices(batch.column("__text")):
                h, r = shingle_sets(data, offsets, size)
                rows, begin = np.unique(r, return_index=True)
                count = np.bincount(r, minlength=n).astype(np.int64)
                d1, d2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                bands = np.zeros((n, n_bands), np.uint64)
                sketch = np.zeros((n, 2 * PERMS), np.uint8)
                if len(h):
                    d1[rows] = np.add.reduceat(V.mix(h ^ np.uint64(0x1234567)), begin)
                    d2[rows] = np.add.reduceat(V.mix(h + np.uint64(0x9E3779B9)), begin)
                    values = np.empty((2 * PERMS, len(rows)), np.uint64)
                    for p in range(PERMS):
                        moved = h * _MULTIPLY[p] + _ADD[p]
                        values[2 * p] = np.minimum.reduceat(moved, begin)
                        values[2 * p + 1] = np.maximum.reduceat(moved, begin)
                    total = np.zeros((n_bands, len(rows)), np.uint64)
                    for k in range(per_band):
                        total = V.mix(total + values[deal[:, k]] * V._COEFF[2][k])
                    bands[rows] = total.T
                    sketch[rows] = (V.mix(values) & np.uint64(255)).astype(np.uint8).T
                kept = np.flatnonzero(count > 0)
                ends = np.concatenate([[0], np.cumsum((count > 0) * n_bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, n) for c in columns), pa.array(count), pa.array(_as_long(d1)), pa.array(_as_long(d2)), pa.ListArray.from_arrays(pa.array(ends), pa.array(_as_long(np.ascontiguousarray(bands[kept].ravel())))), pa.array([r.tobytes() for r in sketch], pa.binary())],
                    names=[*columns, "n", "a", "b", "bands", "sketch"],
                )

    return run


def _sets(size: int, wanted):
    """Of the rows whose __id the bitmap wanted holds: the sorted hashes of the text's set (8 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = whole.filter(pa.array(_in(wanted.value, np.asarray(whole.column("__id")).view(np.uint64))))
            for first, n, data, offsets in V.slices(batch.column("__text")):
                h, r = shingle_sets(data, offsets, size)
                raw, ends = h.tobytes(), 8 * np.searchsorted(r, np.arange(n + 1))
                sets = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, n) for c in ("__key", "__th")), pa.array(sets, pa.binary())], names=["__key", "__th", "hashes"])

    return run


def _arrays(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _confirm(link: int, of: int):
    """Of pairs with both sets (sa, sb): those that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 512):
                batch = whole.slice(start, 512)
                n = len(batch)
                sides = [_arrays(batch.column(name)) for name in ("sa", "sb")]
                h = np.concatenate([x for side in sides for x in side])
                r = np.repeat(np.tile(np.arange(n), 2), [len(x) for side in sides for x in side])
                order = np.lexsort((h, r))
                h, r = h[order], r[order]
                both = np.bincount(r[1:][(h[1:] == h[:-1]) & (r[1:] == r[:-1])], minlength=n)
                union = np.bincount(r, minlength=n) - both
                linked = pa.array((of * both >= link * union) & (union > 0))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(linked) for c in ("x", "y")], names=["x", "y"])

    return run


def _least_agreement(link: int, of: int) -> int:
    """Bytes of two sketches that agree at least when the sets are linked, but for SIGMAS deviations."""
    s = link / of
    return int(2 * PERMS * s - SIGMAS * (2 * PERMS * s * (1 - s)) ** 0.5)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2 * PERMS)


def _near(link: int, of: int):
    """Of pairs with both sketches: those that may be linked."""
    least = _least_agreement(link, of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            agree = (_matrix(batch.column("sx")) == _matrix(batch.column("sy"))).sum(axis=1) if len(batch) else np.zeros(0)
            sure = pa.array(agree >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(sure) for c in ("x", "y")], names=["x", "y"])

    return run


def _across(link: int, of: int):
    """Of the members of two blocks of a bucket: links that join its components, confirmed on the full sets.

    Each member outside the largest component is compared with all of larger or earlier ones, by
    sketch and then by set; members that a link has joined are not compared again. So a task gives
    out fewer links than it has members, however many pairs it has looked at.
    """
    least = _least_agreement(link, of)

    def run(key, table):
        block, root, n, ids = (np.asarray(table.column(c)) for c in ("block", "root", "n", "c"))
        apart = key[1].as_py() != key[2].as_py()
        _, of_root, sizes = np.unique(root, return_inverse=True, return_counts=True)
        place = np.empty(len(sizes), np.int64)
        place[np.argsort(-sizes, kind="stable")] = np.arange(len(sizes))
        order = np.argsort(place[of_root], kind="stable")
        block, n, ids, comp = block[order], n[order], ids[order], place[of_root][order]
        start = np.searchsorted(comp, comp)  # the members before it are in larger or earlier components
        sketch, hashes = _matrix(table.column("sketch"))[order], None
        xs, ys = [], []
        for i in np.flatnonzero(comp > 0).tolist():
            stop = int(start[i])
            fits = (of * np.minimum(n[:stop], n[i]) >= link * np.maximum(n[:stop], n[i])) & (comp[:stop] != comp[i])
            if apart:
                fits &= block[:stop] != block[i]
            at = np.flatnonzero(fits)
            at = at[(sketch[at] == sketch[i]).sum(axis=1) >= least]
            if not len(at):
                continue
            if hashes is None:  # numbers from 0 for the hashes of this task
                hashes = _arrays(table.column("hashes"))
                hashes = [hashes[k] for k in order.tolist()]
                _, number = np.unique(np.concatenate(hashes), return_inverse=True)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in hashes])])
                own = np.zeros(int(number.max()) + 1, bool)
            mine = number[ends[i] : ends[i + 1]]
            own[mine] = True
            for k in range(0, len(at), 256):
                some = at[k : k + 256]
                sizes_of = n[some]
                begins = np.concatenate([[0], np.cumsum(sizes_of)[:-1]])
                both = np.add.reduceat(own[np.concatenate([number[ends[j] : ends[j + 1]] for j in some.tolist()])].astype(np.int64), begins)
                for j in some[of * both >= link * (n[i] + sizes_of - both)].tolist():
                    if comp[j] != comp[i]:
                        xs.append(ids[i])
                        ys.append(ids[j])
                        comp[comp == comp[i]] = comp[j]
            own[mine] = False
        return pa.table({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64())})

    return run


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's edges (x, y): each end (c) and the least of its component in this partition (root)."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(up.setdefault(x, x) if x not in up else x), top(up.setdefault(y, y) if y not in up else y)
            if a != b:
                up[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([top(x) for x in up], pa.int64())], names=["c", "root"])


def components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """(c, root) for all ends of edges (x, y) of numbers; root is the least of the component.

    Each partition finds the components of its own edges. An end that got different roots in
    different partitions links these; those links, between roots only, are a smaller graph of the
    same kind.
    """
    local = keep(edges, "edges").mapInArrow(_forest, "c long, root long")
    ends = keep(local.groupBy("c").agg(F.sort_array(F.collect_set("root")).alias("roots")), "ends")  # one of each partition at most
    own = ends.select("c", F.col("roots")[0].alias("root"))
    links = ends.filter(F.size("roots") > 1).select(F.col("roots")[0].alias("y"), F.explode(F.slice("roots", F.lit(2), F.size("roots") - 1)).alias("x"))
    if links.limit(1).count() == 0:
        return own
    above = components(links.select("x", "y").distinct(), keep)
    return own.join(above.select(F.col("c").alias("root"), F.col("root").alias("top")), "root", "left").select("c", F.coalesce("top", "root").alias("root"))


class _Linker:
    """Links between classes (c: their number, n: size of the set, sketch, bands, rep: a row that has the set)."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, link: int, of: int):
        self.docs, self.classes, self.size, self.link, self.of = docs, classes, size, link, of
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        """df, written down until clear()."""
        self.kept.append(materialize(df, tag))
        return self.kept[-1]

    def clear(self) -> None:
        for df in self.kept:
            drop_materialized(df)

    def sets(self, need: DataFrame) -> DataFrame:
        """c, hashes: the full sets of the classes that need (c) names."""
        spark = need.sparkSession
        need = need.distinct().join(self.classes.select("c", "rep"), "c")
        need = self.keep(need.select("c", F.col("rep.key").alias("key"), F.col("rep.th").alias("th")), "need")
        wanted = spark.sparkContext.broadcast(_bitmap(need.select(F.xxhash64("key", "th").alias("id")), "id"))
        kind = self.docs.schema["__key"].dataType.simpleString()
        some = self.docs.select("*", F.xxhash64("__key", "__th").alias("__id"))
        some = some.mapInArrow(_sets(self.size, wanted), f"__key {kind}, __th long, hashes binary")
        found = need.join(some, need["key"].eqNullSafe(some["__key"]) & (need["th"] == some["__th"])).select("c", "hashes")
        # rows that are there several times have the same set
        return self.keep(found, "sets").dropDuplicates(["c"])

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs (x, y) whose full sets are linked."""
        pairs = self.keep(pairs, "pairs")
        sets = self.sets(pairs.select(F.col("x").alias("c")).union(pairs.select("y")))
        with_x = pairs.join(sets.select(F.col("c").alias("x"), F.col("hashes").alias("sa")), "x")
        both = with_x.join(sets.select(F.col("c").alias("y"), F.col("hashes").alias("sb")), "y").select("x", "y", "sa", "sb")
        return self.keep(both.mapInArrow(_confirm(self.link, self.of), "x long, y long"), "links")

    def run(self) -> DataFrame:
        """(c, root) of the classes that are linked with another."""
        buckets = self.classes.select("c", "n", F.posexplode("bands").alias("k", "v")).select("c", "n", F.xxhash64("k", "v").alias("key"))
        centres = buckets.groupBy("key").agg(F.min("c").alias("y"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("key", "y")
        members = self.keep(buckets.join(centres, "key"), "members")
        sketches = self.classes.select("c", "n", "sketch")
        pairs = members.filter("c <> y").select(F.col("c").alias("x"), "y").distinct()
        pairs = pairs.join(sketches.select(F.col("c").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("sx")), "x")
        pairs = pairs.join(sketches.select(F.col("c").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("sy")), "y")
        pairs = pairs.filter(self.of * F.least("nx", "ny") >= self.link * F.greatest("nx", "ny")).select("x", "y", "sx", "sy")
        links = self.confirm(pairs.mapInArrow(_near(self.link, self.of), "x long, y long"))

        rooted = members.select("key", "c", "n").join(components(links, self.keep), "c", "left").select("key", "c", "n", F.coalesce("root", "c").alias("root"))
        rooted = self.keep(rooted, "rooted")
        split = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
        split = split.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.sum("m").alias("m"), F.sum("n").alias("n"))
        blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int")
        split = split.filter("roots > 1").select("key", blocks.alias("blocks"))
        mixed = self.keep(rooted.join(split, "key").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")), "mixed")
        mixed = mixed.drop("n").join(self.keep(sketches.join(self.sets(mixed.select("c")), "c"), "compared"), "c")
        others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("lo"), F.greatest("block", j).alias("hi")))
        columns = ["c", "root", "n", "block", "sketch", "hashes"]
        mixed = mixed.select("key", *columns, F.explode(others).alias("p")).select("key", "p.lo", "p.hi", *columns)
        more = mixed.groupBy("key", "lo", "hi").applyInArrow(_across(self.link, self.of), "x long, y long")
        return components(links.unionByName(more), self.keep)


def _grouped(docs: DataFrame, key: str, text: str, size: int, link: int, of: int) -> DataFrame:
    """__key, __th, set (hashes, size), root, component of each row; root is null without a word."""
    ship(docs.sparkSession)
    source = docs.select(F.col(f"`{key}`").alias("__key"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("__th"), F.col(f"`{text}`").alias("__text"))
    kind = source.schema["__key"].dataType.simpleString()
    signed = source.mapInArrow(_signatures(["__key", "__th"], size, bands_for(link, of)), f"__key {kind}, __th long, n long, a long, b long, bands array<long>, sketch binary")
    signed = materialize(signed.select("__key", "__th", F.struct("a", "b", "n").alias("set"), "bands", "sketch"), "signatures")
    rep = F.min(F.struct(F.col("__key").alias("key"), F.col("__th").alias("th"))).alias("rep")
    classes = signed.filter(F.col("set.n") > 0).groupBy("set").agg(rep, F.min("__key").alias("least"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    # numbers that are written down with the classes, so they stay the same
    classes = materialize(classes.select("*", F.col("set.n").alias("n"), F.monotonically_increasing_id().alias("c")), "classes")
    linker = _Linker(source, classes, size, link, of)
    by_class = classes.select("c", "set", "least").join(linker.run(), "c", "left").select("set", "least", F.coalesce("root", "c").alias("root"))
    of_root = by_class.groupBy("root").agg(F.min("least").alias("component"))
    of_class = materialize(by_class.join(of_root, "root").select("set", "root", "component"), "components")
    linker.clear()
    drop_materialized(classes)
    return signed.select("__key", "__th", "set").join(of_class, "set", "left")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, link: int = LINK, of: int = OF) -> DataFrame:
    """key, n_shingles, component_id, kept: a row per row of docs."""
    component = F.when(F.col("set.n") > 0, F.col("component")).otherwise(F.col("__key"))
    return _grouped(docs, key, text, size, link, of).select(
        F.col("__key").alias(key), F.col("set.n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("__key"), F.lit(False)).alias("kept")
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, link: int = 80, of: int = 100) -> DataFrame:
    """docs with one row of each group of near-duplicates: that with the least key (a null key only
    where there is no other), then the least hash of its text. Wordless texts all stay."""
    grouped = _grouped(docs, key, text, size, link, of).filter(F.col("set.n") > 0)
    place = F.struct(F.col("__key").isNull().alias("none"), F.col("__key").alias("key"), F.col("__th").alias("th"))
    rows = grouped.groupBy("root", "__key", "__th").agg(F.count(F.lit(1)).alias("copies"))
    first = rows.groupBy("root").agg(F.min(place).alias("first"))
    rows = materialize(rows.join(first, "root").select("__key", "__th", "copies", (place == F.col("first")).alias("stays")), "verdicts")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    whole = whole.select("__row", F.xxhash64(F.coalesce(F.col(f"__row.`{text}`"), F.lit(""))).alias("__th"))

    def on(r: DataFrame):
        return whole["__row"][key].eqNullSafe(r["__key"]) & (whole["__th"] == r["__th"])

    # rows that are there several times are taken out with the rest, and one of each is put back
    gone = rows.filter("NOT stays OR copies > 1")
    out = whole.join(gone, on(gone), "left_anti").select("__row.*")
    again = rows.filter("stays AND copies > 1")
    if again.limit(1).count():
        one = whole.join(again, on(again), "left_semi").groupBy(F.col("__row")[key].alias("k"), "__th").agg(F.first("__row").alias("__row"))
        out = out.unionByName(one.select("__row.*"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
