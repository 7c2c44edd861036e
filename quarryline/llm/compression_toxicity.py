"""Toxicity by compression distance to two zstandard dictionaries.

A text is folded (A-Z to a-z, all below 0x80 but letters and digits to one space) and cut at spaces
into windows of WINDOW bytes or a little more. Each window is compressed as it is with both
dictionaries. The shares of a document's windows for which the toxic one saves so many bytes or more
(THRESHOLDS) become its score, with weights that are calibrated on labelled rows that the
dictionaries have not seen.

The ordinary dictionary is trained by the library (COVER) on windows of ordinary text. The toxic one
is the same content followed by what the library trains on the residue of toxic windows: stretches
of runs of GRAM bytes that toxic texts hold RATIO times as often as ordinary ones. Without the residue both
would be filled with the same frequent syllables. Both are used as raw content, since the tables of
code lengths that the library adds differ by more than a window's savings.

Labels are learnt from a bounded sample: the SAMPLE labelled rows with the least hash of their id,
of those whose crc32(doc_id as text) mod 5 is not 0. Remainders 1 to 3 train the dictionaries, from
distinct texts in the order of their hash up to LEARN_BYTES of each kind (a text that no longer fits
is passed over), 4 the calibration. Only the text goes into a score, and all of it.

Defined results: a null or wordless text has no windows and gets the score of a text without any
that counts; a text's length has no bound; null ids belong to no fold (held_out is false) and are
not learnt from; a doc_id with several label rows counts with each; repeated rows each get a row;
without labels of both kinds, or where toxic texts share no such stretch (LEAST_DOCS of them, fewer
where there are under 250), every score is 0; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import vectors as V
from quarryline.llm.common import materialize, read_table, ship

WINDOW = 32
#: Labelled rows that are learnt from, at most, and bytes of training text: ordinary and toxic.
SAMPLE = 20_000
LEARN_BYTES = (5 << 20, 2 << 20)
#: Bytes of the ordinary dictionary, and of the part that the toxic one has besides.
ORDINARY_BYTES, TOXIC_BYTES = 64 << 10, 1 << 10
#: Windows that the ordinary dictionary is trained on: with more the library fills it with rare ones.
ORDINARY_WINDOWS = 40_000
#: Residue: runs of so many bytes, in so many toxic texts at least, so many times as often as in ordinary ones.
GRAM, LEAST_DOCS, RATIO = 7, 5, 8.0
#: Bytes that a window must save to count: each threshold has a weight of its own.
THRESHOLDS = (2, 3, 4, 5)
#: Matches of fewer bytes are not looked for: they are mere syllables.
LEAST_MATCH = 6

_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if V.ALNUM[c] else 32 for c in range(256))


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def windows(text: bytes) -> list[bytes]:
    """Windows of a text, each with a space at both ends."""
    folded = b" " + b" ".join(text.translate(_FOLD).split()) + b" "
    out, at, end = [], 0, len(folded) - 1
    while at < end:
        cut = folded.find(b" ", at + WINDOW)
        cut = end if cut < 0 else cut
        out.append(folded[at : cut + 1])
        at = cut
    return out


def _compressor(content: bytes):
    import zstandard as z

    how = z.ZstdCompressionParameters(
        window_log=18, hash_log=17, chain_log=17, search_log=5, min_match=LEAST_MATCH, target_length=32, strategy=z.STRATEGY_DFAST, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    content = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=how)
    return z.ZstdCompressor(compression_params=how, dict_data=content).compress


def _savings(ordinary: bytes, toxic: bytes, columns: list[str]):
    """columns, shares (of the windows, those that save each threshold's bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, harsh = _compressor(ordinary), _compressor(toxic)
        limits = np.array(THRESHOLDS)[:, None]
        for batch in batches:
            for first, n, data, offsets in V.slices(batch.column("__text")):
                raw, ends = data.tobytes(), offsets.tolist()
                shares = np.zeros((n, len(THRESHOLDS)))
                for row in range(n):
                    saved = np.array([len(plain(w)) - len(harsh(w)) for w in windows(raw[ends[row] : ends[row + 1]])])
                    if len(saved):
                        shares[row] = (saved >= limits).mean(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(THRESHOLDS)), pa.array(shares.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, n) for c in columns), lists], names=[*columns, "shares"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold(key):
    return F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(5))


# ---- the dictionaries


def _grams(windows_of: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows' bytes one after the other, a number for the run of GRAM bytes at each place (0: crosses a border), and its text."""
    flat = [w for ws in windows_of for w in ws]
    data = np.frombuffer(b"".join(flat), np.uint8)
    sizes = np.array([len(w) for w in flat], np.int32)
    left = np.repeat(np.cumsum(sizes, dtype=np.int32), sizes) - np.arange(len(data), dtype=np.int32)
    code = np.zeros(len(data), np.uint64)
    for k in range(min(GRAM, 8)):
        code[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(8 * k)
    code[left < GRAM] = 0
    owner = np.repeat(np.repeat(np.arange(len(windows_of), dtype=np.int32), [len(ws) for ws in windows_of]), sizes)
    return data, code, owner


def _frequency(code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes (but 0) and the number of texts that hold each."""
    order = np.lexsort((owner, code))
    c, o = code[order], owner[order]
    fresh = c != 0
    fresh[1:] &= (c[1:] != c[:-1]) | (o[1:] != o[:-1])
    return np.unique(c[fresh], return_counts=True)


def marks(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> np.ndarray:
    """Runs of GRAM bytes that toxic texts hold far more often than ordinary ones."""
    grams, c1 = _frequency(*_grams(toxic)[1:])
    known, c0 = _frequency(*_grams(ordinary)[1:])
    at = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
    c0 = np.where(known[at] == grams, c0[at], 0) if len(known) else np.zeros(len(grams))
    least = max(2, min(LEAST_DOCS, len(toxic) // 50))
    rate = ((c1 + 0.5) / (len(toxic) + 1)) / ((c0 + 0.5) / (len(ordinary) + 1))
    return grams[(c1 >= least) & (rate >= RATIO)]


def residue(texts: list[list[bytes]], marked: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Of the windows that hold a marked run: the stretches that such runs cover; and the other windows."""
    data, code, _ = _grams(texts)
    at = np.flatnonzero(np.isin(code, marked) & (code != 0))
    inside = np.zeros(len(data) + GRAM, bool)
    for k in range(GRAM):
        inside[at + k] = True
    held, others, begin = [], [], 0
    for w in (w for ws in texts for w in ws):
        mine = inside[begin : begin + len(w)]
        if mine.any():
            text = np.where(mine, data[begin : begin + len(w)], 0).astype(np.uint8).tobytes()
            held.append(b" ".join(x for x in text.split(b"\0") if x))
        else:
            others.append(w)
        begin += len(w)
    return held, others


def dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """What the library trains; where it has too little to train on, the samples themselves."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, k=segment, d=8).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-size:]


def _training_texts(rows: DataFrame) -> dict[int, list[str]]:
    """Distinct texts of each label, by hash up to LEARN_BYTES."""
    rows = rows.filter("__fold <> 4 AND __text <> ''").withColumn("__th", F.xxhash64("__text"))
    sizes = rows.select("__th", "__y", F.octet_length("__text").alias("n")).distinct().orderBy("__th", "__y").collect()  # SAMPLE rows at most
    left, chosen = list(LEARN_BYTES), []
    for th, y, n in sizes:
        if n <= left[y]:
            left[y] -= n
            chosen.append((th, y))
    if not chosen:
        return {}
    wanted = F.broadcast(rows.sparkSession.createDataFrame(chosen, "__th long, __y int"))  # SAMPLE rows at most
    found: dict[int, dict] = {}
    for y, t in rows.withColumn("__y", F.col("__y").cast("int")).join(wanted, ["__th", "__y"]).select("__y", "__text").orderBy("__y", "__th").collect():  # LEARN_BYTES at most, but for copies
        found.setdefault(y, {})[t] = None
    return {y: list(ts) for y, ts in found.items()}


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    ship(docs.sparkSession)
    chosen = labels.select(F.col(key).alias("__key"), F.col(label).alias("__y")).filter(F.col("__key").isNotNull() & F.col("__y").isin(0, 1) & (fold(F.col("__key")) != 0))
    chosen = chosen.orderBy(F.xxhash64("__key"), "__y").limit(SAMPLE)
    chosen = F.broadcast(materialize(chosen, "sample"))  # SAMPLE rows at most
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(chosen, "__key")
    rows = materialize(rows.select("__key", "__y", "__text", fold(F.col("__key")).alias("__fold")), "learn")
    none = Model(b"", b"", ())
    texts = _training_texts(rows.dropDuplicates(["__text", "__y", "__fold"]))
    if len(texts) < 2:
        return none
    plain, harsh = ([w for w in (windows(t.encode()) for t in texts[y]) if w] for y in (0, 1))
    marked = marks(harsh, plain)
    left, flat = residue(harsh, marked)[0], residue(plain, marked)[1]
    if not left:
        return none
    order = np.random.Generator(np.random.PCG64(3)).permutation(len(flat))[:ORDINARY_WINDOWS]
    ordinary = dictionary([flat[k] for k in order], ORDINARY_BYTES, 32)
    toxic = ordinary + dictionary(left, TOXIC_BYTES, 16)
    held = rows.filter("__fold = 4").select("__y", "__text")
    kind = held.schema["__y"].dataType.simpleString()
    held = held.mapInArrow(_savings(ordinary, toxic, ["__y"]), f"__y {kind}, shares array<double>").collect()  # SAMPLE rows at most
    x = np.sqrt(np.array([r[1] for r in held]).reshape(-1, len(THRESHOLDS)))
    weights = _logistic(np.hstack([np.ones((len(x), 1)), x]), np.array([r[0] for r in held], float))
    return Model(ordinary, toxic, tuple(weights.tolist()))


def score(docs: DataFrame, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    """keys, score (0 to 1), predicted (0 or 1) of each row."""
    ship(docs.sparkSession)
    chosen = docs.select(*keys, F.col(text).alias("__text"))
    if not model.weights:
        return chosen.select(*keys, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    found = chosen.mapInArrow(_savings(model.ordinary, model.toxic, keys), f"{fields}, shares array<double>")
    z = sum((F.lit(w) * F.sqrt(F.col("shares")[k]) for k, w in enumerate(model.weights[1:])), F.lit(model.weights[0]))
    p = F.round(1 / (1 + F.exp(-z)), 9)
    return found.select(*keys, p.alias("score"), (p >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    out = score(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
