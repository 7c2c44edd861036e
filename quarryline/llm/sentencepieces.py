"""SentencePiece BPE encoding by a prefix table, and decoding.

For each prefix of a chunk the table keeps the one token that its encoding ends with. The tokens
that end at a place come from an automaton over all pieces; a token goes in if it is compatible
with the token that its start's prefix ends with, i.e. if merging the two tokens' text would give
just these two. The ids are then read backwards. Time grows linearly with a chunk.

A chunk is a run of spaces with the characters of one class after it. No piece has a space after
another character; classes are the characters that pieces put side by side, directly or by way of
others (for this model the letters of a script, or the punctuation), and all that stand in no such
pair. No piece spans two classes, so merges never leave a chunk. Ids of chunks are kept in a cache
of two generations: a full one becomes the older one, from which chunks that are met again come back.

Defined results: a null text is empty; an empty text has no ids and decodes to an empty text; rows
are independent, so repeated rows, extra columns and empty tables need nothing special.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarryline.llm.common import read_table, ship

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Chunks in each of the two generations of a worker's cache, and the characters of the longest kept.
CACHE = 100_000
LONGEST = 256


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class PieceTable:
    """The pieces of one model and what is derived from them."""

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.piece: list[str] = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_of: dict[int, int] = {}
        self.byte_id: list[int] = [-1] * 256
        self.id: dict[str, int] = {}
        for i, p in enumerate(self.piece):
            if sp.is_byte(i):
                b = int(p[3:5], 16)
                self.byte_of[i], self.byte_id[b] = b, i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[p] = i
        # priority of the merge that makes a piece: less is earlier; single characters are never merged
        self.rank = {i: (-1.0 if len(p) == 1 else -sp.get_score(i)) for p, i in self.id.items()}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.known = {p for p in self.id if len(p) == 1}
        breaks = "\n" if "\n" not in self.known else ""
        classes = ["".join(map(re.escape, sorted(c))) for c in self._classes()]
        runs = [f"{SPACE}*[{c}]+" for c in classes] + [f"{SPACE}*[^{''.join(classes)}{SPACE}{breaks}]+", f"{SPACE}+"]
        self.chunks = re.compile("|".join(runs + [breaks] * bool(breaks))).findall
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.length = [len(p) for p in self.piece]
        self.number = [str(i) for i in range(len(self.piece))]
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.piece))]
        self.bytes = [bytes((self.byte_of[i],)) if i in self.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.piece)]

    def _classes(self) -> list[list[str]]:
        """Characters that pieces put side by side, directly or by way of others; the largest class first."""
        over: dict[str, str] = {}

        def top(c: str) -> str:
            while over.setdefault(c, c) != c:
                c = over[c]
            return c

        for p in self.id:
            word = p.lstrip(SPACE)
            for a, b in zip(word, word[1:], strict=False):
                over[top(a)] = top(b)
        found: dict[str, list[str]] = {}
        for c in over:
            found.setdefault(top(c), []).append(c)
        return sorted(found.values(), key=lambda c: (-len(c), min(c)))

    def _last_merge(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge joins into this one; (-1, -1): never made; None: one character."""
        if token in self.halves:
            return self.halves[token]
        parts = [self.id.get(c, -1) for c in self.piece[token]]
        last = None
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                if parts[k] < 0 or parts[k + 1] < 0:
                    continue
                joined = self.id.get(self.piece[parts[k]] + self.piece[parts[k + 1]])
                if joined is not None and (best is None or self.rank[joined] < best[0]):
                    best = (self.rank[joined], k, joined)
            if best is None:
                last = (-1, -1)
                break
            last = (parts[best[1]], parts[best[1] + 1])
            parts[best[1] : best[1] + 2] = [best[2]]
        self.halves[token] = last
        return last

    def _reached(self, token: int) -> bool:
        return self._last_merge(token) != (-1, -1)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the text of both is encoded as left, right: undoes both sides' merges, latest first,
        and looks whether the tokens that then meet would have been joined before. As left, the number of
        pieces stands for the start of the text and -1 for a prefix without a token."""
        key = left << 20 | right
        known = self.fits.get(key)
        if known is None:
            known = left >= 0 and self._reached(right) and (left == len(self.piece) or self._meet(left, right))
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[key] = known
        return known

    def _meet(self, left: int, right: int) -> bool:
        before, equal = float("inf"), False  # a join across is earlier if its rank is less, or equal where that counts
        while True:
            joined = self.id.get(self.piece[left] + self.piece[right])
            if joined is not None:
                r = self.rank[joined]
                if r < before or (equal and r == before):
                    return False
            a, b = self._last_merge(left), self._last_merge(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and self.rank[left] > self.rank[right]):
                before, equal, left = self.rank[left], False, a[1]  # of equal ranks the one further left is first
            else:
                before, equal, right = self.rank[right], True, b[0]

    def _run(self, text: str) -> list[int]:
        """ids of a run of known characters; none if a character is unknown."""
        end = len(text) - 1
        last = [-1] * len(text) + [len(self.piece)]  # by the place of a prefix's last character; at -1 the start
        known, compatible = self.fits.get, self.compatible
        for at, (token, length) in self.automaton.iter(text):
            if last[at] < 0:  # only one token can end a prefix
                before = last[at - length]
                ok = known(before << 20 | token)
                if ok is None:
                    ok = compatible(before, token)
                if ok:
                    last[at] = token
        if -1 in last:
            return []
        length_of = self.length
        ids = []
        while end >= 0:
            token = last[end]
            ids.append(token)
            end -= length_of[token]
        ids.reverse()
        return ids

    def encode_chunk(self, chunk: str) -> list[int]:
        ids = self._run(chunk)
        if ids:
            return ids
        run = ""
        for c in chunk:
            if c in self.known:
                run += c
                continue
            if run:
                ids += self._run(run)
                run = ""
            ids += [self.byte_id[b] for b in c.encode()]
        return ids + self._run(run) if run else ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return [i for c in self.chunks(SPACE + text.replace(" ", SPACE)) for i in self.encode_chunk(c)]

    def raw(self, ids) -> bytes:
        """The UTF-8 bytes of ids, spaces as spaces, the first one included."""
        out = self.bytes
        return b"".join([out[i] for i in ids])

    def decode(self, ids) -> str:
        """The text of ids without the space that encoding put in front."""
        out = self.raw(ids)
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")

    def entry(self, chunk: str) -> bytes:
        """The ids of a chunk as 32-bit numbers."""
        found = self.older.get(chunk)
        if found is None:
            found = b"".join([self.packed[i] for i in self.encode_chunk(chunk)])
        if len(chunk) <= LONGEST:
            if len(self.cache) >= CACHE:
                self.older = self.cache.copy()
                self.cache.clear()  # in place, since entries() holds its get
            self.cache[chunk] = found
        return found

    def entries(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers."""
        if not text:
            return b""
        get, make = self.cache.get, self.entry
        return b"".join([get(c) or make(c) for c in self.chunks(SPACE + text.replace(" ", SPACE))])


@lru_cache(maxsize=2)
def piece_table(model: str) -> PieceTable:
    return PieceTable(model)


def _digest_row(table: PieceTable, text: str | None) -> tuple[int, str, str]:
    ids = _numbers(table.entries(text or ""))
    number = table.number
    return len(ids), hashlib.sha256(",".join([number[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(table.raw(ids)[1:]).hexdigest()


def _numbers(packed: bytes) -> list[int]:
    return np.frombuffer(packed, dtype="<i4").tolist()


def _key_columns(docs: DataFrame, keys: list[str], text: str):
    return docs.select(*keys, docs[text].alias("__text"))


def digests(docs: DataFrame, keys: list[str], text: str = "text", model: str | None = None) -> DataFrame:
    """keys, n_tokens, ids_sha256, decoded_sha256 of each row."""
    ship(docs.sparkSession)
    model = model or default_model()
    chosen = _key_columns(docs, keys, text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model)
        for batch in batches:
            rows = [_digest_row(table, t) for t in batch.column("__text").to_pylist()]
            n, ids, raw = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())],
                names=[*keys, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return chosen.mapInArrow(run, f"{fields}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenize(docs: DataFrame, keys: list[str], text: str = "text", model: str | None = None) -> DataFrame:
    """keys, ids (array of int), decoded text of each row."""
    ship(docs.sparkSession)
    model = model or default_model()
    chosen = _key_columns(docs, keys, text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                ids = [table.entries(t or "") for t in batch.column("__text").to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                decoded = [table.raw(_numbers(x))[1:].decode() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in keys), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(decoded, pa.string())],
                    names=[*keys, "ids", "decoded"],
                )

    return chosen.mapInArrow(run, f"{fields}, ids array<int>, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
