"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import balanced_shards, compression_toxicity, license_scan, line_dedup, minmax, pii_spans, quality_rules, queries, sentencepieces, winnowing, zip_archives
from tests.oracle import assert_same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{k % 997}" for k in range(30_000))
BASE = " ".join(f"term{k}" for k in range(60))
#: (doc_id, text, lang, source, n_words): odd rows, and a column that has the name of a result's.
ODD = [
    (1, None, "en", "a", 7),
    (2, "", None, None, 7),
    (3, "one two", "en", "a", None),
    (4, BASE, "en", "a", 7),
    (5, BASE, "en", "b", 7),
    (5, BASE, "en", "b", 7),
    (6, BASE + " extra", "en", "b", 7),
    (7, LONG, "de", "a", 7),
    (None, "Nobody knows this row", "en", "b", 7),
    (8, " \t\n\x0b ", "en", "a", 7),
    (9, BASE.upper(), "en", "a", 7),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_words long")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_quality_rules(spark, odd, none):
    got = quality_rules.assess(odd, ["doc_id"]).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert (by[1].n_words, by[1].base_failed, by[1].kept) == (0, True, False)
    assert by[4].n_words == 60 and by[4].kept
    assert by[7].n_repeat_words == 30_000 and by[7].base_failed
    assert quality_rules.assess(none, ["doc_id"]).count() == 0
    good = quality_rules.keep_good(odd)
    assert good.columns == odd.columns
    assert sorted(r.doc_id for r in good.collect()) == [4, 5, 5, 6, 9]
    assert quality_rules.keep_good(none).count() == 0


def test_bad_host_goes(spark):
    rows = [(k, "too short", "bad") for k in range(300)] + [(1000, BASE, "bad")] + [(2000 + k, f"{BASE} {k}", "good") for k in range(300)]
    got = {r.doc_id: r.kept for r in quality_rules.assess(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"]).collect()}
    assert not got[1000] and all(got[2000 + k] for k in range(300))


def test_sentencepiece_is_the_library(spark, odd, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    table = sentencepieces.piece_table(sentencepieces.default_model())
    rng = random.Random(2)
    parts = [" ", "   ", "\n", "\t", "a", "the", "ing", "é", "日本", "😀", "<s>", "<0x0A>", "▁", "\x00", "0", "==", "Hello", "'s", "한국"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(20))) for _ in range(3000)] + [LONG, "x" * 5000, " " * 100]
    for t in texts:
        ids = sp.encode(t)
        assert table.encode(t) == ids
        assert table.decode(ids) == sp.decode(ids)
    for r in sentencepieces.digests(odd, ["doc_id", "text"]).collect():
        ids = sp.encode(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    for r in sentencepieces.tokenize(odd, ["doc_id", "text"]).collect():
        assert r.ids == sp.encode(r.text or "") and r.decoded == sp.decode(r.ids)
    assert sentencepieces.digests(none, ["doc_id"]).count() == 0


def test_sentencepiece_encodes_a_word_once(monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    table = sentencepieces.PieceTable(sentencepieces.default_model())
    done = Counter()
    encode = table.encode_chunk
    monkeypatch.setattr(table, "encode_chunk", lambda c: done.update([c]) or encode(c))
    monkeypatch.setattr(sentencepieces, "CACHE", 10)
    texts = [f"often {a}{b}, often. (often) Привет, часто! 日本 z{a}" for a in "abcdefgh" for b in "ijklmnop"] + ["q" * 1000, "", "x▁y\n\n ", "12 345"]
    rows = [sentencepieces._digest_row(table, t) for t in texts]
    for t, (n, ids, raw) in zip(texts, rows, strict=True):
        want = sp.encode(t)
        assert (n, ids) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert raw == hashlib.sha256(sp.decode(want).encode()).hexdigest()
    assert done["▁often"] == 1  # with whatever punctuation, and however often the cache was full
    assert max(len(table.cache), len(table.older)) <= 10 and max(map(len, [*table.cache, *table.older])) <= sentencepieces.LONGEST
    rng = random.Random(6)
    parts = [*table.id, *table.known, *table.known, "日", "😀", "\n", " ", "7"]
    for t in ("".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(3000)):
        assert table.encode(t) == sp.encode(t)


def _brute_windows(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(len(w), 8)
        for k in range(len(w) - n + 1 if n else 0):
            if i is not None:
                grams[tuple(w[k : k + n])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


def test_winnowing_is_brute_force(spark, odd, none):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choices("abcd", k=n))
    items = [(k, text(rng.randrange(0, 30))) for k in range(25)] + [(None, text(20)), (98, None), (99, "one, TWO"), (7, "term0 term1 term2 term3 term4 term5 term6 term7")]
    docs = [(r[0], r[1]) for r in ODD if r[0] != 7] + [(100 + k, text(rng.randrange(0, 60))) for k in range(60)]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = [tuple(r) for r in winnowing.find(d, b).drop("__th").collect()]
    assert sorted(got, key=str) == _brute_windows(docs, items)
    assert winnowing.find(none, b).count() == 0
    assert winnowing.find(odd, b.limit(0)).filter("n_items > 0").count() == 0
    assert winnowing.clean(odd, b).columns == odd.columns


def test_one_item_is_a_leak(spark):
    item = " ".join(f"q{k}" for k in range(12))
    other = " ".join(f"r{k}" for k in range(12))
    rows = [(1, f"before {item} after"), (2, f"{BASE} {item[:23]}"), (3, item[:20]), (4, f"{item} {other}"), (5, BASE), (6, None), (None, f"x {other.upper()}"), (1, BASE)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    assert sorted(tuple(r) for r in winnowing.clean(d, b).fillna("").collect()) == [(1, BASE), (3, item[:20]), (5, BASE), (6, "")]
    assert winnowing.clean(d, b.limit(0)).count() == len(rows)
    flags = {(r.doc_id, r.n_items): r.contaminated for r in winnowing.find(d, b).collect()}
    assert flags[1, 1] is False and flags[4, 2] is True


def _sets(docs, size):
    out = []
    for _, t in docs:
        w = WORD.findall((t or "").translate(FOLD))
        out.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def _brute_components(docs, size, link, of):
    sets, up = _sets(docs, size), list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and of * both >= link * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    return sets, [top(i) for i in range(len(docs))]


def _copies(rng, groups, of_each):
    docs = []
    for g in range(groups):
        words = [f"g{g}x{rng.randrange(500)}" for _ in range(80)]
        for _ in range(of_each):
            own = list(words)
            for _ in range(rng.randrange(0, 7)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            docs.append(" ".join(own))
    return docs


def test_near_duplicates_are_brute_force(spark, odd, none):
    docs = [(r[0], r[1]) for r in ODD if r[0] is not None] + [(100 + k, t) for k, t in enumerate(_copies(random.Random(6), 6, 30))]
    sets, tops = _brute_components(docs, 3, 85, 100)
    least = {}
    for (d, _), t in zip(docs, tops, strict=True):
        least[t] = min(d, least.get(t, d))
    want = sorted((d, len(s), least[t] if s else d, d == (least[t] if s else d)) for (d, _), s, t in zip(docs, sets, tops, strict=True))
    got = sorted(tuple(r) for r in minmax.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == want
    assert minmax.near_duplicates(odd).count() == len(ODD)
    assert minmax.near_duplicates(none).count() == 0


def test_one_of_each_group_stays(spark, odd):
    kept = minmax.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 7, 8, None], key=str)


def test_three_line_windows(spark, odd, none):
    passage = "first line here\nsecond line here\nthird line here"
    rows = [(1, f"own top\n{passage}\nown end"), (2, f"{passage}\nother"), (3, passage), (4, None), (5, ""), (6, "first line here\nalone"), (2, f"{passage}\nother")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.k: r for r in line_dedup.dedup(d).select(F.col("__row.doc_id").alias("k"), "__lines", "__removed", "__clean").collect()}
    assert got[1]["__clean"] == rows[0][1]
    assert (got[2]["__clean"], got[2]["__removed"]) == ("other", 3)
    assert got[3]["__clean"] == "" and got[4]["__clean"] is None and got[6]["__removed"] == 0
    assert sorted(r.doc_id for r in line_dedup.without_repeats(d).collect()) == [1, 2, 2, 4, 5, 6]
    assert line_dedup.without_repeats(odd).columns == odd.columns
    assert line_dedup.without_repeats(none).count() == 0


def test_long_lines_are_windows_too(spark):
    line = " ".join(f"v{k}" for k in range(55))
    d = spark.createDataFrame([(1, f"a\n{line}\nb"), (2, f"c\n{line}\nd"), (3, "c\nd")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.without_repeats(d).collect()} == {1: f"a\n{line}\nb", 2: "c\nd", 3: "c\nd"}


def test_shards(spark, odd, none):
    docs = [(100 + k, f"text {k % 400 if k % 3 else 0}") for k in range(1500)] + [(r[0], r[1]) for r in ODD]
    got = balanced_shards.assign(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    slots, groups = defaultdict(list), defaultdict(set)
    text = dict(docs)
    for r in got:
        slots[r.shard].append(r.slot)
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        groups[raw].add(r.shard)
    counts = [len(s) for s in slots.values()]
    assert len(got) == len(docs) and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    whole = [len(s) == 1 for raw, s in groups.items() if raw != b"text 0"]
    assert sum(whole) >= 0.95 * len(whole)
    # links between different shards, pair by pair; the large group does not fit into one shard
    place = defaultdict(list)
    for r in got:
        place[(text[r.doc_id] or "").encode()].append(r.shard)
    cut = {raw: sum(a != b for k, a in enumerate(s) for b in s[:k]) for raw, s in place.items()}
    links = {raw: len(s) * (len(s) - 1) // 2 for raw, s in place.items()}
    assert sum(n for raw, n in cut.items() if raw != b"text 0") <= 0.1 * sum(n for raw, n in links.items() if raw != b"text 0")
    assert sum(cut.values()) <= 7 / 8 * sum(links.values())
    assert balanced_shards.assign(none).count() == 0


def test_zip_reader_against_the_standard_library(tmp_path):
    import io
    import zipfile

    for big in (False, True):
        raw = b"".join(zip_archives.zip_bytes([("a/x", b"12345" * 1000), ("b", b"")], big))
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            assert z.read("a/x") == b"12345" * 1000 and z.testzip() is None
        found = zip_archives.zip_members(lambda n, at, raw=raw: raw[at : at + n], len(raw))
        at, n = found["a/x"]
        assert raw[at : at + n] == b"12345" * 1000 and set(found) == {"a/x", "b"}
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("k", b"own")
        z.comment = b"a comment"
    raw = buffer.getvalue()
    at, n = zip_archives.zip_members(lambda n, at: raw[at : at + n], len(raw))["k"]
    assert raw[at : at + n] == b"own"
    with pytest.raises(ValueError):
        zip_archives.zip_members(lambda n, at: b"x" * n, 100)


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/\n", "<p>small</p>"), (2, None, "<p>small</p>"), (3, "u", big), (9, "u", big), (9, "u", big), (4, "u", None), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/zips"
    got = zip_archives.read_archives(spark, zip_archives.write_archives(pages, folder), folder).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in got) == sorted(
        [("1", 12, "response", None), ("2", 12, "response", None), ("3", 1200, "revisit", 9), ("9", 1200, "response", None), ("9", 1200, "response", None), ("4", 0, "response", None), ("None", 1200, "revisit", 9)]
    )
    assert {r.page_id: bytes(r.payload) for r in got if r.page_id == 9} == {9: big.encode()}
    assert zip_archives.read_archives(spark, zip_archives.write_archives(pages.limit(0), folder + "0"), folder + "0").count() == 0


def _brute_pii(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m.group())
        if 14 <= len(d) <= 19 and pii_spans.luhn(d):
            found.append((m.start(), 2, m.end()))
    return sorted(found + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15])


def test_pii_patterns_are_the_plain_ones():
    rng = random.Random(8)
    for _ in range(20_000):
        t = "".join(rng.choices("0123456789" * 2 + "..@@++--  ()ab%é", k=rng.randrange(40)))
        assert pii_spans.pattern_spans(t) == _brute_pii(t)
    assert pii_spans.pattern_spans("a" * 200_000 + "1" * 200_000) == []


def test_pii_field(spark, odd, none):
    field = pii_spans.Field()
    field.learn(pii_spans._examples([], random.Random(5)))
    spans = lambda t: [(pii_spans.KINDS[k], t[a:b]) for a, k, b in pii_spans.added_spans(t, field, pii_spans.pattern_spans(t))]
    assert spans("write to ann.lee [at] mail3.example.com today") == [("email", "ann.lee [at] mail3.example.com")]
    assert spans("call (415) 555-0134 today") == [("phone", "(415) 555-0134")]
    assert spans("on 2024-10-11 order 4111111111111112 cost 12345678.90") == []
    got = pii_spans.find(odd, field, ["doc_id"]).collect()
    assert len(got) == len(ODD) and {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    one = pii_spans.find(spark.createDataFrame([(1, "é a.b@c.de 10.0.0.1")], "doc_id long, text string"), field, ["doc_id"]).first()
    assert (one.n_email, one.n_ip, one.spans) == (1, 1, "email:2:10,ip:11:19")
    assert pii_spans.find(none, field, ["doc_id"]).count() == 0


def _every_segmentation(text, field, blocked):
    """The best score and spans of all segmentations of all tokens of a text, one by one."""
    borders = [0, *(m.end() for m in pii_spans._TOKEN.finditer(text))]
    n = len(borders) - 1
    entities = defaultdict(list)
    for i in range(n):
        if not (text[borders[i]].isalnum() or text[borders[i]] in "+("):
            continue
        for j in range(i + 1, min(n, i + pii_spans.MAX_TOKENS) + 1):
            a, b = borders[i], borders[j]
            if text[b - 1].isalnum() and not any(x < b and y > a for x, y in blocked):
                f = pii_spans.span_features(text, a, b)
                if f is not None:
                    entities[i].append((j, field.scores([(i, j, f)])[0]))

    def ways(i, prev):
        if i == n:
            yield 0.0, ()
            return
        for v, rest in ways(i + 1, 4):
            yield field.follow[prev][4] + v, rest
        for j, s in entities[i]:
            for kind in range(4):
                for v, rest in ways(j, kind):
                    yield field.follow[prev][kind] + s[kind] + v, ((borders[i], kind, borders[j]), *rest)

    return max(ways(0, 4), key=lambda w: w[0])


class _AnyWeights(dict):
    """A weight between -1 and 2 for every feature."""

    def get(self, key, default=None):
        return np.array([zlib.crc32(f"{key} {k}".encode()) % 1000 for k in range(4)]) / 333 - 1


def test_pii_field_is_the_best_of_all_segmentations():
    follow = np.array([[zlib.crc32(f"{a} {b}".encode()) % 100 / 50 - 1 for b in range(5)] for a in range(5)])
    field = pii_spans.Field(_AnyWeights(), follow)
    rng = random.Random(12)
    parts = ["a", "bo", " ", "@", "[at]", ".", "12", "4155550134", "+", "(", ")", "-", "10.2.3.4", "x@y.de"]
    seen = 0
    for _ in range(300):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 7)))
        if len(pii_spans._TOKEN.findall(text)) > 11:  # their number doubles with each token
            continue
        base = pii_spans.pattern_spans(text)
        value, spans = _every_segmentation(text, field, [(a, b) for a, _, b in base])
        got = pii_spans.added_spans(text, field, base)
        seen += len(spans)
        if got != list(spans):  # two segmentations may be equally good
            borders = [0, *(m.end() for m in pii_spans._TOKEN.finditer(text))]
            at, prev, total = 0, 4, 0.0
            by = {a: (k, b) for a, k, b in got}
            while at < len(text):
                kind, end = by.get(at, (4, borders[borders.index(at) + 1]))
                total += field.follow[prev][kind] + (field.scores([(0, 0, pii_spans.span_features(text, at, end))])[0][kind] if kind < 4 else 0)
                at, prev = end, kind
            assert total == pytest.approx(value)
    assert seen > 20


def test_pii_in_long_texts_without_spaces():
    field = pii_spans.Field()
    field.learn(pii_spans._examples([], random.Random(5)))
    for piece in ("x" * 130 + "name[at]host[dot]org,", "é" * 140 + "x@", "(" * 50):
        text = (piece * (1 << 20))[: 1 << 20]
        began = time.time()
        spans = pii_spans.added_spans(text, field, pii_spans.pattern_spans(text))
        assert time.time() - began < 60
        assert len(spans) == len(set(spans)) and all(a[2] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    phones = "call (415) 555-0134 " + "word " * 18 + "or (415) 555-0199 now"
    found = pii_spans.added_spans(phones, field, [])
    assert [phones[a:b] for a, _, b in found] == ["(415) 555-0134", "(415) 555-0199"]


def test_toxicity_finds_planted_words(spark, odd, none):
    rng = random.Random(9)
    plain = [f"word{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(1500):
        w = rng.choices(plain, k=60)
        toxic = int(k % 5 == 0)
        if toxic:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["vile", "rotten", "awful"])
        docs.append((k, " ".join(w)))
        labels.append((k, toxic))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = compression_toxicity.train(d, y)
    got = {r.doc_id: r for r in compression_toxicity.score(d, model, ["doc_id"]).collect()}
    held = [k for k in got if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(got[k].predicted == labels[k][1] for k in held) >= 0.97 * len(held)
    odd_scores = compression_toxicity.score(odd, model, ["doc_id"]).collect()
    assert len(odd_scores) == len(ODD) and all(0 <= r.score <= 1 for r in odd_scores)
    assert compression_toxicity.score(none, model, ["doc_id"]).count() == 0
    blank = compression_toxicity.train(d, y.limit(0))
    assert compression_toxicity.score(d, blank, ["doc_id"]).filter("score > 0").count() == 0


def test_licences(spark, none):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rest = "\n".join(f"some other words in line {k}" for k in range(30))
    rows = [
        (1, "a/LICENSE", apache),
        (2, "a/b/c/x.py", rest),
        (3, "a/b/y.py", f"{rest}\n{mit}"),
        (4, "z/q.py", rest),
        (5, None, mit),
        (6, "a/b/c/none.py", None),
        (7, "a/b/c/COPYING", f"{rest}\n{mit}"),
        (8, "ab/x.py", rest),
    ]
    got = {r.k: r for r in license_scan.scan(spark.createDataFrame(rows, "k long, path string, text string"), "k", "path", "text").collect()}
    assert got[1].declared == "Apache-2.0" and got[3].declared == "MIT" and got[5].declared == "MIT"
    assert (got[2].declared, got[2].licence, got[2].inherited_from) == (None, "MIT", "a/b/c")
    assert got[4].licence is None and got[6].licence == "MIT" and got[8].licence is None
    assert license_scan.scan(none.withColumn("path", F.lit("a")), "doc_id", "path", "text").count() == 0


def test_licences_anywhere_in_a_text(spark):
    rest = "\n".join(f"some other words in line {k}" for k in range(30))
    texts = [
        (1, "MIT", f"{rest}\nReleased under the MIT License.\n{rest}"),
        (2, "Apache-2.0", f"/*\n * Copyright 2020 Jane Doe\n *\n * Licensed under the Apache License, Version 2.0.\n */\n{rest}"),
        (3, "MPL-2.0", f"{rest}\n# This Source Code Form is subject\n# to the terms of the Mozilla\n# Public License, v. 2.0.\n{rest}"),
        (4, "GPL-3.0", f"// This work is licensed under the GNU\n// General Public License, version 3.\n{rest}"),
        (5, None, f"{rest}\nthe public terms of a version\n{rest}"),
        (6, "MIT", "\n".join("Released under the MIT License.".split())),
    ]
    d = spark.createDataFrame([(k, f"d{k}/f.c", t) for k, _, t in texts], "k long, path string, text string")
    assert {r.k: r.declared for r in license_scan.scan(d, "k", "path", "text").collect()} == {k: name for k, name, _ in texts}


MIT_FILE = """MIT License

Copyright (c) 2021 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL_HEADER = """/*
 * frob.c - frobs things
 *
 * Copyright (C) 2019 Jane Doe
 *
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version {v} of the License, or
 * (at your option) any later version.
 */
"""
APACHE_HEADER = """# Copyright 2018 The Authors
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""


def test_licence_files_and_headers(spark):
    code = "\n".join(f"some other words in line {k}" for k in range(30))
    rows = [
        (1, "p/LICENSE", MIT_FILE),
        (2, "p/src/x.py", code),
        (3, "q/x.c", GPL_HEADER.format(v=2) + code),
        (4, "q/y.c", GPL_HEADER.format(v=3) + code),
        (5, "q/z.py", APACHE_HEADER + code),
        (6, "q/mit.js", "/*\n * " + MIT_FILE.replace("\n", "\n * ") + "*/\n" + code),
        (7, "q/plain.py", code),
    ]
    got = {r.k: r for r in license_scan.scan(spark.createDataFrame(rows, "k long, path string, text string"), "k", "path", "text").collect()}
    assert {k: r.declared for k, r in got.items()} == {1: "MIT", 2: None, 3: "GPL-2.0", 4: "GPL-3.0", 5: "Apache-2.0", 6: "MIT", 7: None}
    assert (got[2].licence, got[2].inherited_from) == ("MIT", "p") and got[7].licence is None
