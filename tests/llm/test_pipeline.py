"""The pipeline against a plain version of every stage."""

import re

import duckdb
import pytest
import sentencepiece

import corpus_pipeline
from quarryline.llm import sentencepieces
from quarryline.llm.common import read_table
from tests.llm.test_operators import ODD, WORD, _brute_components, _brute_windows

SF = "/root/testdata/sf0.001"


def _quality(docs):
    out = []
    for d, t in docs:
        w = WORD.findall(t or "")
        seen: dict = {}
        for k in range(len(w) - 4):
            seen.setdefault(tuple(w[k : k + 5]), []).append(k)
        hit = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(5)}
        if len(w) >= 10 and 100 * len(hit) <= 20 * len(w):
            out.append((d, t))
    return out


def _lines(docs):
    places: dict = {}
    every = {}
    for d, t in sorted(docs):
        x = t.split("\n")
        every[d] = x
        n = [len(WORD.findall(v)) for v in x]
        for k in range(len(x)):
            for size in (1, 2, 3):
                total = sum(n[k : k + size])
                if k + size <= len(x) and total and (size == 3 or total >= 50 or len(x) == size):
                    places.setdefault((size, *x[k : k + size]), []).append((d, k, size))
    gone: dict = {}
    for at in places.values():
        for d, k, size in sorted(at)[1:]:
            gone.setdefault(d, set()).update(range(k, k + size))
    out = []
    for d, x in every.items():
        left = "\n".join(v for k, v in enumerate(x) if k not in gone.get(d, ()))
        if d not in gone or re.search(r"[^\x20\x09-\x0D]", left):
            out.append((d, left))
    return out


def test_pipeline_is_the_plain_version(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    docs = _lines(_quality(docs))
    docs.sort()
    sets, tops = _brute_components(docs, 5, 80, 100)
    first: dict = {}
    docs = [x for x, s, t in zip(docs, sets, tops, strict=True) if not s or first.setdefault(t, x[0]) == x[0]]
    bad = {r[0] for r in _brute_windows(docs, items) if r[3]}  # windows of any item
    assert bad
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.default_model())
    want = {d: sp.encode(t) for d, t in docs if d not in bad}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {d: list(r.ids) for d, r in got.items()} == want
    assert all(r.decoded == sp.decode(list(r.ids)) and r.n_tokens == len(r.ids) for r in got.values())


def test_a_passage_of_one_item_is_dropped(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(1).first()
    words = re.findall(r"\w+", items.text)[:8]
    assert len(words) == 8
    own = " ".join(f"own{k}" for k in range(30))
    docs = spark.createDataFrame([(1, f"{own} {' '.join(words)} {own}"), (2, own), (3, f"{own} {' '.join(words[:7])}")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, SF).collect()) == [2, 3]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_words long")
    got = stage(spark, odd, SF)
    rows = got.collect()
    if name == "tokens":
        assert len(rows) == len(ODD) and all(r.n_tokens == len(r.ids) for r in rows)
    else:
        assert got.columns == odd.columns
        kept = sorted(str(r.doc_id) for r in rows)
        want = {"quality": [4, 5, 5, 6, 9], "near_duplicates": [1, 2, 3, 4, 7, 8, None], "decontaminate": [r[0] for r in ODD]}.get(name)
        assert want is None or kept == sorted(map(str, want))
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_all_but_the_last_stage_keep_the_columns(spark):
    docs = read_table(spark, SF, "documents").limit(20)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
