"""The pipeline, the registered queries and their SQL on the smallest tables."""

import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from pairmill.llm import catalog, planes, toxicity
from pairmill.llm.common import table
from tests.llm.helpers import EDGE, WORD, classes, low

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


@pytest.mark.parametrize("name", list(catalog.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLE[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda rows, names: sorted(repr([r[names.index(c)] for c in cols]) for r in rows)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


def test_contracts(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    one = catalog.QUERIES["op1_toxicity"](spark, SF).collect()
    assert {r.doc_id for r in one} == set(docs)
    for r in one:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    near = {r.doc_id: r.class_id for r in catalog.QUERIES["op2_dart_minhash"](spark, SF).collect()}
    assert near == classes(docs.items())
    seven = catalog.QUERIES["op7_trie_lm"](spark, SF).collect()
    out = [r for r in seven if r.held_out]
    assert len(seven) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in seven)
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    at = 0
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(planes.default_tokenizer())
    for r in sorted(catalog.QUERIES["op5_bit_planes"](spark, SF).collect(), key=lambda r: r.doc_id):
        ids = np.array([*tok.encode(docs[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def _found(item, text):
    """A plain look for an item: most of its four-word runs stand in the text."""
    import regex

    w, t = (regex.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", low(x)) for x in (item, text))
    grams = {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    return len(grams) and len(grams & {tuple(t[k : k + 4]) for k in range(len(t) - 3)}) >= 0.5 * len(grams)


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, SF, "documents").cache()
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    s = dict(corpus_pipeline.STAGES)
    kept = s["toxicity"](spark, docs, SF).cache()
    scores = {r.doc_id: r.score for r in toxicity.score_texts(docs, toxicity.train(docs, table(spark, SF, "labels"))).collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, x in scores.items() if x < 0.5}
    single = s["near_dedup"](spark, kept, SF).cache()
    assert {r.doc_id for r in single.collect()} == set(classes([(r.doc_id, r.text) for r in kept.collect()]).values())
    clean = s["decontamination"](spark, single, SF).cache()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect() if not any(_found(i, r.text) for i in items)}
    mixed = s["source_mix"](spark, clean, SF).cache()
    assert single.columns == clean.columns == mixed.columns == docs.columns
    words = lambda rows: sum(len(WORD.findall(r.text)) for r in rows)
    assert abs(words(mixed.collect()) / words(clean.collect()) - 1.5) < 0.1
    out = s["token_output"](spark, mixed, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in mixed.collect())
    assert corpus_pipeline.run(spark, SF).count() == len(out)


def test_stages_take_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "text without an id stands here"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, None, s, None) for i, t, s in EDGE], "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, str(tmp_path)).cache()
        assert d.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
