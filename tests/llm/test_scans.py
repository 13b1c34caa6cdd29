"""Word runs, the token cache and ranked search against plain code."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmill.llm import catalog, ranked, runs, token_cache
from tests.llm.helpers import EDGE, EDGE_SCHEMA, WORD, edge_frame, low

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _runs(w, least=6, exponent=4):
    """Every period on its own; a stretch with a smaller period is left to that one."""
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size, part = i - s + q, w[s : i + q]
            if size >= max(least, exponent * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_small_alphabets(seed):
    rng = random.Random(seed)
    for _ in range(250):
        n, k = rng.randrange(70), rng.choice([1, 2, 2, 3, 6])
        w = [rng.randrange(k) for _ in range(n)]
        if n > 3 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randrange(3, 11)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        least, exponent = rng.choice([(6, 4), (2, 2), (9, 2), (4, 3)])
        ids, want = np.array(w, np.int64), _runs(w, least, exponent)
        assert [tuple(r) for r in runs.stretch_runs(ids, least, exponent).tolist()] == want
        cut = [(s + lo, m, q) for lo, hi in runs.repeated_stretches(ids, np.array([0, n]), least, exponent) for s, m, q in runs.stretch_runs(ids[lo:hi], least, exponent).tolist()]
        assert sorted(cut, key=lambda r: (r[0], r[2])) == want


def test_common_extension_equals_comparison():
    rng = random.Random(3)
    s = [rng.randrange(1, 3) for _ in range(400)]
    tree = runs.SuffixTree(s)
    a, b = np.array([(x, y) for x in range(0, 400, 7) for y in range(400) if x != y]).T
    for x, y, got in zip(a.tolist(), b.tolist(), tree.common(a, b).tolist(), strict=True):
        k = 0
        while max(x, y) + k < 400 and s[x + k] == s[y + k]:
            k += 1
        assert got == k
    assert sorted(range(401), key=lambda i: s[i:]) == np.argsort(tree.rank).tolist()


def test_long_stretches_stay_linear():
    assert runs.stretch_runs(np.zeros(200_000, np.int64)).tolist() == [[0, 200_000, 1]]


def _run_row(key, text):
    w = (text or "").encode().split()
    n, h = len(w), None if key is None else zlib.crc32(str(key).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = _runs(w)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    milli = best and 1000 * best[1] // best[2]
    return (key, len(found), *(best or (None,) * 3), milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_run_query_equals_plain_code(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("ab cd é Ab xyz".split()) for _ in range(rng.randrange(1, 90)))) for k in range(100, 220)]
    rows += [(300, "\x1c ".join(["a", "b"] * 9)), (301, "a b " * 8), (302, "x " * 5), (303, "x " * 6), (304, "x y " * 4), (305, "x y x y x y z " * 4)]
    rows += [(k, t) for k, t, _ in EDGE if k not in (6, 7)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.op11_word_runs(spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(_run_row(*r)) for r in rows)


def test_runs_of_edge_rows(spark):
    d = edge_frame(spark)
    out = runs.find_runs(d.withColumn("_runs", F.lit(1))).collect()
    assert len(out) == len(EDGE)
    for r in out:
        w = (r.text or "").encode().split()
        assert r["_runs"].n_words == len(w) and [tuple(x) for x in r["_runs"].runs] == (_runs(w) if len(w) < 5000 else [])
    assert runs.find_runs(d.limit(0)).count() == 0
    whole = runs.find_runs(spark.createDataFrame([(1, "a b " * 30_000)], "id long, text string")).first()["_runs"]
    assert [tuple(x) for x in whole.runs] == [(0, 60_000, 2)] and whole.collapsed == "a b"
    with pytest.raises(ValueError):
        runs.find_runs(d, least_exponent=1)


# ---------------------------------------------------------------- token cache


def _count(text):
    import sentencepiece

    return len(sentencepiece.SentencePieceProcessor(model_file=token_cache.default_tokenizer()).encode(text or ""))


def test_counts_equal_the_library(spark):
    d = edge_frame(spark)
    cache = token_cache.new_cache(spark)
    out = token_cache.count_tokens(d.withColumn("_tokens", F.lit(5)), cache)
    assert out.columns == [c for c in d.columns if c != "text"] + ["_tokens"]
    got = sorted((repr(r.doc_id), r.source or "", tuple(r["_tokens"])) for r in out.collect())
    assert got == sorted((repr(i), s or "", (len((t or "").encode()), _count(t))) for i, t, s in EDGE)
    assert token_cache.count_tokens(d.limit(0), cache).count() == 0


def test_known_contents_are_not_encoded_again(spark, monkeypatch):
    cache = token_cache.new_cache(spark)
    first = spark.createDataFrame([(k, f"text number {k % 7}") for k in range(60)], "doc_id long, text string")
    assert {r["_tokens"].n_tokens for r in token_cache.count_tokens(first, cache).collect()} == {_count("text number 1")}
    stored = lambda: {r.digest: r.n_tokens for r in cache.rows(spark).collect()}
    before = stored()
    assert len(before) == 7
    raw = lambda: spark.read.parquet(cache.path).count()
    assert raw() == 7
    # A cache whose counts are told apart shows where a count comes from: only the two new contents are encoded.
    planted = token_cache.TokenCache(cache.folder + "-planted", cache.tokenizer)
    cache.rows(spark).withColumn("n_tokens", F.lit(1000).cast("long")).write.parquet(planted.path)
    more = first.union(spark.createDataFrame([(k, f"other text {k % 2}") for k in range(40)], "doc_id long, text string"))
    got = collections.Counter(r["_tokens"].n_tokens for r in token_cache.count_tokens(more, planted).collect())
    assert got == {1000: 60, _count("other text 1"): 40}
    assert spark.read.parquet(planted.path).count() == 9


def test_other_tokenizers_have_their_own_counts(spark):
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = tokenizers.Tokenizer.from_file(path)
    other = token_cache.TokenCache(token_cache.new_cache(spark).folder, path)
    assert other.path != token_cache.TokenCache(other.folder, token_cache.default_tokenizer()).path
    rows = [(1, "plain words"), (2, "end <|endoftext|> start"), (3, None)]
    out = token_cache.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), other)
    assert {r.doc_id: r["_tokens"].n_tokens for r in out.collect()} == {i: len(model.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    with pytest.raises(ValueError):
        token_cache.tokenizer_version("words.txt")


# ---------------------------------------------------------------- ranked search


def _best(docs, items, k=10):
    """Every document scored for every item."""
    terms = [collections.Counter(TERM.findall(low(t))) for _, t in docs]
    n_docs, n_terms = sum(1 for t in terms if t), sum(sum(t.values()) for t in terms)
    df = collections.Counter(x for t in terms for x in t)
    out = []
    for item in sorted({i for i, _ in items}, key=repr):
        asked = {x for i, t in items if i == item for x in TERM.findall(low(t))}
        scored = []
        for (key, _), t in zip(docs, terms, strict=True):
            m = 10 + 90 * sum(t.values()) * n_docs // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * t[x] // (1000 * t[x] + 8 * m)) for x in asked if t[x])
            if s > 0:
                scored.append((-s, key is None, key or 0, key))
        out += [(item, r, key, -s) for r, (s, _, _, key) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize(("seed", "shard_bytes", "parts"), [(0, 1 << 25, 3), (1, 400, 2), (2, 3000, 1)])
def test_search_equals_scoring_everything(spark, monkeypatch, seed, shard_bytes, parts):
    rng = random.Random(seed)
    monkeypatch.setattr(ranked, "GROUP_TERMS", 40)
    words = [f"w{k}" for k in range(150)]
    weights = [1 / (k + 1) for k in range(150)]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for k in range(500)]
    docs += [(k, docs[7][1]) for k in range(500, 530)] + [(7, docs[7][1])] * 3  # ties beyond the tenth, repeated rows
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for k in range(40)] + [(90, docs[7][1]), (91, "W3-w4.w3 nothing"), (92, "nowhere"), (93, None), (94, ""), (91, "w9"), (None, "w1 w80")]
    index = ranked.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), shard_bytes=shard_bytes)
    got = ranked.search(index, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, _best(docs, items)))


def test_blocks_are_rejected_unread():
    """On long lists most blocks of the common word stay packed, and the answer is that of scoring everything."""
    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join(["common"] * rng.randrange(1, 4) + [f"f{rng.randrange(9)}"] * rng.randrange(1, 30) + (["rare"] if k % 400 == 0 else [])) for k in range(8000)]
    n_terms = sum(len(t.split()) for t in texts)
    rows = ranked._shard(0, pa.array(texts), pa.array(range(8000)), 8000, n_terms).to_pylist()
    lists = {r["term"]: (r["peak"], *(np.array(r[c]) for c in ("last", "peaks", "ends")), r["data"]) for r in rows[1:]}
    shard = ranked.Shard(np.array(rows[0]["factors"]), rows[0]["keys"], lists)
    df = {r["term"]: r["df"] for r in rows[1:]}
    query = [(t, math.floor(1000 * math.log(16002 / (2 * df[t] + 1)))) for t in ("rare", "common", "f3")]
    got = shard.best(query, 10)
    read = shard.blocks_read
    assert [(k, s) for s, k in got] == [(k, s) for _, _, k, s in _best(list(enumerate(texts)), [(0, "rare common f3")])]
    assert read < sum(len(lists[t][1]) for t, _ in query) / 2


def test_varints_round_trip():
    v = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28 - 1, 2**28, 2**34], np.int64)
    data, ends = ranked.varints(v)
    assert ranked.from_varints(data).tolist() == v.tolist() and ends[-1] == len(data)


def test_search_of_edge_rows(spark):
    docs = [(i, t) for i, t, _ in EDGE]
    items = [(1, "One w5x5 it's"), (2, "テキスト odd id"), (3, None)]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("clash")).withColumn("shard", F.lit(1))
    got = ranked.search(ranked.build_index(edge_frame(spark).withColumn("shard", F.lit("s"))), frame)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, _best(docs, items)))
    empty = ranked.build_index(edge_frame(spark).limit(0))
    assert empty.n_docs == 0 and ranked.search(empty, frame).count() == 0
    assert ranked.search(ranked.build_index(edge_frame(spark)), frame.limit(0)).count() == 0
    named = ranked.build_index(spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x"), ("c", "y")], EDGE_SCHEMA.split(",")[0].replace("long", "string") + ", text string"))
    assert [tuple(r) for r in ranked.search(named, spark.createDataFrame([("q", "x")], "item_id string, text string"), k=2).select("rank", "key").orderBy("rank").collect()] == [(1, "a"), (2, "b")]
    assert WORD.findall(" a ") == ["a"]
