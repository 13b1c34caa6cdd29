import random

import numpy as np
import pyarrow as pa

from pairmill.llm import dart, decontaminate, spotsigs
from pairmill.llm.common import Words
from tests.llm.helpers import classes, edge_frame, similarity, shingles


def _variants(n, seed, words=120):
    """Copies of one text with more and more words changed, truncated copies, and copies of copies."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(400)}" for _ in range(words)]
    out = [" ".join(base)]
    for k in range(n):
        t = list(rng.choice(out).split() if k % 3 == 0 else base)
        for _ in range(rng.randrange(0, 12)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        if k % 5 == 0:
            t = t[: rng.randrange(len(t) * 3 // 5, len(t) + 1)]
        out.append(" ".join(t))
    return out


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(2)
    a = [rng.choice("abcdefgh") for _ in range(500)]
    b = a[:400] + [rng.choice("abcdefgh") for _ in range(100)]
    w = Words(pa.array([" ".join(a), " ".join(b), "", None]))
    row, g, c = dart.weighted_shingles(w)
    s = dart.dart_signatures(row, g, c, 4, k=4096)
    want = similarity(shingles(" ".join(a)), shingles(" ".join(b)))
    assert abs((s[0] == s[1]).mean() - want) < 0.04
    assert (s[:2] != 0).all() and not s[2:].any()


def test_real_weights_count():
    s = dart.dart_signatures(np.array([0, 0, 1, 1]), np.array([7, 9, 7, 9], dtype=np.uint64), np.array([0.5, 6.0, 2.5, 3.0]), 2, k=4096)
    assert abs((s[0] == s[1]).mean() - 3.5 / 8.5) < 0.04


def _meet(x, y):
    extra = set(x.get(dart.EXTRA, [])) & set(y.get(dart.EXTRA, []))
    return extra or set(x.get(dart.FAR, [])) & set(y.get(dart.SHRUNK, [])) or set(y.get(dart.FAR, [])) & set(x.get(dart.SHRUNK, []))


def test_hub_keys_lose_no_link():
    texts = _variants(150, 3) + _variants(60, 9, words=30)
    e, ptr = dart.elements(*Words(pa.array(texts)).grams(5))
    sets = [e[a:b] for a, b in zip(ptr, ptr[1:], strict=False)]
    links = 0
    for hub in (sets[0], sets[17], sets[160]):
        close = [dart.jaccard(s, hub) >= 0.8 for s in sets]
        keys = [{r: k.tolist() for r, k in dart.hub_keys(s, hub, c)} for s, c in zip(sets, close, strict=True)]
        for i in range(len(sets)):
            for j in range(i):
                if dart.jaccard(sets[i], sets[j]) >= 0.8 and not (close[i] and close[j]):
                    links += 1
                    assert _meet(keys[i], keys[j])
    assert links


def test_classes_equal_brute_force(spark):
    texts = _variants(120, 1) + _variants(40, 4, words=40) + ["", None, " ", "a b", "A  b", "c"] + [f"lone {k} words here are few and {k * 7}" for k in range(20)]
    rows = list(enumerate(texts)) + [(1000 + k, texts[k]) for k in range(0, 60, 4)]
    got = {r.doc_id: r.class_id for r in dart.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = classes(rows)
    assert len(got) == len(rows)
    assert sum(got[i] != want[i] for i in want) == 0


def test_independent_edits_do_not_meet(spark):
    """Half of all rows are heavy edits of one text; candidate keys must not bring all of them together."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(200)]
    sets = []
    for _ in range(120):
        t = [w if rng.random() > 0.12 else f"e{rng.randrange(10**9)}" for w in base]
        e, _ = dart.elements(*Words(pa.array([" ".join(t)])).grams(5))
        sets.append(e)
    hub, _ = dart.elements(*Words(pa.array([" ".join(base)])).grams(5))
    keys = [{r: k.tolist() for r, k in dart.hub_keys(s, hub, dart.jaccard(s, hub) >= 0.8)} for s in sets]
    met = sum(bool(_meet(keys[i], keys[j])) for i in range(120) for j in range(i))
    assert met < 0.05 * 120 * 119 / 2


def test_edges_of_classes(spark):
    d = edge_frame(spark)
    rows = dart.near_duplicate_classes(d).collect()
    got = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == d.count() and got[None] is None
    assert got[1] == got[2] == got[3] == 1 and got[4] == got[5] == 4 and got[6] == got[7] == 6 and got[8] == 8
    kept = dart.keep_first(d)
    assert kept.columns == d.columns and sorted(kept.toPandas().doc_id.fillna(-1)) == [-1, 1, 4, 6, 8, 9, 10]
    assert dart.near_duplicate_classes(d.limit(0)).count() == 0
    assert dart.keep_first(d.limit(0)).columns == d.columns


def test_keys_that_repeat_with_other_texts(spark):
    """Keys 1, 1, 2, 3 with texts A, B, A', B': two classes, one row of each stays, whatever the partitions."""
    a, b = (" ".join(f"{x}{k}" for k in range(80)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (3, a), (None, b), (7, a), (7, a)]
    base = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 3, 9):
        d = base.repartition(parts)
        got = sorted(map(repr, (tuple(r) for r in dart.near_duplicate_classes(d).collect())))
        assert got == sorted(map(repr, [(1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (None, None), (7, 1), (7, 1)]))
        assert sorted(map(repr, (tuple(r) for r in dart.keep_first(d).collect()))) == sorted(map(repr, [(1, a), (1, b), (None, b)]))
    rng = random.Random(1)
    texts = _variants(40, 5)
    many = [(rng.randrange(30), rng.choice(texts)) for _ in range(120)]
    want = classes(list(enumerate(t for _, t in many)))
    least = {}
    for k, (i, _) in enumerate(many):
        least[want[k]] = min(i, least.get(want[k], i))
    for parts in (1, 5):
        got = dart.near_duplicate_classes(spark.createDataFrame(many, "doc_id long, text string").repartition(parts)).collect()
        assert sorted(tuple(r) for r in got) == sorted((i, least[want[k]]) for k, (i, _) in enumerate(many))
        assert dart.keep_first(spark.createDataFrame(many, "doc_id long, text string").repartition(parts)).count() == len(set(want.values()))


def _paraphrase(words, rng, share):
    return [w if rng.random() > share else f"new{rng.randrange(999)}" for w in words]


def test_contaminated_finds_copies_and_edits(spark):
    rng = random.Random(6)
    vocabulary = [f"v{k}" for k in range(800)]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(line(40))) for k in range(12)] + [(12, None), (13, ""), (14, "too short item"), (0, "again other words " + " ".join(line(20)))]
    docs, want = [], set()
    for k in range(60):
        body, item = line(150), items[k % 12]
        if k < 36:
            piece = item[1].split()
            piece = piece if k < 12 else _paraphrase(piece, rng, 0.12) if k < 24 else [w for w in piece if rng.random() > 0.1]
            body = body[:50] + [piece[0].upper() + ",", *piece[1:]] + body[50:]
            want.add((k, item[0]))
        docs.append((k, " ".join(body)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = decontaminate.contaminated(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    exact = next(r for r in rows if r.doc_id == 3)
    assert (exact.score, exact.first_word, exact.end_word) == (1.0, 50, 90)
    clean = decontaminate.without_benchmark(frame, bench)
    assert sorted(r.doc_id for r in clean.collect()) == list(range(36, 60))


def test_parts_of_a_large_benchmark_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"pre {k} " + " ".join(f"i{k}w{j}" for j in range(20))) for k in range(20)], "doc_id long, text string")
    bench = docs.selectExpr("doc_id AS item_id", "substr(text, 7) AS text")
    whole = sorted(tuple(r) for r in decontaminate.contaminated(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "PART_WORDS", 100)
    assert len(decontaminate._parts(docs, bench, "text", "item_id", "text")) > 5
    assert sorted(tuple(r) for r in decontaminate.contaminated(docs, bench).collect()) == whole and len(whole) == 20


def test_edges_of_decontamination(spark):
    d = edge_frame(spark)
    bench = spark.createDataFrame([(1, "text without an id stands here"), (2, None)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.contaminated(d, bench).collect()] == [None]
    assert decontaminate.without_benchmark(d, bench).count() == d.count() - 1
    assert decontaminate.contaminated(d, bench.limit(0)).count() == 0
    assert decontaminate.without_benchmark(d.limit(0), bench).columns == d.columns


def test_align_equals_the_plain_matrix():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.integers(1, 5, rng.integers(1, 12)).astype(np.uint64), rng.integers(1, 5, rng.integers(1, 20)).astype(np.uint64)
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -0.5), h[i, j + 1] - 0.5, h[i + 1, j] - 0.5)
        assert decontaminate.align(a, b[None, :])[0][0] == h.max()


def test_fingerprints_follow_the_next_document(spark):
    import hashlib

    rows = [(k * 3, " ".join(f"w{(k * 7 + j) % 50}" for j in range(k % 40))) for k in range(200)] + [(700, None), (9, None), (701, "é🙂" * 30)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in spotsigs.fingerprints(d).collect())
    order = sorted((i, t or "") for i, t in rows)
    want = []
    for k, (i, t) in enumerate(order):
        n = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - n] + order[(k + 1) % len(order)][1][:n]).encode()).hexdigest()))
    assert got == sorted(want)


def test_fingerprints_tell_edits_from_others(spark):
    rng = random.Random(4)
    d = [(k, " ".join(rng.choice(["the", "a", "is", *[f"c{j}" for j in range(300)]]) for _ in range(200))) for k in range(60)]
    rows = spotsigs.fingerprints(spark.createDataFrame([*d, (60, d[59][1]), (61, d[59][1])], "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in rows}
    assert min(r.near_edited for r in rows) > 0.4 and max(by[k].near_next for k in range(58)) < 0.1
    assert by[59].near_next == 1.0 and by[59].fingerprint == by[60].fingerprint


def test_edges_of_fingerprints(spark):
    d = edge_frame(spark)
    rows = spotsigs.fingerprints(d).collect()
    assert len(rows) == d.count()
    assert {r.fingerprint for r in rows if r.doc_id in (1, 2, 3)} == {""} and all(r.fingerprint for r in rows if r.doc_id not in (1, 2, 3))
    one = spotsigs.fingerprints(d.where("doc_id = 9")).collect()[0]
    assert one.near_next == 1.0 and one.n_chars == 3_000
    assert spotsigs.fingerprints(d.limit(0)).count() == 0


def test_similar_pairs_equal_brute_force(spark):
    texts = _variants(60, 5) + [""]
    prints = [(k, spotsigs.fingerprint(s)) for k, s in enumerate(spotsigs.spot_sets(pa.array(texts)))]
    first = {}
    for k, f in prints:
        first.setdefault(f, k)
    ids = sorted(k for f, k in first.items() if f)
    sets = dict((k, spotsigs.spots_of(f)) for k, f in prints)
    want = {(a, b) for a in ids for b in ids if a < b and spotsigs.pruned_jaccard(sets[a], sets[b], 0.6) >= 0.6}
    got = {tuple(sorted((r.a, r.b))) for r in spotsigs.similar_pairs(spark.createDataFrame(prints, "doc_id long, fingerprint string"), 0.6).collect()}
    assert got == want and want
