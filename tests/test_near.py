"""Order-dependent near-duplicate operators against plain sequential code."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairmill.operators import augment as G
from pairmill.operators import dedup as D
from pairmill.operators import joins as J
from pairmill.operators import vectors as V
from pairmill.operators.graph import components
from pairmill.operators.novelty import novelty_filter, rule_keywords, shared_keys


def jac(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


@pytest.mark.parametrize("pair_rows", [64, 4])
def test_novelty_equals_greedy(spark, monkeypatch, pair_rows):
    """With 4 rows a group, clusters go by their first rows; equal texts, sets of one word and blank keywords take part."""
    from pairmill.operators import novelty

    monkeypatch.setattr(novelty, "PAIR_ROWS", pair_rows)
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = []
    base = [sorted(rnd.sample(words, 20)) for _ in range(12)]
    for i in range(400):
        k = set(rnd.choice(base)) if i % 2 else set(rnd.sample(words, rnd.randint(0, 6)))
        if i % 3 == 0 and k:
            k.discard(rnd.choice(sorted(k)))
        if i % 5 == 0:
            k.add(rnd.choice(words))
        rows.append((i, sorted(k) + (["", " "] if i % 11 == 0 else []), f"Rule {i // 4 if i % 7 == 0 else i}" if i % 13 else " "))
    kept = []
    for i, k, t in rows:
        k = {x.strip() for x in k} - {""} or {"rule"}
        if not any(jac(k, k2) >= 0.9 or (t.strip() and t.lower() == t2.lower()) for _, k2, t2 in kept):
            kept.append((i, k, t))
    d = spark.createDataFrame(rows, "id long, kw array<string>, rule string").repartition(5)
    assert sorted(r[0] for r in novelty_filter(d, "id", "kw", "rule").select("id").collect()) == [r[0] for r in kept]


def test_frequent_tokens_make_no_large_groups(spark):
    """One word in half of the rows: every near pair has a common key, and no key has many rows."""
    rnd = random.Random(6)
    rows = [(i, sorted({*(["the"] if i % 2 else []), *(f"v{rnd.randrange(4000)}" for _ in range(12))})) for i in range(3000)]
    rows += [(3000 + i, sorted({*rows[i][1], "more"})) for i in range(0, 400, 2)]
    d = spark.createDataFrame(rows, "id long, s array<string>")
    keys = {r["id"]: set(r["_keys"]) for r in shared_keys(d, "id", "s", 0.9).collect()}
    for i in range(0, 400, 2):
        assert keys[i] & keys[3000 + i] or jac(set(rows[i][1]), set(rows[i][1]) | {"more"}) < 0.9
    count = {}
    for ks in keys.values():
        for k in ks:
            count[k] = count.get(k, 0) + 1
    assert max(count.values()) <= 8


def test_rule_keywords(spark):
    d = spark.createDataFrame([(["B ", "a", "b"], ["p"]), (["", " "], ["p", "q", "p"]), ([], [])], "k array<string>, t array<string>")
    assert [r[0] for r in d.select(rule_keywords(F.col("k"), F.col("t"))).collect()] == [["b", "a"], ["p", "q"], ["rule"]]


def sequential_merge(rows, cosine=0.985):
    def norm(x):
        return x / np.linalg.norm(x)

    recs = []
    for vid, layer, x, kw, sc in rows:
        x = norm(np.array(x))
        best, at = -1.0, None
        for n, r in enumerate(recs):
            if r["layer"] == layer and float(r["v"] @ x) > best:
                best, at = float(r["v"] @ x), n
        if at is not None and best >= cosine:
            r = recs[at]
            r["v"], r["sc"], r["n"] = norm(0.7 * r["v"] + 0.3 * x), max(r["sc"], sc), r["n"] + 1
            r["kw"] |= set(kw)
        else:
            recs.append({"id": vid, "layer": layer, "v": x, "kw": set(kw), "sc": sc, "n": 1})
    return recs


@pytest.mark.parametrize("fold_rows", [4096, 40])
def test_vector_merge_equals_sequential(spark, fold_rows):
    """With 40 rows a task, large sets are checked range by range, and those of several vectors are streamed."""
    rng = np.random.default_rng(0)
    centers = rng.standard_normal((12, 16))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    rows = []
    for i in range(500):
        c = centers[i % 12] if i % 2 else centers[0]
        # Half the rows crowd one centre; spreads range from copies to chains around the merge angle.
        x = c + rng.standard_normal(16) * (0.0 if i % 5 == 0 else 0.02 if i % 12 < 9 else 0.05)
        rows.append((i, int(i % 2), x.tolist(), [f"k{i % 9}"], float(i % 17)))
    want = sequential_merge(rows)
    d = spark.createDataFrame(rows, "vid long, layer long, vector array<double>, keywords array<string>, score double").withColumn("step", F.col("vid"))
    got = {r["vid"]: r for r in V.vector_merge(d, "vid", ["layer"], "step", "vector", "keywords", "score", dim=16, fold_rows=fold_rows).collect()}
    assert sorted(got) == sorted(r["id"] for r in want)
    for r in want:
        g = got[r["id"]]
        assert g["members"] == r["n"] and g["score"] == r["sc"] and g["keywords"] == sorted(r["kw"])
        assert np.allclose(g["vector"], r["v"], atol=1e-9)


def test_merge_steps_and_link_angle():
    """An older vector is below the last bit after so many merges, and no merge leads further from its newcomer."""
    theta = math.acos(0.985)
    x, y = np.array([1.0, 0.0]), np.array([math.cos(theta), math.sin(theta)])
    merged = 0.7 * x + 0.3 * y
    away = math.acos(merged @ y / np.linalg.norm(merged))
    assert abs(V.link_angle(0.985) - theta - away) < 1e-12
    a, b = np.array([1.0, 0.0]), np.array([math.cos(0.05), math.sin(0.05)])
    for k in range(V.merge_steps(0.985)):
        x = np.array([math.cos(0.02 * (k % 3)), math.sin(0.02 * (k % 3))])
        a, b = (0.7 * z + 0.3 * x for z in (a, b))
        a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    assert np.abs(a - b).max() < 1e-16


def test_linked_sets_of_crowded_buckets(spark):
    """Groups of copies, chains and far vectors: every pair within the angle shares its set, found by comparing all."""
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((60, 24))
    x = np.concatenate([centers, centers[0] + 0.02 * rng.standard_normal((300, 24)), centers[1] + np.cumsum(0.06 * rng.standard_normal((120, 24)), axis=0)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = spark.createDataFrame([(k, 0, v.tolist()) for k, v in enumerate(x)], "_id long, g int, _v array<double>")
    angle = V.link_angle(0.985)
    comp = {r["_id"]: r["comp"] for r in V.linked_sets(d, ["g"], angle, 24).collect()}
    near = np.argwhere(np.triu(x @ x.T >= math.cos(angle), 1))
    assert len(near) > 40_000 and all(a in comp and comp[a] == comp.get(b) for a, b in near.tolist())
    assert len(set(comp.values())) > 1 and not {0, 59} <= {k for k in comp if comp[k] == comp.get(0)}


def test_pairs_are_met_where_their_bucket_is_sent(monkeypatch):
    """Sketches of a bucket are compared with one another, whatever the batches; too many rows or links come out whole, for the hubs."""
    monkeypatch.setattr(V, "LOCAL_ROWS", 12)
    rng = np.random.default_rng(5)
    sizes = [1, 2, 7, 12, 13, 30, 1, 9, 10, 3]
    rows, links, whole = [], set(), set()
    for b, n in enumerate(sizes):
        s = [[int(x) for x in rng.integers(-(1 << 63), 1 << 63, 2)] for _ in range(n)]
        if b in (2, 7, 8):  # bucket 8 holds ten near rows, more links than four a row
            s = [[s[0][0] ^ (1 << k % 60), s[0][1]] if b == 8 or k % 3 == 0 else s[k] for k in range(n)]
        mine = [(b - 4, 1000 * b + k, *x) for k, x in enumerate(s)]
        near = {(y[1], x[1]) for i, x in enumerate(mine) for y in mine[i + 1 :] if sum(bin((x[c] ^ y[c]) & (1 << 64) - 1).count("1") for c in (2, 3)) <= 32}
        if n > 12 or len(near) > 4 * n:
            whole |= {x[:2] for x in mine}
        else:
            links |= near
        rows += mine
    batches = [pa.RecordBatch.from_pylist([dict(zip(("bucket", "_id", "s0", "s1"), x, strict=True)) for x in rows[k : k + 5]]) for k in range(0, len(rows), 5)]
    out = [r for b in V._met_in_buckets(32)(batches) for r in b.to_pylist()]
    assert len(links) == 3 + 3 and sorted((r["_id"], r["_hub"]) for r in out if r["_hub"] is not None) == sorted(links)
    assert {(r["bucket"], r["_id"]) for r in out if r["_hub"] is None} == whole and len(whole) == 13 + 30 + 10


def edits(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(cur[-1] + 1, prev[j] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_fuzzy_pairs_miss_nothing(spark):
    rnd = random.Random(1)
    terms = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 30))) for _ in range(150)]
    for t in terms[:80]:
        s = list(t)
        for _ in range(rnd.randint(0, 4)):
            p = rnd.randrange(len(s) + 1)
            s[p:p + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "z"])
        if s:
            terms.append("".join(s))
    left, right = sorted(set(terms[:130])), sorted(set(terms[60:]))
    want = {(a, b) for a in left for b in right if a == b or (abs(len(a) - len(b)) <= 2 and 1 - edits(a, b) / max(len(a), len(b)) >= 0.84 - 1e-12)}
    q = spark.createDataFrame([(x,) for x in left], "a string")
    c = spark.createDataFrame([(x,) for x in right], "b string")
    assert {(r["a"], r["b"]) for r in J.fuzzy_pairs(q, c, "a", "b").collect()} == want


@pytest.mark.parametrize("hot_rows", [0, 10, 10**9])
def test_topk_jaccard_with_and_without_hot_tokens(spark, monkeypatch, hot_rows):
    """All tokens frequent, some, or none."""
    monkeypatch.setattr(J, "HOT_RULE_ROWS", hot_rows)
    monkeypatch.setattr(J, "PLACES", 40)
    rnd = random.Random(2)
    words = [f"t{i}" for i in range(40)]
    rules = [(i, sorted({"the", *(["of"] if i % 2 else []), *rnd.sample(words, rnd.randint(0, 4))}), rnd.randint(0, 60)) for i in range(300)]
    qs = [(i, sorted({"the", *rnd.sample(words, 3)} if i % 3 else {"the", "of"})) for i in range(60)]
    want = {}
    for q, toks in qs:
        s = [(round(jac(set(toks), set(k)) + min(0.08, 0.01 * math.log1p(u)), 9), -r) for r, k, u in rules if set(toks) & set(k)]
        want[q] = [-r for _, r in sorted(s, reverse=True)[:3]]
    qd = spark.createDataFrame(qs, "q long, toks array<string>")
    rd = spark.createDataFrame(rules, "r long, kw array<string>, uses int")
    got = {}
    for row in J.topk_jaccard(qd, rd, "q", "toks", "r", "kw", "uses", "r", 3).orderBy("q", "rank").collect():
        got.setdefault(row["q"], []).append(row["r"])
    assert got == want


def test_topk_of_copies_keeps_the_leaders_only(spark):
    """Equal keywords: the k best bases and first places stay, and what rounding could tie with them."""
    rows = [(i, ["a", "b"], 0.5 if i % 2 else 0.25, i) for i in range(200)] + [(900, ["b", "a"], 0.5 - 1e-12, 900), (901, ["c"], 0.1, 901)]
    d = spark.createDataFrame(rows, "item long, _kw array<string>, _base double, _pos long").withColumn("_kw", F.array_sort("_kw"))
    assert sorted(r["item"] for r in J._leaders(d, 3).collect()) == [1, 3, 5, 900, 901]


@pytest.mark.parametrize("k", [1, 3])
def test_topk_jaccard_of_many_copies_and_short_items(spark, k):
    rnd = random.Random(5)
    words = [f"t{i}" for i in range(60)]
    pick = lambda n: sorted({words[min(59, int(rnd.expovariate(0.12)))] for _ in range(n)})
    rules = [(i, pick(rnd.choice([1, 2, 4, 14])) if i % 4 else ["t0", "t1"], i % 50) for i in range(500)]
    qs = [(i, pick(rnd.choice([1, 5, 30])) if i % 5 else ["t0", "t2", "zz"]) for i in range(80)]
    want = {}
    for q, toks in qs:
        s = sorted((-round(jac(set(toks), set(w)) + min(0.08, 0.01 * math.log1p(u)), 9), r) for r, w, u in rules if set(toks) & set(w))
        want[q] = [(r, -x) for x, r in s[:k]]
    qd = spark.createDataFrame(qs, "q long, toks array<string>")
    rd = spark.createDataFrame(rules, "r long, kw array<string>, uses int")
    got = {}
    for row in J.topk_jaccard(qd, rd, "q", "toks", "r", "kw", "uses", "r", k).orderBy("q", "rank").collect():
        got.setdefault(row["q"], []).append((row["r"], row["score"]))
    assert got == {q: w for q, w in want.items() if w}


def _sent(spark):
    """Rows that tasks have written to shuffles so far, by stage."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {s.stageId(): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}


def test_topk_jaccard_sends_rows_not_pairs(spark):
    """Nearly every query shares words with every rule: what is shuffled stays within three times the words of both sides."""
    rnd = random.Random(7)
    words = [f"t{i}" for i in range(300)]
    rules = [(i, [*rnd.sample(words, 12), f"own{i}"], rnd.randint(0, 49)) for i in range(1500)]
    qs = [(i, rnd.sample(words, 25)) for i in range(1500)]
    qd = spark.createDataFrame(qs, "q long, toks array<string>")
    rd = spark.createDataFrame(rules, "r long, kw array<string>, uses int")
    before = _sent(spark)
    got = {}
    for row in J.topk_jaccard(qd, rd, "q", "toks", "r", "kw", "uses", "r", 3).collect():
        got.setdefault(row["q"], []).append((row["rank"], row["r"]))
    assert 0 < sum(n for stage, n in _sent(spark).items() if stage not in before) < 3 * (1500 * 13 + 1500 * 25)
    for q, toks in qs[::50]:
        s = sorted((-round(jac(set(toks), set(w)) + min(0.08, 0.01 * math.log1p(u)), 9), r) for r, w, u in rules if set(toks) & set(w))
        assert sorted(got[q]) == [(i + 1, r) for i, (_, r) in enumerate(s[:3])]


def test_compose_layers_sums_vectors_in_the_row(spark):
    hits = spark.createDataFrame([(1, 10, 1.0), (1, 11, 0.5), (1, 12, 1.0), (2, 13, 1.0)], "q long, v long, score double")
    recs = spark.createDataFrame([(10, 0, [1.0, 0.0]), (11, 0, [0.0, 2.0, 0.5]), (12, 1, [30.0, 40.0]), (13, 0, None)], "v long, layer long, vec array<float>")
    d = J.compose_layers(hits, recs, "q", "v", "layer", "vec", F.lit(1.0))
    got = {(r["q"], r["layer"], r["pos"]): round(r["value"], 9) for r in d.collect()}
    assert got == {(1, 0, 0): 1.0, (1, 0, 1): 1.0, (1, 0, 2): 0.25, (1, 1, 0): 1.2, (1, 1, 1): 1.6}
    assert "posexplode" not in d._jdf.queryExecution().optimizedPlan().toString().split("Aggregate", 1)[1]


def test_subset_closure_on_a_chain_and_a_loop(spark):
    edges = [("p", f"n{i}", f"n{i + 1}") for i in range(20)] + [("q", "a", "b"), ("q", "b", "a")]
    d = spark.createDataFrame(edges, "p string, a string, b string")
    got = {(r["p"], r["a"], r["b"]) for r in G.subset_closure(d, "p").collect()}
    want = {("p", f"n{i}", f"n{j}") for i in range(21) for j in range(i, 21)} | {("q", x, y) for x in "ab" for y in "ab"}
    assert got == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 101), (101, 102)]
    nodes = spark.createDataFrame([(i,) for i in [*range(51), 100, 101, 102, 200]], "node long")
    got = {r["node"]: r["comp"] for r in components(nodes, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(51)} == {0} and got[102] == 100 and got[200] == 200


def test_exact_pairs_keep_the_parts_apart(spark):
    rows = [(1, "line one\nline two", "c"), (2, "line one", "line two\nc"), (3, " line one", "line two\nc "), (4, "x", "")]
    d = spark.createDataFrame(rows, "pos long, i string, o string")
    got = {r["pos"]: r["status"] for r in D.exact_pairs(d, "i", "o", ["pos"]).collect()}
    assert got == {1: "kept", 2: "kept", 3: "duplicate", 4: "short"}


def test_vector_merge_with_text_ids(spark):
    rows = [(f"vec_{k:03d}", "skill", 0, k, [1.0, 2.0 + 1e-4 * (k % 4), float(k // 4)], ["a"], 0.5) for k in range(12)]
    d = spark.createDataFrame(rows, "vid string, kind string, layer long, step long, vector array<double>, keywords array<string>, score double")
    got = {r["vid"]: r["members"] for r in V.vector_merge(d, "vid", ["kind", "layer"], "step", "vector", "keywords", "score", dim=3).collect()}
    assert got == {"vec_000": 4, "vec_004": 4, "vec_008": 4}


def test_vector_merge_of_far_vectors_with_text_ids(spark):
    axes = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rows = [(f"vec_{k:03d}", "skill", 0, k, axes[k % 3], [f"w{k}"], k / 10) for k in range(8)]
    d = spark.createDataFrame(rows, "vid string, kind string, layer long, step long, vector array<double>, keywords array<string>, score double")
    got = {r["vid"]: (r["members"], r["keywords"], r["score"], r["vector"]) for r in V.vector_merge(d, "vid", ["kind", "layer"], "step", "vector", "keywords", "score", dim=3).collect()}
    assert got == {
        "vec_000": (3, ["w0", "w3", "w6"], 0.6, axes[0]), "vec_001": (3, ["w1", "w4", "w7"], 0.7, axes[1]), "vec_002": (2, ["w2", "w5"], 0.5, axes[2]),
    }


def test_leaderboard_of_equal_scores(spark):
    from pairmill.operators.dialog import leaderboard

    d = spark.createDataFrame([(k, 0.5 if k < 500 else k / 1000) for k in range(600)], "k long, s double")
    got = {r["k"]: r["place"] for r in leaderboard(d, "s", "k").collect()}
    assert got[599] == 1 and got[501] == 99 and {got[k] for k in range(501)} == {100}


def test_weighted_blocks_follow_any_weight(spark):
    from pyspark.sql import functions as F

    from pairmill.operators import sample as S

    d = spark.range(20_000)
    for weight in (1e-3, 1.0, 50_000.0):
        score = F.greatest(-F.log(S.uniform(S.order_key(1, "id"))) / weight, F.lit(1e-9))
        most = d.groupBy(F.floor(F.log2(score) * 1024).alias("b")).count().agg(F.max("count")).first()[0]
        assert most < 200
        assert S.weighted_take(d, 7, F.lit(weight), 1, "id").count() == 7
