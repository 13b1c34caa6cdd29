"""Sampling: counts, subsets, skew, equal results for any partitioning, exact budget walks."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pairmill.operators import sample as S


def h(seed, *parts):
    return hashlib.md5("|".join([str(seed), *map(str, parts)]).encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    # One group holds more than a third of all rows.
    return [(i, "hot" if i % 3 else f"g{i % 7}", 1 + (i * 37) % 90) for i in range(3000)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, grp string, tokens long")


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_take_is_the_hash_order_prefix(frame, rows, parts):
    want = sorted(sorted((r[0] for r in rows), key=lambda i: (h(9, i), i))[:700])
    assert ids(S.take(frame.repartition(parts), 700, 9, "id")) == want


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_group_caps_small_and_large(frame, rows, parts):
    for cap in (20, 1500):
        want = []
        for g in {r[1] for r in rows}:
            want += sorted((r[0] for r in rows if r[1] == g), key=lambda i: (h(9, i), i))[:cap]
        assert ids(S.take(frame.repartition(parts), cap, 9, "id", ["grp"])) == sorted(want)


def test_position_rank_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "POSITION_BLOCK", 10)
    d = spark.range(0, 1000, 3).withColumn("g", F.col("id") % 2)
    got = {r["id"]: r["r"] for r in S.position_ranked(d, "id", ["g"], "r").collect()}
    for g in (0, 1):
        seq = [i for i in range(0, 1000, 3) if i % 2 == g]
        assert [got[i] for i in seq] == list(range(1, len(seq) + 1))


def walk(rows, budget, seed):
    total, keep = 0, []
    for i, _, t in sorted(rows, key=lambda r: (h(seed, r[0]), r[0])):
        if total + t <= budget:
            keep.append(i)
            total += t
    return sorted(keep)


@pytest.mark.parametrize("budget", [0, 50, 1234, 60_000, 10**9])
def test_budget_walk_equals_the_sequential_one(frame, rows, budget):
    for parts in (1, 16):
        got = S.fill_budget(frame.repartition(parts), "tokens", budget, 3, "id", max_tokens=90)
        assert ids(got) == walk(rows, budget, 3)


def test_stages_are_disjoint_and_within_budget(spark, rows):
    d = spark.createDataFrame(
        [(i, t, "" if i % 4 else "extract_signatures_v2", "korean" if i % 2 else "code", 50, 100, i % 10 == 0) for i, _, t in rows],
        "id long, tokens long, augment_type string, task string, input_chars int, output_chars int, has_action boolean")
    budgets = [("stage1_base_lm", 30_000), ("stage2_curriculum", 9_000), ("stage3_distill", 8_000), ("stage4_instruction", 5_000)]
    out = S.curriculum_stages(d, budgets, 42, "id", ["extract_signatures_v2"], ["summary"], 90).collect()
    assert len({r["id"] for r in out}) == len(out)
    # Sequential reference walk over the same pools.
    used, want = set(), {}
    for n, (name, budget) in enumerate(budgets):
        pool = []
        for i, _, t in rows:
            aug, task, act = ("" if i % 4 else "extract_signatures_v2"), ("korean" if i % 2 else "code"), i % 10 == 0
            ok = {
                "stage1_base_lm": aug == "",
                "stage2_curriculum": aug != "" or act,
                "stage3_distill": (task == "korean" and (aug == "" or act)) or task == "code",
                "stage4_instruction": task == "korean" or act,
            }[name]
            if ok and i not in used:
                pool.append((i, "", t))
        keep = walk(pool, budget, f"42{n}")
        used |= set(keep)
        want[name] = keep
    for name, _ in budgets:
        assert sorted(r["id"] for r in out if r["stage"] == name) == want[name]


def test_draws_follow_the_weights(frame):
    d = S.weighted_draws(frame, 6000, F.when(F.col("grp") == "hot", 3.0).otherwise(1.0), 5, "id")
    assert d.count() == 6000
    hot = d.join(frame, "id").filter("grp = 'hot'").count()
    assert abs(hot / 6000 - 6 / 7) < 0.03


def test_weighted_take_without_replacement(frame):
    got = ids(S.weighted_take(frame, 500, F.col("tokens"), 5, "id"))
    assert len(got) == len(set(got)) == 500


def test_balanced_and_quota(frame, rows):
    b = S.balanced(frame, 90, 1, "id", "grp")
    assert b.count() == 90
    sizes = {}
    for r in b.collect():
        sizes[r["grp"]] = sizes.get(r["grp"], 0) + 1
    assert min(sizes.values()) >= 90 // len(sizes)
    lim = frame.groupBy("grp").agg((F.count("*") + 10).alias("quota"))
    q = S.quota(frame, lim, 1, "id", "grp", upsample=True)
    assert q.count() == len(rows) + 10 * lim.count()
    assert q.filter("_meta_upsampled").count() == 10 * lim.count()


def test_backfill_targets():
    assert S.backfill_targets(100, 0.84, 1000, 1000) == (84, 16)
    assert S.backfill_targets(100, 0.84, 10, 1000) == (10, 90)
    assert S.backfill_targets(100, 0.84, 1000, 4) == (96, 4)


def test_replay_rounds_half_to_even(spark):
    a, b = spark.range(10), spark.range(100, 103)
    assert S.replay_mix(a, b, 0.8, 0.2, 1, "id").filter("_stage3b_mix <> ''").count() == round(10 * 0.2 / 0.8)


def test_position_ranks_by_a_tree_of_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(S, "POSITION_BLOCK", 4)
    rnd = random.Random(3)
    pos = rnd.sample(range(-50, 3000), 400) + [2**40 + k for k in range(30)]
    got = S.position_ranked(spark.createDataFrame([(p,) for p in pos], "pos long").repartition(7), "pos", rank="r", total="n").collect()
    assert {r["pos"]: r["r"] for r in got} == {p: k for k, p in enumerate(sorted(pos), 1)} and {r["n"] for r in got} == {430}
