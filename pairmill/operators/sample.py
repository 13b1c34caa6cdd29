"""Caps, samples, mixes, splits and budgets, with results independent of the partition count.

Random order is the order of a seeded hash of the row key. Ranks come from two levels:
rows are counted per block of the hash space (or of the position), the block counts are
summed in order, and rows are ranked only inside their block. No window ever holds a whole
source, so a source with a third of all rows is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hash blocks: the first hex digits of the md5 order key. A block holds an even share of its
# group because the order key is a hash: 1/65,536 of a whole table, 1/4,096 of one group.
GLOBAL_DIGITS, GROUP_DIGITS = 4, 3
POSITION_BLOCK = 65_536


def order_key(seed: int | str, *cols) -> Column:
    """Seeded hash of a row key, as hex text; the same on any engine that has md5."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_block(key: str = "_ord", digits: int = GLOBAL_DIGITS) -> Column:
    return F.substring(F.col(key), 1, digits)


def uniform(key: Column) -> Column:
    """Hash text to a number inside (0, 1): 52 bits, never 0 or 1."""
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def first_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """First ``n`` rows of a total order, for small report-sized ``n``."""
    return df.orderBy(*order).limit(n)


def _offsets(df: DataFrame, groups: Sequence[str], value: Column) -> DataFrame:
    """(groups, block, start, total): running sum of ``value`` before each block."""
    sums = df.groupBy(*groups, "_block").agg(value.alias("_v"))
    w = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    return sums.select(
        *groups, "_block",
        F.coalesce(F.sum("_v").over(w), F.lit(0)).alias("_start"),
        F.sum("_v").over(whole).alias("_total"),
    )


def _tree_offsets(df: DataFrame, value: Column) -> DataFrame:
    """As ``_offsets`` of a whole table whose blocks are whole numbers, without a window over all of them.

    Blocks are summed by 2^16, these sums again by 2^16, and running sums are made inside each node of that tree, so no
    window has more than 65,536 rows, whatever the number of blocks.
    """
    blocks = df.groupBy("_block").agg(value.alias("_v")).withColumn("_b1", F.floor(F.col("_block") / POSITION_BLOCK))
    middle = blocks.groupBy("_b1").agg(F.sum("_v").alias("_v1")).withColumn("_b2", F.floor(F.col("_b1") / POSITION_BLOCK))
    top = middle.groupBy("_b2").agg(F.sum("_v1").alias("_v2"))

    def before(v: str, node: Column | str, order: str) -> Column:
        return F.coalesce(F.sum(v).over(Window.partitionBy(node).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    top = top.select("_b2", before("_v2", F.lit(0), "_b2").alias("_s2"), F.sum("_v2").over(Window.partitionBy(F.lit(0))).alias("_total"))
    middle = middle.join(top, "_b2").select("_b1", (F.col("_s2") + before("_v1", "_b2", "_b1")).alias("_s1"), "_total")
    return blocks.join(middle, "_b1").select("_block", (F.col("_s1") + before("_v", "_b1", "_block")).alias("_start"), "_total")


def ranked(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], block: Column,
           rank: str = "rank", total: str | None = None, limit: Column | None = None, few_blocks: bool = False, numbered: bool = False) -> DataFrame:
    """Exact 1-based rank inside each group (all rows if ``groups`` is empty).

    ``block`` must be a coarse, order-preserving function of the first order column.
    ``limit`` drops blocks that start beyond it before any row is sorted. ``few_blocks`` says
    that the number of blocks has a fixed bound, which makes the summed table broadcastable. ``numbered``: blocks are whole
    numbers, and any number of them can be summed in order.
    """
    d = df.withColumn("_block", block)
    off = _tree_offsets(d, F.count("*")) if numbered and not groups else _offsets(d, groups, F.count("*"))
    if limit is not None:
        off = off.filter(F.col("_start") < limit)
    joined = d.join(F.broadcast(off) if few_blocks else off, [*groups, "_block"])
    w = Window.partitionBy(*groups, "_block").orderBy(*order)
    out = joined.withColumn(rank, F.row_number().over(w) + F.col("_start"))
    if limit is not None:
        out = out.filter(F.col(rank) <= limit)
    if total is not None:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_block", "_start", "_total")


def hash_ranked(df: DataFrame, seed, key: str | Sequence[str], groups: Sequence[str] = (), rank: str = "rank",
                total: str | None = None, limit: Column | None = None) -> DataFrame:
    """Rank in seeded random order."""
    keys = [key] if isinstance(key, str) else list(key)
    d = df.withColumn("_ord", order_key(seed, *keys))
    block = hash_block(digits=GROUP_DIGITS if groups else GLOBAL_DIGITS)
    return ranked(d, groups, ["_ord", *keys], block, rank, total, limit, few_blocks=not groups).drop("_ord")


def position_ranked(df: DataFrame, pos: str, groups: Sequence[str] = (), rank: str = "rank", total: str | None = None,
                    limit: Column | None = None) -> DataFrame:
    """Rank in input order by an integer position."""
    return ranked(df, groups, [pos], F.floor(F.col(pos) / POSITION_BLOCK), rank, total, limit, numbered=True)


def take(df: DataFrame, n: int, seed, key, groups: Sequence[str] = ()) -> DataFrame:
    """``n`` rows in seeded random order, per group if given."""
    return hash_ranked(df, seed, key, groups, "_r", limit=F.lit(n)).drop("_r")


def take_first(df: DataFrame, n: int, pos: str, groups: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows by position, per group if given (running caps in input order)."""
    return position_ranked(df, pos, groups, "_r", limit=F.lit(n)).drop("_r")


def seeded_shuffle(df: DataFrame, seed, key: str, place: str = "place") -> DataFrame:
    """All rows in seeded random order, with their place in it (from 1), so that the order outlives later shuffles."""
    return hash_ranked(df, seed, key, rank=place).orderBy(place)


def repeat_cap(df: DataFrame, key: str, pos: str, short_len: int = 72, short_cap: int = 5, long_cap: int = 10) -> DataFrame:
    """At most ``short_cap``/``long_cap`` rows per identical text; refused rows do not count.

    The literal upper bound lets Spark prune each map task to ``long_cap`` rows per text.
    """
    w = Window.partitionBy(key).orderBy(pos)
    cap = F.when(F.length(key) <= short_len, short_cap).otherwise(long_cap)
    d = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max(short_cap, long_cap))
    return d.filter(F.col("_r") <= cap).drop("_r")


def prefix_key(words: Column, n: int = 4) -> Column:
    return F.array_join(F.slice(words, 1, n), " ")


def balanced(df: DataFrame, n: int, seed, key: str, group: str) -> DataFrame:
    """max(1, n // groups) rows of each group, the rest of ``n`` filled from the leftovers."""
    groups = df.select(group).distinct().count()
    per = max(1, n // max(1, groups))
    d = hash_ranked(df, seed, key, [group], "_r")
    # Quota rows first, leftovers after, each in hash order: one global rank decides.
    d = d.withColumn("_late", (F.col("_r") > per).cast("int")).withColumn("_ord", order_key(seed, key))
    block = F.concat(F.col("_late").cast("string"), hash_block())
    out = ranked(d, [], ["_late", "_ord", key], block, "_g", limit=F.lit(n))
    return out.drop("_r", "_late", "_ord", "_g")


def quota(df: DataFrame, limits: DataFrame, seed, key: str, group: str, upsample: bool = False) -> DataFrame:
    """Per-group limits from ``limits(group, quota)``; optionally filled up with flagged copies.

    Copies are drawn with replacement: draw ``j`` of a group takes the row whose rank is a
    hash of ``j`` modulo the group size, so both sides meet in an equi-join on (group, rank).
    """
    lim = limits.select(F.col(group), F.col("quota").cast("long").alias("_q"))
    d = hash_ranked(df, seed, key, [group], "_r", total="_n").join(lim, group)
    base = d.filter(F.col("_r") <= F.col("_q")).withColumn("_meta_upsampled", F.lit(False))
    if not upsample:
        return base.drop("_r", "_n", "_q")
    need = d.select(group, "_n", "_q").distinct().filter(F.col("_q") > F.col("_n"))
    draws = need.withColumn("_j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_q") - F.col("_n")))).withColumn(
        "_r", 1 + F.pmod(F.conv(F.substring(order_key(seed, group, "_j"), 1, 12), 16, 10).cast("long"), F.col("_n"))
    )
    extra = d.drop("_n", "_q").join(draws.select(group, "_r"), [group, "_r"]).withColumn("_meta_upsampled", F.lit(True))
    return base.drop("_r", "_n", "_q").unionByName(extra.drop("_r"))


def counts(*dfs: DataFrame) -> list[int]:
    return [d.count() for d in dfs]


def ratio_mix(a: DataFrame, b: DataFrame, ratio: tuple[int, int], seed, key: str, floor_rows: int = 60_000) -> DataFrame:
    """total = min(a+b, max(floor, b)); int(total * share) rows of a, the rest of b."""
    na, nb = counts(a, b)
    total = min(na + nb, max(floor_rows, nb))
    n_a = int(total * (ratio[0] / float(sum(ratio))))
    left = take(a, n_a, seed, key).withColumn("_mix_source", F.lit("a"))
    return left.unionByName(take(b, total - n_a, seed, key).withColumn("_mix_source", F.lit("b")))


def ratio_mix_fill(pools: Sequence[tuple[str, DataFrame]], ratio: Sequence[int], target: int, seed, key: str) -> DataFrame:
    """Targets per pool by weight; the shortfall is filled from the leftovers in turn.

    Leftovers are popped from the far end of each pool, one per pool and round.
    """
    total = float(sum(ratio))
    want = [int(target * (r / total)) for r in ratio]
    parts = []
    for i, ((name, df), n) in enumerate(zip(pools, want)):
        d = hash_ranked(df, seed, key, (), "_r", total="_n").withColumn("_mix_source", F.lit(name))
        late = F.when(F.col("_r") > n, F.col("_n") - F.col("_r") + 1).otherwise(F.lit(0))
        parts.append(d.withColumn("_round", late).withColumn("_pool", F.lit(i)))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    # Order: all selected rows (round 0), then round 1 of each pool, round 2, ..
    block = F.when(F.col("_round") == 0, F.lit(-1)).otherwise(F.floor(F.col("_round") / POSITION_BLOCK))
    d = u.withColumn("_o", F.col("_round"))
    # Round 0 is kept whole (its size never passes the target), only leftovers need ranks.
    chosen = d.filter("_round = 0")
    rest = max(0, target - sum(min(n, c) for n, c in zip(want, counts(*[p for _, p in pools]))))
    extra = ranked(d.filter("_round > 0"), [], ["_round", "_pool"], block, "_g", limit=F.lit(rest)).drop("_g")
    return chosen.unionByName(extra).drop("_r", "_n", "_round", "_pool", "_o")


def replay_mix(a: DataFrame, b: DataFrame, ratio_a: float, ratio_b: float, seed, key: str) -> DataFrame:
    """All of a plus round(len(a) * rb / ra) rows of b, cycling b; ties round half to even."""
    na, nb = counts(a, b)
    want = round(na * ratio_b / ratio_a)
    cycles = -(-want // max(1, nb))
    d = hash_ranked(b, seed, key, (), "_r").withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(max(0, cycles - 1)))))
    reps = d.filter(F.col("_c") * nb + F.col("_r") <= want).drop("_r", "_c")
    return a.withColumn("_stage3b_mix", F.lit("")).unionByName(reps.withColumn("_stage3b_mix", F.lit("logic_replay")))


def backfill_targets(cap: int, ratio: float, main: int, other: int) -> tuple[int, int]:
    """round(cap * ratio) of the main group, the rest others, spare moved to whichever has rows."""
    t_main = min(int(round(cap * min(max(ratio, 0.0), 1.0))), main)
    t_other = min(cap - t_main, other)
    spare = cap - t_main - t_other
    add = min(main - t_main, spare)
    return t_main + add, t_other + min(other - t_other, spare - add)


def weighted_take(df: DataFrame, n: int, weight: Column, seed, key: str) -> DataFrame:
    """Weighted sample without replacement: the ``n`` largest u^(1/w), u from the row hash.

    log(u)/w keeps the same order. Blocks are cut in the logarithm of that score, which one weight or another
    only shifts: a block holds about a thousandth of the rows of equal weight, be it small or huge.
    """
    u = uniform(order_key(seed, key))
    score = F.round(F.log(u) / F.greatest(weight.cast("double"), F.lit(1e-6)), 9)
    d = df.withColumn("_s", -score)
    block = F.floor(F.log2(F.greatest(F.col("_s"), F.lit(1e-9))) * 1024)
    return ranked(d, [], ["_s", key], block, "_r", limit=F.lit(n)).drop("_s", "_r")


def weighted_draws(df: DataFrame, k: int, weight: Column, seed, key: str) -> DataFrame:
    """``k`` draws with replacement in proportion to ``weight``.

    Rows get cumulative weight intervals from two-level sums. A draw point belongs to one
    block; points and intervals meet inside the block, so no task sees the whole table.
    """
    spark = df.sparkSession
    d = df.withColumn("_w", (weight * 1_000_000).cast("long")).withColumn("_ord", order_key(seed, key)).withColumn("_block", hash_block())
    off = _offsets(d, [], F.sum("_w"))
    w = Window.partitionBy("_block").orderBy("_ord", key)
    iv = d.join(off, "_block").withColumn("_hi", F.sum("_w").over(w) + F.col("_start")).withColumn("_lo", F.col("_hi") - F.col("_w"))
    # Both draws and block intervals are cut into the same fixed slots, so a draw meets the one
    # or two blocks of its slot by an equi-join; the blocks have a fixed bound of 16^4 rows.
    slots = 4096
    wide = Window.orderBy("_block")
    ends = off.select("_block", F.col("_start").alias("_b0"), F.coalesce(F.lead("_start", 1).over(wide), F.col("_total")).alias("_b1"), F.col("_total").alias("_all"))
    ends = ends.filter("_b1 > _b0").withColumn("_slot", F.explode(F.sequence(F.floor(F.col("_b0") * slots / F.col("_all")), F.floor((F.col("_b1") - 1) * slots / F.col("_all")))))
    all_w = d.agg(F.sum("_w").alias("_sum"))
    u = uniform(order_key(seed, F.lit("draw"), "draw"))
    pts = spark.range(k).withColumnRenamed("id", "draw").crossJoin(F.broadcast(all_w)).withColumn("_p", F.floor(u * F.col("_sum")))
    pts = pts.withColumn("_slot", F.floor(F.col("_p") * slots / F.col("_sum"))).join(F.broadcast(ends), "_slot")
    pts = pts.filter((F.col("_p") >= F.col("_b0")) & (F.col("_p") < F.col("_b1"))).select("draw", "_block", "_p")
    hit = pts.join(iv.select(key, "_block", "_lo", "_hi"), "_block").filter((F.col("_p") >= F.col("_lo")) & (F.col("_p") < F.col("_hi")))
    return hit.select("draw", key)


def systematic(df: DataFrame, n: int, seed, key: str, pos: str) -> DataFrame:
    """Every (rows // n)-th row from a seeded offset."""
    total = df.count()
    if n >= total:
        return df
    step = max(1, total // n)
    offset = int(__import__("hashlib").md5(str(seed).encode()).hexdigest()[:8], 16) % step
    d = position_ranked(df, pos, (), "_r")
    i = F.col("_r") - 1 - offset
    return d.filter((i >= 0) & (i % step == 0) & (F.floor(i / step) < n)).drop("_r")


def clamped_split(df: DataFrame, seed, key: str, lo: int = 1024, hi: int = 4096, share: float = 0.02) -> DataFrame:
    """eval = min(hi, max(lo, int(share * rows))) rows of the shuffled set, the rest train."""
    n = df.count()
    size = min(hi, max(lo, int(n * share)))
    d = hash_ranked(df, seed, key, (), "_r")
    return d.withColumn("split", F.when(F.col("_r") <= size, "eval").otherwise("train")).drop("_r")


def ratio_split(df: DataFrame, seed, key: str, val_ratio: float) -> DataFrame:
    """cut = int(n * (1 - val)), clamped so that neither side is empty."""
    n = df.count()
    cut = int(n * (1.0 - val_ratio))
    if cut <= 0 or cut >= n:
        cut = max(1, n - 1)
    d = hash_ranked(df, seed, key, (), "_r")
    return d.withColumn("split", F.when(F.col("_r") <= cut, "train").otherwise("val")).drop("_r")


def stable_mod(c, mod: int) -> Column:
    """Bucket of a text: first eight hex digits of its sha1, modulo ``mod``."""
    text = F.col(c) if isinstance(c, str) else c
    return F.conv(F.substring(F.sha1(text.cast("string")), 1, 8), 16, 10).cast("long") % mod


def replicate(df: DataFrame, weight: Column) -> DataFrame:
    """Each row written ``weight`` times; run after deduplication."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), weight.cast("int")))).drop("_copy")


def repeat_pool(df: DataFrame, times: int) -> DataFrame:
    """Whole pool repeated; copies are made row by row, without a join."""
    return replicate(df, F.lit(times)) if times > 0 else df.limit(0)


def curriculum_weight(rank: Column, progress: float) -> Column:
    """Loss weight of tier ids 0/1/2 at training progress p."""
    return (
        F.when(rank == 2, 1.2 * (1.0 + 0.80 * progress))
        .when(rank == 1, 1.1 * (1.0 + 0.35 * progress))
        .otherwise(F.lit(1.0))
    )


def domain_weight(domain: Column, progress: float, script_focus: float, doc_focus: float) -> Column:
    return (
        F.when(domain == 2, 1.0 + script_focus * progress)
        .when(domain == 1, 1.0 + doc_focus * progress)
        .when(domain == 0, F.lit(1.0))
        .otherwise(1.0 + 0.15 * progress)
    )


def sampler_weight(tier: Column, domain: Column) -> Column:
    """Tier 1.7/1.25/1.0 times domain 1.0/1.3/1.6/1.1."""
    t = F.when(tier == 2, 1.7).when(tier == 1, 1.25).otherwise(1.0)
    return t * F.when(domain == 0, 1.0).when(domain == 1, 1.3).when(domain == 2, 1.6).otherwise(1.1)


def decay_scores(df: DataFrame, key: str, score: str, decay: float, max_size: int) -> DataFrame:
    """round(score * decay), zeros dropped, the ``max_size`` largest kept."""
    d = df.withColumn(score, F.bround(F.col(score) * decay).cast("long")).filter(F.col(score) > 0)
    return d.orderBy(F.col(score).desc(), F.col(key)).limit(max_size)


def focus_batch(df: DataFrame, scores: DataFrame, n: int, ratio: float, seed, key: str, score: str) -> DataFrame:
    """A share of the batch from the top scores, the rest a random draw of the others."""
    top = scores.orderBy(F.col(score).desc(), F.col(key)).limit(round(ratio * n)).select(key)
    hot = df.join(F.broadcast(top), key).withColumn("_focus", F.lit(True))
    others = df.join(F.broadcast(top), key, "left_anti")
    want = n - hot.count()
    return hot.unionByName(others.orderBy(order_key(seed, key), key).limit(want).withColumn("_focus", F.lit(False)))


def pools_take(df: DataFrame, sizes: dict[str, int], seed, key: str, tag: str) -> DataFrame:
    """Given number of rows from each tagged pool."""
    spark = df.sparkSession
    lim = spark.createDataFrame(list(sizes.items()), f"{tag} string, _q long")
    d = hash_ranked(df, seed, key, [tag], "_r")
    return d.join(F.broadcast(lim), tag).filter(F.col("_r") <= F.col("_q")).drop("_r", "_q")


# ------------------------------------------------------------------ token budgets


def fill_budget(df: DataFrame, tokens: str, budget: int, seed, key: str, max_tokens: int = 12_000) -> DataFrame:
    """Rows taken in seeded random order while total + tokens <= budget; a row that does not fit
    is skipped and the walk goes on. Exact, although the walk is sequential by definition:

    * the rows before the first misfit are a prefix of the order, found with two-level sums;
    * after it less than one row's worth of room is left (< ``max_tokens``). At most room // t
      rows of size t can still fit, so the candidates number under room * (1 + ln room) rows,
      whatever the table holds, and one small task finishes the walk.

    The shortest-first second pass of the source rules adds nothing: a row skipped once never
    fits later, because the total only grows.
    """
    d = df.filter((F.col(tokens) > 0) & (F.col(tokens) <= max_tokens)).withColumn("_ord", order_key(seed, key))
    d = d.withColumn("_block", hash_block())
    off = _offsets(d, [], F.sum(tokens))
    w = Window.partitionBy("_block").orderBy("_ord", key)
    # Blocks that start beyond the budget cannot belong to the prefix and are not sorted.
    cum = d.join(F.broadcast(off.filter(F.col("_start") <= budget)), "_block").withColumn("_cum", F.sum(tokens).over(w) + F.col("_start"))
    used, last = cum.filter(F.col("_cum") <= budget).agg(F.coalesce(F.max("_cum"), F.lit(0)), F.max(F.struct("_ord", key))).first()
    names = df.columns
    prefix = cum.filter(F.col("_cum") <= budget).select(*names)
    room = budget - int(used)
    if room <= 0:
        return prefix
    after = d.filter(F.col(tokens) <= room)
    if last is not None:
        at, who = F.lit(last[0]), F.lit(last[1]).cast(df.schema[key].dataType)
        after = after.filter((F.col("_ord") > at) | ((F.col("_ord") == at) & (F.col(key) > who)))
    small = after.select(key, "_ord", tokens)
    cand = ranked(small, [tokens], ["_ord", key], hash_block(digits=2), "_r", limit=F.floor(F.lit(room) / F.col(tokens))).drop("_r")
    schema = df.select(key).schema

    def walk(batches):
        rows = sorted((o, k, t) for pdf in batches for o, k, t in zip(pdf["_ord"], pdf[key], pdf[tokens]))
        left, keep = room, []
        for _, k, t in rows:
            if t <= left:
                left -= t
                keep.append(k)
        yield pd.DataFrame({key: keep})

    # One task on purpose: the candidate count has the fixed bound given above.
    extra = cand.select("_ord", key, tokens).repartition(1).mapInPandas(walk, schema)
    return prefix.unionByName(df.join(F.broadcast(extra), key, "left_semi").select(*names))


# Stage budgets in tokens.
STAGES = (("stage1_base_lm", 22_000_000), ("stage2_curriculum", 10_000_000), ("stage3_distill", 14_000_000), ("stage4_instruction", 4_000_000))


def stage_pools(df: DataFrame, curriculum: Sequence[str], distill: Sequence[str]) -> dict[str, Column]:
    """Membership of the four pools by augment type, task, tokens, lengths and action trace."""
    aug, tok, task = F.col("augment_type"), F.col("tokens"), F.col("task")
    base, cur, dis = aug == "", aug.isin(*curriculum), aug.isin(*distill)
    ko, code, act = task == "korean", task == "code", F.col("has_action")
    return {
        "stage1_base_lm": base,
        "stage2_curriculum": cur | (base & (tok >= 900)) | act,
        "stage3_distill": dis
        | (ko & (tok <= 1400) & (F.col("input_chars") <= 600) & (F.col("output_chars") <= 220) & (base | act))
        | (code & (tok <= 900) & (F.col("output_chars") <= 140)),
        "stage4_instruction": (dis & (tok <= 1100)) | (ko & (tok <= 1200) & (F.col("output_chars") <= 240)) | (act & (tok <= 1400)),
    }


def curriculum_stages(df: DataFrame, budgets: Sequence[tuple[str, int]], seed, key: str, curriculum: Sequence[str],
                      distill: Sequence[str], max_tokens: int = 12_000, rejected: str | None = None) -> DataFrame:
    """Each stage fills its budget from keys no earlier stage used.

    Rows of over ``max_tokens`` fit no stage; with ``rejected`` those that stand in a pool come too, as the stage of that name.
    """
    from pairmill.session import cut_lineage

    pools = stage_pools(df, curriculum, distill)
    # Texts are read once: the stages work on (key, tokens, pool flags).
    narrow = cut_lineage(df.select(key, "tokens", *[pools[name].alias(name) for name, _ in budgets]))
    done = None
    for i, (name, budget) in enumerate(budgets):
        cand = narrow.filter(name).select(key, "tokens")
        if done is not None:
            cand = cand.join(done, key, "left_anti")
        sel = cut_lineage(fill_budget(cand, "tokens", budget, f"{seed}{i}", key, max_tokens).withColumn("stage", F.lit(name)))
        done = sel if done is None else done.unionByName(sel)
    if rejected is not None:
        pooled = reduce(or_, [F.col(name) for name, _ in budgets])
        done = done.select(key, "stage").unionByName(narrow.filter(pooled & (F.col("tokens") > max_tokens)).select(key, F.lit(rejected).alias("stage")))
    return df.join(done.select(key, "stage"), key)
