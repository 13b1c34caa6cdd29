"""Greedy novelty filter over keyword sets and rule texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.functions import text as X
from pairmill.operators.graph import hot_lookup
from pairmill.session import cut_lineage

#: Rows of one key that are compared with one another; larger groups first meet their first row only, while that thins them.
PAIR_ROWS, THINNED = 64, 0.8


def rule_keywords(keywords: Column, prompt_tokens: Column | None = None) -> Column:
    """Trimmed, lower-case, distinct keywords; where none is left, the prompt's tokens, else "rule"."""
    k = F.array_distinct(F.filter(F.transform(keywords, lambda x: F.lower(X.strip(x))), lambda x: x != ""))
    rule = F.array(F.lit("rule"))
    other = rule if prompt_tokens is None else F.when(F.size(prompt_tokens) > 0, F.array_distinct(prompt_tokens)).otherwise(rule)
    return F.when(F.size(k) > 0, k).otherwise(other)


def shared_keys(df: DataFrame, row: str, tokens: str, threshold: float) -> DataFrame:
    """(row, _keys): any two different sets whose overlap (Jaccard) reaches ``threshold`` have a key in common.

    All tokens stand in one order, rare ones first by their counts in the table. Two such sets of two tokens or more share
    two tokens within the first n - ceil(threshold * n) + 2, so each pair of these is a key. A token of half the rows is the
    last of its sets and in no key, unless all of a set is that frequent, and then it takes another token with it.
    """
    ex = cut_lineage(df.select(row, F.explode(tokens).alias("_tok")))
    counts = ex.groupBy("_tok").agg(F.count("*").alias("_df"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("_df", F.xxhash64("_tok").alias("h"), "_tok"))), lambda s: s["_tok"])
    d = hot_lookup(ex, counts, "_tok").groupBy(row).agg(order.alias("_all"))
    n = F.size("_all")
    first = F.slice("_all", F.lit(1), F.least(n, n - F.ceil(n * threshold - 1e-9).cast("int") + 2))
    pairs = F.flatten(F.transform(first, lambda x, i: F.transform(F.slice(first, i + 2, F.size(first)), lambda y: F.xxhash64(x, y))))
    return d.select(row, F.when(n > 1, pairs).otherwise(F.array(F.xxhash64(F.get("_all", F.lit(0))))).alias("_keys"))


def greedy_independent(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Rows of ``nodes`` that stay when each in order goes if an earlier neighbour stays; ``edges`` are (u, v) with u < v.

    Per round a row whose earlier neighbours are all decided is decided, and one with an earlier neighbour that stays goes.
    """
    if edges.isEmpty():
        return nodes
    state = nodes.select(F.col(node).alias("v"), F.lit(0).alias("st"))
    while True:
        seen = hot_lookup(edges, state.select(F.col("v").alias("u"), F.col("st").alias("su")), "u")
        seen = seen.groupBy("v").agg(F.max((F.col("su") == 1).cast("int")).alias("stays"), F.max((F.col("su") == 0).cast("int")).alias("open"))
        now = F.when(F.col("st") > 0, F.col("st")).when(F.col("stays") == 1, 2).when(F.col("open") == 1, 0).otherwise(1)
        state = cut_lineage(state.join(seen, "v", "left").select("v", now.alias("st")))
        if state.filter("st = 0").isEmpty():
            return state.filter("st = 1").select(F.col("v").alias(node))


def novelty_filter(df: DataFrame, pos: str, keywords: str, rule_text: str, threshold: float = 0.90, prompt_tokens: Column | None = None) -> DataFrame:
    """Greedy in ``pos`` order: a row is dropped when a kept earlier row has keyword overlap of at least ``threshold`` or
    the same normalized text (blank texts aside). Keywords as in ``rule_keywords``. Exact, without comparing whole groups.

    1. Rows with equal keywords and equal text: only the first can survive, whatever happens to it.
    2. Rows meet under ``shared_keys`` and their text. While a key has more than ``PAIR_ROWS`` rows, the first undecided row
       of all its keys is kept and the rows of these are tested against it alone, so a cluster of near copies goes in one
       round; it ends when rounds no longer thin the largest group.
    3. What is left is compared under common keys, sizes that can reach the threshold only, and the edges are resolved.
    """
    base = df.select(
        F.col(pos).alias("_p"),
        F.array_sort(rule_keywords(F.col(keywords), prompt_tokens)).alias("_set"),
        F.lower(X.normalize_space(rule_text)).alias("_low"),
    ).select("_p", "_set", F.sha2("_low", 256).alias("_txt"), (F.col("_low") != "").alias("_has"))
    reps = cut_lineage(base.withColumn("_k", F.md5(F.to_json("_set"))).groupBy("_k", "_txt", "_has").agg(F.min(F.struct("_p", "_set")).alias("r")).select("r.*", "_k", "_txt", "_has"))
    keys = shared_keys(reps, "_p", "_set", threshold)
    one = F.array(F.xxhash64("_k"))
    same = F.when(F.col("_has"), F.array(F.xxhash64(F.lit("text"), "_txt"))).otherwise(F.array().cast("array<long>"))
    left = cut_lineage(reps.join(keys, "_p").select("_p", "_set", "_txt", "_has", F.array_distinct(F.concat("_keys", one, same)).alias("_keys")))
    kept, last = None, None

    def groups(d: DataFrame) -> DataFrame:
        return d.select("_p", "_set", "_txt", "_has", F.explode("_keys").alias("g"))

    def near(a: str, b: str) -> Column:
        x, y = F.col(f"{a}_set"), F.col(f"{b}_set")
        return (X.jaccard(x, y) >= threshold) | (F.col(f"{a}_has") & F.col(f"{b}_has") & (F.col(f"{a}_txt") == F.col(f"{b}_txt")))

    while True:
        g = groups(left)
        most = g.groupBy("g").count().agg(F.max("count")).first()[0] or 0
        if most <= PAIR_ROWS or (last is not None and most > THINNED * last):
            break
        last = most
        heads = g.groupBy("g").agg(F.min(F.struct("_p", "_set", "_txt", "_has")).alias("h"))
        m = cut_lineage(hot_lookup(cut_lineage(g), heads, "g"))
        lead = cut_lineage(m.groupBy("_p").agg(F.min((F.col("h._p") == F.col("_p")).cast("int")).alias("ok")).filter("ok = 1").select("_p"))
        hit = m.filter((F.col("h._p") < F.col("_p")) & near("", "h.")).select("_p", F.col("h._p").alias("by")).distinct()
        gone = hit.join(lead.select(F.col("_p").alias("by")), "by", "left_semi").select("_p").distinct()
        kept = lead if kept is None else kept.unionByName(lead)
        left = cut_lineage(left.join(lead.unionByName(gone), "_p", "left_anti"))
    n = F.size("_set")
    g = groups(left).withColumn("n", n)
    a = g.select("g", "n", *[F.col(c).alias("a" + c) for c in ("_p", "_set", "_txt", "_has")])
    b = g.select("g", F.col("n").alias("m"), *[F.col(c).alias("b" + c) for c in ("_p", "_set", "_txt", "_has")])
    fits = (F.col("a_p") < F.col("b_p")) & ((F.least("n", "m") >= F.greatest("n", "m") * threshold - 1e-9) | (F.col("a_txt") == F.col("b_txt")))
    pairs = a.join(b, "g").filter(fits & near("a", "b"))
    edges = cut_lineage(pairs.select(F.col("a_p").alias("u"), F.col("b_p").alias("v")).distinct())
    stays = greedy_independent(left.select("_p"), edges, "_p")
    kept = stays if kept is None else kept.unionByName(stays)
    return df.join(kept.withColumnRenamed("_p", pos), pos, "left_semi")
