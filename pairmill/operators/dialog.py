"""Conversations to pairs, candidates, leaderboards, paragraph chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmill.functions import text as X


TURN_BLOCK = 4096


def dialog_pairs(df: DataFrame, conv: str, turn: str, role: str, content: str) -> DataFrame:
    """Latest user text followed by the next assistant text, in turn order.

    Other roles and empty texts are skipped first, so the previous remaining row decides: one
    lag. The lag runs per block of turns, which bounds a window whatever a conversation holds;
    only the first row of a later block looks at the last row of the block before it.
    """
    rows = df.select(
        conv, turn, F.lower(X.strip(role)).alias("_role"), X.clean_text(content).alias("_text"), F.floor(F.col(turn) / TURN_BLOCK).alias("_b")
    ).filter((F.col("_text") != "") & F.col("_role").isin("user", "assistant"))
    w = Window.partitionBy(conv, "_b").orderBy(turn)
    inside = (
        rows.withColumn("_prev", F.lag("_role").over(w))
        .withColumn("input", F.lag("_text").over(w))
        .filter((F.col("_role") == "assistant") & (F.col("_prev") == "user"))
        .select(conv, turn, "input", F.col("_text").alias("output"))
    )
    later = df.filter(F.col(turn) >= TURN_BLOCK).select(conv)
    long = rows.join(later.distinct(), conv, "left_semi")
    row = F.struct(F.col(turn).alias("t"), "_role", "_text")
    ends = long.groupBy(conv, "_b").agg(F.min(row).alias("head"), F.max(row).alias("tail"))
    before = F.lag("tail").over(Window.partitionBy(conv).orderBy("_b"))
    across = ends.withColumn("prev", before).filter((F.col("head._role") == "assistant") & (F.col("prev._role") == "user"))
    return inside.unionByName(across.select(conv, F.col("head.t").alias(turn), F.col("prev._text").alias("input"), F.col("head._text").alias("output")))


def alternating_pairs(items: Column) -> Column:
    """Array elements (0,1), (2,3), .. as an array of (pos, input, output) structs."""
    def pairs(a):
        n = F.floor(F.size(a) / 2).cast("int")
        two = F.transform(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
            lambda i: F.struct(i.alias("pos"), F.get(a, i * 2).alias("input"), F.get(a, i * 2 + 1).alias("output")),
        )
        return F.slice(two, F.lit(1), n)

    # Bound as a lambda variable: the array is built once, not once per element.
    return F.get(F.transform(F.array(items), pairs), F.lit(0))


def best_of(df: DataFrame, keys: Sequence[str], score: Column | str, position: Column | str) -> DataFrame:
    """Highest score per key, first position wins ties."""
    w = Window.partitionBy(*keys).orderBy(X.col(score).desc(), X.col(position))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def meta_score(df: DataFrame, loss: str, mtime: str, bounds: DataFrame) -> DataFrame:
    """0.88 loss part + 0.12 recency part; ``bounds`` is the one-row (oldest, newest) aggregate."""
    d = df.crossJoin(F.broadcast(bounds))
    part = (3.0 - F.least(F.greatest(F.col(loss), F.lit(0.0)), F.lit(3.0))) / 3.0
    span = F.col("newest") - F.col("oldest")
    fresh = F.when(span <= 0, 0.5).otherwise((F.col(mtime) - F.col("oldest")) / span)
    return d.withColumn("meta_score", 0.88 * part + 0.12 * fresh).drop("newest", "oldest")


def total_score(meta: Column, probe: Column) -> Column:
    """0.68 meta + 0.32 probe, or 0.95 meta where no probe ran."""
    return F.when(probe.isNull(), 0.95 * meta).otherwise(0.68 * meta + 0.32 * probe)


def paragraphs(c, min_len: int) -> Column:
    parts = F.split(X.text(c), rf"\n[ {X.ODD_BLANK}]*\n+")
    return F.filter(F.transform(parts, X.normalize_space), lambda p: F.length(p) >= min_len)


def chunk_paragraphs(paras: Column, min_chars: int = 500, target_chars: int = 1500) -> Column:
    """Pack paragraphs in order; a chunk closes once it has ``min_chars`` and the next would pass the target."""
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("buf")
    )

    def step(acc, p):
        size = F.length(acc["buf"])
        add = F.length(p) + F.when(size > 0, 2).otherwise(0)
        full = (size >= min_chars) & (size + add > target_chars)
        joined = F.when(size > 0, F.concat(acc["buf"], F.lit("\n\n"), p)).otherwise(p)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["buf"])).otherwise(acc["done"]).alias("done"),
            F.when(full, p).otherwise(joined).alias("buf"),
        )

    return F.aggregate(
        paras,
        start,
        step,
        lambda a: F.when(F.length(a["buf"]) >= min_chars, F.array_append(a["done"], a["buf"])).otherwise(a["done"]),
    )


def cut_at(c: Column, share: float, edge: int) -> tuple[Column, Column]:
    """Cut a text at ``share`` of its length, at least ``edge`` characters from either end."""
    n = F.length(c)
    at = F.least(F.greatest(F.floor(n * share).cast("int"), F.lit(edge)), n - edge)
    return X.strip(F.substr(c, F.lit(1), at)), X.strip(F.substr(c, at + 1))


def leaderboard(df: DataFrame, score: str, key: str) -> DataFrame:
    """Rank by score, best first, equal scores sharing a rank.

    Rows are counted per distinct score first, and only distinct scores are ranked, in steps of a
    thousandth: any number of rows may share a score.
    """
    d = df.withColumn("_s", F.round(-F.col(score), 9))
    per = d.groupBy("_s").agg(F.count("*").alias("_n")).withColumn("_block", F.floor(F.col("_s") * 1000))
    w = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # Scores lie in [0, 1]: at most a thousand steps.
    off = per.groupBy("_block").agg(F.sum("_n").alias("_m")).select("_block", F.coalesce(F.sum("_m").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_block").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    places = per.join(off, "_block").select("_s", (F.coalesce(F.sum("_n").over(inner), F.lit(0)) + F.col("_before") + 1).alias("place"))
    return d.join(places, "_s").drop("_s")


def consensus(df: DataFrame, group: str, order: Sequence[Column], tokens: str, top: int = 4) -> DataFrame:
    """Mean overlap of the best candidate with the next ones; 1 when it is alone.

    Only the first ``top`` rows per group leave their map task.
    """
    w = Window.partitionBy(group).orderBy(*order)
    d = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).select(group, "_r", tokens)
    g = d.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_r", tokens))).alias("c"))
    best = F.get("c", F.lit(0)).getField(tokens)
    rest = F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(1)))

    def sim(x):
        k = x[tokens]
        n = F.size(F.array_intersect(best, k))
        return F.when(F.size(k) == 0, 0.0).otherwise(n.cast("double") / F.greatest(F.size(best) + F.size(k) - n, F.lit(1)))

    mean = F.aggregate(F.transform(rest, sim), F.lit(0.0), lambda a, v: a + v) / F.size(rest)
    return g.select(group, F.when(F.size("c") <= 1, 1.0).when(F.size(best) == 0, 0.0).otherwise(mean).alias("consensus"))
