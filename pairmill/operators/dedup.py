"""Exact, cross-pool and near duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmill.functions import text as X


def pair_key(inp, out) -> Column:
    """Case-blind key of a normalized pair."""
    return F.sha2(F.concat_ws("\x00", F.lower(X.normalize_space(inp)), F.lower(X.normalize_space(out))), 256)


def task_key(*parts) -> Column:
    """Key over raw values, no normalization."""
    return F.sha1(F.concat_ws("\n", *[X.text(p) for p in parts]))


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Earliest row per key.

    Spark places a per-partition group limit of one row before the exchange, so a key that
    holds a third of the data ships at most one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def exact_pairs(df: DataFrame, inp: str, out: str, order: Sequence[str], min_inp: int = 2, min_out: int = 1) -> DataFrame:
    """Status per row: short, duplicate or kept, by exact stripped pair; ``order`` is unique per row."""
    i, o = X.strip(inp), X.strip(out)
    # The length of the first part keeps pairs apart that differ only in where a newline falls.
    d = df.withColumn("_k", F.sha2(F.concat_ws("\n", F.length(i).cast("string"), i, o), 256))
    short = (F.length(X.strip(inp)) < min_inp) | (F.length(X.strip(out)) < min_out)
    long_rows = d.filter(~short)
    # The first row per key is found on (key, order) only, with partial minima. Rows then meet it by
    # their own unique position, so a key shared by a third of the rows does not gather anywhere.
    lead = long_rows.groupBy("_k").agg(F.min(F.struct(*order)).alias("_lead")).select("_lead.*", F.lit(True).alias("_first"))
    flag = F.when(F.col("_first"), "kept").otherwise("duplicate")
    tagged = long_rows.join(lead, list(order), "left").withColumn("status", flag).drop("_first").select(*d.columns, "status")
    return d.filter(short).withColumn("status", F.lit("short")).unionByName(tagged).drop("_k")


def cross_pool_unique(pools: Sequence[tuple[str, DataFrame]], key: str, order: Sequence[str]) -> DataFrame:
    """A key used by an earlier pool is not available later: first wins by (pool rank, order).

    One pass over the union gives the same rows as removing used keys pool by pool.
    """
    u = None
    for rank, (name, df) in enumerate(pools):
        p = df.withColumn("pool", F.lit(name)).withColumn("_rank", F.lit(rank))
        u = p if u is None else u.unionByName(p)
    return first_wins(u, [key], ["_rank", *order]).drop("_rank")


def best_per_term(df: DataFrame, term: str, score: Sequence[Column], pos: str) -> DataFrame:
    """One row per term: highest score tuple, first position wins ties."""
    return first_wins(df, [term], [*[s.desc() for s in score], F.col(pos)])
