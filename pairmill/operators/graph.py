"""Lookups that stand hot keys, and connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.session import cut_lineage

#: A key with more than this part of the rows, and more than this many of them, is looked up by broadcast.
HOT_SHARE, HOT_ROWS = 0.001, 10_000


def hot_lookup(left: DataFrame, right: DataFrame, key: str, share: float = HOT_SHARE, least: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row per ``key``.

    Keys that hold more than ``share`` of ``left``'s rows, fewer than 1 / ``share`` keys, meet their row by broadcast; all
    others by a join on the key, so that no task gets a hot key's rows. ``left`` is read several times: store it first.
    """
    rows = left.count()
    if rows <= least:
        return left.join(right, key)
    limit = max(least, int(rows * share))
    hot = cut_lineage(left.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select(key))
    if hot.isEmpty():
        return left.join(right, key)
    few = F.broadcast(cut_lineage(right.join(F.broadcast(hot), key, "left_semi")))
    cold = left.join(F.broadcast(hot), key, "left_anti").join(right, key)
    return left.join(few, key).select(*cold.columns).unionByName(cold)


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, comp): smallest node reachable over ``edges(u, v)``.

    Each round lets a node take the smallest label among itself, its neighbours and its label's label, so long chains
    halve; lineage is cut every round. Nodes of very many edges and labels of very many nodes are looked up by broadcast.
    """
    both = cut_lineage(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    lab = cut_lineage(nodes.select(F.col(node).alias("node"), F.col(node).alias("comp")))
    while True:
        near = hot_lookup(both, lab.select(F.col("node").alias("u"), "comp"), "u").groupBy("v").agg(F.min("comp").alias("c1"))
        step = cut_lineage(lab.join(near, lab["node"] == near["v"], "left").select("node", "comp", F.least("comp", F.coalesce("c1", "comp")).alias("c")))
        jump = step.select(F.col("node").alias("c"), F.col("c").alias("c2"))
        new = cut_lineage(hot_lookup(step, jump, "c").select("node", F.col("comp").alias("old"), F.least("c", "c2").alias("comp")))
        changed = not new.filter("old <> comp").isEmpty()
        lab = new.select("node", "comp")
        if not changed:
            return lab.withColumnRenamed("node", node)
