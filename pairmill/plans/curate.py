"""Whole flows: curation of one corpus with named reject reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairmill.functions import filters as R
from pairmill.functions import text as X
from pairmill.operators.dedup import first_wins, pair_key
from pairmill.schema import HANGUL, Script


def tag_pairs(pairs: DataFrame, hint_cols: Sequence[str], tier: str, script: Script = HANGUL, **policy) -> DataFrame:
    """Pairs with ``reason`` (null = passes the rules) and the duplicate ``key`` of passing rows."""
    p = pairs.withColumns({"input": X.normalize_space("input"), "output": X.normalize_space("output")})
    rules = R.chat_rules("input", "output", R.language_hint(hint_cols, script), tier, script, **policy)
    tagged = p.withColumn("reason", R.first_reason(rules))
    return tagged.withColumn("key", F.when(F.col("reason").isNull(), pair_key("input", "output")))


def accepted(tagged: DataFrame, order: Sequence[str]) -> DataFrame:
    """Passing rows, first per key in ``order``."""
    return first_wins(tagged.filter("reason IS NULL"), ["key"], order).drop("reason", "key")


def reject_report(tagged: DataFrame, pos: str, source: str) -> DataFrame:
    """Rows per source and reason, 'ok' and 'duplicate' included, in one scan of the corpus.

    Counts are combined per (key, source, reason) before the exchange; a key shared by a third
    of the rows arrives as one partial row per source and map task. Only then is the first
    source of each key found, on the counted rows.
    """
    g = tagged.groupBy("key", source, "reason").agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    lead = F.min("first").over(Window.partitionBy("key"))
    won = F.when(F.col("key").isNotNull() & (F.col("first") == F.col("lead")), 1).otherwise(0)
    d = g.withColumn("lead", F.when(F.col("key").isNotNull(), lead)).withColumn("won", won)
    rows = F.explode(
        F.when(
            F.col("key").isNull(), F.array(F.struct(F.col("reason").alias("reason"), F.col("n").alias("n")))
        ).otherwise(
            F.array(
                F.struct(F.lit("ok").alias("reason"), F.col("won").cast("long").alias("n")),
                F.struct(F.lit("duplicate").alias("reason"), (F.col("n") - F.col("won")).alias("n")),
            )
        )
    )
    flat = d.select(source, rows.alias("r")).filter("r.n > 0")
    return flat.groupBy(source, "r.reason").agg(F.sum("r.n").alias("n"))
