"""Counts, profiles, fingerprints, evaluation metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmill.functions import text as X
from pairmill.schema import HANGUL, Script


def symbol_profile(df: DataFrame, c: str, script: Script = HANGUL) -> DataFrame:
    """Frequency of every script symbol; partial counts are combined before the shuffle."""
    return (
        df.select(F.explode(F.regexp_extract_all(X.text(c), F.lit(f"[{script.symbols}]"), F.lit(0))).alias("ch"))
        .groupBy("ch").agg(F.count("*").alias("n"))
    )


def top_symbols(df: DataFrame, c: str, k: int, script: Script = HANGUL) -> DataFrame:
    return symbol_profile(df, c, script).orderBy(F.col("n").desc(), "ch").limit(k)


def reject_rollup(df: DataFrame, source: str, reason: str) -> DataFrame:
    """Rows per reason: per source and overall (source null)."""
    return df.rollup(reason, source).agg(F.count("*").alias("n")).filter(F.col(reason).isNotNull())


def source_accounting(df: DataFrame, path: str, **flags: Column) -> DataFrame:
    return df.groupBy(path).agg(F.count("*").alias("read"), *[F.count_if(v).alias(k) for k, v in flags.items()])


def label_counts(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(label, value, n) of several label columns in one pass: rows fan out before the partial count."""
    pairs = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for c in labels])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.label", "p.value").agg(F.count("*").alias("n"))


def top_counts(df: DataFrame, c: str, n: int) -> DataFrame:
    return df.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), c).limit(n)


def stage_stats(df: DataFrame, stage: str, tokens: str, budgets: dict[str, int]) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv])
    b = F.element_at(table, F.col(stage))
    return df.groupBy(stage).agg(F.count("*").alias("rows"), F.sum(tokens).alias("tokens")).withColumn("budget", b.cast("long")).withColumn(
        "utilization", F.col("tokens") / F.greatest(b, F.lit(1)))


def content_digest(df: DataFrame, *cols: str) -> DataFrame:
    """Row count, bytes and an order-free digest: the sum of 48-bit row hashes."""
    h = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *cols)), 1, 12), 16, 10).cast("decimal(38,0)")
    size = F.lit(0)
    for c in cols:
        size = size + F.octet_length(F.col(c).cast("string"))
    return df.agg(F.count("*").alias("rows"), F.sum(size).cast("long").alias("bytes"), F.sum(h).cast("string").alias("digest"))


def file_fingerprint(files: DataFrame) -> DataFrame:
    """(path, length, modificationTime, content) -> size, mtime, sha1 of the first MiB."""
    return files.select("path", F.col("length").alias("size_bytes"), F.unix_micros("modificationTime").alias("mtime_us"),
                        F.sha1(F.substring("content", 1, 1_048_576)).alias("head_sha1"))


def preview_stats(df: DataFrame, chars: Column, tokens: Column, order: str, n: int = 256) -> DataFrame:
    p = df.select(order, chars.alias("c"), tokens.alias("t")).orderBy(order).limit(n)
    return p.agg(F.count("*").alias("records"), F.round(F.avg("c"), 2).alias("mean_chars"), F.round(F.avg("t"), 2).alias("mean_tokens"),
                 F.round(F.stddev_pop("c"), 4).alias("std_chars"))


def field_summary(df: DataFrame, field: str, size: str) -> DataFrame:
    return df.groupBy(field).agg(F.count("*").alias("files"), F.sum(size).cast("long").alias("bytes"))


def exact_match(df: DataFrame, checkpoint: str, category: str, gold: Column, pred: Column, explicit: Column) -> DataFrame:
    """Exact match, parse and explicit-answer rates per checkpoint and per category (category null = all)."""
    ok = (pred != "") & (pred == gold)
    d = df.select(checkpoint, category, ok.cast("int").alias("ok"), (pred != "").cast("int").alias("parsed"), explicit.cast("int").alias("explicit"))
    return d.rollup(checkpoint, category).agg(
        F.count("*").alias("count"), F.avg("ok").alias("exact_match"), F.avg("parsed").alias("parse_rate"), F.avg("explicit").alias("explicit_rate")
    ).filter(F.col(checkpoint).isNotNull())


def suite_metrics(df: DataFrame, checkpoint: str) -> DataFrame:
    """Rates per checkpoint from row flags general, logic, collapse, unknown, passed and relevance."""
    def rate(flag, among, empty):
        return F.coalesce(F.avg(F.when(F.col(among), F.col(flag).cast("int"))), F.lit(empty))

    return df.groupBy(checkpoint).agg(
        rate("passed", "general", 0.0).alias("general_prompt_suite_pass_rate"),
        rate("collapse", "general", 1.0).alias("collapse_rate"),
        rate("unknown", "general", 0.0).alias("unknown_rate"),
        F.coalesce(F.avg(F.when(F.col("general"), F.col("relevance"))), F.lit(0.0)).alias("definition_relevance_score"),
        rate("passed", "logic", 0.0).alias("logic_reasoning_readout_rate"),
    )


# Default promotion thresholds.
THRESHOLDS = {"logic_exact_min": 0.10, "general_prompt_suite_pass_rate_min": 0.50, "collapse_rate_max": 0.20, "definition_relevance_score_min": 0.25}


def promotion_gate(metrics: DataFrame, checkpoint: str, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Decision and reasons per checkpoint from per-benchmark metric rows (best over benchmarks).

    ``winner`` is the first promoted checkpoint by name, empty when all are on hold.
    """
    th = {**THRESHOLDS, **(thresholds or {})}
    m = metrics.groupBy(checkpoint).agg(
        F.max("logic_exact_match").alias("logic_exact_match"),
        F.coalesce(F.max("general_prompt_suite_pass_rate"), F.lit(0.0)).alias("general_prompt_suite_pass_rate"),
        F.coalesce(F.min("collapse_rate"), F.lit(1.0)).alias("collapse_rate"),
        F.coalesce(F.min("unknown_rate"), F.lit(1.0)).alias("unknown_rate"),
        F.coalesce(F.max("definition_relevance_score"), F.lit(0.0)).alias("definition_relevance_score"),
    )
    reasons = F.filter(
        F.array(
            F.when(F.col("logic_exact_match") < th["logic_exact_min"], "logic_exact below threshold"),
            F.when(F.col("general_prompt_suite_pass_rate") < th["general_prompt_suite_pass_rate_min"], "general prompt suite pass too low"),
            F.when(F.col("collapse_rate") > th["collapse_rate_max"], "collapse rate too high"),
            F.when(F.col("definition_relevance_score") < th["definition_relevance_score_min"], "definition relevance too low"),
        ),
        lambda x: x.isNotNull(),
    )
    d = m.withColumn("reasons", reasons).withColumn("decision", F.when(F.size("reasons") == 0, "promote").otherwise("hold"))
    win = d.filter("decision = 'promote'").agg(F.coalesce(F.min(checkpoint), F.lit("")).alias("winner"))
    return d.crossJoin(F.broadcast(win))


def spec_eval(df: DataFrame, tier: str, hard: Column, soft: Column) -> DataFrame:
    """Pass rates by tier (tier null = all)."""
    d = df.select(tier, hard.cast("int").alias("h"), soft.cast("int").alias("s"), (hard | soft).cast("int").alias("a"))
    return d.rollup(tier).agg(F.count("*").alias("n"), F.avg("h").alias("hard_rate"), F.avg("s").alias("soft_rate"), F.avg("a").alias("any_rate"))


def compare_averages(df: DataFrame, checkpoint: str, score: str, candidate: str, baseline: str) -> DataFrame:
    """Mean score of both checkpoints, their ratio and the gain in points."""
    d = df.groupBy().agg(F.avg(F.when(F.col(checkpoint) == candidate, F.col(score))).alias("candidate"), F.avg(F.when(F.col(checkpoint) == baseline, F.col(score))).alias("baseline"))
    return d.withColumn("ratio", F.col("candidate") / F.greatest(F.lit(1e-6), F.col("baseline"))).withColumn("gain", (F.col("candidate") - F.col("baseline")) * 100.0)


def group_mean_vectors(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, pos, value): normalized mean of the unit vectors of each group, all in partial sums."""
    from pairmill.operators.vectors import unit

    m = df.select(group, F.posexplode(unit(vector)).alias("pos", "x")).groupBy(group, "pos").agg(F.avg("x").alias("m"))
    n = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(group)))
    return m.select(group, "pos", F.when(n <= 1e-8, F.col("m")).otherwise(F.col("m") / n).alias("value"))


def group_principal_vectors(df: DataFrame, group: str, vector: str, dim: int) -> DataFrame:
    """(group, value array): first principal direction of each group's unit vectors, signed to the mean.

    Each task sums products over its rows; the d*d sums are combined by key, so only one
    d-by-d matrix per group reaches the small eigen step, however many rows the group has.
    Groups under three rows, or without spread, use the mean.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    from pairmill.operators.vectors import unit

    key_type = df.schema[group].dataType
    width = dim * dim + dim + 1
    part_schema = T.StructType([T.StructField("g", key_type), T.StructField("cells", T.ArrayType(T.DoubleType()))])

    def partial(batches):
        acc: dict = {}
        for pdf in batches:
            for g, rows in pdf.groupby("g"):
                m = np.asarray(rows["v"].tolist(), dtype="float64")
                s = np.concatenate([(m.T @ m).ravel(), m.sum(axis=0), [len(m)]])
                acc[g] = acc.get(g, np.zeros(width)) + s
            if len(acc) > 256:
                yield pd.DataFrame({"g": list(acc), "cells": [a.tolist() for a in acc.values()]})
                acc = {}
        if acc:
            yield pd.DataFrame({"g": list(acc), "cells": [a.tolist() for a in acc.values()]})

    sums = (
        df.select(F.col(group).alias("g"), unit(vector).alias("v")).mapInPandas(partial, part_schema)
        .select("g", F.posexplode("cells").alias("i", "x")).groupBy("g", "i").agg(F.sum("x").alias("x"))
    )

    def solve(pdf):
        x = pdf.sort_values("i")["x"].to_numpy()
        n, mean = x[-1], x[dim * dim:-1] / x[-1]
        mean_u = mean / max(np.linalg.norm(mean), 1e-12)
        cov = x[: dim * dim].reshape(dim, dim) / n - np.outer(mean, mean)
        out = mean_u
        if n >= 3 and np.trace(cov) > 1e-16:
            out = np.linalg.eigh(cov)[1][:, -1]
            out = -out if out @ mean_u < 0 else out
        return pd.DataFrame([(pdf["g"].iloc[0], out.tolist())], columns=["g", "value"])

    out_schema = T.StructType([T.StructField("g", key_type), T.StructField("value", T.ArrayType(T.DoubleType()))])
    return sums.groupBy("g").applyInPandas(solve, out_schema).withColumnRenamed("g", group)


def mix_accounting(df: DataFrame, tag: str) -> DataFrame:
    return df.groupBy(tag).agg(F.count("*").alias("rows"))
