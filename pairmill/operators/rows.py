"""Canonical pair rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.functions import text as X


def infer_domain(task: Column, segment: Column, language: Column) -> Column:
    t, s, g = (F.lower(X.strip(c)) for c in (task, segment, language))
    return (
        F.when((t == "code") | (s == "code"), "code")
        .when(t.isin("korean", "ko") | (s == "ko") | (g == "ko"), "korean")
        .when(t.isin("english", "en") | s.isin("english", "en") | (g == "en"), "english")
        .when((t == "doc") | (s == "doc"), "doc")
        .otherwise("other")
    )


def _or(c: Column, default: str) -> Column:
    return F.when(X.strip(c) == "", F.lit(default)).otherwise(c)


def canonical_rows(df: DataFrame, license_value: str = "MIT") -> DataFrame:
    """Pair + labels + lineage in the canonical schema; rows without a pair are dropped."""
    for f in ("task_type", "segment_tag", "language", "source", "source_dataset"):
        if f not in df.columns:
            df = df.withColumn(f, F.lit(""))
    d = (
        df.withColumn("input", X.strip("input"))
        .withColumn("output", X.strip("output"))
        .filter("input <> '' AND output <> ''")
        .withColumn("_domain", infer_domain(F.col("task_type"), F.col("segment_tag"), F.col("language")))
    )
    dom, task, seg, lang = (F.col(c) for c in ("_domain", "task_type", "segment_tag", "language"))
    return d.withColumns(
        {
            "task_type": F.when(dom.isin("code", "korean", "english", "doc"), dom).otherwise(_or(task, "other")),
            "segment_tag": F.when(dom == "korean", "ko").when(dom.isin("code", "english", "doc"), dom).otherwise(_or(seg, "other")),
            "language": F.when(dom == "korean", "ko").when(dom == "english", "en")
            .when(dom.isin("code", "doc"), _or(lang, "en")).otherwise(lang),
            "license": F.lit(license_value),
            "source_dataset": F.when(X.strip("source_dataset") == "", X.strip("source")).otherwise(F.col("source_dataset")),
        }
    ).drop("_domain")
