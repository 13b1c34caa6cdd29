"""Sinks: data sets, manifests, listings and run logs."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from pairmill.session import shared_folder as shared_folder


def write_jsonl(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """One JSON object per line; one file per task, split by column values if asked."""
    w = df.write.mode(mode).option("ignoreNullFields", True)
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def write_manifest(parts: dict[str, DataFrame], config: dict, path: str, spark: SparkSession) -> None:
    """A folder with the run settings and any number of tables: each table's tasks write its files, and a small listing (settings,
    and name, schema and rows of every table) is written last. Without its listing a manifest does not count as written."""
    listing = [("", json.dumps(config, ensure_ascii=False, sort_keys=True), 0)]
    for name, df in parts.items():
        df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}")
        listing.append((name, df.schema.json(), spark.read.schema(df.schema).json(f"{path}/{name}").count()))
    spark.createDataFrame(listing, "part string, content string, rows long").coalesce(1).write.mode("overwrite").json(f"{path}/listing")


def read_manifest(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """(settings, tables) of a written manifest; an error if it has no listing, or a table has other rows than the listing says."""
    rows = spark.read.schema("part string, content string, rows long").json(f"{path}/listing").collect()  # one row per table
    parts = {r["part"]: spark.read.schema(StructType.fromJson(json.loads(r["content"]))).json(f"{path}/{r['part']}") for r in rows if r["part"]}
    for r in rows:
        if r["part"] and parts[r["part"]].count() != r["rows"]:
            raise ValueError(f"{path}/{r['part']} is not what its listing says")
    return json.loads(next(r["content"] for r in rows if not r["part"])), parts


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated report with a header (a counted table, one row per source)."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_field_lists(files: DataFrame, path: str) -> None:
    """Classified file table -> one listing folder per field; every task adds a file of its own, in the order of paths."""
    files.sortWithinPartitions("field", "path").write.mode("overwrite").partitionBy("field").csv(path, sep="\t", header=True)


def append_log(df: DataFrame, path: str) -> None:
    """Append run events (ts, phase, status, payload)."""
    df.write.mode("append").json(path)
