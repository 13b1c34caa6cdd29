"""Run log as a stream: new event files are picked up and counted per phase and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "ts timestamp, phase string, status string, payload string"


def log_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files).json(path)


def status_counts(events: DataFrame) -> DataFrame:
    """Running counts; the state has one row per (phase, status)."""
    return events.groupBy("phase", "status").agg(F.count("*").alias("n"))
