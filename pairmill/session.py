"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pairmill", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Local or cluster session. On a cluster leave ``master`` unset (spark-submit sets it)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # plans are built several times faster without call sites
    )
    if master:
        b = b.master(master).config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.ui.showConsoleProgress", "false")
    spark = b.getOrCreate()
    if master and master.startswith("local[") and not _root(spark):  # one machine: its own folder is shared by all
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pairmill-"))
    return spark


def _root(spark: SparkSession) -> str | None:
    sc = spark.sparkContext
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which all machines of the cluster share."""
    root = _root(spark)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back, column by column: for wide rows that several steps read in part."""
    path = shared_folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder of the cluster and read it back.

    Iterative operators call this once per round so that neither the plan nor the
    recovery cost after a lost executor grows with the number of rounds.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)
