"""File discovery and bounded probes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairmill.functions import classify as C
from pairmill.functions import filters as R
from pairmill.functions import text as X
from pairmill.schema import HANGUL, INPUT_KEYS, OUTPUT_KEYS, Script

# Path parts that exclude a file.
EXCLUDE_TOKENS = ("quality/", "sources_", "smoke", "resumecheck", "bg_test", "_test", "/test/", "stages_")


def excluded_path(path, tokens: Sequence[str] = EXCLUDE_TOKENS):
    low = F.lower(F.replace(X.text(path), F.lit("\\"), F.lit("/")))
    return R.has_any(low, [t.lower() for t in tokens])


def discover(spark: SparkSession, root: str, glob: str = "*.jsonl", tokens: Sequence[str] = EXCLUDE_TOKENS) -> DataFrame:
    """(path, rel, size_bytes, reason): files under ``root``; reason null = selected.

    Contents are not read. Spark's listing already leaves out empty files.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rel = F.regexp_replace("path", r"\A[a-z]+:/*", "/")
    rel = F.substr(rel, F.length(F.lit(root.rstrip("/"))) + 1)
    why = F.when(excluded_path(rel, tokens), "excluded_by_path_token")
    return f.select("path", rel.alias("rel"), F.col("length").alias("size_bytes"), why.alias("reason"))


def first_lines(scan: DataFrame, n: int) -> DataFrame:
    """First ``n`` lines of every file; each task ships at most ``n`` lines per file it reads."""
    w = Window.partitionBy("path").orderBy("block", "pos")
    return scan.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def probe(scan: DataFrame, n: int = 180, script: Script = HANGUL, share: float = 0.16) -> DataFrame:
    """Chat, tier, language and code ratios of the first ``n`` lines per file."""
    rows = first_lines(scan, n).filter("status = 'ok'").select("path", "row.*")
    inp, out = X.pick_first_non_empty(INPUT_KEYS), X.pick_first_non_empty(OUTPUT_KEYS)
    hint = R.language_hint(["language", "segment_tag", "task_type"], script)
    # One-element explodes: a row's texts are picked and merged once, not again wherever they are named.
    d = rows.select("path", (X.strip("_meta_quality_tier") != "").cast("int").alias("tier"), hint.alias("_hint"), F.explode(F.array(F.struct(inp.alias("i"), out.alias("o")))).alias("_p"))
    i, o = F.col("_p.i"), F.col("_p.o")
    d = d.select("path", "tier", "_hint", ((i != "") & (o != "")).cast("int").alias("chat"), F.explode(F.array(R.merged(i, o))).alias("_both"))
    d = d.select("path", "tier", "chat", (F.col("_hint") | (X.script_ratio_letters("_both", script) >= share)).cast("int").alias("script"),
                 R.has_any(F.col("_both"), C.CODE_MARKS).cast("int").alias("code"))
    return d.groupBy("path").agg(F.count("*").alias("parsed"), F.avg("chat").alias("chat_ratio"), F.avg("tier").alias("tier_ratio"),
                                 F.avg("script").alias("script_ratio"), F.avg("code").alias("code_ratio"))


def top_keys(scan: DataFrame, n_lines: int = 160, n_keys: int = 10) -> DataFrame:
    """Most frequent JSON keys per file."""
    keys = F.json_object_keys("line")
    d = first_lines(scan, n_lines).filter("status = 'ok'").select("path", F.posexplode(keys).alias("i", "key"))
    c = d.groupBy("path", "key").agg(F.count("*").alias("n"), F.min("i").alias("i"))
    w = Window.partitionBy("path").orderBy(F.col("n").desc(), "i", "key")
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n_keys)


def probe_reason(min_chat: float = 0.70, min_script: float = 0.30, need_tier: bool = True):
    """Why a probed file is rejected; null = selected."""
    return R.first_reason([
        ("probe_unparsed", F.col("parsed") <= 0),
        ("probe_not_chat", F.col("chat_ratio") < min_chat),
        ("probe_not_ko", F.col("script_ratio") < min_script),
        ("probe_no_tier", F.lit(need_tier) & (F.col("tier_ratio") <= 0.0)),
    ])
