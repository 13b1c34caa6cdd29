"""JSON lines, JSON documents, tab lists, exported tables and source specs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmill.functions import text as X
from pairmill.schema import RAW_SCHEMA


def jsonl_scan(spark: SparkSession, path, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Lines with (path, block, pos) lineage, ``status`` and the parsed row.

    status: blank, json_decode, not_dict or ok. (path, block, pos) orders the rows as they
    stand in the files, whatever the split size; undecodable bytes become U+FFFD.
    """
    raw = spark.read.text(path).select(
        F.make_valid_utf8("value").alias("line"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
    )
    return parsed_lines(raw, schema)


def parsed_lines(raw: DataFrame, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """``raw`` (line and its lineage) with ``status`` and the parsed row."""
    v = F.try_parse_json(X.strip("line"))
    status = (
        F.when(X.strip("line") == "", "blank").when(v.isNull(), "json_decode")
        .when(~F.schema_of_variant(v).startswith("OBJECT"), "not_dict").otherwise("ok")
    )
    d = raw.withColumn("status", status)
    return d.withColumn("row", F.when(F.col("status") == "ok", F.from_json("line", schema, {"mode": "PERMISSIVE"})))


def jsonl_rows(spark: SparkSession, path, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Only the parsed rows, flattened, with their lineage."""
    return jsonl_scan(spark, path, schema).filter("status = 'ok'").select("row.*", "path", "block", "pos")


def json_scan(spark: SparkSession, path, schema: T.StructType, max_rows: int | None = None) -> DataFrame:
    """A ``.json`` file with one object or an array of objects -> rows.

    ``max_rows`` is the probe limit of the source rules, per call.
    """
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    return d if max_rows is None else d.limit(max_rows)


VOCAB_SCHEMA = "rank string, term string, pos string, gloss string, grade string"


def vocabulary_scan(spark: SparkSession, path, rank_max: int = 6000, header: bool = True) -> DataFrame:
    """Tab file rank, term, part of speech, gloss, grade with a header -> typed rows.

    Rows with fewer than five columns, empty terms or a rank over the cap are dropped.
    """
    d = spark.read.csv(path, sep="\t", header=header, schema=VOCAB_SCHEMA, comment="#", quote="")
    rank = F.coalesce(F.expr("try_cast(rank AS INT)"), F.lit(0))
    g = F.upper(X.strip("grade"))
    d = d.filter(F.col("grade").isNotNull() & (X.strip("term") != ""))
    d = d.select(rank.alias("rank"), X.normalize_space("term").alias("term"), X.normalize_space("gloss").alias("gloss"), F.when(g.isin("A", "B", "C"), g).otherwise("").alias("grade"))
    return d if rank_max <= 0 else d.filter(F.col("rank") <= rank_max)


def glossary_rows(vocab: DataFrame, max_rows: int = 5000) -> DataFrame:
    """Vocabulary terms with a usable gloss as (input, output) rows, in rank order."""
    ok = (F.length("term") >= 2) & (F.length("gloss") >= 6) & ~X.char_run("gloss", 8)
    d = vocab.filter(ok).select(F.col("term").alias("input"), F.col("gloss").alias("output"), "grade", "rank")
    return d if max_rows <= 0 else d.orderBy("rank").limit(max_rows)


def path_list_scan(spark: SparkSession, path) -> DataFrame:
    """First column of a tab list, comments and the header row skipped."""
    first = X.strip(F.split(F.col("value"), "\t")[0])
    d = spark.read.text(path).filter((X.strip("value") != "") & ~X.strip("value").startswith("#"))
    return d.select(F.replace(first, F.lit("\\"), F.lit("/")).alias("path")).filter("path <> '' AND lower(path) <> 'path'")


def table_scan(spark: SparkSession, path) -> DataFrame:
    """Exported table of a public question set."""
    return spark.read.parquet(path)


# Adapters: public data set layouts -> (input, output) columns; None drops the row.
ADAPTERS: dict[str, Callable[[], tuple[Column, Column]]] = {
    "question_response": lambda: (X.clean_text("question"), X.clean_text("response")),
    "question_answer": lambda: (X.clean_text("question"), X.clean_text("answer")),
    "instruction_output": lambda: (X.clean_text("instruction"), X.clean_text("output")),
    "instruction_input_output": lambda: (
        F.when(X.clean_text("input") == "", X.clean_text("instruction")).otherwise(
            F.concat(X.clean_text("instruction"), F.lit("\n\n추가 정보:\n"), X.clean_text("input"))),
        X.clean_text("output"),
    ),
}


def adapt(df: DataFrame, adapter: str, source_dataset: str, language: str, tier: str = "high") -> DataFrame:
    """Project an exported data set to canonical pair rows."""
    inp, out = ADAPTERS[adapter]()
    rid = X.stable_id("hf_mit_lang_", [F.lit(source_dataset), F.lit(language), inp, out])
    return df.select(rid.alias("id"), inp.alias("input"), out.alias("output"), F.lit(language).alias("language"), F.lit(tier).alias("_meta_quality_tier"),
                     F.lit(source_dataset).alias("source_dataset"), F.lit("MIT").alias("license")).filter("input <> '' AND output <> ''")


def parse_source_specs(specs: Sequence[str], sep: str = ":") -> list[tuple[str, int, int]]:
    """'path:limit' (or 'path=cap') -> (path, rank, limit); unreadable entries are skipped."""
    out = []
    for raw in specs:
        path, _, limit = raw.strip().rpartition(sep)
        path, limit = path.strip().replace("\\", "/"), limit.strip()
        if path and limit.lstrip("-").isdigit():
            out.append((path, len(out), max(0, int(limit))))
    return out


def source_table(spark: SparkSession, specs: Sequence[str], sep: str = ":") -> DataFrame:
    """Source specs as a table (path, src_rank, limit); one row per command-line entry."""
    return spark.createDataFrame(parse_source_specs(specs, sep), "path string, src_rank int, row_limit long")


def with_source(df: DataFrame, sources: DataFrame, path: str) -> DataFrame:
    """Rows of the listed sources with their rank and limit."""
    return df.join(sources.withColumnRenamed("path", path), path)
