"""Five stages from raw documents to token files: each takes and returns documents, the last returns what its files hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairmill.llm import dart, decontaminate, mixing, planes, toxicity
from pairmill.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to ``labels``, scores at 0.5 or more go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least doc_id stays."""
    return dart.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which an item of ``benchmark`` stands, copied or edited, go."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's share of the mix asks for: weights 3, 1, 2 in turn, 150 % of all words."""
    return mixing.mix_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all texts in plane files below the shared folder; per document what the files hold of it."""
    return planes.read_digests(planes.write_files(docs, planes.default_tokenizer(), added=True))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("token_output", token_files),
]

#: Classifier, similarity, alignment and tokenizer are beyond SQL; ``tests/llm/test_pipeline.py`` has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
