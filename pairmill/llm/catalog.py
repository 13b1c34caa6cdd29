"""Registered queries of this subpackage and their SQL texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.llm import dart, decontaminate, html_text, licenses, mixing, planes, ranked, runs, spotsigs, token_cache, toxicity, trie_lm, urls
from pairmill.llm.common import stored, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score_texts(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.read_digests(planes.write_files(table(spark, sf_dir, "documents"), planes.default_tokenizer(), added=True))


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op7_trie_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rest = toxicity.held_out(parts=7, rest=2)
    scored = trie_lm.score_texts(docs, trie_lm.train(docs.where(~rest)))
    return scored.withColumn("held_out", rest)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    return urls.url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    placed = mixing.place(stored(docs, "mix"), F.col("size"))
    return placed.select("doc_id", *[f"_mix.{c}" for c in ("size", "source_size", "target", "taken")])


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = runs.find_runs(docs.withColumn("text", runs.repeat_tail(F.col("text"), F.col("doc_id"))))
    return found.select("doc_id", *[c.alias(k) for k, c in runs.run_digests(F.col("_runs")).items()])


def op12_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_cache.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), token_cache.new_cache(spark))
    return counted.select("doc_id", "_tokens.n_bytes", "_tokens.n_tokens", (F.col("_tokens.n_tokens") > 4096).alias("over_limit"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked.build_index(table(spark, sf_dir, "documents"))
    return ranked.search(index, table(spark, sf_dir, "benchmark")).withColumnRenamed("key", "doc_id")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_dart_minhash": op2_dart_minhash,
    "op3_html_text": op3_html_text,
    "op4_decontaminate": op4_decontaminate,
    "op5_bit_planes": op5_bit_planes,
    "op6_spotsigs": op6_spotsigs,
    "op7_trie_lm": op7_trie_lm,
    "op8_url_filter": op8_url_filter,
    "op9_source_mix": op9_source_mix,
    "op10_license_scan": op10_license_scan,
    "op11_word_runs": op11_word_runs,
    "op12_token_cache": op12_token_cache,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE = {"op8_url_filter": urls.SQL, "op9_source_mix": mixing.SQL, "op10_license_scan": licenses.oracle_sql(), "op13_ranked_search": ranked.SQL}
