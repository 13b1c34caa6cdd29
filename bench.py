"""Headline queries, timed one after another; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), BENCH_ALL=1 for every query.
Results are written to Spark's no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

HEADLINE = (
    "p03_normalize_space", "t02_script_ratio_letters", "t12_max_bigram_count", "t15_rare_symbol_ratio", "t21_token_sets", "f28_pair_rules",
    "f29_reject_reason", "c03_infer_domain", "d01_dedupe_pair_normalized", "d03_dedupe_exact_tuple", "d05_novelty_filter", "d06_vector_merge",
    "m02_per_source_cap", "m11_weighted_sample_without_replacement", "m14_group_quota", "m16_ratio_mix_fill", "m21_token_budget_fill",
    "m22_curriculum_stages", "j02_vocab_join", "j04_fuzzy_term_join", "j06_topk_jaccard_join", "j07_topk_vector_meta_join", "a01_reject_counts",
    "a11_exact_match", "a12_suite_metrics", "a16_group_principal_vector", "w03_dialog_pairs", "w08_chunk_overlap_split", "q01_quality_score",
    "x04_keywords", "x08_document_fanout", "x14_tool_rows", "x31_gen_arithmetic", "x33_generator_mix", "s01_jsonl_scan", "k01_jsonl_sink",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    from pairmill import catalog
    from pairmill.session import build_session

    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = catalog.load()
    names = list(queries) if os.environ.get("BENCH_ALL") else list(HEADLINE)
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        try:
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as ex:  # noqa: BLE001
            print(f"{name}: {type(ex).__name__}: {str(ex)[:300]}", file=sys.stderr)
            times[name] = -1.0
        if os.environ.get("BENCH_ALL"):
            print(name, times[name], file=sys.stderr, flush=True)
    done = [v for v in times.values() if v >= 0]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(done), 3), "unit": "sec", "queries": times,
                      "failed": sum(v < 0 for v in times.values()), "sf": sf_dir.rsplit("/sf", 1)[-1], "cpus": cpus}))


if __name__ == "__main__":
    main()
