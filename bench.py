"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2:
the first run includes code generation, the best run counts; a query that takes more
than 8 seconds is run once). BENCH_QUERIES names a comma-separated choice.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from callspark.plans.catalog import catalog  # noqa: E402
from callspark.session import local_session  # noqa: E402

HEADLINE = [
    "a1_basic_kpis", "a2_all_kpis", "a3_percentiles", "a6_agent_table", "a10_trends_daily", "a12_compare_kpis",
    "a13_compare_groups", "a19_ad_hoc_median", "a26_duration_histogram", "a28_quality_score",
    "f7_filter_spec", "f13_segments",
    "w1_first_call_cohorts", "w5_retention_first_monthly", "w9_volume_hourly_by_agent", "w10_moving_average_calls",
    "o2_deep_page_rows", "k2_upsert", "s1_csv_import", "p10_clean",
    "t1_clean_text", "t2_keywords", "t2_corpus_keywords", "t4_text_statistics", "t6_entity_counts_documents",
    "t7_mask_pii", "t10_pair_similarity", "t12_assemble_transcripts",
    "l1_fuzzy_keyword_hits", "l6_label_calls", "l7_interpret", "l9_answer_questions",
    "v1_prepare_documents", "v2_hash_embedding", "v5_nearest_cosine", "v6_filtered_search", "v7_hybrid_search",
    "v9_retrieve", "j4_index_missing_ids", "r1_stream_import", "r3_window_kpis",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    queries = catalog()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in wanted:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            if times[-1] > 8:
                break
        seconds[name] = round(min(times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale)}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
