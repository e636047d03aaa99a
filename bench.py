"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)"""

from __future__ import annotations

import json
import os
import time

from quayside.plans import load_all
from quayside.session import local_session

HEADLINE = [
    "q03_top_category_this_year", "q04_top_products_by_units", "q06_top_customers_by_spend", "q20_top_brand_last_quarter",
    "q40_revenue_per_shipping_city", "q41_membership_tiers", "q42_shipping_fee_per_order", "q45_return_rate_per_category",
    "g03_inner_joins", "g11_continuous_percentile", "g12_rank_over_whole_table", "s04_dedup_by_checksum", "s11_constraint_violations",
    "c04_history_window", "c05_run_stats", "c11_redact_secrets", "t01_clean_text", "t08_chunk_documents", "t10_injection_markers",
    "t12_hash_features", "r03_keyword_search", "r04_vector_search", "r10_hybrid_search", "l01_detect_language", "l04_classify_intent",
    "l06_fuse_route", "a01_validate_citations", "e06_summary", "st01a_sliding_window_admission", "st02_incremental_index",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="16g")
    queries = load_all()
    # Start the JVM code paths and the Python workers before the clock runs.
    for name in ("q04_top_products_by_units", "t01_clean_text", "r04_vector_search"):
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    asked = spark.read.parquet(f"{folder}/benchmark.parquet").count()
    routed = spark.read.parquet(f"{folder}/events.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "ms_per_search": round(1000 * seconds["r10_hybrid_search"] / asked, 2),
        "ms_per_routed_question": round(1000 * seconds["l06_fuse_route"] / routed, 4),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
