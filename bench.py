"""Time the headline queries: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from clientscope.queries import load
from clientscope.session import local_session

HEADLINE = (
    "scan_sharded_union", "sink_replace_period", "filter_like_any", "classify_code_and_keyword", "fill_missing_by_pattern",
    "join_left_chain", "join_composite_key_dedupe", "join_wide_assemble", "agg_conditional_pivot", "agg_period_counts",
    "agg_distinct_count_case", "win_dedupe_cascade", "win_cumulative_counts", "topk_share", "sample_random_limit",
    "feat_rolling_windows", "feat_rolling_windows_compat", "feat_pos_dynamics", "feat_assemble", "feat_correlated_pairs",
    "client_paid_tier", "core_product_scores", "need_product_topn", "lifestyle_top_category", "life_situation_top",
    "life_sub_situation", "target_five_class", "eval_roc_auc", "eval_auc_ovr", "eval_lift_table", "score_linear_vectorized",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().QUERIES

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        once(name)  # warm-up: code generation and file cache
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1]}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
