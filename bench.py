"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. One query is run first to
warm the session up; then each is timed
whole: plan, run and produce every row.
"""

import json
import os
import time

from creditloom.queries import QUERIES
from creditloom.session import local_session

HEADLINE = [
    "popular_items", "item_catalog", "cleaned_loans", "interaction_counts", "latest_profile", "user_index",
    "user_features", "stratified_sample", "negative_samples", "training_pairs", "topk_cosine", "ndcg_at_k",
    "metrics_by_subset", "roc_auc", "repay_filter", "rerank_by_request", "apply_replies", "request_prompts",
    "capped_distributions", "application_kpis", "daily_applications", "collaborative_top_items", "topk_by_cell", "topk_pruned",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    QUERIES["popular_items"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
