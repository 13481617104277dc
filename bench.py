"""Timed run of headline queries.  Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.  Each query runs to the end
through the noop sink, so every column of every row is computed and nothing is collected.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "filter_waterfall", "dedup_conversations", "length_distribution", "tag_sequence_histogram", "check_line_repetition", "audit_corpus",
    "sample_k", "train_val_split", "shuffle", "stratified_token_quota", "pack_sequences",
    "grpo_advantage", "rloo_advantage", "reinforce_pp_advantage", "gae", "approx_kl", "policy_loss_terms", "replace_uniform_groups", "best_of_n",
    "regression_metrics", "roc_auc", "mean_spearman", "normalized_gini", "pass_rate_by", "rerank_mrr_ndcg",
    "length_rewards", "squad_em_f1", "bm25_topk", "dense_topk",
    "join_totals", "reconcile", "many_partners", "standardize_messages", "sessionize_steps",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from tessera.plans import catalog
    from tessera.plans.session import session

    spark = session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.read.parquet(f"{folder}/nation.parquet").count()  # start the executor threads before the clock
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
