"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from cinnabar.plans.bindings import RULES

HEADLINE = ["rules_ranked", "policy_data", "rule_pareto", "cgr_compose", "bond_change_counts", "environment_1hop", "softmax_topk", "combined_policy", "uct_puct_scores", "visit_backup", "branching_profile", "competing_sites_score", "rank_routes_combined", "cluster_routes", "prior_step_asof", "stratified_split", "cascade_summary", "dedup_keep_first"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
    spark = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            RULES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs), 3)
        print(name, *(round(x, 3) for x in runs), file=sys.stderr, flush=True)
    print(json.dumps({"metric": "median of 3, sum over headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
