"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from maskbench.plans import catalog
from maskbench.session import local_session

HEADLINE = [
    "pivot_with_deltas", "main_table", "retention", "ablation_report", "pooled_sequence_test",
    "severity_endpoint_test", "widening_verdict", "gap_shift", "iqa_correlation_by_mode",
    "across_within_views", "cluster_bootstrap_pooled", "wilcoxon_signed_rank", "cliffs_delta",
    "rank_auc", "exact_quantiles", "gate_replay_table", "trajectory_deciles", "profile_ema",
    "duplicate_report", "reconciliation", "denominator_correction", "frame_jf", "fused_masks",
    "degrade_fog", "degrade_c4_fog_blur_noise", "iqa_panel", "restoration_bank",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "maskbench-bench")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times: dict[str, float] = {}
    for n in names:
        t = time.perf_counter()
        # the noop sink runs the whole plan without collecting rows on the driver
        catalog.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
