"""Time the headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from rollout_lake.plans import catalog
from rollout_lake.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "entry_grpo_with_rejection",
    "g08_grpo_advantage",
    "g09_rloo_advantage",
    "g12_gae",
    "i05_group_funnel",
    "i06_keep_valid_rows",
    "i08_downsample_groups",
    "h03_cum_turn_ratio_geometric",
    "h09_weight_statistics_token",
    "h11_weight_percentiles",
    "h13_mismatch_by_reward_sign",
    "h15_ratio_statistics",
    "h20_cum_turn_objective",
    "j01_pass_at_k",
    "j06_best_and_worst",
    "j09_column_accuracy",
    "j14_majority_vote",
    "f05_normalise",
    "f12_math_equal",
    "f22_code_score",
    "e07_trajectory_roll_up",
    "e09_assemble_transcript",
    "e15_mask_labels",
    "d16_join_streams",
    "b08_sample_per_source",
    "b15_fine_tuning_rows",
    "c06_chunk_rows",
    "k01_balanced_partitions",
]


def run(spark, name: str) -> float:
    started = time.time()
    catalog.queries()[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.time() - started


def main() -> None:
    spark = local_session("bench", CPUS)
    wanted = sys.argv[1:] or HEADLINE
    run(spark, "entry_grpo_with_rejection")  # start-up of the JVM and the code paths is not a query
    took = {name: round(run(spark, name), 3) for name in wanted}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": SF_DIR.rstrip("/").split("sf")[-1], "cpus": CPUS,
    }))


if __name__ == "__main__":
    main()
