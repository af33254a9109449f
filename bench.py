"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Every query is executed in full into a sink that drops the rows. The first
run of a query warms code generation, the median of the next runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from callmetrics.plans.catalog import QUERIES  # noqa: E402
from callmetrics.session import local_session  # noqa: E402

HEADLINE = [
    "ag1_study_status", "ag3_level_outcomes", "ag7_cohort_audit", "ag8_spend_ledger", "ag11_feature_medians",
    "jn3_remaining_plan", "wn1_last_wins", "wn3_first_stopping_call", "wn4_budget_replay", "wn6_inter_chunk_gaps",
    "me2_frozen_prediction", "me6_auc_calls", "me7_cluster_bootstrap", "me8_prospective_report", "me10_curve_fit",
    "sk8_json_lines_writer", "sk9_export_manifest", "ss1_event_reassembly", "ss2_chunk_events", "rs1_rescored_status",
    "tr1_trace_features", "tr6_trigger_replay", "tr14_policy_replay", "tr16_tr17_consistency_gate",
]
RUNS = 2


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        timed(spark, name, sf_dir)
        seconds[name] = round(statistics.median(timed(spark, name, sf_dir) for _ in range(RUNS)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
