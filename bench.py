"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default: scale 0.1), BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import time

from cohortloom.catalog import QUERIES
from cohortloom.session import local_session

HEADLINE = [
    "rolling_sum_ape", "rolling_sum_nbv", "rolling_distinct_owner", "rolling_distinct_policy", "rolling_status_counts",
    "ticket_size", "quality_rates", "agent_kpi_block", "claim_kpis", "topk_per_agent", "avg_rank_floor", "policy_base_star",
    "range_margin_join", "fallback_margin", "policy_ltv", "client_holdings", "wide_feature_mart", "decile_ntile", "decile_profile",
    "first_second_policy_pivot", "running_min", "first_vs_later_events", "summary_stats", "percentile_thresholds",
    "waterfall_rows", "waterfall_entities", "campaign_base", "partitioned_roundtrip",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    # One untimed query, so that the first timing is not the start of the JVM.
    QUERIES["ratio_of_sums"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
