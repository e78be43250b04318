"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from stormline.plans.catalog import QUERIES
from stormline.session import get_session

HEADLINE = [
    "waterbody_summary", "waterbody_summary_qc", "storms", "storm_ids", "storm_so_far", "episodes", "dead_mask",
    "loo_median", "panel_grid", "flatten_payload", "config_changes", "latest_params", "history_merge", "cso_scores",
    "cso_refit", "filings_dedup", "filing_shares", "onset_clusters", "last_samples", "nearest_volume", "stream_storms",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
                    "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    wanted = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    # One untimed pass, so that the first query does not pay for starting the JVM.
    QUERIES["waterbody_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    taken = {}
    for name in wanted:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(taken.values()), 3), "unit": "sec",
                      "queries": taken, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
