"""Time the headline queries; prints one JSON line.

Reads the tables in $BENCH_SF_DIR on local[$BENCH_CPUS]. Each query runs $BENCH_RUNS times (default
2) into a sink that drops the rows; the shortest time counts, so the first run warms the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetledger import build_session  # noqa: E402
from fleetledger.checks.registry import QUERIES  # noqa: E402

HEADLINE = (
    "contract_funnel",
    "fleet_status",
    "funnel_members",
    "active_contracts",
    "contract_profile",
    "counter_bounds_one",
    "counter_bounds_all",
    "case_timeline",
    "cost_actuals",
    "unit_financials",
    "margin_by_segment",
    "cost_features_asset",
    "cost_features_month",
    "comparison_matrices",
    "matrix_median",
    "gram_stats",
    "cost_model_coefficients",
    "segment_effects",
    "lattice_effects",
    "search_columns",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    settings = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    }
    spark = build_session("fleetledger-bench", f"local[{cpus}]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        spent = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - start)
        times[name] = round(min(spent), 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
