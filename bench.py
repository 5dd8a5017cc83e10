"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder with the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
BENCH_QUERIES  comma-separated names instead of the headline list
"""

from __future__ import annotations

import json
import os
import re
import time

from panelyard.plans import load_queries
from panelyard.session import build_session

HEADLINE = (
    "find_duplicates", "declip", "entity_history", "group_levels", "snapshot_block", "history_asof", "weather_rolling", "feast_response",
    "cold_prior_winsor", "seasonal_wake_apply", "spc_detect_multi", "nelson_rules", "segment_breaks", "regime_state", "load_metrics",
    "district_history", "comparison_table", "oof_segments", "bias_curve", "nearest_part_band",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = build_session("panelyard-bench", cpus=cpus, shuffle_partitions=max(8, int(cpus) * 2))
    spark.sparkContext.setLogLevel("ERROR")
    catalogue = load_queries()
    # One tiny scan starts the JVM's machinery before the clock runs.
    spark.read.parquet(f"{folder}/nation.parquet").count()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        catalogue[name].dataframe(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline panel queries, total wall clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
