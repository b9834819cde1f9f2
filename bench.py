"""Time the headline queries: prints one JSON line.

Environment: BENCH_SF_DIR (tables, default /root/testdata/sf0.1) and BENCH_CPUS (local threads, default 8).
Each query is planned and fully executed into a no-op sink, so neither collecting nor caching is measured.
"""

from __future__ import annotations

import json
import os
import time

from gridloom.plans import REGISTRY
from gridloom.session import local_session

HEADLINE = [
    "skill_summary", "skill_summary_by_method", "monthly_skill_summary", "paired_accumulator", "window_statistics",
    "value_summary", "wasserstein_distance", "distribution_stats", "histogram_own_range", "smoothed_density",
    "daily_mean", "resample_six_hours", "land_sea_mask", "regrid_strict", "regrid_renormalised", "channel_statistics",
    "climate_change_map", "signal_summary", "correction_validation_hist", "model_rollup", "cdft_correction",
    "gamma_parameters", "field_scoring", "merged_partial_skill",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    # Start the executor threads and the Python workers before the clock runs.
    REGISTRY["area_mean"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
