"""Headline timings: prints one JSON line.

Reads $BENCH_SF_DIR (default sf0.1) on local[$BENCH_CPUS]; every result is fully computed and
written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from reachspark.queries import QUERIES
from reachspark.session import local_session

HEADLINE = [
    "bed_shear",
    "cell_statistics_median",
    "slope",
    "focal_fraction",
    "volume_assessment",
    "align_bilinear",
    "zonal_statistics",
    "exceedance_at",
    "return_periods",
    "lifespan_cells",
    "best_summary",
    "seasonal_habitat_area",
    "cover_suitability",
    "label_regions",
    "stranding",
    "stranding_velocity",
    "least_cost_distance",
    "detrended_dem",
    "idw",
    "kriging",
    "polygonize",
    "terraforming_summary",
    "recruitment",
    "cost_report",
    "design_pool_riffle",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    QUERIES["con"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
