"""Seconds per headline query; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores.  ``python bench.py name ...`` times only those.
"""

from __future__ import annotations

import json
import os
import sys
import time

from shirelens.plans.queries import REGISTRY
from shirelens.session import build_session

HEADLINE = [
    "quality_profile", "key_consistency", "region_profiles", "yearly_trend", "customer_yearly_statistics", "composite_indices",
    "region_documents", "latest_predictions", "top_predictions", "canonical_names", "distance_pairs", "point_clusters",
    "cluster_centers", "feature_clusters", "coverage_plan", "coverage_grid", "anomaly_cells", "anomaly_regions",
    "forest_predictions", "explained_regions", "scoring_run", "entity_degree", "edge_endpoints", "weighted_pair_sample",
    "hourly_surge", "stream_closed_windows",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["top_hotspots"](spark, directory).collect()  # start-up is not what is measured
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        REGISTRY[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(directory.rstrip("/"))}))


if __name__ == "__main__":
    main()
