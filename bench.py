"""Runs the headline queries on $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from aeolith.plans.queries import QUERIES
from aeolith.session import session

HEADLINE = (
    "all_stats", "monthly_stats", "cdf_linear", "weighted_circular_mean", "wind_rose", "mean_joint_pd", "daily_agg", "means_map", "power_law_shear", "monin_obukhov", "solar_zenith",
    "irradiance_bias", "qdm_relative", "unit_normalise", "time_interpolate", "roll_local_time", "nearest_site", "regrid_idw", "multi_resolution_join", "site_model_wind", "box_filter",
)


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
