"""Seconds per headline query at one scale; prints one JSON line.

Each query is executed in full into a no-op sink. The first, unmeasured query warms the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelweave import build_session  # noqa: E402
from panelweave.plans.catalogue import QUERIES  # noqa: E402

HEADLINES = [
    "panel_long", "panel_densify", "long_country_source", "interpolate_linear", "interpolate_hourly", "ffill",
    "standard", "window_mean_scale", "temporal_split", "series_records", "w_binary", "w_knn", "w_knn_embedding",
    "w_gaussian", "w_normalised", "w_statistics", "lag", "did_plain", "did_spatial_ols", "did_spatial_ols_supplier",
    "did_spatial_2sls", "spatial_adjust", "train_windows", "ar2_fit", "ar_laplace_fit", "ar_student_fit", "forecast_paths",
    "forecast_summary", "metric_bundle", "spatial_metrics", "item_metrics", "end_to_end_forecast",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": cpus,
    }
    spark = build_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINES
    QUERIES["did_plain"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "panel_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
