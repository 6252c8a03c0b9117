"""Headline queries, timed once after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tsfoundry.plans.catalog import QUERIES  # noqa: E402
from tsfoundry.session import get_spark  # noqa: E402

HEADLINE = [
    "entry_slice", "resample_hourly_sum", "filter_start_with_buffer", "combine_first", "append_dedupe",
    "calendar_reindex", "holiday_proximity", "recurrence_band_join", "lag_features", "rolling_stats",
    "rolling_quantile_seasonal", "interpolate_time", "seasonal_decompose", "acf", "scale_robust",
    "rolling_origin_folds", "pinball_loss", "pit_histogram", "column_summary", "box_stats_by_calendar",
    "correlation_matrix", "mutual_information", "evaluation_report", "rolling_cv_run",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(max(8, int(cpus))), "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        if name not in times:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
