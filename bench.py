"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run in full into the no-op sink. ``processed_shipments`` is the whole cleaning,
feature and scaling job over all line items; its throughput is given in rows per second.
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

from tidegauge import session
from tidegauge.registry import QUERIES

HEADLINE = [
    "processed_shipments",
    "all_profiles_lineitem",
    "insights",
    "correlation_lineitem",
    "scaled_lineitem",
    "iqr_sequential",
    "quality_counters",
    "check_ranges",
    "hour_profile",
    "yearly_trend",
    "daily_means",
    "seasonal_strength",
    "lags",
    "rolling_mean_full",
    "rolling_corr",
    "ffill",
    "ffill_sliced",
    "smoothed",
    "autocorrelation",
    "interval_stats",
    "ensemble_forecast",
    "autoregressive_forecast",
    "forecast_metrics",
    "backtest_summary",
    "validation_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["hour_profile"](spark, folder).count()

    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{seconds[name]:8.3f}s {name}", file=sys.stderr, flush=True)

    rows = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": pathlib.Path(folder).name.removeprefix("sf"),
                "rows_per_sec": {
                    "processed_shipments": round(rows / seconds["processed_shipments"])
                },
            }
        )
    )


if __name__ == "__main__":
    main()
