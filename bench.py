"""Headline queries, timed. One JSON line on stdout.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query runs twice into a no-op sink, so all rows and columns are computed; ``queries`` holds the second run,
``first_run`` the first (code generation and class loading included). ``laps_view`` is the join and numbering that
turns the given tables into the lap table; the other queries start from that table, as from a stored lap file.
"""

from __future__ import annotations

import json
import os
import time

from lapforge.catalog import QUERIES
from lapforge.session import local_session
from lapforge.sources import testdata

HEADLINE = [
    "features_race_v4", "features_quali_v4", "features_race_v3", "filter_iqr", "window_lap_history",
    "window_telemetry_history", "window_tyre_and_stint", "window_session_baseline", "window_laps_since_neutralization",
    "window_race_control_flags", "join_weather_nearest", "join_quali", "join_encoding_lookup", "join_recent_form",
    "agg_lap_telemetry", "agg_live_features", "agg_target_encoding", "agg_error_metrics", "agg_describe",
    "encode_leave_fold_out", "split_group_kfold", "report_model_comparison", "ingest_laps",
    "window_lap_history_split", "filter_iqr_split", "stream_live_features", "model_linear_group_kfold",
]


def timed(build) -> float:
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    first, second = {}, {}
    runs = {"laps_view": lambda: testdata.derive_laps(spark, sf_dir)}
    runs |= {name: (lambda q=QUERIES[name]: q(spark, sf_dir)) for name in HEADLINE}
    for name, build in runs.items():
        first[name] = timed(build)
        if name == "laps_view":
            testdata.laps(spark, sf_dir)
        second[name] = timed(build)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(second.values()), 3), "unit": "sec",
        "queries": second, "first_run": first, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
