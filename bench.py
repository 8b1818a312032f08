"""Seconds per headline query; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of local cores and
``BENCH_QUERIES`` (optional, comma separated) the queries. The stage tables of the batch job
are timed under ``stage_*`` where they are built; queries that follow read them, as in the
batch job. Operators that do not read stage tables run in full.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

STAGES = ["raw", "clean", "features", "road_health", "labelled", "hotspots", "allocation",
          "series", "tested", "forecast_metrics", "forecasts"]
HEADLINE = [
    "dq_checks", "fix_geo", "normalise_categoricals", "dedupe", "spatial_impute", "risk_score",
    "features", "completeness", "rhi_zone", "rhi_all_levels", "rhi_weights_data",
    "dbscan_labels", "hotspots_by_cause", "hotspots_top", "daily_series", "supervised_frame",
    "forecast_naive", "forecast_ets", "forecast_metrics", "forecasts", "zone_signals",
    "resource_allocation", "ml_label_table", "ml_split_counts", "optimal_threshold",
    "clf_metrics", "roc_curve", "class_report", "reg_metrics", "validate_requests",
    "enrich_requests", "filtered_events", "filter_options", "kpi_stats", "kpi_overview",
    "top_causes", "daily_volume", "dow_hour_heatmap", "live_kpis", "latest_records",
    "stream_dedupe", "stream_daily_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("curbsight-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from curbsight.plans import catalog

    times: dict[str, float] = {}

    def timed(name: str, work) -> None:
        began = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)

    job = catalog.job_for(spark, sf_dir)
    for stage in STAGES:
        timed(f"stage_{stage}", lambda: job.build(stage))
    for name in chosen:
        timed(name, lambda: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode(
            "overwrite").save())
    print(json.dumps({
        "metric": "total seconds of stages and headline queries",
        "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
