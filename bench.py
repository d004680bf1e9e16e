"""Headline queries timed end to end; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "daily_category_hours",
    "trailing_index",
    "concentration_mean_index",
    "feature_matrix",
    "long_horizon_features",
    "leave_one_out",
    "clean_cells",
    "quality_hits",
    "dedupe_keep_last",
    "coverage",
    "hour_of_day_profile",
    "network_profile",
    "distribution_summary",
    "station_correlation",
    "autocorrelation",
    "bridged_episodes",
    "as_of_reading",
    "upsert_same_source",
    "regression_metrics",
    "skill_intervals",
    "class_metrics",
    "threshold_sweep",
    "source_agreement",
    "slots_to_hours",
    "price_regression",
    "gate_evidence",
    "alert_table",
    "persistence_band",
    "weather_usability",
]


def main() -> None:
    from hourglass.plans.catalog import load_all
    from hourglass.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load_all()
    catalog["fact_dimension_join"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the engine
    times: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        catalog[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
