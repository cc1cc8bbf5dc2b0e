"""Headline queries, timed once each on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from driftline.session import local_session

HEADLINE = (
    "flagship_change_board", "a1_normalize_epochs", "e2_sliding_windows", "e8_series_onset", "i3_fluctuation_exponent",
    "i7_page_cusum", "i10_permutation_entropy", "i12_spectrum_residual", "i15_unit_root", "i21_feature_vector",
    "b7_weak_labels", "c2_asof_nearest", "c8_fold_assignment", "g2_calibration_table", "h12_fuse_evidence",
    "j2_nearest_asset", "j3_closest_approach", "j7_pairs_report", "m1_forest_fit", "n3_neighbourhood", "t2_rolling_detectors",
    "m11_daily_board",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    from driftline.plans.catalogue import QUERIES

    spark.range(1000).groupBy().count().collect()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}
        )
    )


if __name__ == "__main__":
    main()
