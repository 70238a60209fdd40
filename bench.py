"""Headline queries on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridscan.queries import QUERIES  # noqa: E402
from gridscan.session import local_session  # noqa: E402

HEADLINE = [
    "m06_scan_granule", "m07_export_rasters", "m05_cascade", "x01_radiometric", "x03_tile_features", "x04_cooccurrence",
    "x06_coherence", "x15_best_shift", "w02_box_mean", "w06_wiener", "p04_contrast_stretch", "j01_context_floor", "j06_overlap_mean",
    "j11_distance_to_positive", "a06_repeat_mosaic", "a13_percentiles", "a20_components", "f01_valid_fraction", "e02_auc_summaries",
    "e08_iou_summary", "e11_threshold_sweep", "l02_speed_matched", "l10_buffered_folds", "t05_spaced_pick", "s16_pyramid",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    QUERIES["f01_valid_fraction"](spark, sf).count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
