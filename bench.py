"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from demandgrid.plans.catalog import QUERIES
from demandgrid.session import local_session

HEADLINE = [
    "k02_top_zips", "a01_zip_profiles", "a07_course_metrics", "a12_location_performance", "a04_candidate_zip_demand", "a05_demand_report", "r06_enrollment_trend",
    "r11_points_per_zip", "j13_candidate_zips", "a28_distance_buckets", "a30_competition_summary", "m22_demand_training_scores", "j35_catchment_overlap",
    "m08_rural_caps", "m19_final_site_priority", "w06_cohort_blend", "w01_global_rank", "k_exact_quantiles", "r02_spearman", "a26_providers_per_zip", "a33_competitor_supply",
    "a34_local_demand", "a35_instructor_track_record", "a38_complaint_summary", "p27_page_signals", "j18_listing_match", "j19_near_duplicate_names", "j23_distance_dedupe",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, cpus)
    wanted = sys.argv[1:] or HEADLINE
    QUERIES["f01_held_classes"](spark, sf_dir).write.mode("overwrite").format("noop").save()  # JVM warm-up, not timed
    times: dict[str, float] = {}
    for name in wanted:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.mode("overwrite").format("noop").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
