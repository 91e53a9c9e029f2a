"""Registered queries against their checking SQL on the smallest tables.

The default run takes one query of every operator family; ALL_QUERIES=1 takes all."""

import os

import pytest
from oracle import check, connect

from demandgrid.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
CORE = """a01_zip_profiles a05_demand_report a07_course_metrics a12_location_performance a16_course_benchmarks a17_forecast a18_historical_score a20_strong_weak_locations
a25_facilities_per_zip a28_distance_buckets a29_posting_demand a30_competition_summary a33_competitor_supply a34_local_demand a35_instructor_track_record a37_commercial_summary a40_score_distribution
a47_source_audit a49_instructor_readiness a50_room_readiness a54_backtest_metrics c08_merge_enrichment f03_area_filter f10_outliers j01_class_locations j11_nearest_centroid j13_candidate_zips
j15_nearest_rent_override j16_address_containment j20_point_in_polygon j22_catchment_trim j25_instructor_matching j28_site_coverage j33_lead_upsert j35_catchment_overlap k02_top_zips k03_gate_candidates
m01_zip_demand_score m08_rural_caps m19_final_site_priority m21_course_priority m30_proven_demand m36_feasibility m39_course_score_graph m54_course_readiness p01_class_record p03_mixed_dates
p27_page_signals p30_anchor_grade p37_place_json r02_spearman r05_signal_backtest r06_enrollment_trend s02_class_file_load s26_detail_sink t01_due_touches t02_reply_intake u01_curated_and_live
w01_global_rank w03_average_rank w06_cohort_blend w07_factor_decomposition""".split()
NAMES = list(QUERIES) if os.environ.get("ALL_QUERIES") else CORE


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    rows, difference = check(spark, duck, name, QUERIES[name], ORACLES.get(name), SF)
    assert difference is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_contract(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["zip", "zip_demand_score", "total_classes", "strength"]
    assert df.count() > 0
