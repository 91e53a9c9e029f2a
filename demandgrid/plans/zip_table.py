"""A wide ZIP table derived from suppliers: many optional signals with gaps.

Each numeric column is (base + key * step % cycle) / per, NULL on every gap-th
key; the same rule is rendered as DataFrame columns and as SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandgrid.plans.sql import VIEWS, extend
from demandgrid.plans.views import centroids, table, zip_signals

C = F.col

# name: (base, step, cycle, per, gap)
NUMBERS = {
    "bachelors_or_higher_share": (5, 7, 50, 100, 6),
    "hospital_count": (0, 3, 5, 1, 3),
    "urgent_care_count": (0, 5, 7, 1, 4),
    "nursing_school_count": (0, 7, 5, 1, 4),
    "healthcare_poi_count": (0, 11, 40, 1, 3),
    "medical_office_count": (0, 13, 30, 1, 2),
    "healthcare_facility_count": (0, 17, 70, 1, 5),
    "healthcare_facility_density": (0, 19, 200, 10, 6),
    "training_school_count": (0, 23, 50, 1, 3),
    "health_program_school_count": (0, 29, 12, 1, 4),
    "training_school_density": (0, 31, 100, 10, 5),
    "community_facility_count": (0, 37, 60, 1, 4),
    "community_facility_density": (0, 41, 300, 10, 7),
    "competition_gap_score": (0, 43, 101, 1, 2),
    "parking_proxy_score": (0, 43, 101, 1, 3),
    "nearest_history_miles": (0, 47, 250, 10, 4),
    "avg_competitor_rating": (30, 53, 21, 10, 5),
    "college_count": (0, 13, 7, 1, 3),
    "childcare_count": (0, 17, 23, 1, 3),
    "school_count": (0, 19, 25, 1, 4),
    "student_enrollment_count": (0, 331, 12000, 1, 4),
    "healthcare_provider_count": (0, 59, 180, 1, 3),
    "physician_count": (0, 61, 60, 1, 4),
    "nurse_count": (0, 67, 90, 1, 4),
    "clinic_provider_count": (0, 71, 30, 1, 5),
    "commercial_access_proxy_score": (0, 73, 101, 1, 3),
    "total_students": (0, 79, 300, 1, 3),
    "class_count": (0, 83, 40, 1, 3),
    "avg_students": (0, 89, 160, 10, 4),
    "fill_rate": (20, 97, 80, 1, 4),
    "demand_score": (0, 41, 101, 1, 3),
    "estimated_rent": (1000, 101, 4000, 1, 3),
    "proven_aha_bls_score": (0, 29, 101, 1, 2),
    "mix_arc_bls": (0, 31, 101, 100, 3),
    "arc_cpr_students": (0, 37, 150, 1, 4),
    "aha_bls_students": (0, 43, 140, 1, 3),
    "arc_bls_students": (0, 47, 130, 1, 5),
}
# name: (values by key modulo their number), None = unknown
LABELS = {
    "rent_source": [None, "listing", None, "broker"],
    "historical_status": [None, "has_history", "no_history"],
    "model_agreement": ["mixed", "model_agrees_high", None, "hidden_opportunity", "model_overpredicts", "model_agrees_low", "model_underpredicts"],
    "data_confidence": ["ok", "ok", "partial", "ok", "missing"],
    "enrichment_updated_at": [None, "2024-05-01T00:00:00", "soon"],
}
BOOLS = {
    "commercial_space_available": [None, True, False, True],
    "commercial_ready": [None, True, True, False, False],
    "classroom_fit": [None, True, False],
}


def _sql_value(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'"


def derived_sql(numbers: dict, labels: dict, bools: dict) -> str:
    """SQL select items of the rules, over a key column k."""
    out = []
    for name, (base, step, cycle, per, gap) in numbers.items():
        out.append(f"CASE WHEN k % {gap} = 0 THEN NULL ELSE CAST({base} + k * {step} % {cycle} AS DOUBLE) / {float(per)} END AS {name}")
    for name, values in {**labels, **bools}.items():
        kind = "BOOLEAN" if name in bools else "VARCHAR"
        whens = " ".join(f"WHEN {i} THEN {_sql_value(v)}" for i, v in enumerate(values))
        out.append(f"CAST(CASE k % {len(values)} {whens} END AS {kind}) AS {name}")
    return ",\n ".join(out)


def derived_columns(k: Column, numbers: dict, labels: dict, bools: dict) -> dict[str, Column]:
    """DataFrame columns of the same rules."""
    cols = {name: F.when(k % gap != 0, (base + k * step % cycle).cast("double") / float(per)) for name, (base, step, cycle, per, gap) in numbers.items()}
    for name, values in {**labels, **bools}.items():
        picked = F.array(*[F.lit(v).cast("boolean" if name in bools else "string") for v in values])
        cols[name] = F.element_at(picked, (k % len(values) + 1).cast("int"))
    return cols


extend("v_zip", f"""SELECT z.*, c.lat, c.lng, CASE WHEN z.land_sqmi > 0 THEN z.population / z.land_sqmi END AS population_density,
 {derived_sql(NUMBERS, LABELS, BOOLS)}
 FROM (SELECT *, CAST(zip AS INT) AS k FROM v_zip_signal) z JOIN v_centroid c ON z.zip = c.zip""", ["v_zip_signal", "v_centroid"])


def zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = derived_columns(C("zip").cast("long"), NUMBERS, LABELS, BOOLS)
    base = zip_signals(spark, sf_dir).join(centroids(spark, sf_dir), "zip")
    cols["population_density"] = F.when(C("land_sqmi") > 0, C("population") / C("land_sqmi"))
    return base.withColumns(cols)
