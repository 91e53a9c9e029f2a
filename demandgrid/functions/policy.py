"""Fixed values of the scoring policy: bounds, weights, caps and thresholds."""

# normalisation bounds of the modelled ZIP signals (low -> 0, high -> 1)
ZIP_BOUNDS = {
    "population": (500.0, 50000.0),
    "population_density": (50.0, 8000.0),
    "median_household_income": (40000.0, 150000.0),
    "working_age_share": (0.55, 0.80),
    "employment_rate": (0.50, 0.75),
    "bachelors_or_higher_share": (0.15, 0.55),
    "healthcare_employment_share": (0.05, 0.25),
    "healthcare_facility_density": (0.0, 15.0),
    "community_facility_density": (0.0, 25.0),
    "training_school_density": (0.0, 8.0),
    "competition_gap_score": (0.0, 100.0),
}
BASELINE_SIGNALS = [
    "population", "population_density", "median_household_income", "working_age_share", "employment_rate",
    "bachelors_or_higher_share", "healthcare_employment_share",
]
ENRICHMENT_SIGNALS = [
    "healthcare_facility_density", "community_facility_density", "training_school_density", "competition_gap_score",
]
BLS_WEIGHTS = {
    "healthcare_employment_share": 0.28,
    "working_age_share": 0.14,
    "median_household_income": 0.10,
    "employment_rate": 0.08,
    "population": 0.08,
    "population_density": 0.07,
    "bachelors_or_higher_share": 0.05,
    "healthcare_facility_density": 0.10,
    "training_school_density": 0.05,
    "competition_gap_score": 0.05,
}
CPR_WEIGHTS = {
    "population": 0.20,
    "population_density": 0.18,
    "median_household_income": 0.12,
    "working_age_share": 0.10,
    "healthcare_employment_share": 0.10,
    "employment_rate": 0.05,
    "bachelors_or_higher_share": 0.05,
    "community_facility_density": 0.10,
    "training_school_density": 0.05,
    "competition_gap_score": 0.05,
}
# automated validation weights and count caps
VALIDATION_WEIGHTS = {
    "hospital_count": 1.2,
    "urgent_care_count": 1.0,
    "nursing_school_count": 1.0,
    "healthcare_poi_count": 1.4,
    "community_facility_count": 0.9,
    "competitor_gap": 1.0,
    "population_density": 0.9,
    "commercial_readiness": 0.8,
    "historical_proximity": 1.0,
}
COMPETITION_SATURATION = 20.0
# offline API-candidate gate
GATE_MIN_POPULATION = 5000.0
GATE_MIN_DENSITY = 300.0
GATE_MIN_OVERALL = 45.0
PLACES_CALLS_PER_ZIP = 4
# candidate site score weights
SITE_WEIGHTS = {
    "demand_score": 0.23,
    "healthcare_training_ecosystem_score": 0.18,
    "competition_gap_score": 0.15,
    "opportunity_score": 0.13,
    "economy_score": 0.09,
    "accessibility_score": 0.10,
    "historical_performance_score": 0.08,
    "profitability_score": 0.04,
}
COHORT_BLEND = 0.5
# rent pressure bounds
RENT_BOUNDS = {"income": (40000.0, 160000.0), "density": (10.0, 250.0), "competition": (2.0, 40.0), "corridor_miles": 5.0}
# business feasibility
VARIABLE_COST = 25.0
FIXED_COST_LOW, FIXED_COST_HIGH = 4000.0, 9000.0
CLASSROOM_MIN, CLASSROOM_TARGET, SQFT_PER_STUDENT = 6, 12, 35.0
PRESSURE_LOW, PRESSURE_MEDIUM, PRESSURE_EXTREME = 25.0, 50.0, 78.0
# unknown inputs of the site priority score count as neutral
UNKNOWN_COMMERCIAL = 50.0
UNKNOWN_HISTORY = 50.0
