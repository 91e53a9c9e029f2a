"""Registered queries over the modelled ZIP layer, the gate and site priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandgrid.functions import policy as P
from demandgrid.functions.exprs import joined, rnd
from demandgrid.operators import modeled as M
from demandgrid.operators import priority as PR
from demandgrid.plans import views as V
from demandgrid.plans.registry import query
from demandgrid.plans.sql import CLAMP, LOG_SCALE, R, RENORM, SCALE, extend, with_views
from demandgrid.plans.zip_table import zips

C = F.col


def layer(source: str, *steps: dict[str, str]) -> str:
    """Nested SELECTs that add columns step by step."""
    sql = f"SELECT * FROM {source}"
    for step in steps:
        sql = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in step.items())} FROM ({sql})"
    return sql


# --- modelled layer ---------------------------------------------------------------

_gap = "CASE WHEN competition_gap_score IS NOT NULL THEN greatest(0.0, least(100.0, competition_gap_score)) WHEN competitor_count <= 2 THEN 100.0 " \
       "WHEN competitor_count <= 5 THEN 75.0 WHEN competitor_count <= 10 THEN 45.0 WHEN competitor_count <= 20 THEN 20.0 WHEN competitor_count > 20 THEN 5.0 END::DOUBLE"
_yes = lambda c, a, b: f"CASE WHEN {c} THEN {a} WHEN NOT {c} THEN {b} END"
_V = {
    "hospital_count": CLAMP("hospital_count * 100.0 / 3"), "urgent_care_count": CLAMP("urgent_care_count * 100.0 / 5"),
    "nursing_school_count": CLAMP("nursing_school_count * 100.0 / 4"),
    "healthcare_poi_count": CLAMP("coalesce(nullif(healthcare_poi_count, 0), nullif(medical_office_count, 0), healthcare_facility_count, healthcare_facility_density) * 100.0 / 25"),
    "community_facility_count": CLAMP("community_facility_count * 100.0 / 20"), "competitor_gap": _gap,
    "population_density": R("n_population_density * 100", 1),
    "commercial_readiness": R(RENORM([(_yes("commercial_space_available", 80.0, 20.0), 1.0), (_yes("commercial_ready", 100.0, 35.0), 1.0),
                                      ("parking_proxy_score", 1.0), (_yes("classroom_fit", 90.0, 25.0), 1.0)]), 1),
    "historical_proximity": "CASE WHEN nearest_history_miles <= 3 THEN 100.0 WHEN nearest_history_miles <= 8 THEN 75.0 WHEN nearest_history_miles <= 15 THEN 45.0 WHEN nearest_history_miles > 15 THEN 15.0 END::DOUBLE",
}
_core = ["hospital_count", "urgent_care_count", "nursing_school_count", "healthcare_poi_count", "competitor_gap", "population_density"]
_isnull = lambda xs, p, neg: " + ".join(f"CASE WHEN {p}{x} IS {neg} NULL THEN 1 ELSE 0 END" for x in xs)
_weak = "coalesce(validation_score < 70, true)"
MODELED = layer(
    "v_zip",
    {f"n_{s}": f"({SCALE(s, *b)} / 100.0)" for s, b in P.ZIP_BOUNDS.items()},
    {"bls_raw": R(RENORM([(f"n_{s}", w) for s, w in P.BLS_WEIGHTS.items()]) + " * 100", 1),
     "cpr_raw": R(RENORM([(f"n_{s}", w) for s, w in P.CPR_WEIGHTS.items()]) + " * 100", 1),
     "baseline_count": f"CAST({_isnull(P.BASELINE_SIGNALS, 'n_', 'NOT')} AS INT)",
     "model_tier": f"CASE WHEN {_isnull(P.ENRICHMENT_SIGNALS, 'n_', 'NOT')} > 0 THEN 'enriched' ELSE 'baseline' END",
     **{f"v_{k}": v for k, v in _V.items()}},
    {"overall_raw": R("(bls_raw + cpr_raw) / 2", 1),
     "confidence": "CASE WHEN baseline_count >= 5 THEN 'ok' WHEN baseline_count >= 3 THEN 'partial' ELSE 'missing' END",
     "validation_score": R(RENORM([(f"v_{k}", w) for k, w in P.VALIDATION_WEIGHTS.items()]), 1),
     "validation_signals": f"CAST({_isnull(P.VALIDATION_WEIGHTS, 'v_', 'NOT')} AS INT)", "core_missing": f"CAST({_isnull(_core, 'v_', '')} AS INT)"},
    {"rural": "coalesce(population_density < 50, false)", "small": "coalesce(population < 10000 AND population_density < 100, false)",
     "weak": _weak, "thin": "coalesce(healthcare_employment_share < 0.01 AND population_density < 100, false)"},
    {"cap_overall": "(rural OR small) AND weak AND overall_raw > 25", "cap_bls": "thin AND weak AND bls_raw > 25"},
    {"bls_demand": "CASE WHEN cap_bls THEN 25.0 ELSE bls_raw END", "cpr_demand": "cpr_raw",
     "overall": R("CASE WHEN cap_overall THEN least(25.0, ((CASE WHEN cap_bls THEN 25.0 ELSE bls_raw END) + cpr_raw) / 2) ELSE ((CASE WHEN cap_bls THEN 25.0 ELSE bls_raw END) + cpr_raw) / 2 END", 1),
     "cap_reason": "CASE WHEN cap_overall AND rural THEN 'rural_low_density_cap' WHEN cap_overall AND small THEN 'small_low_density_market_cap' WHEN cap_bls THEN 'rural_weak_healthcare_workforce_cap' ELSE '' END",
     "final_cap_applied": "cap_overall OR cap_bls", "validation_override_applied": "NOT (cap_overall OR cap_bls) AND NOT weak"},
    {"validation_tier": """CASE WHEN confidence = 'missing' OR overall IS NULL OR (confidence <> 'ok' AND (validation_signals < 3 OR core_missing >= 4)) THEN 'Insufficient data'
   WHEN overall >= 70 AND coalesce(validation_score, 0) >= 65 THEN 'Strong opportunity' WHEN overall >= 55 AND coalesce(validation_score, 0) >= 65 THEN 'Validation-supported opportunity'
   WHEN overall >= 55 THEN 'Promising opportunity' WHEN overall >= 40 OR coalesce(validation_score, 0) >= 65 THEN 'Watchlist' ELSE 'Low priority' END"""})
extend("modeled", MODELED, ["v_zip"])


def model(spark, sf):
    return M.modeled(zips(spark, sf))


def _register(name, cols):
    @query(name, with_views("modeled", f"SELECT {cols} FROM modeled"))
    def _(spark, sf):
        return model(spark, sf).select(*cols.split(", "))


_register("m05_modeled_tilts", "zip, bls_raw, cpr_raw, overall_raw, baseline_count, model_tier, confidence")
_register("m07_automated_validation", "zip, validation_score, validation_signals, core_missing, validation_tier")
_register("m08_rural_caps", "zip, overall, bls_demand, cpr_demand, cap_reason, final_cap_applied, validation_override_applied")
_register("c18_validation_components", "zip, v_competitor_gap, v_commercial_readiness, v_historical_proximity")


@query("m10_zip_features", with_views("v_zip_signal v_centroid", f"""
SELECT z.zip, population, {R("CASE WHEN land_sqmi > 0 THEN population / land_sqmi END", 4)} AS population_density, median_household_income
FROM v_zip_signal z JOIN v_centroid c ON z.zip = c.zip"""))
def _(spark, sf):
    geo = V.centroids(spark, sf).join(V.zip_signals(spark, sf).select("zip", "land_sqmi"), "zip")
    out = M.features(geo, V.zip_signals(spark, sf).drop("land_sqmi"))
    return out.select("zip", "population", rnd(C("population_density"), 4).alias("population_density"), "median_household_income")


@query("j02_national_layer", with_views("modeled", """
SELECT zip, overall, bls_demand, cpr_demand, validation_tier, confidence FROM modeled WHERE overall IS NOT NULL ORDER BY overall DESC, zip LIMIT 50"""))
def _(spark, sf):
    z = zips(spark, sf)
    base = ["zip", "lat", "lng", "land_sqmi"]
    acs = ["population", "median_household_income", "working_age_share", "employment_rate", "healthcare_employment_share", "bachelors_or_higher_share"]
    rest = [c for c in z.columns if c not in base + acs + ["population_density"]]
    f = M.features(z.select(*base), z.select("zip", *acs), z.select("zip", *rest))
    return M.modeled(f).where("overall IS NOT NULL").orderBy(C("overall").desc(), "zip").limit(50).select(
        "zip", "overall", "bls_demand", "cpr_demand", "validation_tier", "confidence")


@query("m06_signal_breakdown", with_views("modeled", " UNION ALL ".join(
    f"SELECT zip, '{s}' AS signal, {R('n_' + s, 4)} AS normalized, CAST({w} AS DOUBLE) AS weight, coalesce({R(f'n_{s} * {w}', 4)}, 0.0) AS contribution, n_{s} IS NOT NULL AS present FROM modeled"
    for s, w in P.BLS_WEIGHTS.items())))
def _(spark, sf):
    return M.signal_rows(M.tilts(zips(spark, sf)), P.BLS_WEIGHTS)


_SIG = " UNION ALL ".join(f"SELECT zip, '{s}' AS s, {R(f'n_{s} * 100', 1)} AS v, n_{s} AS nn FROM modeled WHERE n_{s} IS NOT NULL" for s in P.ZIP_BOUNDS)


@query("m09_drivers_weaknesses", with_views("modeled", """
SELECT m.zip, coalesce(d, '') AS score_drivers, coalesce(w, '') AS score_weaknesses FROM modeled m
LEFT JOIN (SELECT zip, string_agg(t, ',' ORDER BY v DESC, s) AS d FROM (SELECT *, row_number() OVER (PARTITION BY zip ORDER BY v DESC, s) AS rn FROM sig WHERE v >= 55) WHERE rn <= 5 GROUP BY 1) a ON m.zip = a.zip
LEFT JOIN (SELECT zip, string_agg(t, ',' ORDER BY v, s) AS w FROM (SELECT *, row_number() OVER (PARTITION BY zip ORDER BY v, s) AS rn FROM sig WHERE v < 45) WHERE rn <= 5 GROUP BY 1) b ON m.zip = b.zip""",
       sig=f"SELECT *, s || ':' || CASE WHEN nn >= 0.66 THEN 'strong' WHEN nn >= 0.33 THEN 'moderate' ELSE 'weak' END AS t FROM ({_SIG})"))
def _(spark, sf):
    return M.drivers(M.tilts(zips(spark, sf))).select("zip", "score_drivers", "score_weaknesses")


@query("c19_signal_strength", with_views("modeled", f"SELECT zip, s AS signal, v AS normalized, CASE WHEN nn >= 0.66 THEN 'strong' WHEN nn >= 0.33 THEN 'moderate' ELSE 'weak' END AS strength FROM ({_SIG})"))
def _(spark, sf):
    t = M.tilts(zips(spark, sf))
    rows = F.array(*[F.struct(F.lit(s).alias("signal"), C(f"n_{s}").alias("n")) for s in P.ZIP_BOUNDS])
    return t.select("zip", F.explode(rows).alias("r")).where("r.n IS NOT NULL").select(
        "zip", "r.signal", rnd(C("r.n") * 100, 1).alias("normalized"), M.strength(C("r.n")).alias("strength"))


@query("m09_risk_flags", with_views("modeled", """
SELECT zip, concat_ws(',', 'modeled_only', 'requires_field_test', 'requires_commercial_validation', 'heatmap_not_boundary_exact',
 CASE WHEN confidence <> 'ok' THEN 'partial_public_data' END, CASE WHEN population IS NULL OR population < 5000 THEN 'low_population' END,
 CASE WHEN population_density IS NULL OR population_density < 300 THEN 'low_density' END,
 CASE WHEN n_healthcare_employment_share IS NULL OR n_healthcare_employment_share < 0.33 THEN 'weak_healthcare_signal' END,
 CASE WHEN overall IS NULL THEN 'partial_public_data' END) AS risk_flags FROM modeled"""))
def _(spark, sf):
    m = model(spark, sf)
    return m.select("zip", joined(M.risk_flags(m)).alias("risk_flags"))


@query("m11_enhanced_signals", with_views("v_poi v_centroid v_zip_signal", f"""
SELECT z.zip, count(CASE WHEN kind IN ('hospital','urgent care') THEN 1 END) AS healthcare_count, count(CASE WHEN kind = 'nursing school' THEN 1 END) AS training_count,
 {R("count(CASE WHEN kind IN ('hospital','urgent care') THEN 1 END) / nullif(any_value(land_sqmi), 0)", 4)} AS healthcare_facility_density,
 {R("count(CASE WHEN kind = 'nursing school' THEN 1 END) / nullif(any_value(land_sqmi), 0)", 4)} AS training_school_density,
 {R("greatest(0.0, 1.0 - count(CASE WHEN kind = 'CPR training' THEN 1 END) / 20.0) * 100", 1)} AS competition_gap_score
FROM v_zip_signal z LEFT JOIN v_poi p ON z.zip = lpad(CAST(p.place_id * 7 % 100 AS VARCHAR), 5, '0') GROUP BY z.zip"""))
def _(spark, sf):
    p = V.pois(spark, sf).withColumn("zip", F.lpad((C("place_id") * 7 % 100).cast("string"), 5, "0"))
    k = p.groupBy("zip").agg(F.count_if(C("kind").isin("hospital", "urgent care")).alias("h"), F.count_if(C("kind") == "nursing school").alias("t"),
                             F.count_if(C("kind") == "CPR training").alias("c"))
    z = V.zip_signals(spark, sf).select("zip", "land_sqmi").join(k, "zip", "left").select(
        "zip", "land_sqmi", *[F.coalesce(C(a), F.lit(0)).alias(b) for a, b in (("h", "healthcare_count"), ("t", "training_count"), ("c", "competitors"))])
    return M.enhanced_signals(z).drop("land_sqmi", "competitors")


@query("m12_rescore_overlay", with_views("modeled v_zip", f"""
SELECT a.zip, a.overall AS new_overall, b.o AS old_overall, {R("a.overall - b.o", 1)} AS change FROM modeled a JOIN base b ON a.zip = b.zip""",
       base=f"SELECT zip, overall AS o FROM ({MODELED.replace('SELECT * FROM v_zip', 'SELECT * REPLACE (NULL::DOUBLE AS competition_gap_score, NULL::DOUBLE AS healthcare_facility_density, NULL::DOUBLE AS community_facility_density, NULL::DOUBLE AS training_school_density) FROM v_zip')})"))
def _(spark, sf):
    z = zips(spark, sf)
    base = M.modeled(z.drop(*P.ENRICHMENT_SIGNALS)).select("zip", C("overall").alias("old_overall"))
    return model(spark, sf).select("zip", C("overall").alias("new_overall")).join(base, "zip").withColumn("change", rnd(C("new_overall") - C("old_overall"), 1))


@query("k01_top_zips_by_course", with_views("modeled", "SELECT zip, bls_demand FROM modeled WHERE coalesce(bls_demand, 0) >= 30 ORDER BY coalesce(bls_demand, 0) DESC, zip LIMIT 25"))
def _(spark, sf):
    return model(spark, sf).where(F.coalesce(C("bls_demand"), F.lit(0.0)) >= 30).orderBy(F.coalesce(C("bls_demand"), F.lit(0.0)).desc(), "zip").limit(25).select("zip", "bls_demand")


# --- gate ------------------------------------------------------------------------------

_n0 = lambda f, lo, hi: f"coalesce({SCALE(f, lo, hi)}, 0.0)"
_mx = lambda caps: "greatest(" + ", ".join(_n0(f, 0, c) for f, c in caps.items() if f not in ("ems_fire_count", "provider_density_per_10k_pop")) + ")"
_bulk = [f for f in M.BULK_FIELDS if f not in ("ems_fire_count", "provider_density_per_10k_pop")]
GATED = layer(
    "modeled",
    {"gate_reason": f"""CASE WHEN lat IS NULL OR lng IS NULL THEN 'missing_coordinates' WHEN coalesce(population, 0) <= 0 THEN 'no_population' WHEN population < 5000 THEN 'low_population'
   WHEN coalesce(population_density, 0) < 300 THEN 'low_density' WHEN coalesce(overall, 0) < 45 THEN 'low_overall' WHEN data_confidence IN ('missing','low','very_low','very low','poor') THEN 'low_confidence'
   WHEN coalesce({', '.join(_bulk)}) IS NOT NULL AND NOT (greatest({', '.join(f'coalesce({b}, 0)' for b in _bulk)}) > 0) THEN 'no_bulk_signal' END""",
     "g_health": R(f"greatest({_mx(M.HEALTH_CAPS)}, 0.8 * {_n0('healthcare_employment_share', 0, 0.03)})", 1),
     "g_school": R(f"greatest({_mx(M.SCHOOL_CAPS)}, 0.7 * {_n0('bachelors_or_higher_share', 0.15, 0.50)})", 1),
     "g_community": R(f"greatest({_mx(M.COMMUNITY_CAPS)}, {_n0('population_density', 300, 5000)}, 0.7 * {_n0('population', 5000, 100000)})", 1),
     "g_commercial": R(f"greatest({_n0('commercial_access_proxy_score', 0, 100)}, 0.6 * {_n0('population_density', 300, 5000)}, CASE WHEN commercial_space_available THEN 80.0 ELSE 0.0 END)", 1),
     "g_history": R(f"greatest({_n0('total_students', 0, 250)}, {_n0('class_count', 0, 30)}, {_n0('avg_students', 0, 15)}, {_n0('fill_rate', 40, 85)}, {_n0('demand_score', 0, 100)})", 1)},
    {"api_candidate_score": f"CASE WHEN gate_reason IS NOT NULL THEN 0.0 ELSE {R('0.35 * overall + 0.20 * g_health + 0.15 * g_school + 0.10 * g_community + 0.10 * g_commercial + 0.10 * g_history', 1)} END"},
    {"api_priority": "CASE WHEN gate_reason IS NOT NULL THEN 'exclude' WHEN api_candidate_score >= 60 THEN 'finalist' WHEN api_candidate_score >= 50 THEN 'high' WHEN api_candidate_score >= 40 THEN 'medium' WHEN api_candidate_score >= 30 THEN 'low' ELSE 'exclude' END"})
extend("gated", GATED, ["modeled"])


def gated(spark, sf):
    return M.gate(model(spark, sf))


@query("m13_api_candidate_gate", with_views("gated", "SELECT zip, api_candidate_score, api_priority, api_priority IN ('high','finalist') AS recommended_for_live_places FROM gated"))
def _(spark, sf):
    return gated(spark, sf).select("zip", "api_candidate_score", "api_priority", "recommended_for_live_places")


@query("c20_gate_parts", with_views("gated", "SELECT zip, g_health, g_school, g_community, g_commercial, g_history FROM gated"))
def _(spark, sf):
    return gated(spark, sf).select("zip", "g_health", "g_school", "g_community", "g_commercial", "g_history")


@query("f06_hard_exclusion", with_views("gated", "SELECT coalesce(gate_reason, 'kept') AS reason, count(*) AS zips FROM gated GROUP BY 1"))
def _(spark, sf):
    m = model(spark, sf)
    return m.groupBy(F.coalesce(M.hard_exclusion(m), F.lit("kept")).alias("reason")).agg(F.count("*").alias("zips"))


@query("k03_gate_candidates", with_views("gated", "SELECT zip, api_candidate_score, overall FROM gated WHERE api_priority <> 'exclude' ORDER BY api_candidate_score DESC, overall DESC, zip DESC LIMIT 15"))
def _(spark, sf):
    return M.gate_candidates(gated(spark, sf), 15).select("zip", "api_candidate_score", "overall")


@query("a56_gate_budget", with_views("gated", """
SELECT total, excluded, candidates, least(candidates, 15) AS selected, least(candidates, 15) * 4 AS estimated_calls, CAST(round_even(least(candidates, 15) * 4 / 60.0, 0) AS BIGINT) AS estimated_minutes
FROM (SELECT count(*) AS total, count(CASE WHEN api_priority = 'exclude' THEN 1 END) AS excluded, count(CASE WHEN api_priority <> 'exclude' THEN 1 END) AS candidates FROM gated)"""))
def _(spark, sf):
    return M.gate_budget(gated(spark, sf), 15)


_F05 = """CASE WHEN lat IS NULL OR lng IS NULL THEN 'missing_coordinates' WHEN coalesce(overall, 0) < 30 THEN 'below_min_score' WHEN coalesce(population, 0) < 5000 THEN 'below_min_population'
 WHEN data_confidence IN ('missing','low','very_low','very low','poor','none') THEN 'missing_acs_fields' WHEN coalesce(population_density, 0) < 300 AND coalesce(overall, 0) < 70 THEN 'low_density' END"""


@query("f05_national_gate", with_views("modeled", f"SELECT zip, {_F05} AS reason FROM modeled"))
def _(spark, sf):
    return model(spark, sf).select("zip", M.national_gate_reason(30, 5000).alias("reason"))


@query("a32_gate_drop_counts", with_views("modeled", f"SELECT coalesce({_F05}, 'kept') AS reason, count(*) AS zips FROM modeled GROUP BY 1"))
def _(spark, sf):
    return model(spark, sf).groupBy(F.coalesce(M.national_gate_reason(30, 5000), F.lit("kept")).alias("reason")).agg(F.count("*").alias("zips"))


@query("c08_merge_enrichment", with_views("v_zip", """
SELECT zip, CASE WHEN CAST(zip AS INT) % 3 = 0 AND healthcare_poi_count IS NOT NULL THEN healthcare_poi_count ELSE hospital_count END AS hospital_count,
 CASE WHEN CAST(zip AS INT) % 3 = 0 THEN 'enriched' ELSE 'baseline' END AS tier,
 CASE WHEN CAST(zip AS INT) % 6 = 0 THEN 'acs,places' WHEN CAST(zip AS INT) % 3 = 0 THEN 'acs,npi' ELSE 'acs' END AS sources FROM v_zip"""))
def _(spark, sf):
    z = zips(spark, sf)
    k = C("zip").cast("int")
    base = z.select("zip", "hospital_count", F.array(F.lit("acs")).alias("enrichment_sources"))
    enr = z.where(k % 3 == 0).select("zip", C("healthcare_poi_count").alias("hospital_count"),
                                     F.when(k % 6 == 0, F.array(F.lit("places"), F.lit("acs"))).otherwise(F.array(F.lit("npi"))).alias("enrichment_sources"))
    return M.merge_enrichment(base, enr).select("zip", "hospital_count", "tier", joined(C("enrichment_sources")).alias("sources"))


@query("j05_carry_prior_enrichment", with_views("v_zip", """
SELECT zip, population, CASE WHEN CAST(zip AS INT) % 4 = 1 THEN coalesce(healthcare_poi_count, hospital_count) ELSE hospital_count END AS hospital_count,
 CASE WHEN CAST(zip AS INT) % 4 = 1 THEN 'enriched' ELSE 'baseline' END AS tier FROM v_zip"""))
def _(spark, sf):
    z = zips(spark, sf)
    prior = z.select("zip", C("healthcare_poi_count").alias("hospital_count"), F.when(C("zip").cast("int") % 4 == 1, "enriched").otherwise("baseline").alias("tier"))
    return M.carry_prior(z.select("zip", "population", "hospital_count", F.lit("baseline").alias("tier")), prior, ["hospital_count"])


# --- site priority -----------------------------------------------------------------------

W = lambda *p: R(RENORM([(CLAMP(x), w) for x, w in p]), 1)
L = lambda x, lo, hi: R(SCALE(x, lo, hi), 1)
LC = lambda x, cap: R(LOG_SCALE(x, cap), 1)
_sets = {"healthcare": ("coalesce(healthcare_facility_count, healthcare_poi_count, medical_office_count)", "healthcare_facility_density", 60, 15),
         "training_any": ("coalesce(training_school_count, nursing_school_count, health_program_school_count)", "training_school_density", 45, 8),
         "training": ("coalesce(training_school_count, health_program_school_count)", "training_school_density", 45, 8),
         "community": ("community_facility_count", "community_facility_density", 50, 25),
         "healthcare_wide": ("coalesce(healthcare_facility_count, healthcare_poi_count, medical_office_count, clinic_provider_count)", "healthcare_facility_density", 60, 15),
         "community_wide": ("coalesce(community_facility_count, school_count, childcare_count)", "community_facility_density", 70, 25)}
_comm = f"""(CASE WHEN NOT commercial_space_available THEN 25.0 WHEN commercial_space_available THEN 45.0 ELSE 35.0 END + CASE WHEN estimated_rent IS NOT NULL THEN 10 ELSE 0 END
 + CASE WHEN rent_source <> '' THEN 5 ELSE 0 END + CASE WHEN parking_proxy_score IS NULL THEN 0 ELSE least(15.0, parking_proxy_score * 0.15) END + CASE WHEN classroom_fit THEN 15 WHEN NOT classroom_fit THEN -5 ELSE 0 END)"""
_sure = "coalesce(commercial_space_available AND commercial_ready, false)"
_some = "(commercial_space_available IS NOT NULL OR commercial_ready IS NOT NULL OR estimated_rent IS NOT NULL OR rent_source IS NOT NULL OR parking_proxy_score IS NOT NULL OR classroom_fit IS NOT NULL)"
_k = "competitor_count"
PRIORITY = layer(
    "modeled",
    {**{f"c_{k}": LC(v[0], v[2]) for k, v in _sets.items()}, **{f"d_{k}": L(v[1], 0, v[3]) for k, v in _sets.items()},
     "nurs": LC("nursing_school_count", 12), "hosp": LC("hospital_count", 10), "urg": LC("urgent_care_count", 10), "popu": L("population", 5000, 60000),
     "den": L("population_density", 500, 10000), "care": L("healthcare_employment_share", 0.005, 0.15), "wrk": L("working_age_share", 0.55, 0.80),
     "emp": L("employment_rate", 0.50, 0.75), "inc": L("median_household_income", 45000, 160000), "edu": L("bachelors_or_higher_share", 0.15, 0.55),
     "historical_fit_score": "CASE WHEN historical_status = 'has_history' THEN coalesce(demand_score, " + R(CLAMP("overall"), 1) + ") END"},
    {**{f"p_{k}": W((f"c_{k}", 0.55), (f"d_{k}", 0.45)) for k in _sets}, "hf": """coalesce(historical_fit_score, CASE model_agreement WHEN 'model_agrees_high' THEN 80.0 WHEN 'hidden_opportunity' THEN 75.0
      WHEN 'model_underpredicts' THEN 70.0 WHEN 'mixed' THEN 55.0 WHEN 'insufficient_history' THEN 50.0 WHEN 'model_overpredicts' THEN 40.0 WHEN 'model_agrees_low' THEN 30.0 END)""",
     "p_anchors": W(("hosp", 0.55), ("urg", 0.45)), "p_size": W(("popu", 0.5), ("den", 0.5)), "p_wc": W(("bls_demand", 0.75), ("care", 0.25)),
     "p_work": W(("wrk", 0.5), ("emp", 0.5)), "p_inc": W(("inc", 0.6), ("edu", 0.4))},
    {"places_support_score": W(("p_healthcare", 0.45), ("p_training_any", 0.45), ("p_community", 0.10)), "p_tf": W(("p_training", 0.75), ("nurs", 0.25)),
     "healthcare_anchor_score": W(("p_healthcare_wide", 0.55), ("p_anchors", 0.30), ("nurs", 0.15)),
     "community_training_score": W(("p_community_wide", 0.35), ("p_training", 0.30), ("p_size", 0.35)),
     "competitor_market_validation_score": f"CASE WHEN {_k} <= 0 THEN 25.0 WHEN {_k} <= 5 THEN 72.0 WHEN {_k} <= 12 THEN 86.0 WHEN {_k} < 20 THEN 92.0 WHEN {_k} >= 20 THEN 96.0 END::DOUBLE",
     "competition_saturation_penalty": f"CAST(greatest(0.0, least(18.0, CASE WHEN {_k} IS NULL OR {_k} <= 0 THEN 0.0 WHEN {_k} <= 5 THEN 2.0 WHEN {_k} <= 12 THEN 5.0 WHEN {_k} < 20 THEN 9.0 ELSE 14.0 END + CASE WHEN {_k} >= 13 AND avg_competitor_rating >= 4.7 THEN 2.0 WHEN {_k} >= 13 AND avg_competitor_rating < 4.0 THEN -1.0 ELSE 0.0 END)) AS DOUBLE)",
     "competition_risk_level": f"CASE WHEN {_k} IS NULL THEN 'unknown' WHEN {_k} <= 0 THEN 'unproven_market' WHEN {_k} <= 5 THEN 'low_to_moderate' WHEN {_k} <= 12 THEN 'competitive_but_healthy' WHEN {_k} < 20 THEN 'competitive' ELSE 'saturated_unless_differentiated' END",
     "competitor_quality_signal": L("avg_competitor_rating", 3.5, 5.0),
     "commercial_feasibility_score": f"CASE WHEN {_some} THEN {R(CLAMP(f'CASE WHEN {_sure} THEN greatest({_comm}, 80.0) ELSE {_comm} END'), 1)} END",
     "commercial_feasibility_confirmed": f"({_some} AND {_sure})",
     "commercial_feasibility_status": f"CASE WHEN NOT {_some} THEN 'unknown' WHEN {_sure} THEN 'confirmed' WHEN NOT commercial_space_available THEN 'unavailable' ELSE 'partial' END",
     "freshness_score": W(("CASE data_confidence WHEN 'ok' THEN 85.0 WHEN 'partial' THEN 60.0 WHEN 'missing' THEN 30.0 END", 0.55),
                          ("CASE WHEN enrichment_updated_at = 'soon' THEN 65.0 WHEN enrichment_updated_at IS NOT NULL THEN 90.0 END", 0.45))},
    {"market_demand_score": W(("p_size", 0.20), ("p_work", 0.15), ("p_wc", 0.20), ("cpr_demand", 0.15), ("p_inc", 0.10), ("hf", 0.10), ("places_support_score", 0.10)),
     "vb": W(("p_healthcare", 0.25), ("p_tf", 0.20), ("p_anchors", 0.15), ("commercial_feasibility_score", 0.15), ("hf", 0.15), ("freshness_score", 0.10)),
     "va": W(("competitor_market_validation_score", 0.90), ("freshness_score", 0.10)), "ev": "coalesce(p_healthcare, p_tf, p_anchors, commercial_feasibility_score, hf) IS NOT NULL",
     "commercial_feasibility_score_used": "coalesce(commercial_feasibility_score, 50.0)", "historical_fit_used": "coalesce(hf, 50.0)"},
    {"validation_evidence_score": "CASE WHEN NOT ev AND competitor_market_validation_score IS NULL THEN NULL WHEN NOT ev THEN va WHEN competitor_market_validation_score IS NOT NULL THEN "
                                  + R(CLAMP("vb * 0.90 + competitor_market_validation_score * 0.10"), 1) + " ELSE vb END"},
    {"fb": W(("market_demand_score", 0.45), ("validation_evidence_score", 0.25), ("commercial_feasibility_score_used", 0.20), ("historical_fit_used", 0.10))},
    {"final_site_priority_score": R(CLAMP("fb - competition_saturation_penalty"), 1)})
extend("prio", PRIORITY, ["modeled"])


def prio(spark, sf):
    return PR.site_priority(model(spark, sf))


def _register_p(name, cols):
    @query(name, with_views("prio", f"SELECT {cols.replace('historical_fit_score', 'hf AS historical_fit_score')} FROM prio"))
    def _(spark, sf):
        return prio(spark, sf).select(*cols.split(", "))


_register_p("m14_market_demand", "zip, market_demand_score")
_register_p("m15_competition_profile", "zip, competitor_market_validation_score, competition_saturation_penalty, competition_risk_level, competitor_quality_signal")
_register_p("m16_commercial_feasibility", "zip, commercial_feasibility_score, commercial_feasibility_score_used, commercial_feasibility_status, commercial_feasibility_confirmed")
_register_p("m17_validation_evidence", "zip, validation_evidence_score, freshness_score")
_register_p("m18_historical_fit", "zip, historical_fit_score, historical_fit_used")
_register_p("m19_final_site_priority", "zip, final_site_priority_score, market_demand_score, validation_evidence_score")
_register_p("c12_places_support", "zip, places_support_score")
_register_p("c13_freshness", "zip, freshness_score")
_register_p("c14_anchor_and_community", "zip, healthcare_anchor_score, community_training_score")

_S = "'Validation-supported opportunity - needs commercial validation'"
_full = "competition_risk_level = 'saturated_unless_differentiated'"
_sureq = "commercial_feasibility_confirmed"
DECISION = f"""CASE WHEN final_site_priority_score IS NULL OR m IS NULL THEN 'Insufficient data' WHEN {_full} THEN CASE WHEN m < 55 THEN 'Saturated / low priority unless strategic'
  WHEN NOT {_sureq} THEN {_S} ELSE 'Demand proven, saturation risk high' END
 WHEN NOT {_sureq} THEN CASE WHEN m < 55 AND v >= 70 THEN 'Watchlist / monitor' WHEN m >= 65 AND v >= 70 THEN 'Strong candidate, validate commercial fit' WHEN v >= 70 THEN {_S}
  WHEN m >= 70 AND v < 55 THEN 'Needs field test' WHEN f >= 55 THEN {_S} WHEN f >= 45 THEN 'Watchlist / monitor' ELSE 'Low priority' END
 WHEN m >= 65 AND v >= 65 AND f >= 70 AND competition_risk_level IN ('low_to_moderate','competitive_but_healthy','unknown') THEN 'Ready for site screening'
 WHEN m >= 70 AND v < 55 THEN 'Needs field test' WHEN competition_risk_level = 'competitive' AND v >= 65 THEN 'Demand proven, saturation risk high'
 WHEN f >= 65 THEN 'Ready for site screening' WHEN f >= 55 THEN 'Validation-supported opportunity' WHEN f >= 45 THEN 'Watchlist / monitor' ELSE 'Low priority' END"""


@query("m20_decision_label", with_views("prio", f"SELECT zip, {DECISION} AS decision_label FROM (SELECT *, final_site_priority_score AS f, market_demand_score AS m, coalesce(validation_evidence_score, 0) AS v FROM prio)"))
def _(spark, sf):
    return prio(spark, sf).select("zip", "decision_label")


@query("c16_priority_flags", with_views("prio", f"""SELECT zip, concat_ws(',', CASE WHEN NOT {_sureq} THEN CASE commercial_feasibility_status WHEN 'unknown' THEN 'commercial_feasibility_missing' ELSE 'commercial_feasibility_partial' END END,
 CASE WHEN NOT {_sureq} THEN 'site_priority_decision_capped' END, CASE WHEN competition_risk_level IN ('competitive','saturated_unless_differentiated') THEN 'competition_saturation_risk' END,
 CASE WHEN coalesce(market_demand_score, 0) < 55 AND places_support_score >= 80 THEN 'places_signal_not_enough_without_public_demand' END,
 CASE WHEN final_site_priority_score IS NOT NULL THEN 'v21_decision_support_only' END) AS priority_flags FROM prio"""))
def _(spark, sf):
    return prio(spark, sf).select("zip", "priority_flags")


_comps = [("market_demand", "market_demand_score", 0.45), ("validation_evidence", "validation_evidence_score", 0.25), ("commercial_feasibility", "commercial_feasibility_score_used", 0.20), ("historical_fit", "historical_fit_used", 0.10)]


@query("m19_priority_breakdown", with_views("prio", " UNION ALL ".join(f"SELECT zip, '{k}' AS component, {c} AS value, CAST({w} AS DOUBLE) AS weight, {R(f'{c} * {w}', 1)} AS points FROM prio" for k, c, w in _comps)))
def _(spark, sf):
    return PR.breakdown(prio(spark, sf))


COURSE_ROWS = layer(
    "prio", {"h_aha": "coalesce(proven_aha_bls_score, " + LC("aha_bls_students", 120) + ")", "h_arcb": "coalesce(" + R("mix_arc_bls * 100", 1) + ", " + LC("arc_bls_students", 120) + ")", "h_cpr": LC("arc_cpr_students", 120)},
    {"f_aha": W(("bls_demand", 0.30), ("healthcare_anchor_score", 0.30), ("p_wc", 0.20), ("h_aha", 0.20)),
     "f_arcb": W(("bls_demand", 0.30), ("healthcare_anchor_score", 0.25), ("community_training_score", 0.15), ("p_wc", 0.15), ("h_arcb", 0.15)),
     "f_cpr": W(("cpr_demand", 0.35), ("community_training_score", 0.30), ("h_cpr", 0.20), ("healthcare_anchor_score", 0.10), ("p_wc", 0.05)),
     "f_all": W(("market_demand_score", 0.45), ("bls_demand", 0.20), ("cpr_demand", 0.20), ("hf", 0.15))})
_crow = lambda c, l, f, h: f"SELECT zip, '{c}' AS course, '{l}' AS label, {f} AS fit, {h} AS hist, coalesce(validation_evidence_score, 0) AS ev, validation_evidence_score AS vs, commercial_feasibility_score_used AS cu, {_sureq} AS sure, competition_risk_level AS risk, competition_saturation_penalty AS pen FROM cr"


@query("m21_course_priority", with_views("prio", f"""SELECT zip, course, fit AS course_fit_score, {R(CLAMP(W(("fit", 0.45), ("vs", 0.25), ("cu", 0.20), ("hist", 0.10)) + " - pen"), 1)} AS course_site_priority_score,
 CASE WHEN fit IS NULL THEN 'Insufficient data' WHEN fit >= 70 AND risk = 'saturated_unless_differentiated' THEN 'Good ' || label || ' fit, but saturated' WHEN fit >= 72 AND sure THEN 'Strong fit'
  WHEN fit >= 62 THEN 'Good fit, needs validation' WHEN fit >= 45 THEN 'Moderate fit' ELSE 'Weak fit' END AS course_fit_label,
 concat_ws('; ', CASE WHEN risk IN ('competitive','saturated_unless_differentiated') THEN 'Competition saturation' WHEN risk = 'unproven_market' THEN 'Market proof' END,
  CASE WHEN NOT sure THEN 'Commercial validation' END, CASE WHEN fit IS NULL THEN 'Course-specific data' WHEN fit < 45 THEN label || ' demand' END) AS blockers,
 CASE WHEN fit IS NULL THEN 'Insufficient data' WHEN fit < 40 THEN 'Low priority' WHEN NOT sure AND fit >= 60 AND risk = 'saturated_unless_differentiated' THEN 'Good demand, but saturated'
  WHEN NOT sure AND (fit >= 55 OR ev >= 70) THEN 'Good demand, validate commercial fit' WHEN NOT sure THEN 'Needs field test' WHEN risk = 'saturated_unless_differentiated' THEN 'Good demand, but saturated'
  WHEN fit >= 70 AND ev >= 65 THEN 'Ready for field assessment' WHEN fit >= 55 THEN 'Needs field test' ELSE 'Watchlist' END AS operator_decision,
 CASE WHEN fit IS NULL THEN 'Insufficient data' WHEN fit < 40 THEN 'Do not proceed yet' WHEN NOT sure AND ((fit >= 60 AND risk = 'saturated_unless_differentiated') OR fit >= 55 OR ev >= 70) THEN 'Needs commercial validation'
  WHEN NOT sure THEN 'Needs field test' WHEN risk = 'saturated_unless_differentiated' THEN 'High competition risk' WHEN fit >= 70 AND ev >= 65 THEN 'Ready for screening' WHEN fit >= 55 THEN 'Needs field test' ELSE 'Watchlist' END AS operator_status,
 CASE WHEN vs >= 82 THEN 'High' WHEN vs >= 65 THEN 'Medium-high' WHEN vs >= 45 THEN 'Medium' ELSE 'Low' END AS operator_confidence FROM x""", cr=COURSE_ROWS,
    x=" UNION ALL ".join([_crow("overall", "Overall", "f_all", "historical_fit_used"), _crow("aha_bls", "AHA BLS", "f_aha", "h_aha"), _crow("arc_bls", "ARC BLS", "f_arcb", "h_arcb"), _crow("arc_cpr", "ARC CPR", "f_cpr", "h_cpr")])))
def _(spark, sf):
    return PR.course_profiles(prio(spark, sf))


@query("c15_course_history", with_views("prio", "SELECT zip, h_aha AS h_aha_bls, h_arcb AS h_arc_bls, h_cpr AS h_arc_cpr FROM cr", cr=COURSE_ROWS))
def _(spark, sf):
    z = zips(spark, sf)
    return z.select("zip", *[PR.course_history(z, c).alias(f"h_{c}") for c in ("aha_bls", "arc_bls", "arc_cpr")])


@query("c17_course_blockers", with_views("prio", """SELECT blocker, count(*) AS zips FROM (SELECT CASE WHEN competition_risk_level IN ('competitive','saturated_unless_differentiated') THEN 'Competition saturation'
  WHEN competition_risk_level = 'unproven_market' THEN 'Market proof' ELSE 'none' END AS blocker FROM prio) GROUP BY 1"""))
def _(spark, sf):
    x = PR.course_profiles(prio(spark, sf)).where("course = 'overall'").select(F.explode(F.split("blockers", "; ")).alias("b"), "zip")
    firsts = x.where(C("b").isin("Competition saturation", "Market proof"))
    rest = prio(spark, sf).join(firsts.select("zip"), "zip", "left_anti").select(F.lit("none").alias("b"))
    return firsts.select("b").unionByName(rest).groupBy(C("b").alias("blocker")).agg(F.count("*").alias("zips"))
