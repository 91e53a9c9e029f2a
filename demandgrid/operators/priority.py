"""Site priority: market demand, validation evidence, commercial feasibility and
history, less a competition penalty; then decisions and course views.

Each sub-score is its own column: every stage below is one Project, so nested
weighted means never repeat their inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.functions import policy as P
from demandgrid.functions.exprs import clamp, flags, joined, known, log_scale, lookup, opt, pick, renorm, rnd, scale, stages

C = F.col
COURSES = {"overall": "Overall", "aha_bls": "AHA BLS", "arc_bls": "ARC BLS", "arc_cpr": "ARC CPR"}


def first_known(df: DataFrame, *names: str) -> Column:
    return F.coalesce(*[known(opt(df, x)) for x in names])


def weighted(*parts: tuple[Column, float]) -> Column:
    """Renormalised mean, one decimal, of parts that already lie in 0..100."""
    return rnd(renorm(list(parts)), 1)


def linear(x: Column, lo: float, hi: float) -> Column:
    return rnd(scale(known(x), lo, hi), 1)


def log_count(x: Column, cap: float) -> Column:
    return rnd(log_scale(known(x), cap), 1)


# fixed values: history fit by agreement of model and history
AGREEMENT_FIT = {
    "model_agrees_high": 80.0,
    "hidden_opportunity": 75.0,
    "model_underpredicts": 70.0,
    "mixed": 55.0,
    "insufficient_history": 50.0,
    "model_overpredicts": 40.0,
    "model_agrees_low": 30.0,
}


def history_fit(df: DataFrame) -> Column:
    """Direct history score, else demand where history exists, else agreement."""
    direct = first_known(df, "historical_fit_score", "proven_demand_score", "historical_demand_score")
    had = F.lower(opt(df, "historical_status", "string")) == "has_history"
    agreement = lookup(F.lower(F.trim(opt(df, "model_agreement", "string"))), AGREEMENT_FIT)
    return F.coalesce(rnd(clamp(direct), 1), F.when(had, rnd(clamp(first_known(df, "demand_score", "overall_score", "overall")), 1)), agreement)


def _count_density(df: DataFrame, name: str, counts: list[str], density: str, cap: float, dense: float) -> list[dict[str, Column]]:
    return [{f"_{name}_c": log_count(first_known(df, *counts), cap), f"_{name}_d": linear(opt(df, density), 0, dense)},
            {f"p_{name}": weighted((C(f"_{name}_c"), 0.55), (C(f"_{name}_d"), 0.45))}]


def evidence(df: DataFrame) -> DataFrame:
    """Count-and-density scores the other parts share."""
    sets = [
        _count_density(df, "healthcare", ["healthcare_facility_count", "healthcare_poi_count", "medical_office_count"], "healthcare_facility_density", 60, 15),
        _count_density(df, "training_any", ["training_school_count", "nursing_school_count", "health_program_school_count"], "training_school_density", 45, 8),
        _count_density(df, "training", ["training_school_count", "health_program_school_count"], "training_school_density", 45, 8),
        _count_density(df, "community", ["community_facility_count"], "community_facility_density", 50, 25),
        _count_density(df, "healthcare_wide", ["healthcare_facility_count", "healthcare_poi_count", "medical_office_count", "clinic_provider_count"],
                       "healthcare_facility_density", 60, 15),
        _count_density(df, "community_wide", ["community_facility_count", "school_count", "childcare_count"], "community_facility_density", 70, 25),
    ]
    singles = {
        "_nursing": log_count(opt(df, "nursing_school_count"), 12), "_hospital": log_count(opt(df, "hospital_count"), 10),
        "_urgent": log_count(opt(df, "urgent_care_count"), 10), "_pop": linear(opt(df, "population"), 5000, 60000),
        "_den": linear(opt(df, "population_density"), 500, 10000), "_care": linear(opt(df, "healthcare_employment_share"), 0.005, 0.15),
        "_bls": clamp(first_known(df, "bls_demand", "aha_bls_score", "arc_bls_score")), "_cpr": clamp(first_known(df, "cpr_demand", "arc_cpr_score")),
        "historical_fit_score": history_fit(df),
    }
    df = stages(df, {**singles, **{k: v for s in sets for k, v in s[0].items()}}, {k: v for s in sets for k, v in s[1].items()})
    return stages(df, {
        "p_anchors": weighted((C("_hospital"), 0.55), (C("_urgent"), 0.45)), "p_size": weighted((C("_pop"), 0.5), (C("_den"), 0.5)),
        "p_workforce_care": weighted((C("_bls"), 0.75), (C("_care"), 0.25)),
        "places_support_score": weighted((C("p_healthcare"), 0.45), (C("p_training_any"), 0.45), (C("p_community"), 0.10)),
        "p_training_full": weighted((C("p_training"), 0.75), (C("_nursing"), 0.25)),
        "_work": linear(opt(df, "working_age_share"), 0.55, 0.80), "_emp": linear(opt(df, "employment_rate"), 0.50, 0.75),
        "_inc": linear(first_known(df, "median_income", "median_household_income"), 45000, 160000),
        "_edu": linear(opt(df, "bachelors_or_higher_share"), 0.15, 0.55)},
        {"p_workforce": weighted((C("_work"), 0.5), (C("_emp"), 0.5)), "p_income": weighted((C("_inc"), 0.6), (C("_edu"), 0.4)),
         "healthcare_anchor_score": weighted((C("p_healthcare_wide"), 0.55), (C("p_anchors"), 0.30), (C("_nursing"), 0.15)),
         "community_training_score": weighted((C("p_community_wide"), 0.35), (C("p_training"), 0.30), (C("p_size"), 0.35))})


def market_demand(df: DataFrame) -> DataFrame:
    return stages(df, {"market_demand_score": weighted(
        (C("p_size"), 0.20), (C("p_workforce"), 0.15), (C("p_workforce_care"), 0.20), (C("_cpr"), 0.15), (C("p_income"), 0.10),
        (C("historical_fit_score"), 0.10), (C("places_support_score"), 0.10))})


def competition(df: DataFrame) -> DataFrame:
    """Competitors prove demand up to a point, then cost points."""
    df = df.withColumns({"_k": first_known(df, "competitor_count", "competitor_count_total", "nearby_cpr_competitors_5mi"),
                         "_r": first_known(df, "avg_competitor_rating", "competitor_avg_rating")})
    k, r = C("_k"), C("_r")
    ladder = lambda *v: pick((k.isNull(), v[0]), (k <= 0, v[1]), (k <= 5, v[2]), (k <= 12, v[3]), (k < 20, v[4]), default=v[5])
    extra = F.when(k >= 13, pick((r >= 4.7, 2.0), (r < 4.0, -1.0)))
    return stages(df, {
        "competitor_market_validation_score": ladder(None, 25.0, 72.0, 86.0, 92.0, 96.0).cast("double"),
        "competition_saturation_penalty": clamp(ladder(0.0, 0.0, 2.0, 5.0, 9.0, 14.0) + F.coalesce(extra, F.lit(0.0)), 0, 18),
        "competition_risk_level": ladder("unknown", "unproven_market", "low_to_moderate", "competitive_but_healthy", "competitive",
                                         "saturated_unless_differentiated"),
        "competitor_quality_signal": linear(r, 3.5, 5.0)}).drop("_k", "_r")


def commercial(df: DataFrame) -> DataFrame:
    """Feasibility from row fields; nothing known is scored as neutral 50 when used."""
    avail, ready, room = (opt(df, c, "boolean") for c in ("commercial_space_available", "commercial_ready", "classroom_fit"))
    rent = first_known(df, "estimated_rent", "rent_avg", "monthly_rent")
    source = F.coalesce(opt(df, "rent_source", "string"), F.lit("")) != ""
    park = first_known(df, "parking_score", "parking_proxy_score")
    some = avail.isNotNull() | ready.isNotNull() | rent.isNotNull() | source | park.isNotNull() | room.isNotNull()
    start = pick((avail == F.lit(False), 25.0), (avail, 45.0), default=35.0)
    sure = F.coalesce(avail & ready, F.lit(False))
    raw = (start + F.when(rent.isNotNull(), 10.0).otherwise(0.0) + F.when(source, 5.0).otherwise(0.0)
           + F.coalesce(clamp(park * 0.15, 0, 15), F.lit(0.0)) + F.when(room, 15.0).when(~room, -5.0).otherwise(0.0))
    score = rnd(clamp(F.when(sure, F.greatest(raw, F.lit(80.0))).otherwise(raw)), 1)
    status = pick((sure, "confirmed"), (avail == F.lit(False), "unavailable"), default="partial")
    return stages(df, {"_some": some}, {
        "commercial_feasibility_score": F.when(C("_some"), score), "commercial_feasibility_confirmed": C("_some") & sure,
        "commercial_feasibility_status": F.when(C("_some"), status).otherwise("unknown")},
        {"commercial_feasibility_score_used": F.coalesce(C("commercial_feasibility_score"), F.lit(P.UNKNOWN_COMMERCIAL))}).drop("_some")


def commercial_from_summary(df: DataFrame) -> DataFrame:
    """Feasibility from the per-ZIP summary of manually checked spaces."""
    rent = F.coalesce(C("rent_avg"), C("rent_min"), C("rent_max")).isNotNull()
    park, room = F.lower(C("parking_summary")).isin("yes", "mixed"), F.lower(C("classroom_fit_summary")).isin("good", "possible")
    pts = lambda cond, v: F.when(cond, float(v)).otherwise(0.0)
    ready = 75.0 + pts(C("available_space_count") > 1, 5) + pts(rent, 5) + pts(park, 5) + pts(room, 5) + pts(F.size("commercial_sources") > 0, 3) \
        + pts(C("commercial_updated_at").isNotNull(), 2)
    partial = 40.0 + pts(C("available_space_count") > 0, 10) + pts(rent, 8) + pts(park, 8) + pts(room, 8)
    ok = F.coalesce(C("commercial_validated"), F.lit(False))
    score = F.when(ok, rnd(clamp(F.when(C("commercial_ready"), ready).otherwise(partial)), 1))
    return df.withColumns({
        "commercial_feasibility_score": score, "commercial_feasibility_score_used": F.coalesce(score, F.lit(P.UNKNOWN_COMMERCIAL)),
        "commercial_feasibility_status": pick((~ok, "unknown"), (C("commercial_ready"), "confirmed"), default="partial"),
        "commercial_feasibility_confirmed": ok & F.coalesce(C("commercial_ready"), F.lit(False))})


def freshness(df: DataFrame) -> Column:
    conf = F.lower(F.coalesce(opt(df, "data_confidence", "string"), opt(df, "confidence", "string"), F.lit("")))
    complete = pick((conf.isin("ok", "high", "complete"), 85.0), (conf.isin("partial", "medium"), 60.0), (conf.isin("missing", "low"), 30.0))
    seen = opt(df, "enrichment_updated_at", "string")
    fresh = F.when(seen.isNotNull() & (seen != ""), F.when(F.try_to_timestamp(seen).isNotNull(), 90.0).otherwise(65.0))
    return weighted((complete, 0.55), (fresh, 0.45))


def validation_evidence(df: DataFrame) -> DataFrame:
    df = df.withColumn("freshness_score", freshness(df))
    real = ["p_healthcare", "p_training_full", "p_anchors", "commercial_feasibility_score", "historical_fit_score"]
    some = F.coalesce(*[C(c) for c in real]).isNotNull()
    proof = C("competitor_market_validation_score")
    base = weighted((C("p_healthcare"), 0.25), (C("p_training_full"), 0.20), (C("p_anchors"), 0.15), (C("commercial_feasibility_score"), 0.15),
                    (C("historical_fit_score"), 0.15), (C("freshness_score"), 0.10))
    alone = weighted((proof, 0.90), (C("freshness_score"), 0.10))
    return stages(df, {"_some": some, "_base": base, "_alone": alone}, {"validation_evidence_score": pick(
        (~C("_some") & proof.isNull(), F.lit(None).cast("double")), (~C("_some"), C("_alone")),
        (proof.isNotNull() & C("_base").isNotNull(), rnd(clamp(C("_base") * 0.90 + proof * 0.10), 1)), default=C("_base"))}).drop("_some", "_base", "_alone")


def final_score(df: DataFrame) -> DataFrame:
    m, v = C("market_demand_score"), C("validation_evidence_score")
    anything = F.coalesce(*[known(opt(df, c)) for c in ("overall", "overall_score", "population", "validation_score", "healthcare_facility_count", "training_school_count")])
    blank = m.isNull() & v.isNull() & anything.isNull()
    df = df.withColumn("historical_fit_used", F.coalesce(C("historical_fit_score"), F.lit(P.UNKNOWN_HISTORY)))
    df = stages(df, {"_b": weighted((m, 0.45), (v, 0.25), (C("commercial_feasibility_score_used"), 0.20), (C("historical_fit_used"), 0.10))})
    df = stages(df, {"final_site_priority_score": F.when(~blank, rnd(clamp(C("_b") - C("competition_saturation_penalty")), 1))})
    return df.withColumn("site_priority_score_status", pick(
        (C("final_site_priority_score").isNull(), "insufficient_data"), (~C("commercial_feasibility_confirmed"), "provisional"),
        default="commercial_confirmed")).drop("_b")


def decision_label() -> Column:
    f, m, v = C("final_site_priority_score"), C("market_demand_score"), F.coalesce(C("validation_evidence_score"), F.lit(0.0))
    risk, sure = C("competition_risk_level"), C("commercial_feasibility_confirmed")
    full = risk == "saturated_unless_differentiated"
    supported = "Validation-supported opportunity - needs commercial validation"
    return pick(
        (f.isNull() | m.isNull(), "Insufficient data"),
        (full & (m < 55), "Saturated / low priority unless strategic"), (full & ~sure, supported), (full, "Demand proven, saturation risk high"),
        (~sure & (m < 55) & (v >= 70), "Watchlist / monitor"), (~sure & (m >= 65) & (v >= 70), "Strong candidate, validate commercial fit"),
        (~sure & (v >= 70), supported), (~sure & (m >= 70) & (v < 55), "Needs field test"), (~sure & (f >= 55), supported),
        (~sure & (f >= 45), "Watchlist / monitor"), (~sure, "Low priority"),
        ((m >= 65) & (v >= 65) & (f >= 70) & risk.isin("low_to_moderate", "competitive_but_healthy", "unknown"), "Ready for site screening"),
        ((m >= 70) & (v < 55), "Needs field test"), ((risk == "competitive") & (v >= 65), "Demand proven, saturation risk high"),
        (f >= 65, "Ready for site screening"), (f >= 55, "Validation-supported opportunity"), (f >= 45, "Watchlist / monitor"), default="Low priority")


def priority_flags() -> Column:
    sure, status = C("commercial_feasibility_confirmed"), C("commercial_feasibility_status")
    return flags(
        (~sure & (status == "unknown"), "commercial_feasibility_missing"), (~sure & (status != "unknown"), "commercial_feasibility_partial"),
        (~sure, "site_priority_decision_capped"), (C("competition_risk_level").isin("competitive", "saturated_unless_differentiated"), "competition_saturation_risk"),
        ((F.coalesce(C("market_demand_score"), F.lit(0.0)) < 55) & (C("places_support_score") >= 80), "places_signal_not_enough_without_public_demand"),
        (C("final_site_priority_score").isNotNull(), "v21_decision_support_only"))


def site_priority(df: DataFrame) -> DataFrame:
    """Every field of the site priority for every ZIP row."""
    out = final_score(validation_evidence(commercial(competition(market_demand(evidence(df))))))
    return out.withColumns({"decision_label": decision_label(), "priority_flags": joined(priority_flags())})


def breakdown(df: DataFrame) -> DataFrame:
    """Weighted points of the four components (long form)."""
    parts = [("market_demand", "market_demand_score", 0.45), ("validation_evidence", "validation_evidence_score", 0.25),
             ("commercial_feasibility", "commercial_feasibility_score_used", 0.20), ("historical_fit", "historical_fit_used", 0.10)]
    rows = F.array(*[F.struct(F.lit(k).alias("component"), C(c).alias("value"), F.lit(w).alias("weight"), rnd(C(c) * w, 1).alias("points")) for k, c, w in parts])
    return df.select("zip", F.explode(rows).alias("r")).select("zip", "r.*")


def course_history(df: DataFrame, course: str) -> Column:
    """Direct course score, else share of the course mix, else student count."""
    mix = opt(df, f"mix_{course}")
    return F.coalesce(rnd(clamp(first_known(df, f"proven_{course}_score", f"{course}_score")), 1), rnd(clamp(known(mix) * 100.0), 1),
                      log_count(first_known(df, f"{course}_students", f"proven_{course}_students"), 120))


def course_profiles(df: DataFrame) -> DataFrame:
    """Four course views per ZIP: fit, priority, label, blockers and status."""
    df = stages(df, {f"h_{c}": course_history(df, c) for c in COURSES if c != "overall"})
    hc, cm, wf = C("healthcare_anchor_score"), C("community_training_score"), C("p_workforce_care")
    fits = {
        "aha_bls": weighted((C("_bls"), 0.30), (hc, 0.30), (wf, 0.20), (C("h_aha_bls"), 0.20)),
        "arc_bls": weighted((C("_bls"), 0.30), (hc, 0.25), (cm, 0.15), (wf, 0.15), (C("h_arc_bls"), 0.15)),
        "arc_cpr": weighted((C("_cpr"), 0.35), (cm, 0.30), (C("h_arc_cpr"), 0.20), (hc, 0.10), (wf, 0.05)),
        "overall": weighted((C("market_demand_score"), 0.45), (C("_bls"), 0.20), (C("_cpr"), 0.20), (C("historical_fit_score"), 0.15)),
    }
    df = stages(df, {f"f_{c}": v for c, v in fits.items()})
    rows = F.array(*[F.struct(
        F.lit(c).alias("course"), C(f"f_{c}").alias("fit"),
        (C("historical_fit_used") if c == "overall" else C(f"h_{c}")).alias("hist")) for c in COURSES])
    keep = ["zip", "validation_evidence_score", "commercial_feasibility_score_used", "commercial_feasibility_confirmed", "competition_risk_level", "competition_saturation_penalty"]
    x = df.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.course", "r.fit", "r.hist")
    v = C("validation_evidence_score")
    x = stages(x, {"_b": weighted((C("fit"), 0.45), (v, 0.25), (C("commercial_feasibility_score_used"), 0.20), (C("hist"), 0.10))})
    fit, sure, risk, ev = C("fit"), C("commercial_feasibility_confirmed"), C("competition_risk_level"), F.coalesce(v, F.lit(0.0))
    full = risk == "saturated_unless_differentiated"
    label = lookup(C("course"), COURSES)
    status = pick(
        (fit.isNull(), "Insufficient data"), (fit < 40, "Low priority"), (~sure & (fit >= 60) & full, "Good demand, but saturated"),
        (~sure & ((fit >= 55) | (ev >= 70)), "Good demand, validate commercial fit"), (~sure, "Needs field test"), (full, "Good demand, but saturated"),
        ((fit >= 70) & (ev >= 65), "Ready for field assessment"), (fit >= 55, "Needs field test"), default="Watchlist")
    operator = pick(
        (fit.isNull(), "Insufficient data"), (fit < 40, "Do not proceed yet"), (~sure & (((fit >= 60) & full) | (fit >= 55) | (ev >= 70)), "Needs commercial validation"),
        (~sure, "Needs field test"), (full, "High competition risk"), ((fit >= 70) & (ev >= 65), "Ready for screening"), (fit >= 55, "Needs field test"), default="Watchlist")
    return x.select(
        "zip", "course", fit.alias("course_fit_score"), rnd(clamp(C("_b") - C("competition_saturation_penalty")), 1).alias("course_site_priority_score"),
        pick((fit.isNull(), "Insufficient data"), ((fit >= 70) & full, F.concat(F.lit("Good "), label, F.lit(" fit, but saturated"))),
             ((fit >= 72) & sure, "Strong fit"), (fit >= 62, "Good fit, needs validation"), (fit >= 45, "Moderate fit"), default="Weak fit").alias("course_fit_label"),
        joined(F.array_compact(F.array(
            pick((risk.isin("competitive", "saturated_unless_differentiated"), "Competition saturation"), (risk == "unproven_market", "Market proof")),
            F.when(~sure, "Commercial validation"),
            pick((fit.isNull(), "Course-specific data"), (fit < 45, F.concat(label, F.lit(" demand")))))), "; ").alias("blockers"),
        status.alias("operator_decision"), operator.alias("operator_status"),
        pick((v.isNull(), "Low"), (v >= 82, "High"), (v >= 65, "Medium-high"), (v >= 45, "Medium"), default="Low").alias("operator_confidence"))
