"""Modelled opportunity per ZIP from public signals, its validation and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.functions import policy as P
from demandgrid.functions.exprs import clamp, flags, joined, known, lookup, mean_known, n, nonzero, opt, pick, ratio, renorm, rnd, scale, stages, total, zero

C = F.col


def features(geo: DataFrame, acs: DataFrame, enrichment: DataFrame | None = None) -> DataFrame:
    """ZIPs known to both sources, density from land area, enrichment on top.

    ``enrichment`` signal values replace the base value when they are known."""
    base = geo.join(acs, "zip")
    base = base.withColumn("population_density", F.when(C("land_sqmi") > 0, ratio(C("population"), C("land_sqmi"))))
    if enrichment is None:
        return base
    extra = [c for c in enrichment.columns if c != "zip"]
    e = enrichment.select("zip", *[C(c).alias(f"e_{c}") for c in extra])
    j = base.join(e, "zip", "left")
    over = {c: F.coalesce(C(f"e_{c}"), C(c)) if c in base.columns else C(f"e_{c}") for c in extra}
    return j.withColumns(over).drop(*[f"e_{c}" for c in extra])


def norm(df: DataFrame, signal: str) -> Column:
    lo, hi = P.ZIP_BOUNDS[signal]
    return scale(known(opt(df, signal)), lo, hi) / 100.0


def tilts(df: DataFrame) -> DataFrame:
    """BLS and CPR tilts (0..100), overall mean, baseline count and confidence."""
    df = stages(df, {f"n_{s}": norm(df, s) for s in P.ZIP_BOUNDS})
    tilt = lambda w: rnd(renorm([(C(f"n_{s}"), x) for s, x in w.items()]) * 100.0, 1)
    present = total([C(f"n_{s}").isNotNull().cast("int") for s in P.BASELINE_SIGNALS])
    richer = total([C(f"n_{s}").isNotNull().cast("int") for s in P.ENRICHMENT_SIGNALS])
    return stages(
        df,
        {"bls_raw": tilt(P.BLS_WEIGHTS), "cpr_raw": tilt(P.CPR_WEIGHTS), "baseline_count": present,
         "model_tier": F.when(richer > 0, "enriched").otherwise("baseline")},
        {"overall_raw": rnd(mean_known([C("bls_raw"), C("cpr_raw")]), 1),
         "confidence": pick((C("baseline_count") >= 5, "ok"), (C("baseline_count") >= 3, "partial"), default="missing")},
    )


def cap_score(x: Column, cap: float) -> Column:
    return clamp(known(x) * (100.0 / cap))


def competitor_gap(df: DataFrame) -> Column:
    k = known(opt(df, "competitor_count"))
    banded = F.when(k.isNotNull(), pick((k <= 2, 100.0), (k <= 5, 75.0), (k <= 10, 45.0), (k <= 20, 20.0), default=5.0))
    return F.coalesce(clamp(known(opt(df, "competition_gap_score"))), banded)


def commercial_readiness(df: DataFrame) -> Column:
    yes = lambda c, a, b: F.when(opt(df, c, "boolean"), a).when(~opt(df, c, "boolean"), b)
    return rnd(mean_known([
        yes("commercial_space_available", 80.0, 20.0), yes("commercial_ready", 100.0, 35.0),
        clamp(known(opt(df, "parking_score"))), clamp(known(opt(df, "parking_proxy_score"))), yes("classroom_fit", 90.0, 25.0)]), 1)


def history_proximity(df: DataFrame) -> Column:
    miles = known(opt(df, "nearest_history_miles"))
    banded = F.when(miles.isNotNull(), pick((miles <= 3, 100.0), (miles <= 8, 75.0), (miles <= 15, 45.0), default=15.0))
    return F.coalesce(clamp(known(opt(df, "historical_proximity_score"))), banded)


def validation_parts(df: DataFrame) -> dict[str, Column]:
    healthcare = F.coalesce(nonzero(opt(df, "healthcare_poi_count")), nonzero(opt(df, "medical_office_count")),
                            opt(df, "healthcare_facility_count"), opt(df, "healthcare_facility_density"))
    return {
        "v_hospital_count": cap_score(opt(df, "hospital_count"), 3), "v_urgent_care_count": cap_score(opt(df, "urgent_care_count"), 5),
        "v_nursing_school_count": cap_score(opt(df, "nursing_school_count"), 4), "v_healthcare_poi_count": cap_score(healthcare, 25),
        "v_community_facility_count": cap_score(opt(df, "community_facility_count"), 20), "v_competitor_gap": competitor_gap(df),
        "v_population_density": rnd(norm(df, "population_density") * 100.0, 1), "v_commercial_readiness": commercial_readiness(df),
        "v_historical_proximity": history_proximity(df),
    }


CORE = ["hospital_count", "urgent_care_count", "nursing_school_count", "healthcare_poi_count", "competitor_gap", "population_density"]


def validation_tier(overall: Column) -> Column:
    v = F.coalesce(C("validation_score"), F.lit(0.0))
    thin = (C("confidence") != "ok") & ((C("validation_signals") < 3) | (C("core_missing") >= 4))
    return pick(
        ((C("confidence") == "missing") | overall.isNull() | thin, "Insufficient data"),
        ((overall >= 70) & (v >= 65), "Strong opportunity"), ((overall >= 55) & (v >= 65), "Validation-supported opportunity"),
        (overall >= 55, "Promising opportunity"), ((overall >= 40) | (v >= 65), "Watchlist"), default="Low priority")


def validated(df: DataFrame) -> DataFrame:
    """Validation score over nine optional signals; a missing one lowers
    confidence, never the score."""
    df = stages(df, validation_parts(df))
    return stages(df, {
        "validation_score": rnd(renorm([(C(f"v_{k}"), w) for k, w in P.VALIDATION_WEIGHTS.items()]), 1),
        "validation_signals": total([C(f"v_{k}").isNotNull().cast("int") for k in P.VALIDATION_WEIGHTS]),
        "core_missing": total([C(f"v_{k}").isNull().cast("int") for k in CORE]),
    })


def capped(df: DataFrame) -> DataFrame:
    """Rural caps at 25 unless validation is strong; the mean is taken again."""
    d, p, h = C("population_density"), C("population"), C("healthcare_employment_share")
    # an explicit coalesce: an unknown score is not a strong one
    weak = F.coalesce(C("validation_score") < 70, F.lit(True))
    rural = F.coalesce(d < 50, F.lit(False))
    small = F.coalesce((p < 10000) & (d < 100), F.lit(False))
    thin_care = F.coalesce((h < 0.01) & (d < 100), F.lit(False))
    gate = F.coalesce((opt(df, "api_priority", "string") == "exclude") & opt(df, "api_filter_reason", "string").rlike("(?i)low.*dens|dens.*low"), F.lit(False))
    over = F.coalesce(C("overall_raw") > 25, F.lit(False)) & weak
    first = stages(df, {"cap_overall": (rural | small | gate) & over,
                        "cap_bls": thin_care & weak & F.coalesce(C("bls_raw") > 25, F.lit(False))})
    second = stages(first, {
        "bls_demand": F.when(C("cap_bls"), 25.0).otherwise(C("bls_raw")), "cpr_demand": C("cpr_raw"),
        "cap_reason": pick((C("cap_overall") & rural, "rural_low_density_cap"), (C("cap_overall") & small, "small_low_density_market_cap"),
                           (C("cap_bls"), "rural_weak_healthcare_workforce_cap"), (C("cap_overall"), "api_low_density_exclusion_cap"), default=""),
        "rural_weaknesses": joined(flags((rural, "very_low_density"), (small, "small_low_density"), (thin_care, "weak_rural_healthcare"),
                                         (gate, "api_low_density"))),
    })
    mean = F.when(C("overall_raw").isNotNull(), rnd(mean_known([C("bls_demand"), C("cpr_demand")]), 1))
    third = second.withColumn("_m", mean)
    overall = F.when(C("cap_overall"), F.least(C("_m"), F.lit(25.0))).otherwise(C("_m"))
    return stages(third, {"overall": overall, "final_cap_applied": C("cap_overall") | C("cap_bls"),
                              "validation_override_applied": ~(C("cap_overall") | C("cap_bls")) & ~weak}).drop("_m")


def modeled(df: DataFrame) -> DataFrame:
    """Tilts, validation, caps, then the tier on the capped score."""
    out = capped(validated(tilts(df)))
    return out.withColumn("validation_tier", validation_tier(C("overall")))


def signal_rows(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Long form: one row per ZIP and weighted signal with its contribution."""
    rows = F.array(*[F.struct(F.lit(s).alias("signal"), C(f"n_{s}").alias("norm"), F.lit(w).alias("weight")) for s, w in weights.items()])
    return df.select("zip", F.explode(rows).alias("r")).select(
        "zip", C("r.signal").alias("signal"), rnd(C("r.norm"), 4).alias("normalized"), C("r.weight").alias("weight"),
        rnd(F.coalesce(C("r.norm") * C("r.weight"), F.lit(0.0)), 4).alias("contribution"), C("r.norm").isNotNull().alias("present"))


def strength(norm_: Column) -> Column:
    return pick((norm_ >= 0.66, "strong"), (norm_ >= 0.33, "moderate"), default="weak")


def drivers(df: DataFrame) -> DataFrame:
    """Five strongest (>=55) and five weakest (<45) signals, as short texts."""
    rows = F.array(*[F.struct(rnd(C(f"n_{s}") * 100.0, 1).alias("v"), F.lit(s).alias("s"), strength(C(f"n_{s}")).alias("w")) for s in sorted(P.ZIP_BOUNDS)])
    seen = F.filter(rows, lambda r: r["v"].isNotNull())
    text = lambda r: F.concat_ws(":", r["s"], r["w"])
    up = F.array_sort(F.transform(F.filter(seen, lambda r: r["v"] >= 55), lambda r: F.struct((-r["v"]).alias("o"), r["s"].alias("s"), r["w"].alias("w"))))
    down = F.array_sort(F.filter(seen, lambda r: r["v"] < 45))
    return df.withColumns({
        "score_drivers": joined(F.transform(F.slice(up, 1, 5), text)), "score_weaknesses": joined(F.transform(F.slice(down, 1, 5), text))})


def risk_flags(df: DataFrame) -> Column:
    always = [(F.lit(True), f) for f in ("modeled_only", "requires_field_test", "requires_commercial_validation", "heatmap_not_boundary_exact")]
    pop, den, care = C("population"), C("population_density"), C("n_healthcare_employment_share")
    return flags(
        *always, (C("confidence") != "ok", "partial_public_data"), (F.coalesce(pop < 5000, F.lit(True)), "low_population"),
        (F.coalesce(den < 300, F.lit(True)), "low_density"), (F.coalesce(care < 0.33, F.lit(True)), "weak_healthcare_signal"),
        (C("overall").isNull(), "partial_public_data"))


def enhanced_signals(df: DataFrame) -> DataFrame:
    """POI counts to densities per square mile and a 0..100 competition gap."""
    area = F.when(C("land_sqmi") > 0, C("land_sqmi"))
    return df.withColumns({
        "healthcare_facility_density": rnd(ratio(C("healthcare_count"), area), 4), "training_school_density": rnd(ratio(C("training_count"), area), 4),
        "competition_gap_score": rnd(clamp(1.0 - F.greatest(C("competitors").cast("double"), F.lit(0.0)) / P.COMPETITION_SATURATION
                                           + C("competitors") * 0, 0, 1) * 100.0, 1)})


# --- gate before paid lookups ----------------------------------------------------

HEALTH_CAPS = {"hospital_count": 5, "urgent_care_count": 5, "ems_fire_count": 10, "healthcare_facility_count": 12, "healthcare_provider_count": 150,
               "provider_density_per_10k_pop": 50, "physician_count": 50, "nurse_count": 75, "clinic_provider_count": 25, "healthcare_facility_density": 12}
SCHOOL_CAPS = {"college_count": 5, "nursing_school_count": 3, "health_program_school_count": 5, "student_enrollment_count": 10000}
COMMUNITY_CAPS = {"childcare_count": 20, "school_count": 20, "community_facility_count": 20, "community_facility_density": 20}
BULK_FIELDS = [*HEALTH_CAPS, *SCHOOL_CAPS, *COMMUNITY_CAPS, "parking_proxy_score", "commercial_access_proxy_score"]


def _n0(df: DataFrame, name: str, lo: float, hi: float) -> Column:
    return F.coalesce(scale(known(opt(df, name)), lo, hi), F.lit(0.0))


def _best(df: DataFrame, caps: dict[str, float]) -> Column:
    return F.greatest(*[_n0(df, f, 0.0, c) for f, c in caps.items()])


def hard_exclusion(df: DataFrame) -> Column:
    """First reason that bars a ZIP from paid lookups, NULL when none does."""
    pop, den, overall = zero(C("population")), zero(C("population_density")), zero(C("overall"))
    bulk = [opt(df, f) for f in BULK_FIELDS]
    has_bulk = F.coalesce(*[b.cast("double") for b in bulk]).isNotNull()
    signal = F.greatest(*[zero(b) for b in bulk]) > 0
    return pick(
        (opt(df, "lat").isNull() | opt(df, "lng").isNull(), "missing_coordinates"), (pop <= 0, "no_population"),
        (pop < P.GATE_MIN_POPULATION, "low_population"), (den < P.GATE_MIN_DENSITY, "low_density"), (overall < P.GATE_MIN_OVERALL, "low_overall"),
        (F.lower(C("data_confidence")).isin("missing", "low", "very_low", "very low", "poor"), "low_confidence"),
        (has_bulk & ~signal, "no_bulk_signal"))


def gate(df: DataFrame) -> DataFrame:
    """Offline 0..100 score for spending lookups on a ZIP, with its class."""
    df = stages(df, {
        "gate_reason": hard_exclusion(df),
        "g_health": rnd(F.greatest(_best(df, HEALTH_CAPS), 0.8 * _n0(df, "healthcare_employment_share", 0, 0.03)), 1),
        "g_school": rnd(F.greatest(_best(df, SCHOOL_CAPS), 0.7 * _n0(df, "bachelors_or_higher_share", 0.15, 0.50)), 1),
        "g_community": rnd(F.greatest(_best(df, COMMUNITY_CAPS), _n0(df, "population_density", P.GATE_MIN_DENSITY, 5000),
                                      0.7 * _n0(df, "population", P.GATE_MIN_POPULATION, 100000)), 1),
        "g_commercial": rnd(F.greatest(
            _n0(df, "commercial_access_proxy_score", 0, 100), 0.6 * _n0(df, "population_density", P.GATE_MIN_DENSITY, 5000),
            F.when(opt(df, "commercial_validated", "boolean"), 100.0).otherwise(0.0), F.when(opt(df, "commercial_space_available", "boolean"), 80.0).otherwise(0.0)), 1),
        "g_history": rnd(F.greatest(_n0(df, "total_students", 0, 250), _n0(df, "class_count", 0, 30), _n0(df, "avg_students", 0, 15),
                                    _n0(df, "fill_rate", 40, 85), _n0(df, "demand_score", 0, 100)), 1),
    })
    score = (0.35 * _n0(df, "overall", 0, 100) + 0.20 * C("g_health") + 0.15 * C("g_school") + 0.10 * C("g_community")
             + 0.10 * C("g_commercial") + 0.10 * C("g_history"))
    df = stages(df, {"api_candidate_score": F.when(C("gate_reason").isNull(), rnd(score, 1)).otherwise(0.0)})
    s = C("api_candidate_score")
    prio = pick((C("gate_reason").isNotNull(), "exclude"), (s >= 60, "finalist"), (s >= 50, "high"), (s >= 40, "medium"), (s >= 30, "low"), default="exclude")
    return stages(df, {"api_priority": prio}).withColumn("recommended_for_live_places", C("api_priority").isin("high", "finalist"))


def gate_candidates(gated: DataFrame, limit: int, min_score: float | None = None) -> DataFrame:
    rows = gated.where(C("api_priority") != "exclude")
    if min_score is not None:
        rows = rows.where(C("api_candidate_score") >= min_score)
    return rows.orderBy(C("api_candidate_score").desc(), F.coalesce(C("overall"), F.lit(0.0)).desc(), C("zip").desc()).limit(limit)


def gate_budget(gated: DataFrame, limit: int, seconds_per_call: float = 1.0) -> DataFrame:
    """Scope, exclusions, selection and the paid calls it would take."""
    agg = gated.agg(F.count("*").alias("total"), n(C("api_priority") == "exclude").alias("excluded"), n(C("api_priority") != "exclude").alias("candidates"))
    picked = F.least(C("candidates"), F.lit(limit))
    calls = picked * P.PLACES_CALLS_PER_ZIP
    return agg.withColumns({"selected": picked, "estimated_calls": calls, "estimated_minutes": F.bround(calls * seconds_per_call / 60.0, 0).cast("bigint")})


def national_gate_reason(min_score: float, min_population: float, min_density: float = 300.0, high_demand: float = 70.0) -> Column:
    """First failing check of the enrichment scope; NULL keeps the ZIP."""
    overall, pop, den = zero(C("overall")), zero(C("population")), zero(C("population_density"))
    return pick(
        (C("lat").isNull() | C("lng").isNull(), "missing_coordinates"), (overall < min_score, "below_min_score"),
        (pop < min_population, "below_min_population"),
        (F.lower(C("data_confidence")).isin("missing", "low", "very_low", "very low", "poor", "none"), "missing_acs_fields"),
        ((den < min_density) & (overall < high_demand), "low_density"))


def merge_enrichment(rows: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Known enrichment values overwrite, sources accumulate sorted and distinct,
    and an enriched ZIP changes tier.  Both sides: zip, enrichment_sources, fields."""
    extra = [c for c in enrichment.columns if c not in ("zip", "enrichment_sources")]
    e = enrichment.select("zip", C("enrichment_sources").alias("_src"), F.lit(True).alias("_hit"), *[C(c).alias(f"_e_{c}") for c in extra])
    j = rows.join(e, "zip", "left")
    none = F.array().cast("array<string>")
    base = F.coalesce(C("enrichment_sources"), none) if "enrichment_sources" in rows.columns else none
    cols = {c: F.coalesce(C(f"_e_{c}"), C(c)) if c in rows.columns else C(f"_e_{c}") for c in extra}
    cols["enrichment_sources"] = F.array_sort(F.array_union(base, F.coalesce(C("_src"), none)))
    cols["tier"] = F.when(C("_hit"), "enriched").otherwise(C("tier") if "tier" in rows.columns else F.lit("baseline"))
    return j.withColumns(cols).drop("_src", "_hit", *[f"_e_{c}" for c in extra])


def carry_prior(rows: DataFrame, prior: DataFrame, fields: list[str]) -> DataFrame:
    """Evidence fields of an earlier enriched output onto a rebuilt base."""
    p = prior.where((C("tier") == "enriched") | opt(prior, "enrichment_tier", "string").isNotNull()).select(
        "zip", F.lit(True).alias("_was"), *[C(f).alias(f"_p_{f}") for f in fields])
    j = rows.join(p, "zip", "left")
    cols = {f: F.coalesce(C(f"_p_{f}"), C(f)) if f in rows.columns else C(f"_p_{f}") for f in fields}
    cols["tier"] = F.when(C("_was"), "enriched").otherwise(C("tier"))
    return j.withColumns(cols).drop("_was", *[f"_p_{f}" for f in fields])
