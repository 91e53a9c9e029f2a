"""Candidate points: nearby demand and competition, then the site score chain.

Places collapse to one weighted row per spot before any distance join, and
candidates to one row per coordinate; both sides then stay as small as the map,
whatever the number of records.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from demandgrid.functions import policy as P
from demandgrid.functions.exprs import (
    EARTH_MILES_GRID, clamp, flags, joined, lookup, mean_known, n, opt, pick, ratio, renorm, rnd, scale, stages, total, zero,
)
from demandgrid.operators.classes import top_per
from demandgrid.operators.geo import distance_buckets, within
from demandgrid.operators.pyramid import near_sums

C = F.col
BUCKET_MILES = [1, 3, 5, 10]

# fixed values: (category, count that saturates, weight)
DEMAND_CATEGORIES = [
    ("hospital", 10, 0.18), ("urgent_care", 10, 0.06), ("fire_station", 8, 0.12), ("ems", 6, 0.08), ("nursing_school", 8, 0.10),
    ("medical_school", 6, 0.05), ("dental_school", 4, 0.03), ("community_college", 8, 0.06), ("university", 8, 0.04),
    ("childcare_center", 25, 0.07), ("senior_care", 15, 0.06), ("gym", 25, 0.03), ("physical_therapy", 20, 0.03),
    ("dental_clinic", 30, 0.02), ("medical_clinic", 25, 0.02), ("emt_training", 4, 0.02), ("cna_training", 4, 0.02),
    ("healthcare_training", 4, 0.01),
]
TRAINING_CATEGORIES = [
    ("nursing_school", 8, 0.22), ("medical_school", 6, 0.12), ("dental_school", 4, 0.06), ("community_college", 8, 0.18),
    ("university", 8, 0.14), ("emt_training", 4, 0.10), ("cna_training", 4, 0.10), ("healthcare_training", 4, 0.08),
]
DIRECT_WORDS = [
    "cpr", "bls", "acls", "pals", "first aid", "first-aid", "life support", "basic life", "aha", "american heart", "red cross", "heartsaver",
    "cna training", "ems training", "emt training", "certification",
]
ECONOMY_PARTS = [
    ("median_household_income", 40000, 110000, 0.25), ("working_age_share", 0.55, 0.80, 0.15), ("healthcare_employment_share", 0.05, 0.20, 0.10),
    ("healthcare_employment_lq", 0.5, 1.5, 0.15), ("bachelors_or_higher_share", 0.15, 0.50, 0.15), ("employment_rate", 0.50, 0.75, 0.10),
    ("population", 5000, 200000, 0.10),
]
WEEKS_PER_MONTH, STUDENTS_PER_CLASS = 4.33, 8.0
CLASSES_PER_WEEK = {"low": 3.0, "mid": 6.0, "high": 10.0}


def spots(cands: DataFrame) -> DataFrame:
    return cands.where(C("lat").isNotNull() & C("lng").isNotNull()).select(C("lat").alias("at_lat"), C("lng").alias("at_lng")).distinct()


def nearby(cands: DataFrame, places: DataFrame, miles: float) -> DataFrame:
    """Candidate spots x place rows within a distance; places: p_lat, p_lng, ..."""
    return within(spots(cands), places, ("at_lat", "at_lng"), ("p_lat", "p_lng"), miles, miles, EARTH_MILES_GRID)


def _rings(miles: float) -> list[float]:
    return sorted({float(m) for m in BUCKET_MILES if m < miles} | {float(miles)})


def back_to(cands: DataFrame, per_spot: DataFrame) -> DataFrame:
    """Spot results for every candidate at that spot."""
    return cands.select("candidate_id", C("lat").alias("at_lat"), C("lng").alias("at_lng")).join(per_spot, ["at_lat", "at_lng"]).drop("at_lat", "at_lng")


def demand_buckets(cands: DataFrame, places: DataFrame, miles: float = 10.0) -> DataFrame:
    """Distinct places per candidate spot and category within 1/3/5/10 miles."""
    p = places.dropDuplicates(["place_id", "category"]).groupBy(C("lat").alias("p_lat"), C("lng").alias("p_lng"), "category").agg(F.count("*").alias("k"))
    rings = near_sums(spots(cands), ("at_lat", "at_lng"), p, ("p_lat", "p_lng"), ["k"], keys=["category"], radii=_rings(miles))
    return rings.groupBy("at_lat", "at_lng", "category").agg(*distance_buckets(C("distance"), BUCKET_MILES, C("k")))


def nearest_places(cands: DataFrame, places: DataFrame, miles: float, limit: int) -> DataFrame:
    """Nearest places per spot and category.  A spot can contribute at most
    ``limit`` places to any list, so the rest of its copies never join."""
    p = places.dropDuplicates(["place_id", "category"]).select(C("lat").alias("p_lat"), C("lng").alias("p_lng"), "category", "place_id")
    few = top_per(p, ["p_lat", "p_lng", "category"], [C("place_id")], limit, "_r").drop("_r")
    return top_per(nearby(cands, few, miles), ["at_lat", "at_lng", "category"], [C("distance"), C("place_id")], limit, "position")


def competition_summary(cands: DataFrame, competitors: DataFrame, miles: float = 10.0) -> DataFrame:
    """About twenty counters per candidate spot from competitor rows.

    ``competitors``: place_id, lat, lng, rating, reviews, website, phone, checked and
    boolean page findings (booking_missing, ...); all counters are sums or maxima,
    so they are taken per cell of a pyramid, and rings of cells are added."""
    r, v = C("rating"), F.coalesce(C("reviews"), F.lit(0))
    flag_cols = [c for c in competitors.columns if c.endswith(("_missing", "_offered", "_detected"))]
    direct = F.lower(F.coalesce(C("name"), F.lit(""))).rlike("|".join(DIRECT_WORDS))
    per = competitors.groupBy(C("lat").alias("p_lat"), C("lng").alias("p_lng")).agg(
        F.count("*").alias("k"), F.sum(r.cast("decimal(18,6)")).alias("s_r"), F.count(r).alias("n_r"), F.sum(v).alias("s_v"), F.max(v).alias("m_v"),
        n(r < 4.0).alias("low_rated"), n(~C("website")).alias("no_site"), n(~C("phone")).alias("no_phone"), n(C("checked")).alias("checked"),
        n(v >= 100).alias("large"), n((v >= 25) & (v < 100)).alias("medium"), n((v > 0) & (v < 25)).alias("small"), n(v == 0).alias("unknown"),
        n(direct).alias("direct"), *[n(C(c)).alias(c) for c in flag_cols])
    counters = [c for c in per.columns if c not in ("p_lat", "p_lng", "m_v")]
    near = near_sums(spots(cands), ("at_lat", "at_lng"), per, ("p_lat", "p_lng"), counters, ["m_v"], radii=_rings(miles))
    s = lambda c: F.sum(c)
    return near.groupBy("at_lat", "at_lng").agg(
        s("k").alias("competitor_count_total"), *[F.coalesce(F.sum(F.when(C("distance") <= m, C("k"))), F.lit(0)).alias(f"competitors_{m}mi") for m in BUCKET_MILES],
        rnd(F.try_divide(s("s_r").cast("double"), s("n_r")), 4).alias("competitor_avg_rating"), s("s_v").alias("competitor_total_reviews"), s("n_r").alias("competitor_with_rating"),
        s("low_rated").alias("competitor_low_rating_count"), s("no_site").alias("competitor_no_website"), s("no_phone").alias("competitor_no_phone"),
        s("checked").alias("website_checked"), s("large").alias("scale_large"), s("medium").alias("scale_medium"), s("small").alias("scale_small"),
        s("unknown").alias("scale_unknown"), F.max("m_v").alias("competitor_top_reviews"), s("direct").alias("direct_competitors"),
        *[s(c).alias(c) for c in flag_cols])


def weighted_counts(table: list[tuple[str, int, float]], prefix: str = "c_") -> Column:
    """Capped, weighted category counts as 0..100."""
    return rnd(total([F.least(F.lit(1.0), zero(C(prefix + k)) / float(cap)) * w for k, cap, w in table]) * 100.0, 2)


def category_counts(buckets: DataFrame) -> DataFrame:
    """Five-mile counts as columns, all-category totals within one and five miles."""
    cats = sorted({k for k, _, _ in DEMAND_CATEGORIES})
    known = C("category").isin(cats)
    return buckets.groupBy("at_lat", "at_lng").agg(
        *[F.coalesce(F.sum(F.when(C("category") == c, C("within_5"))), F.lit(0)).alias(f"c_{c}") for c in cats],
        F.coalesce(F.sum(F.when(known, C("within_1"))), F.lit(0)).alias("one_mile_total"), F.coalesce(F.sum(F.when(known, C("within_5"))), F.lit(0)).alias("five_mile_total"),
        n(known & (C("within_5") > 0)).alias("categories_seen"), n(known & (C("within_10") >= 20)).alias("categories_saturated"))


def demand_scores(df: DataFrame) -> DataFrame:
    return stages(df, {"demand_score": weighted_counts(DEMAND_CATEGORIES), "training_score": weighted_counts(TRAINING_CATEGORIES)})


def competition_gap(df: DataFrame) -> DataFrame:
    """sqrt(demand x room left); weak incumbents leave more room."""
    k, reviews = zero(C("competitors_5mi")), zero(C("competitor_total_reviews"))
    rating = C("competitor_avg_rating")
    weak = F.coalesce(F.when(rating < 4.0, F.least(F.lit(0.3), (4.0 - rating) * 0.3)), F.lit(0.0)) \
        + F.when((k > 0) & (F.try_divide(reviews, k) < 25), 0.1).otherwise(0.0) \
        + F.when((k > 0) & (F.try_divide(zero(C("competitor_no_website")), k) > 0.3), 0.1).otherwise(0.0)
    room = F.greatest(F.lit(0.0), F.least(F.lit(1.0), k / 6.0) - F.least(weak, F.lit(0.5)))
    return stages(df, {"_sat": room}, {
        "effective_saturation": rnd(C("_sat"), 3),
        "competition_gap_score": rnd(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), C("demand_score") / 100.0)) * (1.0 - C("_sat"))) * 100.0, 2)}).drop("_sat")


def competition_pressure(df: DataFrame) -> DataFrame:
    """Density, scale and reach of competitors, damped by their weaknesses."""
    t, rev = zero(C("competitor_count_total")), zero(C("competitor_total_reviews"))
    bands = (3.0 * zero(C("scale_large")) + 1.5 * zero(C("scale_medium")) + zero(C("scale_small"))) / 6.0
    weak = F.least(F.lit(1.0), (1.5 * zero(C("competitor_low_rating_count")) + zero(C("competitor_no_website")) + zero(C("booking_missing"))) / F.greatest(3.0 * t, F.lit(1.0)))
    norm = F.greatest(F.lit(0.0), 0.4 * F.least(F.lit(1.0), t / 6.0) + 0.4 * F.least(F.lit(1.0), bands) + 0.2 * F.least(F.lit(1.0), rev / 800.0) - 0.4 * weak)
    some = t > 0
    return stages(df, {"_p": F.when(some, norm)}, {
        "competition_pressure_score": rnd(C("_p") * 100.0, 2),
        "dominant_provider_index": F.when(some & (rev > 0), rnd(zero(C("competitor_top_reviews")) / rev, 3)),
        "estimated_market_capacity": F.when(some & (rev > 0), C("competitor_total_reviews").cast("bigint")),
        "demand_to_competition_ratio": pick((C("_p") > 0, rnd(F.least(F.lit(1.0), C("demand_score") / 100.0) / C("_p"), 3)),
                                            ((C("_p") == 0) & (C("demand_score") > 0), 9.999))}).drop("_p")


def pressure_band(score: Column) -> Column:
    return pick((score.isNull(), "Unknown"), (score < P.PRESSURE_LOW, "Low"), (score < P.PRESSURE_MEDIUM, "Medium"), (score < P.PRESSURE_EXTREME, "High"), default="Extreme")


def competition_detail(df: DataFrame) -> DataFrame:
    t = F.when(C("competitor_count_total") > 0, C("competitor_count_total"))
    share = lambda c: rnd(ratio(zero(C(c)), t), 3)
    z = lambda c: F.coalesce(C(c), F.lit(0))
    return df.withColumns({
        "band_0_1_mi": z("competitors_1mi"), "band_1_3_mi": F.greatest(F.lit(0), z("competitors_3mi") - z("competitors_1mi")),
        "band_3_5_mi": F.greatest(F.lit(0), z("competitors_5mi") - z("competitors_3mi")), "general_competitors": z("competitor_count_total") - z("direct_competitors"),
        "website_presence": rnd(1.0 - ratio(zero(C("competitor_no_website")), t), 3), "booking_friction_share": share("booking_missing"),
        "schedule_unavailable_share": share("schedule_missing"), "competition_pressure_band": pressure_band(C("competition_pressure_score"))})


def economy(df: DataFrame) -> DataFrame:
    """Seven local economy parts renormalised; nothing known is neutral 50."""
    parts = [(scale(opt(df, f), lo, hi) / 100.0, w) for f, lo, hi, w in ECONOMY_PARTS]
    used = total([F.when(opt(df, f).isNotNull(), w).otherwise(0.0) for f, _, _, w in ECONOMY_PARTS])
    return stages(df, {"economy_score": F.coalesce(rnd(renorm(parts) * 100.0, 2), F.lit(50.0)),
                       "economy_confidence": pick((rnd(used, 6) <= 0, "missing"), (rnd(used, 6) >= 0.7, "ok"), default="partial")})


def nearness(d: Column, near: float, far: float) -> Column:
    """1 up to ``near``, falling to 0 at ``far``; unknown counts 0."""
    return F.coalesce(clamp(1.0 - (d - near) / (far - near), 0, 1), F.lit(0.0))


def accessibility(df: DataFrame) -> DataFrame:
    score = (0.20 * nearness(C("d_freeway"), 0.5, 1.5) + 0.20 * nearness(C("d_transit"), 0.5, 3.0) + 0.15 * nearness(C("d_corridor"), 2.0, 8.0)
             + 0.20 * nearness(C("d_shopping"), 0.25, 1.25) + 0.10 * F.when(C("d_parking").isNotNull(), 0.75).otherwise(0.0)
             + 0.15 * F.least(F.lit(1.0), zero(C("one_mile_total")) / 25.0))
    return stages(df, {"accessibility_score": rnd(score * 100.0, 2)})


def nearest_by_kind(cands: DataFrame, places: DataFrame, reach: dict[str, float]) -> DataFrame:
    """Distance to the closest place of each kind, each within its own reach."""
    p = places.where(C("category").isin(list(reach))).select(C("lat").alias("p_lat"), C("lng").alias("p_lng"), "category").distinct()
    near = nearby(cands, p, max(reach.values()))
    ok = C("distance") <= lookup(C("category"), reach)
    return near.where(ok).groupBy("at_lat", "at_lng").agg(*[F.min(F.when(C("category") == k, C("distance"))).alias(f"d_{k}") for k in reach])


def weakness_index(df: DataFrame) -> Column:
    t = C("competitor_count_total")
    num = total([zero(C(c)) for c in ("competitor_no_website", "competitor_no_phone", "booking_missing", "schedule_missing", "pricing_missing",
                                      "friction_detected", "outdated_detected")]) + 2.0 * zero(C("competitor_low_rating_count")) + zero(opt(df, "multilingual_missing"))
    axes = 9 + (1 if "multilingual_missing" in df.columns else 0)
    return F.when(t > 0, clamp(num / (axes * t), 0, 1)).otherwise(0.0)


def opportunity(df: DataFrame) -> DataFrame:
    """Blend of demand, training, gap, weakness, white space and job demand with
    the weights that fit what is known."""
    unit = lambda c: clamp(C(c) / 100.0, 0, 1)
    growth = clamp(F.coalesce(opt(df, "working_age_share"), F.lit(0.6)), 0.2, 1.5)
    df = stages(df, {"_d": unit("demand_score"), "_t": unit("training_score"), "_g": unit("competition_gap_score"), "_w": weakness_index(df),
                     "_j": unit("job_demand_score"), "_gr": growth, "_pn": unit("competition_pressure_score")})
    room = F.greatest(F.lit(0.1), C("_pn") * (1.0 - 0.5 * C("_w")))
    white = F.when(C("_d") > 0, F.when(C("_pn").isNull(), F.least(F.lit(1.0), C("_d") * C("_gr")) * 100.0)
                   .otherwise(F.least(F.lit(1.0), C("_d") * C("_gr") / room / 2.0) * 100.0))
    df = stages(df, {"white_space_score": rnd(white, 2)})
    d, t, g, w, j, ws = C("_d"), C("_t"), C("_g"), C("_w"), C("_j"), C("white_space_score") / 100.0
    base = pick(
        (ws.isNull() & j.isNull(), 0.35 * d + 0.25 * t + 0.25 * g + 0.15 * w), (ws.isNull(), 0.30 * d + 0.20 * t + 0.25 * g + 0.15 * w + 0.10 * j),
        (j.isNull(), 0.30 * d + 0.20 * t + 0.15 * g + 0.15 * w + 0.20 * ws), default=0.25 * d + 0.15 * t + 0.15 * g + 0.15 * w + 0.10 * j + 0.20 * ws)
    return stages(df, {"opportunity_score": rnd(base * 100.0, 2), "weakness_index": rnd(w, 3)}).drop("_d", "_t", "_g", "_w", "_j", "_gr", "_pn")


# fixed values: job demand parts (columns, count that saturates, weight)
JOB_PARTS = [(["certification_postings_count"], 25, 0.30), (["bls_count"], 15, 0.16), (["cpr_count"], 15, 0.14), (["first_aid_count"], 12, 0.08),
             (["acls_count", "pals_count"], 8, 0.07), (["healthcare_role_count", "emt_role_count"], 25, 0.10),
             (["caregiver_role_count", "dental_role_count", "childcare_role_count"], 20, 0.08), (["unique_employers_count"], 10, 0.07)]


def job_demand_score() -> Column:
    """Capped weighted posting counts; unknown without postings data."""
    parts = [F.least(F.lit(1.0), total([zero(C(c)) for c in cols]) / float(cap)) * w for cols, cap, w in JOB_PARTS]
    return F.when(C("active_postings_count").isNotNull() & C("certification_postings_count").isNotNull(), rnd(total(parts) * 100.0, 2))


def profitability(df: DataFrame) -> DataFrame:
    """Students and revenue bands from utilisation and price (``avg_price``)."""
    util = 0.4 + 0.4 * clamp(C("opportunity_score") / 100.0, 0, 1) + 0.2 * clamp(C("demand_score") / 100.0, 0, 1)
    df = stages(df, {f"students_{k}": F.bround(v * WEEKS_PER_MONTH * STUDENTS_PER_CLASS * util, 0).cast("bigint") for k, v in CLASSES_PER_WEEK.items()})
    df = df.withColumns({f"revenue_{k}": rnd(C(f"students_{k}") * C("avg_price"), 2) for k in CLASSES_PER_WEEK})
    return stages(df, {"profitability_score": rnd(F.least(F.lit(1.0), C("revenue_mid") / 40000.0) * 100.0, 2)})


def lookup_price(df: DataFrame, prices: DataFrame, default: float) -> DataFrame:
    """State median with two or more samples, else the overall median, else a default.

    ``prices``: state, median_price, sample_size, overall_median (one row a state)."""
    p = prices.where((C("median_price") > 0) & (C("sample_size") >= 2)).select(F.upper(F.trim("state")).alias("_st"), C("median_price").alias("_mp"))
    overall = prices.agg(F.max(F.when(C("overall_median") > 0, C("overall_median"))).alias("o")).scalar()
    j = df.withColumn("_st", F.upper(F.trim("state"))).join(p, "_st", "left").withColumn("_ov", overall)
    return j.withColumns({"avg_price": F.coalesce(C("_mp"), C("_ov"), F.lit(float(default))),
                          "price_source": pick((C("_mp").isNotNull(), F.concat(F.lit("state:"), C("_st"))), (C("_ov").isNotNull(), "overall_median"),
                                               default="config_default")}).drop("_st", "_mp", "_ov")


# fixed values: trust by source name
SOURCE_TRUST = {"us census bureau acs": 1.0, "bls": 1.0, "google places api": 0.8, "manual rent overrides": 0.9, "public job postings csv": 0.9}


def source_trust(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    best = F.greatest(*[F.when(low.contains(k), v).otherwise(0.0) for k, v in SOURCE_TRUST.items()])
    return F.when(low.contains("stub") | low.contains("not yet integrated"), 0.0).otherwise(best)


def freshness(collected: Column, as_of: Column) -> Column:
    days = (F.unix_timestamp(as_of) - F.unix_timestamp(collected)) / 86400.0
    return pick((days.isNull(), 0.5), (days <= 30, 1.0), (days <= 365, 1.0 - 0.6 * ((days - 30) / 335.0)), default=0.2)


def source_quality(sources: DataFrame, as_of: Column) -> DataFrame:
    """Per candidate: trust x freshness, mean freshness and distinct credible names."""
    s = sources.select("candidate_id", "name", source_trust(C("name")).alias("t"), freshness(C("collected_at"), as_of).alias("f")).where(C("t") > 0)
    return s.groupBy("candidate_id").agg(F.avg(C("t") * C("f")).alias("quality"), F.avg("f").alias("fresh"), F.countDistinct("name").alias("credible"))


def confidence(df: DataFrame) -> DataFrame:
    """Data confidence and its dimensions.  Expects quality, fresh, credible,
    missing_fields and the profile counters."""
    raw = F.greatest(F.lit(0.0), 0.6 * zero(C("quality")) + 0.4 * F.least(F.lit(1.0), zero(C("credible")) / 4.0) - F.least(F.lit(0.5), 0.04 * zero(C("missing_fields"))))
    cats = float(len(DEMAND_CATEGORIES))
    pct = lambda c: rnd(c * 100.0, 2)
    comp = F.when(F.coalesce(C("competitor_count_total"), F.lit(0)) <= 0, 0.5).otherwise(F.least(F.lit(1.0), ratio(C("website_checked"), C("competitor_count_total"))))
    known = total([C(c).isNotNull().cast("int") for c in ("d_freeway", "d_transit", "d_corridor", "d_shopping", "d_parking")])
    return stages(df, {
        "confidence_score": rnd(raw * 100.0, 2), "dim_accessibility": pct(known / 5.0), "dim_competition": pct(comp),
        "dim_rent": pct(F.when(C("rent_per_sqft_annual").isNotNull(), 1.0).otherwise(0.0)), "dim_demand": pct(F.least(F.lit(1.0), zero(C("categories_seen")) / cats * 1.5)),
        "dim_freshness": pct(zero(C("fresh"))), "dim_saturation": pct(F.when(C("categories_seen") > 0, F.greatest(F.lit(0.0), 1.0 - F.least(
            F.lit(1.0), C("categories_saturated") / C("categories_seen")))).otherwise(0.0)),
        "dim_demographic": pct(total([opt(df, f).isNotNull().cast("int") for f, *_ in ECONOMY_PARTS]) / float(len(ECONOMY_PARTS)))})


SUB_SCORES = {"demand_score": 0.23, "training_score": 0.18, "competition_gap_score": 0.15, "opportunity_score": 0.13, "economy_score": 0.09,
              "accessibility_score": 0.10, "historical_score": 0.08, "profitability_score": 0.04}


def area_score(df: DataFrame) -> DataFrame:
    """Area score over eight sub-scores (history neutral when unknown)."""
    df = df.withColumn("historical_score", F.coalesce(clamp(opt(df, "history_score")), F.lit(50.0)))
    return stages(df, {"area_score": rnd(total([C(k) * w for k, w in SUB_SCORES.items()]), 2)})


def parking_score(notes: Column) -> Column:
    t = F.lower(notes)
    most = F.array_max(F.transform(F.regexp_extract_all(t, F.lit(r"\b(\d{1,3})\b"), 1), lambda x: x.cast("int")))
    good = 55.0 + F.when(t.rlike("dedicated|reserved"), 20.0).otherwise(0.0) + F.when(t.rlike("lot|garage|spaces"), 15.0).otherwise(0.0) \
        + F.when(F.coalesce(most, F.lit(0)) >= 10, 10.0).otherwise(0.0)
    return F.when(F.coalesce(notes, F.lit("")) != "", F.when(t.rlike("no parking|street only|no dedicated"), 30.0).otherwise(F.least(F.lit(100.0), good)))


def visibility_score(notes: Column) -> Column:
    t = F.lower(notes)
    up = F.when(t.rlike("ground floor|ground-floor|street-facing|corner|high visibility|signage"), 25.0).otherwise(0.0)
    down = F.when(t.rlike("second floor|rear|back of|basement|low visibility|no signage"), 25.0).otherwise(0.0)
    return F.when(F.coalesce(notes, F.lit("")) != "", clamp(50.0 + up - down))


def rent_affordability(rent: Column) -> Column:
    return rnd(clamp((72.0 - rent) / 54.0, 0, 1) * 100.0, 2)


def classroom_fit(sqft: Column) -> Column:
    r = sqft / P.SQFT_PER_STUDENT / float(P.CLASSROOM_TARGET)
    return F.when(sqft > 0, rnd(F.least(F.lit(100.0), F.when(r < 1.0, r * 100.0).otherwise(90.0 + r * 5.0)), 2))


def candidate_type() -> Column:
    return pick((~F.coalesce(C("viable"), F.lit(True)), "invalid_or_low_confidence"), (F.coalesce(C("validated"), F.lit(False)), "verified_commercial_listing"),
                (F.coalesce(C("commercial_anchor"), F.lit(False)), "commercial_area_proxy"), default="landmark_proxy")


def demand_level(notes: Column) -> Column:
    t = F.lower(F.coalesce(notes, F.lit("")))
    return pick((t.rlike("enrollment|confirmed"), "confirmed"), (t.rlike("ads test|landing test|tested"), "tested"), default="proxy")


def feasibility(df: DataFrame) -> DataFrame:
    """Site-level scores from a matched listing, break-even and risk points."""
    has = F.coalesce(C("has_override"), F.lit(False))
    notes = F.concat_ws(" ", F.coalesce(C("broker_notes"), F.lit("")), F.coalesce(C("parking_notes"), F.lit("")))
    df = stages(df, {
        "rent_fit": F.when(has, rent_affordability(C("asking_rent"))), "parking_fit": F.when(has, parking_score(C("parking_notes"))),
        "classroom_fit_score": F.when(has, classroom_fit(C("square_feet"))), "visibility_fit": F.when(has & (F.trim(notes) != ""), visibility_score(notes))})
    parts = [C(c) for c in ("rent_fit", "parking_fit", "classroom_fit_score", "accessibility_score", "visibility_fit")]
    points = F.when(C("competition_pressure_score") >= 60, 1).otherwise(0) + (C("confidence_score") < 50).cast("int") + (C("area_score") < 50).cast("int") \
        + (~F.coalesce(C("validated"), F.lit(False))).cast("int")
    margin = C("avg_price") - P.VARIABLE_COST
    return stages(df, {
        "lease_readiness_score": F.when(has, rnd(mean_known(parts), 2)),
        "breakeven_students": F.when(margin > 0, F.ceil(F.lit((P.FIXED_COST_LOW + P.FIXED_COST_HIGH) / 2) / margin).cast("bigint")),
        "risk_level": pick((points >= 3, "High"), (points >= 1, "Medium"), default="Low"),
        "data_basis": pick((has & C("validated"), "validated_override"), (has, "proxy"), default="none"), "candidate_type": candidate_type()})


def tiers(df: DataFrame) -> DataFrame:
    """Gated site score, final score with ZIP effects, tier with caps, executive state."""
    a, sure = C("area_score"), C("candidate_type") == "verified_commercial_listing"
    level = pick((a < 30, 0), (a < 50, 1), (a < 65, 2), (a < 80, 3), default=4)
    crowded = (C("effective_saturation") >= 0.9) & (C("competition_gap_score") < 25)
    capped = F.least(level, F.when((C("confidence_score") < 30) | crowded, 2).otherwise(4), F.when(~sure, 3).otherwise(4))
    return df.withColumns({
        "site_score": F.when(sure & C("lease_readiness_score").isNotNull(), rnd(0.5 * a + 0.5 * C("lease_readiness_score"), 2)),
        "final_score": rnd(clamp(a + clamp(zero(opt(df, "zip_adjustment")), -5, 5)), 2),
        "confidence_adjusted": rnd(clamp(C("confidence_score") + clamp(zero(opt(df, "zip_confidence_modifier")), -10, 10)), 2),
        "tier": F.element_at(F.array(*[F.lit(x) for x in "FDCBA"]), capped + 1),
        "executive_state": pick((sure, "Lease-ready candidate"), ((C("candidate_type") == "invalid_or_low_confidence") | (a < 45), "Not recommended"),
                                ((C("candidate_type") == "commercial_area_proxy") & (a >= 55), "Recommended for listing search"), default="Recommended for field validation")})


def rent_pressure(df: DataFrame) -> Column:
    """Relative rent pressure 0..100 from income, density, competition and corridor."""
    b = P.RENT_BOUNDS
    return F.coalesce(rnd(renorm([
        (scale(opt(df, "median_household_income"), *b["income"]) / 100.0, 0.40), (scale(C("five_mile_total"), *b["density"]) / 100.0, 0.25),
        (scale(C("competitor_count_total"), *b["competition"]) / 100.0, 0.20), (clamp((b["corridor_miles"] - C("d_corridor")) / b["corridor_miles"], 0, 1), 0.15)]) * 100.0, 2),
        F.lit(50.0))


def rent_estimates(df: DataFrame, cohort: str) -> DataFrame:
    """Dollar rents from the cohort's cited rents: none -> unknown, one -> in
    proportion, more -> least squares.  The line comes from a grouped aggregate
    joined back, so a cohort never has to sit in one task."""
    i, r = C("rent_pressure_index"), C("rent_per_sqft_annual")
    cited = df.where(r.isNotNull()).groupBy(cohort).agg(
        F.count("*").alias("_n"), F.avg(i).alias("_mx"), F.avg(r).alias("_my"), F.var_pop(i).alias("_vx"), F.covar_pop(i, r).alias("_cxy"))
    j = df.join(cited, cohort, "left")
    spread = C("_n") * C("_n") * C("_vx")  # central moments: exact far from zero too
    one = F.when(C("_mx") <= 0, C("_my")).otherwise(C("_my") * i / C("_mx"))
    many = F.when(F.abs(spread) < 1e-9, C("_my")).otherwise(F.greatest(F.lit(0.0), C("_my") + F.try_divide(C("_cxy"), C("_vx")) * (i - C("_mx"))))
    est = F.when(C("_n") == 1, one).when(C("_n") > 1, many)
    return j.withColumns({"estimated_rent_per_sqft": rnd(est, 2), "anchor_count": F.coalesce(C("_n"), F.lit(0)),
                          "rent_confidence": F.when(est.isNotNull(), "estimated_anchored").otherwise("estimated")}).drop("_n", "_mx", "_my", "_vx", "_cxy")


# --- cohort ------------------------------------------------------------------------

NORMALIZED = ["demand_score", "training_score", "competition_gap_score", "opportunity_score"]


def cohort_stats(df: DataFrame, cohort: str, cols: list[str]) -> DataFrame:
    """Mean and population deviation per cohort, as a join side (a window would
    gather a hot cohort in one task)."""
    return df.groupBy(cohort).agg(F.count("*").alias("_size"), *[f for c in cols for f in (
        F.avg(c).alias(f"_mu_{c}"), F.stddev_pop(c).alias(f"_sd_{c}"), F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"))])


def cohort_blend(df: DataFrame, cohort: str, blend: float = P.COHORT_BLEND) -> DataFrame:
    """Half absolute, half sigmoid of the cohort z-score; no spread changes nothing."""
    j = df.join(cohort_stats(df, cohort, NORMALIZED), cohort)
    new = {}
    for c in NORMALIZED:
        z = (C(c) - C(f"_mu_{c}")) / C(f"_sd_{c}")
        mixed = clamp((1.0 - blend) * C(c) + blend * 100.0 / (1.0 + F.exp(-z)))
        new[f"n_{c}"] = F.when((C(f"_sd_{c}") < 1e-6) | (C("_size") < 2), C(c)).otherwise(rnd(mixed, 2))
    j = stages(j, new)
    score = total([F.coalesce(C(f"n_{k}") if k in NORMALIZED else C(k), F.lit(0.0)) * w for k, w in SUB_SCORES.items()])
    return j.withColumn("cohort_area_score", F.when(C("_size") < 2, C("area_score")).otherwise(rnd(score, 2))).drop(*[c for c in j.columns if c.startswith(("_mu_", "_sd_", "_lo_", "_hi_"))])


def score_deltas(df: DataFrame, cohort: str, score: str) -> DataFrame:
    """Distance to the cohort mean with a label (a flat cohort is all 'around')."""
    s = df.groupBy(cohort).agg(F.avg(score).alias("_mu"), (F.max(score) - F.min(score)).alias("_spread"))
    j = df.join(s, cohort).withColumn("score_delta", rnd(C(score) - C("_mu"), 2))
    d = C("score_delta")
    label = pick(((C("_spread") < 1.0) | (F.abs(d) < 1.0), "Around cohort mean"), (d >= 3.0, "Well above cohort mean"), (d >= 1.0, "Above cohort mean"),
                 (d <= -3.0, "Well below cohort mean"), default="Below cohort mean")
    return j.withColumns({"score_delta_label": label, "cohort_mean": rnd(C("_mu"), 2)}).drop("_mu", "_spread")


def factor_decomposition(df: DataFrame, cohort: str) -> DataFrame:
    """What lifts or lowers each candidate against its cohort (long form, ranked)."""
    means = df.groupBy(cohort).agg(*[F.avg(c).alias(f"_m_{c}") for c in SUB_SCORES])
    j = df.join(means, cohort)
    rows = F.array(*[F.struct(
        F.lit(c).alias("sub_score"), rnd(C(c), 2).alias("value"), rnd(C(f"_m_{c}"), 2).alias("cohort_mean"), rnd(C(c) - C(f"_m_{c}"), 2).alias("delta"),
        rnd((C(c) - C(f"_m_{c}")) * w, 3).alias("contribution")) for c, w in SUB_SCORES.items()])
    known = F.filter(rows, lambda r: r["value"].isNotNull())
    ordered = F.array_sort(F.transform(known, lambda r: F.struct((-F.abs(r["contribution"])).alias("o"), r["sub_score"].alias("k"), r.alias("r"))))
    return j.select("candidate_id", F.posexplode(ordered).alias("pos", "s")).select("candidate_id", (C("pos") + 1).alias("position"), "s.r.*")


def cohort_differentiation(df: DataFrame, cohort: str, score: str) -> DataFrame:
    s = df.groupBy(cohort).agg(F.avg(score).alias("mu"), F.stddev_pop(score).alias("sd"), F.count(score).alias("k"))
    cv = F.when(C("mu") > 0, C("sd") / C("mu")).otherwise(0.0)
    return s.select(cohort, rnd(F.when(C("k") >= 2, clamp((cv - 0.02) / 0.08, 0, 1)).otherwise(1.0) * 100.0, 2).alias("differentiation"))


def catchment_overlap(nearest5: DataFrame, cands: DataFrame, most: int = 5) -> DataFrame:
    """Mean Jaccard of each candidate's nearest-competitor set with all others.

    ``nearest5``: candidate_id, place_id (at most ``most`` rows a candidate); sets
    without anything in common count as zero in the mean.

    No two sets ever meet.  Every subset of a set (at most 2**most) is counted over all
    sets by their size.  The counts of a set's subsets of j competitors add up to the
    sum of C(k, j) over all others with k in common, so inclusion and exclusion gives how
    many have exactly k, and with the sizes their Jaccards.  A competitor that nearly
    all sets hold is one more counted subset, and costs what any other does."""
    sets = nearest5.groupBy("candidate_id").agg(F.array_sort(F.collect_set("place_id")).alias("ids"))
    m = sets.agg(F.count("*").alias("m")).scalar()
    kinds = sets.groupBy("ids").agg(F.count("*").alias("w"))
    chosen = lambda mask: F.filter("ids", lambda x, i: F.floor(mask / F.pow(F.lit(2.0), i)) % 2 == 1)
    subsets = F.transform(F.sequence(F.lit(1), F.pow(F.lit(2.0), F.size("ids")).cast("int") - 1), chosen)
    rows = kinds.select("ids", "w", F.size("ids").alias("n"), F.explode(subsets).alias("sub"))
    counts = rows.groupBy("sub", C("n").alias("n2")).agg(F.sum("w").alias("c"))
    a = rows.select("ids", "n", "sub").join(counts, "sub").groupBy("ids", "n", "n2").agg(
        *[F.sum(F.when(F.size("sub") == j, C("c")).otherwise(0)).alias(f"_a{j}") for j in range(1, most + 1)])
    parts = []
    for k in range(1, most + 1):
        exactly = total([(-1) ** (j - k) * math.comb(j, k) * C(f"_a{j}") for j in range(k, most + 1)])
        parts.append(F.when(exactly > 0, exactly * k / (C("n") + C("n2") - k)).otherwise(0.0))
    # a set is in its own counts, with Jaccard 1
    per = a.groupBy("ids").agg((F.sum(total(parts)) - 1.0).alias("s"))
    mine = sets.join(per, "ids").select("candidate_id", "s").withColumn("_m", m)
    mean = F.try_divide(C("s"), C("_m") - 1)
    out = cands.select("candidate_id").join(mine, "candidate_id", "left")
    return out.select("candidate_id", rnd(F.coalesce(clamp(1.0 - mean / 0.6, 0, 1), F.lit(1.0)) * 100.0, 2).alias("catchment_overlap"))


def city_rankings(df: DataFrame, area: str, score: str) -> DataFrame:
    """Best, mean of the best three and count per area, ranked over all areas."""
    top = top_per(df, [area], [C(score).desc(), C("candidate_id")], 3)
    agg = top.groupBy(area).agg(F.max(score).alias("best_score"), rnd(F.avg(score), 2).alias("avg_top_score"), F.min_by("candidate_id", "rn").alias("best_candidate"))
    sizes = df.groupBy(area).agg(F.count("*").alias("candidate_count"))
    return agg.join(sizes, area)


def capability_gaps(df: DataFrame) -> DataFrame:
    """Share of checked competitors lacking each capability (long form)."""
    kinds = ["booking", "schedule", "pricing", "acls_pals", "weekend", "group_corporate", "multilingual"]
    k = F.coalesce(C("website_checked"), F.lit(0))

    def offered(x: str) -> Column:
        return zero(C(f"{x}_offered")).cast("bigint") if f"{x}_offered" in df.columns else F.greatest(F.lit(0).cast("bigint"), k - zero(C(f"{x}_missing")).cast("bigint"))

    rows = F.array(*[F.struct(F.lit(x).alias("gap"), zero(C(f"{x}_missing")).cast("bigint").alias("missing"), offered(x).alias("offered")) for x in kinds],
                   F.struct(F.lit("outdated_website").alias("gap"), zero(C("outdated_detected")).cast("bigint").alias("missing"), F.lit(0).cast("bigint").alias("offered")))
    x = df.select("candidate_id", k.alias("checked"), C("competitor_count_total").alias("t"), F.explode(rows).alias("g")).select("candidate_id", "checked", "t", "g.*")
    share = F.when(C("checked") > 0, C("missing") / C("checked")).otherwise(0.0)
    x = x.withColumn("s", share)
    r = ratio(C("checked"), C("t"))
    return x.select("candidate_id", "gap", "missing", "offered", "checked", rnd(C("s"), 3).alias("share_missing"),
                    pick((C("s") >= 0.6, "strong"), (C("s") >= 0.35, "moderate"), (C("s") > 0, "weak"), default="none").alias("strength"),
                    pick(((C("checked") > 0) & (r >= 0.6), "high"), ((C("checked") > 0) & (r >= 0.3), "medium"), default="low").alias("confidence"))
