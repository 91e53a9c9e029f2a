"""Registered queries over candidate points, nearby places and competitors."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandgrid.functions.exprs import rnd
from demandgrid.operators import candidates as K
from demandgrid.operators.classes import top_per
from demandgrid.operators.ranks import global_rank
from demandgrid.plans import views as V
from demandgrid.plans.q_modeled import layer
from demandgrid.plans.registry import query
from demandgrid.plans.sql import CLAMP, HAV, R, RENORM, SCALE, extend, with_views
from demandgrid.plans.zip_table import derived_columns, derived_sql

C = F.col

CATS = [k for k, _, _ in K.DEMAND_CATEGORIES] + ["freeway", "transit", "corridor", "shopping", "parking", "other"]
NUMBERS = {
    "median_household_income": (40000, 1543, 120000, 1, 7), "working_age_share": (55, 1, 26, 100, 9), "employment_rate": (50, 3, 26, 100, 11),
    "healthcare_employment_share": (5, 1, 21, 100, 5), "healthcare_employment_lq": (5, 7, 12, 10, 4), "bachelors_or_higher_share": (15, 7, 40, 100, 6),
    "population": (5000, 977, 190000, 1, 8), "rent_per_sqft_annual": (18, 13, 60, 1, 2), "asking_rent": (18, 17, 60, 1, 3), "square_feet": (0, 131, 1500, 1, 4),
    "history_score": (0, 37, 101, 1, 3), "zip_adjustment": (-5, 3, 11, 1, 4), "zip_confidence_modifier": (-10, 7, 21, 1, 5),
    "active_postings_count": (0, 11, 40, 1, 6), "certification_postings_count": (0, 13, 30, 1, 6), "bls_count": (0, 7, 17, 1, 6), "cpr_count": (0, 5, 19, 1, 4),
    "first_aid_count": (0, 3, 14, 1, 5), "acls_count": (0, 7, 6, 1, 4), "pals_count": (0, 11, 5, 1, 3), "healthcare_role_count": (0, 17, 20, 1, 4),
    "emt_role_count": (0, 19, 9, 1, 3), "caregiver_role_count": (0, 23, 8, 1, 4), "dental_role_count": (0, 29, 9, 1, 5), "childcare_role_count": (0, 31, 8, 1, 3),
    "unique_employers_count": (0, 37, 13, 1, 4),
}
LABELS = {
    "parking_notes": [None, "Dedicated lot with 40 spaces", "street only", "garage nearby", ""],
    "broker_notes": [None, "Ground floor corner unit, ads test done", "rear basement unit", "enrollment confirmed by tenant"],
    "state": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "NOWHERE", None],
    "cohort": ["north", "south", "east"],
}
BOOLS = {"viable": [True, True, True, False, None], "validated": [None, True, False], "commercial_anchor": [True, False, None, True],
         "has_override": [True, False, True, None]}

extend("v_candw", f"SELECT point_id AS candidate_id, lat, lng, {derived_sql(NUMBERS, LABELS, BOOLS)} FROM (SELECT *, point_id AS k FROM v_point)", ["v_point"])
extend("v_place", "SELECT place_id, lat, lng, CASE place_id % 24 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATS)) + " END AS category FROM v_poi", ["v_poi"])
FLAGS = {"booking_missing": 5, "schedule_missing": 7, "pricing_missing": 3, "acls_pals_missing": 11, "acls_pals_offered": 13, "weekend_missing": 6, "weekend_offered": 17,
         "group_corporate_missing": 19, "group_corporate_offered": 23, "multilingual_missing": 10, "multilingual_offered": 29, "friction_detected": 31, "outdated_detected": 14}
extend("v_comp", "SELECT place_id, name, lat, lng, rating, review_count AS reviews, place_id % 4 > 0 AS website, place_id % 6 > 0 AS phone, place_id % 3 > 0 AS checked, "
       + ", ".join(f"place_id % {m} = 0 AS {f}" for f, m in FLAGS.items()) + " FROM v_poi WHERE kind IN ('CPR training', 'nursing school')", ["v_poi"])


def cands(spark, sf):
    p = V.points(spark, sf)
    return p.select(C("point_id").alias("candidate_id"), "lat", "lng", *[v.alias(n) for n, v in derived_columns(C("point_id"), NUMBERS, LABELS, BOOLS).items()])


def places(spark, sf):
    names = F.array(*[F.lit(c) for c in CATS])
    return V.pois(spark, sf).select("place_id", "lat", "lng", F.element_at(names, (C("place_id") % 24 + 1).cast("int")).alias("category"))


def competitors(spark, sf):
    k = C("place_id")
    return V.pois(spark, sf).where(C("kind").isin("CPR training", "nursing school")).select(
        "place_id", "name", "lat", "lng", "rating", C("review_count").alias("reviews"), (k % 4 > 0).alias("website"), (k % 6 > 0).alias("phone"), (k % 3 > 0).alias("checked"),
        *[(k % m == 0).alias(f) for f, m in FLAGS.items()])


D = HAV("c.lat", "c.lng", "p.lat", "p.lng", 3958.7613)
DEM = [k for k, _, _ in K.DEMAND_CATEGORIES]
_dem = "(" + ", ".join(f"'{c}'" for c in DEM) + ")"
CHAIN = {
    "pairs": f"SELECT * FROM (SELECT c.candidate_id, p.place_id, p.category, {D} AS d FROM v_candw c CROSS JOIN v_place p WHERE c.lat IS NOT NULL) WHERE d <= 10",
    "bk": "SELECT candidate_id, category, count(CASE WHEN d <= 1 THEN 1 END) AS within_1, count(CASE WHEN d <= 3 THEN 1 END) AS within_3, count(CASE WHEN d <= 5 THEN 1 END) AS within_5, count(*) AS within_10 FROM pairs GROUP BY 1, 2",
    "cnt": "SELECT candidate_id, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN category = '{c}' THEN within_5 END), 0) AS BIGINT) AS c_{c}" for c in DEM)
           + f", coalesce(sum(CASE WHEN category IN {_dem} THEN within_1 END), 0) AS one_mile_total, coalesce(sum(CASE WHEN category IN {_dem} THEN within_5 END), 0) AS five_mile_total"
           + f", count(CASE WHEN category IN {_dem} AND within_5 > 0 THEN 1 END) AS categories_seen, count(CASE WHEN category IN {_dem} AND within_10 >= 20 THEN 1 END) AS categories_saturated FROM bk GROUP BY 1",
    "cpairs": f"SELECT * FROM (SELECT c.candidate_id, p.*, {D} AS d FROM v_candw c CROSS JOIN v_comp p WHERE c.lat IS NOT NULL) WHERE d <= 10",
    "comp": "SELECT candidate_id, count(*) AS competitor_count_total, " + ", ".join(f"count(CASE WHEN d <= {m} THEN 1 END) AS competitors_{m}mi" for m in (1, 3, 5, 10))
            + f", {R('avg(rating)', 4)} AS competitor_avg_rating, CAST(sum(reviews) AS BIGINT) AS competitor_total_reviews, count(rating) AS competitor_with_rating, count(CASE WHEN rating < 4 THEN 1 END) AS competitor_low_rating_count,"
            + " count(CASE WHEN NOT website THEN 1 END) AS competitor_no_website, count(CASE WHEN NOT phone THEN 1 END) AS competitor_no_phone, count(CASE WHEN checked THEN 1 END) AS website_checked,"
            + " count(CASE WHEN reviews >= 100 THEN 1 END) AS scale_large, count(CASE WHEN reviews BETWEEN 25 AND 99 THEN 1 END) AS scale_medium, count(CASE WHEN reviews BETWEEN 1 AND 24 THEN 1 END) AS scale_small,"
            + " count(CASE WHEN reviews = 0 THEN 1 END) AS scale_unknown, max(reviews) AS competitor_top_reviews, count(CASE WHEN regexp_matches(lower(name), 'cpr|bls|acls|pals|first aid|first-aid|life support|aha|american heart|red cross|heartsaver|cna training|ems training|emt training|certification') THEN 1 END) AS direct_competitors, "
            + ", ".join(f"count(CASE WHEN {f} THEN 1 END) AS {f}" for f in FLAGS) + " FROM cpairs GROUP BY 1",
    "acc": "SELECT candidate_id, " + ", ".join(f"min(CASE WHEN category = '{k}' AND d <= {m} THEN d END) AS d_{k}" for k, m in
                                               {"freeway": 1.5, "transit": 3.0, "corridor": 8.0, "shopping": 1.25, "parking": 0.5}.items()) + " FROM pairs GROUP BY 1",
}
REACH = {"freeway": 1.5, "transit": 3.0, "corridor": 8.0, "shopping": 1.25, "parking": 0.5}


def ctes(*names):
    return {n: CHAIN[n] for n in names}


def at(df):
    return df.withColumnsRenamed({"at_lat": "lat", "at_lng": "lng"})


def counts(spark, sf):
    return K.category_counts(K.demand_buckets(cands(spark, sf), places(spark, sf)))


def with_demand(spark, sf):
    return K.demand_scores(cands(spark, sf).join(at(counts(spark, sf)), ["lat", "lng"], "left"))


def with_competition(spark, sf):
    c = cands(spark, sf)
    comp = at(K.competition_summary(c, competitors(spark, sf)))
    return K.competition_pressure(K.competition_gap(with_demand(spark, sf).join(comp, ["lat", "lng"], "left")))


_m22 = lambda t: R("(" + " + ".join(f"least(1.0, coalesce(c_{k}, 0) / {float(cap)}) * {w}" for k, cap, w in t) + ") * 100", 2)
S_DEMAND = {"demand_score": _m22(K.DEMAND_CATEGORIES), "training_score": _m22(K.TRAINING_CATEGORIES)}
_z = lambda c: f"coalesce({c}, 0)"
S_GAP1 = {"sat": f"""greatest(0.0, least(1.0, {_z('competitors_5mi')} / 6.0) - least(0.5, CASE WHEN competitor_avg_rating < 4 THEN least(0.3, (4 - competitor_avg_rating) * 0.3) ELSE 0 END
 + CASE WHEN competitors_5mi > 0 AND competitor_total_reviews / competitors_5mi < 25 THEN 0.1 ELSE 0 END + CASE WHEN competitors_5mi > 0 AND competitor_no_website / competitors_5mi > 0.3 THEN 0.1 ELSE 0 END))""",
          "pn": f"""CASE WHEN competitor_count_total > 0 THEN greatest(0.0, 0.4 * least(1.0, competitor_count_total / 6.0) + 0.4 * least(1.0, (3.0 * scale_large + 1.5 * scale_medium + scale_small) / 6.0)
 + 0.2 * least(1.0, competitor_total_reviews / 800.0) - 0.4 * least(1.0, (1.5 * competitor_low_rating_count + competitor_no_website + booking_missing) / (3.0 * competitor_count_total))) END"""}
S_GAP2 = {"effective_saturation": R("sat", 3), "competition_gap_score": R("sqrt(least(1.0, demand_score / 100) * (1 - sat)) * 100", 2), "competition_pressure_score": R("pn * 100", 2),
          "dominant_provider_index": R("CASE WHEN competitor_total_reviews > 0 THEN competitor_top_reviews / competitor_total_reviews END", 3),
          "estimated_market_capacity": "CASE WHEN competitor_total_reviews > 0 THEN competitor_total_reviews END",
          "demand_to_competition_ratio": "CASE WHEN pn > 0 THEN " + R("least(1.0, demand_score / 100) / pn", 3) + " WHEN pn = 0 AND demand_score > 0 THEN 9.999 END::DOUBLE"}
_BASE = "SELECT w.*, n.* EXCLUDE candidate_id, m.* EXCLUDE candidate_id FROM v_candw w LEFT JOIN cnt n ON w.candidate_id = n.candidate_id LEFT JOIN comp m ON w.candidate_id = m.candidate_id"
COMPETED = dict(**ctes("pairs", "bk", "cnt", "cpairs", "comp"), b0=_BASE, b1=layer("b0", S_DEMAND, S_GAP1, S_GAP2))
VW = "v_candw v_place v_comp"


@query("a31_demand_buckets", with_views("v_candw v_place", "SELECT * FROM bk", **ctes("pairs", "bk")))
def _(spark, sf):
    c = cands(spark, sf)
    return K.back_to(c, K.demand_buckets(c, places(spark, sf)))


@query("a31_nearest_places", with_views("v_candw v_place", f"""SELECT candidate_id, category, place_id, {R('d', 6)} AS distance, CAST(rn AS INT) AS position FROM (
 SELECT *, row_number() OVER (PARTITION BY candidate_id, category ORDER BY d, place_id) AS rn FROM pairs WHERE d <= 5) WHERE rn <= 5""", **ctes("pairs")))
def _(spark, sf):
    c = cands(spark, sf)
    near = K.nearest_places(c, places(spark, sf), 5.0, 5)
    return K.back_to(c, near).select("candidate_id", "category", "place_id", rnd(C("distance"), 6).alias("distance"), "position")


@query("m22_demand_training_scores", with_views("v_candw v_place", "SELECT candidate_id, demand_score, training_score FROM b1", **ctes("pairs", "bk", "cnt"),
                                                b0="SELECT w.*, n.* EXCLUDE candidate_id FROM v_candw w LEFT JOIN cnt n ON w.candidate_id = n.candidate_id", b1=layer("b0", S_DEMAND)))
def _(spark, sf):
    return with_demand(spark, sf).select("candidate_id", "demand_score", "training_score")


@query("a30_competition_summary", with_views(VW, "SELECT * FROM comp", **ctes("cpairs", "comp")))
def _(spark, sf):
    c = cands(spark, sf)
    return K.back_to(c, K.competition_summary(c, competitors(spark, sf)))


@query("m23_competition_gap", with_views(VW, "SELECT candidate_id, effective_saturation, competition_gap_score FROM b1", **COMPETED))
def _(spark, sf):
    return with_competition(spark, sf).select("candidate_id", "effective_saturation", "competition_gap_score")


@query("m24_competition_pressure", with_views(VW, "SELECT candidate_id, competition_pressure_score, estimated_market_capacity, demand_to_competition_ratio FROM b1", **COMPETED))
def _(spark, sf):
    return with_competition(spark, sf).select("candidate_id", "competition_pressure_score", "estimated_market_capacity", "demand_to_competition_ratio")


@query("w10_dominant_provider", with_views(VW, "SELECT candidate_id, dominant_provider_index FROM b1", **COMPETED))
def _(spark, sf):
    return with_competition(spark, sf).select("candidate_id", "dominant_provider_index")


_BAND = "CASE WHEN competition_pressure_score IS NULL THEN 'Unknown' WHEN competition_pressure_score < 25 THEN 'Low' WHEN competition_pressure_score < 50 THEN 'Medium' WHEN competition_pressure_score < 78 THEN 'High' ELSE 'Extreme' END"


@query("a57_competition_detail", with_views(VW, f"""SELECT candidate_id, coalesce(competitors_1mi, 0) AS band_0_1_mi, coalesce(competitors_3mi - competitors_1mi, 0) AS band_1_3_mi, coalesce(competitors_5mi - competitors_3mi, 0) AS band_3_5_mi,
 coalesce(competitor_count_total - direct_competitors, 0) AS general_competitors, {R("1.0 - competitor_no_website / competitor_count_total", 3)} AS website_presence,
 {R("booking_missing / competitor_count_total", 3)} AS booking_friction_share, {_BAND} AS competition_pressure_band FROM b1""", **COMPETED))
def _(spark, sf):
    return K.competition_detail(with_competition(spark, sf)).select(
        "candidate_id", "band_0_1_mi", "band_1_3_mi", "band_3_5_mi", "general_competitors", "website_presence", "booking_friction_share", "competition_pressure_band")


@query("p36_direct_competitor", with_views("v_comp", """SELECT place_id, regexp_matches(lower(name), 'cpr|bls|acls|pals|first aid|first-aid|life support|aha|american heart|red cross|heartsaver|cna training|ems training|emt training|certification') AS direct FROM v_comp"""))
def _(spark, sf):
    return competitors(spark, sf).select("place_id", F.lower("name").rlike("|".join(K.DIRECT_WORDS)).alias("direct"))


_EC = {"economy_score": "coalesce(" + R(RENORM([(f"({SCALE(f, lo, hi)} / 100)", w) for f, lo, hi, w in K.ECONOMY_PARTS]) + " * 100", 2) + ", 50.0)::DOUBLE",
       "eused": "round(" + " + ".join(f"CASE WHEN {f} IS NOT NULL THEN {w} ELSE 0 END" for f, _, _, w in K.ECONOMY_PARTS) + ", 6)"}
_EC2 = {"economy_confidence": "CASE WHEN eused <= 0 THEN 'missing' WHEN eused >= 0.7 THEN 'ok' ELSE 'partial' END"}


@query("m25_economy_score", with_views("v_candw", "SELECT candidate_id, economy_score, economy_confidence FROM b1", b1=layer("v_candw", _EC, _EC2)))
def _(spark, sf):
    return K.economy(cands(spark, sf)).select("candidate_id", "economy_score", "economy_confidence")


_near = lambda c, a, b: f"coalesce(CASE WHEN {c} IS NOT NULL THEN greatest(0.0, least(1.0, 1.0 - ({c} - {a}) / {b - a})) END, 0.0)"
_AC = {"accessibility_score": R(f"(0.20 * {_near('d_freeway', 0.5, 1.5)} + 0.20 * {_near('d_transit', 0.5, 3.0)} + 0.15 * {_near('d_corridor', 2.0, 8.0)} + 0.20 * {_near('d_shopping', 0.25, 1.25)} "
                                "+ CASE WHEN d_parking IS NOT NULL THEN 0.075 ELSE 0 END + 0.15 * least(1.0, coalesce(one_mile_total, 0) / 25.0)) * 100", 2)}


def with_access(df, spark, sf):
    near = at(K.nearest_by_kind(cands(spark, sf), places(spark, sf), REACH))
    return K.accessibility(df.join(near, ["lat", "lng"], "left"))


@query("m26_accessibility_score", with_views("v_candw v_place", "SELECT candidate_id, accessibility_score FROM b1", **ctes("pairs", "bk", "cnt", "acc"),
       b0="SELECT w.candidate_id, n.one_mile_total, a.* EXCLUDE candidate_id FROM v_candw w LEFT JOIN cnt n ON w.candidate_id = n.candidate_id LEFT JOIN acc a ON w.candidate_id = a.candidate_id", b1=layer("b0", _AC)))
def _(spark, sf):
    base = cands(spark, sf).select("candidate_id", "lat", "lng").join(at(counts(spark, sf)), ["lat", "lng"], "left")
    return with_access(base, spark, sf).select("candidate_id", "accessibility_score")


_JOB = R("(" + " + ".join(f"least(1.0, ({' + '.join(_z(c) for c in cols)}) / {float(cap)}) * {w}" for cols, cap, w in K.JOB_PARTS) + ") * 100", 2)
_JD = {"job_demand_score": f"CASE WHEN active_postings_count IS NOT NULL AND certification_postings_count IS NOT NULL THEN {_JOB} END"}


@query("m28_job_demand_score", with_views("v_candw", "SELECT candidate_id, job_demand_score FROM b1", b1=layer("v_candw", _JD)))
def _(spark, sf):
    return cands(spark, sf).select("candidate_id", K.job_demand_score().alias("job_demand_score"))


_OP1 = {"ww": "CASE WHEN competitor_count_total > 0 THEN least(1.0, (competitor_no_website + competitor_no_phone + booking_missing + schedule_missing + pricing_missing + friction_detected + outdated_detected + 2.0 * competitor_low_rating_count + multilingual_missing) / (10.0 * competitor_count_total)) ELSE 0 END",
        "gr": "greatest(0.2, least(1.5, coalesce(working_age_share, 0.6)))", "dn": "least(1.0, demand_score / 100)", "tn": "least(1.0, training_score / 100)", "gn": "competition_gap_score / 100", "jn": "job_demand_score / 100",
        "pp": CLAMP("competition_pressure_score / 100", 0, 1)}
_OP2 = {"white_space_score": R("CASE WHEN dn > 0 THEN CASE WHEN pp IS NULL THEN least(1.0, dn * gr) ELSE least(1.0, dn * gr / greatest(0.1, pp * (1 - 0.5 * ww)) / 2) END * 100 END", 2)}
_OP3 = {"opportunity_score": R("""CASE WHEN white_space_score IS NULL AND jn IS NULL THEN 0.35 * dn + 0.25 * tn + 0.25 * gn + 0.15 * ww WHEN white_space_score IS NULL THEN 0.30 * dn + 0.20 * tn + 0.25 * gn + 0.15 * ww + 0.10 * jn
 WHEN jn IS NULL THEN 0.30 * dn + 0.20 * tn + 0.15 * gn + 0.15 * ww + 0.20 * white_space_score / 100 ELSE 0.25 * dn + 0.15 * tn + 0.15 * gn + 0.15 * ww + 0.10 * jn + 0.20 * white_space_score / 100 END * 100""", 2), "weakness_index": R("ww", 3)}


def with_opportunity(spark, sf):
    return K.opportunity(with_competition(spark, sf).withColumn("job_demand_score", K.job_demand_score()))


@query("m27_opportunity_score", with_views(VW, "SELECT candidate_id, opportunity_score, weakness_index, white_space_score FROM b2", **COMPETED, b2=layer("b1", _JD, _OP1, _OP2, _OP3)))
def _(spark, sf):
    return with_opportunity(spark, sf).select("candidate_id", "opportunity_score", "weakness_index", "white_space_score")


def prices(spark, sf):
    c = V.class_table(spark, sf)
    # prices are whole dollars in a narrow range, so the exact median's state is tiny
    overall = c.agg(F.median("price").alias("m")).scalar()
    return c.groupBy("state").agg(F.median("price").alias("median_price"), F.count("*").alias("sample_size")).withColumn("overall_median", overall)


PRICE = """SELECT w.candidate_id, coalesce(p.mp, (SELECT median(price) FROM v_class)) AS avg_price, CASE WHEN p.mp IS NOT NULL THEN 'state:' || w.state ELSE 'overall_median' END AS price_source
 FROM v_candw w LEFT JOIN (SELECT state, median(price) AS mp, count(*) AS k FROM v_class GROUP BY 1) p ON upper(trim(w.state)) = upper(p.state) AND p.k >= 2"""


@query("j17_price_lookup", with_views("v_candw v_class", PRICE))
def _(spark, sf):
    return K.lookup_price(cands(spark, sf), prices(spark, sf), 90.0).select("candidate_id", "avg_price", "price_source")


_st = lambda n: f"CAST(round_even({n} * 4.33 * 8.0 * (0.4 + 0.4 * least(1.0, opportunity_score / 100) + 0.2 * least(1.0, demand_score / 100)), 0) AS BIGINT)"
_PR = [{"students_low": _st(3), "students_mid": _st(6), "students_high": _st(10)}, {f"revenue_{k}": R(f"students_{k} * avg_price", 2) for k in ("low", "mid", "high")},
       {"profitability_score": R("least(1.0, revenue_mid / 40000) * 100", 2)}]
OPP = dict(**COMPETED, b2=layer("b1", _JD, _OP1, _OP2, _OP3), price=PRICE, b3=layer("(SELECT b2.*, avg_price, price_source FROM b2 JOIN price USING (candidate_id))", *_PR))


def with_profit(spark, sf):
    return K.profitability(K.lookup_price(with_opportunity(spark, sf), prices(spark, sf), 90.0))


@query("m29_profitability", with_views(VW + " v_class", "SELECT candidate_id, students_low, students_mid, students_high, revenue_mid, profitability_score FROM b3", **OPP))
def _(spark, sf):
    return with_profit(spark, sf).select("candidate_id", "students_low", "students_mid", "students_high", "revenue_mid", "profitability_score")


SOURCES = ["US Census Bureau ACS 5-year", "BLS QCEW", "Google Places API (Nearby)", "Public job postings CSV", "stub source"]
AS_OF = "2001-01-01 00:00:00"
SRC = """SELECT candidate_id, avg(t * f) AS quality, avg(f) AS fresh, count(DISTINCT name) AS credible FROM (SELECT *, CASE WHEN days <= 30 THEN 1.0 WHEN days <= 365 THEN 1.0 - 0.6 * ((days - 30) / 335.0) ELSE 0.2 END AS f FROM (
 SELECT o_custkey AS candidate_id, CASE o_orderkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'd' END AS name, CASE o_orderkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 WHEN 3 THEN 0.9 ELSE 0.0 END AS t,
 (epoch(TIMESTAMP '2001-01-01') - epoch(o_orderdate)) / 86400.0 AS days FROM orders) WHERE t > 0) GROUP BY 1"""


def sources(spark, sf):
    return V.table(spark, sf, "orders").select(C("o_custkey").alias("candidate_id"), F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (C("o_orderkey") % 5 + 1).cast("int")).alias("name"),
                                               C("o_orderdate").alias("collected_at"))


@query("c23_source_trust_freshness", with_views("", f"SELECT candidate_id, {R('quality', 6)} AS quality, {R('fresh', 6)} AS fresh, credible FROM src", src=SRC))
def _(spark, sf):
    q = K.source_quality(sources(spark, sf), F.lit(AS_OF).cast("timestamp"))
    return q.select("candidate_id", rnd(C("quality"), 6).alias("quality"), rnd(C("fresh"), 6).alias("fresh"), "credible")


_MISS = ["median_household_income", "rent_per_sqft_annual", "competitor_avg_rating", "d_transit", "d_freeway"]
_pct = lambda x: R(f"({x}) * 100", 2)
_CF = {"confidence_score": R("greatest(0.0, 0.6 * coalesce(quality, 0) + 0.4 * least(1.0, coalesce(credible, 0) / 4.0) - least(0.5, 0.04 * missing_fields)) * 100", 2),
       "dim_accessibility": _pct("(" + " + ".join(f"CASE WHEN d_{k} IS NOT NULL THEN 1 ELSE 0 END" for k in REACH) + ") / 5.0"),
       "dim_competition": _pct("CASE WHEN coalesce(competitor_count_total, 0) = 0 THEN 0.5 ELSE least(1.0, website_checked / competitor_count_total) END"),
       "dim_rent": "CASE WHEN rent_per_sqft_annual IS NOT NULL THEN 100.0 ELSE 0.0 END::DOUBLE", "dim_demand": _pct("least(1.0, coalesce(categories_seen, 0) / 18.0 * 1.5)"),
       "dim_freshness": _pct("coalesce(fresh, 0)"), "dim_saturation": _pct("CASE WHEN categories_seen > 0 THEN greatest(0.0, 1.0 - least(1.0, categories_saturated / categories_seen)) ELSE 0 END"),
       "dim_demographic": _pct("(" + " + ".join(f"CASE WHEN {f} IS NOT NULL THEN 1 ELSE 0 END" for f, *_ in K.ECONOMY_PARTS) + ") / 7.0")}
_AREA = {"historical_score": "coalesce(history_score, 50.0)", }
_AREA2 = {"area_score": R(" + ".join(f"{k} * {w}" for k, w in K.SUB_SCORES.items()), 2)}
_pk = "CASE WHEN coalesce(parking_notes, '') <> '' THEN CASE WHEN regexp_matches(lower(parking_notes), 'no parking|street only|no dedicated') THEN 30.0 ELSE least(100.0, 55.0 + CASE WHEN regexp_matches(lower(parking_notes), 'dedicated|reserved') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(lower(parking_notes), 'lot|garage|spaces') THEN 15 ELSE 0 END + CASE WHEN parking_notes LIKE '%40%' THEN 10 ELSE 0 END) END END::DOUBLE"
_nt = "lower(concat_ws(' ', coalesce(broker_notes, ''), coalesce(parking_notes, '')))"
_vs = f"CASE WHEN trim({_nt}) <> '' THEN greatest(0.0, least(100.0, 50.0 + CASE WHEN regexp_matches({_nt}, 'ground floor|ground-floor|street-facing|corner|high visibility|signage') THEN 25 ELSE 0 END - CASE WHEN regexp_matches({_nt}, 'second floor|rear|back of|basement|low visibility|no signage') THEN 25 ELSE 0 END)) END::DOUBLE"
_has = "coalesce(has_override, false)"
_fr = "square_feet / 35.0 / 12.0"
_FE = {"rent_fit": f"CASE WHEN {_has} THEN {R(CLAMP('(72.0 - asking_rent) / 54.0', 0, 1) + ' * 100', 2)} END", "parking_fit": f"CASE WHEN {_has} THEN {_pk} END",
       "classroom_fit_score": f"CASE WHEN {_has} AND square_feet > 0 THEN {R(f'least(100.0, CASE WHEN {_fr} < 1 THEN {_fr} * 100 ELSE 90 + {_fr} * 5 END)', 2)} END", "visibility_fit": f"CASE WHEN {_has} THEN {_vs} END",
       "candidate_type": "CASE WHEN NOT coalesce(viable, true) THEN 'invalid_or_low_confidence' WHEN coalesce(validated, false) THEN 'verified_commercial_listing' WHEN coalesce(commercial_anchor, false) THEN 'commercial_area_proxy' ELSE 'landmark_proxy' END",
       "pts": "CASE WHEN competition_pressure_score >= 60 THEN 1 ELSE 0 END + CASE WHEN confidence_score < 50 THEN 1 ELSE 0 END + CASE WHEN area_score < 50 THEN 1 ELSE 0 END + CASE WHEN coalesce(validated, false) THEN 0 ELSE 1 END"}
_FE2 = {"lease_readiness_score": f"CASE WHEN {_has} THEN {R(RENORM([(c, 1.0) for c in ('rent_fit', 'parking_fit', 'classroom_fit_score', 'accessibility_score', 'visibility_fit')]), 2)} END",
        "breakeven_students": "CAST(ceil(6500.0 / (avg_price - 25.0)) AS BIGINT)", "risk_level": "CASE WHEN pts >= 3 THEN 'High' WHEN pts >= 1 THEN 'Medium' ELSE 'Low' END",
        "data_basis": f"CASE WHEN {_has} AND validated THEN 'validated_override' WHEN {_has} THEN 'proxy' ELSE 'none' END"}
_sure = "candidate_type = 'verified_commercial_listing'"
_TI = {"site_score": f"CASE WHEN {_sure} THEN {R('0.5 * area_score + 0.5 * lease_readiness_score', 2)} END", "final_score": R("greatest(0.0, least(100.0, area_score + coalesce(zip_adjustment, 0)))", 2),
       "confidence_adjusted": R("greatest(0.0, least(100.0, confidence_score + coalesce(zip_confidence_modifier, 0)))", 2),
       "tier": f"substr('FDCBA', CAST(least(CASE WHEN area_score < 30 THEN 0 WHEN area_score < 50 THEN 1 WHEN area_score < 65 THEN 2 WHEN area_score < 80 THEN 3 ELSE 4 END, CASE WHEN confidence_score < 30 OR (effective_saturation >= 0.9 AND competition_gap_score < 25) THEN 2 ELSE 4 END, CASE WHEN {_sure} THEN 4 ELSE 3 END) + 1 AS INT), 1)",
       "executive_state": f"CASE WHEN {_sure} THEN 'Lease-ready candidate' WHEN candidate_type = 'invalid_or_low_confidence' OR area_score < 45 THEN 'Not recommended' WHEN candidate_type = 'commercial_area_proxy' AND area_score >= 55 THEN 'Recommended for listing search' ELSE 'Recommended for field validation' END",
       "rent_pressure_index": "coalesce(" + R(RENORM([(f"({SCALE('median_household_income', 40000, 160000)} / 100)", 0.40), (f"({SCALE('five_mile_total', 10, 250)} / 100)", 0.25), (f"({SCALE('competitor_count_total', 2, 40)} / 100)", 0.20), (CLAMP("(5.0 - d_corridor) / 5.0", 0, 1), 0.15)]) + " * 100", 2) + ", 50.0)::DOUBLE"}
FULL = dict(**OPP, acc=CHAIN["acc"], src=SRC,
            b4="SELECT b3.*, a.* EXCLUDE candidate_id, quality, fresh, credible FROM b3 LEFT JOIN acc a ON b3.candidate_id = a.candidate_id LEFT JOIN src s ON b3.candidate_id = s.candidate_id",
            b5=layer("b4", {"missing_fields": " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in _MISS)}, {**_AC, **_EC, **_CF}, {**_EC2, **_AREA}, _AREA2, _FE, _FE2, _TI))
VF = VW + " v_class"


def profile(spark, sf):
    """Everything the site score needs, one row per candidate."""
    df = with_access(with_profit(spark, sf), spark, sf)
    df = df.join(K.source_quality(sources(spark, sf), F.lit(AS_OF).cast("timestamp")), "candidate_id", "left")
    missing = F.lit(0)
    for c in _MISS:
        missing = missing + C(c).isNull().cast("int")
    df = K.area_score(K.confidence(K.economy(df.withColumn("missing_fields", missing))))
    return K.tiers(K.feasibility(df)).withColumn("rent_pressure_index", K.rent_pressure(df))


def _reg(name, cols):
    @query(name, with_views(VF, f"SELECT {cols} FROM b5", **FULL))
    def _(spark, sf):
        return profile(spark, sf).select(*cols.split(", "))


_reg("m33_confidence_dimensions", "candidate_id, confidence_score, dim_accessibility, dim_competition, dim_rent, dim_demand, dim_freshness, dim_saturation, dim_demographic")
_reg("m34_area_and_site_score", "candidate_id, area_score, site_score, final_score, confidence_adjusted")
_reg("m35_tier_and_state", "candidate_id, tier, executive_state, candidate_type")
_reg("m36_feasibility", "candidate_id, rent_fit, parking_fit, classroom_fit_score, visibility_fit, lease_readiness_score, breakeven_students, risk_level, data_basis")


@query("m37_rent_pressure", with_views(VF, "SELECT candidate_id, rent_pressure_index FROM b5", **FULL))
def _(spark, sf):
    return profile(spark, sf).select("candidate_id", "rent_pressure_index")


@query("p35_candidate_type", with_views("v_candw", """SELECT candidate_id, CASE WHEN NOT coalesce(viable, true) THEN 'invalid_or_low_confidence' WHEN coalesce(validated, false) THEN 'verified_commercial_listing' WHEN coalesce(commercial_anchor, false) THEN 'commercial_area_proxy' ELSE 'landmark_proxy' END AS candidate_type,
 CASE WHEN broker_notes LIKE '%enrollment%' THEN 'confirmed' WHEN broker_notes LIKE '%ads test%' THEN 'tested' ELSE 'proxy' END AS demand_level FROM v_candw"""))
def _(spark, sf):
    return cands(spark, sf).select("candidate_id", K.candidate_type().alias("candidate_type"), K.demand_level(C("broker_notes")).alias("demand_level"))


@query("p47_parking_visibility", with_views("v_candw", f"SELECT candidate_id, {_pk} AS parking, {_vs} AS visibility FROM v_candw"))
def _(spark, sf):
    notes = F.concat_ws(" ", F.coalesce(C("broker_notes"), F.lit("")), F.coalesce(C("parking_notes"), F.lit("")))
    return cands(spark, sf).select("candidate_id", K.parking_score(C("parking_notes")).alias("parking"), F.when(F.trim(notes) != "", K.visibility_score(notes)).alias("visibility"))


@query("c46_rent_and_classroom", with_views("v_candw", f"""SELECT candidate_id, {R(CLAMP('(72.0 - asking_rent) / 54.0', 0, 1) + ' * 100', 2)} AS affordability,
 CASE WHEN square_feet > 0 THEN {R(f'least(100.0, CASE WHEN {_fr} < 1 THEN {_fr} * 100 ELSE 90 + {_fr} * 5 END)', 2)} END AS fit FROM v_candw"""))
def _(spark, sf):
    return cands(spark, sf).select("candidate_id", K.rent_affordability(C("asking_rent")).alias("affordability"), K.classroom_fit(C("square_feet")).alias("fit"))


@query("f08_viable_candidates", with_views("v_candw", "SELECT cohort, count(*) AS viable FROM v_candw WHERE coalesce(viable, true) GROUP BY 1"))
def _(spark, sf):
    return cands(spark, sf).where(F.coalesce(C("viable"), F.lit(True))).groupBy("cohort").agg(F.count("*").alias("viable"))


# --- cohort over simple stand-in scores -----------------------------------------------

SUBS = {"demand_score": (0, 37, 101, 1, 999983), "training_score": (0, 53, 101, 1, 999983), "competition_gap_score": (10, 7, 61, 1, 999983), "opportunity_score": (0, 29, 101, 1, 999983),
        "economy_score": (0, 31, 101, 1, 999983), "accessibility_score": (0, 41, 101, 1, 999983), "historical_score": (0, 43, 101, 1, 999983), "profitability_score": (0, 47, 101, 1, 999983)}
COH = {"cohort": ["north", "south", "east"]}
extend("v_scored", f"SELECT *, {R(' + '.join(f'{k} * {w}' for k, w in K.SUB_SCORES.items()), 2)} AS area_score FROM (SELECT point_id AS candidate_id, lat, lng, {derived_sql(SUBS, COH, {})} FROM (SELECT *, point_id AS k FROM v_point))", ["v_point"])


def scored(spark, sf):
    p = V.points(spark, sf)
    df = p.select(C("point_id").alias("candidate_id"), "lat", "lng", *[v.alias(n) for n, v in derived_columns(C("point_id"), SUBS, COH, {}).items()])
    return K.stages(df, {"area_score": rnd(K.total([C(k) * w for k, w in K.SUB_SCORES.items()]), 2)})


_blend = lambda c: f"CASE WHEN {c} IS NULL THEN NULL WHEN sd_{c} < 1e-6 THEN {c} ELSE {R(f'greatest(0.0, least(100.0, 0.5 * {c} + 50.0 / (1.0 + exp(-({c} - mu_{c}) / sd_{c}))))', 2)} END"
COHORT = layer("v_scored", {f"{a}_{c}": f"{f}({c}) OVER (PARTITION BY cohort)" for c in K.NORMALIZED for a, f in (("mu", "avg"), ("sd", "stddev_pop"))},
               {f"n_{c}": _blend(c) for c in K.NORMALIZED},
               {"cohort_area_score": R(" + ".join(f"coalesce({'n_' if k in K.NORMALIZED else ''}{k}, 0) * {w}" for k, w in K.SUB_SCORES.items()), 2)})


@query("w06_cohort_blend", with_views("v_scored", "SELECT candidate_id, cohort, " + ", ".join(f"n_{c}" for c in K.NORMALIZED) + ", cohort_area_score FROM co", co=COHORT))
def _(spark, sf):
    return K.cohort_blend(scored(spark, sf), "cohort").select("candidate_id", "cohort", *[f"n_{c}" for c in K.NORMALIZED], "cohort_area_score")


@query("a46_cohort_means", with_views("v_scored", "SELECT cohort, " + ", ".join(f"{R(f'avg({c})', 4)} AS {c}" for c in K.SUB_SCORES) + " FROM v_scored GROUP BY 1"))
def _(spark, sf):
    return scored(spark, sf).groupBy("cohort").agg(*[rnd(F.avg(c), 4).alias(c) for c in K.SUB_SCORES])


@query("w04_score_deltas", with_views("v_scored", """SELECT candidate_id, score_delta, CASE WHEN spread < 1 OR abs(score_delta) < 1 THEN 'Around cohort mean' WHEN score_delta >= 3 THEN 'Well above cohort mean' WHEN score_delta >= 1 THEN 'Above cohort mean'
 WHEN score_delta <= -3 THEN 'Well below cohort mean' ELSE 'Below cohort mean' END AS score_delta_label FROM (SELECT *, """ + R("area_score - mu", 2) + """ AS score_delta FROM (SELECT *, avg(area_score) OVER (PARTITION BY cohort) AS mu,
 max(area_score) OVER (PARTITION BY cohort) - min(area_score) OVER (PARTITION BY cohort) AS spread FROM v_scored))"""))
def _(spark, sf):
    return K.score_deltas(scored(spark, sf), "cohort", "area_score").select("candidate_id", "score_delta", "score_delta_label")


@query("w07_factor_decomposition", with_views("v_scored", f"""SELECT candidate_id, CAST(row_number() OVER (PARTITION BY candidate_id ORDER BY abs(contribution) DESC, sub_score) AS INT) AS position, sub_score, value, cohort_mean, delta, contribution FROM (
 {" UNION ALL ".join(f"SELECT candidate_id, '{c}' AS sub_score, {R(c, 2)} AS value, {R(f'avg({c}) OVER (PARTITION BY cohort)', 2)} AS cohort_mean, {R(f'{c} - avg({c}) OVER (PARTITION BY cohort)', 2)} AS delta, {R(f'({c} - avg({c}) OVER (PARTITION BY cohort)) * {w}', 3)} AS contribution FROM v_scored" for c, w in K.SUB_SCORES.items())}) WHERE value IS NOT NULL"""))
def _(spark, sf):
    return K.factor_decomposition(scored(spark, sf), "cohort")


@query("w08_differentiation", with_views("v_scored", f"SELECT cohort, {R('greatest(0.0, least(1.0, (stddev_pop(area_score) / avg(area_score) - 0.02) / 0.08)) * 100', 2)} AS differentiation FROM v_scored GROUP BY 1"))
def _(spark, sf):
    return K.cohort_differentiation(scored(spark, sf), "cohort", "area_score")


@query("w01_candidate_rank", with_views("v_scored", "SELECT candidate_id, row_number() OVER (ORDER BY area_score DESC, candidate_id) AS candidate_rank FROM v_scored"))
def _(spark, sf):
    return global_rank(scored(spark, sf).select("candidate_id", "area_score"), [C("area_score").desc(), C("candidate_id").asc()], "candidate_rank").select("candidate_id", "candidate_rank")


@query("a45_city_rankings", with_views("v_scored", f"""SELECT area, best_candidate, best_score, avg_top_score, candidate_count, row_number() OVER (ORDER BY best_score DESC, avg_top_score DESC, area) AS city_rank FROM (
 SELECT area, max(CASE WHEN rn = 1 THEN candidate_id END) AS best_candidate, max(area_score) AS best_score, {R("avg(CASE WHEN rn <= 3 THEN area_score END)", 2)} AS avg_top_score, count(*) AS candidate_count FROM (
  SELECT *, row_number() OVER (PARTITION BY area ORDER BY area_score DESC, candidate_id) AS rn FROM (SELECT *, CAST(CAST(floor(lat * 10) AS INT) AS VARCHAR) AS area FROM v_scored WHERE lat IS NOT NULL)) GROUP BY 1)"""))
def _(spark, sf):
    df = scored(spark, sf).where("lat IS NOT NULL").withColumn("area", F.floor(C("lat") * 10).cast("string"))
    r = K.city_rankings(df, "area", "area_score")
    ranked = global_rank(r, [C("best_score").desc(), C("avg_top_score").desc(), C("area").asc()], "city_rank")
    return ranked.select("area", "best_candidate", "best_score", "avg_top_score", "candidate_count", "city_rank")


@query("w09_rent_estimates", with_views("v_candw", f"""SELECT candidate_id, CASE WHEN n = 1 THEN {R("CASE WHEN sx <= 0 THEN sy ELSE sy * idx / sx END", 2)} WHEN n > 1 THEN {R("greatest(0.0, (n * sxy - sx * sy) / (n * sxx - sx * sx) * idx + (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n)", 2)} END AS estimated_rent_per_sqft,
 coalesce(n, 0) AS anchor_count FROM i LEFT JOIN (SELECT cohort, count(*) AS n, sum(idx) AS sx, sum(r) AS sy, sum(idx * idx) AS sxx, sum(idx * r) AS sxy FROM i WHERE r IS NOT NULL GROUP BY 1) a ON i.cohort = a.cohort""",
       i="SELECT candidate_id, CASE WHEN k % 50 = 3 THEN 'lone' WHEN k % 50 = 7 THEN 'none' ELSE cohort END AS cohort, CAST(k * 37 % 101 AS DOUBLE) AS idx, CASE WHEN k % 50 = 7 OR (k % 50 = 3 AND k <> 53) THEN NULL ELSE rent_per_sqft_annual END AS r FROM (SELECT *, candidate_id AS k FROM v_candw)"))
def _(spark, sf):
    k = C("candidate_id")
    df = cands(spark, sf).select(
        "candidate_id", F.when(k % 50 == 3, "lone").when(k % 50 == 7, "none").otherwise(C("cohort")).alias("cohort"), (k * 37 % 101).cast("double").alias("rent_pressure_index"),
        F.when(~((k % 50 == 7) | ((k % 50 == 3) & (k != 53))), C("rent_per_sqft_annual")).alias("rent_per_sqft_annual"))
    return K.rent_estimates(df, "cohort").select("candidate_id", "estimated_rent_per_sqft", "anchor_count")


@query("j35_catchment_overlap", with_views("v_candw v_comp", f"""SELECT w.candidate_id, {R("coalesce(greatest(0.0, least(1.0, 1.0 - coalesce(s, 0) / ((SELECT count(*) FROM n5c) - 1) / 0.6)), 1.0) * 100", 2)} AS catchment_overlap FROM v_candw w
 LEFT JOIN n5c n ON w.candidate_id = n.candidate_id LEFT JOIN ov o ON w.candidate_id = o.candidate_id""", cpairs=CHAIN["cpairs"],
       n5="SELECT candidate_id, place_id FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY d, place_id) AS rn FROM cpairs WHERE d <= 2) WHERE rn <= 5",
       n5c="SELECT candidate_id, count(*) AS n FROM n5 GROUP BY 1",
       ov="SELECT a AS candidate_id, sum(k * 1.0 / (x.n + y.n - k)) AS s FROM (SELECT l.candidate_id AS a, r.candidate_id AS b, count(*) AS k FROM n5 l JOIN n5 r ON l.place_id = r.place_id AND l.candidate_id <> r.candidate_id GROUP BY 1, 2) JOIN n5c x ON a = x.candidate_id JOIN n5c y ON b = y.candidate_id GROUP BY 1").replace(
           "coalesce(greatest(0.0, least(1.0, 1.0 - coalesce(s, 0)", "CASE WHEN n.n IS NULL THEN 1.0 ELSE greatest(0.0, least(1.0, 1.0 - coalesce(s, 0)").replace("/ 0.6)), 1.0) * 100", "/ 0.6)) END * 100"))
def _(spark, sf):
    c = cands(spark, sf)
    p = competitors(spark, sf).select("place_id", "lat", "lng", F.lit("x").alias("category"))
    n5 = K.back_to(c, K.nearest_places(c, p, 2.0, 5)).select("candidate_id", "place_id")
    return K.catchment_overlap(n5, c)


@query("a53_capability_gaps", with_views(VW, "SELECT candidate_id, gap, missing, offered, checked, " + R("s", 3) + """ AS share_missing, CASE WHEN s >= 0.6 THEN 'strong' WHEN s >= 0.35 THEN 'moderate' WHEN s > 0 THEN 'weak' ELSE 'none' END AS strength,
 CASE WHEN checked > 0 AND checked / t >= 0.6 THEN 'high' WHEN checked > 0 AND checked / t >= 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT *, CASE WHEN checked > 0 THEN missing / checked ELSE 0 END AS s FROM g)""",
       **ctes("cpairs", "comp"), g=" UNION ALL ".join(
           f"SELECT candidate_id, website_checked AS checked, competitor_count_total AS t, '{x}' AS gap, {x}_missing AS missing, " + (f"{x}_offered" if x in ("acls_pals", "weekend", "group_corporate", "multilingual") else f"greatest(0, website_checked - {x}_missing)") + " AS offered FROM comp"
           for x in ("booking", "schedule", "pricing", "acls_pals", "weekend", "group_corporate", "multilingual"))
       + " UNION ALL SELECT candidate_id, website_checked, competitor_count_total, 'outdated_website', outdated_detected, 0 FROM comp"))
def _(spark, sf):
    c = cands(spark, sf)
    return K.capability_gaps(K.back_to(c, K.competition_summary(c, competitors(spark, sf))))


@query("a44_area_demand_max", with_views("v_candw v_place", "SELECT category, max(within_5) AS max_within_5 FROM bk GROUP BY 1", **ctes("pairs", "bk")))
def _(spark, sf):
    return K.demand_buckets(cands(spark, sf), places(spark, sf)).groupBy("category").agg(F.max("within_5").alias("max_within_5"))


@query("c06_competitor_discovery", with_views("v_candw v_comp", f"""SELECT candidate_id, place_id, {R('d', 4)} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY d, place_id) AS rn FROM cpairs WHERE d <= 5) WHERE rn <= 5""", **ctes("cpairs")))
def _(spark, sf):
    c = cands(spark, sf)
    comp = competitors(spark, sf).select("place_id", "lat", "lng", F.lit("competitor").alias("category"))
    # the same competitor comes back from several queries; identity is the place id
    again = comp.unionByName(comp.where(C("place_id") % 2 == 0))
    return K.back_to(c, K.nearest_places(c, again, 5.0, 5)).select("candidate_id", "place_id", rnd(C("distance"), 4).alias("distance"))


@query("w11_weakest_dimensions", with_views("v_scored", """SELECT candidate_id, string_agg(k, ',' ORDER BY v, k) AS weakest FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY v, k) AS rn FROM (
 """ + " UNION ALL ".join(f"SELECT candidate_id, '{c}' AS k, {c} AS v FROM v_scored" for c in K.SUB_SCORES) + ")) WHERE rn <= 2 GROUP BY 1"))
def _(spark, sf):
    dims = F.array_sort(F.array(*[F.struct(C(c).alias("v"), F.lit(c).alias("k")) for c in K.SUB_SCORES]))
    return scored(spark, sf).select("candidate_id", F.array_join(F.slice(F.transform(dims, lambda s: s["k"]), 1, 2), ",").alias("weakest"))
