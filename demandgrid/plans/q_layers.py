"""Registered queries: composed layers, strategies and the remaining file readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandgrid.functions import text as T
from demandgrid.functions.exprs import joined, lookup, pick, rnd, zero
from demandgrid.operators import candidates as K
from demandgrid.operators import classes as CL
from demandgrid.operators import matching as MT
from demandgrid.operators import ops as O
from demandgrid.operators import records as RC
from demandgrid.operators import strategies as ST
from demandgrid.operators import trends as TR
from demandgrid.operators.classes import top_per
from demandgrid.plans import q_ops as Q
from demandgrid.plans import views as V
from demandgrid.plans.q_candidates import COMPETED, FULL, REACH, VF, VW, _BAND, at, cands, counts, ctes, places, profile, with_competition
from demandgrid.plans.q_classes import AVG2, FILL, TARGETS, held, performance
from demandgrid.plans.q_modeled import gated, model
from demandgrid.plans.q_records import by, by_sql, orders, scratch
from demandgrid.plans.q_zips import scored
from demandgrid.plans.registry import query
from demandgrid.plans.sql import CLAMP, HAV, R, with_views
from demandgrid.plans.zip_table import zips
from demandgrid.sources import readers as RD
from demandgrid.sources import sinks as SK

C = F.col


@query("m03_confidence_modifier", with_views("scored", "SELECT zip, confidence_modifier FROM scored"))
def _(spark, sf):
    return scored(spark, sf).select("zip", "confidence_modifier")


@query("c21_gate_score_and_class", with_views("gated", "SELECT api_priority, count(*) AS zips, " + R("avg(api_candidate_score)", 4) + " AS mean_score FROM gated GROUP BY 1"))
def _(spark, sf):
    return gated(spark, sf).groupBy("api_priority").agg(F.count("*").alias("zips"), rnd(F.avg("api_candidate_score"), 4).alias("mean_score"))


@query("c22_confidence_dimension_means", with_views(VF, "SELECT cohort, " + ", ".join(f"{R(f'avg({c})', 3)} AS {c}" for c in ("dim_accessibility", "dim_competition", "dim_demand", "dim_saturation", "dim_demographic")) + " FROM b5 GROUP BY 1", **FULL))
def _(spark, sf):
    return profile(spark, sf).groupBy("cohort").agg(*[rnd(F.avg(c), 3).alias(c) for c in ("dim_accessibility", "dim_competition", "dim_demand", "dim_saturation", "dim_demographic")])


_S = {"nursing": ("nursing_school >= 1 OR nl >= 2", "5 + nl * 3"), "hospital": ("hospital >= 1", "4 + hospital * 2"), "ems-fire": ("crews >= 1", "3 + crews * 2"), "airport": ("d_corridor <= 1", "6"), "childcare": ("childcare_center >= 3", "2 + childcare_center"),
      "weekend": ("pupils >= 2", "2 + pupils"), "multilingual": ("population >= 100000 AND bachelors_or_higher_share < 0.30", "4"), "partnership": ("effective_saturation >= 0.7 OR competitors_5mi >= 6", "5 + least(competitors_5mi, 6)")}
_g = lambda c: f"coalesce(c_{c}, 0)"
STRAT = f"""SELECT candidate_id, coalesce(string_agg(k, ',' ORDER BY rn), 'partnership') AS strategies FROM (SELECT candidate_id, k, row_number() OVER (PARTITION BY candidate_id ORDER BY w DESC, n) AS rn FROM (
 {" UNION ALL ".join(f"SELECT candidate_id, CASE WHEN {c} THEN '{k}' END AS k, CASE WHEN {c} THEN {w} END AS w, {i} AS n FROM st WHERE {c}" for i, (k, (c, w)) in enumerate(_S.items()))}
 UNION ALL SELECT candidate_id, NULL, -1, 99 FROM st)) WHERE rn <= 3 GROUP BY 1"""
_strat_ctes = dict(**COMPETED, acc=ctes("acc")["acc"], st=f"""SELECT b1.candidate_id, population, bachelors_or_higher_share, effective_saturation, coalesce(competitors_5mi, 0) AS competitors_5mi, d_corridor, {_g('hospital')} AS hospital, {_g('nursing_school')} AS nursing_school, {_g('childcare_center')} AS childcare_center,
 {_g('nursing_school')} + {_g('cna_training')} + {_g('emt_training')} + {_g('healthcare_training')} + {_g('medical_school')} AS nl, {_g('fire_station')} + {_g('ems')} AS crews, {_g('university')} + {_g('community_college')} AS pupils FROM b1 LEFT JOIN acc a ON b1.candidate_id = a.candidate_id""")


def strategic(spark, sf):
    near = at(K.nearest_by_kind(cands(spark, sf), places(spark, sf), REACH)).select("lat", "lng", "d_corridor")
    df = with_competition(spark, sf).join(near, ["lat", "lng"], "left")
    return df.withColumn("strategies", ST.strategies(df))


@query("k09_top_strategies", with_views(VW, STRAT, **_strat_ctes))
def _(spark, sf):
    return strategic(spark, sf).select("candidate_id", joined(C("strategies")).alias("strategies"))


@query("f09_strategy_filter", with_views(VW, f"SELECT count(*) AS candidates FROM ({STRAT}) WHERE strategies LIKE '%airport%' OR strategies LIKE '%partnership%'", **_strat_ctes))
def _(spark, sf):
    return strategic(spark, sf).where(ST.fits(C("strategies"), ["airport", "partnership"])).agg(F.count("*").alias("candidates"))


@query("m46_decision_matrix", with_views(VF, """SELECT candidate_id, site_score, tier, CASE WHEN p >= 2 THEN 'Hard' WHEN p = 1 THEN 'Medium' ELSE 'Easy' END AS launch_difficulty FROM (SELECT *, CASE WHEN effective_saturation >= 0.8 THEN 1 ELSE 0 END + CASE WHEN confidence_score < 40 THEN 1 ELSE 0 END + CASE WHEN competition_gap_score < 35 THEN 1 ELSE 0 END AS p FROM b5)""", **FULL))
def _(spark, sf):
    return profile(spark, sf).select("candidate_id", "site_score", "tier", ST.launch_difficulty(C("effective_saturation"), C("confidence_score"), C("competition_gap_score")).alias("launch_difficulty"))


@query("c30_candidate_dashboard", with_views(VF, f"SELECT candidate_id, area_score, tier, {_BAND} AS pressure, risk_level FROM b5", **FULL))
def _(spark, sf):
    return profile(spark, sf).select("candidate_id", "area_score", "tier", K.pressure_band(C("competition_pressure_score")).alias("pressure"), "risk_level")


@query("a62_candidate_profile", with_views(VF, """SELECT candidate_id, five_mile_total, competitor_count_total, concat_ws(',', CASE WHEN median_household_income IS NULL THEN 'income' END, CASE WHEN rent_per_sqft_annual IS NULL THEN 'rent' END, CASE WHEN competitor_avg_rating IS NULL THEN 'rating' END, CASE WHEN d_transit IS NULL THEN 'transit' END) AS missing FROM b5""", **FULL))
def _(spark, sf):
    miss = {"median_household_income": "income", "rent_per_sqft_annual": "rent", "competitor_avg_rating": "rating", "d_transit": "transit"}
    return profile(spark, sf).select("candidate_id", "five_mile_total", "competitor_count_total", F.concat_ws(",", *[F.when(C(k).isNull(), v) for k, v in miss.items()]).alias("missing"))


@query("c45_growth_proxy", with_views("v_candw", "SELECT candidate_id, greatest(0.2, least(1.5, coalesce(working_age_share, 0.6)))::DOUBLE AS growth, coalesce(history_score, 50.0)::DOUBLE AS history FROM v_candw"))
def _(spark, sf):
    from demandgrid.functions.exprs import clamp
    return cands(spark, sf).select("candidate_id", clamp(F.coalesce(C("working_age_share"), F.lit(0.6)), 0.2, 1.5).alias("growth"), F.coalesce(clamp(C("history_score")), F.lit(50.0)).alias("history"))


@query("c47_economy_block", with_views("v_candw", "SELECT c.candidate_id, c.median_household_income, l.s AS labor, r.rent_per_sqft_annual AS rent FROM v_candw c LEFT JOIN (SELECT candidate_id, healthcare_employment_lq AS s FROM v_candw WHERE candidate_id % 2 = 0) l ON c.candidate_id = l.candidate_id LEFT JOIN (SELECT candidate_id, rent_per_sqft_annual FROM v_candw WHERE candidate_id % 3 = 0) r ON c.candidate_id = r.candidate_id"))
def _(spark, sf):
    c, k = cands(spark, sf), C("candidate_id")
    labor = c.where(k % 2 == 0).select("candidate_id", C("healthcare_employment_lq").alias("labor"))
    rent = c.where(k % 3 == 0).select("candidate_id", C("rent_per_sqft_annual").alias("rent"))
    return c.select("candidate_id", "median_household_income").join(labor, "candidate_id", "left").join(rent, "candidate_id", "left")


@query("c43_score_outcome_join", with_views("v_scored", "SELECT count(area_score) AS rows, " + R("corr(area_score, o)", 6) + " AS pearson FROM (SELECT s.area_score, avg(o_totalprice) AS o FROM v_scored s JOIN orders ON s.candidate_id = o_custkey GROUP BY s.candidate_id, s.area_score)"))
def _(spark, sf):
    from demandgrid.operators.ranks import fit
    from demandgrid.plans.q_candidates import scored as cohort_scored
    o = orders(spark, sf).groupBy(C("o_custkey").alias("candidate_id")).agg(F.avg("o_totalprice").alias("outcome"))
    return fit(cohort_scored(spark, sf).join(o, "candidate_id"), "area_score", "outcome").select(C("n").alias("rows"), rnd(C("pearson"), 6).alias("pearson"))


@query("c44_feature_backfill", with_views("v_zip", "SELECT zip, coalesce(median_household_income, 1000.0 + CAST(zip AS INT)) AS income, coalesce(population_density, population / nullif(land_sqmi, 0)) AS density FROM v_zip"))
def _(spark, sf):
    z = zips(spark, sf)
    old = z.select("zip", (C("zip").cast("int") + 1000.0).alias("old_income"))
    return z.join(old, "zip").select("zip", F.coalesce("median_household_income", "old_income").alias("income"), F.coalesce(C("population_density"), F.try_divide("population", F.nullif("land_sqmi", F.lit(0.0)))).alias("density"))


@query("a63_course_section", with_views("area", f"""SELECT p.course_type, p.total_classes, p.average_students, b.m AS median_students, w.weekend_classes FROM (SELECT decision AS course_type, count(*) AS total_classes, {AVG2} AS average_students FROM area WHERE decision IS NOT NULL GROUP BY 1) p
 JOIN (SELECT decision AS course_type, {R('median(enrolled)', 2)} AS m FROM area WHERE decision IS NOT NULL GROUP BY 1) b USING (course_type) JOIN (SELECT decision AS course_type, count(CASE WHEN day_part = 'weekend' THEN 1 END) AS weekend_classes FROM area WHERE decision IS NOT NULL GROUP BY 1) w USING (course_type)"""))
def _(spark, sf):
    from demandgrid.plans.q_classes import area
    rows = area(spark, sf).where("decision IS NOT NULL").withColumn("course_type", C("decision"))
    # one pass over the area feeds every part of the section
    return rows.groupBy("course_type").agg(F.count("*").alias("total_classes"), CL.mean_students().alias("average_students"), rnd(F.median("enrolled"), 2).alias("median_students"), F.count_if(C("day_part") == "weekend").alias("weekend_classes"))


# --- operations ------------------------------------------------------------------------------

@query("m55_action_ladder", with_views("modeled secon v_lead room", f"SELECT course, count(*) AS zips, {R('avg(feasibility)', 3)} AS mean_feasibility FROM ({Q.READY}) GROUP BY 1"))
def _(spark, sf):
    return Q.QREADY(spark, sf).groupBy("course").agg(F.count("*").alias("zips"), rnd(F.avg("feasibility"), 3).alias("mean_feasibility"))


@query("m56_missing_requirements", with_views("modeled secon v_lead room", """SELECT missing, count(*) AS courses FROM (SELECT concat_ws(',', CASE WHEN demand IS NULL THEN 'demand_not_modeled' WHEN demand < 40 THEN 'sufficient_demand' END, CASE WHEN instructor_score <= 0 THEN 'any_instructor' WHEN instructor_score < 65 THEN 'named_instructor' WHEN instructor_score < 80 THEN 'verified_instructor' END,
 CASE WHEN room_score <= 0 THEN 'any_room' WHEN room_score < 60 THEN 'specific_room' WHEN room_score < 80 THEN 'confirmed_room' END) AS missing FROM (""" + Q.READY + ")) GROUP BY 1"))
def _(spark, sf):
    return Q.QREADY(spark, sf).groupBy("missing").agg(F.count("*").alias("courses"))


@query("c31_proof_and_penalty", with_views("v_zip secon", f"SELECT z.zip, CASE WHEN historical_status = 'has_history' THEN coalesce(proven_aha_bls_score, 75.0) END AS proof, CASE WHEN pct < 100 THEN {R('(1 - pct / 100.0) * 15', 1)} ELSE 0.0 END::DOUBLE AS econ_penalty FROM v_zip z LEFT JOIN (SELECT zip, demand_vs_break_even_pct AS pct FROM secon) e ON z.zip = e.zip"))
def _(spark, sf):
    e = O.site_economics(zips(spark, sf), Q.few_supply(spark, sf), O.local_demand(V.students(spark, sf))).select("zip", "demand_vs_break_even_pct")
    return zips(spark, sf).join(e, "zip", "left").select("zip", F.when(C("historical_status") == "has_history", F.coalesce(C("proven_aha_bls_score"), F.lit(75.0))).alias("proof"), O.economics_penalty(C("demand_vs_break_even_pct")).alias("econ_penalty"))


@query("c32_zip_readiness", with_views("v_lead room", f"SELECT z.zip, i.score AS instructor_score, r.score AS room_score, i.stage AS instructor_stage, r.stage AS room_stage FROM (SELECT DISTINCT zip FROM v_lead) z LEFT JOIN ({Q.IREADY.format(k='zip')}) i ON z.zip = i.zip LEFT JOIN ({Q.RREADY}) r ON z.zip = r.zip"))
def _(spark, sf):
    i = O.instructor_readiness(Q.graded(spark, sf), ["zip"]).select("zip", C("score").alias("instructor_score"), C("stage").alias("instructor_stage"))
    r = O.room_readiness(Q.fitted(spark, sf), ["zip"]).select("zip", C("score").alias("room_score"), C("stage").alias("room_stage"))
    return i.join(r, "zip", "left").select("zip", "instructor_score", "room_score", "instructor_stage", "room_stage")


@query("c35_roster_candidates", "SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'AHA_BLS_INSTRUCTOR' WHEN 1 THEN 'ARC_BLS_INSTRUCTOR' ELSE 'ARC_CPR_INSTRUCTOR' END AS candidate_type, CASE WHEN s_suppkey % 2 = 0 THEN 'VERIFIED' ELSE 'NEEDS_VERIFICATION' END AS credential_status FROM supplier")
def _(spark, sf):
    k = C("s_suppkey")
    courses = T.list_cell(by(k, "aha bls; arc bls", "ARC_BLS|x", "ARC CPR FA AED"))
    norm = F.transform(courses, lambda c: F.upper(F.regexp_replace(c, " ", "_")))
    return V.table(spark, sf, "supplier").select(k.alias("id"), pick((F.array_contains(norm, "AHA_BLS"), "AHA_BLS_INSTRUCTOR"), (F.array_contains(norm, "ARC_BLS"), "ARC_BLS_INSTRUCTOR"), default="ARC_CPR_INSTRUCTOR").alias("candidate_type"),
                                                 F.when(T.tri_bool(by(k, "yes", "no")), "VERIFIED").otherwise("NEEDS_VERIFICATION").alias("credential_status"))


@query("c36_provider_leads", with_views("v_supply", "SELECT zip, provider, CAST(rn AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY zip ORDER BY provider) AS rn FROM (SELECT DISTINCT zip, lower(provider) AS provider FROM v_supply WHERE provider IS NOT NULL)) WHERE rn <= 5"))
def _(spark, sf):
    names = Q.supply_rows(spark, sf).where("provider IS NOT NULL").select("zip", F.lower("provider").alias("provider")).distinct()
    return top_per(names, ["zip"], [C("provider")], 5, "position")


@query("c37_lead_sources_union", with_views("v_supply v_poi", """SELECT source, count(*) AS leads FROM (SELECT DISTINCT 'provider' AS source, lower(provider) AS n FROM v_supply WHERE provider IS NOT NULL UNION ALL SELECT 'place', lower(name) || place_id FROM v_poi WHERE kind = 'CPR training') WHERE n NOT LIKE '%provider 7%' GROUP BY 1"""))
def _(spark, sf):
    a = Q.supply_rows(spark, sf).where("provider IS NOT NULL").select(F.lit("provider").alias("source"), F.lower("provider").alias("n")).distinct()
    b = V.pois(spark, sf).where("kind = 'CPR training'").select(F.lit("place").alias("source"), F.concat(F.lower("name"), C("place_id").cast("string")).alias("n"))
    # the own brand never becomes a lead
    return a.unionByName(b).where(~C("n").contains("provider 7")).groupBy("source").agg(F.count("*").alias("leads"))


@query("c48_missing_inputs", with_views("v_zip v_space", """SELECT z.zip, i.input, 'add_' || i.input || '_input' AS task FROM v_zip z CROSS JOIN (VALUES ('rooms'), ('hospitals'), ('transit')) i(input) WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.input = i.input AND h.zip = z.zip)""",
       have="SELECT 'rooms' AS input, zip FROM v_space UNION ALL SELECT 'hospitals', zip FROM v_zip WHERE hospital_count > 0 UNION ALL SELECT 'transit', lpad(CAST(s_suppkey * 13 % 700 AS VARCHAR), 5, '0') FROM supplier"))
def _(spark, sf):
    z = zips(spark, sf)
    have = {"rooms": V.table(spark, sf, "part").select(F.lpad((C("p_partkey") % 700).cast("string"), 5, "0").alias("zip")),
            "hospitals": z.where("hospital_count > 0").select("zip"), "transit": V.table(spark, sf, "supplier").select(F.lpad((C("s_suppkey") * 13 % 700).cast("string"), 5, "0").alias("zip"))}
    return MT.missing_inputs(z.select("zip"), "zip", have).withColumn("task", F.concat(F.lit("add_"), C("input"), F.lit("_input")))


@query("j32_room_candidates", with_views("v_zip v_room v_space", """SELECT zip, source, count(*) AS rooms FROM (SELECT zip, 'location' AS source FROM v_room UNION ALL SELECT zip, 'commercial' FROM v_space UNION ALL SELECT zip, 'signal' FROM v_zip WHERE community_facility_count >= 1) WHERE zip IN (SELECT zip FROM v_zip) GROUP BY 1, 2"""))
def _(spark, sf):
    k = C("p_partkey")
    a = Q.rooms(spark, sf).select("zip", F.lit("location").alias("source"))
    b = V.table(spark, sf, "part").select(F.lpad((k % 700).cast("string"), 5, "0").alias("zip"), F.lit("commercial").alias("source"))
    s = zips(spark, sf).where("community_facility_count >= 1").select("zip", F.lit("signal").alias("source"))
    wanted = zips(spark, sf).select("zip")
    return a.unionByName(b).unionByName(s).join(wanted, "zip", "left_semi").groupBy("zip", "source").agg(F.count("*").alias("rooms"))


@query("k06_near_target_first", with_views("perf", "SELECT instructor, near, performance_score FROM (SELECT *, coalesce(home_state = 'S2', false) OR coalesce(substr(home_zip, 1, 3) = '000', false) AS near FROM perf) ORDER BY near DESC, performance_score DESC, instructor LIMIT 20"))
def _(spark, sf):
    near = F.coalesce(C("home_state") == "S2", F.lit(False)) | F.coalesce(F.substring("home_zip", 1, 3) == "000", F.lit(False))
    return Q.perf(spark, sf).withColumn("near", near).orderBy(C("near").desc(), C("performance_score").desc(), "instructor").limit(20).select("instructor", "near", "performance_score")


# fixed values: ZIP prefixes of priority markets (stand-in areas of the test tables)
MARKETS = {"0000": "north", "0002": "bay", "0005": "east"}


@query("m58_priority_market", with_views("v_centroid", "SELECT zip, CASE substr(zip, 1, 4) WHEN '0000' THEN 'north' WHEN '0002' THEN 'bay' WHEN '0005' THEN 'east' END AS market FROM v_centroid"))
def _(spark, sf):
    return V.centroids(spark, sf).select("zip", lookup(F.substring("zip", 1, 4), MARKETS).alias("market"))


@query("p39_posting_records", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'unknown' ELSE 'Clinic' END AS employer, 37.5::DOUBLE AS lat, 3.0::DOUBLE AS radius_miles FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 > 0""")
def _(spark, sf):
    from demandgrid.operators.texts import CERTIFICATIONS, found
    k = C("o_orderkey")
    js = F.to_json(F.struct(by(k, "Nurse, BLS card", "Chef", "Driver").alias("title"), F.struct(by(k, None, "Clinic").alias("display_name")).alias("company"), F.when(k % 5 > 0, F.lit(37.5)).alias("latitude"), F.lit(-122.0).alias("longitude")))
    r = F.from_json(C("js"), "struct<title:string,description:string,company:struct<display_name:string>,latitude:double,longitude:double>")
    rows = orders(spark, sf).select(k.alias("id"), js.alias("js")).withColumn("r", r)
    text = F.concat_ws(" ", "r.title", "r.description", "r.company.display_name")
    keep = F.lit(False)
    for p in CERTIFICATIONS.values():
        keep = keep | found(text, p)
    # a single listing is credited within three miles
    return rows.where(keep & C("r.latitude").isNotNull() & C("r.longitude").isNotNull()).select("id", F.coalesce("r.company.display_name", F.lit("unknown")).alias("employer"), C("r.latitude").alias("lat"), F.lit(3.0).alias("radius_miles"))


# --- file readers: the given table written in the file's layout and read back ------------------

def saved(spark, df, sep=","):
    path = scratch(spark)
    df.write.option("header", True).option("sep", sep).csv(path)
    return path


def sup(spark, sf):
    return V.table(spark, sf, "supplier")


_z = "lpad(CAST(s_suppkey AS VARCHAR), 5, '0')"


def zz():
    return F.lpad(C("s_suppkey").cast("string"), 5, "0")


@query("s01_header_aliases", with_views("v_class", "SELECT count(*) AS classes, CAST(sum(enrolled) AS BIGINT) AS students, CAST(sum(capacity) AS BIGINT) AS seats FROM v_class"))
def _(spark, sf):
    c = V.class_table(spark, sf)
    raw = c.select(C("enrolled").alias("Num Enrolled (net)"), C("class_name").alias("Course"), C("capacity").alias("Max Seats"), C("city").alias("Town"))
    return RD.class_history(spark, saved(spark, raw)).agg(F.count("*").alias("classes"), F.sum("enrolled").alias("students"), F.sum("capacity").alias("seats"))


@query("s03_locations_file", f"SELECT 'site ' || CAST(s_suppkey AS VARCHAR) AS place_key, 'Reno' AS city, {_z} AS zip FROM supplier")
def _(spark, sf):
    raw = sup(spark, sf).select(F.concat(F.lit("Site "), C("s_suppkey").cast("string"), F.lit(" (t)")).alias("Abbreviation"), F.concat(F.lit("A(1 B, Reno, NV "), zz(), F.lit(")")).alias("Name"))
    df = RD.big_csv(spark, saved(spark, raw), position="pos")
    return CL.location_dimension(df, "Abbreviation", "Name", "pos").select("place_key", "city", "zip")


@query("s04_centroid_file", with_views("v_centroid", "SELECT zip, lat, lng FROM v_centroid WHERE CAST(zip AS INT) % 7 > 0"))
def _(spark, sf):
    raw = V.centroids(spark, sf).select("zip", F.when(C("zip").cast("int") % 7 == 0, "bad").otherwise(C("lat").cast("string")).alias("lat"), "lng")
    return RD.zip_centroids(spark, saved(spark, raw))


@query("s07_facility_files", f"SELECT category, count(*) AS rows, count(zip) AS with_zip FROM (SELECT 'hospital' AS category, CASE WHEN s_suppkey % 2 = 0 THEN {_z} END AS zip FROM supplier UNION ALL SELECT 'ems', {_z} FROM supplier) GROUP BY 1")
def _(spark, sf):
    a = sup(spark, sf).select(C("s_name").alias("NAME"), (C("s_suppkey") / 10).alias("LATITUDE"), (C("s_suppkey") / 9).alias("LONGITUDE"), F.when(C("s_suppkey") % 2 == 0, C("s_suppkey").cast("string")).alias("ZIP"))
    b = sup(spark, sf).select(C("s_name").alias("NAME"), F.concat(zz(), F.lit("-1")).alias("Zip_Code"))
    f = RD.facilities(spark, {"hospital": saved(spark, a), "ems": saved(spark, b)})
    return f.groupBy("category").agg(F.count("*").alias("rows"), F.count("zip").alias("with_zip"))


@query("s09_institution_file", f"SELECT {_z} AS zip, s_name AS name, CAST(s_suppkey * 3 AS BIGINT) AS enrollment FROM supplier")
def _(spark, sf):
    return RD.institutions(spark, saved(spark, sup(spark, sf).select(C("s_name").alias("INSTNM"), zz().alias("ZIP"), (C("s_suppkey") * 3).alias("EFTOTLT")))).select("zip", "name", "enrollment")


@query("s11_job_posting_file", "SELECT CAST(o_orderkey AS VARCHAR) AS title, CAST(o_orderkey % 9 AS DOUBLE) AS radius_miles FROM orders")
def _(spark, sf):
    k = C("o_orderkey")
    cols = {"title": k, "radius_miles": k % 9, "latitude": F.lit(37.1), "longitude": F.lit(-122.1)}
    raw = orders(spark, sf).select(*[(cols[c] if c in cols else F.lit("x")).alias(c) for c in RD.POSTING_COLUMNS])
    return RD.job_postings(spark, saved(spark, raw)).select("title", "radius_miles")


@query("s12_rent_override_file", "SELECT CAST(s_suppkey AS VARCHAR) AS city, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey + 0.5 END::DOUBLE AS rent_per_sqft_annual FROM supplier")
def _(spark, sf):
    cols = {"city": C("s_suppkey"), "rent_per_sqft_annual": F.when(C("s_suppkey") % 3 > 0, F.concat(F.lit("$"), (C("s_suppkey") + 0.5).cast("string"))).otherwise("n/a"), "latitude": F.lit(1), "longitude": F.lit(2), "radius_miles": F.lit(3)}
    raw = sup(spark, sf).select(*[(cols[c] if c in cols else F.lit("x")).alias(c) for c in RD.RENT_COLUMNS])
    return RD.rent_overrides(spark, saved(spark, raw)).select("city", "rent_per_sqft_annual")


@query("s13_commercial_override_file", "SELECT CAST(s_suppkey AS VARCHAR) AS candidate_id FROM supplier WHERE s_suppkey % 4 > 0")
def _(spark, sf):
    raw = sup(spark, sf).select(F.when(C("s_suppkey") % 4 > 0, C("s_suppkey").cast("string")).otherwise(" ").alias("candidate_id"), F.lit("").alias("address_match"), F.lit("30").alias("asking_rent"), F.lit("900").alias("square_feet"))
    return RD.commercial_overrides(spark, saved(spark, raw)).select("candidate_id")


@query("s14_commercial_validation_file", f"SELECT {_z} AS zip, CASE WHEN s_suppkey % 5 > 0 THEN 1000.0 + s_suppkey END::DOUBLE AS monthly_rent FROM supplier WHERE s_suppkey % 6 > 0")
def _(spark, sf):
    raw = sup(spark, sf).select(F.when(C("s_suppkey") % 6 > 0, C("s_suppkey").cast("string")).otherwise("none").alias("zip"), F.when(C("s_suppkey") % 5 > 0, F.concat(F.lit("$"), (C("s_suppkey") + 1000).cast("string"))).otherwise("ask").alias("monthly_rent"))
    return RD.commercial_validation(spark, saved(spark, raw)).select("zip", "monthly_rent")


@query("s15_state_price_file", "SELECT upper(r_name) AS state, CASE WHEN r_regionkey % 4 < 3 THEN 80 + r_regionkey * 1.25 END::DOUBLE AS median_price, CAST(r_regionkey AS DOUBLE) AS sample_size FROM region")
def _(spark, sf):
    raw = V.table(spark, sf, "region").select(F.lower("r_name").alias("state"), F.when(C("r_regionkey") % 4 < 3, F.concat(F.lit("$"), (80 + C("r_regionkey") * 1.25).cast("string"))).otherwise("n/a").alias("median_price"), C("r_regionkey").alias("sample_size"), F.lit("75").alias("overall_median"))
    return RD.state_prices(spark, saved(spark, raw)).select("state", "median_price", "sample_size")


@query("s16_roster_file", f"SELECT s_name AS name, {_z} AS zip, 2 - CAST(s_suppkey % 2 AS INT) AS courses, s_suppkey % 3 = 0 AS verified FROM supplier")
def _(spark, sf):
    raw = sup(spark, sf).select(C("s_name").alias("name"), C("s_suppkey").alias("zip"), by(C("s_suppkey"), "AHA_BLS; ARC_BLS", "ARC_BLS").alias("courses"), by(C("s_suppkey"), "Yes", "no", "").alias("verified"))
    return RD.roster(spark, saved(spark, raw)).select("name", "zip", F.size("courses").alias("courses"), "verified")


@query("s17_locations_import", f"SELECT s_name AS location_name, {_z} AS zip, 'active' AS active_status, CAST(s_suppkey AS DOUBLE) AS capacity FROM supplier")
def _(spark, sf):
    raw = sup(spark, sf).select(C("s_name").alias("location_name"), C("s_suppkey").alias("zip"), F.lit(" Active").alias("active_status"), C("s_suppkey").alias("capacity"))
    return RD.locations(spark, saved(spark, raw)).select("location_name", "zip", "active_status", "capacity")


@query("s18_course_economics_file", "SELECT upper(r_name) AS course_type, (90.5 + r_regionkey)::DOUBLE AS student_price, CASE WHEN r_regionkey % 2 = 1 THEN 3 * r_regionkey END::DOUBLE AS card_cost FROM region")
def _(spark, sf):
    raw = V.table(spark, sf, "region").select(C("r_name").alias("course_type"), F.concat(F.lit("$"), (90.5 + C("r_regionkey")).cast("string")).alias("student_price"), F.when(C("r_regionkey") % 2 == 1, (3 * C("r_regionkey")).cast("string")).otherwise("n/a").alias("card_cost"))
    return RD.keyed_numbers(spark, saved(spark, raw), "course_type", ["student_price", "card_cost"])


@query("s19_room_budget_file", "SELECT 60.0::DOUBLE AS max_hourly_rate, 8.0::DOUBLE AS minimum_capacity, count(*) AS sites FROM supplier")
def _(spark, sf):
    raw = sup(spark, sf).agg(F.lit(60).alias("max_hourly_rate"), F.lit("").alias("minimum_capacity"), F.count("*").alias("sites"))
    return RD.settings(spark, saved(spark, raw), {"max_hourly_rate": 75.0, "minimum_capacity": 8.0, "sites": 0.0}).withColumn("sites", C("sites").cast("bigint"))


@query("s20_site_cost_file", "SELECT CAST(count(*) AS DOUBLE) AS fixed, 420.0::DOUBLE AS amortization FROM supplier")
def _(spark, sf):
    raw = sup(spark, sf).agg(F.count("*").alias("fixed"))
    return RD.settings(spark, saved(spark, raw), {"fixed": 650.0, "amortization": 420.0})


@query("s21_site_health_file", "SELECT s_name AS site_name, 'WATCH' AS health_status, s_suppkey - 1067.0 AS break_even_gap FROM supplier".replace("s_suppkey - 1067.0", "CAST(s_suppkey AS DOUBLE) - 1067.0"))
def _(spark, sf):
    raw = sup(spark, sf).select(C("s_name").alias("site_name"), F.lit("odd").alias("health_status"), C("s_suppkey").alias("monthly_avg_revenue"))
    return O.site_health(RD.site_health(spark, saved(spark, raw))).select("site_name", "health_status", "break_even_gap")


@query("s22_performance_file", "SELECT s_name AS name, performance_score FROM (SELECT s_name, " + R("45.0 * least(1.0, s_suppkey / 500.0) + 15.0 * least(1.0, s_suppkey / 120.0) + 25.0 + 5.0", 1) + " AS performance_score FROM supplier) ORDER BY 2 DESC, 1 LIMIT 30")
def _(spark, sf):
    raw = sup(spark, sf).select(C("s_name").alias("name"), C("s_suppkey").alias("students"), F.lit(9).alias("students_per_class"), C("s_suppkey").alias("zips"), F.lit(3).alias("aha_bls_students"), F.lit(0).alias("arc_bls_students"), F.lit(0).alias("arc_cpr_students"))
    df = RD.big_csv(spark, saved(spark, raw))
    num = df.withColumns({c: T.parse_number(C(c)) for c in df.columns if c != "name"})
    return O.performance(num).orderBy(C("performance_score").desc(), "name").limit(30).select("name", "performance_score")


@query("s23_json_twin", "SELECT s_suppkey AS id, s_name AS name, 'json' AS kind FROM supplier UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN s_name END, 'csv' FROM supplier")
def _(spark, sf):
    rows = sup(spark, sf).select(C("s_suppkey").alias("id"), C("s_name").alias("name"))
    twin, both = scratch(spark), scratch(spark)
    rows.write.json(twin + ".json")
    rows.where("id IS NULL").write.json(both + ".json")  # the CSV is preferred where both exist
    rows.select("id", F.when(C("id") % 3 > 0, C("name")).alias("name")).write.option("header", True).csv(both + ".csv")
    read = lambda path, kind: RD.table_or_json(spark, path, "id bigint, name string", multi_line=False).withColumn("kind", F.lit(kind))
    return read(twin, "json").unionByName(read(both, "csv"))


@query("s24_zip_list_file", f"SELECT {_z} AS zip FROM supplier WHERE s_suppkey % 2 = 0")
def _(spark, sf):
    path = scratch(spark)
    listed = F.when(C("s_suppkey") % 2 == 0, F.array(F.struct(C("s_suppkey").cast("string").alias("zip")), F.struct(zz().alias("zip"))))
    sup(spark, sf).select(listed.alias("zips")).write.json(path)
    return RD.zip_list(spark, path, multi_line=False).select("zip")


@query("s25_rescored_profiles", with_views("v_scored", "SELECT candidate_id, area_score FROM v_scored"))
def _(spark, sf):
    from demandgrid.plans.q_candidates import scored as cohort_scored
    path = scratch(spark)
    cohort_scored(spark, sf).select("candidate_id", F.struct(*K.SUB_SCORES).alias("sub_scores")).write.json(path)
    schema = "candidate_id bigint, sub_scores struct<" + ",".join(f"{k}:double" for k in K.SUB_SCORES) + ">"
    p = RD.profiles(spark, path, schema, multi_line=False)
    return p.select("candidate_id", rnd(K.total([C(f"sub_scores.{k}") * w for k, w in K.SUB_SCORES.items()]), 2).alias("area_score"))


@query("s29_benchmark_csv", with_views("usable", f"SELECT course_type, {AVG2} AS average_students, count(enrolled) AS class_count FROM usable WHERE course_type IN ('arc_cpr','arc_bls','aha_bls') GROUP BY 1"))
def _(spark, sf):
    from demandgrid.plans.q_classes import usable
    path = scratch(spark)
    SK.write_table(CL.benchmarks(usable(spark, sf), TARGETS), path)
    df = RD.big_csv(spark, path)
    return df.select("course_type", C("average_students").cast("double").alias("average_students"), C("class_count").cast("bigint").alias("class_count"))


@query("s31_preferred_layer", with_views("v_zip", "SELECT zip, population FROM v_zip"))
def _(spark, sf):
    base = scratch(spark)
    zips(spark, sf).select("zip", "population").write.parquet(base + "/base")
    return spark.read.parquet(RD.preferred(spark, [base + "/enriched", base + "/base"]))


@query("s32_backtest_file", "SELECT CAST(s_suppkey AS VARCHAR) AS address, CAST(s_suppkey AS DOUBLE) AS outcome FROM supplier WHERE s_suppkey % 3 > 0")
def _(spark, sf):
    raw = sup(spark, sf).select(C("s_suppkey").alias("address"), F.lit("CA").alias("state"), F.when(C("s_suppkey") % 3 > 0, C("s_suppkey").cast("string")).otherwise("tbd").alias("outcome"))
    return RD.backtest_rows(spark, saved(spark, raw)).select("address", "outcome")


@query("c42_zip_files", with_views("v_zip", "SELECT zip, population FROM v_zip"))
def _(spark, sf):
    path = scratch(spark)
    SK.write_zip_files(zips(spark, sf).select("zip", "population"), path)
    return spark.read.schema("population double, zip string").json(path).select("zip", "population")
