"""Registered queries: operations tables, matching, upserts and parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandgrid.functions import text as T
from demandgrid.functions.exprs import joined, rnd
from demandgrid.operators import matching as MT
from demandgrid.operators import ops as O
from demandgrid.operators.classes import top_per
from demandgrid.plans import views as V
from demandgrid.plans.q_candidates import cands
from demandgrid.plans.q_modeled import model
from demandgrid.plans.registry import query
from demandgrid.plans.sql import CLAMP, HAV, R, extend, with_views
from demandgrid.plans.zip_table import derived_columns, derived_sql, zips

C = F.col

# --- supply and demand --------------------------------------------------------------------

extend("v_supply", """SELECT lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS zip, CASE l_partkey % 3 WHEN 0 THEN 'BLS' WHEN 1 THEN 'CPR' ELSE 'OTHER' END AS course_type, CASE WHEN l_linenumber <> 2 THEN CAST(40 + l_partkey % 90 AS DOUBLE) END AS price,
 CASE WHEN l_partkey % 11 > 0 THEN 'Provider ' || CAST(l_partkey % 23 AS VARCHAR) END AS provider, 'Hall ' || CAST(l_orderkey % 7 AS VARCHAR) AS location FROM lineitem""")


def supply_rows(spark, sf):
    p = C("l_partkey")
    return V.table(spark, sf, "lineitem").select(
        F.lpad(C("l_suppkey").cast("string"), 5, "0").alias("zip"), F.element_at(F.array(F.lit("BLS"), F.lit("CPR"), F.lit("OTHER")), (p % 3 + 1).cast("int")).alias("course_type"),
        F.when(C("l_linenumber") != 2, (40 + p % 90).cast("double")).alias("price"), F.when(p % 11 > 0, F.concat(F.lit("Provider "), (p % 23).cast("string"))).alias("provider"),
        F.concat(F.lit("Hall "), (C("l_orderkey") % 7).cast("string")).alias("location"))


SUPPLY = """SELECT m.*, p.providers, l.locations FROM (SELECT zip, course_type, count(*) AS class_count, count(DISTINCT provider) AS provider_count, median(price) AS median_price, min(price) AS min_price, max(price) AS max_price FROM v_supply GROUP BY 1, 2) m
 LEFT JOIN (SELECT zip, course_type, string_agg(provider, '; ' ORDER BY provider) AS providers FROM (SELECT *, row_number() OVER (PARTITION BY zip, course_type ORDER BY provider) AS rn FROM (SELECT DISTINCT zip, course_type, provider FROM v_supply WHERE provider IS NOT NULL)) WHERE rn <= 6 GROUP BY 1, 2) p USING (zip, course_type)
 LEFT JOIN (SELECT zip, course_type, string_agg(location, '; ' ORDER BY location) AS locations FROM (SELECT *, row_number() OVER (PARTITION BY zip, course_type ORDER BY location) AS rn FROM (SELECT DISTINCT zip, course_type, location FROM v_supply)) WHERE rn <= 3 GROUP BY 1, 2) l USING (zip, course_type)"""


@query("a33_competitor_supply", with_views("v_supply", SUPPLY))
def _(spark, sf):
    return O.competitor_supply(supply_rows(spark, sf))


@query("a36_competitor_context", with_views("v_supply", "SELECT zip, count(*) AS total_classes, count(DISTINCT provider) AS provider_count FROM v_supply GROUP BY 1"))
def _(spark, sf):
    return supply_rows(spark, sf).groupBy("zip").agg(F.count("*").alias("total_classes"), F.countDistinct("provider").alias("provider_count"))


DEMAND = """SELECT a.*, top_courses FROM (SELECT home_zip, count(*) AS student_count, count(DISTINCT class_id) AS class_count, count(DISTINCT instructor) AS instructor_count, CAST(max(reg_date) AS VARCHAR) AS latest_registration FROM v_student GROUP BY 1) a
 JOIN (SELECT home_zip, string_agg(course || ' (' || k || ')', '; ' ORDER BY rn) AS top_courses FROM (SELECT *, row_number() OVER (PARTITION BY home_zip ORDER BY k DESC, course) AS rn FROM (SELECT home_zip, course, count(*) AS k FROM v_student GROUP BY 1, 2)) WHERE rn <= 3 GROUP BY 1) b USING (home_zip)"""


@query("a34_local_demand", with_views("v_student", DEMAND))
def _(spark, sf):
    return O.local_demand(V.students(spark, sf))


extend("v_taught", """SELECT CASE WHEN user_id % 17 = 3 THEN 'Cancelled - hold' WHEN user_id % 17 = 5 THEN NULL ELSE 'Instructor ' || CAST(user_id % 300 AS VARCHAR) END AS instructor, event_id % 2003 AS class_id, lpad(CAST(user_id % 100 AS VARCHAR), 5, '0') AS home_zip,
 CASE event_id % 6 WHEN 0 THEN 'AHA BLS Provider' WHEN 1 THEN 'Red Cross CPR' WHEN 2 THEN 'arc basic life support' WHEN 3 THEN 'First Aid' WHEN 4 THEN 'bls' END AS discipline, CAST(ts AS DATE) AS reg_date FROM events""")
extend("v_roster", "SELECT 'INSTRUCTOR ' || CAST(s_suppkey AS VARCHAR) AS name, 'City ' || CAST(s_nationkey AS VARCHAR) AS city, 'S' || CAST(s_nationkey % 7 AS VARCHAR) AS state, lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS zip FROM supplier")


def taught(spark, sf):
    u, e = C("user_id"), C("event_id")
    disc = F.element_at(F.array(*[F.lit(x).cast("string") for x in ("AHA BLS Provider", "Red Cross CPR", "arc basic life support", "First Aid", "bls", None)]), (e % 6 + 1).cast("int"))
    return V.table(spark, sf, "events").select(
        F.when(u % 17 == 3, "Cancelled - hold").when(u % 17 != 5, F.concat(F.lit("Instructor "), (u % 300).cast("string"))).alias("instructor"), (e % 2003).alias("class_id"),
        F.lpad((u % 100).cast("string"), 5, "0").alias("home_zip"), disc.alias("discipline"), C("ts").cast("date").alias("reg_date"))


def roster(spark, sf):
    s = V.table(spark, sf, "supplier")
    return s.select(F.concat(F.lit("INSTRUCTOR "), C("s_suppkey").cast("string")).alias("name"), F.concat(F.lit("City "), C("s_nationkey").cast("string")).alias("city"),
                    F.concat(F.lit("S"), (C("s_nationkey") % 7).cast("string")).alias("state"), F.lpad(C("s_suppkey").cast("string"), 5, "0").alias("zip"))


TRACK = f"""SELECT a.*, r.city AS home_city, r.state AS home_state, r.zip AS home_zip, {R("students * 1.0 / nullif(classes, 0)", 1)} AS students_per_class, aha_bls_students > 0 AS teaches_aha, arc_bls_students + arc_cpr_students > 0 AS teaches_arc FROM (
 SELECT instructor, count(*) AS students, count(DISTINCT class_id) AS classes, count(DISTINCT home_zip) AS zips, count(CASE WHEN discipline IN ('AHA BLS Provider', 'bls') THEN 1 END) AS aha_bls_students, count(CASE WHEN discipline = 'arc basic life support' THEN 1 END) AS arc_bls_students,
  count(CASE WHEN discipline IN ('Red Cross CPR', 'First Aid') THEN 1 END) AS arc_cpr_students, CAST(max(reg_date) AS VARCHAR) AS last_taught FROM v_taught WHERE instructor LIKE 'Instructor%' GROUP BY 1) a LEFT JOIN v_roster r ON lower(a.instructor) = lower(r.name)"""
extend("track", TRACK, ["v_taught", "v_roster"])
PERF = f"""SELECT *, CASE WHEN performance_score >= 70 THEN 'Top Performer' WHEN performance_score >= 45 THEN 'Solid' WHEN performance_score >= 25 THEN 'Developing' ELSE 'Low' END AS performance_tier,
 CASE WHEN performance_score >= 95 THEN 'A+' WHEN performance_score >= 90 THEN 'A' WHEN performance_score >= 80 THEN 'B' WHEN performance_score >= 70 THEN 'C' WHEN performance_score >= 60 THEN 'D' ELSE 'E' END AS company_grade FROM (
 SELECT *, {R("45.0 * least(1.0, students / 500.0) + 25.0 * least(1.0, students_per_class / 8.0) + 15.0 * least(1.0, zips / 120.0) + 5.0 * (CASE WHEN aha_bls_students > 0 THEN 1 ELSE 0 END + CASE WHEN arc_bls_students > 0 THEN 1 ELSE 0 END + CASE WHEN arc_cpr_students > 0 THEN 1 ELSE 0 END)", 1)} AS performance_score,
  concat_ws(',', CASE WHEN aha_bls_students > 0 THEN 'AHA_BLS' END, CASE WHEN arc_bls_students > 0 THEN 'ARC_BLS' END, CASE WHEN arc_cpr_students > 0 THEN 'ARC_CPR_FA_AED' END) AS proven FROM track)"""
extend("perf", PERF, ["track"])


def perf(spark, sf):
    return O.performance(O.track_record(taught(spark, sf), roster(spark, sf)))


@query("a35_instructor_track_record", with_views("track", "SELECT * FROM track"))
def _(spark, sf):
    return O.track_record(taught(spark, sf), roster(spark, sf))


@query("j31_performance_with_home", with_views("track", "SELECT instructor, home_city, home_zip FROM track WHERE home_zip IS NOT NULL"))
def _(spark, sf):
    return O.track_record(taught(spark, sf), roster(spark, sf)).where("home_zip IS NOT NULL").select("instructor", "home_city", "home_zip")


@query("p17_discipline_course", with_views("v_taught", """SELECT discipline, CASE WHEN discipline IN ('AHA BLS Provider', 'bls') THEN 'AHA_BLS' WHEN discipline = 'arc basic life support' THEN 'ARC_BLS' WHEN discipline IS NOT NULL THEN 'ARC_CPR_FA_AED' END AS course, count(*) AS students FROM v_taught GROUP BY 1, 2"""))
def _(spark, sf):
    return taught(spark, sf).groupBy("discipline", O.discipline_course(C("discipline")).alias("course")).agg(F.count("*").alias("students"))


@query("p19_real_instructor", with_views("v_taught", "SELECT coalesce(instructor LIKE 'Instructor%', false) AS real, count(*) AS students FROM v_taught GROUP BY 1"))
def _(spark, sf):
    return taught(spark, sf).groupBy(O.is_real_instructor(C("instructor")).alias("real")).agg(F.count("*").alias("students"))


@query("p33_instructor_performance", with_views("perf", "SELECT instructor, performance_score, performance_tier, company_grade, proven FROM perf"))
def _(spark, sf):
    return perf(spark, sf).select("instructor", "performance_score", "performance_tier", "company_grade", joined(C("proven")).alias("proven"))


@query("p32_proven_courses", with_views("perf", "SELECT proven, count(*) AS instructors FROM perf GROUP BY 1"))
def _(spark, sf):
    return perf(spark, sf).groupBy(joined(C("proven")).alias("proven")).agg(F.count("*").alias("instructors"))


@query("k05_top_performers", with_views("perf", "SELECT instructor, performance_score FROM perf WHERE proven LIKE '%ARC_BLS%' ORDER BY 2 DESC, 1 LIMIT 10"))
def _(spark, sf):
    return perf(spark, sf).where(F.array_contains("proven", "ARC_BLS")).orderBy(C("performance_score").desc(), "instructor").limit(10).select("instructor", "performance_score")


@query("a51_winning_profile", with_views("perf", f"""SELECT count(*) AS sample, {R('median(students)', 1)} AS median_students, {R('median(students_per_class)', 1)} AS median_class_size, {R('median(zips)', 1)} AS median_zips, count(CASE WHEN teaches_aha THEN 1 END) AS teach_aha, count(CASE WHEN teaches_arc THEN 1 END) AS teach_arc
 FROM (SELECT * FROM perf WHERE proven LIKE '%AHA_BLS%' ORDER BY performance_score DESC, instructor LIMIT 25)"""))
def _(spark, sf):
    return O.winning_profile(perf(spark, sf), "AHA_BLS", 25)


@query("c33_sourcing_plan", with_views("perf", """SELECT lane, instructor, near, performance_score, CAST(rn AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY near DESC, performance_score DESC, instructor) AS rn FROM (
 SELECT *, coalesce(home_state = 'S3', false) OR coalesce(substr(home_zip, 1, 3) = '000', false) AS near, CASE WHEN proven LIKE '%AHA_BLS%' THEN 'activate' WHEN proven <> '' THEN 'bridge' END AS lane FROM perf) WHERE lane IS NOT NULL) WHERE rn <= 12"""))
def _(spark, sf):
    return O.sourcing_plan(perf(spark, sf), "AHA_BLS", F.lit("S3"), F.lit("000"), 12).select("lane", "instructor", "near", "performance_score", "position")


@query("m49_eligible_or_bridge", with_views("perf", "SELECT instructor, proven LIKE '%ARC_BLS%' AS eligible, NOT proven LIKE '%ARC_BLS%' AND proven LIKE '%AHA_BLS%' AS bridge FROM perf"))
def _(spark, sf):
    return perf(spark, sf).select("instructor", F.array_contains("proven", "ARC_BLS").alias("eligible"), O.can_bridge("ARC_BLS").alias("bridge"))


# --- site health and coverage ------------------------------------------------------------

SN = {"monthly_avg_revenue": (0, 173, 3000, 1, 5), "raw_gap": (-500, 61, 1500, 1, 2), "period_net_profit": (-400, 83, 900, 1, 3)}
SL = {"health_status": ["critical", " Strong", "stable", None, "LEAKAGE", "nonsense", "WATCH"]}
SB = {"active": [True, True, False]}
extend("v_site", f"SELECT s_suppkey AS site_id, s_name AS site_name, {derived_sql(SN, SL, SB)}, CAST(37000 + k * 3001 % 600 AS DOUBLE) / 1000 AS s_lat, CAST(-122300 + k * 7001 % 600 AS DOUBLE) / 1000 AS s_lng FROM (SELECT *, s_suppkey AS k FROM supplier)")
HEALTH = f"""SELECT *, health IN ('CRITICAL','LEAKAGE') AS is_weak, health = 'STRONG' AS is_strong, concat_ws(',', CASE WHEN health = 'LEAKAGE' THEN 'leakage' END, CASE WHEN health = 'CRITICAL' THEN 'critical' END, CASE WHEN break_even_gap < 0 THEN 'below_break_even' END,
 CASE WHEN monthly_avg_revenue >= 1067 AND period_net_profit < 0 THEN 'period_net_loss' END) AS warnings FROM (SELECT *, CASE WHEN upper(trim(health_status)) IN ('CRITICAL','WATCH','STABLE','STRONG','LEAKAGE') THEN upper(trim(health_status)) ELSE 'WATCH' END AS health,
 coalesce(raw_gap, {R('monthly_avg_revenue - 1067', 2)}) AS break_even_gap FROM v_site)"""
extend("health", HEALTH, ["v_site"])


def sites(spark, sf):
    k = C("s_suppkey")
    return V.table(spark, sf, "supplier").select(
        k.alias("site_id"), C("s_name").alias("site_name"), *[v.alias(x) for x, v in derived_columns(k, SN, SL, SB).items()],
        ((37000 + k * 3001 % 600).cast("double") / 1000.0).alias("s_lat"), ((-122300 + k * 7001 % 600).cast("double") / 1000.0).alias("s_lng"))


def health(spark, sf):
    return O.site_health(sites(spark, sf).withColumnRenamed("raw_gap", "break_even_gap"))


@query("p31_site_health", with_views("health", "SELECT site_id, health AS health_status, break_even_gap, is_weak, is_strong, warnings FROM health"))
def _(spark, sf):
    return health(spark, sf).select("site_id", "health_status", "break_even_gap", "is_weak", "is_strong", "warnings")


@query("a39_health_summary", with_views("health", "SELECT s AS health_status, count(h.site_id) AS sites, count(CASE WHEN is_weak THEN 1 END) AS at_risk FROM (VALUES ('CRITICAL'),('WATCH'),('STABLE'),('STRONG'),('LEAKAGE')) v(s) LEFT JOIN health h ON h.health = s GROUP BY 1"))
def _(spark, sf):
    all_ = V.table(spark, sf, "region").agg(F.count("*").alias("c")).select(F.explode(F.array(*[F.lit(s) for s in O.STATUSES])).alias("health_status"))  # one row, then the fixed list
    counts = health(spark, sf).groupBy("health_status").agg(F.count("*").alias("c"), F.count_if("is_weak").alias("w"))
    return all_.join(counts, "health_status", "left").select("health_status", F.coalesce("c", F.lit(0)).alias("sites"), F.coalesce("w", F.lit(0)).alias("at_risk"))


_nr = lambda cond: f"SELECT zip, site_id, is_weak, is_strong, {R('d', 1)} AS d FROM (SELECT z.zip, h.*, {HAV('z.lat', 'z.lng', 's_lat', 's_lng', 3958.7613)} AS d, row_number() OVER (PARTITION BY zip ORDER BY {HAV('z.lat', 'z.lng', 's_lat', 's_lng', 3958.7613)}, site_id) AS rn FROM v_centroid z CROSS JOIN health h WHERE {cond}) WHERE rn = 1"


@query("j28_site_coverage", with_views("v_centroid health", """SELECT a.zip, a.site_id AS active_site, a.d AS active_site_miles, i.site_id AS inactive_site, i.d AS inactive_site_miles, a.d <= 6 AS covered,
 CASE WHEN a.d > 15 THEN 'OPEN_TEST_OK' WHEN a.d <= 6 THEN CASE WHEN a.is_weak THEN 'FIX_CURRENT_FIRST' ELSE 'USE_EXISTING_SITE' END WHEN a.d <= 12 AND a.is_strong THEN 'CANNIBALIZATION_RISK' WHEN a.d <= 12 AND a.is_weak THEN 'FIX_CURRENT_FIRST' ELSE 'OPEN_TEST_OK' END AS coverage_decision
 FROM act a JOIN ina i ON a.zip = i.zip""", act=_nr("h.active"), ina=_nr("NOT h.active")))
def _(spark, sf):
    return O.coverage(V.centroids(spark, sf), health(spark, sf)).select("zip", "active_site", "active_site_miles", "inactive_site", "inactive_site_miles", "covered", "coverage_decision")


@query("j30_nearest_site_health", with_views("v_centroid health", "SELECT n.zip, n.site_id, n.d AS miles, h.health AS health_status FROM n JOIN health h ON n.site_id = h.site_id", n=_nr("true")))
def _(spark, sf):
    from demandgrid.operators.geo import nearest
    z, h = V.centroids(spark, sf), health(spark, sf)
    hit = nearest(z, "lat", "lng", h, "site_id", "s_lat", "s_lng", 100.0)
    return z.join(hit, ["lat", "lng"]).join(h.select("site_id", "health_status"), "site_id").select("zip", "site_id", rnd(C("distance"), 1).alias("miles"), "health_status")


# --- leads, rooms --------------------------------------------------------------------------

LN = {"distance_miles": (0, 37, 400, 10, 7), "travel_radius_miles": (0, 11, 40, 1, 4)}
LL = {"credential_status": ["VERIFIED", "NEEDS_VERIFICATION", "SIGNAL_ONLY", None, "EXPIRED", "NEEDS_VERIFICATION", "REJECTED"],
      "outreach_status": ["NEW", "CONTACTED", "CONFIRMED", None, "AVAILABLE", "REJECTED", "NEW", "NEW", "INTERESTED", "NEW", "NEW"],
      "source": ["roster_import", "live_search", "zip_enrichment_signal", "past_instructor", "live_search"], "organization": ["AHA instructor network", "", "City CPR School", None],
      "signals": ["bls instructor", None, "nursing faculty", "paramedic", "yoga"], "interest": ["YES", "MAYBE", "NO", None], "performance_tier": ["Top Performer", None, "Solid"]}
LB = {"contactable": [True, False, True], "past_instructor": [None, False, True, False, None, False, False, False, False]}
extend("v_lead", f"SELECT c_custkey AS lead_id, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE c_name END AS name, lpad(CAST(c_custkey % 100 AS VARCHAR), 5, '0') AS zip, CASE c_custkey % 3 WHEN 0 THEN 'AHA_BLS' WHEN 1 THEN 'ARC_BLS' ELSE 'ARC_CPR_FA_AED' END AS course, {derived_sql(LN, LL, LB)} FROM (SELECT *, c_custkey AS k FROM customer)")


def leads(spark, sf):
    k = C("c_custkey")
    df = V.table(spark, sf, "customer").select(
        k.alias("lead_id"), F.when(k % 13 == 0, "").otherwise(C("c_name")).alias("name"), F.lpad((k % 100).cast("string"), 5, "0").alias("zip"),
        F.element_at(F.array(F.lit("AHA_BLS"), F.lit("ARC_BLS"), F.lit("ARC_CPR_FA_AED")), (k % 3 + 1).cast("int")).alias("course"), *[v.alias(x) for x, v in derived_columns(k, LN, LL, LB).items()])
    return df.withColumns({"courses_possible": F.array("course"), "proven": F.when(C("past_instructor"), F.array("course"))})


LEVEL = """CASE WHEN upper(outreach_status) = 'CONFIRMED' THEN 6 WHEN credential_status = 'VERIFIED' OR outreach_status IN ('CREDENTIAL_VERIFIED','AVAILABLE') THEN 5 WHEN outreach_status IN ('CONTACTED','REPLIED','INTERESTED') THEN 4
 WHEN coalesce(past_instructor, false) OR source IN ('past_instructor','enrollment_performance') THEN 3 WHEN source = 'zip_enrichment_signal' OR credential_status = 'SIGNAL_ONLY' THEN 1 WHEN trim(name) <> '' THEN 2 ELSE 1 END"""
_hay = "lower(concat_ws(' ', coalesce(signals, ''), coalesce(organization, '')))"
CONF = R(CLAMP(f"""CAST(CASE credential_status WHEN 'VERIFIED' THEN 40 WHEN 'NEEDS_VERIFICATION' THEN 22 WHEN 'SIGNAL_ONLY' THEN 8 WHEN 'EXPIRED' THEN 10 ELSE 0 END
 + CASE WHEN regexp_matches({_hay}, 'bls|cpr|aha instructor') THEN 20 WHEN regexp_matches({_hay}, 'aha|paramedic|nursing|emt|acls|pals|first aid|red cross|american heart') THEN 10 ELSE 0 END + CASE WHEN source = 'roster_import' THEN 15 ELSE 0 END
 + CASE WHEN distance_miles IS NULL THEN 0 WHEN distance_miles <= 10 THEN 12 WHEN distance_miles <= coalesce(nullif(travel_radius_miles, 0), 20) THEN 7 ELSE -10 END + CASE WHEN contactable THEN 8 ELSE 0 END + CASE WHEN coalesce(organization, '') <> '' THEN 5 ELSE 0 END
 + CASE interest WHEN 'YES' THEN 8 WHEN 'MAYBE' THEN 4 WHEN 'NO' THEN -8 ELSE 0 END AS DOUBLE)"""), 1)
CONF = f"CASE WHEN credential_status = 'REJECTED' THEN 0.0 ELSE {CONF} END"


def graded(spark, sf):
    return O.stages(leads(spark, sf), {"lead_level": O.lead_level(), "confidence_score": O.lead_confidence()})


@query("p34_lead_level", with_views("v_lead", f"SELECT lead_id, CAST({LEVEL} AS INT) AS lead_level FROM v_lead"))
def _(spark, sf):
    return leads(spark, sf).select("lead_id", O.lead_level().alias("lead_level"))


@query("m47_lead_confidence", with_views("v_lead", f"SELECT lead_id, {CONF} AS confidence_score FROM v_lead"))
def _(spark, sf):
    return leads(spark, sf).select("lead_id", O.lead_confidence().alias("confidence_score"))


MATCH = R(CLAMP("""CAST(CASE lv WHEN 1 THEN 12 WHEN 2 THEN 30 WHEN 3 THEN 58 WHEN 4 THEN 65 WHEN 5 THEN 85 ELSE 100 END + CASE WHEN distance_miles IS NULL THEN 0 WHEN distance_miles <= 10 THEN 8 WHEN distance_miles <= 20 THEN 3 ELSE -12 END
 + CASE WHEN past_instructor AND course = 'ARC_BLS' THEN 8 WHEN course = 'ARC_BLS' THEN 4 ELSE -6 END + CASE performance_tier WHEN 'Top Performer' THEN 6 WHEN 'Solid' THEN 3 ELSE 0 END + CASE WHEN contactable THEN 4 ELSE 0 END AS DOUBLE)"""), 1)


@query("m48_match_score", with_views("v_lead", f"SELECT lead_id, {MATCH} AS match_score FROM (SELECT *, {LEVEL} AS lv FROM v_lead)"))
def _(spark, sf):
    return graded(spark, sf).select("lead_id", O.match_score("ARC_BLS").alias("match_score"))


@query("k07_lead_order", with_views("v_lead", f"SELECT zip, lead_id, CAST(rn AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY zip ORDER BY lv DESC, ms DESC, coalesce(distance_miles, 9999), lead_id) AS rn FROM (SELECT *, {MATCH} AS ms FROM (SELECT *, {LEVEL} AS lv FROM v_lead))) WHERE rn <= 8"))
def _(spark, sf):
    g = graded(spark, sf).withColumn("ms", O.match_score("ARC_BLS"))
    return top_per(g, ["zip"], [C("lead_level").desc(), C("ms").desc(), F.coalesce(C("distance_miles"), F.lit(9999.0)), C("lead_id")], 8, "position").select("zip", "lead_id", "position")


@query("k04_top_leads", with_views("v_lead", f"SELECT zip, course, lead_id, CAST(rn AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY zip, course ORDER BY cf DESC, lead_id) AS rn FROM (SELECT *, {CONF} AS cf FROM v_lead)) WHERE rn <= 5"))
def _(spark, sf):
    return top_per(graded(spark, sf), ["zip", "course"], [C("confidence_score").desc(), C("lead_id")], 5, "position").select("zip", "course", "lead_id", "position")


@query("k08_contactable_first", with_views("v_lead", "SELECT zip, lead_id, CAST(rn AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY zip ORDER BY contactable DESC, coalesce(regexp_matches(signals, 'bls|nursing'), false) DESC, coalesce(distance_miles, 999), lead_id) AS rn FROM v_lead) WHERE rn <= 3"))
def _(spark, sf):
    strong = F.coalesce(C("signals").rlike("bls|nursing"), F.lit(False))
    return top_per(leads(spark, sf), ["zip"], [C("contactable").desc(), strong.desc(), F.coalesce(C("distance_miles"), F.lit(999.0)), C("lead_id")], 3, "position").select("zip", "lead_id", "position")


_near = "coalesce(distance_miles <= coalesce(nullif(travel_radius_miles, 0), 20), true)"
_ok = "coalesce(outreach_status <> 'REJECTED', true) AND coalesce(credential_status <> 'REJECTED', true)"
IREADY = f"""SELECT *, CASE WHEN confirmed > 0 THEN 100.0 WHEN roster_nearby > 0 THEN 80.0 WHEN strong_named > 0 THEN 65.0 WHEN signals >= 2 THEN 50.0 WHEN signals > 0 OR named > 0 THEN 25.0 ELSE 0.0 END::DOUBLE AS score,
 CASE WHEN confirmed > 0 THEN 'Confirmed' WHEN named > 0 OR roster_nearby > 0 THEN 'Candidate Found' WHEN signals > 0 THEN 'Signal Only' WHEN usable = 0 THEN 'Blocked' ELSE 'No Signal' END AS stage FROM (
 SELECT {{k}}, count(CASE WHEN {_ok} AND credential_status = 'VERIFIED' AND outreach_status IN ('CONFIRMED','AVAILABLE','CREDENTIAL_VERIFIED') AND {_near} THEN 1 END) AS confirmed, count(CASE WHEN {_ok} AND source = 'roster_import' AND {_near} THEN 1 END) AS roster_nearby,
  count(CASE WHEN nm THEN 1 END) AS named, count(CASE WHEN nm AND cf >= 40 THEN 1 END) AS strong_named, count(CASE WHEN {_ok} AND credential_status = 'SIGNAL_ONLY' THEN 1 END) AS signals, count(CASE WHEN {_ok} THEN 1 END) AS usable
 FROM (SELECT *, {CONF} AS cf, {_ok} AND credential_status IN ('NEEDS_VERIFICATION','VERIFIED') AND name <> '' AND {_near} AS nm FROM v_lead) GROUP BY {{k}})"""


@query("a49_instructor_readiness", with_views("v_lead", "SELECT zip, course, score, stage, confirmed, roster_nearby, named, signals FROM (" + IREADY.format(k="zip, course") + ")"))
def _(spark, sf):
    return O.instructor_readiness(graded(spark, sf), ["zip", "course"]).select("zip", "course", "score", "stage", "confirmed", "roster_nearby", "named", "signals")


@query("c34_signals_as_leads", with_views("v_zip", " UNION ALL ".join(f"SELECT zip, '{v}' AS candidate_type, CAST({k} AS INT) AS institutions FROM v_zip WHERE {k} >= 1" for k, v in {
    "nursing_school_count": "NURSING_PROFESSOR", "training_school_count": "EMT_INSTRUCTOR", "health_program_school_count": "UNKNOWN_HEALTHCARE_TRAINER", "hospital_count": "HOSPITAL_EDUCATOR", "competitor_count": "CPR_BUSINESS_OWNER"}.items())))
def _(spark, sf):
    return O.zip_signals_as_leads(zips(spark, sf))


RN = {"capacity": (0, 7, 30, 1, 4), "hourly_rate": (10, 13, 90, 1, 3), "daily_rate": (100, 17, 400, 1, 2)}
RL = {"floor_space_notes": ["open floor for manikins", None, "fixed seating", "clear space", ""], "parking_notes": ["free lot", "street only", None, "garage"], "cancellation_policy": [None, "24h", " "],
      "notes": [None, "landlord refused", "nice", "", "quiet", "bright", "calm", "good", "ok", "fine", "unsafe at dusk"], "outreach_status": ["NEW", "GOOD_FIT", "TOO_EXPENSIVE", "CONFIRMED", "NEW", "REJECTED", "NEW"],
      "source": ["locations_import", "zip_enrichment_signal", "commercial_validation_csv"]}
RB = {"training_use_allowed": [None, True, True, True, True, True, False], "access_control_possible": [None, True, None, True, None, True, None, False], "camera_allowed": [None, True], "wifi": [True, None, True, True, True, True, True, True, False],
      "recurring_available": [None, True, True, None, True, True, True, True, True, False], "movable_tables_chairs": [True, None, False], "weekend_available": [None, True], "evening_available": [True, False, None],
      "restroom_access": [True, None], "ada_access": [None, False, True]}
extend("v_room", f"SELECT p_partkey AS room_id, lpad(CAST(p_partkey % 100 AS VARCHAR), 5, '0') AS zip, {derived_sql(RN, RL, RB)} FROM (SELECT *, p_partkey AS k FROM part)")


def rooms(spark, sf):
    k = C("p_partkey")
    return V.table(spark, sf, "part").select(k.alias("room_id"), F.lpad((k % 100).cast("string"), 5, "0").alias("zip"), *[v.alias(x) for x, v in derived_columns(k, RN, RL, RB).items()])


_nt = "lower(concat_ws(' ', coalesce(notes, ''), coalesce(floor_space_notes, ''), coalesce(parking_notes, '')))"
RFLAGS = f"""concat_ws(',', CASE WHEN NOT training_use_allowed THEN 'training_not_allowed' END, CASE WHEN NOT access_control_possible THEN 'no_access_control' END, CASE WHEN NOT camera_allowed THEN 'no_camera' END, CASE WHEN NOT wifi THEN 'bad_wifi' END, CASE WHEN NOT recurring_available THEN 'no_recurring' END,
 CASE WHEN regexp_matches({_nt}, 'unsafe|no lighting|sketchy at night') THEN 'unsafe_entry' END, CASE WHEN regexp_matches({_nt}, 'uncooperative|landlord refused|hostile') THEN 'uncooperative' END, CASE WHEN regexp_matches({_nt}, 'unsuitable|no open floor|fixed seating|pillars block|too small') THEN 'room_unsuitable' END)"""
_pt = lambda c, v: f"CASE WHEN {c} THEN {v} ELSE 0 END"
ROOM = f"""SELECT *, CASE WHEN eliminations <> '' THEN 0.0 ELSE {R(CLAMP('CAST(s AS DOUBLE)'), 1)} END AS classroom_fit_score, {R('least(100.0, kn * 10)', 1)} AS confidence_score FROM (SELECT *, {RFLAGS} AS eliminations,
 {_pt('capacity >= 8', 15)} + {_pt("regexp_matches(lower(floor_space_notes), 'open floor|manikin|movable|flexible|clear space')", 12)} + {' + '.join(_pt(k, v) for k, v in O.ROOM_FACTS.items())}
 + CASE WHEN regexp_matches(lower(parking_notes), 'free|lot|ample|garage|available|good') THEN 6 WHEN lower(parking_notes) LIKE '%street%' THEN 2 ELSE 0 END + CASE WHEN hourly_rate <= 60 THEN 7 WHEN hourly_rate > 60 THEN -8 WHEN daily_rate <= 300 THEN 7 WHEN daily_rate > 300 THEN -8 ELSE 0 END + {_pt("trim(cancellation_policy) <> ''", 3)} AS s,
 {' + '.join(_pt(c, 1) for c in ['capacity IS NOT NULL', "floor_space_notes <> ''", "parking_notes <> ''", 'coalesce(hourly_rate, daily_rate) IS NOT NULL', "trim(cancellation_policy) <> ''"] + [f'{k} IS NOT NULL' for k in O.ROOM_FACTS])} AS kn FROM v_room)"""
extend("room", ROOM, ["v_room"])


def fitted(spark, sf):
    return O.room_fit(rooms(spark, sf), 8.0, 60.0, 300.0)


@query("m50_room_fit", with_views("room", "SELECT room_id, classroom_fit_score, confidence_score, eliminations FROM room"))
def _(spark, sf):
    return fitted(spark, sf).select("room_id", "classroom_fit_score", "confidence_score", "eliminations")


@query("f11_hard_elimination", with_views("room", "SELECT eliminations, count(*) AS rooms FROM room GROUP BY 1"))
def _(spark, sf):
    return rooms(spark, sf).groupBy(joined(O.room_flags()).alias("eliminations")).agg(F.count("*").alias("rooms"))


_rok = "eliminations = '' AND outreach_status <> 'REJECTED'"
RREADY = f"""SELECT *, CASE WHEN confirmed > 0 THEN 100.0 WHEN likely >= 2 THEN 80.0 WHEN named_rooms > 0 THEN 60.0 WHEN limited > 0 THEN 40.0 WHEN signals > 0 THEN 20.0 ELSE 0.0 END::DOUBLE AS score,
 CASE WHEN confirmed > 0 THEN 'Confirmed' WHEN named_rooms > 0 THEN 'Candidate Found' WHEN signals > 0 THEN 'Signal Only' WHEN eliminated = pool THEN 'Blocked' ELSE 'No Signal' END AS stage FROM (
 SELECT zip, count(CASE WHEN {_rok} AND (outreach_status = 'CONFIRMED' OR (outreach_status = 'GOOD_FIT' AND recurring_available)) THEN 1 END) AS confirmed, count(CASE WHEN {_rok} AND classroom_fit_score >= 55 THEN 1 END) AS likely,
  count(CASE WHEN {_rok} AND source <> 'zip_enrichment_signal' THEN 1 END) AS named_rooms, count(CASE WHEN {_rok} AND outreach_status IN ('TOO_EXPENSIVE','NO_WEEKEND_ACCESS','BAD_FLOOR_SPACE') THEN 1 END) AS limited, count(CASE WHEN {_rok} AND source = 'zip_enrichment_signal' THEN 1 END) AS signals,
  count(*) - count(CASE WHEN {_rok} THEN 1 END) AS eliminated, count(*) AS pool FROM room GROUP BY 1)"""


@query("a50_room_readiness", with_views("room", f"SELECT zip, score, stage, confirmed, likely, named_rooms, eliminated FROM ({RREADY})"))
def _(spark, sf):
    return O.room_readiness(fitted(spark, sf), ["zip"]).select("zip", "score", "stage", "confirmed", "likely", "named_rooms", "eliminated")


CN = {"monthly_rent": (800, 37, 3000, 1, 4)}
CL = {"available": ["yes", "no", None, "Available"], "parking": ["Yes", "none", None, "ample", "no"], "classroom_fit": ["good", "possible", None, "poor", "", "bad", "bad"], "updated_at": ["2024-01-05", "", "2023-12-31", None]}
extend("v_space", f"SELECT p_partkey AS space_id, lpad(CAST(p_partkey % 700 AS VARCHAR), 5, '0') AS zip, {derived_sql(CN, CL, {})} FROM (SELECT *, p_partkey AS k FROM part)")
COMM = f"""SELECT *, available_space_count > 0 AND parking_summary IN ('Yes','Mixed') AND classroom_fit_summary IN ('Good','Possible') AS commercial_ready FROM (SELECT zip, count(*) AS space_count, count(CASE WHEN lower(available) IN ('yes','available') THEN 1 END) AS available_space_count,
 min(monthly_rent) AS rent_min, max(monthly_rent) AS rent_max, {R('avg(monthly_rent)', 0)} AS rent_avg, max(nullif(updated_at, '')) AS updated_at,
 CASE WHEN count(nullif(parking, '')) = 0 THEN 'Unknown' WHEN count(CASE WHEN lower(parking) IN ('yes','ample') THEN 1 END) = count(nullif(parking, '')) THEN 'Yes' WHEN count(CASE WHEN lower(parking) IN ('yes','ample') THEN 1 END) = 0 THEN 'No' ELSE 'Mixed' END AS parking_summary,
 CASE WHEN count(nullif(classroom_fit, '')) = 0 THEN 'Unknown' WHEN count(CASE WHEN classroom_fit = 'good' THEN 1 END) > 0 THEN 'Good' WHEN count(CASE WHEN classroom_fit = 'possible' THEN 1 END) > 0 THEN 'Possible' ELSE 'Limited' END AS classroom_fit_summary FROM v_space GROUP BY 1)"""


def commercial(spark, sf):
    k = C("p_partkey")
    return O.commercial_summary(V.table(spark, sf, "part").select(F.lpad((k % 700).cast("string"), 5, "0").alias("zip"), *[v.alias(x) for x, v in derived_columns(k, CN, CL, {}).items()]))


@query("a37_commercial_summary", with_views("v_space", COMM))
def _(spark, sf):
    return commercial(spark, sf)


@query("j08_commercial_on_zips", with_views("v_space v_zip", f"SELECT z.zip, c.commercial_ready, c.rent_avg FROM v_zip z LEFT JOIN ({COMM}) c ON z.zip = c.zip"))
def _(spark, sf):
    return zips(spark, sf).select("zip").join(commercial(spark, sf).select("zip", "commercial_ready", "rent_avg"), "zip", "left")


@query("c09_commercial_enrichment", with_views("v_space v_zip", f"SELECT z.zip, c.available_space_count > 0 AS commercial_space_available, c.rent_avg AS estimated_rent FROM v_zip z JOIN ({COMM}) c ON z.zip = c.zip"))
def _(spark, sf):
    return zips(spark, sf).select("zip").join(commercial(spark, sf), "zip").select("zip", (C("available_space_count") > 0).alias("commercial_space_available"), C("rent_avg").alias("estimated_rent"))


# --- economics and readiness ------------------------------------------------------------------

_var = R("card + 27.0 + 0.03 * price", 2)
UNIT = f"""SELECT *, {R('1070.0 / contribution', 1)} AS break_even_students, {R('100.0 * contribution / price', 1)} AS contribution_pct FROM (SELECT *, {R(f'price - {_var} - 45.0 / 7', 2)} AS contribution, {_var} AS variable_cost FROM (
 SELECT zip, course, coalesce(CASE WHEN course = 'ARC_CPR_FA_AED' THEN cpr ELSE bls END, dp)::DOUBLE AS price, card, CASE WHEN (CASE WHEN course = 'ARC_CPR_FA_AED' THEN cpr ELSE bls END) IS NOT NULL THEN 'competitor_median' ELSE 'default' END AS price_source
 FROM v_zip LEFT JOIN (SELECT zip, max(CASE WHEN course_type = 'BLS' THEN mp END) AS bls, max(CASE WHEN course_type = 'CPR' THEN mp END) AS cpr FROM (SELECT zip, course_type, median(CASE WHEN CAST(zip AS INT) % 4 > 0 THEN price END) AS mp FROM v_supply GROUP BY 1, 2) GROUP BY 1) m USING (zip)
 CROSS JOIN (VALUES ('AHA_BLS', 95.0, 25.0), ('ARC_BLS', 85.0, 20.0), ('ARC_CPR_FA_AED', 75.0, 18.0)) c(course, dp, card)))"""


def few_supply(spark, sf):
    """All supply; every fourth ZIP lists no prices, so the default price is used there."""
    return O.competitor_supply(supply_rows(spark, sf).withColumn("price", F.when(C("zip").cast("int") % 4 > 0, C("price"))))


@query("m51_unit_economics", """WITH p AS (SELECT DISTINCT CAST(40 + l_partkey % 90 AS DOUBLE) AS price FROM lineitem) SELECT price, variable_cost, contribution, CASE WHEN contribution > 0 THEN """ + R("1070.0 / contribution", 1) + """ END AS break_even_students, """ + R("100.0 * contribution / price", 1)
       + " AS contribution_pct, CASE WHEN contribution > 0 THEN " + R(R("1070.0 / contribution", 1) + " / 7", 1) + " END AS break_even_classes FROM (SELECT *, " + R("price - variable_cost - 45.0 / 7", 2) + " AS contribution FROM (SELECT price, " + R("20.0 + 27.0 + 0.03 * price", 2) + " AS variable_cost FROM p))")
def _(spark, sf):
    p = supply_rows(spark, sf).where("price IS NOT NULL").select("price").distinct().withColumns({"card_cost": F.lit(20.0), "instructor_cost": F.lit(45.0)})
    return O.unit_economics(p).select("price", "variable_cost", "contribution", "break_even_students", "contribution_pct", "break_even_classes")


@query("m52_monthly_pnl", with_views("v_student", f"""SELECT home_zip, students, {R('85.0 * students', 2)} AS revenue, {R('85.0 * students - cost', 2)} AS net_profit, {R('100.0 * (85.0 * students - cost) / (85.0 * students)', 1)} AS net_margin_pct FROM (
 SELECT *, 20.0 * students + 27.0 * students + 0.03 * 85.0 * students + 45.0 * students / 7 + 1070.0 AS cost FROM (SELECT home_zip, count(*) AS students FROM v_student GROUP BY 1))"""))
def _(spark, sf):
    v = V.students(spark, sf).groupBy("home_zip").agg(F.count("*").alias("students")).withColumns({"price": F.lit(85.0), "card_cost": F.lit(20.0), "instructor_cost": F.lit(45.0)})
    return O.monthly_pnl(v).select("home_zip", "students", "revenue", "net_profit", "net_margin_pct")


SECON = f"""SELECT b.zip, course AS easiest_course, break_even_students, {R('sc / 6.0', 1)} AS per_month, round_even(100.0 * {R('sc / 6.0', 1)} / break_even_students, 0) AS demand_vs_break_even_pct, {R('sc / 6.0', 1)} >= break_even_students AS clears_break_even, {R('sc / 6.0', 1)} >= 108 AS meets_company_target
 FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zip ORDER BY break_even_students, course) AS rn FROM ({UNIT}) WHERE contribution > 0) WHERE rn = 1) b LEFT JOIN (SELECT home_zip, count(*) AS sc FROM v_student GROUP BY 1) d ON b.zip = d.home_zip"""
extend("secon", SECON, ["v_zip", "v_supply", "v_student"])


@query("m53_site_economics", with_views("secon", "SELECT * FROM secon"))
def _(spark, sf):
    return O.site_economics(zips(spark, sf), few_supply(spark, sf), O.local_demand(V.students(spark, sf)))


@query("m57_posting_urgency", with_views("secon v_lead", f"""SELECT s.zip, CASE WHEN p >= 3 THEN 'high' WHEN p >= 1 THEN 'medium' ELSE 'low' END AS priority FROM (SELECT e.zip, CASE WHEN i.score < 50 THEN 2 WHEN i.score < 80 THEN 1 ELSE 0 END + CASE WHEN demand_vs_break_even_pct >= 100 THEN 2 WHEN demand_vs_break_even_pct >= 40 THEN 1 ELSE 0 END + CASE WHEN per_month * 6 >= 20 THEN 1 ELSE 0 END AS p
 FROM secon e LEFT JOIN ({IREADY.format(k="zip")}) i ON e.zip = i.zip) s"""))
def _(spark, sf):
    e = O.site_economics(zips(spark, sf), few_supply(spark, sf), O.local_demand(V.students(spark, sf)))
    i = O.instructor_readiness(graded(spark, sf), ["zip"]).select("zip", "score")
    return e.join(i, "zip", "left").select("zip", O.posting_urgency(C("score"), C("demand_vs_break_even_pct"), C("per_month") * 6).alias("priority"))


READY = f"""SELECT *, {R(CLAMP('demand * w0 + instructor_score * w1 + room_score * w2 + coalesce(proof, 50.0) * w3 - pen'), 1)} AS feasibility FROM (
 SELECT z.zip, c.course, w0, w1, w2, w3, coalesce(i.score, 0) AS instructor_score, coalesce(r.score, 0) AS room_score, CASE WHEN historical_status = 'has_history' THEN coalesce(proven_aha_bls_score, 75.0) END AS proof,
  CASE WHEN demand_score IS NOT NULL AND t IS NOT NULL THEN {R('0.5 * demand_score + 0.5 * t', 1)} ELSE coalesce(demand_score, t) END AS demand, CASE WHEN pct < 100 THEN {R('(1 - greatest(0.0, pct / 100.0)) * 15', 1)} ELSE 0 END AS pen, CAST(z.zip AS INT) % 9 AS wk, CAST(z.zip AS INT) % 14 AS tot
 FROM (SELECT m.*, e.demand_vs_break_even_pct AS pct FROM modeled m LEFT JOIN secon e ON m.zip = e.zip) z
 CROSS JOIN LATERAL (SELECT course, w0, w1, w2, w3, CASE course WHEN 'OVERALL' THEN NULL WHEN 'ARC_CPR_FA_AED' THEN z.cpr_demand ELSE z.bls_demand END AS t FROM (VALUES ('OVERALL', 0.40, 0.25, 0.25, 0.10), ('ARC_BLS', 0.40, 0.25, 0.25, 0.10), ('ARC_CPR_FA_AED', 0.40, 0.25, 0.25, 0.10), ('AHA_BLS', 0.35, 0.40, 0.15, 0.10)) q(course, w0, w1, w2, w3)) c
 LEFT JOIN ({IREADY.format(k="zip")}) i ON z.zip = i.zip LEFT JOIN ({RREADY}) r ON z.zip = r.zip)"""


def QREADY(spark, sf):
    """Readiness of every ZIP and course view."""
    e = O.site_economics(zips(spark, sf), few_supply(spark, sf), O.local_demand(V.students(spark, sf))).select("zip", "demand_vs_break_even_pct")
    i = O.instructor_readiness(graded(spark, sf), ["zip"]).select("zip", C("score").alias("instructor_score"))
    r = O.room_readiness(fitted(spark, sf), ["zip"]).select("zip", C("score").alias("room_score"))
    z = model(spark, sf).join(e, "zip", "left").join(i, "zip", "left").join(r, "zip", "left")
    k = C("zip").cast("int")
    z = z.withColumns({"base_demand": C("demand_score"), "instructor_score": F.coalesce("instructor_score", F.lit(0.0)), "room_score": F.coalesce("room_score", F.lit(0.0)),
                       "proof": F.when(C("historical_status") == "has_history", F.coalesce(C("proven_aha_bls_score"), F.lit(75.0))), "saturation_penalty": F.lit(0.0), "cannibalization": F.lit(0.0),
                       "weekly_signups": k % 9, "total_signups": k % 14, "risk_flags": F.lit("")})
    return O.course_readiness(z).select("zip", "course", "demand", "feasibility", "action", "missing")


@query("m54_course_readiness", with_views("modeled secon v_lead room", f"""SELECT zip, course, {R('demand', 1)} AS demand, feasibility, CASE WHEN demand IS NULL THEN 'RESEARCH_NEEDED' WHEN demand < 40 THEN 'NOT_READY_DEMAND_WEAK' WHEN instructor_score <= 0 THEN 'NOT_READY_NO_INSTRUCTOR' WHEN instructor_score < 80 THEN 'INSTRUCTOR_OUTREACH_NEEDED' WHEN room_score <= 0 THEN 'NOT_READY_NO_SPACE'
  WHEN room_score < 80 THEN 'SPACE_OUTREACH_NEEDED' WHEN wk > 5 OR tot >= 10 THEN CASE WHEN feasibility >= 85 THEN 'PERMANENT_CENTER_CANDIDATE' ELSE 'RECURRING_CLASS_CANDIDATE' END WHEN demand < 55 THEN 'RESEARCH_NEEDED' ELSE 'TEST_CLASS_READY' END AS action,
 concat_ws(',', CASE WHEN demand IS NULL THEN 'demand_not_modeled' WHEN demand < 40 THEN 'sufficient_demand' END, CASE WHEN instructor_score <= 0 THEN 'any_instructor' WHEN instructor_score < 65 THEN 'named_instructor' WHEN instructor_score < 80 THEN 'verified_instructor' END,
  CASE WHEN room_score <= 0 THEN 'any_room' WHEN room_score < 60 THEN 'specific_room' WHEN room_score < 80 THEN 'confirmed_room' END) AS missing FROM ({READY})"""))
def _(spark, sf):
    return QREADY(spark, sf)


# --- matching of people and places ----------------------------------------------------------

def people(spark, sf):
    """Past instructors with coordinates of their home ZIP."""
    h = V.centroids(spark, sf).select(C("zip").alias("home_zip"), C("lat").alias("h_lat"), C("lng").alias("h_lng"))
    return perf(spark, sf).join(h, "home_zip").select(C("instructor").alias("person"), "home_zip", "h_lat", "h_lng", "proven", "performance_tier")


_pm = HAV("z.lat", "z.lng", "c.lat", "c.lng")
LEADX = "SELECT lead_id, CASE WHEN lead_id % 4 = 0 THEN 'INSTRUCTOR-' || CAST(lead_id % 300 AS VARCHAR) ELSE name END AS name, zip, source, trim(regexp_replace(lower(CASE WHEN lead_id % 4 = 0 THEN 'INSTRUCTOR-' || CAST(lead_id % 300 AS VARCHAR) ELSE name END), '[^a-z0-9]+', ' ', 'g')) AS nn, distance_miles FROM v_lead"
MATCHED = f"""
 ppl AS (SELECT p.instructor AS person, lower(p.instructor) AS nn, c.lat, c.lng FROM perf p JOIN v_centroid c ON p.home_zip = c.zip), lx AS ({LEADX}),
 dd AS (SELECT z.zip, c.person, c.nn, {_pm} AS d FROM v_centroid z CROSS JOIN ppl c), near AS (SELECT * FROM dd WHERE d <= 1.5),
 crm AS (SELECT l.zip, l.name, l.source, coalesce(l.distance_miles, {R('n.d', 1)}) AS distance_miles, pp.nn IS NOT NULL AS past_instructor FROM (SELECT * FROM lx WHERE source <> 'zip_enrichment_signal' AND nn <> '') l LEFT JOIN near n ON l.zip = n.zip AND l.nn = n.nn LEFT JOIN ppl pp ON l.nn = pp.nn),
 sig AS (SELECT zip, name, source, distance_miles, false AS past_instructor FROM lx WHERE NOT (source <> 'zip_enrichment_signal' AND nn <> '')),
 fresh AS (SELECT zip, person AS name, 'enrollment_performance' AS source, {R('d', 1)} AS distance_miles, true AS past_instructor FROM near n WHERE NOT EXISTS (SELECT 1 FROM lx l WHERE l.source <> 'zip_enrichment_signal' AND l.nn = n.nn AND l.zip = n.zip)),
 far AS (SELECT zip, person AS name, 'enrollment_performance' AS source, {R('d', 1)} AS distance_miles, true AS past_instructor FROM (SELECT *, row_number() OVER (PARTITION BY zip ORDER BY d, person) AS rn FROM dd WHERE zip NOT IN (SELECT zip FROM crm UNION SELECT zip FROM fresh)) WHERE rn <= 3)"""


@query("j25_instructor_matching", with_views("perf v_centroid v_lead", "SELECT * FROM crm UNION ALL SELECT * FROM sig UNION ALL SELECT * FROM fresh UNION ALL SELECT * FROM far", raw=MATCHED))
def _(spark, sf):
    k = C("lead_id")
    name = F.when(k % 4 == 0, F.concat(F.lit("INSTRUCTOR-"), (k % 300).cast("string"))).otherwise(C("name"))
    lx = leads(spark, sf).withColumn("name", name)
    m = O.match_instructors(V.centroids(spark, sf), people(spark, sf), lx, 1.5)
    return m.select("zip", "name", "source", "distance_miles", "past_instructor")


@query("j26_roster_in_travel_radius", with_views("v_centroid", f"""SELECT z.zip, CAST(c.zip AS INT) AS person, {R(_pm, 1)} AS miles FROM v_centroid z CROSS JOIN (SELECT *, CAST(zip AS INT) AS k FROM v_centroid WHERE CAST(zip AS INT) % 6 > 0) c WHERE {_pm} <= 1.5 * coalesce(nullif(k % 5, 0), 4)
 UNION ALL SELECT zip, CAST(zip AS INT), NULL FROM v_centroid WHERE CAST(zip AS INT) % 6 = 0"""))
def _(spark, sf):
    z = V.centroids(spark, sf)
    k = C("zip").cast("int")
    r = z.select(k.alias("person"), C("zip").alias("h_zip"), F.when(k % 6 > 0, C("lat")).alias("h_lat"), F.when(k % 6 > 0, C("lng")).alias("h_lng"), (k % 5).cast("double").alias("travel_radius_miles"))
    return O.roster_near(z, r, 5.0, 4.0)


def listing_sides(spark, sf):
    p = V.pois(spark, sf)
    k = C("place_id")
    left = p.select(k.alias("l_id"), C("name").alias("l_name"), C("lat").alias("l_lat"), C("lng").alias("l_lng"))
    # the second source has no coordinates for every third place, and words some names otherwise
    shifted = p.select((k + 1000000).alias("r_id"), F.when(k % 5 == 0, F.concat(C("name"), F.lit(" inc"))).when(k % 7 == 0, "other words here").otherwise(C("name")).alias("r_name"),
                                                         F.when(k % 3 > 0, C("lat") + 0.0002).alias("r_lat"), C("lng").alias("r_lng"))
    copies = p.where(k % 10 == 4).select((k + 2000000).alias("r_id"), C("name").alias("r_name"), (C("lat") + 0.0002).alias("r_lat"), C("lng").alias("r_lng"))
    return left, shifted.unionByName(copies)


_W = "list_sort(list_distinct(list_filter(string_split_regex(lower({}), '\\s+'), lambda t: t <> '')))"
# the walk: left rows in id order, each takes the first unused right row that fits
LISTED = f"""l AS (SELECT place_id AS l_id, {_W.format('name')} AS w, lat, lng FROM v_poi),
 r AS (SELECT r_id, {_W.format('name')} AS w, lat, lng FROM (SELECT place_id + 1000000 AS r_id, CASE WHEN place_id % 5 = 0 THEN name || ' inc' WHEN place_id % 7 = 0 THEN 'other words here' ELSE name END AS name, CASE WHEN place_id % 3 > 0 THEN lat + 0.0002 END AS lat, lng FROM v_poi
  UNION ALL SELECT place_id + 2000000, name, lat + 0.0002, lng FROM v_poi WHERE place_id % 10 = 4)),
 p AS MATERIALIZED (SELECT l_id, r_id FROM l JOIN r ON abs(l.lat - r.lat) < 0.01 AND abs(l.lng - r.lng) < 0.01 AND {HAV('l.lat', 'l.lng', 'r.lat', 'r.lng', 3958.7613)} <= 0.05 AND len(list_intersect(l.w, r.w)) * 1.0 / (len(l.w) + len(r.w) - len(list_intersect(l.w, r.w))) >= 0.5),
 q AS MATERIALIZED (SELECT row_number() OVER (ORDER BY l_id) AS i, l_id, list(r_id ORDER BY r_id) AS rs FROM p GROUP BY l_id),
 walk(i, used, l_id, r_id) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT UNION ALL
  SELECT i, CASE WHEN t IS NULL THEN used ELSE list_append(used, t) END, l_id, t FROM (SELECT q.i, w.used, q.l_id, list_filter(q.rs, lambda x: NOT list_contains(w.used, x))[1] AS t FROM walk w JOIN q ON q.i = w.i + 1))"""


@query("j18_listing_match", with_views("v_poi", "SELECT l_id, r_id FROM walk WHERE r_id IS NOT NULL", raw=LISTED).replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, sf):
    return MT.first_match(*listing_sides(spark, sf))


@query("j18_listing_summary", with_views("v_poi", """SELECT count(w.r_id) AS matched, count(*) - count(w.r_id) AS right_only, round(avg(CASE WHEN w.r_id IS NOT NULL THEN rating END), 2) AS avg_rating, CAST(sum(CASE WHEN w.r_id IS NOT NULL THEN reviews END) AS BIGINT) AS total_reviews
 FROM (SELECT r.r_id, CASE WHEN r_id % 9 > 0 THEN CAST(r_id % 5 AS DOUBLE) END AS rating, r_id % 40 AS reviews FROM r) r LEFT JOIN (SELECT r_id FROM walk WHERE r_id IS NOT NULL) w ON r.r_id = w.r_id""", raw=LISTED).replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, sf):
    left, right = listing_sides(spark, sf)
    facts = right.select("r_id", F.when(C("r_id") % 9 > 0, (C("r_id") % 5).cast("double")).alias("rating"), (C("r_id") % 40).alias("reviews"))
    return MT.match_summary(facts, MT.first_match(left, right))


_tok = lambda c: f"list_distinct(list_filter(string_split(lower({c}), ' '), lambda t: t <> ''))"
_jac = lambda a, b: f"len(list_intersect({a}, {b})) * 1.0 / nullif(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0)"


@query("r12_token_jaccard", f"""WITH n AS (SELECT DISTINCT p_name, p_brand || ' ' || p_type || ' ' || p_name AS other FROM part) SELECT p_name, other, {R(_jac(_tok('p_name'), _tok('other')), 6)} AS jaccard FROM n""")
def _(spark, sf):
    n = V.table(spark, sf, "part").select("p_name", F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("other")).distinct()
    return n.select("p_name", "other", rnd(T.token_jaccard(MT.word_set(C("p_name")), MT.word_set(C("other"))), 6).alias("jaccard"))


def sourced(spark, sf):
    k = C("p_partkey")
    p = V.table(spark, sf, "part")
    return p.select(k.alias("lead_id"), F.concat_ws(" ", C("p_name"), F.lit("academy"), F.when(k % 3 == 0, F.lit("east")), (k % 40).cast("string")).alias("name"), F.when(k % 4 == 0, F.concat(F.lit("555-"), k.cast("string"))).otherwise("").alias("phone"),
                    F.when(k % 5 == 0, F.concat(F.lit("u"), k.cast("string"))).alias("url"), F.when(k % 2 == 0, "google").otherwise("yelp").alias("source"), F.when(k % 7 == 0, F.concat(F.lit("street "), k.cast("string"))).alias("address"))


@query("j19_near_duplicate_names", r"""WITH RECURSIVE d AS MATERIALIZED (SELECT p_partkey AS lead_id, concat_ws(' ', p_name, 'academy', CASE WHEN p_partkey % 3 = 0 THEN 'east' END, CAST(p_partkey % 40 AS VARCHAR)) AS name, CASE WHEN p_partkey % 4 = 0 THEN '555-' || CAST(p_partkey AS VARCHAR) ELSE '' END AS phone,
  CASE WHEN p_partkey % 5 = 0 THEN 'u' || CAST(p_partkey AS VARCHAR) END AS url, CASE WHEN p_partkey % 2 = 0 THEN 'google' ELSE 'yelp' END AS source, CASE WHEN p_partkey % 7 = 0 THEN 'street ' || CAST(p_partkey AS VARCHAR) END AS address FROM part),
 n AS MATERIALIZED (SELECT *, list_sort(list_distinct(list_filter(string_split_regex(lower(name), '\s+'), lambda t: t <> ''))) AS w FROM d),
 s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pos) AS i, w, pos FROM (SELECT w, min(lead_id) AS pos FROM n GROUP BY w)),
 t AS MATERIALIZED (SELECT i, len(w) AS n, unnest(w) AS t FROM s),
 e AS MATERIALIZED (SELECT b.i, a.i AS j FROM t b JOIN t a ON a.t = b.t AND a.i < b.i GROUP BY b.i, a.i, a.n, b.n HAVING count(*) * 1.0 / (a.n + b.n - count(*)) >= 0.6),
 q AS MATERIALIZED (SELECT s.i, list(e.j) AS js FROM s LEFT JOIN e ON s.i = e.i GROUP BY s.i),
 walk(i, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT q.i, CASE WHEN list_has_any(w.kept, list_filter(q.js, lambda x: x IS NOT NULL)) THEN w.kept ELSE list_append(w.kept, q.i) END FROM walk w JOIN q ON q.i = w.i + 1),
 kept AS MATERIALIZED (SELECT unnest(kept) AS i FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)),
 lead AS (SELECT s.i, coalesce(min(CASE WHEN k.i = s.i THEN s.i END), min(CASE WHEN e.j = k.i THEN k.i END)) AS k FROM s LEFT JOIN e ON e.i = s.i LEFT JOIN kept k ON k.i = s.i OR k.i = e.j GROUP BY s.i),
 g AS MATERIALIZED (SELECT n.*, s2.pos AS keeper FROM n JOIN s USING (w) JOIN lead ON lead.i = s.i JOIN s s2 ON s2.i = lead.k),
 m AS (SELECT keeper, count(*) AS merged, min_by(phone, lead_id) FILTER (phone <> '') AS p, min_by(url, lead_id) FILTER (url <> '') AS u, min_by(address, lead_id) FILTER (address <> '') AS a FROM g GROUP BY keeper),
 o AS (SELECT keeper, string_agg(source, '+' ORDER BY f) AS sources FROM (SELECT keeper, source, min(lead_id) AS f FROM g GROUP BY 1, 2) GROUP BY 1),
 r AS (SELECT d.lead_id, d.name, coalesce(nullif(d.phone, ''), m.p) AS phone, coalesce(nullif(d.url, ''), m.u) AS url, d.source, coalesce(nullif(d.address, ''), m.a) AS address, m.merged, o.sources FROM d JOIN m ON d.lead_id = m.keeper JOIN o ON o.keeper = m.keeper)
SELECT *, coalesce(phone <> '', false) OR coalesce(url <> '', false) AS contactable FROM r""")
def _(spark, sf):
    df = sourced(spark, sf)
    links = MT.near_duplicates(df, "lead_id", "name")
    return MT.merge_duplicates(df, links, "lead_id", ["phone", "url", "address"], "lead_id")


@query("u01_curated_and_live", """WITH cur AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'u' || CAST(o_custkey AS VARCHAR) END AS url FROM orders WHERE o_orderkey % 3 = 0),
 live AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE 'U' || CAST(o_custkey AS VARCHAR) END AS url FROM orders WHERE o_orderkey % 3 > 0)
SELECT * FROM cur UNION ALL SELECT id, url FROM (SELECT *, row_number() OVER (PARTITION BY lower(url) ORDER BY id) AS rn FROM live WHERE trim(url) <> '' AND lower(url) NOT IN (SELECT url FROM cur WHERE url <> '')) WHERE rn = 1 UNION ALL SELECT * FROM live WHERE trim(url) = ''""")
def _(spark, sf):
    o, k = V.table(spark, sf, "orders"), C("o_orderkey")
    cur = o.where(k % 3 == 0).select(k.alias("id"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("u"), C("o_custkey").cast("string"))).alias("url"))
    live = o.where(k % 3 > 0).select(k.alias("id"), F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit("U"), C("o_custkey").cast("string"))).alias("url"))
    return MT.union_preferring(cur, live, "url", "id")


@query("u02_distinct_places", "SELECT l_partkey AS pid, NULL::BIGINT AS line FROM lineitem WHERE l_partkey % 5 > 0 GROUP BY 1 UNION ALL SELECT NULL, l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_partkey % 5 = 0")
def _(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(F.when(C("l_partkey") % 5 > 0, C("l_partkey")).alias("pid"), F.when(C("l_partkey") % 5 == 0, C("l_orderkey") * 10 + C("l_linenumber")).alias("line"))
    return MT.distinct_places(rows, "pid")


@query("u05_ordered_distinct", "SELECT l_partkey AS value, min(l_orderkey * 10 + l_linenumber) AS position FROM lineitem GROUP BY 1")
def _(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(C("l_partkey").alias("value"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("position"))
    return MT.first_per_value(rows, "value", "position")


@query("u06_restrict_to_keys", with_views("v_centroid v_class", "SELECT * FROM v_centroid WHERE zip IN (SELECT zip FROM v_class WHERE zip IS NOT NULL)"))
def _(spark, sf):
    return V.centroids(spark, sf).join(V.class_table(spark, sf).where("zip IS NOT NULL").select("zip"), "zip", "left_semi")


@query("s30_centroid_merge", with_views("v_centroid", "SELECT zip, CASE WHEN CAST(zip AS INT) % 2 = 0 THEN lat + 1 ELSE lat END AS lat, lng FROM v_centroid WHERE CAST(zip AS INT) % 2 = 0 OR CAST(zip AS INT) % 3 > 0"))
def _(spark, sf):
    z, k = V.centroids(spark, sf), C("zip").cast("int")
    return MT.centroid_merge(z.where(k % 3 > 0), z.where(k % 2 == 0).withColumn("lat", C("lat") + 1))


@query("j33_lead_upsert", """WITH prior AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'NEW' WHEN 1 THEN 'CONTACTED' WHEN 2 THEN '' END AS outreach_status, CASE WHEN c_custkey % 5 = 0 THEN 'note' END AS notes, 'old' AS phone FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0),
 fresh AS (SELECT c_custkey AS id, 'NEW' AS outreach_status, 'auto' AS notes, 'new' AS phone FROM customer WHERE c_custkey % 3 > 0)
SELECT id, CASE WHEN f.id IS NULL THEN p.outreach_status WHEN p.outreach_status NOT IN ('', 'NEW') THEN p.outreach_status ELSE f.outreach_status END AS outreach_status, CASE WHEN f.id IS NULL THEN p.notes ELSE coalesce(p.notes, f.notes) END AS notes, coalesce(f.phone, p.phone) AS phone
FROM fresh f FULL OUTER JOIN prior p USING (id) WHERE f.id IS NOT NULL OR coalesce(p.outreach_status, '') NOT IN ('', 'NEW')""")
def _(spark, sf):
    c, k = V.table(spark, sf, "customer"), C("c_custkey")
    prior = c.where((k % 2 == 0) | (k % 3 == 0)).select(k.alias("id"), F.when(k % 4 == 0, "NEW").when(k % 4 == 1, "CONTACTED").when(k % 4 == 2, "").alias("outreach_status"),
                                                        F.when(k % 5 == 0, "note").alias("notes"), F.lit("old").alias("phone"))
    fresh = c.where(k % 3 > 0).select(k.alias("id"), F.lit("NEW").alias("outreach_status"), F.lit("auto").alias("notes"), F.lit("new").alias("phone"))
    return MT.upsert(prior, fresh, ["id"], ["outreach_status", "notes"])


@query("j33_lead_identity", """WITH l AS (SELECT c_custkey AS k, lpad(CAST(c_custkey % 90 AS VARCHAR), 5, '0') AS zip, CASE WHEN c_custkey % 3 = 0 THEN 'L' || CAST(c_custkey AS VARCHAR) ELSE '' END AS lid, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS name, CASE c_custkey % 2 WHEN 0 THEN 'crm' END AS source FROM customer),
 i AS (SELECT k, zip, CASE WHEN lid <> '' THEN lid ELSE coalesce(name, '') || '|' || coalesce(source, '') END AS identity FROM l),
 prior AS (SELECT zip, identity, max(k) AS k FROM i WHERE k % 4 < 2 GROUP BY 1, 2), fresh AS (SELECT zip, identity, max(k) AS k FROM i WHERE k % 4 > 0 GROUP BY 1, 2)
SELECT coalesce(f.zip, p.zip) AS zip, coalesce(f.identity, p.identity) AS identity, CASE WHEN f.k IS NULL THEN CASE WHEN p.k % 3 = 0 THEN 'CONTACTED' ELSE 'NEW' END WHEN p.k % 3 = 0 THEN 'CONTACTED' ELSE 'NEW' END AS outreach_status, coalesce(f.k, p.k) AS row
FROM fresh f FULL OUTER JOIN prior p ON f.zip = p.zip AND f.identity = p.identity WHERE f.k IS NOT NULL OR p.k % 3 = 0""")
def _(spark, sf):
    k = C("c_custkey")
    rows = V.table(spark, sf, "customer").select(k.alias("row"), F.lpad((k % 90).cast("string"), 5, "0").alias("zip"), F.when(k % 3 == 0, F.concat(F.lit("L"), k.cast("string"))).otherwise("").alias("id"),
                                                 F.when(k % 5 > 0, C("c_name")).alias("name"), F.when(k % 2 == 0, "crm").alias("source")).withColumn("identity", MT.lead_identity(C("id"), C("name"), C("source")))
    last = lambda df: df.groupBy("zip", "identity").agg(F.max("row").alias("row"))  # of rows with one identity the last counts
    prior = last(rows.where(C("row") % 4 < 2)).withColumn("outreach_status", F.when(C("row") % 3 == 0, "CONTACTED").otherwise("NEW"))
    fresh = last(rows.where(C("row") % 4 > 0)).withColumn("outreach_status", F.lit("NEW"))
    return MT.upsert(prior, fresh, ["zip", "identity"], ["outreach_status"])


@query("j34_append_unseen", """SELECT id, stage FROM (SELECT o_orderkey AS id, 'sent' AS stage FROM orders WHERE o_orderkey % 2 = 0 UNION ALL
 SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0))""")
def _(spark, sf):
    o = V.table(spark, sf, "orders").select(C("o_orderkey").alias("id"))
    return MT.append_unseen(o.where("id % 2 = 0").withColumn("stage", F.lit("sent")), o.where("id % 3 = 0").withColumn("stage", F.lit("new")), "id")


_OV = """WITH a AS (SELECT c_custkey AS id, lower(c_name) || ' | block ' || CAST(c_custkey % 50 AS VARCHAR) || ', main street' AS addr FROM customer),
 o AS (SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 11 % 400 END AS cid, CASE WHEN s_suppkey % 4 = 1 THEN 'Block ' || CAST(s_suppkey % 50 AS VARCHAR) || ', Main ' END AS needle FROM supplier),
 e AS (SELECT a.id, min(o.pos) AS pos FROM a JOIN o ON a.id = o.cid GROUP BY 1), c AS (SELECT a.id, min(o.pos) AS pos FROM a JOIN o ON trim(o.needle) <> '' AND contains(a.addr, trim(lower(o.needle))) GROUP BY 1)"""


@query("j16_address_containment", _OV + " SELECT a.id, coalesce(e.pos, c.pos) AS override_row, CASE WHEN e.pos IS NOT NULL THEN 'candidate_id' ELSE 'address' END AS matched_by FROM a LEFT JOIN e ON a.id = e.id LEFT JOIN c ON a.id = c.id WHERE e.pos IS NOT NULL OR c.pos IS NOT NULL")
def _(spark, sf):
    k, s = C("c_custkey"), C("s_suppkey")
    a = V.table(spark, sf, "customer").select(k.alias("id"), F.concat(F.lower("c_name"), F.lit(" | block "), (k % 50).cast("string"), F.lit(", main street")).alias("addr"))
    o = V.table(spark, sf, "supplier").select(s.alias("override_row"), F.when(s % 3 == 0, s * 11 % 400).alias("cid"), F.when(s % 4 == 1, F.concat(F.lit("Block "), (s % 50).cast("string"), F.lit(", Main "))).alias("needle"))
    return MT.lookup_override(a, "id", "addr", o, "cid", "needle", "override_row")


@query("j15_nearest_rent_override", with_views("v_candw v_site", f"""SELECT candidate_id, site_id AS override_id, {R('d', 3)} AS distance, {R('monthly_avg_revenue / 12', 2)} AS rent_month FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY d, site_id) AS rn FROM (
 SELECT c.candidate_id, s.*, {HAV('c.lat', 'c.lng', 's_lat', 's_lng', 3958.7613)} AS d FROM v_candw c CROSS JOIN v_site s WHERE c.lat IS NOT NULL AND s.monthly_avg_revenue IS NOT NULL) WHERE d <= 1 + site_id % 4) WHERE rn = 1"""))
def _(spark, sf):
    from demandgrid.operators.geo import nearest_reaching
    s = sites(spark, sf).where("monthly_avg_revenue IS NOT NULL").withColumn("radius", (1 + C("site_id") % 4).cast("double"))
    s = s.withColumn("site", F.struct("site_id", "monthly_avg_revenue"))
    c = cands(spark, sf).select("candidate_id", "lat", "lng")
    near = c.join(nearest_reaching(c, "lat", "lng", s, "site", "s_lat", "s_lng", "radius", 4.0, 3958.7613), ["lat", "lng"])
    best = near.groupBy("candidate_id").agg(F.min(F.struct("distance", "site.site_id", "site.monthly_avg_revenue")).alias("b"))
    return best.select("candidate_id", C("b.site_id").alias("override_id"), rnd(C("b.distance"), 3).alias("distance"), rnd(C("b.monthly_avg_revenue") / 12, 2).alias("rent_month"))
