"""Registered queries: parsers, place judgements, nested records, ledgers, files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from demandgrid.functions import places as P
from demandgrid.functions import text as T
from demandgrid.functions.exprs import joined, lookup, pick, rnd
from demandgrid.operators import candidates as K
from demandgrid.operators import classes as CL
from demandgrid.operators import facilities as FA
from demandgrid.operators import matching as MT
from demandgrid.operators import records as RC
from demandgrid.operators.classes import top_per
from demandgrid.plans import views as V
from demandgrid.plans.q_candidates import BOOLS, CATS, ctes, cands, counts, places, with_competition
from demandgrid.plans.q_modeled import model
from demandgrid.plans.registry import query
from demandgrid.plans.sql import HAV, R, extend, with_views
from demandgrid.plans.zip_table import zips
from demandgrid.session import ensure_checkpoint_dir
from demandgrid.sources import readers as RD
from demandgrid.sources import sinks as SK
from demandgrid.streaming import incremental as IN
from demandgrid.streaming import live as LV

C = F.col


def orders(spark, sf):
    return V.table(spark, sf, "orders")


def arr(*xs):
    return F.array(*[F.lit(x).cast("string") for x in xs])


def by(k, *xs):
    """Literal chosen by key modulo the list length."""
    return F.element_at(arr(*xs), (k % len(xs) + 1).cast("int"))


def by_sql(k: str, *xs) -> str:
    q = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return f"(CASE {k} % {len(xs)} " + " ".join(f"WHEN {i} THEN {q(x)}" for i, x in enumerate(xs)) + " END)"


# --- parsers -----------------------------------------------------------------------------

@query("p02_numbers_and_prices", f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 > 0 THEN CAST(round_even(o_totalprice, 0) AS BIGINT) END AS whole, CASE WHEN o_orderkey % 9 > 0 THEN {R('o_totalprice', 2)} END AS price FROM orders""")
def _(spark, sf):
    k = C("o_orderkey")
    text = F.when(k % 9 == 0, "N/A").otherwise(F.concat(F.lit(" $"), F.format_number("o_totalprice", 2), F.lit(" ")))
    return orders(spark, sf).select(k.alias("id"), T.parse_int(F.regexp_replace(text, r"\$", "")).alias("whole"), T.parse_price(text).alias("price"))


@query("p03_mixed_dates", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 < 7 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders")
def _(spark, sf):
    k, d = C("o_orderkey"), C("o_orderdate")
    forms = ["yyyy-MM-dd", "M/d/yyyy", "M/d/yy H:mm", "MMM d, yyyy", "d-MMM-yyyy", "yyyy-MM-dd HH:mm:ss", "MM-dd-yyyy"]
    text = F.when(k % 8 == 7, "soon")
    for i, f in enumerate(forms):
        text = text.when(k % 8 == i, F.date_format(d, f))
    return orders(spark, sf).select(k.alias("id"), F.date_format(T.parse_date(text), "yyyy-MM-dd").alias("day"))


@query("p13_sortable_dates", "SELECT o_custkey AS id, max(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS newest FROM orders WHERE o_orderkey % 4 < 3 GROUP BY 1")
def _(spark, sf):
    k, d = C("o_orderkey"), C("o_orderdate")
    text = F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(d, "M/d/yyyy")).when(k % 4 == 2, F.date_format(d, "yyyy-MM-dd HH:mm")).otherwise("n/a")
    rows = orders(spark, sf).select(C("o_custkey").alias("id"), T.sortable_date(text).alias("d"))
    return rows.groupBy("id").agg(F.date_format(F.max("d"), "yyyy-MM-dd").alias("newest")).where("newest IS NOT NULL")


@query("p05_location_name", """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 4 THEN NULL ELSE s_name END AS place, CASE WHEN s_suppkey % 5 = 4 THEN 'n/a' ELSE lower(s_name) || CASE s_suppkey % 5 WHEN 2 THEN ' -' ELSE '' END END AS place_key FROM supplier""")
def _(spark, sf):
    k, nm = C("s_suppkey"), C("s_name")
    raw = F.when(k % 5 == 0, F.concat(nm, F.lit(" (t)"))).when(k % 5 == 1, F.concat(F.lit("  "), nm, F.lit("（tmp） "))).when(k % 5 == 2, F.concat(nm, F.lit("  - (1)"))).when(k % 5 == 3, nm).otherwise("n/a")
    return V.table(spark, sf, "supplier").select(k.alias("id"), T.location_name(raw).alias("place"), T.location_key(raw).alias("place_key"))


@query("p06_city_state_zip", """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 2 THEN 'Back Hall' ELSE 'San ' || CASE c_custkey % 2 WHEN 0 THEN 'Jose' ELSE 'Mateo' END END AS city, CASE WHEN c_custkey % 3 < 2 THEN 'CA' END AS state,
 CASE WHEN c_custkey % 3 < 2 THEN lpad(CAST(c_custkey % 99999 AS VARCHAR), 5, '0') END AS zip FROM customer""")
def _(spark, sf):
    k = C("c_custkey")
    z, town = F.lpad((k % 99999).cast("string"), 5, "0"), F.when(k % 2 == 0, "san jose").otherwise("SAN MATEO")
    raw = F.when(k % 3 == 0, F.concat(F.lit("Main Hall(1631 N First Street, Suite 200, "), town, F.lit(", CA "), z, F.lit(")"))) \
        .when(k % 3 == 1, F.concat(F.lit("Office(9 B Street, "), town, F.lit(", CA, "), z, F.lit(")"))).otherwise("Back Hall (upstairs)")
    return V.table(spark, sf, "customer").select(k.alias("id"), T.address_parts(raw).alias("a")).select("id", "a.city", "a.state", "a.zip")


@query("p07_address_zip", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 3 THEN NULL ELSE lpad(CAST(c_custkey % 99999 AS VARCHAR), 5, '0') END AS zip FROM customer")
def _(spark, sf):
    k = C("c_custkey")
    z = F.lpad((k % 99999).cast("string"), 5, "0")
    raw = F.when(k % 4 == 0, F.concat(F.lit("12345 Main St, San Jose, CA "), z, F.lit(", USA"))).when(k % 4 == 1, F.concat(F.lit("9 Elm, CA "), z, F.lit("-1234"))) \
        .when(k % 4 == 2, F.concat(F.lit("54321 Oak "), z, F.lit(" unit b"))).otherwise("54321 Oak Street")
    return V.table(spark, sf, "customer").select(k.alias("id"), T.address_zip(raw).alias("zip"))


@query("p08_zip_normal_form", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 3 THEN NULL ELSE lpad(CAST(c_custkey % 9999 AS VARCHAR), 5, '0') END AS zip FROM customer")
def _(spark, sf):
    k = C("c_custkey")
    v = (k % 9999).cast("string")
    raw = F.when(k % 4 == 0, F.concat(v, F.lit(".0"))).when(k % 4 == 1, F.concat(F.lpad(v, 5, "0"), F.lit("-77"))).when(k % 4 == 2, F.concat(F.lit(" "), v)).otherwise("none")
    return V.table(spark, sf, "customer").select(k.alias("id"), T.zip5(raw).alias("zip"))


@query("p09_multiline_cells", "SELECT c_custkey AS id, 3 - CAST(c_custkey % 2 AS INT) AS parts, CASE c_custkey % 2 WHEN 0 THEN 'a; b; ' || c_mktsegment ELSE 'a; ' || c_mktsegment END AS cell FROM customer")
def _(spark, sf):
    k = C("c_custkey")
    raw = F.when(k % 2 == 0, F.concat(F.lit("a\nb ; "), C("c_mktsegment"), F.lit(",a"))).otherwise(F.concat(F.lit(" a,,"), C("c_mktsegment"), F.lit("\n")))
    uniq = F.array_distinct(T.lines(raw))
    return V.table(spark, sf, "customer").select(k.alias("id"), F.size(uniq).alias("parts"), joined(uniq, "; ").alias("cell"))


@query("p10_list_cells", "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'x|y,z' WHEN 1 THEN 'x,y' ELSE 'x, y' END AS items FROM customer")
def _(spark, sf):
    raw = by(C("c_custkey"), "x|y ; z;", " x | y", "x, y")
    return V.table(spark, sf, "customer").select(C("c_custkey").alias("id"), joined(T.list_cell(raw)).alias("items"))


@query("p11_tri_state", "SELECT CASE c_custkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS flag, count(*) AS rows FROM customer GROUP BY 1")
def _(spark, sf):
    return V.table(spark, sf, "customer").groupBy(T.tri_bool(by(C("c_custkey"), "Yes", "Not required", " TRUE ", "0", "perhaps", None)).alias("flag")).agg(F.count("*").alias("rows"))


@query("p12_money", f"SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 AND c_custkey % 5 > 0 THEN {R('c_acctbal', 2)} END AS amount FROM customer")
def _(spark, sf):
    raw = F.when(C("c_custkey") % 5 == 0, "call us").otherwise(F.concat(F.lit("$"), F.format_number("c_acctbal", 2)))
    return V.table(spark, sf, "customer").select(C("c_custkey").alias("id"), T.money(raw).alias("amount"))


@query("p45_plain_names", "SELECT p_partkey AS id, trim(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS name FROM part")
def _(spark, sf):
    return V.table(spark, sf, "part").select(C("p_partkey").alias("id"), T.plain_name(F.concat(C("p_name"), F.lit(" & "), C("p_brand"))).alias("name"))


@query("p46_location_keys", "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'san jose|ca' WHEN 1 THEN '|ca' ELSE 'zip|' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') END AS key FROM customer")
def _(spark, sf):
    k = C("c_custkey")
    return V.table(spark, sf, "customer").select(k.alias("id"), RC.job_key(by(k, " San Jose", None, ""), by(k, "CA", " CA ", None), k.cast("string")).alias("key"))


@query("p48_target_lines", "SELECT c_custkey AS id, 'Santana Row, San Jose' AS place, CASE c_custkey % 2 WHEN 0 THEN 'CA' ELSE 'NV' END AS state FROM customer")
def _(spark, sf):
    raw = by(C("c_custkey"), "Santana Row, San Jose, CA", "Santana Row, San Jose")
    return V.table(spark, sf, "customer").select(C("c_custkey").alias("id"), T.target_line(raw, "NV").alias("t")).select("id", "t.place", "t.state")


@query("p18_teachable_courses", "SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'AHA_BLS' WHEN 1 THEN 'ARC_BLS,ARC_CPR_FA_AED' WHEN 2 THEN 'AHA_BLS,ARC_BLS,ARC_CPR_FA_AED' ELSE '' END AS courses, CASE s_suppkey % 4 WHEN 0 THEN 'AHA instructor ID on file' WHEN 1 THEN 'HSI/ASHI instructor ID on file' WHEN 2 THEN 'aha heartsaver; Red Cross' ELSE 'yoga' END AS signals FROM supplier")
def _(spark, sf):
    k = C("s_suppkey")
    aha, hsi, cert = by(k, "1012.0", None, "0.0", ""), by(k, "0", "77", None, "nan"), by(k, None, None, "aha heartsaver\nRed Cross", "yoga")
    return V.table(spark, sf, "supplier").select(k.alias("id"), joined(T.teachable_courses(aha, hsi, cert)).alias("courses"), joined(T.certification_signals(aha, hsi, cert), "; ").alias("signals"))


@query("p20_roster_contacts", "SELECT s_suppkey AS id, 'Pat ' || s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN '$45' ELSE '' END AS pay_rate, s_suppkey % 6 = 0 AS renewal_due FROM supplier WHERE s_suppkey % 3 > 0")
def _(spark, sf):
    s, k = V.table(spark, sf, "supplier"), C("s_suppkey")
    raw = s.select(k.alias("id"), by(k, "no", "Yes", "active").alias("active"), F.lit("Pat ").alias("first"), C("s_name").alias("last"), F.concat(F.lit("M"), k.cast("string"), F.lit("@x.org")).alias("email"),
                   F.when(k % 5 == 0, "weekends #Salary: $45. ok").otherwise("none").alias("notes"))
    renew = s.where(k % 6 == 0).select(F.concat(F.lit("m"), k.cast("string"), F.lit("@x.org")).alias("mail")).withColumn("due", F.lit(True))
    act = raw.where(F.lower("active").isin("yes", "y", "true", "1", "active")).withColumn("mail", F.lower("email"))
    return act.join(renew, "mail", "left").select("id", F.trim(F.concat_ws(" ", F.trim("first"), "last")).alias("name"), T.salary(C("notes")).alias("pay_rate"), F.coalesce("due", F.lit(False)).alias("renewal_due"))


@query("p21_location_rows", "SELECT s_suppkey AS id, s_name AS label, CASE WHEN s_suppkey % 2 = 0 THEN '12 Elm, Albany, NY ' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') ELSE '' END AS address, CASE WHEN s_suppkey % 2 = 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 5, '0') END AS zip FROM supplier")
def _(spark, sf):
    k = C("s_suppkey")
    raw = F.when(k % 2 == 0, F.concat(C("s_name"), F.lit(" (12 Elm, Albany, NY "), F.lpad(k.cast("string"), 5, "0"), F.lit(")"))).otherwise(C("s_name"))
    addr = F.regexp_extract(raw, r"\((.*)\)\s*$", 1)
    return V.table(spark, sf, "supplier").select(k.alias("id"), F.trim(F.regexp_replace(raw, r"\s*\(.*\)\s*$", "")).alias("label"), addr.alias("address"), T.zip5(F.when(addr != "", addr)).alias("zip"))


@query("p22_provider_kind", "SELECT CASE p_partkey % 5 WHEN 0 THEN 'nurse' WHEN 1 THEN 'physician' WHEN 2 THEN 'nurse' ELSE 'other' END AS kind, count(*) AS providers FROM part GROUP BY 1")
def _(spark, sf):
    return V.table(spark, sf, "part").groupBy(FA.provider_kind(by(C("p_partkey"), "163W00000X", "207Q00000X", " 367a0000x", "", None)).alias("kind")).agg(F.count("*").alias("providers"))


@query("a26_providers_per_zip", """SELECT lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS zip, count(*) AS healthcare_provider_count, count(CASE WHEN l_partkey % 5 IN (0, 2) THEN 1 END) AS nurse_count, count(CASE WHEN l_partkey % 5 = 1 THEN 1 END) AS physician_count, count(CASE WHEN l_linenumber = 2 THEN 1 END) AS clinic_provider_count
FROM lineitem WHERE l_suppkey % 9 > 0 GROUP BY 1""")
def _(spark, sf):
    k = C("l_partkey")
    z = F.when(C("l_suppkey") % 9 == 0, "bad").otherwise(F.concat(F.lpad(C("l_suppkey").cast("string"), 5, "0"), F.lit("1234")))
    return FA.providers_per_zip(V.table(spark, sf, "lineitem"), z, by(k, "163W00000X", "207Q00000X", "367A0000X", "", None), C("l_linenumber").cast("string"))


@query("a27_institutions_per_zip", """SELECT lpad(CAST(p_partkey % 100 AS VARCHAR), 5, '0') AS zip, count(*) AS college_count, count(CASE WHEN p_size % 4 = 0 THEN 1 END) AS nursing_school_count, count(CASE WHEN p_size % 4 < 2 THEN 1 END) AS health_program_school_count,
 CAST(coalesce(sum(CASE WHEN p_partkey % 3 > 0 THEN p_size END), 0) AS BIGINT) AS student_enrollment_count FROM part GROUP BY 1""")
def _(spark, sf):
    k = C("p_partkey")
    name = F.element_at(arr("School of Nursing", "Dental Arts College", "Law School", "City College"), (C("p_size") % 4 + 1).cast("int"))
    return FA.institutions_per_zip(V.table(spark, sf, "part").select(F.lpad((k % 100).cast("string"), 5, "0").alias("zip"), name.alias("name"), F.when(k % 3 > 0, C("p_size")).alias("enrollment")))


@query("p23_map_kinds", "SELECT CASE p_partkey % 7 WHEN 0 THEN 'childcare' WHEN 1 THEN 'school' WHEN 2 THEN 'community' WHEN 3 THEN 'parking' WHEN 4 THEN 'commercial' WHEN 5 THEN 'commercial' END AS kind, count(*) AS elements FROM part GROUP BY 1")
def _(spark, sf):
    k = C("p_partkey")
    return V.table(spark, sf, "part").groupBy(FA.map_kind(by(k, "Kindergarten", "college", "library", "parking", "marketplace", None, "bench"), by(k, None, None, None, None, None, "bakery", "")).alias("kind")).agg(F.count("*").alias("elements"))


@query("p24_place_matches", with_views("v_poi", """SELECT place_id, kind IN ('hospital','urgent care') AS healthcare, kind IN ('nursing school','CPR training') AS training, kind = 'CPR training' AS competitor FROM v_poi"""))
def _(spark, sf):
    p = V.pois(spark, sf)
    none = F.array().cast("array<string>")
    return p.select("place_id", P.matches(none, C("name"), P.HEALTHCARE_TYPES, P.HEALTHCARE_WORDS).alias("healthcare"), P.matches(none, C("name"), [], P.TRAINING_WORDS).alias("training"),
                    P.matches(none, C("name"), [], P.COMPETITOR_WORDS).alias("competitor"))


PLACE_CASES = [  # name, type, viability reason, signal, status
    ("Oak Medical Office Building", "doctor", None, "doctor", "verified_commercial_site"), ("Main St & 2nd Ave", "store", "intersection", "store", "invalid_anchor"), ("Free Robux Generator", None, "spam_listing", None, "invalid_anchor"),
    ("City Parking Garage", None, "bad_name", None, "invalid_anchor"), ("Sunny Shopping Plaza", "shopping_mall", None, "shopping_mall", "commercial_plaza"), ("Corner Bakery", "bakery", None, None, "area_proxy"),
    ("Union Depot", "train_station", "type:train_station", None, "invalid_anchor"), ("Learning Center West", "library", None, "library", "verified_commercial_site"), ("Grand Plaza", None, None, "plaza", "commercial_plaza"),
]


def judged(spark, sf):
    k = C("p_partkey")
    types = F.when(by(k, *[c[1] for c in PLACE_CASES]).isNotNull(), F.array(by(k, *[c[1] for c in PLACE_CASES])))
    return V.table(spark, sf, "part").select(k.alias("id"), F.concat(C("p_brand"), F.lit(" "), by(k, *[c[0] for c in PLACE_CASES])).alias("name"), types.alias("types"))


@query("p28_anchor_viability", f"SELECT p_partkey AS id, {by_sql('p_partkey', *[c[2] for c in PLACE_CASES])} AS reason FROM part")
def _(spark, sf):
    return judged(spark, sf).select("id", P.viability_reason(C("types"), C("name"), F.lit(None).cast("string")).alias("reason"))


@query("p29_commercial_signal", f"SELECT p_partkey AS id, {by_sql('p_partkey', *[c[3] for c in PLACE_CASES])} AS signal FROM part")
def _(spark, sf):
    return judged(spark, sf).select("id", P.commercial_signal(C("types"), C("name")).alias("signal"))


@query("p30_anchor_grade", f"SELECT p_partkey AS id, {by_sql('p_partkey', *[c[4] for c in PLACE_CASES])} AS status, CASE {by_sql('p_partkey', *[c[4] for c in PLACE_CASES])} WHEN 'verified_commercial_site' THEN 90 WHEN 'commercial_plaza' THEN 70 WHEN 'area_proxy' THEN 45 ELSE 8 END AS quality FROM part")
def _(spark, sf):
    s = judged(spark, sf).select("id", P.anchor_status(C("types"), C("name"), F.lit(None).cast("string")).alias("status"))
    return s.withColumn("quality", lookup(C("status"), P.ANCHOR_QUALITY))


@query("c40_area_names", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Midtown, San Jose' WHEN 1 THEN 'San Jose — Main St corridor' WHEN 2 THEN 'San Jose, CA area' ELSE 'Candidate area' END AS name FROM customer")
def _(spark, sf):
    k = C("c_custkey")
    return V.table(spark, sf, "customer").select(k.alias("id"), P.area_name(by(k, "San Jose", "San Jose", "San Jose", None), by(k, "CA", "CA", "CA", " "), by(k, "Midtown", None, "", None), by(k, None, "120 Main St, San Jose", "9 N", None)).alias("name"))


# --- nested records ------------------------------------------------------------------------

@query("p37_place_json", with_views("v_poi", "SELECT place_id AS id, CAST(place_id AS VARCHAR) AS place_id, name, lat, lng, rating, CAST(review_count AS BIGINT) AS review_count FROM v_poi"))
def _(spark, sf):
    p, k = V.pois(spark, sf), C("place_id")
    new = F.to_json(F.struct(k.cast("string").alias("id"), F.struct(C("name").alias("text")).alias("displayName"), F.struct(C("lat").alias("latitude"), C("lng").alias("longitude")).alias("location"), "rating", C("review_count").alias("userRatingCount")))
    old = F.to_json(F.struct(k.cast("string").alias("place_id"), "name", F.struct(F.struct("lat", "lng").alias("location")).alias("geometry"), "rating", C("review_count").alias("user_ratings_total")))
    return RC.places_from_json(p.select(k.alias("id"), F.when(k % 2 == 0, new).otherwise(old).alias("js")), "js").drop("types")


@query("p38_business_json", with_views("v_poi", "SELECT CAST(place_id AS VARCHAR) AS business_id, name, rating, CAST(review_count AS BIGINT) AS review_count, lat, lng, kind || ',school' AS categories FROM v_poi"))
def _(spark, sf):
    t = lambda c: F.struct(c.alias("title"))
    js = F.to_json(F.struct(C("place_id").cast("string").alias("id"), "name", "rating", "review_count", F.struct(C("lat").alias("latitude"), C("lng").alias("longitude")).alias("coordinates"),
                            F.array(t(C("kind")), t(F.lit(None).cast("string")), t(F.lit("school"))).alias("categories")))
    return RC.business_from_json(V.pois(spark, sf).select(js.alias("js")), "js")


CENTER = """SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '555-0' || CAST(s_suppkey AS VARCHAR) END AS phone, CASE s_suppkey % 5 WHEN 0 THEN 'a@b.ORG' WHEN 1 THEN '' ELSE 'x@y.com' END AS email, CASE WHEN s_suppkey % 3 = 0 THEN 'http://c.com' ELSE '' END AS website,
 """ + R("CASE WHEN s_suppkey % 6 > 0 THEN s_suppkey * 1000.0 * 0.000621371 END", 1) + """ AS distance_miles, '1 Elm, Reno, NV' AS full_address FROM supplier"""


def centers(spark, sf):
    k = C("s_suppkey")
    phone = F.when(k % 4 == 0, "999-999 9999").otherwise(F.concat(F.lit(" 555-0"), k.cast("string")))
    js = F.to_json(F.struct(C("s_name").alias("name"), phone.alias("phone"), by(k, "a@b.ORG", None, "x@y.com", " x@y.com", "x@y.com").alias("email"), F.when(k % 3 == 0, "http://c.com").alias("websiteUrl"),
                            F.when(k % 6 > 0, k * 1000.0).alias("distance"), F.struct(F.lit("1 Elm").alias("address1"), F.lit("Reno").alias("city"), F.lit("NV").alias("state")).alias("organisationProfile")))
    return RC.centers_from_json(V.table(spark, sf, "supplier").select(k.alias("id"), js.alias("js")), "js", "9999999999")


@query("p40_training_centers", CENTER)
def _(spark, sf):
    return centers(spark, sf)


@query("p41_recruiting_leads", f"SELECT id FROM ({CENTER}) WHERE website = '' AND NOT lower(email) LIKE '%.org' AND (email <> '' OR phone <> '') AND coalesce(distance_miles <= 30, true)")
def _(spark, sf):
    return RC.recruiting_leads(centers(spark, sf), 30.0).select("id")


@query("p43_clean_urls", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN u || '?q=1&z=2#top' WHEN 1 THEN u || '?q=1' WHEN 2 THEN u ELSE u || '?a=b' END AS url FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages)")
def _(spark, sf):
    u = F.concat(F.regexp_replace("url", "[?#].*$", ""), by(C("page_id"), "?q=1&api_key=SEC&z=2#top", "?access_token=x&q=1", "?key=1&my_secret=2", "?a=b&maps_key=77"))
    return V.table(spark, sf, "pages").select("page_id", P.clean_url(u).alias("url"))


@query("p44_scrub_staff_fields", "SELECT s_suppkey AS id, s_name AS name, 'yes' AS wifi, 'b' AS deep FROM supplier")
def _(spark, sf):
    k = C("s_suppkey")
    df = V.table(spark, sf, "supplier").select(k.alias("id"), C("s_name").alias("name"), F.lit("1234").alias("door_code"), F.struct(F.lit("yes").alias("wifi"), k.alias("wifi_password"), F.array(F.struct(F.lit("b").alias("note"), k.alias("api_key"))).alias("list")).alias("room"))
    out = RC.scrubbed(df)
    return out.select("id", "name", C("room.wifi").alias("wifi"), F.element_at(F.flatten(F.array("room.list.note")), 1).alias("deep")) if "door_code" not in out.columns else df


AUD_NAMES = ["Google Places API (Nearby Search)", "US Census Bureau ACS", "BLS QCEW", "Manual rent override", "Commercial real estate (not yet integrated)", "Competitor website homepage fetch"]


def sources(spark, sf):
    o, k = orders(spark, sf), C("o_orderkey")
    return o.select(C("o_custkey").alias("candidate_id"), by(k, *AUD_NAMES).alias("name"), F.when(k % 2 == 0, "https://a.b").otherwise("").alias("url"), F.array(F.concat(F.lit("f"), (k % 17).cast("string")), F.lit("")).alias("fields"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("collected_at"))


_fam = by_sql("o_orderkey", "Google Places Nearby Search", "Census ACS", "BLS / Labor Market", "Rent Override", "Commercial real estate (not yet integrated)", "Competitor Website Fetch")
_ql = by_sql("o_orderkey", "platform_api", "official", "official", "manual_override", "stub", "web_fetch")


@query("a47_source_audit", f"SELECT {_fam} AS family, count(*) AS records, count(DISTINCT o_orderkey % 17) AS field_count, any_value({_ql}) AS quality, max(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS data_as_of FROM orders GROUP BY 1")
def _(spark, sf):
    return RC.audit(sources(spark, sf))


@query("a48_candidate_sources", f"SELECT o_custkey AS candidate_id, {_ql} AS quality, count(*) AS records FROM orders GROUP BY 1, 2")
def _(spark, sf):
    return sources(spark, sf).groupBy("candidate_id", P.source_quality(C("name"), C("url")).alias("quality")).agg(F.count("*").alias("records"))


@query("p42_source_quality", f"SELECT {_ql} AS quality, {_fam} AS family, count(*) AS records FROM orders GROUP BY 1, 2")
def _(spark, sf):
    return sources(spark, sf).groupBy(P.source_quality(C("name"), C("url")).alias("quality"), P.source_family(C("name")).alias("family")).agg(F.count("*").alias("records"))


@query("r14_census_indicators", "SELECT p_partkey AS id, " + R("nullif(p_size, 0) * 1.0 / nullif(p_retailprice, 0)", 6) + " AS healthcare_employment_share, " + R("CASE WHEN p_partkey % 5 > 0 THEN p_retailprice / (p_retailprice + 500) END", 6) + " AS employment_rate FROM part")
def _(spark, sf):
    p = V.table(spark, sf, "part")
    df = p.select(C("p_partkey").alias("id"), F.when(C("p_size") != 0, C("p_size")).alias("employed_health"), C("p_retailprice").alias("employed"), F.lit(1.0).alias("bachelors"), F.lit(0.0).alias("edu_total"),
                  F.when(C("p_partkey") % 5 > 0, C("p_retailprice") + 500).alias("working_age"), F.lit(None).cast("double").alias("population"))
    return RC.census_indicators(df).select("id", rnd(C("healthcare_employment_share"), 6).alias("healthcare_employment_share"), rnd(C("employment_rate"), 6).alias("employment_rate"))


@query("r13_labor_quarters", f"""SELECT area, CAST(y AS INT) AS year, CAST(q AS INT) AS quarter, {R('employment', 4)} AS employment, {R('wage', 4)} AS weekly_wage FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY y DESC, q DESC) AS rn FROM (
 SELECT o_custkey % 50 AS area, year(o_orderdate) AS y, quarter(o_orderdate) AS q, CAST(count(*) AS DOUBLE) AS employment, sum(o_totalprice) / count(*) / 13 AS wage FROM orders GROUP BY 1, 2, 3)) WHERE rn = 1""")
def _(spark, sf):
    o = orders(spark, sf).groupBy((C("o_custkey") % 50).alias("area"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(F.count("*").cast("double").alias("month1"), F.sum("o_totalprice").alias("total_wages"))
    q = RC.labor_quarters(o.withColumns({"month2": C("month1"), "month3": C("month1"), "avg_weekly_wage": F.lit(None).cast("double")}))
    return q.select("area", "year", "quarter", rnd(C("employment"), 4).alias("employment"), rnd(C("weekly_wage"), 4).alias("weekly_wage"))


@query("c38_candidate_ids", with_views("v_point", "SELECT point_id, 'ca-san-jose-' || lpad(CAST(point_id % 1000 AS VARCHAR), 3, '0') || '-' || substr(sha256(format('{:.4f},{:.4f}', lat, lng)), 1, 6) AS candidate_id FROM v_point WHERE lat IS NOT NULL"))
def _(spark, sf):
    return V.points(spark, sf).where("lat IS NOT NULL").select("point_id", RC.candidate_id(F.lit("CA"), F.lit("San Jose"), C("point_id") % 1000, C("lat"), C("lng")).alias("candidate_id"))


@query("c39_request_keys", "SELECT count(*) AS requests, count(DISTINCT o_custkey % 40 * 10 + o_orderkey % 2) AS distinct_requests FROM orders")
def _(spark, sf):
    key = RC.request_key(F.lit("places"), F.when(C("o_orderkey") % 2 == 0, "text").otherwise("nearby"), F.struct((C("o_custkey") % 40).alias("a")))
    return orders(spark, sf).select(key.alias("k")).agg(F.count("*").alias("requests"), F.countDistinct("k").alias("distinct_requests"))


# --- time-driven state ------------------------------------------------------------------------

AS_OF = "2000-06-30 12:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def sequences(spark, sf):
    k = C("o_orderkey")
    return orders(spark, sf).select(k.alias("lead_id"), by(k, "ACTIVE", "DONE", "ACTIVE", "PENDING_APPROVAL", "STOPPED_REPLIED").alias("status"), C("o_orderdate").alias("next_touch_at"), k.alias("position"),
                                    F.concat(F.lit("p"), (k % 3000).cast("string"), F.lit("@x.com")).alias("to_email"))


_st = by_sql("o_orderkey", "ACTIVE", "DONE", "ACTIVE", "PENDING_APPROVAL", "STOPPED_REPLIED")


@query("t01_due_touches", f"SELECT lead_id, CASE WHEN row_number() OVER (ORDER BY lead_id) <= 17 THEN 'send' ELSE 'capped' END AS outcome FROM (SELECT o_orderkey AS lead_id FROM orders WHERE {_st} = 'ACTIVE' AND o_orderdate <= TIMESTAMP '{AS_OF}')")
def _(spark, sf):
    return IN.due_touches(sequences(spark, sf), as_of(), 20, 3).select("lead_id", "outcome")


@query("t02_reply_intake", f"""SELECT o.o_orderkey AS lead_id, CASE WHEN f.event_id % 4 = 0 THEN 'STOPPED_OPT_OUT' ELSE 'STOPPED_REPLIED' END AS status, CASE WHEN f.event_id % 4 = 0 THEN 'NOT_INTERESTED' ELSE 'REPLIED' END AS outreach_status
FROM orders o JOIN (SELECT user_id % 3000 AS p, min(event_id) AS event_id FROM events GROUP BY 1) f ON o.o_orderkey % 3000 = f.p WHERE {_st} IN ('ACTIVE','DONE','PENDING_APPROVAL')""")
def _(spark, sf):
    e = V.table(spark, sf, "events").select(F.concat(F.lit("P"), (C("user_id") % 3000).cast("string"), F.lit("@X.com")).alias("from_email"), F.lit("Re: class").alias("subject"),
                                            by(C("event_id"), "please UNSUBSCRIBE me", "sounds good", "call me", "ok").alias("snippet"), C("event_id").alias("received_at"))
    return IN.reply_intake(sequences(spark, sf), e)


@query("t03_refresh_cooldown", f"SELECT o_custkey AS key, coalesce(epoch(TIMESTAMP '{AS_OF}') - epoch(max(o_orderdate)) >= 864000, true) AS allowed FROM orders GROUP BY 1")
def _(spark, sf):
    st = orders(spark, sf).groupBy(C("o_custkey").alias("key")).agg(F.max("o_orderdate").alias("refreshed_at"))
    return IN.refresh_allowed(st, as_of(), 864000).select("key", "allowed")


@query("t04_created_since", f"SELECT count(CASE WHEN epoch(o_orderdate) >= epoch(TIMESTAMP '{AS_OF}') - 240 * 3600 THEN 1 END) AS created FROM orders")
def _(spark, sf):
    return IN.created_since(orders(spark, sf).select(C("o_orderdate").alias("created_at")), as_of(), 240.0)


@query("t05_expired_entries", f"SELECT o_orderkey AS key FROM orders WHERE epoch(TIMESTAMP '{AS_OF}') - epoch(o_orderdate) > (o_orderkey % 5) * 86400 * 100")
def _(spark, sf):
    e = orders(spark, sf).select(C("o_orderkey").alias("key"), C("o_orderdate").alias("as_of"), ((C("o_orderkey") % 5) * 8640000).alias("ttl_seconds"))
    return IN.expired(e, as_of()).select("key")


@query("t05_latest_per_provider", "SELECT o_orderpriority AS provider, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS latest FROM orders GROUP BY 1")
def _(spark, sf):
    return orders(spark, sf).groupBy(C("o_orderpriority").alias("provider")).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("latest"))


@query("t06_run_ledger", "SELECT key, count(CASE WHEN m = 0 THEN 1 END) AS cache_hits, count(CASE WHEN m = 1 THEN 1 END) AS cache_misses, count(CASE WHEN m = 2 THEN 1 END) AS cache_stale, count(CASE WHEN m = 3 THEN 1 END) AS live_calls, count(CASE WHEN m = 3 THEN 1 END) = 0 AND count(CASE WHEN m = 0 THEN 1 END) > 0 AS served_from_cache FROM (SELECT l_suppkey AS key, l_orderkey % 4 AS m FROM lineitem) GROUP BY 1")
def _(spark, sf):
    return IN.run_ledger(V.table(spark, sf, "lineitem").select(C("l_suppkey").alias("key"), by(C("l_orderkey"), "hit", "miss", "stale", "live").alias("outcome")))


def streamed(spark, rows, versions):
    """``rows`` as six files, taken in as a stream two at a time; the newest version per key."""
    base = scratch(spark)
    rows.repartition(6).write.parquet(base + "/in")
    stream = LV.arriving(spark, base + "/in", rows.schema, 2)
    LV.advance(versions(stream), base + "/out", base + "/state")
    return LV.current(spark, base + "/out")


@query("t02_live_replies", """SELECT 'p' || CAST(user_id AS VARCHAR) || '@x.com' AS key, min(event_id) AS received_at, min(event_id) % 4 = 0 AS opted_out FROM events GROUP BY user_id""")
def _(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", F.concat(F.lit("P"), C("user_id").cast("string"), F.lit("@X.com")).alias("sender"), by(C("event_id"), "please UNSUBSCRIBE me", "sounds good", "call me", "ok").alias("words"))
    return streamed(spark, e, lambda s: LV.replies(s, C("sender"), C("event_id"), C("words"))).select("key", "received_at", "opted_out")


@query("t03_live_cooldown", "SELECT CAST(o_custkey AS VARCHAR) AS key, (SELECT max(epoch(o_orderdate)) FROM orders) - max(epoch(o_orderdate)) >= 864000 AS allowed FROM orders GROUP BY 1")
def _(spark, sf):
    rows = orders(spark, sf).select(C("o_custkey").alias("id"), C("o_orderdate").cast("timestamp").alias("refreshed_at"))
    # allowed from the last second of the pause on
    return streamed(spark, rows, lambda s: LV.timers(s, C("id"), C("refreshed_at"), F.lit(864000 - 1))).select("key", C("passed").alias("allowed"))


@query("t04_live_created", "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS created FROM events WHERE ts IS NOT NULL GROUP BY 1")
def _(spark, sf):
    rows = V.table(spark, sf, "events").select("ts")
    return streamed(spark, rows, lambda s: LV.buckets(s, C("ts"), 3600)).select(C("key").alias("hour"), "created")


@query("t05_live_expiry", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(floor(epoch(ts)) AS BIGINT) AS seen, user_id % 5 * 3600 AS ttl FROM events),
 l AS (SELECT key, max(seen) AS stamp, max(ttl) AS seconds FROM e GROUP BY 1) SELECT key, stamp, seconds, coalesce((SELECT max(seen) FROM e) > stamp + seconds, true) AS passed FROM l""")
def _(spark, sf):
    rows = V.table(spark, sf, "events").select("user_id", "ts")
    return streamed(spark, rows, lambda s: LV.timers(s, C("user_id"), C("ts"), C("user_id") % 5 * 3600))


@query("t06_live_ledger", """SELECT key, cache_hits, cache_misses, cache_stale, live_calls, live_calls = 0 AND cache_hits > 0 AS served_from_cache FROM (SELECT CAST(user_id AS VARCHAR) AS key, count(CASE WHEN m = 0 THEN 1 END) AS cache_hits,
 count(CASE WHEN m = 1 THEN 1 END) AS cache_misses, count(CASE WHEN m = 2 THEN 1 END) AS cache_stale, count(CASE WHEN m = 3 THEN 1 END) AS live_calls FROM (SELECT user_id, event_id % 4 AS m FROM events) GROUP BY 1)""")
def _(spark, sf):
    rows = V.table(spark, sf, "events").select("user_id", by(C("event_id"), "hit", "miss", "stale", "live").alias("outcome"))
    return streamed(spark, rows, lambda s: LV.ledger(s, C("user_id"), C("outcome")))


@query("f13_fresh_within", f"SELECT o_orderpriority AS provider, count(CASE WHEN epoch(TIMESTAMP '{AS_OF}') - epoch(o_orderdate) <= 90 * 86400 THEN 1 END) AS fresh FROM orders GROUP BY 1")
def _(spark, sf):
    return orders(spark, sf).groupBy(C("o_orderpriority").alias("provider")).agg(F.count_if(IN.fresh_within(C("o_orderdate"), as_of(), 90)).alias("fresh"))


# --- joins of whole layers ---------------------------------------------------------------------

@query("j01_class_locations", """WITH raw AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'hall a' ELSE 'site ' || CAST(s_suppkey AS VARCHAR) END AS key, 'Town' || CAST(s_suppkey AS VARCHAR) AS city FROM supplier),
 dim AS (SELECT key, arg_min(city, s_suppkey) AS city, count(*) > 1 AS ambiguous FROM raw GROUP BY 1)
SELECT CASE WHEN d.key IS NULL THEN 'unmatched' WHEN ambiguous THEN 'ambiguous' ELSE 'matched' END AS match, count(*) AS classes, count(CASE WHEN NOT ambiguous THEN d.city END) AS with_city FROM (SELECT CASE WHEN l_suppkey % 10 = 0 THEN 'hall a' WHEN l_suppkey % 10 = 1 THEN 'nowhere' ELSE 'site ' || CAST(l_suppkey AS VARCHAR) END AS key FROM lineitem) l LEFT JOIN dim d ON l.key = d.key GROUP BY 1""")
def _(spark, sf):
    k, s = C("s_suppkey"), C("l_suppkey")
    raw = V.table(spark, sf, "supplier").select(F.when(k % 10 == 0, "Hall A (t)").otherwise(F.concat(F.lit("Site  "), k.cast("string"))).alias("abbr"),
                                                F.concat(F.lit("X(1 Elm, Town"), F.translate(k.cast("string"), "0123456789", "abcdefghij"), F.lit(", CA "), F.lpad(k.cast("string"), 5, "0"), F.lit(")")).alias("name"), k.alias("pos"))
    dim = CL.location_dimension(raw, "abbr", "name", "pos")
    recs = V.table(spark, sf, "lineitem").select(F.lit(None).cast("string").alias("city"), F.when(s % 10 == 0, "hall a").when(s % 10 == 1, "Nowhere").otherwise(F.concat(F.lit("Site "), s.cast("string"))).alias("location"))
    return CL.attach_locations(recs, dim).groupBy("match").agg(F.count("*").alias("classes"), F.count("city").alias("with_city"))


@query("a23_location_dimension", """SELECT CASE WHEN s_suppkey % 10 = 0 THEN 'hall a' ELSE 'site ' || CAST(s_suppkey // 2 AS VARCHAR) END AS place_key, count(*) AS copies, count(DISTINCT s_suppkey % 4) > 1 AS ambiguous, CASE WHEN count(DISTINCT s_suppkey) = 1 THEN lpad(CAST(min(s_suppkey) AS VARCHAR), 5, '0') END AS zip FROM supplier GROUP BY 1""")
def _(spark, sf):
    k = C("s_suppkey")
    raw = V.table(spark, sf, "supplier").select(F.when(k % 10 == 0, "Hall A").otherwise(F.concat(F.lit("Site "), F.floor(k / 2).cast("string"))).alias("abbr"),
                                                F.concat(F.lit("X(1 Elm, "), by(k, "Reno", "Elko", "Ely", "Fallon"), F.lit(", NV "), F.lpad(k.cast("string"), 5, "0"), F.lit(")")).alias("name"), k.alias("pos"))
    return CL.location_dimension(raw, "abbr", "name", "pos").select("place_key", "copies", "ambiguous", "zip")


@query("j03_bulk_sources_merged", """WITH a AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS zip, 1 AS x FROM supplier WHERE s_suppkey % 2 = 0), b AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS zip, 2 AS y FROM supplier WHERE s_suppkey % 3 = 0), c AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS zip, 3 AS x FROM supplier WHERE s_suppkey % 5 = 0)
SELECT zip, coalesce(c.x, a.x) AS x, b.y, concat_ws(',', CASE WHEN a.zip IS NOT NULL THEN 'HIFLD' END, CASE WHEN b.zip IS NOT NULL THEN 'NPI' END, CASE WHEN c.zip IS NOT NULL THEN 'IPEDS' END) AS sources FROM a FULL JOIN b USING (zip) FULL JOIN c USING (zip)""")
def _(spark, sf):
    z = V.centroids(spark, sf).select("zip")
    k = C("zip").cast("int")
    return FA.merge_sources({"HIFLD": z.where(k % 2 == 0).withColumn("x", F.lit(1)), "NPI": z.where(k % 3 == 0).withColumn("y", F.lit(2)), "IPEDS": z.where(k % 5 == 0).withColumn("x", F.lit(3))}).withColumn("sources", joined(C("sources")))


@query("j04_bulk_onto_national", with_views("v_zip", "SELECT zip, CASE WHEN CAST(zip AS INT) % 3 = 0 THEN hospital_count ELSE NULL END AS hospital_count, CASE WHEN CAST(zip AS INT) % 3 = 0 THEN 'bulk_enriched' ELSE 'baseline' END AS tier FROM v_zip"))
def _(spark, sf):
    z = zips(spark, sf)
    bulk = z.where(C("zip").cast("int") % 3 == 0).select("zip", "hospital_count", F.lit("bulk_enriched").alias("tier2"))
    return z.select("zip").join(bulk, "zip", "left").select("zip", "hospital_count", F.coalesce("tier2", F.lit("baseline")).alias("tier"))


@query("j06_resume_undone", with_views("v_zip", "SELECT zip FROM v_zip WHERE population IS NOT NULL AND CAST(zip AS INT) % 4 > 0 UNION SELECT zip FROM v_zip WHERE CAST(zip AS INT) % 25 = 0"))
def _(spark, sf):
    z = zips(spark, sf)
    k = C("zip").cast("int")
    todo = z.where("population IS NOT NULL").select("zip").join(z.where(k % 4 == 0).select("zip"), "zip", "left_anti")
    return todo.union(z.select("zip").join(z.where(k % 25 == 0).select("zip"), "zip", "left_semi")).distinct()


@query("c11_priority_zips", with_views("v_zip", """SELECT zip, min(p) AS position FROM (SELECT zip, CAST(zip AS BIGINT) AS p FROM v_zip WHERE CAST(zip AS INT) % 9 = 0 UNION ALL SELECT zip, 1000000000 + rn FROM (SELECT zip, row_number() OVER (ORDER BY demand_score DESC NULLS LAST, zip) AS rn FROM v_zip) WHERE rn <= 20) GROUP BY 1"""))
def _(spark, sf):
    from pyspark.sql.window import Window as W
    z = zips(spark, sf)
    curated = z.where(C("zip").cast("int") % 9 == 0).select("zip", C("zip").cast("bigint").alias("position"))
    # the window sees at most the requested twenty rows
    top = z.select("zip", "demand_score").orderBy(C("demand_score").desc_nulls_last(), "zip").limit(20)
    ranked = top.withColumn("position", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(C("demand_score").desc_nulls_last(), "zip")).cast("bigint") + 1000000000).select("zip", "position")
    return MT.first_per_value(curated.unionByName(ranked), "zip", "position")


@query("c10_category_status", with_views("v_zip v_place", """SELECT z.zip, c.category, coalesce(p.k, 0) AS places, CASE WHEN z.lat IS NULL THEN 'no_coordinates' WHEN p.k IS NULL THEN 'missing' ELSE 'ok' END AS status FROM v_zip z CROSS JOIN (SELECT DISTINCT category FROM v_place) c
 LEFT JOIN (SELECT lpad(CAST(place_id * 7 % 100 AS VARCHAR), 5, '0') AS zip, category, count(*) AS k FROM v_place GROUP BY 1, 2) p ON z.zip = p.zip AND c.category = p.category"""))
def _(spark, sf):
    # the category list is fixed, so it is exploded inside each row
    z = zips(spark, sf).select("zip", "lat", F.explode(arr(*CATS)).alias("category"))
    k = places(spark, sf).groupBy(F.lpad((C("place_id") * 7 % 100).cast("string"), 5, "0").alias("zip"), "category").agg(F.count("*").alias("k"))
    return z.join(k, ["zip", "category"], "left").select("zip", "category", F.coalesce("k", F.lit(0)).alias("places"), pick((C("lat").isNull(), "no_coordinates"), (C("k").isNull(), "missing"), default="ok").alias("status"))


@query("c07_zip_poi_evidence", with_views("v_poi", f"""SELECT lpad(CAST(place_id * 7 % 100 AS VARCHAR), 5, '0') AS zip, count(DISTINCT CASE WHEN kind IN ('hospital','urgent care') THEN place_id END) AS healthcare, count(DISTINCT CASE WHEN kind = 'nursing school' THEN place_id END) AS training,
 count(DISTINCT CASE WHEN kind = 'CPR training' THEN place_id END) AS competitors, {R("avg(CASE WHEN kind = 'CPR training' THEN rating END)", 2)} AS competitor_rating FROM v_poi GROUP BY 1"""))
def _(spark, sf):
    p = V.pois(spark, sf).withColumn("zip", F.lpad((C("place_id") * 7 % 100).cast("string"), 5, "0"))
    # each query group can return a place several times
    seen = MT.distinct_places(p.unionByName(p.where(C("place_id") % 3 == 0)), "place_id")
    return seen.groupBy("zip").agg(F.count_if(C("kind").isin("hospital", "urgent care")).alias("healthcare"), F.count_if(C("kind") == "nursing school").alias("training"), F.count_if(C("kind") == "CPR training").alias("competitors"),
                                   rnd(F.avg(F.when(C("kind") == "CPR training", C("rating"))), 2).alias("competitor_rating"))


_plain = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


@query("j29_site_health_by_name", f"""WITH s AS (SELECT s_suppkey AS position, CASE WHEN s_suppkey % 4 = 0 THEN lpad(CAST(s_suppkey % 700 AS VARCHAR), 5, '0') END AS zip, CASE WHEN s_suppkey % 6 > 0 THEN {_plain("s_name")} ELSE '' END AS n FROM supplier),
 l AS (SELECT c_custkey AS loc, CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey % 700 AS VARCHAR), 5, '0') END AS zip, CASE c_custkey % 4 WHEN 0 THEN 'room at ' || {_plain("'Supplier#' || lpad(CAST(c_custkey % 120 AS VARCHAR), 9, '0')")} WHEN 1 THEN {_plain("'Supplier#0000000' || CAST(c_custkey % 12 AS VARCHAR)")} WHEN 2 THEN '' ELSE 'nobody' END AS n FROM customer),
 z AS (SELECT loc, min(position) AS p FROM l JOIN s USING (zip) GROUP BY 1), m AS (SELECT loc, min(position) AS p FROM l JOIN s ON s.n <> '' AND (contains(l.n, s.n) OR contains(s.n, l.n)) GROUP BY 1)
SELECT l.loc, coalesce(z.p, m.p) AS position FROM l LEFT JOIN z USING (loc) LEFT JOIN m USING (loc) WHERE coalesce(z.p, m.p) IS NOT NULL""")
def _(spark, sf):
    k, s = C("c_custkey"), C("s_suppkey")
    numbered = lambda x: T.plain_name(F.concat(F.lit("Supplier#"), F.lpad(x.cast("string"), 9, "0")))
    name = F.when(k % 4 == 0, F.concat(F.lit("room at "), numbered(k % 120))).when(k % 4 == 1, T.plain_name(F.concat(F.lit("Supplier#0000000"), (k % 12).cast("string")))).when(k % 4 == 2, "").otherwise("nobody")
    loc = V.table(spark, sf, "customer").select(k.alias("loc"), F.when(k % 3 == 0, F.lpad((k % 700).cast("string"), 5, "0")).alias("zip"), name.alias("name"))
    site = V.table(spark, sf, "supplier").select(s.alias("position"), F.when(s % 4 == 0, F.lpad((s % 700).cast("string"), 5, "0")).alias("zip"), F.when(s % 6 > 0, T.plain_name(C("s_name"))).otherwise("").alias("name"))
    return MT.match_by_area_then_name(loc, site)


@query("j24_rent_template_merge", with_views("v_point v_site", """SELECT g.point_id AS row_id, w.r_id AS filled_id FROM v_point g LEFT JOIN walk w ON w.l_id = g.point_id AND w.r_id IS NOT NULL
 UNION ALL SELECT NULL, site_id FROM v_site WHERE site_id NOT IN (SELECT r_id FROM walk WHERE r_id IS NOT NULL)""",
       raw=f"""p AS (SELECT g.point_id AS l_id, s.site_id AS r_id FROM v_point g JOIN v_site s ON g.lat IS NOT NULL AND {HAV('g.lat', 'g.lng', 's_lat', 's_lng', 3958.7613)} <= 0.3),
 q AS MATERIALIZED (SELECT row_number() OVER (ORDER BY l_id) AS i, l_id, list(r_id ORDER BY r_id) AS rs FROM p GROUP BY l_id),
 walk(i, used, l_id, r_id) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT UNION ALL
  SELECT i, CASE WHEN t IS NULL THEN used ELSE list_append(used, t) END, l_id, t FROM (SELECT q.i, w.used, q.l_id, list_filter(q.rs, lambda x: NOT list_contains(w.used, x))[1] AS t FROM walk w JOIN q ON q.i = w.i + 1))""").replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, sf):
    from demandgrid.plans.q_ops import sites
    g = V.points(spark, sf).select(C("point_id").alias("row_id"), "lat", "lng")
    return MT.replace_filled(g, sites(spark, sf).select(C("site_id").alias("filled_id"), C("s_lat").alias("lat"), C("s_lng").alias("lng")), 0.3)


# --- interpretation of candidates -------------------------------------------------------------

@query("m45_competitor_bands", with_views("v_candw v_place v_comp", """SELECT candidate_id, CASE WHEN coalesce(competitors_5mi, 0) <= 1 THEN 'Low' WHEN competitors_5mi <= 4 THEN 'Medium' WHEN competitors_5mi <= 9 THEN 'High' ELSE 'Very High' END AS density,
 CASE WHEN competitor_avg_rating IS NULL THEN 'Unknown' WHEN competitor_avg_rating >= 4.5 THEN 'Strong' WHEN competitor_avg_rating >= 3.8 THEN 'Mixed' ELSE 'Weak' END AS quality, CASE WHEN competition_gap_score >= 65 THEN 'High' WHEN competition_gap_score >= 35 THEN 'Medium' ELSE 'Low' END AS market_gap FROM b1""",
       **__import__("demandgrid.plans.q_candidates", fromlist=["COMPETED"]).COMPETED))
def _(spark, sf):
    c, r, g = F.coalesce(C("competitors_5mi"), F.lit(0)), C("competitor_avg_rating"), C("competition_gap_score")
    return with_competition(spark, sf).select("candidate_id", pick((c <= 1, "Low"), (c <= 4, "Medium"), (c <= 9, "High"), default="Very High").alias("density"),
                                              pick((r.isNull(), "Unknown"), (r >= 4.5, "Strong"), (r >= 3.8, "Mixed"), default="Weak").alias("quality"), pick((g >= 65, "High"), (g >= 35, "Medium"), default="Low").alias("market_gap"))


@query("m59_density_mode", with_views("v_candw v_comp", "SELECT c.candidate_id, CASE WHEN coalesce(m.competitors_5mi, 0) >= 20 THEN 'dense' ELSE 'normal' END AS mode FROM v_candw c LEFT JOIN comp m ON c.candidate_id = m.candidate_id", **ctes("cpairs", "comp")))
def _(spark, sf):
    from demandgrid.plans.q_candidates import at, competitors
    c = cands(spark, sf)
    s = at(K.competition_summary(c, competitors(spark, sf))).select("lat", "lng", "competitors_5mi")
    return c.select("candidate_id", "lat", "lng").join(s, ["lat", "lng"], "left").select("candidate_id", F.when(C("competitors_5mi") >= 20, "dense").otherwise("normal").alias("mode"))


@query("m44_expansion_readiness", with_views("v_candw", """SELECT candidate_id, ['Weak','Moderate','Strong'][CAST(least(CASE WHEN s >= 80 AND c >= 60 AND rk THEN 2 WHEN s >= 65 AND c >= 35 THEN 1 ELSE 0 END, CASE WHEN rk THEN 2 ELSE 1 END, CASE WHEN c < 30 THEN 0 ELSE 2 END) + 1 AS INT)] AS readiness
 FROM (SELECT candidate_id, coalesce(history_score, 0) AS s, candidate_id * 11 % 101 AS c, rent_per_sqft_annual IS NOT NULL AS rk FROM v_candw)"""))
def _(spark, sf):
    s, c, rk = F.coalesce(C("history_score"), F.lit(0.0)), C("candidate_id") * 11 % 101, C("rent_per_sqft_annual").isNotNull()
    level = F.least(pick(((s >= 80) & (c >= 60) & rk, 2), ((s >= 65) & (c >= 35), 1), default=0), F.when(rk, 2).otherwise(1), F.when(c < 30, 0).otherwise(2))
    return cands(spark, sf).select("candidate_id", F.element_at(arr("Weak", "Moderate", "Strong"), level + 1).alias("readiness"))


IMPORTANCE = {"hospital": 0, "nursing_school": 0, "medical_school": 0, "fire_station": 1, "ems": 1, "community_college": 1, "university": 1}


@query("k10_demand_drivers", with_views("v_candw v_place", f"""SELECT candidate_id, category, within_5 AS places, CAST(rn AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY CASE category {' '.join(f"WHEN '{k}' THEN {v}" for k, v in IMPORTANCE.items())} ELSE 2 END, within_5 DESC, category) AS rn FROM bk WHERE within_5 > 0) WHERE rn <= 5""", **ctes("pairs", "bk")))
def _(spark, sf):
    c = cands(spark, sf)
    b = K.demand_buckets(c, places(spark, sf)).where("within_5 > 0").withColumn("imp", lookup(C("category"), IMPORTANCE, 2))
    top = top_per(b, ["at_lat", "at_lng"], [C("imp"), C("within_5").desc(), C("category")], 5, "position")
    return K.back_to(c, top.select("at_lat", "at_lng", "category", C("within_5").alias("places"), "position"))


@query("a60_zip_dashboard_rows", with_views("modeled", """SELECT zip, overall, CASE WHEN confidence = 'ok' THEN 'High' WHEN confidence = 'partial' THEN 'Medium' ELSE 'Low' END AS confidence_band, CASE WHEN cpr_demand > bls_demand THEN 'CPR' WHEN bls_demand IS NOT NULL THEN 'BLS' WHEN cpr_demand IS NOT NULL THEN 'CPR' END AS best_course, greatest(bls_demand, cpr_demand) AS best_score FROM modeled"""))
def _(spark, sf):
    b, c = C("bls_demand"), C("cpr_demand")
    return model(spark, sf).select("zip", "overall", pick((C("confidence") == "ok", "High"), (C("confidence") == "partial", "Medium"), default="Low").alias("confidence_band"),
                                   pick((c > b, "CPR"), (b.isNotNull(), "BLS"), (c.isNotNull(), "CPR")).alias("best_course"), F.greatest(b, c).alias("best_score"))


@query("a58_course_with_most_students", with_views("held", "SELECT city, arg_max(course_type, s) AS best_course FROM (SELECT city, course_type, sum(enrolled) * 1000 - ascii(course_type) AS s FROM held GROUP BY 1, 2) GROUP BY 1"))
def _(spark, sf):
    from demandgrid.plans.q_classes import held
    s = held(spark, sf).groupBy("city", "course_type").agg((F.sum("enrolled") * 1000 - F.ascii("course_type")).alias("s"))
    return s.groupBy("city").agg(F.max_by("course_type", "s").alias("best_course"))


@query("a59_report_metadata", with_views("modeled", "SELECT validation_tier, count(*) AS zip_rows, count(CASE WHEN model_tier = 'enriched' THEN 1 END) AS enriched, count(DISTINCT model_tier) AS model_tiers, min(zip) AS first_zip FROM modeled GROUP BY 1"))
def _(spark, sf):
    return model(spark, sf).groupBy("validation_tier").agg(F.count("*").alias("zip_rows"), F.count_if(C("model_tier") == "enriched").alias("enriched"), F.countDistinct("model_tier").alias("model_tiers"), F.min("zip").alias("first_zip"))


@query("a52_action_queue", with_views("v_zip", """SELECT grp AS task_group, count(*) AS tasks FROM (SELECT 'confirm_instructor' AS grp FROM v_zip WHERE nursing_school_count >= 2 UNION ALL SELECT 'find_room' FROM v_zip WHERE coalesce(community_facility_count, 0) < 10 UNION ALL SELECT 'check_commercial' FROM v_zip WHERE commercial_ready IS NULL
 UNION ALL SELECT 'fix_site' FROM v_zip WHERE fill_rate < 40 UNION ALL SELECT 'add_data' FROM v_zip WHERE population IS NULL) GROUP BY 1"""))
def _(spark, sf):
    # one pass: every ZIP lists its tasks, no branch reads the table again
    tasks = F.array_compact(F.array(F.when(C("nursing_school_count") >= 2, "confirm_instructor"), F.when(F.coalesce(C("community_facility_count"), F.lit(0.0)) < 10, "find_room"), F.when(C("commercial_ready").isNull(), "check_commercial"),
                                    F.when(C("fill_rate") < 40, "fix_site"), F.when(C("population").isNull(), "add_data")))
    return zips(spark, sf).select(F.explode(tasks).alias("task_group")).groupBy("task_group").agg(F.count("*").alias("tasks"))


# --- files ---------------------------------------------------------------------------------------

def scratch(spark) -> str:
    """A fresh folder in the shared checkpoint location."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get() + "/files-" + uuid.uuid4().hex


@query("s02_class_file_load", with_views("c", "SELECT course_type, month, count(*) AS classes, CAST(sum(enrolled) AS BIGINT) AS students FROM c GROUP BY 1, 2"))
def _(spark, sf):
    path = scratch(spark)
    V.class_table(spark, sf).select(C("class_name").alias("Class Name"), F.date_format("class_date", "MM/dd/yyyy").alias("Class Date"), C("enrolled").alias("Students Enrolled"), C("capacity").alias("Max Students"),
                                    C("city").alias("City"), C("status").alias("Status")).write.option("header", True).csv(path)
    return RD.class_history(spark, path).groupBy("course_type", "month").agg(F.count("*").alias("classes"), F.sum("enrolled").alias("students"))


@query("s05_gazetteer_file", with_views("v_centroid v_zip_signal", "SELECT c.zip, c.lat, c.lng, z.land_sqmi FROM v_centroid c JOIN v_zip_signal z ON c.zip = z.zip"))
def _(spark, sf):
    path = scratch(spark)
    z = V.centroids(spark, sf).join(V.zip_signals(spark, sf).select("zip", "land_sqmi"), "zip")
    z.select(C("zip").cast("int").alias("GEOID"), F.when(C("land_sqmi") > 0, C("land_sqmi").cast("string")).otherwise("x").alias("ALAND_SQMI"), C("lat").alias("INTPTLAT"), C("lng").alias("INTPTLONG ")).write.option("header", True).option("sep", "\t").csv(path)
    return RD.gazetteer(spark, path)


@query("s08_provider_file", "SELECT lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS zip, count(*) AS healthcare_provider_count, count(CASE WHEN l_linenumber = 2 THEN 1 END) AS clinic_provider_count FROM lineitem GROUP BY 1")
def _(spark, sf):
    path = scratch(spark)
    V.table(spark, sf, "lineitem").select(C("l_orderkey").alias("NPI"), C("l_linenumber").alias("Entity Type Code"), F.concat(F.lpad(C("l_suppkey").cast("string"), 5, "0"), F.lit("0001")).alias("Provider Business Practice Location Address Postal Code"),
                                          F.lit("163W").alias("Healthcare Provider Taxonomy Code_1"), C("l_shipdate").alias("Other")).write.option("header", True).csv(path)
    p = RD.providers(spark, path)
    return FA.providers_per_zip(p, C("zip"), C("taxonomy"), C("entity")).select("zip", "healthcare_provider_count", "clinic_provider_count")


@query("s10_map_elements_file", with_views("v_poi", "SELECT CASE place_id % 3 WHEN 0 THEN 'school' WHEN 1 THEN 'commercial' END AS kind, count(*) AS elements FROM v_poi WHERE place_id % 3 < 2 GROUP BY 1"))
def _(spark, sf):
    path, k = scratch(spark), C("place_id")
    e = F.struct(F.lit("way").alias("type"), F.when(k % 2 == 0, C("lat")).alias("lat"), F.when(k % 2 == 0, C("lng")).alias("lon"), F.when(k % 2 == 1, F.struct(C("lat"), C("lng").alias("lon"))).alias("center"),
                 F.struct(by(k, "school", None, "bench").alias("amenity"), by(k, None, "books", None).alias("shop")).alias("tags"))
    V.pois(spark, sf).select(F.array(e).alias("elements")).write.json(path)
    return RD.map_elements(spark, path, lines=True).groupBy("kind").agg(F.count("*").alias("elements"))


def array_files(df, text, head: str, tail: str):
    """Rows as large JSON arrays: 16 files, each one array in the order of the ids, commas between rows."""
    w = Window.partitionBy("part").orderBy("id")
    rows = df.select(F.pmod(F.hash("id"), F.lit(16)).alias("part"), "id", text.alias("v"))
    ends = rows.select("part", "id", F.concat(F.when(F.row_number().over(w) == 1, head).otherwise(","), "v", F.when(F.lead("id").over(w).isNull(), tail).otherwise("")).alias("value"))
    path = scratch(df.sparkSession)
    ends.repartition(16, "part").sortWithinPartitions("part", "id").select("part", "value").write.partitionBy("part").text(path)
    return path


@query("s10_map_array_file", with_views("v_poi", """SELECT CASE place_id % 3 WHEN 0 THEN 'school' WHEN 1 THEN 'commercial' END AS kind, lat, lng, count(*) AS elements FROM v_poi WHERE place_id % 3 < 2 GROUP BY ALL"""))
def _(spark, sf):
    k = C("place_id")
    tags = F.create_map(F.lit("name"), F.concat(C("name"), F.lit(' } "x" ] {')), F.lit("amenity"), by(k, "school", "", "bench"), F.lit("shop"), by(k, "", "books", ""))
    at = F.struct("lat", C("lng").alias("lon"))
    e = F.struct(F.lit("way").alias("type"), F.when(k % 2 == 0, C("lat")).alias("lat"), F.when(k % 2 == 0, C("lng")).alias("lon"), F.when(k % 2 == 1, at).alias("center"), tags.alias("tags"))
    path = array_files(V.pois(spark, sf).withColumn("id", k), F.to_json(e), '{"version":0.6,"osm3s":{"note":"[{"},"elements":[', '],"remark":[{"type":"node","lat":1,"lon":1,"tags":{"amenity":"school"}}]}')
    return RD.map_elements(spark, path).groupBy("kind", "lat", "lng").agg(F.count("*").alias("elements"))


@query("s06_acs_array_file", with_views("v_zip_signal", f"""SELECT zip, CASE WHEN k % 5 > 0 THEN population END::DOUBLE AS population, median_household_income::DOUBLE AS median_household_income,
 {R('CASE WHEN k % 5 > 0 AND population > 0 THEN (k % 9) * 10.0 / population END', 6)} AS working_age_share FROM (SELECT *, CAST(zip AS INT) AS k FROM v_zip_signal)"""))
def _(spark, sf):
    z, k = V.zip_signals(spark, sf), C("zip").cast("int")
    s = lambda c: F.coalesce(c.cast("string"), F.lit("-666666666"))
    names = ["NAME", "B01003_001E", "B19013_001E", "B23025_001E", "B23025_004E", "B15003_001E", *[f"B15003_0{i}E" for i in (22, 23, 24, 25)], "C24050_046E", "zip code tabulation area"]
    cells = F.array(F.concat(F.lit('Area ["'), C("zip"), F.lit('"]')), s(F.when(k % 5 > 0, C("population"))), s(C("median_household_income")), s(k % 9 * 10), *[F.lit("-666666666")] * 7, k.cast("string"))
    path = array_files(z.withColumn("id", k), F.to_json(cells), json.dumps([names])[:-1] + ",", "]")
    return RD.acs_table(spark, path).select("zip", "population", "median_household_income", rnd(C("working_age_share"), 6).alias("working_age_share"))


@query("s11_postings_with_line_breaks", """SELECT CAST(doc_id AS VARCHAR) AS title, md5(replace(replace(text, chr(13), ' '), chr(92), '/')) AS description_md5, CAST(doc_id % 9 AS DOUBLE) AS radius_miles, CASE WHEN doc_id % 2 = 0 THEN 'a "b", c' || chr(10) ELSE 'plain' END AS notes
 FROM documents""")
def _(spark, sf):
    k = C("doc_id")
    cols = {"title": k, "description": F.translate("text", "\r\\", " /"), "radius_miles": k % 9, "latitude": F.lit(37.1), "longitude": F.lit(-122.1), "notes": F.when(k % 2 == 0, 'a "b", c\n').otherwise("plain")}
    raw = V.table(spark, sf, "documents").select(*[cols.get(c, F.lit("x")).alias(c) for c in RD.POSTING_COLUMNS])
    path = scratch(spark)
    raw.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return RD.job_postings(spark, path).select("title", F.md5("description").alias("description_md5"), "radius_miles", "notes")


@query("s06_acs_table", with_views("v_zip_signal", f"""SELECT zip, population, {R('CASE WHEN population > 0 THEN population * (40 + k % 30) / 100.0 / population END', 6)} AS working_age_share,
 {R('CASE WHEN population > 0 THEN ((k % 7) * population / 100.0 + CASE WHEN k % 4 > 0 THEN population * 0.01 ELSE 0 END) / population END', 6)} AS bachelors_or_higher_share FROM (SELECT *, CAST(zip AS INT) AS k FROM v_zip_signal)"""))
def _(spark, sf):
    z = V.zip_signals(spark, sf)
    pop, k = C("population"), C("zip").cast("int")
    s = lambda c: F.coalesce(c.cast("string"), F.lit("-666666666"))
    raw = z.select(C("zip").cast("int").cast("string").alias("ZCTA"), s(pop).alias("B01003_001E"), s(C("median_household_income")).alias("B19013_001E"), s(pop * (40 + k % 30) / 100).alias("B23025_001E"), s(pop * 0.3).alias("B23025_004E"), s(pop).alias("B15003_001E"),
                   F.lit("-666666666").alias("B15003_022E"), s((k % 7) * pop / 100).alias("B15003_023E"), s(F.when(k % 4 > 0, pop * 0.01)).alias("B15003_024E"), F.lit("bad").alias("B15003_025E"), F.lit(None).cast("string").alias("C24050_046E"))
    return RD.acs(raw).select("zip", "population", rnd(C("working_age_share"), 6).alias("working_age_share"), rnd(C("bachelors_or_higher_share"), 6).alias("bachelors_or_higher_share"))


@query("s26_detail_sink", with_views("v_zip", "SELECT zip, population, median_household_income FROM v_zip WHERE zip = '00042'"))
def _(spark, sf):
    path = scratch(spark)
    SK.write_detail(zips(spark, sf).select("zip", "population", "median_household_income"), path)
    return SK.read_detail(spark, path, "00042")


@query("s27_lite_rows", with_views("modeled", "SELECT zip, lat, lng AS lon, overall AS overall_score, bls_demand AS aha_bls, bls_demand AS arc_bls, cpr_demand AS arc_cpr, model_tier AS tier, confidence AS data_confidence, validation_score, validation_tier FROM modeled"))
def _(spark, sf):
    return RC.lite(model(spark, sf).withColumns({"tier": C("model_tier"), "data_confidence": C("confidence")}))


@query("s28_candidate_csv", with_views("v_candw", "SELECT candidate_id, coalesce(state, 'unknown') AS state, coalesce(CAST(CAST(square_feet AS INT) AS VARCHAR), 'unknown') AS square_feet FROM v_candw"))
def _(spark, sf):
    path = scratch(spark)
    SK.write_candidates(cands(spark, sf).select("candidate_id", "state", C("square_feet").cast("int").alias("square_feet")), path)
    return RD.big_csv(spark, path).withColumn("candidate_id", C("candidate_id").cast("bigint"))


@query("c41_safe_payload", "SELECT page_id, regexp_replace(url, '[?#].*$', '') || '?q=1' AS url FROM pages")
def _(spark, sf):
    path = scratch(spark)
    SK.write_payload(V.table(spark, sf, "pages").select("page_id", F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("?api_key=1&q=1")).alias("url"), F.lit("x").alias("gate_code")), path, ["url"])
    return spark.read.schema("page_id bigint, url string, gate_code string").json(path).where("gate_code IS NULL").drop("gate_code")
