"""Registered queries over ZIP demand, order statistics and geometry."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from demandgrid.functions.exprs import haversine, haversine_meters, joined, rnd
from demandgrid.operators import geo as G
from demandgrid.operators import pyramid as PY
from demandgrid.operators import ranks as RK
from demandgrid.operators import refresh as RF
from demandgrid.operators import zip_demand as Z
from demandgrid.operators.classes import is_held
from demandgrid.plans import views as V
from demandgrid.plans.q_classes import AVG2, CUTOFF, FILL, held
from demandgrid.plans.registry import query
from demandgrid.plans.sql import CLAMP, HAV, R, extend, with_views
from demandgrid.session import shared_dir

C = F.col


def profiles(spark, sf):
    return Z.zip_profiles(held(spark, sf))


def with_anchors(spark, sf):
    """Profiles, reference average and newest date from one scan of the classes."""
    return Z.profiles_and_anchors(V.classes(spark, sf), is_held(CUTOFF) & (C("enrolled") > 0))


def scored(spark, sf):
    return Z.scored_profiles(*with_anchors(spark, sf))


def _bucket_cols(b):
    k = b.lower()
    fill = FILL.replace("enrolled END", f"enrolled END) FILTER (bucket = '{b}'").replace("capacity END", f"capacity END) FILTER (bucket = '{b}'")
    num = f"sum(CASE WHEN bucket = '{b}' AND capacity > 0 THEN enrolled END)"
    den = f"sum(CASE WHEN bucket = '{b}' AND capacity > 0 THEN capacity END)"
    return f"""count(CASE WHEN bucket = '{b}' THEN 1 END) AS {k}_classes,
 CAST(coalesce(sum(CASE WHEN bucket = '{b}' THEN enrolled END), 0) AS BIGINT) AS {k}_students,
 CAST({den} AS BIGINT) AS {k}_capacity, {R(f"{num} * 100.0 / {den}", 1)} AS {k}_fill"""


extend("prof", f"""SELECT zip, count(*) AS total_classes, CAST(sum(enrolled) AS BIGINT) AS total_students, {AVG2} AS average_students,
 CAST(sum(CASE WHEN capacity > 0 THEN capacity END) AS BIGINT) AS total_capacity, {FILL} AS fill_rate,
 CAST(min(class_date) AS VARCHAR) AS earliest_class_date, CAST(max(class_date) AS VARCHAR) AS latest_class_date,
 string_agg(DISTINCT lower(city), ',' ORDER BY lower(city)) AS cities,
 {", ".join(_bucket_cols(b) for b in ("ARC_CPR", "ARC_BLS", "AHA_BLS"))}
 FROM held WHERE zip IS NOT NULL GROUP BY zip""", ["held"])
extend("anchor", f"SELECT (SELECT {AVG2} FROM held) AS ref, (SELECT CAST(max(class_date) AS VARCHAR) FROM c) AS latest", ["held"])


def score_sql(source: str) -> str:
    """Score columns over a profile relation."""
    return f"""SELECT *, {R("greatest(-5.0, least(5.0, (zip_demand_score - 50.0) / 50.0 * 5.0))", 2)} AS adjustment,
 CASE WHEN zip_demand_score >= 90 THEN 'Very Strong' WHEN zip_demand_score >= 75 THEN 'Strong' WHEN zip_demand_score >= 60 THEN 'Moderate'
  WHEN zip_demand_score >= 40 THEN 'Weak' ELSE 'Very Weak' END AS strength,
 greatest(-10.0, least(10.0, CASE WHEN total_classes >= 20 THEN 4.0 WHEN total_classes >= 8 THEN 2.0 ELSE -4.0 END
  + CASE WHEN fill_rate >= 70 THEN 3.0 WHEN fill_rate < 40 THEN -3.0 ELSE 0.0 END
  + CASE WHEN age <= 6 THEN 3.0 WHEN age > 18 THEN -3.0 ELSE 0.0 END))::DOUBLE AS confidence_modifier FROM (
 SELECT *, {R('''least(100.0, 100.0 * (0.45 * least(1.0, ln(1.0 + k3) / ln(41.0)) + 0.30 * coalesce(least(1.0, s3 * 1.0 / nullif(k3, 0) / ref), 0)
  + 0.25 * greatest(0.0, least(1.0, 1.0 - age / 18.0))) * (0.5 + 0.5 * coalesce(greatest(0.0, least(1.0, fill_rate / 100.0)), 0.5)))''', 1)} AS zip_demand_score FROM (
 SELECT p.*, ref, greatest(0.0, datediff('day', CAST(latest_class_date AS DATE), CAST(latest AS DATE)) / 30.44) AS age,
  arc_cpr_classes + arc_bls_classes + aha_bls_classes AS k3, arc_cpr_students + arc_bls_students + aha_bls_students AS s3
 FROM {source} p CROSS JOIN anchor))"""


extend("scored", score_sql("prof"), ["prof", "anchor"])


@query("a01_zip_profiles", with_views("prof", "SELECT * FROM prof"))
def _(spark, sf):
    return profiles(spark, sf).withColumn("cities", joined(C("cities")))


def folded(spark, sf):
    """The class history as sums: a base and two increments, the second folded twice."""
    path = shared_dir(spark) + "/sums-" + uuid.uuid4().hex
    part = F.pmod(F.hash("class_name", "class_date", "city"), F.lit(3))
    # the class rows are joined and typed once, not once for every batch
    arrived = f"{path}-rows"
    V.classes(spark, sf).withColumn("part", part).select("part", "month", "zip", "course_type", "bucket", "cancelled", "class_date", "enrolled", "capacity", "city").write.partitionBy("part").parquet(arrived)
    rows = spark.read.parquet(arrived)
    for batch in (0, 1, 2, 2):
        RF.fold(rows.where(C("part") == batch), path, f"b{batch}")
    return RF.state(spark, path)


@query("a01_refreshed_profiles", with_views("prof", "SELECT * FROM prof"))
def _(spark, sf):
    return RF.profiles(RF.held(folded(spark, sf), CUTOFF)).withColumn("cities", joined(C("cities")))


@query("k02_refreshed_top_zips", with_views("scored", "SELECT zip, zip_demand_score, total_classes, strength FROM scored ORDER BY 2 DESC, 1 LIMIT 20"))
def _(spark, sf):
    rows = folded(spark, sf)
    out = Z.scored_profiles(RF.profiles(RF.held(rows, CUTOFF)), *RF.anchors(rows, CUTOFF))
    return out.select("zip", "zip_demand_score", "total_classes", "strength").orderBy(C("zip_demand_score").desc(), "zip").limit(20)


@query("a02_zip_fill_rate", with_views("held", f"""
SELECT zip, bucket, {FILL} AS fill_rate, CAST(sum(CASE WHEN capacity > 0 THEN capacity END) AS BIGINT) AS capacity
FROM held WHERE zip IS NOT NULL AND bucket <> 'OTHER' GROUP BY 1, 2"""))
def _(spark, sf):
    from demandgrid.operators.classes import fill_pct
    return held(spark, sf).where("zip IS NOT NULL AND bucket <> 'OTHER'").groupBy("zip", "bucket").agg(
        fill_pct().alias("fill_rate"), F.sum(F.when(C("capacity") > 0, C("capacity"))).alias("capacity"))


SCORE_COLS = "zip, total_classes, zip_demand_score, adjustment, confidence_modifier, strength"


@query("m01_zip_demand_score", with_views("scored", "SELECT zip, total_classes, zip_demand_score FROM scored"))
def _(spark, sf):
    return scored(spark, sf).select("zip", "total_classes", "zip_demand_score")


@query("m02_m04_score_effects", with_views("scored", f"SELECT {SCORE_COLS} FROM scored"))
def _(spark, sf):
    return scored(spark, sf).select(*SCORE_COLS.split(", "))


@query("k02_top_zips", with_views("scored", "SELECT zip, zip_demand_score, total_classes, strength FROM scored ORDER BY 2 DESC, 1 LIMIT 20"))
def _(spark, sf):
    return scored(spark, sf).select("zip", "zip_demand_score", "total_classes", "strength").orderBy(
        C("zip_demand_score").desc(), "zip").limit(20)


@query("j36_centroid_coverage", with_views("prof v_centroid", f"""
SELECT count(*) AS total_demand_zips, count(c.zip) AS covered_zips, count(*) - count(c.zip) AS missing_zips,
 {R("count(c.zip) * 100.0 / count(*)", 1)} AS coverage_pct FROM prof p LEFT JOIN (SELECT * FROM v_centroid WHERE CAST(zip AS INT) % 5 > 0) c ON p.zip = c.zip"""))
def _(spark, sf):
    # every fifth centroid is absent, so that the audit has something to find
    return Z.centroid_coverage(profiles(spark, sf), V.centroids(spark, sf).where(C("zip").cast("int") % 5 > 0))


def candidates(spark, sf):
    """Candidate sites: customers, some without coordinates or ZIP."""
    k = C("point_id")
    return V.points(spark, sf).join(
        V.table(spark, sf, "customer").select(C("c_custkey").alias("point_id"), C("c_nationkey").alias("nk")), "point_id").select(
        k.alias("candidate_id"),
        F.when(k % 4 == 0, F.lpad((k % 130).cast("string"), 5, "0")).when(k % 4 == 1, F.lpad((k % 90).cast("string"), 5, "0")).alias("candidate_zip"),
        F.when(k % 3 == 0, C("lat")).alias("lat"), F.when((k % 3 == 0) & C("lat").isNotNull(), C("lng")).alias("lng"),
        F.when(k % 5 > 0, F.concat(F.lit(" Nation_"), C("nk"))).alias("city"))


extend("v_cand", """SELECT point_id AS candidate_id,
 CASE point_id % 4 WHEN 0 THEN lpad(CAST(point_id % 130 AS VARCHAR), 5, '0') WHEN 1 THEN lpad(CAST(point_id % 90 AS VARCHAR), 5, '0') END AS candidate_zip,
 CASE WHEN point_id % 3 = 0 THEN lat END AS lat, CASE WHEN point_id % 3 = 0 AND lat IS NOT NULL THEN lng END AS lng,
 CASE WHEN point_id % 5 > 0 THEN ' Nation_' || c_nationkey END AS city FROM v_point JOIN customer ON point_id = c_custkey""", ["v_point"])

RESOLVED = f"""
 cen AS (SELECT zip, CASE WHEN CAST(zip AS INT) % 5 > 0 THEN lat END AS lat, CASE WHEN CAST(zip AS INT) % 5 > 0 THEN lng END AS lng FROM v_centroid),
 cc AS (SELECT d.*, coalesce(d.lat, o.lat) AS at_lat, coalesce(d.lng, o.lng) AS at_lng FROM v_cand d LEFT JOIN cen o ON d.candidate_zip = o.zip),
 allp AS (SELECT candidate_id, p.zip, 1 AS rk FROM cc CROSS JOIN prof p JOIN cen z ON p.zip = z.zip
    WHERE at_lat IS NOT NULL AND {HAV('at_lat', 'at_lng', 'z.lat', 'z.lng')} <= 5
  UNION SELECT candidate_id, p.zip, CASE WHEN at_lat IS NULL THEN 2 ELSE 1 END FROM cc JOIN prof p ON p.zip = candidate_zip
  UNION SELECT candidate_id, p.zip, 3 FROM cc JOIN prof p ON list_contains(string_split(p.cities, ','), lower(trim(city)))),
 resolved AS (SELECT candidate_id, zip, CASE rk WHEN 1 THEN 'exact_plus_radius' WHEN 2 THEN 'exact' ELSE 'city' END AS basis FROM (
   SELECT *, min(rk) OVER (PARTITION BY candidate_id) AS best FROM allp) WHERE rk = best)"""


def centroids4(spark, sf):
    """Every fifth ZIP is listed without coordinates."""
    known = lambda c: F.when(C("zip").cast("int") % 5 > 0, C(c)).alias(c)
    return V.centroids(spark, sf).select("zip", known("lat"), known("lng"))


@query("j13_candidate_zips", with_views("prof v_centroid v_cand", "SELECT candidate_id, zip, basis FROM resolved", raw=RESOLVED))
def _(spark, sf):
    return Z.resolve_candidates(candidates(spark, sf), profiles(spark, sf), centroids4(spark, sf), 5.0)


MERGED = """
 merged AS (SELECT candidate_id, count(*) AS zips, max(basis) AS basis, CAST(sum(total_classes) AS BIGINT) AS total_classes,
  CAST(sum(total_students) AS BIGINT) AS total_students, CAST(sum(total_capacity) AS BIGINT) AS total_capacity,
  min(earliest_class_date) AS earliest_class_date, max(latest_class_date) AS latest_class_date,
  CASE WHEN count(*) = 1 THEN max(fill_rate) ELSE """ + R("sum(round_even(fill_rate / 100.0 * total_capacity, 0)) * 100.0 / sum(CASE WHEN fill_rate IS NOT NULL THEN total_capacity END)", 1) + """ END AS fill_rate,
  CAST(sum(arc_cpr_classes) AS BIGINT) AS arc_cpr_classes, CAST(sum(arc_cpr_students) AS BIGINT) AS arc_cpr_students,
  CAST(sum(arc_bls_classes) AS BIGINT) AS arc_bls_classes, CAST(sum(arc_bls_students) AS BIGINT) AS arc_bls_students,
  CAST(sum(aha_bls_classes) AS BIGINT) AS aha_bls_classes, CAST(sum(aha_bls_students) AS BIGINT) AS aha_bls_students,
  """ + R("sum(total_students) * 1.0 / sum(total_classes)", 2) + """ AS average_students
  FROM resolved JOIN prof USING (zip) GROUP BY candidate_id)"""


@query("a03_merged_profiles", with_views("prof v_centroid v_cand", "SELECT * FROM merged", raw=RESOLVED + "," + MERGED))
def _(spark, sf):
    p = profiles(spark, sf)
    return Z.merged_candidates(candidates(spark, sf), p, centroids4(spark, sf), 5.0)


@query("a04_candidate_zip_demand", with_views(
    "prof anchor v_centroid v_cand", """SELECT d.candidate_id, coalesce(zips, 0) AS zips, coalesce(basis, 'none') AS basis, zip_demand_score,
 coalesce(adjustment, 0.0)::DOUBLE AS adjustment, coalesce(confidence_modifier, 0.0)::DOUBLE AS confidence_modifier, strength
 FROM v_cand d LEFT JOIN sc USING (candidate_id)""", raw=RESOLVED + "," + MERGED, sc=score_sql("merged")))
def _(spark, sf):
    p, ref, latest = with_anchors(spark, sf)
    return Z.candidate_zip_demand(candidates(spark, sf), p, centroids4(spark, sf), 5.0, ref, latest).select(
        "candidate_id", "zips", "basis", "zip_demand_score", "adjustment", "confidence_modifier", "strength")


_RATES = {"students_per_month": "total_students", "held_classes_per_month": "total_classes",
          "arc_cpr_students_per_month": "arc_cpr_students", "arc_bls_students_per_month": "arc_bls_students",
          "aha_bls_students_per_month": "aha_bls_students"}
REPORT = f"""
 r0 AS (SELECT *, CAST((year(b) - year(a)) * 12 + month(b) - month(a) + 1 AS INT) AS month_span FROM (SELECT *, CAST(earliest_class_date AS DATE) AS a,
   CAST(latest_class_date AS DATE) AS b FROM scored)),
 r1 AS (SELECT *, {", ".join(f"{R(f'{v} * 1.0 / month_span', 4)} AS {k}" for k, v in _RATES.items())},
   {", ".join(f"coalesce({R(f'{b}_students * 1.0 / nullif({b}_classes, 0)', 2)}, 0.0) AS {b}_avg_students" for b in ("arc_cpr", "arc_bls", "aha_bls"))} FROM r0),
 r2 AS (SELECT *, {", ".join(f"coalesce({R(f'least(100.0, 100.0 * greatest({m}, 0) / (SELECT quantile_cont({m}, 0.9) FROM r1 WHERE {m} > 0))', 2)}, 0.0) AS n_{m}" for m in Z.INDEX_PARTS)} FROM r1),
 report AS (SELECT *, {R("(" + " + ".join(f"n_{m}" for m in Z.INDEX_PARTS) + ") / 7", 2)} AS demand_index FROM r2)"""
_REP_COLS = ["zip", "month_span", "zip_demand_score", *_RATES, *[f"n_{m}" for m in Z.INDEX_PARTS], "demand_index"]


def report(spark, sf):
    return Z.demand_report(scored(spark, sf), V.centroids(spark, sf))


@query("a05_demand_report", with_views("scored v_centroid", f"""SELECT {", ".join("p." + c for c in _REP_COLS)}, c.lat, c.lng, c.zip IS NOT NULL AS centroid_present
FROM report p LEFT JOIN v_centroid c ON p.zip = c.zip""", raw=REPORT))
def _(spark, sf):
    return report(spark, sf).select(*_REP_COLS, "lat", "lng", "centroid_present")


@query("r07_demand_index", with_views("scored", "SELECT zip, demand_index FROM report", raw=REPORT))
def _(spark, sf):
    return report(spark, sf).select("zip", "demand_index")


_SERIES = ["arc_cpr_avg_students", "arc_bls_avg_students", "aha_bls_avg_students", "average_students", "demand_index"]


@query("r03_report_fits", with_views("scored", f"""
SELECT series, n, {R("sxy / sxx", 4)} AS slope, {R("my - sxy / sxx * mx", 4)} AS intercept, {R("sxy * sxy / (sxx * syy)", 4)} AS r_squared FROM (
 SELECT series, count(*) AS n, avg(x) AS mx, avg(y) AS my, sum((x - ax) * (x - ax)) AS sxx, sum((x - ax) * (y - ay)) AS sxy, sum((y - ay) * (y - ay)) AS syy
 FROM (SELECT *, avg(x) OVER (PARTITION BY series) AS ax, avg(y) OVER (PARTITION BY series) AS ay FROM (
  {" UNION ALL ".join(f"SELECT '{s}' AS series, zip_demand_score AS x, {s} AS y FROM report" + ("" if s == "demand_index" else f" WHERE {s} > 0") for s in _SERIES)}))
 GROUP BY series)""", raw=REPORT))
def _(spark, sf):
    return Z.report_fits(report(spark, sf))


# --- order statistics and fits -------------------------------------------------

@query("w03_average_rank", with_views("v_point", """
SELECT point_id, rank() OVER (ORDER BY round(score / 100)) + (count(*) OVER (PARTITION BY round(score / 100)) - 1) / 2.0 AS avg_rank FROM v_point"""))
def _(spark, sf):
    p = V.points(spark, sf).select("point_id", F.round(C("score") / 100).alias("s"))
    return RK.average_rank(p, "s", "avg_rank").select("point_id", "avg_rank")


@query("r02_spearman", """
WITH v AS (SELECT p_type, round(p_retailprice / 10) AS x, CAST(p_size AS DOUBLE) AS y FROM part WHERE p_partkey % 11 > 0),
 k AS (SELECT p_type, rank() OVER (PARTITION BY p_type ORDER BY x) + (count(*) OVER (PARTITION BY p_type, x) - 1) / 2.0 AS rx,
   rank() OVER (PARTITION BY p_type ORDER BY y) + (count(*) OVER (PARTITION BY p_type, y) - 1) / 2.0 AS ry FROM v),
 m AS (SELECT *, avg(rx) OVER (PARTITION BY p_type) AS ax, avg(ry) OVER (PARTITION BY p_type) AS ay FROM k)
SELECT p_type, count(*) AS n, """ + R("sum((rx - ax) * (ry - ay)) / sqrt(sum((rx - ax) * (rx - ax)) * sum((ry - ay) * (ry - ay)))", 6) + " AS spearman FROM m GROUP BY 1")
def _(spark, sf):
    # p_partkey % 11 = 0 rows carry no price, so pairs with a missing side occur
    v = V.table(spark, sf, "part").select("p_type", F.when(C("p_partkey") % 11 > 0, F.round(C("p_retailprice") / 10)).alias("x"), C("p_size").cast("double").alias("y"))
    return RK.spearman(v, "x", "y", ["p_type"]).withColumn("spearman", rnd(C("spearman"), 6))


@query("r01_grouped_fit", """
WITH v AS (SELECT l_returnflag AS k, l_quantity AS x, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount * 100 END AS y FROM lineitem
  UNION ALL SELECT 'flat', 3.0, l_quantity FROM lineitem),
 m AS (SELECT *, avg(x) OVER (PARTITION BY k) AS ax, avg(y) OVER (PARTITION BY k) AS ay FROM v WHERE x IS NOT NULL AND y IS NOT NULL),
 s AS (SELECT k, count(*) AS n, max(ax) AS ax, max(ay) AS ay, sum((x - ax) * (x - ax)) AS sxx, sum((y - ay) * (y - ay)) AS syy, sum((x - ax) * (y - ay)) AS sxy FROM m GROUP BY k)
SELECT k, n, """ + R("CASE WHEN sxx > 1e-6 THEN sxy / sqrt(sxx * syy) END", 6) + " AS pearson, " + R("CASE WHEN sxx > 1e-6 THEN sxy / sxx END", 6)
       + " AS slope, " + R("CASE WHEN sxx > 1e-6 THEN ay - sxy / sxx * ax END", 6) + " AS intercept, "
       + R("CASE WHEN sxx > 1e-6 THEN sxy * sxy / (sxx * syy) END", 6) + " AS r_squared FROM s")
def _(spark, sf):
    li = V.table(spark, sf, "lineitem")
    a = li.select(C("l_returnflag").alias("k"), C("l_quantity").alias("x"), F.when(C("l_linenumber") % 3 != 0, C("l_discount") * 100).alias("y"))
    flat = li.select(F.lit("flat").alias("k"), F.lit(3.0).alias("x"), C("l_quantity").alias("y"))
    return RK.fit(a.unionByName(flat), "x", "y", ["k"]).select("k", "n", *[rnd(C(c), 6).alias(c) for c in ("pearson", "slope", "intercept", "r_squared")])


@query("w01_global_rank", "SELECT c_custkey AS candidate_id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer")
def _(spark, sf):
    p = V.points(spark, sf).select(C("point_id").alias("candidate_id"), "score")
    return RK.global_rank(p, [C("score").desc(), C("candidate_id").asc()]).select("candidate_id", "rank")


@query("k_exact_quantiles", "SELECT l_returnflag AS k, " + ", ".join(
    f"{R(f'quantile_cont(l_extendedprice, {q})', 4)} AS {n}" for n, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))) + " FROM lineitem GROUP BY 1")
def _(spark, sf):
    li = V.table(spark, sf, "lineitem").select(C("l_returnflag").alias("k"), "l_extendedprice")
    q = RK.quantiles(li, "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, ["k"])
    return q.select("k", *[rnd(C(c), 4).alias(c) for c in ("p10", "p50", "p90")])


# --- geometry -------------------------------------------------------------------

@query("r08_haversine", with_views("v_point v_centroid", f"""
SELECT point_id, {R(HAV("p.lat", "p.lng", "37.3", "-122.0", 3958.7613), 6)} AS miles,
 {R("2.0 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h))", 3)} AS meters FROM (SELECT *, pow(sin(radians(37.3 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(37.3)) *
 pow(sin(radians(-122.0 - lng) / 2), 2) AS h FROM v_point) p"""))
def _(spark, sf):
    la, lo = F.lit(37.3), F.lit(-122.0)
    return V.points(spark, sf).select("point_id", rnd(haversine(C("lat"), C("lng"), la, lo, 3958.7613), 6).alias("miles"),
                                      rnd(haversine_meters(C("lat"), C("lng"), la, lo), 3).alias("meters"))


@query("f07_radius_filter", with_views("v_point", f"""SELECT point_id, {R(HAV("37.3", "-122.0", "lat", "lng"), 4)} AS distance FROM v_point
WHERE {HAV("37.3", "-122.0", "lat", "lng")} <= 12"""))
def _(spark, sf):
    pts = V.points(spark, sf)
    b = G.bbox(F.lit(37.3), F.lit(-122.0), F.lit(12.1))
    d = haversine(F.lit(37.3), F.lit(-122.0), C("lat"), C("lng"))
    near = pts.where(C("lat").between(b["south"], b["north"]) & C("lng").between(b["west"], b["east"]))
    return near.withColumn("distance", d).where(C("distance") <= 12).select("point_id", rnd(C("distance"), 4).alias("distance"))


@query("f14_bounding_box", with_views("v_point", """SELECT point_id FROM v_point WHERE lat BETWEEN 37.2 AND 37.4 AND lng BETWEEN -122.2 AND -122.0"""))
def _(spark, sf):
    return V.points(spark, sf).where(C("lat").between(37.2, 37.4) & C("lng").between(-122.2, -122.0)).select("point_id")


@query("r10_bounding_box", with_views("v_point", f"""SELECT point_id, {R("lat - 3 / 69.0", 6)} AS south, {R("lng - 3 / (69.0 * cos(radians(lat)))", 6)} AS west,
 {R("lat + 3 / 69.0", 6)} AS north, {R("lng + 3 / (69.0 * cos(radians(lat)))", 6)} AS east FROM v_point WHERE lat IS NOT NULL"""))
def _(spark, sf):
    b = G.bbox(C("lat"), C("lng"), F.lit(3.0))
    return V.points(spark, sf).where("lat IS NOT NULL").select("point_id", *[rnd(v, 6).alias(k) for k, v in b.items()])


@query("r09_grid_points", with_views("v_centroid", f"""
SELECT zip, CAST(rn - 1 AS INT) AS pos, {R("glat", 5)} AS grid_lat, {R("glng", 5)} AS grid_lng FROM (
 SELECT *, row_number() OVER (PARTITION BY zip ORDER BY round({HAV("lat", "lng", "glat", "glng", 3958.7613)}, 6), north, east) AS rn FROM (
  SELECT zip, lat, lng, i * 2.0 AS north, j * 2.0 AS east, lat + i * 2.0 / 69.0 AS glat, lng + j * 2.0 / (69.0 * cos(radians(lat))) AS glng
  FROM v_centroid, range(-3, 4) a(i), range(-3, 4) b(j) WHERE sqrt(i * i * 4.0 + j * j * 4.0) <= 5.0)) WHERE rn <= 12"""))
def _(spark, sf):
    g = G.grid_points(V.centroids(spark, sf), "lat", "lng", 5.0, 2.0, 12)
    return g.select("zip", "pos", rnd(C("grid_lat"), 5).alias("grid_lat"), rnd(C("grid_lng"), 5).alias("grid_lng"))


NEAREST = """SELECT {k}, {s}, d FROM (SELECT {k}, {s}, d, row_number() OVER (PARTITION BY {k} ORDER BY d, {s}) AS rn FROM (
 SELECT {k}, {s}, {h} AS d FROM {a} a CROSS JOIN {b} b WHERE a.lat IS NOT NULL) WHERE d <= {m}) WHERE rn = 1"""


@query("j11_nearest_centroid", with_views(
    "v_point v_centroid", f"SELECT p.point_id, h.zip, {R('d', 6)} AS distance FROM v_point p LEFT JOIN hit h ON p.point_id = h.point_id",
    hit=NEAREST.format(k="point_id", s="zip", a="v_point", b="v_centroid", m=3.0, h=HAV("a.lat", "a.lng", "b.lat", "b.lng", 3958.7613))))
def _(spark, sf):
    c = V.centroids(spark, sf).select("zip", C("lat").alias("zlat"), C("lng").alias("zlng"))
    return G.assign(V.points(spark, sf), "lat", "lng", c, "zip", "zlat", "zlng", 3.0).select("point_id", "zip", rnd(C("distance"), 6).alias("distance"))


@query("r11_points_per_zip", with_views(
    "v_point v_centroid", "SELECT zip, count(*) AS points FROM hit GROUP BY 1",
    hit=NEAREST.format(k="point_id", s="zip", a="v_point", b="v_centroid", m=25.0, h=HAV("a.lat", "a.lng", "b.lat", "b.lng", 3958.7613))))
def _(spark, sf):
    c = V.centroids(spark, sf).select("zip", C("lat").alias("zlat"), C("lng").alias("zlng"))
    return G.count_by_site(V.points(spark, sf), "lat", "lng", c, "zip", "zlat", "zlng", 25.0)


@query("j12_nearest_hospital", with_views(
    "v_poi v_centroid", f"SELECT zip, {R('d', 1)} AS nearest_hospital_miles FROM hit", hosp="SELECT * FROM v_poi WHERE kind = 'hospital'",
    hit=NEAREST.format(k="zip", s="place_id", a="v_centroid", b="hosp", m=100.0, h=HAV("a.lat", "a.lng", "b.lat", "b.lng", 3958.7613))))
def _(spark, sf):
    h = V.pois(spark, sf).where("kind = 'hospital'").select("place_id", C("lat").alias("hlat"), C("lng").alias("hlng"))
    z = V.centroids(spark, sf)
    hit = G.nearest(z, "lat", "lng", h, "place_id", "hlat", "hlng", 100.0)
    return z.join(hit, ["lat", "lng"]).select("zip", rnd(C("distance"), 1).alias("nearest_hospital_miles"))


@query("a25_facilities_per_zip", with_views(
    "v_poi v_centroid", f"""SELECT z.zip, count(CASE WHEN kind = 'hospital' THEN 1 END) AS hospital_count,
 count(CASE WHEN kind = 'urgent care' THEN 1 END) AS urgent_care_count, count(CASE WHEN kind IN ('hospital', 'urgent care') THEN 1 END) AS healthcare_facility_count,
 any_value({R('h.d', 1)}) AS nearest_hospital_miles FROM z LEFT JOIN h ON z.zip = h.zip GROUP BY z.zip""",
    fac="SELECT * FROM v_poi WHERE kind IN ('hospital', 'urgent care', 'nursing school')", hosp="SELECT * FROM v_poi WHERE kind = 'hospital'",
    near="SELECT place_id, zip FROM (" + NEAREST.format(k="place_id", s="zip", a="fac", b="v_centroid", m=25.0, h=HAV("a.lat", "a.lng", "b.lat", "b.lng", 3958.7613)) + ")",
    z="SELECT f.kind, CASE WHEN f.place_id % 3 = 0 THEN lpad(CAST(f.place_id % 100 AS VARCHAR), 5, '0') ELSE n.zip END AS zip FROM fac f LEFT JOIN near n ON f.place_id = n.place_id",
    h=NEAREST.format(k="zip", s="place_id", a="v_centroid", b="hosp", m=100.0, h=HAV("a.lat", "a.lng", "b.lat", "b.lng", 3958.7613))))
def _(spark, sf):
    from demandgrid.operators.facilities import facilities_per_zip
    k = C("place_id")
    fac = V.pois(spark, sf).where(C("kind").isin("hospital", "urgent care", "nursing school")).select(
        F.translate("kind", " ", "_").alias("category"), F.when(k % 3 == 0, F.lpad((k % 100).cast("string"), 5, "0")).alias("zip"), "lat", "lng", k.alias("facility_id"))
    return facilities_per_zip(fac, V.centroids(spark, sf)).select(
        "zip", "hospital_count", "urgent_care_count", "healthcare_facility_count", "nearest_hospital_miles")


@query("a28_distance_buckets", with_views("v_centroid v_poi", f"""
SELECT zip, kind, count(CASE WHEN d <= 1 THEN 1 END) AS within_1, count(CASE WHEN d <= 3 THEN 1 END) AS within_3, count(CASE WHEN d <= 5 THEN 1 END) AS within_5,
 count(*) AS within_10 FROM (SELECT z.zip, p.kind, {HAV("z.lat", "z.lng", "p.lat", "p.lng", 3958.7613)} AS d FROM v_centroid z CROSS JOIN v_poi p) WHERE d <= 10 GROUP BY 1, 2"""))
def _(spark, sf):
    # copies of a spot are counted once each kind, then weighted
    p = V.pois(spark, sf).groupBy("kind", C("lat").alias("plat"), C("lng").alias("plng")).agg(F.count("*").alias("k"))
    z = V.centroids(spark, sf)
    rings = PY.near_sums(z, ("lat", "lng"), p, ("plat", "plng"), ["k"], keys=["kind"], radii=[1.0, 3.0, 5.0, 10.0])
    return z.join(rings, ["lat", "lng"]).groupBy("zip", "kind").agg(*G.distance_buckets(C("distance"), [1, 3, 5, 10], C("k")))


@query("j27_zip_distance", with_views("v_centroid", f"""
SELECT a.zip AS zip_a, b.zip AS zip_b, {R(HAV("a.lat", "a.lng", "b.lat", "b.lng"), 1)} AS miles FROM (SELECT DISTINCT lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS za,
 lpad(CAST(l_partkey % 100 AS VARCHAR), 5, '0') AS zb FROM lineitem) q JOIN v_centroid a ON a.zip = za JOIN v_centroid b ON b.zip = zb"""))
def _(spark, sf):
    q = V.table(spark, sf, "lineitem").select(F.lpad(C("l_suppkey").cast("string"), 5, "0").alias("zip_a"),
                                              F.lpad((C("l_partkey") % 100).cast("string"), 5, "0").alias("zip_b")).distinct()
    c = V.centroids(spark, sf)
    j = q.join(c.toDF("zip_a", "la", "lo"), "zip_a").join(c.toDF("zip_b", "la2", "lo2"), "zip_b")
    return j.select("zip_a", "zip_b", rnd(haversine(C("la"), C("lo"), C("la2"), C("lo2")), 1).alias("miles"))


def triangles(spark, sf):
    """A zone per part: a slanted triangle of changing size."""
    k = C("p_partkey")
    la, lo = (370000 + k * 2903 % 6000).cast("double") / 10000.0, (-1223000 + k * 6121 % 6000).cast("double") / 10000.0
    side = (1 + k % 5) / 200.0
    v = lambda a, b: F.struct(a.alias("lat"), b.alias("lng"))
    return V.table(spark, sf, "part").select(
        k.alias("zone_id"), F.array(v(la, lo), v(la + side, lo + side / 3), v(la + side / 2, lo + side)).alias("polygon"))


TRI = """SELECT p_partkey AS zone_id, CAST(370000 + p_partkey * 2903 % 6000 AS DOUBLE) / 10000 AS a1, CAST(-1223000 + p_partkey * 6121 % 6000 AS DOUBLE) / 10000 AS o1,
 (1 + p_partkey % 5) / 200.0 AS s FROM part"""


def _cross(i, j):
    return (f"CAST((o{i} > lng) <> (o{j} > lng) AND lat < (a{j} - a{i}) * (lng - o{i}) / (CASE WHEN o{j} = o{i} THEN 1e-12 ELSE o{j} - o{i} END) + a{i} AS INT)")


TRI2 = "SELECT zone_id, a1, o1, a1 + s AS a2, o1 + s / 3 AS o2, a1 + s / 2 AS a3, o1 + s AS o3 FROM tri"
INSIDE = f"({_cross(1, 3)} + {_cross(2, 1)} + {_cross(3, 2)}) % 2 = 1"


@query("j20_point_in_polygon", with_views("v_point", f"SELECT zone_id, point_id FROM t2 CROSS JOIN v_point WHERE lat IS NOT NULL AND {INSIDE}", tri=TRI, t2=TRI2))
def _(spark, sf):
    return PY.in_zones(V.points(spark, sf), "lat", "lng", triangles(spark, sf), "zone_id", "polygon").select("zone_id", "point_id")


def _m(i):
    return f"2.0 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(a{i} - lat) / 2), 2) + cos(radians(lat)) * cos(radians(a{i})) * pow(sin(radians(o{i} - lng) / 2), 2))))"


@query("j21_commercial_zone_filter", with_views("v_point", f"""SELECT DISTINCT point_id FROM t2 CROSS JOIN v_point WHERE lat IS NOT NULL AND ({INSIDE}
 OR least({_m(1)}, {_m(2)}, {_m(3)}) <= 250)""", tri=TRI, t2=TRI2))
def _(spark, sf):
    return PY.near_zones(V.points(spark, sf), "point_id", "lat", "lng", triangles(spark, sf), "polygon", 250.0, 3).select("point_id")


@query("j22_catchment_trim", with_views("v_centroid v_poi", f"""
SELECT zip, count(*) AS kept, count(CASE WHEN d <= 1 THEN 1 END) AS within_1, count(CASE WHEN d <= 3 THEN 1 END) AS within_3 FROM (
 SELECT z.zip, {HAV("z.lat", "z.lng", "p.lat", "p.lng", 3958.7613)} AS d, p.place_id, p.lat, p.lng, z.lat - 0.03 AS a1, z.lng - 0.03 AS o1, z.lat + 0.05 AS a2, z.lng AS o2,
  z.lat - 0.01 AS a3, z.lng + 0.06 AS o3 FROM v_centroid z CROSS JOIN v_poi p) WHERE d <= 5 AND (place_id % 7 = 0 OR {INSIDE}) GROUP BY 1"""))
def _(spark, sf):
    # every seventh place is listed without coordinates and must be kept
    p = V.pois(spark, sf).select("place_id", C("lat").alias("plat"), C("lng").alias("plng"))
    v = lambda a, b: F.struct((C("lat") + a).alias("lat"), (C("lng") + b).alias("lng"))
    z = V.centroids(spark, sf).withColumn("shape", F.array(v(-0.03, -0.03), v(0.05, 0.0), v(-0.01, 0.06)))
    kept = PY.catchment_rings(z, ("lat", "lng"), "shape", p, ("plat", "plng"), C("place_id") % 7 == 0, [1.0, 3.0, 5.0], 3958.7613)
    return kept.groupBy("zip").agg(F.sum("kept").alias("kept"), *G.distance_buckets(C("distance"), [1, 3], C("kept")))


# the walk: best first, a point stays unless one that stayed is nearer than two miles
@query("j23_distance_dedupe", with_views("v_point", "SELECT point_id, score FROM o WHERE i IN (SELECT unnest(kept) FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)) UNION ALL SELECT point_id, score FROM v_point WHERE lat IS NULL",
       raw=f"""o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY score DESC, point_id) AS i, * FROM v_point WHERE lat IS NOT NULL),
 q AS MATERIALIZED (SELECT b.i, list(a.i) FILTER (a.i IS NOT NULL) AS js FROM o b LEFT JOIN o a ON a.i < b.i AND {HAV('a.lat', 'a.lng', 'b.lat', 'b.lng', 3958.7613)} < 2.0 GROUP BY b.i),
 walk(i, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT q.i, CASE WHEN list_has_any(w.kept, coalesce(q.js, [])) THEN w.kept ELSE list_append(w.kept, q.i) END FROM walk w JOIN q ON q.i = w.i + 1)""").replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, sf):
    return G.distance_dedupe(V.points(spark, sf), "point_id", "lat", "lng", "score", 2.0).select("point_id", "score")
