"""Hand-computed values, null contracts and brute-force comparisons."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from demandgrid.functions import exprs as X
from demandgrid.functions import policy as P
from demandgrid.functions import text as T
from demandgrid.operators import candidates as K
from demandgrid.operators import classes as CL
from demandgrid.operators import evaluation as EV
from demandgrid.operators import geo as G
from demandgrid.operators import matching as M
from demandgrid.operators import modeled as MO
from demandgrid.operators import ops as O
from demandgrid.operators import ranks as R
from demandgrid.operators import texts as TX
from demandgrid.operators import zip_demand as Z

C = F.col


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def hav(a, b, c, d, r=3958.7613):
    p = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * r * math.asin(math.sqrt(min(1.0, p)))


# --- policy and null contracts ---------------------------------------------------------

def test_weights_sum_to_one():
    for w in (P.BLS_WEIGHTS, P.CPR_WEIGHTS, P.SITE_WEIGHTS, K.SUB_SCORES, EV.NODE_WEIGHTS):
        assert abs(sum(w.values()) - 1) < 1e-9
    for t in (K.DEMAND_CATEGORIES, K.TRAINING_CATEGORIES, K.ECONOMY_PARTS, K.JOB_PARTS):
        assert abs(sum(r[-1] for r in t) - 1) < 1e-9


def test_clamp_and_renorm_keep_unknown(spark):
    none = F.lit(None).cast("double")
    r = one(spark, a=X.clamp(none), b=X.clamp(F.lit(120.0)), c=X.renorm([(none, 0.7), (F.lit(40.0), 0.3)]), d=X.renorm([(none, 1.0)]), e=X.known(F.lit(float("nan"))), f=X.known(F.lit(float("-inf"))))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (None, 100.0, pytest.approx(40.0), None, None, None)


def test_fence_keeps_scan_filters(spark):
    df = X.stages(spark.range(100).withColumn("v", C("id") * 2), {"w": C("v") + 1}).where("id = 7 and w > 3")
    assert df.collect() == [Row(id=7, v=14, w=15)]


# --- parsing ------------------------------------------------------------------------------

def test_headers_exact_before_partial():
    found = CL.resolve_headers(["Class Name", "Start Date / Time", "Students", "Seats", "Location", "City"])
    assert found["class_name"] == "Class Name" and found["date"] == "Start Date / Time"
    assert found["enrolled"] == "Students" and found["capacity"] == "Seats" and found["city"] == "City"


@pytest.mark.parametrize("text,want", [
    ("2/1/26 8:00", dt.date(2026, 2, 1)), ("2026-02-01", dt.date(2026, 2, 1)), ("02/01/2026", dt.date(2026, 2, 1)), ("Feb 1, 2026", dt.date(2026, 2, 1)),
    ("1-Feb-2026", dt.date(2026, 2, 1)), ("2026-02-01T08:00:00Z", dt.date(2026, 2, 1)), ("5/6/71", dt.date(1971, 5, 6)), ("n/a", None), ("", None), ("13/45/2020", None)])
def test_dates(spark, text, want):
    assert one(spark, d=T.parse_date(F.lit(text))).d == want


def test_course_types(spark):
    names = {"AHA BLS Provider": "aha_bls", "Red Cross First Aid/CPR/AED": "arc_cpr", "House Group Training": "unknown_course_type", "Adult First Aid/CPR/AED Blended": "cpr_first_aid_blended",
             "AHA ACLS Provider": "acls", "Red Cross BLS Skills Session": "skills_session", "house cpr class": "house_cpr", "": "unknown_course_type"}
    df = spark.createDataFrame([(n, None, "open") for n in names], "class_name string, class_date date, status string")
    got = {r.class_name: r.course_type for r in CL.typed_classes(df).collect()}
    assert got == names


def test_address_and_money(spark):
    r = one(spark, a=T.address_parts(F.lit("San Jose(1631 N First Street, Suite 200, San Jose, CA 95112)")), z=T.address_zip(F.lit("12345 Main St")), m=T.money(F.lit("$3,200")), n=T.money(F.lit("-5")))
    assert (r.a.city, r.a.state, r.a.zip) == ("San Jose", "CA", "95112") and r.z is None and r.m == 3200.0 and r.n is None


# --- held classes and demand ---------------------------------------------------------------

CLASS = "class_name string, class_date date, enrolled int, capacity int, price double, status string, city string, zip string"


def classes(spark, rows):
    return CL.typed_classes(spark.createDataFrame(rows, CLASS))


def test_held_boundaries(spark):
    d = dt.date
    rows = [("AHA BLS", d(2025, 5, 31), 1, 10, 50.0, "", "A", "1"), ("AHA BLS", d(2025, 6, 1), 9, 10, 50.0, "", "A", "1"), ("AHA BLS", d(2025, 5, 1), 0, 10, 50.0, "", "A", "1"),
            ("AHA BLS", d(2025, 5, 1), 5, 10, 50.0, "Cancelled", "A", "1"), ("AHA BLS", None, 5, 10, 50.0, None, "A", "1"), ("AHA BLS", d(2025, 5, 1), None, 10, 50.0, "", "A", "1")]
    got = CL.held(classes(spark, rows), "2025-06").select("class_date", "enrolled").collect()
    assert {(r.class_date, r.enrolled) for r in got} == {(d(2025, 5, 31), 1), (None, 5)}


def test_zip_score_by_hand(spark):
    d = dt.date
    rows = [("AHA BLS", d(2025, 1, 1), 6, 10, 50.0, "", "San  Jose", "95112")] * 3 + [("ACLS", d(2025, 1, 1), 20, None, 50.0, "", "san jose", "95112")]
    p = Z.zip_profiles(CL.held(classes(spark, rows), "2025-06"))
    r = Z.scored_profiles(p, F.lit(6.0), F.lit("2025-01-01")).first()
    raw = 0.45 * math.log1p(3) / math.log1p(40) + 0.30 * 1 + 0.25 * 1
    assert r.fill_rate == 60.0 and r.zip_demand_score == pytest.approx(round(100 * raw * (0.5 + 0.5 * 0.6), 1))
    assert r.cities == ["san jose"] and r.confidence_modifier == pytest.approx(-4 + 0 + 3) and r.average_students == 9.5


def test_growth_odd_month_goes_late(spark):
    rows = [("AHA BLS", dt.date(2024, m, 3), e, 10, 1.0, "", "A", "1") for m, e in ((1, 2), (2, 4), (3, 6))]
    r = CL.growth(classes(spark, rows), ["zip"]).first()
    assert (r.earlier, r.later, r.growth_ratio) == (2.0, 5.0, 2.5)


def test_area_filter_falls_back_to_everything(spark):
    rows = [("AHA BLS", dt.date(2024, 1, 3), 2, 10, 1.0, "", c, "1") for c in ("San Jose", "Reno")]
    df = classes(spark, rows)
    assert CL.area_filter(df, "Santana Row, San Jose").count() == 1 and CL.area_filter(df, "Paris").count() == 2


# --- order statistics ------------------------------------------------------------------------

def test_quantiles_and_ranks_match_numpy(spark):
    random.seed(3)
    vals = [round(random.gauss(0, 1), 2) for _ in range(500)] + [7.0] * 250  # a third of the rows tie
    df = spark.createDataFrame([(float(v),) for v in vals], "v double").repartition(7)
    q = R.quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.9}).first()
    assert [q.a, q.b, q.c] == pytest.approx(list(np.quantile(vals, [0.1, 0.5, 0.9])))
    srt = sorted(vals)
    want = {v: (srt.index(v) + 1 + srt.index(v) + srt.count(v)) / 2 for v in set(vals)}
    got = {r.v: r.rk for r in R.average_rank(df, "v", "rk").distinct().collect()}
    assert got == pytest.approx(want)


def test_global_rank_is_total(spark):
    df = spark.range(1000).withColumn("s", C("id") % 3).repartition(5)
    got = [r["rank"] for r in R.global_rank(df, [C("s").desc(), C("id").asc()]).orderBy(C("s").desc(), "id").collect()]
    assert got == list(range(1, 1001))


def test_fit_contracts(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 6.0), ("flat_y", 1.0, 5.0), ("flat_y", 2.0, 5.0), ("flat_x", 1.0, 2.0), ("flat_x", 1.0, 3.0), ("lone", 1.0, 1.0)], "k string, x double, y double")
    got = {r.k: r for r in R.fit(df, "x", "y", ["k"]).collect()}
    assert got["a"].slope == pytest.approx(2) and got["a"].pearson == pytest.approx(1)
    assert got["flat_y"].slope == 0 and got["flat_y"].pearson is None and got["flat_y"].r_squared is None
    assert got["flat_x"].slope is None and got["lone"].pearson is None


# --- geometry against brute force ---------------------------------------------------------------

def cloud(n, seed, spread=0.6):
    rnd = random.Random(seed)
    pts = [(i, 37 + rnd.random() * spread, -122 + rnd.random() * spread) for i in range(n * 2 // 3)]
    return pts + [(len(pts) + i, pts[0][1], pts[0][2]) for i in range(n - len(pts))]  # a third share one spot


def test_nearest_equals_full_scan(spark):
    pts, sites = cloud(120, 1, 2.5), cloud(9, 2, 2.5)
    p = spark.createDataFrame(pts, "id long, lat double, lng double")
    s = spark.createDataFrame(sites, "site long, slat double, slng double")
    got = {r.id: (r.site, r.distance) for r in G.assign(p, "lat", "lng", s, "site", "slat", "slng", 60.0).collect()}
    for i, la, lo in pts:
        d, k = min((hav(la, lo, b, c), k) for k, b, c in sites)
        want = (k, d) if d <= 60 else (None, None)
        assert got[i][0] == want[0] and (want[1] is None or got[i][1] == pytest.approx(want[1]))


def test_within_equals_full_scan(spark):
    a, b = cloud(60, 5), cloud(50, 6)
    x = spark.createDataFrame(a, "i long, la double, lo double")
    y = spark.createDataFrame(b, "j long, lb double, lc double")
    got = {(r.i, r.j) for r in G.within(x, y, ("la", "lo"), ("lb", "lc"), 7.0, 7.0).collect()}
    assert got == {(i, j) for i, p, q in a for j, r, s in b if hav(p, q, r, s, 3958.8) <= 7.0}


def globe(n, seed):
    """Points at the date line, at the poles and anywhere."""
    r = random.Random(seed)
    at = [lambda: (r.uniform(-2, 2), r.choice([-180.0, 180.0]) + r.uniform(-1, 1)), lambda: (r.choice([-1, 1]) * (90 - r.random() ** 2), r.uniform(-180, 180)), lambda: (r.uniform(40, 42), r.uniform(-1, 1))]
    pts = [at[k % 3]() for k in range(n)]
    return [(k, la, lo if -180 <= lo <= 180 else lo - 360 * (1 if lo > 0 else -1)) for k, (la, lo) in enumerate(pts)]


@pytest.mark.parametrize("miles", [5.0, 25.0, 90.0])
def test_joins_close_round_the_globe(spark, miles):
    a, b = globe(90, 1) + [(900, 0.0, 179.99), (901, 89.9, 10.0)], globe(60, 2) + [(900, 0.0, -179.99), (901, 89.9, -170.0)]
    x, y = spark.createDataFrame(a, "i long, la double, lo double"), spark.createDataFrame(b, "j long, lb double, lc double")
    got = [(r.i, r.j) for r in G.within(x, y, ("la", "lo"), ("lb", "lc"), miles, miles).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, p, q in a for j, r, s in b if hav(p, q, r, s, 3958.8) <= miles}
    near = {r.i: (r.j, r.distance) for r in G.assign(x, "la", "lo", y, "j", "lb", "lc", miles).collect()}
    for i, p, q in a:
        d, j = min((hav(p, q, r, s), j) for j, r, s in b)
        assert near[i][0] == (j if d <= miles else None)


def test_line_fit_far_from_zero(spark):
    rows = [(1e9 + i / 1000, 2.0 * i, i % 3 + 1.0) for i in range(1000)] + [(None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double, w double")
    for weight in (None, "w"):
        f = R.fit(df, "x", "y", None, weight).first()
        assert f.slope == pytest.approx(2000, rel=1e-6) and f.pearson == pytest.approx(1.0, abs=1e-9)
    flat = R.fit(spark.createDataFrame([(1.0, 5.0), (1.0, 6.0)], "x double, y double"), "x", "y").first()
    assert (flat.slope, flat.pearson, flat.r_squared, flat.intercept) == (None, None, None, None)
    level = R.fit(spark.createDataFrame([(1e9, 5.1), (1e9 + 1, 5.1)], "x double, y double"), "x", "y").first()
    assert (level.slope, level.pearson, level.flat_y) == (0.0, None, True)


def test_polygon_and_short_polygon(spark):
    v = lambda a, b: F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng"))
    sq = F.array(v(0.0, 0.0), v(0.0, 2.0), v(2.0, 2.0), v(2.0, 0.0))
    r = one(spark, i=G.polygon_contains(F.lit(1.0), F.lit(1.0), sq), o=G.polygon_contains(F.lit(3.0), F.lit(1.0), sq), s=G.polygon_contains(F.lit(1.0), F.lit(1.0), F.slice(sq, 1, 2)))
    assert (r.i, r.o, r.s) == (True, False, False)


def test_distance_dedupe_equals_greedy_walk(spark):
    rnd = random.Random(8)
    pts = [(i, la, lo, float(rnd.randint(0, 40))) for i, la, lo in cloud(300, 9)]
    df = spark.createDataFrame(pts + [(9999, None, None, 1.0)], "id long, lat double, lng double, s double")
    kept = []
    for i, la, lo, s in sorted(pts, key=lambda p: (-p[3], p[0])):
        if all(hav(la, lo, b, c) >= 3.0 for _, b, c in kept):
            kept.append((i, la, lo))
    got = {r.id for r in G.distance_dedupe(df, "id", "lat", "lng", "s", 3.0).collect()}
    assert got == {k[0] for k in kept} | {9999}


# --- matching against the sequential rule -----------------------------------------------------------

def test_patterns_see_unicode_words(spark):
    texts = {"Clases en español": True, "我们提供 中文 服务": True, "Se habla ESPAÑOL": True, "españolas": False, "plain page": False, "langue étrangère": False}
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", TX.found(C("text"), TX.PAGE_SIGNALS["multilingual_support"]).alias("hit")).collect()
    assert {r.text: r.hit for r in rows} == texts
    got = spark.createDataFrame([("éparking",), ("no parking",)], "text string").select(F.array_contains(TX.themes(C("text")), "parking").alias("p")).collect()
    assert [r.p for r in got] == [False, True]


def test_piles_under_two_names_pair_by_rank(spark):
    """Interleaved names that all match: the walk pairs the i-th left with the i-th right row."""
    n = 2000
    l = spark.range(n).select(C("id").alias("l_id"), F.when(C("id") % 2 == 0, "a b c").otherwise("a b c d").alias("l_name"), F.lit(37.0).alias("l_lat"), F.lit(-122.0).alias("l_lng"))
    r = spark.range(n).select((C("id") + 5000).alias("r_id"), F.when(C("id") % 3 == 0, "a b c").otherwise("a b c d").alias("r_name"), F.lit(37.0).alias("r_lat"), F.lit(-122.0).alias("r_lng"))
    assert {(x.l_id, x.r_id) for x in M.first_match(l, r).collect()} == {(i, i + 5000) for i in range(n)}


def test_first_match_equals_sequential(spark):
    rnd = random.Random(4)
    words = ["cpr", "center", "east", "west", "academy"]
    side = lambda n, base: [(base + i, " ".join(rnd.sample(words, 3)), 37 + rnd.randint(0, 2) * 0.0003, -122.0) for i in range(n)] + [(base + 500 + i, "same name", 38.0, -121.0) for i in range(n // 2)]
    left, right = side(40, 0), side(40, 1000)
    jac = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    used, want = set(), set()
    for i, n, la, lo in sorted(left):
        hit = next((j for j, m, lb, lc in sorted(right) if j not in used and hav(la, lo, lb, lc) <= 0.05 and jac(n, m) >= 0.5), None)
        if hit is not None:
            used.add(hit)
            want.add((i, hit))
    l = spark.createDataFrame(left, "l_id long, l_name string, l_lat double, l_lng double")
    r = spark.createDataFrame(right, "r_id long, r_name string, r_lat double, r_lng double")
    assert {(x.l_id, x.r_id) for x in M.first_match(l, r).collect()} == want


def test_near_duplicates_equal_sequential(spark):
    rnd = random.Random(11)
    words = list("abcdefgh")
    rows = [(i, " ".join(rnd.sample(words, rnd.randint(2, 5)))) for i in range(120)] + [(200 + i, "x y z") for i in range(60)]
    jac = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    kept, want = [], {}
    for i, n in rows:
        hit = next((k for k, m in kept if jac(n, m) >= 0.6), None)
        want[i] = i if hit is None else hit
        if hit is None:
            kept.append((i, n))
    got = {r.id: r.keeper for r in M.near_duplicates(spark.createDataFrame(rows, "id long, name string"), "id", "name").collect()}
    assert got == want


def test_contained_equals_nested_loop(spark):
    longs, shorts = ["abcde", "xbc", "zz", "abcabc"], ["bc", "abc", "q", "zz", "abcdef"]
    l, s = spark.createDataFrame([(x,) for x in longs], "l string"), spark.createDataFrame([(x,) for x in shorts], "s string")
    assert {(r.l, r.s) for r in M.contained(l, "l", s, "s").collect()} == {(a, b) for a in longs for b in shorts if b in a}


def test_overlap_equals_all_pairs(spark):
    rnd = random.Random(2)
    sets = {i: set(rnd.sample(range(12), 5)) for i in range(20)} | {100 + i: {1, 2, 3, 4, 5} for i in range(15)}
    n5 = spark.createDataFrame([(i, p) for i, s in sets.items() for p in s], "candidate_id long, place_id long")
    cands = spark.createDataFrame([(i,) for i in [*sets, 777]], "candidate_id long")
    got = {r.candidate_id: r.catchment_overlap for r in K.catchment_overlap(n5, cands).collect()}
    for i, s in sets.items():
        avg = sum(len(s & t) / len(s | t) for j, t in sets.items() if j != i) / (len(sets) - 1)
        assert got[i] == pytest.approx(max(0, min(1, 1 - avg / 0.6)) * 100, abs=0.006)
    assert got[777] == 100.0


# --- scores --------------------------------------------------------------------------------------

def test_rural_cap_needs_weak_validation(spark):
    base = dict(zip="1", population=800.0, population_density=20.0, median_household_income=150000.0, working_age_share=0.8, employment_rate=0.75, bachelors_or_higher_share=0.55, healthcare_employment_share=0.25)
    rows = [Row(**base, hospital_count=0.0, urgent_care_count=0.0), Row(**{**base, "zip": "2"}, hospital_count=9.0, urgent_care_count=9.0)]
    df = spark.createDataFrame(rows).withColumns({"nursing_school_count": C("hospital_count"), "healthcare_poi_count": C("hospital_count") * 10, "competitor_count": F.lit(0.0)})
    got = {r.zip: r for r in MO.modeled(df).collect()}
    assert got["1"].overall == 25.0 and got["1"].cap_reason == "rural_low_density_cap"
    assert got["2"].overall > 25.0 and got["2"].validation_override_applied


def test_missing_signal_renormalises(spark):
    full = dict(zip="1", population=50000.0, land_sqmi=5.0, median_household_income=150000.0, working_age_share=0.8, employment_rate=0.75, bachelors_or_higher_share=0.55, healthcare_employment_share=0.25, population_density=8000.0)
    r = MO.tilts(spark.createDataFrame([Row(**full)])).first()
    assert r.bls_raw == 100.0 and r.cpr_raw == 100.0 and r.baseline_count == 7
    empty = MO.tilts(spark.createDataFrame([("9",)], "zip string")).first()
    assert empty.bls_raw is None and empty.overall_raw is None and empty.confidence == "missing"


def test_cohort_without_spread_is_untouched(spark):
    cols = {k: F.lit(50.0) for k in K.SUB_SCORES}
    df = spark.range(4).withColumns({**cols, "cohort": F.lit("x"), "candidate_id": C("id"), "area_score": F.lit(50.0)})
    assert {r.n_demand_score for r in K.cohort_blend(df, "cohort").collect()} == {50.0}


def test_unit_economics_by_hand(spark):
    df = spark.createDataFrame([(85.0, 20.0, 45.0), (30.0, 20.0, 45.0)], "price double, card_cost double, instructor_cost double")
    a, b = O.unit_economics(df).orderBy(C("price").desc()).collect()
    assert a.variable_cost == 49.55 and a.contribution == 29.02 and a.break_even_students == 36.9 and b.break_even_students is None


def test_opening_decision_downgrades(spark):
    r = one(spark, a=EV.opening_decision(F.lit(85.0), F.lit("high")), b=EV.opening_decision(F.lit(85.0), F.lit("very_low")), c=EV.opening_decision(F.lit(None).cast("double"), F.lit("high")))
    assert (r.a, r.b, r.c) == ("OPEN", "WATCH", None)


def test_room_explicit_no_eliminates(spark):
    cols = "capacity double, hourly_rate double, daily_rate double, floor_space_notes string, parking_notes string, cancellation_policy string, notes string, outreach_status string, source string, " + ", ".join(
        f"{c} boolean" for c in [*O.ROOM_FACTS, "access_control_possible", "camera_allowed"])
    blank = [None] * (9 + len(O.ROOM_FACTS) + 2)
    no_wifi = list(blank)
    no_wifi[9 + list(O.ROOM_FACTS).index("wifi")] = False
    got = O.room_fit(spark.createDataFrame([tuple(blank), tuple(no_wifi)], cols)).collect()
    assert {r.eliminations for r in got} == {"", "bad_wifi"} and {r.classroom_fit_score for r in got} == {0.0}
