"""Nested grids and the containment index against plain loops, with crowded and wide cases."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandgrid.functions.exprs import EARTH_MILES, EARTH_MILES_GRID
from demandgrid.operators import candidates as K
from demandgrid.operators import matching as M
from demandgrid.operators import pyramid as PY


def miles(a, b, radius=EARTH_MILES_GRID):
    la, lo, lb, mo = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((mo - lo) / 2) ** 2
    return 2 * radius * math.asin(math.sqrt(min(1.0, h)))


def plain_rings(queries, sites, radii):
    out = {}
    for q in queries:
        for lat, lng, kind, v in sites:
            d = miles(q, (lat, lng))
            if d <= radii[-1]:
                key = (*q, kind, next(r for r in radii if d <= r))
                n, s, m = out.get(key, (0, 0, -1))
                out[key] = (n + 1, s + v, max(m, v))
    return out


def spread(rng, n, lat=37.4, lng=-122.0, width=0.4):
    return [(round(lat + rng.uniform(-width, width), 5), round(lng + rng.uniform(-width, width), 5)) for _ in range(n)]


@pytest.mark.parametrize("heavy", [1, 8, 512])
def test_ring_sums_equal_plain_loops(spark, heavy):
    rng = random.Random(heavy)
    radii = [1.0, 3.0, 5.0, 10.0]
    queries = spread(rng, 25) + [(37.4, 179.99), (37.4, -179.99), (89.95, 10.0), (-89.99, 0.0)]
    sites = [(*p, rng.choice("ab"), rng.randint(0, 9)) for p in spread(rng, 300) + spread(rng, 200, 37.401, -122.001, 0.002)]
    sites += [(37.41, -179.995, "a", 5), (37.39, 179.93, "b", 2), (89.99, -170.0, "a", 1), (-89.97, 90.0, "b", 4), (37.4, -122.0, "a", 1), (37.4, -122.0, "a", 1)]
    q = spark.createDataFrame(queries + [(None, 1.0)], "y double, x double")
    s = spark.createDataFrame(sites + [(None, None, "a", 9)], "lat double, lng double, kind string, v bigint").withColumn("one", F.lit(1).cast("bigint"))
    got = PY.near_sums(q, ("y", "x"), s.withColumn("top", F.col("v")), ("lat", "lng"), ["one", "v"], ["top"], keys=["kind"], radii=radii, heavy=heavy)
    assert {(r["y"], r["x"], r["kind"], r["distance"]): (r["one"], r["v"], r["top"]) for r in got.collect()} == plain_rings(queries, sites, radii)


@pytest.mark.parametrize("heavy", [1, 512])
def test_own_radius_sums_equal_plain_loops(spark, heavy):
    rng = random.Random(4)
    queries = spread(rng, 30, width=0.1)
    sites = [(*p, rng.choice([0.5, 1.0, 2.5, 6.0, rng.uniform(0.1, 6.0)])) for p in spread(rng, 400, width=0.15)]
    want = {}
    for q in queries:
        for lat, lng, r in sites:
            if miles(q, (lat, lng)) <= r:
                want[q] = want.get(q, 0) + 1
    s = spark.createDataFrame(sites, "lat double, lng double, r double").withColumn("one", F.lit(1).cast("bigint"))
    got = PY.near_sums(spark.createDataFrame(queries, "y double, x double"), ("y", "x"), s, ("lat", "lng"), ["one"], own="r", max_miles=6.0, heavy=heavy)
    assert {(r["y"], r["x"]): r["one"] for r in got.collect()} == want


def test_a_crowded_cell_is_not_met_row_by_row(spark):
    """100,000 places on a spot of some hundred metres: a circle's edge meets a few cells of at most ``heavy`` rows."""
    k = F.col("id")
    places = spark.range(100_000).select((37.4 + k % 331 * 7e-6).alias("lat"), (-122.0 + F.floor(k / 331) * 7e-6).alias("lng"), F.lit(1).cast("bigint").alias("one"))
    queries = [(37.4 + 0.01 * i, -122.0) for i in range(1, 60)]
    q = spark.createDataFrame(queries, "y double, x double")
    got = PY.near_sums(q, ("y", "x"), places, ("lat", "lng"), ["one"], radii=[1.0, 5.0])
    counts = {(r["y"], r["distance"]): r["one"] for r in got.collect()}
    p = np.array([(r["lat"], r["lng"]) for r in places.collect()])
    for y, x in queries:
        a, b = np.radians(p[:, 0]), np.radians(p[:, 1])
        h = np.sin((a - math.radians(y)) / 2) ** 2 + math.cos(math.radians(y)) * np.cos(a) * np.sin((b - math.radians(x)) / 2) ** 2
        d = 2 * EARTH_MILES_GRID * np.arcsin(np.sqrt(h))
        assert counts.get((y, 1.0), 0) == (d <= 1.0).sum() and counts.get((y, 5.0), 0) == ((d > 1.0) & (d <= 5.0)).sum()


@pytest.mark.parametrize("k", [1, 3, 40])
def test_nearest_k_equals_plain_loops(spark, k):
    rng = random.Random(k)
    targets = [(f"t{i}", *p) for i, p in enumerate(spread(rng, 20) + [(0.0, 0.0), (-33.9, 151.2), (89.9, 5.0), (37.4, 179.99)])] + [("none", None, None)]
    people = [(f"p{i}", *p) for i, p in enumerate(spread(rng, 30, 37.3, -121.9, 0.01) + spread(rng, 3, 40.7, -74.0, 0.01) + [(37.5, -179.9), (88.0, -175.0)])]
    t = spark.createDataFrame(targets, "zip string, lat double, lng double")
    p = spark.createDataFrame(people + [("lost", None, 1.0)], "person string, h_lat double, h_lng double")
    met = PY.nearest_k(t, "zip", "lat", "lng", p, "h_lat", "h_lng", k).collect()
    assert len({(r["zip"], r["person"]) for r in met}) == len(met)
    for name, lat, lng in targets[:-1]:
        want = sorted((miles((lat, lng), (y, x), EARTH_MILES), n) for n, y, x in people)[:k]
        got = sorted((r["distance"], r["person"]) for r in met if r["zip"] == name)[:k]
        assert [n for _, n in got] == [n for _, n in want]
    assert not [r for r in met if r["zip"] == "none"]


def test_a_lone_target_meets_few_people(spark):
    """Towns of 2,000 people each; a target far from all of them meets its nearest town's people at most."""
    k = F.col("id")
    people = spark.range(20_000).select(k.alias("person"), (30.0 + k % 10 * 2.0 + F.floor(k / 10) % 50 * 1e-3).alias("h_lat"), (-100.0 + F.floor(k / 500) * 1e-3).alias("h_lng"))
    t = spark.createDataFrame([("in", 30.0201, -99.9801), ("out", 20.0, -100.0)], "zip string, lat double, lng double")
    met = {r["zip"]: r["n"] for r in PY.nearest_k(t, "zip", "lat", "lng", people, "h_lat", "h_lng", 3).groupBy("zip").agg(F.count("*").alias("n")).collect()}
    assert 3 <= met["in"] < 300 and 3 <= met["out"] <= 20_000


def inside(lat, lng, poly):
    odd = False
    for (ya, xa), (yb, xb) in zip(poly, [poly[-1], *poly[:-1]]):
        if (xa > lng) != (xb > lng):
            odd ^= lat < (yb - ya) * (lng - xa) / (xb - xa if xb != xa else 1e-12) + ya
    return odd and len(poly) >= 3


ZONES = "zone int, polygon array<struct<lat:double,lng:double>>"


@pytest.mark.parametrize("heavy", [1, 512])
def test_zones_equal_plain_ray_casting(spark, heavy):
    rng = random.Random(heavy)
    star = [(37.4 + (0.3 if i % 2 else 0.1) * math.sin(i * math.pi / 8), -122.0 + (0.3 if i % 2 else 0.1) * math.cos(i * math.pi / 8)) for i in range(16)]
    polys = [star, [(37.3, -122.2), (37.5, -122.2), (37.5, -121.9), (37.3, -121.9)], [(37.4, -122.0), (37.4001, -122.0), (37.4, -121.9999)], [(10.0, -170.0), (70.0, -170.0), (70.0, -20.0), (10.0, -20.0)],
             [(37.0, -122.0), (38.0, -122.0)], [(37.1, -122.1)] * 3, [(rng.uniform(37, 38), rng.uniform(-122.5, -121.5)) for _ in range(9)]]
    pts = [(i, *p) for i, p in enumerate(spread(rng, 400) + [(37.4, -122.0), (37.5, -122.2), (37.40001, -121.99999)])]
    z = spark.createDataFrame([(i, p) for i, p in enumerate(polys)], ZONES)
    df = spark.createDataFrame([*pts, (-1, None, 5.0)], "id int, lat double, lng double")
    got = sorted((r["id"], r["zone"]) for r in PY.in_zones(df, "lat", "lng", z, "zone", "polygon", heavy).collect())
    assert got == sorted((i, k) for i, la, lo in pts for k, p in enumerate(polys) if inside(la, lo, p))


def test_cover_of_any_size_is_bounded(spark):
    sizes = [1e-6, 1e-3, 0.02, 0.7, 5.0, 60.0, 170.0]
    z = spark.createDataFrame([(i, [(0.0, 0.0), (s / 2, s / 3), (0.0, s)]) for i, s in enumerate(sizes)], ZONES)
    cells = {r["zone"]: r["n"] for r in PY.cover_start(z, "zone", "polygon").groupBy("zone").agg(F.count("*").alias("n")).collect()}
    assert len(cells) == len(sizes) and max(cells.values()) <= 25
    kept = PY.cover_judge(PY.cover_start(z, "zone", "polygon")).collect()
    assert all(r["_crossed"] or r["zone"] >= 0 for r in kept)


def test_near_zones_equal_plain_rule(spark):
    rng = random.Random(9)
    polys = [[(37.4, -122.0), (37.41, -122.0), (37.405, -121.99)], [(37.3, 179.9995), (37.31, 179.9995), (37.305, 179.99)], [(37.2, -121.8)]]
    pts = [(i, *p) for i, p in enumerate(spread(rng, 200, 37.405, -121.995, 0.012) + [(37.3, -179.9999), (37.2005, -121.8), (37.3, 0.0)])]
    z = spark.createDataFrame([(p,) for p in polys], "polygon array<struct<lat:double,lng:double>>")
    df = spark.createDataFrame(pts, "id int, lat double, lng double")
    near = lambda la, lo, p: inside(la, lo, p) or any(miles((la, lo), v, 6371000.0) <= 250 for v in p)
    want = {i for i, la, lo in pts if any(near(la, lo, p) for p in polys)}
    assert {r["id"] for r in PY.near_zones(df, "id", "lat", "lng", z, "polygon", 250.0, 3).collect()} == want
    assert PY.near_zones(df, "id", "lat", "lng", z, "polygon", 250.0, 10_000).count() == len(pts)


def test_contained_in_long_texts_with_needles_of_many_lengths(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (100_000, 100_000, 3000, 10, 2, 0)]
    needles = [texts[k % 2][s : s + n] for k, (s, n) in enumerate((rng.randrange(90_000), n) for n in range(1, 201))] + ["zzzz", "zz", "q", "abcdabcdabcdabcdabcdé", ""]
    left = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "id int, t string")
    right = spark.createDataFrame([(i, n) for i, n in enumerate(needles)], "nid int, n string")
    began = time.time()
    got = {(r["id"], r["nid"]) for r in M.contained(left, "t", right, "n").collect()}
    assert got == {(i, j) for i, t in enumerate(texts) for j, n in enumerate(needles) if n and n in t}
    assert time.time() - began < 60


def test_contained_keeps_repeated_rows_and_needles(spark):
    left = spark.createDataFrame([(1, "main street 5"), (2, "main street 5"), (3, "a")], "id int, t string")
    right = spark.createDataFrame([(7, "street"), (8, "street"), (9, "a")], "nid int, n string")
    assert sorted((r["id"], r["nid"]) for r in M.contained(left, "t", right, "n").collect()) == [(1, 7), (1, 8), (1, 9), (2, 7), (2, 8), (2, 9), (3, 9)]


def test_overlap_with_a_hub_in_nine_of_ten_sets(spark):
    rng = random.Random(6)
    sets = {i: set(rng.sample(range(1, 60), rng.randint(1, 4))) | ({0} if i % 10 else set()) for i in range(600)}
    n5 = spark.createDataFrame([(i, p) for i, s in sets.items() for p in s], "candidate_id long, place_id long")
    cands = spark.createDataFrame([(i,) for i in [*sets, 9999]], "candidate_id long")
    got = {r["candidate_id"]: r["catchment_overlap"] for r in K.catchment_overlap(n5, cands).collect()}
    for i, s in sets.items():
        mean = sum(len(s & t) / len(s | t) for j, t in sets.items() if j != i) / (len(sets) - 1)
        assert got[i] == pytest.approx(max(0.0, min(1.0, 1 - mean / 0.6)) * 100, abs=0.0051)
    assert got[9999] == 100.0


def test_zone_covers_are_not_broadcast(spark):
    """A zone is eight bytes of input and many cells of polygons: the plan's guess of their size must not send them to the driver."""
    k = F.col("id")
    v = lambda a, b: F.struct((37.0 + k % 50 * 0.01 + a).alias("lat"), (-122.0 + F.floor(k / 50) * 0.01 + b).alias("lng"))
    zones = spark.range(500).select(k.alias("zone"), F.array(v(0.0, 0.0), v(0.02, 0.005), v(0.01, 0.02)).alias("poly"))
    rng = random.Random(5)
    pts = [(i, *p) for i, p in enumerate(spread(rng, 300, 37.25, -121.95, 0.2))]
    got = PY.in_zones(spark.createDataFrame(pts, "id bigint, lat double, lng double"), "lat", "lng", zones, "zone", "poly", heavy=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan

    def inside(lat, lng, p):
        odd = False
        for a, b in zip(p, [p[-1], *p[:-1]]):
            if (a[1] > lng) != (b[1] > lng) and lat < (b[0] - a[0]) * (lng - a[1]) / (b[1] - a[1] or 1e-12) + a[0]:
                odd = not odd
        return odd

    shapes = {z["zone"]: [(x["lat"], x["lng"]) for x in z["poly"]] for z in zones.collect()}
    want = {(z, i) for z, p in shapes.items() for i, lat, lng in pts if inside(lat, lng, p)}
    assert {(r["zone"], r["id"]) for r in got.collect()} == want and want


@pytest.mark.parametrize("unrolled,part", [(8, 4096), (2, 5)])
def test_rays_of_few_edges_are_compiled(spark, monkeypatch, unrolled, part):
    """A fold over a polygon is run row by row; the pairs of points and zones of few edges meet without one, and in parts."""
    monkeypatch.setattr(PY, "UNROLLED", unrolled)
    monkeypatch.setattr(PY, "PART_POINTS", part)
    rng = random.Random(unrolled)
    polys = [[(37.0 + i % 6 * 0.05 + a, -122.0 + i // 6 * 0.05 + b) for a, b in ((0.0, 0.0), (0.09, 0.02), (0.05, 0.09))] for i in range(36)]
    star = [(37.2 + (0.2 if i % 2 else 0.1) * math.sin(i * math.pi / 40), -121.8 + (0.2 if i % 2 else 0.1) * math.cos(i * math.pi / 40)) for i in range(80)]
    pts = [(i, *p) for i, p in enumerate(spread(rng, 400, 37.2, -121.8, 0.25) + [(37.06, -121.96)] * 60)]
    df = spark.createDataFrame(pts, "id int, lat double, lng double")
    for shapes in ([*polys, star], polys):
        got = PY.in_zones(df, "lat", "lng", spark.createDataFrame([(i, p) for i, p in enumerate(shapes)], ZONES), "zone", "polygon")
        assert sorted((r["id"], r["zone"]) for r in got.collect()) == sorted((i, k) for i, la, lo in pts for k, p in enumerate(shapes) if inside(la, lo, p))
    if unrolled > 2:
        assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("heavy", [1, 512])
def test_catchment_rings_equal_plain_loops(spark, heavy):
    """Circle and polygon by nested grids: unlisted places stay, a shape of two corners trims nothing."""
    from demandgrid.operators import geo as G

    rng = random.Random(heavy)
    rows = [(f"z{i}", *p) for i, p in enumerate(spread(rng, 12, width=0.05))] + [("far", 10.0, 179.99)]
    places = [(i, *p) for i, p in enumerate(spread(rng, 500, width=0.12))] + [(700, 10.0, 180.01), (701, 10.001, 179.995)]
    q = spark.createDataFrame(rows, "zip string, lat double, lng double")
    v = lambda a, b: F.struct((F.col("lat") + a).alias("lat"), (F.col("lng") + b).alias("lng"))
    few = F.array(v(0.0, 0.0), v(0.05, 0.05))
    q = q.withColumn("shape", F.when(F.col("zip") == "z3", few).when(F.col("zip") != "z4", F.array(v(-0.03, -0.03), v(0.05, 0.0), v(-0.01, 0.06))))
    s = spark.createDataFrame(places, "id bigint, plat double, plng double")
    gone = F.col("id") % 7 == 0
    got = PY.catchment_rings(q, ("lat", "lng"), "shape", s, ("plat", "plng"), gone, [1.0, 3.0, 5.0], heavy=heavy)
    got = {(r["zip"], r["distance"]): r["k"] for r in got.groupBy("zip", "distance").agg(F.sum("kept").alias("k")).collect()}
    pairs = G.within(q, s, ("lat", "lng"), ("plat", "plng"), 5.0, 5.0, EARTH_MILES_GRID)
    kept = G.catchment(pairs, F.when(~gone, F.col("plat")), F.when(~gone, F.col("plng")), F.col("shape"))
    ring = F.when(F.col("distance") <= 1, 1.0).when(F.col("distance") <= 3, 3.0).otherwise(5.0)
    want = {(r["zip"], r["r"]): r["k"] for r in kept.groupBy("zip", ring.alias("r")).agg(F.count("*").alias("k")).collect()}
    assert got == want and want


def test_candidate_pairs_are_not_moved_to_compare_them(spark):
    """Candidates and ZIPs of one spot pair up without a shuffle of the pairs; keys of several spots still come once."""
    from demandgrid.operators import zip_demand as Z

    cands = [(1, None, 37.40, -122.0, None), (1, None, 37.41, -122.0, None), (2, "00003", 37.40, -122.0, None), (3, "00001", None, None, "x"), (4, None, None, None, "Town"), (None, "00002", None, None, None), (5, "00002", 37.41, -122.01, "town")]
    c = spark.createDataFrame(cands + cands[2:4], "candidate_id bigint, candidate_zip string, lat double, lng double, city string")
    cen = spark.createDataFrame([("00001", 37.40, -122.01), ("00002", 37.42, -122.0), ("00002", 37.40, -122.02), ("00003", 39.0, -120.0), ("00001", 37.40, -122.01)], "zip string, lat double, lng double")
    ints = "total_classes total_students total_capacity arc_cpr_classes arc_cpr_students arc_bls_classes arc_bls_students aha_bls_classes aha_bls_students".split()
    prof = spark.createDataFrame([(f"0000{i}", ["town"], 50.0 + i, f"2000-0{i}-01", f"2000-0{i}-09") for i in (1, 2, 3)], "zip string, cities array<string>, fill_rate double, earliest_class_date string, latest_class_date string")
    prof = prof.withColumns({x: (F.col("zip").cast("bigint") * (j + 3)) for j, x in enumerate(ints)})
    got = Z.resolve_candidates(c, prof, cen, 5.0)
    rows = sorted(map(tuple, got.collect()), key=str)
    near = "exact_plus_radius"
    assert rows == sorted([(1, "00001", near), (1, "00002", near), (2, "00001", near), (2, "00002", near), (2, "00003", near), (3, "00001", near), (3, "00002", near), (4, "00001", "city"),
                           (4, "00002", "city"), (4, "00003", "city"), (None, "00002", near), (None, "00001", near), (5, "00001", near), (5, "00002", near)], key=str)
    # the pairs' branch of the plan ends in its join: only odd pairs are compared
    branch = got._jdf.queryExecution().optimizedPlan().toString().split("\n:- ")[1]
    assert "Join Inner" in branch and "Aggregate" not in branch
    merged = {r["candidate_id"]: r for r in Z.merged_candidates(c, prof, cen, 5.0).collect()}
    facts = {r["zip"]: r for r in prof.collect()}
    for i in {r[0] for r in rows}:
        mine = [facts[z] for k, z, _ in rows if k == i]
        assert merged[i]["zips"] == len(mine) and all(merged[i][x] == sum(f[x] for f in mine) for x in ints)
        assert merged[i]["earliest_class_date"] == min(f["earliest_class_date"] for f in mine) and merged[i]["latest_class_date"] == max(f["latest_class_date"] for f in mine)


@pytest.mark.parametrize("part", [512, 7])
def test_dense_pairs_equal_plain_pairs(spark, monkeypatch, part):
    """Cells a third of the radius wide and straight lines give the pairs and distances of ``within``; copies of one spot meet in parts."""
    from demandgrid.operators import geo as G

    monkeypatch.setattr(G, "PART_ROWS", part)
    rng = random.Random(part)
    left = [(i, *p) for i, p in enumerate(spread(rng, 200, width=0.2) + [(37.4, 179.99), (37.4, -179.99), (89.95, 10.0), (-89.99, 0.0)] + [(37.4, -122.0)] * 30)]
    right = [(i, *p, rng.choice([0.0, 0.5, 1.0, 2.5, 6.0, rng.uniform(0.1, 6.0)])) for i, p in enumerate(spread(rng, 300, width=0.25) + [(37.41, -179.995), (89.99, -170.0), (-89.97, 90.0), (37.4, -122.0)])]
    right += [(900, 37.4, -122.0, 0.0), (901, None, 1.0, 2.0), (902, 37.4, -122.0, None), (903, 37.4, -122.0, -1.0), (904, 37.4, -122.0, 6.0)]
    c = spark.createDataFrame([*left, (None, 37.4, -122.0), (990, None, 2.0)], "id bigint, lat double, lng double")
    p = spark.createDataFrame(right, "pid bigint, plat double, plng double, r double")
    rows = lambda df: sorted(((r["id"], r["pid"], r["distance"]) for r in df.collect()), key=str)
    at = (("lat", "lng"), ("plat", "plng"))
    for reach in (6.0, F.col("r")):
        dense = G.within_dense(c, p, *at, reach, 6.0)
        assert dense.columns == G.within(c, p, *at, reach, 6.0).columns and rows(dense) == rows(G.within(c, p, *at, reach, 6.0)) != []
    # what meets is judged by products; the distance comes only with a doubt, after them
    plan = dense._jdf.queryExecution().optimizedPlan().toString()
    assert plan[plan.index("Join Inner"):].index("_sure") < plan[plan.index("Join Inner"):].index("ASIN")


def test_few_of_the_pairs_that_meet_are_not_results(spark):
    """Postings reach one to six miles: a candidate meets those around it, not all within the widest."""
    from demandgrid.operators import geo as G

    k = F.col("id")
    c = spark.range(3000).select(k.alias("c"), (37.0 + k * 3571 % 6500 / 10000.0).alias("lat"), (-122.3 + k * 7457 % 6500 / 10000.0).alias("lng"))
    p = spark.range(1000).select(k.alias("p"), (37.0 + k * 2903 % 6500 / 10000.0).alias("plat"), (-122.3 + k * 6121 % 6500 / 10000.0).alias("plng"), (1.0 + k % 6).alias("r"))
    near = G.within_dense(c, p, ("lat", "lng"), ("plat", "plng"), F.col("r"), 6.0)
    found = near.count()
    limits = G.spread_cells(p, "plat", "plng", F.col("r"), G.cell_size(6.0) / G.FINE)
    met = limits.join(G.in_cell(c, "lat", "lng", G.cell_size(6.0) / G.FINE), ["cy", "cx"]).count()
    assert found and met < 2.5 * found


def test_rounding_by_arithmetic_equals_decimal_rounding(spark):
    from demandgrid.functions.exprs import rnd, rnd_far

    rng = random.Random(12)
    values = [rng.uniform(0, 10.0 ** rng.randint(-4, 7)) for _ in range(20_000)] + [k / 2000 for k in range(-50, 4000)] + [0.0005, 1.0005, 2.6755, 1e-12, -0.0001, -2.5, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", rnd(F.col("x"), 3).alias("a"), rnd_far(F.col("x"), 3).alias("b"))
    assert df.where("NOT (a <=> b)").count() == 0


@pytest.mark.parametrize("spots", [64, 3])
def test_zips_of_several_spots_come_once_without_comparing_pairs(spark, monkeypatch, spots):
    """A candidate near several spots of a ZIP counts it at the first; pairs are compared only where a ZIP has very many."""
    from demandgrid.operators import zip_demand as Z

    monkeypatch.setattr(Z, "SPOTS", spots)
    rng = random.Random(spots)
    at = spread(rng, 60, width=0.1)
    places = [(f"{z:05d}", *p) for z, m in enumerate((1, 1, 2, 3, 9, 5, 1)) for p in spread(rng, m, width=0.12)]
    c = spark.createDataFrame([(i, "00004" if i < 4 else None, *p, None) for i, p in enumerate(at)], "candidate_id bigint, candidate_zip string, lat double, lng double, city string")
    cen = spark.createDataFrame(places + places[3:7], "zip string, lat double, lng double")
    prof = spark.createDataFrame([(f"{z:05d}", ["town"]) for z in range(7)], "zip string, cities array<string>")
    got = Z.resolve_candidates(c, prof, cen, 5.0)
    want = {(i, z) for i, p in enumerate(at) for z, *q in places if miles(p, q, EARTH_MILES) <= 5.0} | {(i, "00004") for i in range(4)}
    assert sorted((r["candidate_id"], r["zip"]) for r in got.collect()) == sorted(want)
    # only own ZIPs beyond the radius and pairs with crowded ZIPs pass through a comparison of pairs
    branches = got._jdf.queryExecution().optimizedPlan().toString().split("\n:- ")
    compared = [b for b in branches if b.split("\n")[0].startswith("Aggregate [candidate_id")]
    assert len(compared) == 1 and ("_x1#" in compared[0]) == (spots == 3)
    assert "exists(" in got._jdf.queryExecution().optimizedPlan().toString()
