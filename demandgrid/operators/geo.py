"""Spatial joins as equi-joins on grid cells.

Distances are never the join condition: one side is put in its cell, the other
is copied to the cells its search box covers, and the exact distance filters
what meets.  Where only counts or a nearest site are wanted, rows sharing exact
coordinates collapse to one weighted row first, so copies of a point cost one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.exprs import EARTH_METERS, EARTH_MILES, EARTH_MILES_GRID, haversine, haversine_meters, n, rnd
from demandgrid.session import ensure_checkpoint_dir, many

C = F.col
MILES_PER_DEGREE = 69.0
# box half-widths use a slightly shorter degree so no true neighbour is cut off
_SAFE_DEGREE = 68.9
# right rows of a cell that meet in one part
CELL_ROWS = 4096
# cells across a radius, and rows of a cell that meet in one part, where many rows lie in every radius
FINE, PART_ROWS = 3, 512
# fourfold steps from the first search radius to the widest
WIDENINGS = 4


def bbox(lat: Column, lng: Column, miles: Column) -> dict[str, Column]:
    """South, west, north, east of a circle."""
    dlat = miles / MILES_PER_DEGREE
    dlng = miles / (MILES_PER_DEGREE * F.greatest(F.cos(F.radians(lat)), F.lit(1e-6)))
    return {"south": lat - dlat, "west": lng - dlng, "north": lat + dlat, "east": lng + dlng}


def offset_point(lat: Column, lng: Column, north: Column, east: Column) -> tuple[Column, Column]:
    return lat + north / MILES_PER_DEGREE, lng + east / (MILES_PER_DEGREE * F.cos(F.radians(lat)))


def lng_cells(size: float) -> int:
    """Cells round the globe: equal ones, at least ``size`` degrees wide, so that their
    numbers close into a ring at +/-180 degrees."""
    return max(1, int(360.0 // size))


def lng_cell(lng: Column, size: float) -> Column:
    n = lng_cells(size)
    return F.least(F.floor(F.pmod(lng + 180.0, F.lit(360.0)) * (n / 360.0)), F.lit(n - 1).cast("bigint"))


def lng_range(lo: Column, hi: Column, size: float) -> Column:
    """Cells of the longitudes from lo to hi (lo <= hi, either may pass +/-180)."""
    n = lng_cells(size)
    ring = F.lit(n).cast("bigint")
    at = lambda x: F.floor((x + 180.0) * (n / 360.0))
    part = F.array_distinct(F.transform(F.sequence(at(lo), at(lo) + F.least(at(hi) - at(lo), ring)), lambda x: F.pmod(x, ring)))
    return F.when(hi - lo >= 360.0, F.sequence(F.lit(0).cast("bigint"), ring - 1)).otherwise(part)


def cell(lat: Column, lng: Column, size: float) -> tuple[Column, Column]:
    return F.floor(lat / size), lng_cell(lng, size)


def _lng_reach(far_lat: Column, miles: Column) -> Column:
    """Longitude half-width of a box whose edge nearest a pole is at ``far_lat``: all
    longitudes when the box holds the pole."""
    wide = F.least(F.lit(180.0), miles / (_SAFE_DEGREE * F.greatest(F.cos(F.radians(far_lat)), F.lit(1e-9))))
    return F.when(far_lat >= 90.0, F.lit(180.0)).otherwise(wide)


def _reach(lat: Column, miles: Column) -> tuple[Column, Column]:
    """Half-widths in degrees that certainly contain a circle of that radius."""
    dlat = miles / _SAFE_DEGREE
    return dlat, _lng_reach(F.abs(lat) + dlat, miles)


def spread_cells(df: DataFrame, lat: str, lng: str, miles: Column, size: float) -> DataFrame:
    """One copy per cell the search box touches, as columns cy, cx."""
    dlat, dlng = _reach(C(lat), miles)
    ys = F.sequence(F.floor((C(lat) - dlat) / size), F.floor((C(lat) + dlat) / size))
    xs = lng_range(C(lng) - dlng, C(lng) + dlng, size)
    located = df.where(C(lat).isNotNull() & C(lng).isNotNull() & miles.isNotNull())
    return located.withColumn("cy", F.explode(ys)).withColumn("cx", F.explode(xs))


def in_cell(df: DataFrame, lat: str, lng: str, size: float) -> DataFrame:
    cy, cx = cell(C(lat), C(lng), size)
    return df.where(C(lat).isNotNull() & C(lng).isNotNull()).withColumns({"cy": cy, "cx": cx})


def cell_size(miles: float) -> float:
    """Cells about as wide as the radius: the box then touches few of them."""
    return max(0.01, round(miles / MILES_PER_DEGREE, 4))


def within(
    left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str],
    miles: float | Column, max_miles: float, radius: float = EARTH_MILES,
) -> DataFrame:
    """All pairs within a distance.  ``miles`` may be a column of either side
    (each row's own radius); ``max_miles`` bounds it and sizes the cells.
    Column names of the two sides must differ.

    A cell with more than ``CELL_ROWS`` right rows is met in parts, and the parts are dealt
    to all tasks: comparing costs far more than the bytes say, and a town is few cells."""
    size = cell_size(max_miles)
    limit = miles if isinstance(miles, Column) else F.lit(float(miles))
    a = spread_cells(left, *left_at, F.lit(float(max_miles)), size)
    b = in_cell(right, *right_at, size)
    parts = b.groupBy("cy", "cx").agg(F.ceil(F.count("*") / CELL_ROWS).alias("_parts"))
    a = a.join(parts, ["cy", "cx"]).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), C("_parts") - 1))).drop("_parts")
    own = F.pmod(F.xxhash64(*[C(f"`{c}`") for c in right.columns]), C("_parts"))
    b = b.join(parts, ["cy", "cx"]).withColumn("_part", own).drop("_parts")
    d = haversine(C(left_at[0]), C(left_at[1]), C(right_at[0]), C(right_at[1]), radius)
    at, k = ["cy", "cx", "_part"], many(left.sparkSession)
    met = a.repartition(k, *at).join(b.repartition(k, *at), at)
    return met.withColumn("distance", d).where(C("distance") <= limit).drop(*at)


def _vector(lat: Column, lng: Column) -> list[Column]:
    """A point on the unit sphere."""
    la, lo = F.radians(lat), F.radians(lng)
    return [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]


def within_dense(
    left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str],
    miles: float | Column, max_miles: float, radius: float = EARTH_MILES,
) -> DataFrame:
    """As ``within``, for sides so dense that the pairs are most of the work.  ``miles`` may
    be a column of the right side, at most ``max_miles``.

    The right rows, each as far as it reaches, are copied to cells a third of the maximum
    wide, so that most of the pairs that meet are results.  They are judged by the straight
    line between two points of the unit sphere, three products; only where that leaves a
    doubt (a relative 1e-9) the distance itself decides.  The left rows of a cell meet in
    parts of ``PART_ROWS`` rows at most, dealt to all tasks."""
    spark = left.sparkSession
    ensure_checkpoint_dir(spark)
    size = cell_size(max_miles) / FINE
    limit = F.least(miles if isinstance(miles, Column) else F.lit(float(miles)), F.lit(float(max_miles)))
    chord = 2.0 * F.sin(F.least(C("_limit") / (2.0 * radius), F.lit(math.pi / 2)))
    b = right.withColumn("_limit", F.when(miles.isNotNull(), limit) if isinstance(miles, Column) else limit).where("_limit >= 0")
    b = b.withColumns({"_sure": F.pow(F.greatest(chord * (1 - 1e-9) - 1e-14, F.lit(0.0)), 2.0), "_most": F.pow(chord * (1 + 1e-9) + 1e-14, 2.0),
                       **dict(zip(("_x2", "_y2", "_z2"), _vector(C(right_at[0]), C(right_at[1]))))})
    b = spread_cells(b, *right_at, C("_limit"), size)
    a = in_cell(left, *left_at, size)
    parts = a.groupBy("cy", "cx").agg(F.ceil(F.count("*") / PART_ROWS).alias("_parts")).checkpoint()
    own = F.pmod(F.xxhash64(*[C(f"`{c}`") for c in left.columns]), C("_parts"))
    a = a.join(parts, ["cy", "cx"]).withColumn("_part", own).drop("_parts").withColumns(dict(zip(("_x1", "_y1", "_z1"), _vector(C(left_at[0]), C(left_at[1])))))
    b = b.join(parts, ["cy", "cx"]).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), C("_parts") - 1))).drop("_parts")
    at, k = ["cy", "cx", "_part"], many(spark)
    dx, dy, dz = (C(f"_{c}1") - C(f"_{c}2") for c in "xyz")
    line = dx * dx + dy * dy + dz * dz
    d = haversine(C(left_at[0]), C(left_at[1]), C(right_at[0]), C(right_at[1]), radius)
    # the side with the parts is the one that a task holds
    met = b.repartition(k, *at).join(a.repartition(k, *at), at).where((line <= C("_sure")) | ((line <= C("_most")) & (d <= C("_limit"))))
    return met.select(*[C(f"`{c}`") for c in (*left.columns, *right.columns)], d.alias("distance"))


def nearest_reaching(
    pts: DataFrame, lat: str, lng: str, sites: DataFrame, site: str, s_lat: str, s_lng: str, reach: str,
    max_miles: float, radius: float = EARTH_MILES,
) -> DataFrame:
    """Of the sites whose own ``reach`` (at most ``max_miles``) covers it, the nearest one of
    every distinct coordinate: lat, lng, <site>, distance.  Ties go to the smallest ``site``.

    The search starts close by and widens fourfold; only coordinates without a hit go on,
    so one in a crowded town meets the sites next to it, never all within the maximum."""
    ensure_checkpoint_dir(pts.sparkSession)
    rest = pts.where(C(lat).isNotNull() & C(lng).isNotNull()).select(C(lat).alias("p_lat"), C(lng).alias("p_lng")).distinct().checkpoint()
    spots = sites.where(C(s_lat).isNotNull() & C(s_lng).isNotNull()).groupBy(
        C(s_lat).alias("q_lat"), C(s_lng).alias("q_lng"), C(reach).alias("q_reach")).agg(F.min(site).alias("q_site")).checkpoint()
    d, found = haversine(C("p_lat"), C("p_lng"), C("q_lat"), C("q_lng"), radius), None
    for k in range(WIDENINGS, -1, -1):
        miles = float(max_miles) / 4.0**k
        size = miles / MILES_PER_DEGREE
        met = spread_cells(rest, "p_lat", "p_lng", F.lit(miles), size).join(in_cell(spots, "q_lat", "q_lng", size), ["cy", "cx"])
        near = met.withColumn("d", d).where((C("d") <= miles) & (C("d") <= C("q_reach")))
        hits = near.groupBy("p_lat", "p_lng").agg(F.min(F.struct("d", "q_site")).alias("b")).checkpoint()
        found = hits if found is None else found.unionByName(hits)
        if k:
            rest = rest.join(hits, ["p_lat", "p_lng"], "left_anti").checkpoint()
    return found.select(C("p_lat").alias(lat), C("p_lng").alias(lng), C("b.q_site").alias(site), C("b.d").alias("distance"))


def nearest(
    pts: DataFrame, lat: str, lng: str, sites: DataFrame, site: str, s_lat: str, s_lng: str,
    max_miles: float, radius: float = EARTH_MILES_GRID, near_cell: float = 0.2,
) -> DataFrame:
    """Nearest site of every distinct coordinate: lat, lng, <site>, distance.

    First the 3x3 cells around the point.  Its best hit is final when it is
    closer than the edge of that block; the rest look again within a radius that
    grows fourfold up to the maximum, and only points without a hit in it go on, so
    a point in sparse country never meets all sites of the next town but one.  All
    steps are equi-joins.  Ties go to the smallest site key."""
    coords = pts.where(C(lat).isNotNull() & C(lng).isNotNull()).select(C(lat).alias("p_lat"), C(lng).alias("p_lng")).distinct()
    # sites sharing a spot collapse to the smallest key
    spots = sites.where(C(s_lat).isNotNull() & C(s_lng).isNotNull()).groupBy(
        C(s_lat).alias("q_lat"), C(s_lng).alias("q_lng")).agg(F.min(site).alias("q_site"))
    dist = haversine(C("p_lat"), C("p_lng"), C("q_lat"), C("q_lng"), radius)

    def best(candidates: DataFrame, limit: float) -> DataFrame:
        hit = candidates.withColumn("d", dist).where(C("d") <= limit)
        return hit.groupBy("p_lat", "p_lng").agg(F.min(F.struct("d", "q_site")).alias("b"))

    cy, cx = cell(C("p_lat"), C("p_lng"), near_cell)
    ring_size = F.lit(lng_cells(near_cell)).cast("bigint")
    around = F.array_distinct(F.transform(F.sequence(cx - 1, cx + 1), lambda x: F.pmod(x, ring_size)))
    ring = coords.withColumn("cy", F.explode(F.sequence(cy - 1, cy + 1))).withColumn("cx", F.explode(around))
    near = coords.join(best(ring.join(in_cell(spots, "q_lat", "q_lng", near_cell), ["cy", "cx"]), max_miles), ["p_lat", "p_lng"], "left")
    dy = F.least(C("p_lat") - (cy - 1) * near_cell, (cy + 2) * near_cell - C("p_lat")) * _SAFE_DEGREE
    wide = 360.0 / lng_cells(near_cell)
    x = F.pmod(C("p_lng") + 180.0, F.lit(360.0))
    edge_lat = F.greatest(F.abs((cy - 1) * near_cell), F.abs((cy + 2) * near_cell))
    # a block at the pole is next to every longitude, so nothing there is final
    shrink = F.when(edge_lat < 89.0, F.cos(F.radians(edge_lat))).otherwise(F.lit(0.0))
    dx = F.least(x - (cx - 1) * wide, (cx + 2) * wide - x) * _SAFE_DEGREE * shrink
    near = near.withColumn("final", F.coalesce(C("b.d") < F.least(dy, dx, F.lit(float(max_miles))), F.lit(False)))
    found, rest = near.where("final").select("p_lat", "p_lng", "b"), near.where(~C("final")).select("p_lat", "p_lng")
    reach = near_cell * MILES_PER_DEGREE
    while True:
        reach = min(reach * 4.0, float(max_miles))
        size = cell_size(reach)
        hits = best(spread_cells(rest, "p_lat", "p_lng", F.lit(reach), size).join(in_cell(spots, "q_lat", "q_lng", size), ["cy", "cx"]), reach)
        found = found.unionByName(hits)
        if reach >= max_miles:
            break
        rest = rest.join(hits, ["p_lat", "p_lng"], "left_anti")
    return found.select(C("p_lat").alias(lat), C("p_lng").alias(lng), C("b.q_site").alias(site), C("b.d").alias("distance"))


def assign(pts: DataFrame, lat: str, lng: str, sites: DataFrame, site: str, s_lat: str, s_lng: str, max_miles: float) -> DataFrame:
    """Points with their nearest site (NULL beyond the maximum)."""
    hit = nearest(pts, lat, lng, sites, site, s_lat, s_lng, max_miles)
    return pts.join(hit, [lat, lng], "left")


def count_by_site(pts: DataFrame, lat: str, lng: str, sites: DataFrame, site: str, s_lat: str, s_lng: str,
                  max_miles: float, extra: list[str] | None = None) -> DataFrame:
    """Points per nearest site.  Copies are counted before the join, so one
    coordinate holding a third of all rows joins as a single row."""
    extra = extra or []
    weighted = pts.where(C(lat).isNotNull() & C(lng).isNotNull()).groupBy(lat, lng, *extra).agg(F.count("*").alias("_k"))
    hit = nearest(weighted, lat, lng, sites, site, s_lat, s_lng, max_miles)
    return weighted.join(hit, [lat, lng]).groupBy(site, *extra).agg(F.sum("_k").alias("points"))


def distance_buckets(dist: Column, miles: list[float], weight: Column | None = None) -> list[Column]:
    """Cumulative counts within each distance."""
    if weight is None:
        return [n(dist <= m).alias(f"within_{m:g}") for m in miles]
    return [F.coalesce(F.sum(F.when(dist <= m, weight)), F.lit(0)).alias(f"within_{m:g}") for m in miles]


def edge_facts(a: Column, b: Column) -> dict[str, Column]:
    """What a ray test needs of the edge from a to b (structs lat, lng)."""
    run = b["lng"] - a["lng"]
    return {"lat": a["lat"], "lng": a["lng"], "to": b["lng"], "rise": b["lat"] - a["lat"], "run": F.when(run == 0, F.lit(1e-12)).otherwise(run)}


def edge_crosses(lat: Column, lng: Column, e) -> Column:
    """Whether the ray from a point crosses an edge (``edge_facts``)."""
    straddles = (e["lng"] > lng) != (e["to"] > lng)
    return straddles & (lat < e["rise"] * (lng - e["lng"]) / e["run"] + e["lat"])


def polygon_contains(lat: Column, lng: Column, polygon: Column) -> Column:
    """Crossing-number test on array<struct<lat,lng>>, closing edge implied.

    Folds over the vertices of one polygon, so no row is exploded."""
    size = F.size(polygon)
    pairs = F.arrays_zip(polygon.alias("a"), F.concat(F.slice(polygon, -1, 1), F.slice(polygon, F.lit(1), F.greatest(size - 1, F.lit(1)))).alias("b"))

    def crosses(e: Column) -> Column:
        return edge_crosses(lat, lng, edge_facts(e.getField("a"), e.getField("b"))).cast("int")

    odd = F.aggregate(pairs, F.lit(0), lambda acc, e: acc + crosses(e)) % 2 == 1
    return F.when(size >= 3, odd).otherwise(F.lit(False))


def polygon_vertex_meters(lat: Column, lng: Column, polygon: Column) -> Column:
    """Distance to the closest vertex, 0 inside."""
    d = F.array_min(F.transform(polygon, lambda v: haversine_meters(lat, lng, v["lat"], v["lng"])))
    return F.when(polygon_contains(lat, lng, polygon), F.lit(0.0)).otherwise(d)


def catchment(pairs: DataFrame, lat: Column, lng: Column, polygon: Column) -> DataFrame:
    """Keep rows inside the catchment; rows without coordinates stay, and fewer
    than three vertices is no catchment at all."""
    inside = polygon_contains(lat, lng, polygon)
    return pairs.where(F.coalesce(F.size(polygon) < 3, F.lit(True)) | lat.isNull() | lng.isNull() | inside)


def distance_dedupe(df: DataFrame, key: str, lat: str, lng: str, score: str, miles: float) -> DataFrame:
    """Keep a candidate unless a better kept one is closer than ``miles``.

    Same result as walking the list best first (ties: smaller key first).  Cells
    are small enough that two rows of one cell always conflict, so only the best
    open row of a cell can be kept in a round; it is kept when no better open row
    lies within reach, and then closes every open row around it.  Both steps meet
    rows with a handful of cell leaders, never rows with rows, so a crowded spot
    stays linear.  The best open row overall is kept in every round, hence the
    loop ends; open rows are checkpointed as they shrink."""
    if miles <= 0:
        return df
    ensure_checkpoint_dir(df.sparkSession)
    placed = C(lat).isNotNull() & C(lng).isNotNull()
    size = miles / (_SAFE_DEGREE * 1.5)
    at = df.where(placed).select(C(key).alias("k"), C(lat).alias("la"), C(lng).alias("lo"),
                                 F.coalesce(C(score).cast("double"), F.lit(0.0)).alias("s"))
    open_ = in_cell(at, "la", "lo", size).checkpoint()
    kept = open_.select("k").where(F.lit(False))
    gap = haversine(C("la"), C("lo"), C("la2"), C("lo2"), EARTH_MILES_GRID)
    better = (C("s") > C("s2")) | ((C("s") == C("s2")) & (C("k") < C("k2")))
    while not open_.isEmpty():
        order = F.struct(C("s"), (-C("k")).alias("nk"))
        leaders = open_.groupBy("cy", "cx").agg(F.max_by(F.struct("k", "la", "lo", "s"), order).alias("b")).select(
            C("b.k").alias("k2"), C("b.la").alias("la2"), C("b.lo").alias("lo2"), C("b.s").alias("s2"))
        around = spread_cells(leaders, "la2", "lo2", F.lit(float(miles)), size)
        beaten = around.join(open_, ["cy", "cx"]).where(better & (gap < miles)).select("k2").distinct()
        new = leaders.join(beaten, "k2", "left_anti").checkpoint()
        closed = spread_cells(new, "la2", "lo2", F.lit(float(miles)), size).join(open_, ["cy", "cx"]).where(
            (gap < miles) | (C("k") == C("k2"))).select("k").distinct()
        kept = kept.unionByName(new.select(C("k2").alias("k")))
        open_ = open_.join(closed, "k", "left_anti").checkpoint()
    survivors = df.join(kept.select(C("k").alias(key)), key, "left_semi")
    return survivors.unionByName(df.where(~placed))


def grid_points(centers: DataFrame, lat: str, lng: str, radius: float, spacing: float, max_points: int) -> DataFrame:
    """Square grid clipped to a circle around each centre, nearest first.

    The grid of one centre is small and known from the arguments, so it is an
    array sorted and cut inside the row."""
    steps = -int(-radius // spacing)
    axis = F.sequence(F.lit(-steps), F.lit(steps))
    offsets = F.flatten(F.transform(axis, lambda i: F.transform(axis, lambda j: F.struct(
        (i * spacing).alias("north"), (j * spacing).alias("east")))))
    inside = F.filter(offsets, lambda o: F.sqrt(o["north"] * o["north"] + o["east"] * o["east"]) <= radius)

    def place(o: Column) -> Column:
        la, lo = offset_point(C(lat), C(lng), o["north"], o["east"])
        return F.struct(rnd(haversine(C(lat), C(lng), la, lo, EARTH_MILES_GRID), 6).alias("d"), o["north"].alias("north"),
                        o["east"].alias("east"), la.alias("grid_lat"), lo.alias("grid_lng"))

    ordered = F.slice(F.array_sort(F.transform(inside, place)), 1, max_points)
    return centers.select("*", F.posexplode(ordered).alias("pos", "g")).select(
        *centers.columns, "pos", C("g.north").alias("north"), C("g.east").alias("east"),
        C("g.grid_lat").alias("grid_lat"), C("g.grid_lng").alias("grid_lng"))
