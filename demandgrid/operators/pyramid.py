"""Nested grids: sums in a radius, nearest neighbours and polygon covers without row pairs.

A level is a grid of square cells of 2**-level degrees; cells nest exactly, since
scaling by a power of two loses no digit.  What lies wholly inside a circle or
polygon is taken cell by cell, what its edge crosses is split further, and rows
are met only where a crossed cell holds few of them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.exprs import EARTH_MILES, EARTH_MILES_GRID, fenced, haversine, haversine_meters, total
from demandgrid.operators.geo import MILES_PER_DEGREE, _reach, catchment, edge_crosses, edge_facts, polygon_contains, within
from demandgrid.session import ensure_checkpoint_dir, many

C = F.col
#: Rows that a crossed cell may hold before it is split; meeting them costs less than judging its parts.
HEAVY = 512
#: Points of a cell that meet its zones in one part.
PART_POINTS = 4096
#: A split halves the side twice; after so many splits a cell is some metres wide.
SPLIT, SPLITS = 2, 5
#: Miles by which a cell must clear a circle; covers rounding of the distances.
CLEAR = 1e-6


def side(level: int | Column) -> float | Column:
    return F.pow(F.lit(2.0), -level) if isinstance(level, Column) else 2.0 ** -level


def grid(lat: Column, lng: Column, level: int | Column) -> tuple[Column, Column]:
    """Cell of a point; longitudes close into a ring."""
    scale = F.pow(F.lit(2.0), level) if isinstance(level, Column) else F.lit(2.0**level)
    return F.floor((lat + 90.0) * scale), F.floor(F.pmod(lng + 180.0, F.lit(360.0)) * scale)


def _box(lat: Column, lng: Column, miles: Column, level: int | Column) -> tuple[Column, Column]:
    """Rows and columns of cells that a circle's box touches."""
    scale = F.pow(F.lit(2.0), level) if isinstance(level, Column) else F.lit(2.0**level)
    dlat, dlng = _reach(lat, miles)
    ring = F.greatest((scale * 360.0).cast("bigint"), F.lit(1).cast("bigint"))
    west, east = F.floor((lng - dlng + 180.0) * scale), F.floor((lng + dlng + 180.0) * scale)
    rows = F.sequence(F.floor((F.greatest(lat - dlat, F.lit(-90.0)) + 90.0) * scale), F.floor((F.least(lat + dlat, F.lit(90.0)) + 90.0) * scale))
    around = F.array_distinct(F.transform(F.sequence(west, F.least(east, west + ring)), lambda x: F.pmod(x, ring)))
    return rows, around


def _span(lat: Column, lng: Column, cy: Column, cx: Column, level: int, radius: float) -> tuple[Column, Column]:
    """Lower and upper bound of the distance from a point to any point of a cell (exact above, short of a pole)."""
    s = side(level)
    south, west = cy * s - 90.0, cx * s - 180.0
    corners = [(south + a * s, west + b * s) for a in (0, 1) for b in (0, 1)]
    far = F.greatest(*[haversine(lat, lng, y, x, radius) for y, x in corners])
    mid = (south + s / 2, west + s / 2)
    half = F.greatest(*[haversine(mid[0], mid[1], y, x, radius) for y, x in (corners[0], corners[2])])
    near = F.greatest(F.lit(0.0), haversine(lat, lng, mid[0], mid[1], radius) - half)
    polar = (south < -88.0) | (south + s > 88.0)
    # beyond a quarter of the globe, or round a pole, corners need not be the farthest points
    return near - CLEAR, F.when(polar | (far > 1.5 * radius), F.lit(float("inf"))).otherwise(far + CLEAR)


def _ring(distance: Column, radii: list[float]) -> Column:
    """The smallest of the radii that holds a distance."""
    return F.coalesce(*[F.when(distance <= r, F.lit(float(r))) for r in sorted(radii)])


def near_sums(queries: DataFrame, at: tuple[str, str], sites: DataFrame, site_at: tuple[str, str], sums: list[str], maxes: list[str] | None = None,
              keys: list[str] | None = None, radii: list[float] | None = None, own: str | None = None, max_miles: float | None = None,
              radius: float = EARTH_MILES_GRID, heavy: int = HEAVY, mins: list[str] | None = None, polygon: str | None = None) -> DataFrame:
    """Sums, maxima and minima over the sites around every query point: at, keys, distance, sums, maxes, mins.

    With ``polygon`` (a column of the queries) only sites inside it count too; a query
    point's row then carries it, and cells that its edge touches are split like those that
    a circle crosses.  Under three vertices it holds nothing.

    With ``radii`` a row per ring: ``distance`` is the smallest of the radii that holds
    the ring's sites.  With ``own`` every site reaches as far as that column says (at
    most ``max_miles``) and ``distance`` is NULL.

    A pyramid of cell sums is built once.  A cell that no circle's edge crosses is added
    as a whole; a crossed one is split while it holds more than ``heavy`` rows, and only
    the rows of small crossed cells meet the query point.  So the work follows the
    circles' edges, not the sites inside, and a crowded cell costs its few children.
    Own radii are classed by size, so that a cell's sites reach about equally far."""
    spark = queries.sparkSession
    ensure_checkpoint_dir(spark)
    maxes, mins, keys = maxes or [], mins or [], keys or []
    at_q = ["q_lat", "q_lng", *(["_p"] if polygon else [])]
    most = float(max_miles if radii is None else max(radii))
    top = math.ceil(math.log2(2.0 * MILES_PER_DEGREE / most))
    levels = [top + SPLIT * i for i in range(SPLITS + 1)]
    q = queries.select(C(at[0]).alias("q_lat"), C(at[1]).alias("q_lng"), *([C(polygon).alias("_p")] if polygon else [])).where("q_lat IS NOT NULL AND q_lng IS NOT NULL").distinct()
    if polygon:
        q = q.where(F.size("_p") >= 3)
    reach = C(own).cast("double") if own else F.lit(most)
    reached = F.floor(F.log2(F.greatest(reach, F.lit(1e-3))) * 4.0) if own else F.lit(0).cast("bigint")
    kept = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in maxes] + [F.min(c).alias(c) for c in mins]
    placed = sites.where(C(site_at[0]).isNotNull() & C(site_at[1]).isNotNull() & reach.isNotNull())
    rows = (
        placed.withColumns({"s_lat": C(site_at[0]), "s_lng": C(site_at[1]), "_reach": reach, "_class": reached})
        .groupBy("s_lat", "s_lng", "_reach", "_class", *keys).agg(*kept).checkpoint()
    )
    lv = F.explode(F.array(*[F.lit(v) for v in levels]))
    celled = rows.withColumn("_level", lv)
    cy, cx = grid(C("s_lat"), C("s_lng"), C("_level"))
    cells = celled.withColumns({"cy": cy, "cx": cx}).groupBy("_level", "cy", "cx", "_class", *keys).agg(
        *kept, F.count("*").alias("_n"), F.min("_reach").alias("_r0"), F.max("_reach").alias("_r1")).checkpoint()
    heads = cells.groupBy("_level", "cy", "cx", "_class").agg(F.sum("_n").alias("_n"), F.min("_r0").alias("_r0"), F.max("_r1").alias("_r1"))
    ys, xs = _box(C("q_lat"), C("q_lng"), F.lit(most), top)
    open_ = q.withColumn("cy", F.explode(ys)).withColumn("cx", F.explode(xs))
    found = None
    for level in levels:
        here = heads.where(C("_level") == level).drop("_level")
        if level == top:
            met = open_.join(here, ["cy", "cx"])
        else:
            up = here.withColumns({"_py": F.floor(C("cy") / 2**SPLIT), "_px": F.floor(C("cx") / 2**SPLIT)})
            met = open_.join(up, ["_py", "_px", "_class"]).drop("_py", "_px")
        near, far = _span(C("q_lat"), C("q_lng"), C("cy"), C("cx"), level, radius)
        met = fenced(met.withColumns({"_near": near, "_far": far}), ["_near", "_far"])
        if own:
            beyond, inner, ring = C("_near") > C("_r1"), C("_far") <= C("_r0"), F.lit(None).cast("double")
        else:
            crossed = reduce(lambda x, y: x | y, [(C("_near") < r) & (C("_far") > r) for r in radii])
            beyond, inner, ring = C("_near") > most, ~crossed, _ring(C("_far"), radii)
        if polygon:
            # a cell whose edge is untouched lies wholly inside or outside, and the latter goes
            met = _judged(met.where(~beyond), F.lit(side(level)))
            beyond, inner = F.lit(False), inner & ~C("_crossed")
        judged = met.where(~beyond).withColumns({"_inner": inner, "distance": F.when(inner, ring)}).drop("_near", "_far", "_r0", "_r1", "_crossed").checkpoint()
        whole = judged.where("_inner").drop("_n").join(cells.where(C("_level") == level).drop("_level", "_n", "_r0", "_r1"), ["cy", "cx", "_class"])
        last = level == levels[-1]
        few = judged.where(~C("_inner")) if last else judged.where(~C("_inner") & (C("_n") <= heavy))
        gy, gx = grid(C("s_lat"), C("s_lng"), level)
        d = haversine(C("q_lat"), C("q_lng"), C("s_lat"), C("s_lng"), radius)
        pairs = few.drop("_n", "distance").join(rows.withColumns({"cy": gy, "cx": gx}), ["cy", "cx", "_class"]).withColumn("_d", d).where(C("_d") <= C("_reach"))
        if polygon:
            pairs = pairs.where(polygon_contains(C("s_lat"), C("s_lng"), C("_p")))
        ringed = F.lit(None).cast("double") if own else _ring(C("_d"), radii)
        columns = [*at_q, *keys, "distance", *sums, *maxes, *mins]
        part = whole.select(*columns).unionByName(pairs.withColumn("distance", ringed).select(*columns))
        found = part if found is None else found.unionByName(part)
        more = judged.where(~C("_inner") & (C("_n") > heavy))
        if last or more.isEmpty():
            break
        open_ = more.select(*at_q, C("cy").alias("_py"), C("cx").alias("_px"), "_class")
    out = found.groupBy(*at_q, *keys, "distance").agg(*kept)
    return out.withColumnsRenamed({"q_lat": at[0], "q_lng": at[1], **({"_p": polygon} if polygon else {})})


def catchment_rings(queries: DataFrame, at: tuple[str, str], polygon: str, sites: DataFrame, site_at: tuple[str, str], unlisted: Column,
                    radii: list[float], radius: float = EARTH_MILES_GRID, heavy: int = HEAVY) -> DataFrame:
    """Queries with a row per ring (``distance``, its radius) and the sites ``kept`` in it.

    As ``geo.catchment``: ``unlisted`` sites stay, others must lie in the query's
    polygon, and fewer than three vertices is no catchment at all.  Counts come from
    nested grids, so no query meets the sites inside its circle and polygon one by one."""
    one = sites.withColumn("kept", F.lit(1).cast("bigint"))
    lat, lng = C(site_at[0]), C(site_at[1])
    open_ = F.coalesce(F.size(polygon) < 3, F.lit(True))
    listed, rest = one.where(~unlisted), one.where(unlisted)
    # polygons are flat and cells are not: what lies off the map is met pair by pair
    flat = (F.abs(lat) < 90.0) & (F.abs(lng) < 180.0)
    off = catchment(within(queries, listed.where(~flat).select(lat.alias("_s_lat"), lng.alias("_s_lng"), "kept"), at, ("_s_lat", "_s_lng"), max(radii), max(radii), radius),
                    C("_s_lat"), C("_s_lng"), C(polygon)).withColumn("distance", _ring(C("distance"), radii))
    out = off.select(*queries.columns, "distance", "kept")
    for q, s, by in ((queries, rest, None), (queries.where(open_), listed.where(flat), None), (queries.where(~open_), listed.where(flat), polygon)):
        sums = near_sums(q, at, s, site_at, ["kept"], radii=radii, radius=radius, heavy=heavy, polygon=by)
        out = out.unionByName(q.join(sums, [*at, *([by] if by else [])]).select(*queries.columns, "distance", "kept"))
    return out


#: Levels of the counts that tell how far the nearest people can be: 64 degrees to about 25 metres.
RINGS = list(range(-6, 13))


def nearest_k(targets: DataFrame, key: str, lat: str, lng: str, people: DataFrame, p_lat: str, p_lng: str, k: int, radius: float = EARTH_MILES) -> DataFrame:
    """Targets with everybody who can be among their ``k`` nearest, and the distance.

    First round: people are counted per cell of every level, and each target takes the
    finest level whose three by three cells around it hold ``k`` of them.  Their farthest
    point bounds the k-th distance.  Second round: the people in the cells of that level
    that the bound reaches.  Where fewer than ``k`` people exist, all are returned."""
    ensure_checkpoint_dir(targets.sparkSession)
    placed = people.where(C(p_lat).isNotNull() & C(p_lng).isNotNull())
    t = targets.where(C(lat).isNotNull() & C(lng).isNotNull()).select(key, C(lat).alias("_lat"), C(lng).alias("_lng"))
    py, px = grid(C(p_lat), C(p_lng), C("_level"))
    levelled = placed.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in RINGS]))).withColumns({"cy": py, "cx": px})
    counts = levelled.groupBy("_level", "cy", "cx").agg(F.count("*").alias("_n"))
    spots = t.select("_lat", "_lng").distinct().withColumn("_level", F.explode(F.array(*[F.lit(v) for v in RINGS])))
    cy, cx = grid(C("_lat"), C("_lng"), C("_level"))
    ring = F.ceil(F.lit(360.0) * F.pow(F.lit(2.0), C("_level")))
    around = F.array_distinct(F.transform(F.sequence(cx - 1, cx + 1), lambda x: F.pmod(x, ring)))
    block = spots.withColumns({"_cy": cy, "_cx": around}).withColumn("cy", F.explode(F.sequence(C("_cy") - 1, C("_cy") + 1))).withColumn("cx", F.explode("_cx"))
    held = block.join(counts, ["_level", "cy", "cx"]).groupBy("_lat", "_lng", "_level").agg(F.sum("_n").alias("_n")).where(C("_n") >= k)
    finest = held.groupBy("_lat", "_lng").agg(F.max("_level").alias("_level"))
    # two sides along the meridian, then two along the parallel nearer to the equator, at most
    wide = 2.0 * side(C("_level"))
    low = F.greatest(F.lit(0.0), F.abs(C("_lat")) - wide)
    bound = F.least(F.lit(math.pi * radius), wide * 69.3 * (1.0 + F.cos(F.radians(low))))
    # a circle round a pole takes a whole ring of cells, so wide ones
    near = spots.select("_lat", "_lng").distinct().join(finest, ["_lat", "_lng"], "left")
    near = near.withColumn("_bound", F.coalesce(bound, F.lit(math.pi * radius)))
    polar = F.abs(C("_lat")) + C("_bound") / 68.9 > 85.0
    near = near.withColumn("_level", F.when(polar | C("_level").isNull(), F.lit(RINGS[0])).otherwise(C("_level")))
    ys, xs = _box(C("_lat"), C("_lng"), C("_bound"), C("_level"))
    cells = near.withColumns({"_ys": ys, "_xs": xs}).withColumn("cy", F.explode("_ys")).withColumn("cx", F.explode("_xs")).drop("_ys", "_xs")
    d = haversine(C("_lat"), C("_lng"), C(p_lat), C(p_lng), radius)
    met = cells.join(levelled, ["_level", "cy", "cx"]).withColumn("distance", d).where(C("distance") <= C("_bound")).drop("cy", "cx", "_level", "_bound")
    return t.join(met, ["_lat", "_lng"]).drop("_lat", "_lng")


#: Levels of polygon covers; a cover starts where the polygon's box is one to five cells wide.
COVER_LEVELS = list(range(-6, 19, 2))


def _edges(polygon: Column) -> Column:
    """The edges of a polygon, the closing one included, as structs a, b."""
    return F.arrays_zip(polygon.alias("a"), F.concat(F.slice(polygon, -1, 1), F.slice(polygon, F.lit(1), F.size(polygon) - 1)).alias("b"))


def _ends(p: Column) -> dict[str, Column]:
    """The box of a polygon: _lo_lat, _lo_lng, _hi_lat, _hi_lng."""
    return {f"_{f}_{d}": (F.array_min if f == "lo" else F.array_max)(F.transform(p, lambda v: v[d])) for f in ("lo", "hi") for d in ("lat", "lng")}  # noqa: B023


def cover_start(zones: DataFrame, key: str, polygon: str) -> DataFrame:
    """key, _p, level, cy, cx: at most 25 cells that hold the polygon (array<struct<lat,lng>>) and
    that its size alone decides.  Flat coordinates, as in ``polygon_contains``; under three vertices no cell."""
    p = C("_p")
    z = zones.select(key, C(polygon).alias("_p")).where(F.size("_p") >= 3)
    ends = _ends(p)
    z = fenced(z.withColumns(ends), list(ends))
    extent = F.greatest(C("_hi_lat") - C("_lo_lat"), C("_hi_lng") - C("_lo_lng"), F.lit(1e-9))
    level = F.greatest(F.lit(COVER_LEVELS[0]), F.least(F.lit(COVER_LEVELS[-1]), (F.floor((2.0 - F.log2(extent)) / 2) * 2).cast("int"))).cast("int")
    cells = fenced(z.withColumn("level", level), ["level"])
    scale = F.pow(F.lit(2.0), C("level"))
    span = lambda d, shift: F.sequence(F.floor((C(f"_lo_{d}") + shift) * scale), F.floor((C(f"_hi_{d}") + shift) * scale))
    return cells.withColumn("cy", F.explode(span("lat", 90.0))).withColumn("cx", F.explode(span("lng", 180.0))).drop(*ends)


def cover_judge(cells: DataFrame) -> DataFrame:
    """Cells of ``cover_start`` less those outside their polygon, with _crossed: whether an edge touches them.

    A cell that no edge touches lies wholly inside or outside, as its centre does."""
    return _judged(cells, side(C("level")))


def _judged(cells: DataFrame, s: Column) -> DataFrame:
    """The cells (cy, cx of side ``s``) less those outside their polygon _p, with _crossed."""
    eps = 1e-9
    y0, x0 = C("cy") * s - 90.0, C("cx") * s - 180.0
    corners = {"_y0": y0 - eps, "_y1": y0 + s + eps, "_x0": x0 - eps, "_x1": x0 + s + eps}
    boxed = fenced(cells.withColumns(corners), list(corners))

    def touches(e: Column) -> Column:
        a, b = e["a"], e["b"]
        box = (F.least(a["lat"], b["lat"]) <= C("_y1")) & (F.greatest(a["lat"], b["lat"]) >= C("_y0")) & (F.least(a["lng"], b["lng"]) <= C("_x1")) & (F.greatest(a["lng"], b["lng"]) >= C("_x0"))
        # which side of the edge's line a corner is on
        turn = lambda y, x: F.signum((b["lng"] - a["lng"]) * (C(y) - a["lat"]) - (b["lat"] - a["lat"]) * (C(x) - a["lng"]))
        return box & (F.abs(total([turn(y, x) for y in ("_y0", "_y1") for x in ("_x0", "_x1")])) < 4.0)

    judged = fenced(boxed.withColumn("_crossed", F.exists(_edges(C("_p")), touches)), ["_crossed"])
    inside = F.when(C("_crossed"), True).otherwise(polygon_contains((C("_y0") + C("_y1")) / 2, (C("_x0") + C("_x1")) / 2, C("_p")))
    return judged.where(inside).drop(*corners)


#: Edges of a cell for which a ray test is written out; a cell that more concern folds over them.
UNROLLED = 8


def _concerning(polygon: Column, s: Column) -> Column:
    """The edges (``edge_facts``) that the ray of a point of the cell (cy, cx of side ``s``) can cross.

    Rays go to larger latitudes, so edges beside or wholly below the cell are left out;
    edges with unknown ends stay."""
    eps = 1e-9
    y0, x0 = C("cy") * s - 90.0 - eps, C("cx") * s - 180.0 - eps
    x1 = x0 + s + 2 * eps

    def may(e: Column) -> Column:
        a, b = e["a"], e["b"]
        unknown = reduce(lambda x, y: x | y, [v[d].isNull() for v in (a, b) for d in ("lat", "lng")])
        return unknown | ((F.least(a["lng"], b["lng"]) <= x1) & (F.greatest(a["lng"], b["lng"]) >= x0) & (F.greatest(a["lat"], b["lat"]) >= y0))

    facts = lambda e: F.struct(*[v.alias(k) for k, v in edge_facts(e["a"], e["b"]).items()])
    return F.transform(F.filter(_edges(polygon), may), facts)


def _odd(lat: Column, lng: Column, edges: Column, most: int) -> Column:
    """The crossing-number test on at most ``most`` edges, without a fold where they are few."""
    crosses = lambda e: edge_crosses(lat, lng, e).cast("int")
    if most > UNROLLED:
        return F.aggregate(edges, F.lit(0), lambda acc, e: acc + crosses(e)) % 2 == 1
    return total([F.lit(0)] + [F.when(F.size(edges) > i, crosses(F.get(edges, F.lit(i)))).otherwise(0) for i in range(most)]) % 2 == 1


def in_zones(pts: DataFrame, lat: str, lng: str, zones: DataFrame, key: str, polygon: str, heavy: int = HEAVY) -> DataFrame:
    """Points with every zone they lie in.

    Zones are covered by cells of their own size, so a cover has at most 25 cells to
    start with, and only touched cells with more than ``heavy`` points are split (in 16,
    of which those without points go).  Rays are cast only for points in touched cells,
    at the edges that concern the cell, and as one written-out formula where those are few.
    A cell's points meet its zones in parts of ``PART_POINTS`` at most, dealt to all tasks."""
    spark = pts.sparkSession
    ensure_checkpoint_dir(spark)
    k = many(spark)  # zones and covers are small beside the work on them
    scale = F.pow(F.lit(2.0), C("level"))
    # flat cells: like the polygons, longitudes do not wrap
    placed = pts.where(C(lat).isNotNull() & C(lng).isNotNull())
    celled = {"cy": F.floor((C(lat) + 90.0) * scale), "cx": F.floor((C(lng) + 180.0) * scale)}
    at = ["level", "cy", "cx"]
    # a zone is a few bytes of input but many cells of polygons, so the plan takes covers for
    # small tables: they are dealt to all tasks here and never broadcast (the merge hints)
    dealt = zones.select(key, C(polygon).alias("_p")).repartition(k, "_p")
    open_, covers, parts = cover_start(dealt, key, "_p"), None, None
    while True:
        judged = cover_judge(open_).checkpoint()
        levels = judged.agg(F.collect_set("level").alias("l")).scalar()  # at most the cover levels
        counts = placed.select(lat, lng, F.explode(levels).alias("level")).withColumns(celled).groupBy(*at).agg(F.count("*").alias("_n"))
        held = judged.hint("merge").join(counts, at).checkpoint()
        split = C("_crossed") & (C("_n") > heavy) & (C("level") < COVER_LEVELS[-1])
        # touched cells keep their edges: points meet them where they meet the cell
        done = held.where(~split).select(key, *at, F.when(C("_crossed"), C("_p")).alias("_p"), F.ceil(C("_n") / PART_POINTS).alias("_parts"))
        covers = done if covers is None else covers.unionByName(done)
        more = held.where(split)
        if more.isEmpty():
            break
        quarter = F.sequence(F.lit(0), F.lit(3))
        open_ = more.withColumn("_i", F.explode(quarter)).withColumn("_j", F.explode(quarter)).select(
            key, "_p", (C("level") + 2).cast("int").alias("level"), (C("cy") * 4 + C("_i")).alias("cy"), (C("cx") * 4 + C("_j")).alias("cx")).repartition(k)
    box = _ends(C("_p"))
    covers = covers.repartition(k).withColumns({**box, "_e": _concerning(C("_p"), side(C("level")))}).drop("_p").checkpoint()
    most = F.max(F.size("_e"))
    levels, most = covers.agg(F.collect_set("level").alias("l")).scalar(), covers.agg(most.alias("m")).first()["m"]
    parts = covers.groupBy(*at).agg(F.max("_parts").alias("_parts")).checkpoint()
    spots = placed.withColumn("level", F.explode(levels)).withColumns(celled).join(parts, at)
    spread = [C(f"`{c}`") for c in dict.fromkeys((lat, lng, pts.columns[0]))]  # not all columns, so that unused ones are not read
    spots = spots.withColumn("_part", F.pmod(F.xxhash64(*spread), C("_parts"))).drop("_parts").repartition(k, *at, "_part")

    def meet(part: DataFrame) -> DataFrame:
        one = part.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), C("_parts") - 1))).drop("_parts").repartition(k, *at, "_part")
        return one.join(spots.hint("merge"), [*at, "_part"]).select(*[C(f"`{c}`") for c in pts.columns], *[c for c in part.columns if c not in (*at, "_parts")])

    # rays are cast only within the polygon's box, widened by more than the rounding of a crossing
    near = reduce(lambda x, y: x & y, [(C(c) >= C(f"_lo_{d}") - 1e-9) & (C(c) <= C(f"_hi_{d}") + 1e-9) for c, d in ((lat, "lat"), (lng, "lng"))])

    def hits(part: DataFrame) -> DataFrame:
        # a fold would keep its whole join out of compiled code, so few edges and many are met apart
        few = (part.where(C("_e").isNull() | (F.size("_e") <= UNROLLED)), min(most or 0, UNROLLED))
        out = [meet(x).where(C("_e").isNull() | (C(key).isNotNull() & near & _odd(C(lat), C(lng), C("_e"), n))) for x, n in
               [few, *([(part.where(F.size("_e") > UNROLLED), most)] if (most or 0) > UNROLLED else [])]]
        return reduce(DataFrame.unionByName, out).drop("_e", *box)

    repeated = zones.where(C(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_k")).where("_k > 1").select(key).checkpoint()
    if repeated.isEmpty():
        return hits(covers)
    # where a key has several zones, each of them is asked in every touched cell of any
    out = hits(covers.join(repeated, key, "left_anti"))
    met = meet(covers.join(repeated, key, "left_semi"))
    cast = met.where("_e IS NOT NULL").drop("_e", *box).join(dealt.hint("merge"), key).where(polygon_contains(C(lat), C(lng), C("_p"))).drop("_p")
    return out.unionByName(met.where("_e IS NULL").drop("_e", *box)).unionByName(cast.select(*out.columns))


def near_zones(pts: DataFrame, key: str, lat: str, lng: str, zones: DataFrame, polygon: str, meters: float, min_keep: int) -> DataFrame:
    """Points inside any zone or within a margin of a vertex; every point when fewer
    than ``min_keep`` qualify."""
    z = zones.select(C(polygon).alias("_poly"), F.xxhash64(polygon).alias("_zone")).distinct()
    inside = in_zones(pts.select(key, lat, lng), lat, lng, z, "_zone", "_poly").select(key)
    vertices = z.select(F.explode("_poly").alias("v")).select(C("v.lat").alias("_vlat"), C("v.lng").alias("_vlng")).where("_vlat IS NOT NULL AND _vlng IS NOT NULL").distinct()
    miles = max(meters, 1.0) / 1609.344
    level = min(20, math.floor(math.log2(MILES_PER_DEGREE / miles)))
    ys, xs = _box(C("_vlat"), C("_vlng"), F.lit(miles * 1.001), level)
    spread = vertices.withColumn("cy", F.explode(ys)).withColumn("cx", F.explode(xs))
    cy, cx = grid(C(lat), C(lng), level)
    near = pts.where(C(lat).isNotNull() & C(lng).isNotNull()).select(key, lat, lng).withColumns({"cy": cy, "cx": cx}).join(spread, ["cy", "cx"])
    near = near.where(haversine_meters(C(lat), C(lng), C("_vlat"), C("_vlng")) <= meters).select(key)
    met = inside.unionByName(near).distinct()
    kept = met.agg(F.count("*").alias("k")).scalar()
    marked = pts.join(met.withColumn("_hit", F.lit(True)), key, "left")
    return marked.where(C("_hit") | (kept < min_keep)).drop("_hit")
