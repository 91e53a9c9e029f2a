"""Steps that must not grow faster than their tables: what they shuffle, and where it meets."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from demandgrid.functions.exprs import EARTH_MILES
from demandgrid.operators import geo as G
from demandgrid.operators import matching as M
from demandgrid.plans import q_zips, views
from demandgrid.sources import sinks
from tests.test_operators import cloud, hav

C = F.col


@pytest.fixture
def star(spark, tmp_path):
    """Lines of every kind, one without an order and one without a supplier, one order twice."""
    draw, tables = random.Random(3), {
        "region": ([(0, "WEST")], "r_regionkey int, r_name string"),
        "nation": ([(k, f"NATION_{k}", 0) for k in range(4)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(k, k % 4) for k in range(30)], "s_suppkey long, s_nationkey int"),
        "orders": ([(k, "FOP"[k % 3]) for k in [*range(60), 7]], "o_orderkey long, o_orderstatus string"),
    }
    lines = [(draw.randint(0, 59), draw.randint(0, 500), draw.randint(0, 29), draw.randint(1, 6), float(draw.randint(1, 50)), draw.choice("RAN"), draw.choice([None, datetime(2000, 1, 1) + timedelta(days=draw.randint(0, 500))])) for _ in range(300)]
    lines += [(99, 1, 1, 1, 1.0, "A", None), (1, 1, 99, 1, 1.0, "A", None)]
    tables["lineitem"] = (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate timestamp")
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path), lines


def test_class_rows_meet_orders_last_and_narrow(spark, star):
    sf, lines = star
    df = views.class_table(spark, sf)
    got = [tuple(r) for r in df.collect()]
    want = []
    for o, part, sup, num, qty, flag, day in lines:
        if o >= 60 or sup >= 30:
            continue
        row = (o * 10 + num, views.TITLES[part % 8], day and day.date(), 0 if flag == "R" else int(qty) if num != 5 else None, 0 if num == 3 else 40 if num != 4 else None,
               float(part % 90 + 40), {"F": "Completed", "O": "Scheduled", "P": "Cancelled"}["FOP"[o % 3]], f"NATION_{sup % 4}", "WEST", f"{sup:05d}" if sup % 11 else None)
        want += [row] * (2 if o == 7 else 1)
    assert sorted(got, key=str) == sorted(want, key=str)
    plan = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    level = {k: next(i for i, x in enumerate(plan) if k in x) for k in ("o_orderkey", "s_suppkey", "n_nationkey")}
    # names are joined last, the narrow supplier first
    assert level["n_nationkey"] < level["o_orderkey"] < level["s_suppkey"]


def test_refreshed_classes_are_joined_once(spark, star):
    from demandgrid.session import shared_dir

    before = set(os.listdir(shared_dir(spark)))
    sums = q_zips.folded(spark, star[0])
    new = {x for x in os.listdir(shared_dir(spark)) if x not in before}
    (rows,) = [x for x in new if x.endswith("-rows")]
    classes = views.classes(spark, star[0])
    assert spark.read.parquet(f"{shared_dir(spark)}/{rows}").count() == classes.count() == sums.agg(F.sum("classes")).first()[0]


def test_crowded_cells_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(G, "CELL_ROWS", 5)
    a, b = cloud(60, 5), cloud(90, 6)
    x, y = spark.createDataFrame(a, "i long, la double, lo double"), spark.createDataFrame(b, "j long, lb double, lc double")
    got = [(r.i, r.j) for r in G.within(x, y, ("la", "lo"), ("lb", "lc"), 7.0, 7.0).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, p, q in a for j, r, s in b if hav(p, q, r, s, EARTH_MILES) <= 7.0}


def test_nearest_within_the_sites_own_reach(spark):
    a, b = cloud(80, 7, 0.2) + [(500, None, 1.0), (501, 0.0, 0.0)], [(j, la, lo, 1.0 + j % 4) for j, la, lo in cloud(40, 8, 0.2)]
    x, y = spark.createDataFrame(a, "i long, la double, lo double"), spark.createDataFrame(b, "j long, lb double, lc double, r double")
    hit = G.nearest_reaching(x, "la", "lo", y, "j", "lb", "lc", "r", 4.0)
    got = {r.i: (r.j, r.distance) for r in x.join(hit, ["la", "lo"]).collect()}
    want = {}
    for i, p, q in a:
        near = [(d, j) for j, r, s, reach in b if p is not None and (d := hav(p, q, r, s, EARTH_MILES)) <= reach]
        if near:
            want[i] = min(near)
    assert got.keys() == want.keys() and all(got[i][0] == j and got[i][1] == pytest.approx(d) for i, (d, j) in want.items())


def test_groups_of_listings_are_short(spark, monkeypatch):
    kinds, within = [], M.within
    monkeypatch.setattr(M, "within", lambda l, r, *more: kinds.append((dict(l.dtypes)["l_g"], dict(r.dtypes)["r_g"])) or within(l, r, *more))
    rows = [(k, "old mill", 37.0, -122.0) for k in range(4)] + [(9, "new mill", 37.0, -122.0)]
    l = spark.createDataFrame(rows, "l_id long, l_name string, l_lat double, l_lng double")
    r = l.toDF("r_id", "r_name", "r_lat", "r_lng").withColumn("r_id", C("r_id") + 100)
    assert {(x.l_id, x.r_id) for x in M.first_match(l, r).collect()} == {(k, k + 100) for k in (0, 1, 2, 3, 9)}
    assert kinds == [("binary", "binary")]


@pytest.mark.parametrize("rows", [M.WALK_ROWS, 20] if hasattr(M, "WALK_ROWS") else [0])
def test_piles_that_overlap_are_walked_row_by_row(spark, monkeypatch, rows):
    """Chains of spots with many copies each: no pairs of copies, no round per copy; repeated ids and wide chains too."""
    opened, settled = [], getattr(M, "_settled", None)
    monkeypatch.setattr(M, "WALK_ROWS", rows)
    monkeypatch.setattr(M, "_settled", lambda o: opened.append(o.count()) or settled(o))
    draw = random.Random(6)
    left = [(k, 37 + (k * 7 % 5) * 0.004 + (k % 2), -122.0) for k in range(150)] + [(7, 37.0, -122.0), (11, 37.004, -122.0)]
    right = [(k, 37.002 + (k * 3 % 4) * 0.004 + draw.randint(0, 1), -122.0) for k in range(900, 1010)] + [(k, 38.002 - d, -122.0) for k in (905, 940) for d in (0, 1)]
    used, want = set(), []
    for i in sorted({i for i, *_ in left}):
        at = [p for p in left if p[0] == i]
        hit = next((j for j, *q in sorted(right) if j not in used and any(hav(p[1], p[2], *q) <= 0.3 for p in at)), None)
        if hit is not None:
            used.add(hit)
            want.append((i, hit))
    g = spark.createDataFrame(left, "row_id long, lat double, lng double")
    f = spark.createDataFrame(right, "filled_id long, lat double, lng double")
    got = [tuple(x) for x in M.replace_filled(g, f, 0.3).where("row_id IS NOT NULL AND filled_id IS NOT NULL").distinct().collect()]
    assert sorted(got) == want and bool(opened) == (rows == 20)


def test_zip_files_are_dealt_to_many_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k:05d}", float(k)) for k in range(40)], "zip string, population double")
    sinks.write_zip_files(rows, str(tmp_path / "zips"))
    folders = [d for d in os.listdir(tmp_path / "zips") if d.startswith("zip=")]
    tasks = {f.split("-")[1] for d in folders for f in os.listdir(tmp_path / "zips" / d) if f.startswith("part-")}
    assert len(folders) == 40 and len(tasks) > 4
