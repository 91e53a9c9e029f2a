"""A base and increments folded into sums equal one pass over all classes."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from demandgrid.operators import classes as CL
from demandgrid.operators import refresh as RF
from demandgrid.operators import trends as TR
from demandgrid.operators import zip_demand as Z

SCHEMA = "zip string, city string, course_type string, bucket string, class_date date, month string, enrolled int, capacity int, cancelled boolean"


def class_rows(seed, size):
    draw = random.Random(seed)
    for _ in range(size):
        day = draw.choice([None, date(2024, 1, 1) + timedelta(days=draw.randint(0, 300))])
        bucket = draw.choice(["ARC_CPR", "ARC_BLS", "AHA_BLS", "OTHER"])
        yield (draw.choice(["00001", "00002", None]), draw.choice(["Reno", " reno ", "Elko", "", None]), bucket.lower(), bucket, day, day and day.strftime("%Y-%m"),
               draw.choice([None, 0, 3, 7, 11]), draw.choice([None, 0, 10, 12]), draw.choice([None, False, False, True]))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_base_and_increments_equal_one_pass(spark, tmp_path):
    parts = [spark.createDataFrame(list(class_rows(seed, 60)), SCHEMA) for seed in range(3)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    folder = str(tmp_path / "sums")
    # the last increment comes before the others and once more at the end
    for k in (2, 0, 1, 2):
        RF.fold(parts[k], folder, f"b{k}")
    sums = RF.state(spark, folder)
    for cutoff in ("2024-05", "2024-12"):
        held, partly = CL.held(whole, cutoff), RF.held(sums, cutoff)
        assert rows_of(RF.profiles(partly)) == rows_of(Z.zip_profiles(held))
        points = RF.monthly_points(partly, ["course_type"])
        assert rows_of(points) == rows_of(TR.monthly_points(held, ["course_type"]).select(*points.columns))
        _, ref, latest = Z.profiles_and_anchors(whole, CL.is_held(cutoff))
        one = spark.range(1).select(ref, latest).first()
        assert tuple(spark.range(1).select(*RF.anchors(sums, cutoff)).first()) == tuple(one)


def test_empty_increment(spark, tmp_path):
    folder = str(tmp_path / "sums")
    rows = spark.createDataFrame(list(class_rows(9, 20)), SCHEMA)
    RF.fold(rows, folder, "a")
    before = rows_of(RF.state(spark, folder))
    RF.fold(rows.where(F.lit(False)), folder, "b")
    assert rows_of(RF.state(spark, folder)) == before
