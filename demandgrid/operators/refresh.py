"""Class history as mergeable sums, so that new class rows are folded in without a full scan.

The state holds one row per month, batch, ZIP, course type and outcome: counts, sums,
first and last day, town names.  A batch of new rows writes its own sums under the months
that it touches (dynamic partition overwrite), so folding the same batch again replaces
its rows instead of counting them twice, and rows may come late for any month.  Profiles,
anchors and monthly means add the sums up; the cutoff month is applied when reading and can
move without another scan.  Reading costs the number of sums, not of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandgrid.functions.exprs import ratio, rnd
from demandgrid.functions.text import BUCKETS, squeeze
from demandgrid.operators.classes import iso

C = F.col
UNDATED = "undated"
KEYS = ["month", "zip", "course_type", "bucket", "ran"]


def partials(classes: DataFrame) -> DataFrame:
    """Sums per month, ZIP, course type, channel and whether the class ran with students."""
    e, cap = C("enrolled"), C("capacity")
    paired = e.isNotNull() & (cap > 0)
    ran = F.coalesce((e > 0) & ~F.coalesce(C("cancelled"), F.lit(False)), F.lit(False))
    city = squeeze(C("city"))
    return classes.withColumns({"month": F.coalesce("month", F.lit(UNDATED)), "ran": ran}).groupBy(*KEYS).agg(
        F.count("*").alias("classes"), F.count(e).alias("known"), F.sum(e).cast("bigint").alias("students"), F.sum(F.when(cap > 0, cap)).cast("bigint").alias("capacity"),
        F.sum(F.when(paired, e)).cast("bigint").alias("paired_students"), F.sum(F.when(paired, cap)).cast("bigint").alias("paired_capacity"),
        F.min("class_date").alias("first_day"), F.max("class_date").alias("last_day"), F.collect_set(F.when(city != "", city)).alias("cities"))


def fold(classes: DataFrame, folder: str, batch: str) -> None:
    """Add a batch of class rows to the state; the same batch again takes its own place.

    A batch name stands for fixed rows: folding fewer months under it leaves the old ones."""
    rows = partials(classes).withColumn("batch", F.lit(batch))
    # one file per month and batch; sums are already few
    rows.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(folder)


def state(spark: SparkSession, folder: str) -> DataFrame:
    schema = ("zip string, course_type string, bucket string, ran boolean, classes bigint, known bigint, students bigint, capacity bigint, paired_students bigint, "
              "paired_capacity bigint, first_day date, last_day date, cities array<string>, month string, batch string")
    return spark.read.schema(schema).parquet(folder)


def held(rows: DataFrame, cutoff: str) -> DataFrame:
    """Sums of the classes that ran in a completed month (undated ones stay)."""
    return rows.where(C("ran") & ((C("month") == UNDATED) | (C("month") < cutoff)))


def profiles(rows: DataFrame) -> DataFrame:
    """The ZIP profiles of ``zip_demand.zip_profiles`` from sums."""
    share = lambda at: rnd(ratio(F.sum(F.when(at, C("paired_students"))) * 100.0, F.sum(F.when(at, C("paired_capacity")))), 1)
    every = F.lit(True)
    cols = [
        F.sum("classes").alias("total_classes"), F.sum("students").alias("total_students"), rnd(ratio(F.sum("students"), F.sum("classes")), 2).alias("average_students"),
        F.sum("capacity").alias("total_capacity"), share(every).alias("fill_rate"), iso(F.min("first_day")).alias("earliest_class_date"), iso(F.max("last_day")).alias("latest_class_date"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("cities")))).alias("cities")]
    for b in BUCKETS:
        at, k = C("bucket") == b, b.lower()
        cols += [F.coalesce(F.sum(F.when(at, C("known"))), F.lit(0)).alias(f"{k}_classes"), F.coalesce(F.sum(F.when(at, C("students"))), F.lit(0)).alias(f"{k}_students"),
                 F.sum(F.when(at, C("paired_capacity"))).alias(f"{k}_capacity"), share(at).alias(f"{k}_fill")]
    return rows.where(C("zip").isNotNull()).groupBy("zip").agg(*cols)


def anchors(rows: DataFrame, cutoff: str) -> tuple[Column, Column]:
    """Overall mean enrolment of the held classes and the newest date of all classes."""
    here = C("ran") & ((C("month") == UNDATED) | (C("month") < cutoff))
    ref = rnd(ratio(F.sum(F.when(here, C("students"))), F.sum(F.when(here, C("known")))), 2).alias("ref")
    one = rows.agg(F.struct(ref, F.date_format(F.max("last_day"), "yyyy-MM-dd").alias("latest"))).scalar()
    return one.getField("ref"), one.getField("latest")


def monthly_points(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean enrolment and classes per month, as ``trends.monthly_points`` gives them."""
    some = rows.where((C("month") != UNDATED) & (C("known") > 0))
    return some.groupBy(*keys, "month").agg(rnd(ratio(F.sum("students"), F.sum("known")), 2).alias("y"), F.sum("known").alias("class_count"))
