"""Enrolment trends and course performance against local and overall averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from demandgrid.functions.exprs import clamp, n, pick, ratio, rnd
from demandgrid.operators.classes import fill_pct, mean_students
from demandgrid.operators.ranks import fit

C = F.col
MIN_POINTS = 3
FLAT_SLOPE = 0.01


def monthly_points(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(C("month").isNotNull() & C("enrolled").isNotNull()).groupBy(*keys, "month").agg(
        mean_students().alias("y"), F.count("*").alias("class_count"))


def month_index(points: DataFrame, keys: list[str]) -> DataFrame:
    """Calendar months since the group's first one (gaps count)."""
    idx = F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")
    p = points.withColumn("_i", idx)
    return p.withColumn("x", (C("_i") - F.min("_i").over(W.partitionBy(*keys))).cast("double")).drop("_i")


def direction(slope: Column, points: Column) -> Column:
    return pick(((points < MIN_POINTS) | slope.isNull(), "insufficient data"), (slope > FLAT_SLOPE, "improving"),
                (slope < -FLAT_SLOPE, "declining"), default="flat")


def enrollment_trend(df: DataFrame, keys: list[str]) -> DataFrame:
    """Line through monthly means; groups with fewer than three months use their
    dated classes instead.

    Monthly points are already few per group; the class-level fallback applies
    only to groups with at most two months and is aggregated by day, weighted by
    the number of equal classes."""
    months = month_index(monthly_points(df, keys), keys)
    few = months.groupBy(*keys).agg(F.count("*").alias("months"))
    dated = df.where(C("class_date").isNotNull() & C("enrolled").isNotNull())
    short = dated.join(few.where(C("months") < MIN_POINTS).select(*keys), keys, "left_semi")
    daily = short.groupBy(*keys, "class_date", "enrolled").agg(F.count("*").alias("w"))
    first = daily.groupBy(*keys).agg(F.min("class_date").alias("d0"))
    daily = daily.join(first, keys).select(
        *keys, F.datediff("class_date", "d0").cast("double").alias("x"), C("enrolled").cast("double").alias("y"), "w")
    basis = "individual_class_records"
    by_class = fit(daily, "x", "y", keys, "w").withColumn("basis", F.lit(basis))
    by_month = fit(months, "x", "y", keys).withColumn("basis", F.lit("monthly_average_enrollment"))
    both = by_month.unionByName(by_class)
    # the fallback wins only where it has more points
    best = both.groupBy(*keys).agg(F.max_by(F.struct("basis", "n", "slope", "intercept", "r_squared", "pearson"),
                                            F.struct(F.when(C("basis") == basis, C("n")).otherwise(F.lit(0)) > 2, C("n"),
                                                     C("basis") != basis)).alias("f"))
    sized = best.select(*keys, "f.*")
    totals = df.groupBy(*keys).agg(F.count("enrolled").alias("total_classes"), mean_students().alias("average_students"))
    ok = C("n") >= MIN_POINTS
    out = sized.join(totals, keys)
    out = out.withColumn("slope", F.when(ok, rnd(C("slope"), 4)))
    return out.select(
        *keys, "basis", "n", "total_classes", "average_students", "slope",
        F.when(ok & C("slope").isNotNull(), rnd(C("intercept"), 4)).alias("intercept"), F.when(ok, rnd(C("r_squared"), 4)).alias("r_squared"),
        F.when(ok, rnd(C("pearson"), 4)).alias("pearson"), direction(C("slope"), C("n")).alias("trend_direction"),
        pick((C("n") < MIN_POINTS, "Insufficient"), (C("n") < 6, "Low"), (C("n") < 12, "Medium"), default="High").alias("confidence"))


def course_performance(df: DataFrame, overall: Column) -> DataFrame:
    """Score of each course against the local mean, with band and strategy.

    The ranking window runs over course types: at most the fixed catalogue."""
    local = df.agg(mean_students().alias("a")).scalar()
    m = df.groupBy("course_type").agg(F.count("*").alias("total_classes"), mean_students().alias("average_students"),
                                      fill_pct().alias("fill"), F.sum("enrolled").alias("total_students"))
    m = m.withColumns({"_loc": local, "_ov": overall})
    enrol = clamp(ratio(50.0 * C("average_students"), F.nullif(C("_loc"), F.lit(0.0))))
    m = m.withColumn("score", rnd(F.coalesce(0.7 * enrol + 0.3 * clamp(C("fill")), enrol), 1))
    m = m.withColumns({
        "band": pick((C("score").isNull(), "Unknown"), (C("score") >= 65, "Strong"), (C("score") >= 45, "Average"), default="Weak"),
        "vs_local": rnd(C("average_students") - C("_loc"), 2), "vs_overall": rnd(C("average_students") - C("_ov"), 2),
        "eligible": (C("course_type") != "unknown_course_type") & C("score").isNotNull() & (C("total_classes") >= 2)})
    place = F.row_number().over(W.partitionBy("eligible").orderBy(C("score").desc(), "course_type"))
    lead = C("_p") == 1
    return m.withColumn("_p", place).withColumn("strategy", F.when(C("eligible"), pick(
        (lead, "primary"), (C("band") == "Weak", "avoid_or_test"), default="secondary"))).drop("_p", "_loc", "_ov")


def scheduling_signals(df: DataFrame) -> DataFrame:
    """Weekend or weekday lead of the course means, and low-fill course count."""
    part = lambda p: F.when(C("day_part") == p, C("enrolled"))
    per = df.groupBy("course_type").agg(
        rnd(ratio(F.sum(part("weekday")), F.count(part("weekday"))), 2).alias("wd"),
        rnd(ratio(F.sum(part("weekend")), F.count(part("weekend"))), 2).alias("we"), fill_pct().alias("f"), F.count("*").alias("k"))
    s = per.agg(F.avg("wd").alias("wd"), F.avg("we").alias("we"), n((C("f") < 50) & (C("k") >= 2)).alias("low_fill_courses"))
    return s.select(rnd(C("wd"), 4).alias("weekday_avg"), rnd(C("we"), 4).alias("weekend_avg"), (C("we") >= C("wd") * 1.15).alias("more_weekend"),
                    (~(C("we") >= C("wd") * 1.15) & (C("wd") >= C("we") * 1.15)).alias("more_weekday"), "low_fill_courses")


# fixed values: which course types and place categories speak for BLS or CPR
BLS_TYPES = ["aha_bls", "arc_bls", "house_bls"]
CPR_TYPES = ["aha_cpr", "arc_cpr", "house_cpr", "cpr_first_aid_blended"]
BLS_PLACES = ["hospital", "urgent_care", "ems", "fire_station", "nursing_school", "medical_school", "cna_training", "healthcare_training"]
CPR_PLACES = ["childcare_center", "gym", "community_college", "university", "senior_care"]


def public_vs_actual(df: DataFrame, places: DataFrame) -> DataFrame:
    """Lean of nearby demand sites against what classes actually enrol."""
    means = df.groupBy("course_type").agg(mean_students().alias("a"))
    actual = means.agg(rnd(F.avg(F.when(C("course_type").isin(BLS_TYPES), C("a"))), 2).alias("bls_actual"),
                       rnd(F.avg(F.when(C("course_type").isin(CPR_TYPES), C("a"))), 2).alias("cpr_actual"))
    sites = places.agg(n(C("category").isin(BLS_PLACES)).alias("b"), n(C("category").isin(CPR_PLACES)).alias("c"))
    return actual.withColumns({"bls_demand_sites": sites.select("b").scalar(), "cpr_demand_sites": sites.select("c").scalar()})
