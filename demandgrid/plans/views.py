"""Domain tables derived from the star schema, as DataFrames.

Each function selects only the columns its consumers can use, so Catalyst
prunes the parquet scans; joins carry no hints, so AQE sizes them at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandgrid.operators.classes import typed_classes

C = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _zip(key: str) -> Column:
    return F.lpad(C(key).cast("string"), 5, "0")


def _per(num: Column, den: int) -> Column:
    return num.cast("double") / F.lit(float(den))


# class titles by part number modulo 8
TITLES = [
    "AHA BLS Provider", "Red Cross Basic Life Support", "Red Cross First Aid/CPR/AED", "AHA Heartsaver CPR",
    "ACLS Provider", "Red Cross BLS Skills Session", "Adult First Aid/CPR/AED Blended", "Group Training",
]


def class_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class rows.  What a row needs of its line is worked out before the joins, as small
    numbers: they are all that the join with the orders has to shuffle.  The supplier gives
    its nation's number only, so that side stays narrow, and names come last."""
    k = C("l_suppkey")
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey",
        (C("l_partkey") % 8 + 1).cast("int").alias("_title"),
        C("l_shipdate").cast("date").alias("class_date"),
        F.when(C("l_returnflag") == "R", 0).when(C("l_linenumber") != 5, C("l_quantity").cast("int")).alias("enrolled"),
        F.when(C("l_linenumber") == 3, 0).when(C("l_linenumber") != 4, 40).alias("capacity"),
        (C("l_partkey") % 90 + 40).cast("double").alias("price"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    place = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), C("n_regionkey") == C("r_regionkey"))
        .select("n_nationkey", "n_name", "r_name")
    )
    return (
        line.join(supplier, k == C("s_suppkey"))
        .join(orders, C("l_orderkey") == C("o_orderkey"))
        .join(place, C("s_nationkey") == C("n_nationkey"))
        .select(
            (C("l_orderkey") * 10 + C("l_linenumber")).alias("class_id"),
            F.element_at(F.array(*[F.lit(t) for t in TITLES]), C("_title")).alias("class_name"),
            "class_date", "enrolled", "capacity", "price",
            F.when(C("o_orderstatus") == "F", "Completed").when(C("o_orderstatus") == "O", "Scheduled")
            .otherwise("Cancelled").alias("status"),
            C("n_name").alias("city"),
            C("r_name").alias("state"),
            F.when(k % 11 != 0, _zip("l_suppkey")).alias("zip"),
        )
    )


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed class records (course type, bucket, month, day part, cancelled)."""
    return typed_classes(class_table(spark, sf_dir))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        _zip("s_suppkey").alias("zip"),
        _per(37000 + k * 7919 % 600, 1000).alias("lat"),
        _per(-122300 + k * 104729 % 600, 1000).alias("lng"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("point_id"), C("c_name").alias("name"), C("c_mktsegment").alias("category"),
        C("c_acctbal").alias("score"),
        F.when(k % 97 != 0, _per(370000 + k * 3571 % 6500, 10000)).alias("lat"),
        _per(-1223000 + k * 7457 % 6500, 10000).alias("lng"),
    )


def zip_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        _zip("s_suppkey").alias("zip"),
        F.when(k % 13 != 0, (500 + k * 977 % 60000).cast("double")).alias("population"),
        F.when(k % 17 == 0, 0.0).otherwise((1 + k % 29).cast("double")).alias("land_sqmi"),
        F.when(k % 7 != 0, (40000 + k * 1543 % 120000).cast("double")).alias("median_household_income"),
        _per(55 + k % 26, 100).alias("working_age_share"),
        _per(50 + k * 3 % 26, 100).alias("employment_rate"),
        F.when(k % 5 != 0, _per(5 + k % 21, 100)).alias("healthcare_employment_share"),
        F.when(k % 4 != 0, (k % 26).cast("double")).alias("competitor_count"),
    )


POI_KINDS = ["hospital", "urgent care", "nursing school", "CPR training", "parking garage", "shopping plaza"]


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("p_partkey")
    kind = F.element_at(F.array(*[F.lit(t) for t in POI_KINDS]), (C("p_size") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        k.alias("place_id"), F.concat(C("p_name"), F.lit(" "), kind).alias("name"), kind.alias("kind"),
        F.when(k % 9 != 0, _per(30 + k % 21, 10)).alias("rating"),
        (k * 37 % 300).cast("int").alias("review_count"),
        _per(370000 + k * 2903 % 6000, 10000).alias("lat"),
        _per(-1223000 + k * 6121 % 6000, 10000).alias("lng"),
    )


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        C("event_id").alias("reg_id"),
        F.lpad((C("user_id") % 100).cast("string"), 5, "0").alias("home_zip"),
        (C("event_id") % 2003).alias("class_id"),
        C("event_type").alias("course"),
        F.concat(F.lit("Instructor "), (C("user_id") % 17).cast("string")).alias("instructor"),
        C("ts").cast("date").alias("reg_date"),
    )


# fixed values: what reviewers say, one phrase before each text (by doc_id), as the prose itself complains of nothing
PHRASES = [
    "Parking was hard to find.", "They canceled my appointment.", "The instructor was unprepared.", "Very crowded, took forever.", "No refund, they keep your money.",
    "The website did not load.", "Overpriced and not worth it.", "Nobody helped, the worst.", "My card never came, the certificate expired.", "Great class!",
]


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (C("doc_id") % len(PHRASES) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", said, "text").alias("text"))
    rated = table(spark, sf_dir, "labels")
    return docs.join(rated, "doc_id", "left").select(
        "doc_id", "text",
        F.when(C("toxic") == 1, 1).when(C("quality") == 1, 5).when(C("quality") == 0, 3).alias("rating"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", C("html").alias("text"))
