"""Output layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandgrid.functions.places import clean_url
from demandgrid.operators.records import lite, scrubbed
from demandgrid.session import many

C = F.col


def write_detail(df: DataFrame, path: str) -> None:
    """One row per ZIP for keyed reads: folders by ZIP prefix, sorted inside, so a
    lookup prunes to one folder and then to few row groups."""
    out = df.withColumn("zip3", F.substring("zip", 1, 3))
    out.repartitionByRange("zip3", "zip").sortWithinPartitions("zip3", "zip").write.mode("overwrite").partitionBy("zip3").parquet(path)


def read_detail(spark: SparkSession, path: str, zip_: str) -> DataFrame:
    return spark.read.parquet(path).where((C("zip3") == zip_[:3]) & (C("zip") == zip_)).drop("zip3")


def write_zip_files(df: DataFrame, path: str) -> None:
    """One folder per ZIP; only for small key sets, else use write_detail.

    The cost is the files, not the bytes, so the ZIPs are dealt to all tasks whatever
    their size, and every task moves its own files into place."""
    rows = scrubbed(df)
    out = rows.repartition(many(rows.sparkSession), "zip").write.mode("overwrite").partitionBy("zip")
    out.option("compression", "gzip").option("mapreduce.fileoutputcommitter.algorithm.version", "2").json(path)


def write_lite(df: DataFrame, path: str) -> None:
    lite(df).write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", True).json(path)


def write_candidates(df: DataFrame, path: str) -> None:
    """Flat candidate CSV; unknown values are written as the word."""
    flat = df.select(*[F.coalesce(C(c).cast("string"), F.lit("unknown")).alias(c) for c in df.columns])
    flat.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_payload(df: DataFrame, path: str, url_columns: list[str]) -> None:
    """JSON payload without staff-only fields and without secrets in URLs."""
    scrubbed(df.withColumns({c: clean_url(C(c)) for c in url_columns})).write.mode("overwrite").json(path)


def write_centroids(df: DataFrame, path: str) -> None:
    df.repartitionByRange("zip").sortWithinPartitions("zip").write.mode("overwrite").option("header", True).csv(path)
