"""QA of a modelled layer: distributions, outliers, omissions, state summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.exprs import n, pick, rnd, zero
from demandgrid.operators.classes import top_per

C = F.col


def distribution(df: DataFrame, fields: list[str], keys: list[str] | None = None) -> DataFrame:
    """Count, range, mean, quantiles and threshold counts per score field.

    Scores carry one decimal between 0 and 100, so the exact percentile keeps at
    most a thousand distinct values per group; for unbounded fields use
    ranks.quantiles, which never holds a group in one task."""
    keys = keys or []
    rows = F.array(*[F.struct(F.lit(f).alias("field"), rnd(C(f), 1).alias("v")) for f in fields])
    long = df.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*").where(C("v").isNotNull())
    q = lambda p: rnd(F.percentile("v", p), 3)
    return long.groupBy(*keys, "field").agg(
        F.count("*").alias("count"), rnd(F.min("v"), 3).alias("min"), rnd(F.max("v"), 3).alias("max"), rnd(F.avg("v"), 3).alias("mean"), q(0.5).alias("median"),
        q(0.1).alias("p10"), q(0.25).alias("p25"), q(0.75).alias("p75"), q(0.9).alias("p90"), n(C("v") >= 70).alias("above_70"),
        n(C("v") >= 55).alias("above_55"), n(C("v") >= 40).alias("above_40"), n(C("v") < 40).alias("below_40"))


def outliers(df: DataFrame, limit: int = 50) -> DataFrame:
    """Six kinds of suspicious rows, at most fifty of each (lowest ZIPs first)."""
    o, p, d = zero(C("overall")), zero(C("population")), zero(C("population_density"))
    lacking = C("population").isNull() | C("population_density").isNull() | C("median_income").isNull() | C("healthcare_employment_share").isNull()
    kinds = F.array_compact(F.array(
        F.when((o >= 70) & (p < 5000), "high_score_low_population"), F.when((o >= 70) & (d < 300), "high_score_low_density"),
        F.when(C("lat").isNull() | C("lng").isNull(), "missing_coordinates"), F.when(lacking, "missing_acs_fields"),
        F.when((zero(C("median_income")) >= 150000) & ((p < 5000) | (d < 300)), "high_income_weak_population_density"),
        F.when((d >= 8000) & (o < 40), "high_density_weak_demand")))
    flat = df.select("zip", "overall", F.explode(kinds).alias("kind"))
    return top_per(flat, ["kind"], [C("zip")], limit, "position")


def omission_reason() -> Column:
    """Why a matched key never got a score."""
    signals = ["population", "population_density", "median_household_income", "working_age_share", "employment_rate", "healthcare_employment_share"]
    return pick((F.coalesce(*[C(s) for s in signals]).isNull(), "no_usable_scoring_signals"), (C("population").isNull(), "missing_population"),
                (C("population_density").isNull(), "missing_land_area_or_density"), default="other")


def omissions(matched: DataFrame, scored: DataFrame) -> DataFrame:
    return matched.join(scored.select("zip"), "zip", "left_anti").groupBy(omission_reason().alias("reason")).agg(F.count("*").alias("zips"))


def coverage(df: DataFrame) -> DataFrame:
    """Row counts of a QA report in one pass."""
    return df.agg(
        F.count("*").alias("total_modeled_rows"), n(C("lat").isNotNull() & C("lng").isNotNull()).alias("rows_with_lat_lng"), F.count("population").alias("rows_with_population"),
        n(C("land_sqmi") > 0).alias("rows_with_land_area"), F.count("overall").alias("rows_with_scores"), n(C("data_confidence") == "ok").alias("ok"),
        n(C("data_confidence") == "partial").alias("partial"), n(C("data_confidence") == "missing").alias("missing"))
