"""Entry strategies and decision rows of a candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.exprs import opt, pick, zero

C = F.col


def strategies(df: DataFrame) -> Column:
    """Top three of eight strategy keys by weight, 'partnership' when none fits.

    Reads the five-mile category counts (c_*), d_corridor, population,
    bachelors_or_higher_share, effective_saturation and competitors_5mi."""
    c = lambda k: F.coalesce(C(f"c_{k}"), F.lit(0))
    nursing = c("nursing_school") + c("cna_training") + c("emt_training") + c("healthcare_training") + c("medical_school")
    crews, pupils = c("fire_station") + c("ems"), c("university") + c("community_college")
    rivals = F.coalesce(opt(df, "competitors_5mi", "bigint"), F.lit(0))
    item = lambda cond, weight, key, order: F.when(cond, F.struct((-weight.cast("long")).alias("o"), F.lit(order).alias("n"), F.lit(key).alias("k")))
    full = (zero(opt(df, "effective_saturation")) >= 0.7) | (rivals >= 6)
    rows = F.array_compact(F.array(
        item((c("nursing_school") >= 1) | (nursing >= 2), 5 + nursing * 3, "nursing", 0), item(c("hospital") >= 1, 4 + c("hospital") * 2, "hospital", 1),
        item(crews >= 1, 3 + crews * 2, "ems-fire", 2), item(opt(df, "d_corridor") <= 1.0, F.lit(6), "airport", 3), item(c("childcare_center") >= 3, 2 + c("childcare_center"), "childcare", 4),
        item(pupils >= 2, 2 + pupils, "weekend", 5),
        item((opt(df, "population") >= 100000) & (opt(df, "bachelors_or_higher_share") < 0.30), F.lit(4), "multilingual", 6), item(full, 5 + F.least(rivals, F.lit(6)), "partnership", 7)))
    keys = F.slice(F.transform(F.array_sort(rows), lambda s: s["k"]), 1, 3)
    return F.when(F.size(rows) > 0, keys).otherwise(F.array(F.lit("partnership")))


def fits(keys: Column, wanted: list[str]) -> Column:
    """No wish list keeps everyone; otherwise any shared strategy."""
    return F.lit(True) if not wanted else F.arrays_overlap(keys, F.array(*[F.lit(w) for w in wanted]))


def launch_difficulty(saturation: Column, confidence: Column, gap: Column) -> Column:
    points = (saturation >= 0.8).cast("int") + (confidence < 40).cast("int") + (gap < 35).cast("int")
    return pick((points >= 2, "Hard"), (points == 1, "Medium"), default="Easy")
