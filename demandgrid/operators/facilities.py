"""Public facility, provider and institution files counted per ZIP."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.exprs import lookup, n, pick, rnd
from demandgrid.operators.geo import nearest

C = F.col


def facilities_per_zip(fac: DataFrame, centroids: DataFrame) -> DataFrame:
    """Counts per ZIP (own ZIP, else nearest centroid) and distance to a hospital.

    ``fac``: category, zip, lat, lng, facility_id."""
    z = centroids.select("zip", C("lat").alias("zlat"), C("lng").alias("zlng"))
    need = fac.where(C("zip").isNull() & C("lat").isNotNull()).groupBy("lat", "lng", "category").agg(F.count("*").alias("k"))
    found = need.join(nearest(need, "lat", "lng", z, "zip", "zlat", "zlng", 25.0), ["lat", "lng"]).select("zip", "category", "k")
    own = fac.where(C("zip").isNotNull()).groupBy("zip", "category").agg(F.count("*").alias("k"))
    both = own.unionByName(found)
    cat = lambda *names: F.coalesce(F.sum(F.when(C("category").isin(*names), C("k"))), F.lit(0))
    counts = both.groupBy("zip").agg(
        cat("hospital").alias("hospital_count"), cat("urgent_care").alias("urgent_care_count"), cat("ems", "fire").alias("ems_fire_count"),
        cat("hospital", "urgent_care").alias("healthcare_facility_count"))
    hosp = fac.where((C("category") == "hospital") & C("lat").isNotNull()).select("facility_id", C("lat").alias("hlat"), C("lng").alias("hlng"))
    near = nearest(centroids, "lat", "lng", hosp, "facility_id", "hlat", "hlng", 100.0)
    miles = centroids.join(near, ["lat", "lng"]).select("zip", rnd(C("distance"), 1).alias("nearest_hospital_miles"))
    return counts.join(miles, "zip", "left").withColumn("healthcare_facility_density", C("healthcare_facility_count").cast("double"))


# fixed values: taxonomy code prefixes
NURSE_CODES = ["163", "164", "367", "364", "366"]
PHYSICIAN_CODES = ["20"]


def provider_kind(code: Column) -> Column:
    c = F.upper(F.trim(code))
    nurse = F.coalesce(F.substring(c, 1, 3).isin(NURSE_CODES), F.lit(False))
    return F.when(nurse, "nurse").when(F.coalesce(F.substring(c, 1, 2).isin(PHYSICIAN_CODES), F.lit(False)), "physician").otherwise("other")


def providers_per_zip(df: DataFrame, zip_: Column, taxonomy: Column, entity: Column) -> DataFrame:
    """One map-side-combined pass over the provider file; rows without a
    five-digit ZIP drop out."""
    z = F.substring(F.trim(zip_), 1, 5)
    rows = df.select(z.alias("zip"), provider_kind(taxonomy).alias("kind"), (F.trim(entity) == "2").alias("org"))
    return rows.where(C("zip").rlike(r"^\d{5}$")).groupBy("zip").agg(
        F.count("*").alias("healthcare_provider_count"), n(C("kind") == "nurse").alias("nurse_count"),
        n(C("kind") == "physician").alias("physician_count"), n(C("org")).alias("clinic_provider_count"))


# fixed values: words in institution names
NURSING_WORDS = ["nursing", "nurse"]
HEALTH_WORDS = [
    "nursing", "nurse", "health", "medical", "dental", "pharmacy", "therapy", "paramedic", "emt", "allied health",
    "respiratory", "radiolog", "surgical tech",
]


def institutions_per_zip(df: DataFrame, nursing: list[str] = NURSING_WORDS, health: list[str] = HEALTH_WORDS) -> DataFrame:
    """``df``: zip, name, enrollment."""
    name = F.lower(F.coalesce(C("name"), F.lit("")))
    return df.where(C("zip").isNotNull()).groupBy("zip").agg(
        F.count("*").alias("college_count"), n(name.rlike("|".join(nursing))).alias("nursing_school_count"),
        n(name.rlike("|".join(health))).alias("health_program_school_count"),
        F.coalesce(F.sum(C("enrollment").cast("bigint")), F.lit(0)).alias("student_enrollment_count"))


# fixed values: map tags per kind
CHILDCARE_TAGS = ["childcare", "kindergarten"]
SCHOOL_TAGS = ["school", "college", "university"]
COMMUNITY_TAGS = ["library", "community_centre", "community_center", "place_of_worship", "social_facility", "townhall"]


def map_kind(amenity: Column, shop: Column) -> Column:
    a = F.lower(F.coalesce(amenity, F.lit("")))
    return pick((a.isin(CHILDCARE_TAGS), "childcare"), (a.isin(SCHOOL_TAGS), "school"), (a.isin(COMMUNITY_TAGS), "community"),
                (a == "parking", "parking"), ((F.coalesce(shop, F.lit("")) != "") | (a == "marketplace"), "commercial"))


def map_elements_per_zip(counted: DataFrame) -> DataFrame:
    """``counted``: zip, kind, points -> facility counts and capped proxies."""
    k = lambda *names: F.coalesce(F.sum(F.when(C("kind").isin(*names), C("points"))), F.lit(0))
    capped = lambda c, cap: rnd(100.0 * F.least(F.lit(1.0), c / float(cap)), 1)
    return counted.groupBy("zip").agg(
        k("childcare").alias("childcare_count"), k("school").alias("school_count"),
        k("childcare", "school", "community").alias("community_facility_count"),
        capped(k("parking"), 10).alias("parking_proxy_score"), capped(k("commercial"), 30).alias("commercial_access_proxy_score"))


def merge_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Datasets keyed by ZIP as one: all ZIPs, later sources overwrite the same
    field, and each row names the sources it came from."""
    out = None
    for name, df in sources.items():
        mine = df.select("zip", F.lit(name).alias("_s"), *[C(c).alias(f"_n_{c}") for c in df.columns if c != "zip"])
        if out is None:
            out = df.select("zip", F.array(F.lit(name)).alias("sources"), *[c for c in df.columns if c != "zip"])
            continue
        j = out.join(mine, "zip", "full_outer")
        none = F.array().cast("array<string>")
        cols = {"sources": F.concat(F.coalesce("sources", none), F.when(C("_s").isNotNull(), F.array("_s")).otherwise(none))}
        for c in df.columns:
            if c != "zip":
                cols[c] = F.coalesce(C(f"_n_{c}"), C(c)) if c in out.columns else C(f"_n_{c}")
        out = j.withColumns(cols).drop("_s", *[c for c in j.columns if c.startswith("_n_")])
    return out
