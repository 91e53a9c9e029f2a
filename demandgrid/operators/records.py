"""Nested records to flat rows, provenance audits, ledgers and safe payloads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandgrid.functions.exprs import n, pick, ratio, rnd
from demandgrid.functions.places import source_family, source_quality

C = F.col

PLACE_JSON = """struct<id:string,place_id:string,name:string,displayName:struct<text:string>,location:struct<latitude:double,longitude:double>,
geometry:struct<location:struct<lat:double,lng:double>>,rating:double,userRatingCount:bigint,user_ratings_total:bigint,types:array<string>>"""


def places_from_json(df: DataFrame, col: str) -> DataFrame:
    """Stored place JSON of either API generation to one flat row."""
    r = F.from_json(C(col), PLACE_JSON)
    return df.withColumn("_r", r).select(
        *[c for c in df.columns if c != col], F.coalesce("_r.id", "_r.place_id").alias("place_id"), F.coalesce("_r.displayName.text", "_r.name").alias("name"),
        F.coalesce("_r.location.latitude", "_r.geometry.location.lat").alias("lat"), F.coalesce("_r.location.longitude", "_r.geometry.location.lng").alias("lng"), C("_r.rating").alias("rating"),
        F.coalesce("_r.userRatingCount", "_r.user_ratings_total").alias("review_count"), C("_r.types").alias("types"))


BUSINESS_JSON = "struct<id:string,name:string,rating:double,review_count:bigint,coordinates:struct<latitude:double,longitude:double>,categories:array<struct<title:string>>>"


def business_from_json(df: DataFrame, col: str) -> DataFrame:
    r = F.from_json(C(col), BUSINESS_JSON)
    titles = F.array_compact(F.transform("_r.categories", lambda c: c["title"]))
    return df.withColumn("_r", r).select(C("_r.id").alias("business_id"), F.coalesce("_r.name", F.lit("")).alias("name"), C("_r.rating").alias("rating"), C("_r.review_count").alias("review_count"),
                                         C("_r.coordinates.latitude").alias("lat"), C("_r.coordinates.longitude").alias("lng"), F.array_join(titles, ",").alias("categories"))


CENTER_JSON = "struct<name:string,phone:string,email:string,websiteUrl:string,distance:double,organisationProfile:struct<address1:string,city:string,state:string,postalCode:string>>"


def centers_from_json(df: DataFrame, col: str, placeholder: str) -> DataFrame:
    """Training-centre records: metres to miles, placeholder phone to blank."""
    r, p = F.from_json(C(col), CENTER_JSON), "_r.organisationProfile"
    phone = F.trim(F.coalesce("_r.phone", F.lit("")))
    words = lambda *cs: F.array_join(F.filter(F.array(*[F.coalesce(C(c), F.lit("")) for c in cs]), lambda x: x != ""), ", ")
    return df.withColumn("_r", r).select(
        *[c for c in df.columns if c != col], F.trim(F.coalesce("_r.name", F.lit(""))).alias("name"), F.when(F.regexp_replace(phone, "[- ]", "") == placeholder, "").otherwise(phone).alias("phone"),
        F.trim(F.coalesce("_r.email", F.lit(""))).alias("email"), F.trim(F.coalesce("_r.websiteUrl", F.lit(""))).alias("website"), rnd(C("_r.distance") * 0.000621371, 1).alias("distance_miles"),
        words(f"{p}.address1", f"{p}.city", f"{p}.state", f"{p}.postalCode").alias("full_address"))


def recruiting_leads(centers: DataFrame, miles: float) -> DataFrame:
    """No own website, no .org/.gov mail, some contact, within reach."""
    mail = F.lower("email")
    return centers.where((C("website") == "") & ~(mail.endswith(".org") | mail.endswith(".gov")) & ((mail != "") | (C("phone") != "")) & F.coalesce(C("distance_miles") <= miles, F.lit(True)))


def audit(sources: DataFrame) -> DataFrame:
    """Provenance per source family: records, distinct fields, quality, newest date.

    ``sources``: name, url, fields (array), collected_at."""
    rows = sources.select(source_family(C("name")).alias("family"), source_quality(C("name"), C("url")).alias("q"), "fields", "collected_at")
    known = F.when(C("q") != "unknown", C("q"))
    main = rows.groupBy("family").agg(F.count("*").alias("records"), F.min(known).alias("_lo"), F.max(known).alias("_hi"), F.max("collected_at").alias("data_as_of"))
    fields = rows.select("family", F.explode("fields").alias("f")).where(C("f") != "").groupBy("family").agg(F.countDistinct("f").alias("field_count"))
    quality = pick((C("_lo").isNull(), "unknown"), (C("_lo") == C("_hi"), C("_lo")), default="mixed")
    return main.join(fields, "family", "left").select("family", "records", F.coalesce("field_count", F.lit(0)).alias("field_count"), quality.alias("quality"), "data_as_of")


def census_indicators(df: DataFrame) -> DataFrame:
    """Shares with safe denominators from census counts."""
    safe = lambda a, b: F.when(C(b) > 0, ratio(C(a), C(b)))
    return df.withColumns({"healthcare_employment_share": safe("employed_health", "employed"), "bachelors_or_higher_share": safe("bachelors", "edu_total"),
                           "working_age_share": safe("working_age", "population"), "employment_rate": safe("employed", "working_age")})


def labor_quarters(df: DataFrame) -> DataFrame:
    """Newest quarter per area: weekly wage from totals, level as fallback.

    ``df``: area, year, quarter, total_wages, month1..month3, avg_weekly_wage."""
    jobs = (C("month1") + C("month2") + C("month3")) / 3.0
    wage = F.coalesce(C("avg_weekly_wage"), F.try_divide(F.try_divide(C("total_wages"), jobs), F.lit(13.0)))
    x = df.select("area", "year", "quarter", jobs.alias("employment"), wage.alias("weekly_wage"))
    return x.groupBy("area").agg(F.max_by(F.struct("year", "quarter", "employment", "weekly_wage"), C("year") * 10 + C("quarter")).alias("r")).select("area", "r.*")


SECRET_KEY = re.compile(
    r"access[_ ]?code|door[_ ]?code|lock[_ ]?box|lockbox|alarm[_ ]?code|gate[_ ]?code|key[_ ]?pad|keypad|wifi[_ ]?pass|wi[-_ ]?fi[_ ]?pass|password|passcode|"
    r"pin[_ ]?code|secret|api[_ ]?key|apikey|access[_ ]?token|auth[_ ]?token|authorization|bearer|token", re.IGNORECASE)


def scrubbed(df: DataFrame) -> DataFrame:
    """Drop staff-only fields at any depth of the schema (structs, arrays of structs)."""
    def clean(col: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            parts = [clean(col.getField(f.name), f.dataType).alias(f.name) for f in kind.fields if not SECRET_KEY.search(f.name)]
            return F.when(col.isNotNull(), F.struct(*parts)) if parts else F.lit(None)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            return F.transform(col, lambda x: clean(x, kind.elementType))
        return col

    return df.select(*[clean(C(f.name), f.dataType).alias(f.name) for f in df.schema.fields if not SECRET_KEY.search(f.name)])


def lite(df: DataFrame) -> DataFrame:
    """The narrow dashboard projection, numbers cut to six digits."""
    six = lambda c: F.round(C(c), 6)
    return df.select("zip", six("lat").alias("lat"), six("lng").alias("lon"), six("overall").alias("overall_score"), six("bls_demand").alias("aha_bls"), six("bls_demand").alias("arc_bls"),
                     six("cpr_demand").alias("arc_cpr"), "tier", "data_confidence", six("validation_score").alias("validation_score"), "validation_tier")


def candidate_id(state: Column, city: Column, index: Column, lat: Column, lng: Column) -> Column:
    """state-city-index plus six hex digits of the rounded coordinates."""
    slug = F.lower(F.regexp_replace(F.trim(city), r"\s+", "-"))
    spot = F.substring(F.sha2(F.format_string("%.4f,%.4f", lat, lng), 256), 1, 6)
    return F.concat_ws("-", F.lower(state), slug, F.lpad(index.cast("string"), 3, "0"), spot)


def request_key(provider: Column, method: Column, params: Column) -> Column:
    """Identity of a request: hash of its canonical JSON."""
    return F.sha2(F.to_json(F.struct(method.alias("method"), params.alias("params"), provider.alias("provider"))), 256)


def job_key(city: Column, state: Column, zip_: Column) -> Column:
    c, s = F.lower(F.trim(F.coalesce(city, F.lit("")))), F.lower(F.trim(F.coalesce(state, F.lit(""))))
    return F.when((c != "") | (s != ""), F.concat_ws("|", c, s)).otherwise(F.concat_ws("|", F.lit("zip"), F.lpad(F.coalesce(zip_, F.lit("")), 5, "0")))
