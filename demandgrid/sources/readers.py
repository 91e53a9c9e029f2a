"""File readers.  Every reader declares its schema (no inference pass), resolves
headers from column names only, and leaves rows distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandgrid.functions.exprs import blank_to_null
from demandgrid.functions.text import list_cell, low, money, parse_number, tri_bool, zip5
from demandgrid.operators.classes import attach_locations, class_records, location_dimension
from demandgrid.operators.facilities import map_kind
from demandgrid.sources.split_files import csv_records, json_elements

C = F.col
LAT_NAMES = ["latitude", "lat", "y"]
LNG_NAMES = ["longitude", "lon", "lng", "long", "x"]
ZIP_NAMES = ["zip", "zipcode", "zip_code", "postal", "postal_code"]


def _named(df: DataFrame, position: str | None) -> DataFrame:
    """Header names trimmed; ``position``: a column that orders rows as the files do
    (by file, split and row), which row numbers of tasks alone do not."""
    names = [c.replace("\ufeff", "").strip() for c in df.columns]
    if position is None:
        return df.toDF(*names)
    at = F.struct(C("_metadata.file_path").alias("file"), C("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return df.select(*[C(f"`{c}`").alias(n) for c, n in zip(df.columns, names)], at.alias(position))


def csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", position: str | None = None) -> DataFrame:
    """All columns as text, quoted line breaks allowed (one task a file), header trimmed."""
    df = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return _named(df, position)


def big_csv(spark: SparkSession, path: str, sep: str = ",", position: str | None = None) -> DataFrame:
    """Like csv(), but splittable: for large files whose rows are single lines."""
    df = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)
    return _named(df, position)


def quoted_csv(spark: SparkSession, path: str, sep: str = ",", position: str | None = None) -> DataFrame:
    """Like csv(), for large files: line breaks in cells are kept and a file is read by several tasks."""
    header = csv(spark, path, sep).columns
    schema = ", ".join("`" + c.replace("`", "``") + "` string" for c in header)
    rows = csv_records(spark, path, sep).where(C("_record") > 0)
    row = rows.select(F.from_csv("text", schema, {"sep": sep, "quote": '"', "escape": '"'}).alias("r"), "_pos")
    return row.select("r.*", *([] if position is None else [C("_pos").alias(position)]))


def col_or_null(df: DataFrame, *names: str) -> Column:
    lower = {c.lower(): c for c in df.columns}
    for name in names:
        if name.lower() in lower:
            return C(f"`{lower[name.lower()]}`")
    return F.lit(None).cast("string")


def require(df: DataFrame, names: list[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}")


def class_history(spark: SparkSession, path: str, locations: str | None = None) -> DataFrame:
    rows = class_records(big_csv(spark, path))
    if locations is None:
        return rows
    raw = csv(spark, locations, position="_pos")
    return attach_locations(rows, location_dimension(raw, "Abbreviation", "Name", "_pos"))


def zip_centroids(spark: SparkSession, path: str) -> DataFrame:
    """zip, lat, lng; bad rows dropped, the last duplicate wins."""
    df = csv(spark, path, position="_pos")
    rows = df.select(F.trim("zip").alias("zip"), C("lat").try_cast("double").alias("lat"), C("lng").try_cast("double").alias("lng"), "_pos")
    ok = rows.where(C("zip").rlike(r"^\d{5}$") & C("lat").isNotNull() & C("lng").isNotNull())
    return ok.groupBy("zip").agg(F.max_by(F.struct("lat", "lng"), "_pos").alias("r")).select("zip", "r.lat", "r.lng")


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    df = big_csv(spark, path, "\t")
    rows = df.select(F.lpad(F.trim("GEOID"), 5, "0").alias("zip"), F.trim("INTPTLAT").try_cast("double").alias("lat"), F.trim("INTPTLONG").try_cast("double").alias("lng"),
                     F.coalesce(F.trim("ALAND_SQMI").try_cast("double"), F.lit(0.0)).alias("land_sqmi"))
    return rows.where(C("lat").isNotNull() & C("lng").isNotNull() & C("zip").rlike(r"^\d{5}$"))


JAM = -1000000.0


def acs(df: DataFrame) -> DataFrame:
    """ACS ZCTA columns (text) to shares; jam values are unknown."""
    v = lambda name: F.when(C(name).try_cast("double") > JAM, C(name).try_cast("double"))
    share = lambda a, b: F.when(b > 0, F.try_divide(a, b))
    bach = [v(f"B15003_0{i}E") for i in (22, 23, 24, 25)]
    some = F.coalesce(*bach)
    total = sum([F.coalesce(b, F.lit(0.0)) for b in bach], F.lit(0.0))
    return df.select(
        F.lpad(F.trim(C("ZCTA")), 5, "0").alias("zip"), v("B01003_001E").alias("population"), v("B19013_001E").alias("median_household_income"),
        share(v("B23025_001E"), v("B01003_001E")).alias("working_age_share"), share(v("B23025_004E"), v("B23025_001E")).alias("employment_rate"),
        share(F.when(some.isNotNull(), total), v("B15003_001E")).alias("bachelors_or_higher_share"), share(v("C24050_046E"), v("B23025_004E")).alias("healthcare_employment_share"))


def acs_table(spark: SparkSession, path: str) -> DataFrame:
    """A saved table of one JSON array of rows, the names first, to shares; several tasks read it."""
    rows = json_elements(spark, path, "array<string>", None, "[")
    names = rows.orderBy("_file", "_element").limit(1).collect()
    if not names:
        raise ValueError("no header row")
    header = names[0].e
    body = rows.where((C("_element") > 0) & (F.size("e") == len(header)))
    table = body.select(*[F.get("e", F.lit(i)).alias(name) for i, name in enumerate(header)])
    zcta = next((name for name in header if name.lower().startswith("zip code tabulation area")), "ZCTA")
    return acs(table.withColumnRenamed(zcta, "ZCTA"))


def facilities(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """Facility files of several categories; rows with neither place nor ZIP drop."""
    out = None
    for category, path in sources.items():
        df = big_csv(spark, path)
        z = F.lpad(F.substring(F.trim(col_or_null(df, *ZIP_NAMES)), 1, 5), 5, "0")
        rows = df.select(F.lit(category).alias("category"), parse_number(col_or_null(df, *LAT_NAMES)).alias("lat"), parse_number(col_or_null(df, *LNG_NAMES)).alias("lng"),
                         F.when(z.rlike(r"^\d{5}$"), z).alias("zip"))
        out = rows if out is None else out.unionByName(rows)
    return out.where(C("lat").isNotNull() | C("lng").isNotNull() | C("zip").isNotNull())


def providers(spark: SparkSession, path: str) -> DataFrame:
    """The three useful columns of the provider file, found by header parts."""
    df = big_csv(spark, path)

    def find(*parts: str) -> Column:
        hit = next((c for p in parts for c in df.columns if p in c.lower()), None)
        return C(f"`{hit}`") if hit else F.lit(None).cast("string")

    return df.select(find("practice location address postal code", "postal code").alias("zip"), find("taxonomy code").alias("taxonomy"), find("entity type code").alias("entity"))


def institutions(spark: SparkSession, path: str) -> DataFrame:
    df = big_csv(spark, path)
    return df.select(col_or_null(df, "INSTNM").alias("name"), zip5(col_or_null(df, "ZIP")).alias("zip"), parse_number(col_or_null(df, "EFTOTLT")).cast("bigint").alias("enrollment")).where(C("zip").isNotNull())


MAP_SCHEMA = "elements array<struct<type:string,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:struct<amenity:string,shop:string>>>"


def map_elements(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Map export to lat, lng, kind; ways and relations use their centre.

    A file is one object whose array of elements several tasks read, or with ``lines``
    one such object a line."""
    if lines:
        df = spark.read.schema(MAP_SCHEMA).json(path).select(F.explode("elements").alias("e"))
    else:
        element = MAP_SCHEMA.removeprefix("elements array<struct<").removesuffix(">>")
        df = json_elements(spark, path, f"struct<{element}>", "elements").select("e")
    rows = df.select(F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lng"), map_kind(C("e.tags.amenity"), C("e.tags.shop")).alias("kind"))
    return rows.where(C("lat").isNotNull() & C("lng").isNotNull() & C("kind").isNotNull())


POSTING_COLUMNS = ["city", "state", "latitude", "longitude", "radius_miles", "employer", "title", "description", "source_url", "posted_at", "notes"]
RENT_COLUMNS = ["city", "state", "latitude", "longitude", "radius_miles", "rent_per_sqft_annual", "source_url", "notes"]


def job_postings(spark: SparkSession, path: str) -> DataFrame:
    df = quoted_csv(spark, path)
    require(df, POSTING_COLUMNS)
    num = ["latitude", "longitude", "radius_miles"]
    return df.withColumns({c: parse_number(C(c)) for c in num})


def rent_overrides(spark: SparkSession, path: str) -> DataFrame:
    df = csv(spark, path)
    require(df, RENT_COLUMNS)
    num = ["latitude", "longitude", "radius_miles", "rent_per_sqft_annual", "vacancy_rate_pct", "median_commercial_lease_term_months"]
    return df.withColumns({c: parse_number(C(c)) if c in df.columns else F.lit(None).cast("double") for c in num})


def commercial_overrides(spark: SparkSession, path: str) -> DataFrame:
    df = csv(spark, path)
    rows = df.withColumns({"candidate_id": blank_to_null(C("candidate_id")), "address_match": blank_to_null(C("address_match")), "asking_rent": parse_number(C("asking_rent")), "square_feet": parse_number(C("square_feet"))})
    return rows.where(C("candidate_id").isNotNull() | C("address_match").isNotNull())


def commercial_validation(spark: SparkSession, path: str) -> DataFrame:
    df = csv(spark, path)
    return df.withColumns({"zip": zip5(C("zip")), "monthly_rent": money(C("monthly_rent"))}).where(C("zip").isNotNull())


def state_prices(spark: SparkSession, path: str) -> DataFrame:
    df = csv(spark, path)
    return df.select(F.upper(F.trim("state")).alias("state"), *[parse_number(C(c)).alias(c) for c in ("median_price", "sample_size", "overall_median")]).where(C("state") != "")


def roster(spark: SparkSession, path: str) -> DataFrame:
    """Instructor roster: list cells split, flags read, unnamed rows dropped."""
    df = csv(spark, path)
    text = lambda c: F.trim(F.coalesce(col_or_null(df, c), F.lit("")))
    cols = {c: text(c) for c in ("name", "email", "phone", "city", "state", "availability", "pay_rate", "reliability_notes")}
    rows = df.select(*[v.alias(k) for k, v in cols.items()], zip5(text("zip")).alias("zip"), *[list_cell(col_or_null(df, c)).alias(c) for c in ("courses", "certifications", "expiration_dates", "languages")],
                     parse_number(text("travel_radius_miles")).alias("travel_radius_miles"), F.coalesce(tri_bool(text("verified")), F.lit(False)).alias("verified"),
                     F.coalesce(blank_to_null(F.upper(text("long_term_interest"))), F.lit("UNKNOWN")).alias("long_term_interest"))
    return rows.where(C("name") != "")


def locations(spark: SparkSession, path: str) -> DataFrame:
    df = csv(spark, path)
    text = lambda c: F.trim(F.coalesce(col_or_null(df, c), F.lit("")))
    return df.select(text("location_name").alias("location_name"), text("address").alias("address"), zip5(text("zip")).alias("zip"), low(text("active_status")).alias("active_status"),
                     list_cell(col_or_null(df, "courses_offered")).alias("courses_offered"), parse_number(text("capacity")).alias("capacity"), parse_number(text("rent_cost")).alias("rent_cost"),
                     text("parking_notes").alias("parking_notes"), text("room_notes").alias("room_notes"),
                     parse_number(text("average_monthly_enrollment")).alias("average_monthly_enrollment")).where(C("location_name") != "")


def keyed_numbers(spark: SparkSession, path: str, key: str, numbers: list[str]) -> DataFrame:
    """Small rule tables: a key column and numeric columns (course economics)."""
    df = csv(spark, path)
    return df.select(F.upper(F.trim(key)).alias(key), *[parse_number(col_or_null(df, c)).alias(c) for c in numbers]).where(C(key) != "")


def first_row(df: DataFrame, position: str) -> DataFrame:
    """First data row, in file order, of a settings file."""
    return df.orderBy(position).limit(1)


def settings(spark: SparkSession, path: str, defaults: dict[str, float]) -> DataFrame:
    """Cost constants: the first row over the defaults."""
    df = first_row(csv(spark, path, position="_pos"), "_pos")
    return df.select(*[F.coalesce(parse_number(col_or_null(df, k)), F.lit(v)).alias(k) for k, v in defaults.items()])


def site_health(spark: SparkSession, path: str) -> DataFrame:
    df = csv(spark, path)
    num = ["monthly_avg_revenue", "break_even_gap", "period_net_profit"]
    return df.withColumns({c: parse_number(col_or_null(df, c)) for c in num}).where(F.trim("site_name") != "")


def table_or_json(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """The CSV table at ``path`` (no suffix), or its JSON twin when only that exists; the
    columns of ``schema`` either way.  The twin is one array, or one object a line."""
    found = preferred(spark, [path + ".csv", path + ".json"])
    if found.endswith(".json") and multi_line:
        return json_elements(spark, found, schema, None).select("e.*")
    if found.endswith(".json"):
        return spark.read.schema(schema).json(found)
    kinds = [part.strip().rsplit(" ", 1) for part in schema.split(",")]
    df = quoted_csv(spark, found)
    return df.select(*[col_or_null(df, name).try_cast(kind).alias(name) for name, kind in kinds])


def zip_list(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Distinct ZIPs of a JSON list file with their first position in file order."""
    df = spark.read.schema("zips array<struct<zip:string,category:string,reason:string>>").option("multiLine", multi_line).json(path)
    at = F.struct(C("_metadata.file_path").alias("file"), C("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    rows = df.select(at.alias("at"), F.posexplode("zips").alias("i", "z")).select(zip5(C("z.zip")).alias("zip"), F.struct("at", "i").alias("pos"))
    return rows.where(C("zip").isNotNull()).groupBy("zip").agg(F.min("pos").alias("pos"))


def profiles(spark: SparkSession, folder: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Stored profile JSONs of a folder, with a declared schema."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(folder)


def backtest_rows(spark: SparkSession, path: str) -> DataFrame:
    df = quoted_csv(spark, path)
    require(df, ["address", "state", "outcome"])
    return df.withColumn("outcome", parse_number(C("outcome"))).where(C("outcome").isNotNull())


def preferred(spark: SparkSession, paths: list[str]) -> str:
    """First path that exists (a metadata check, at plan time)."""
    jvm = spark._jvm
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hp):
            return p
    raise FileNotFoundError(str(paths))
