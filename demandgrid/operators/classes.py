"""Class-history operators: typing, the held-class filter and its rollups.

Every rollup is one partial+final hash aggregation.  Medians use the built-in
exact percentile only on class sizes, whose distinct values are few whatever
the row count, so its per-group state stays small even for a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from demandgrid.functions.exprs import blank_to_null, clamp, joined, lookup, n, pick, ratio, renorm, rnd, stages
from demandgrid.functions.text import (
    cancelled, course_label, course_type, decision_course, demand_bucket, is_blank, title_signals, location_key,
    address_parts, location_name, low, parse_date, parse_int, parse_price, squeeze,
)

C = F.col


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def typed_classes(df: DataFrame) -> DataFrame:
    """Course type, demand bucket, decision course, month, day part, cancelled flag."""
    d = C("class_date")
    signals = title_signals(C("class_name"))
    t = {k: C(k) for k in signals}
    base = df.withColumns({
        "month": F.date_format(d, "yyyy-MM"),
        "day_part": F.when(F.weekday(d) >= 5, "weekend").when(d.isNotNull(), "weekday"),
        "cancelled": cancelled(C("status")),
    })
    return stages(base, signals, {"course_type": course_type(t)}).withColumns({
        "bucket": demand_bucket(C("course_type"), t),
        "decision": decision_course(C("course_type"), t),
    }).drop(*signals)


# --- ingest of a messy export --------------------------------------------------

# fixed values: header spellings per field, in order of preference
HEADER_ALIASES = {
    "class_name": ["class name", "course name", "class", "course", "class type", "course type", "title", "event", "name"],
    "date": ["class date", "start date", "event date", "scheduled date", "date", "start", "scheduled", "datetime"],
    "enrolled": ["students enrolled", "num enrolled", "# enrolled", "enrolled", "enrollment", "students", "registered",
                 "attendees", "seats filled", "filled", "attendance", "count"],
    "capacity": ["max students", "max capacity", "max enrollment", "class size", "capacity", "max", "seats", "limit",
                 "max seats"],
    "price": ["price", "cost", "fee", "tuition", "amount", "rate", "list price"],
    "city": ["city", "town"],
    "location": ["location", "training center", "venue", "site", "place", "address", "facility"],
    "status": ["class status", "status", "state"],
    "end_date": ["end date / time", "end date", "end time", "end"],
    "hours": ["hours", "hrs", "duration", "length"],
}


def resolve_headers(headers: list[str]) -> dict[str, str]:
    """Field -> header.  Every exact spelling is settled before any partial one,
    and a header serves one field only.  Works on column names, never on data."""
    taken: dict[str, str] = {}
    free = {h: h.strip().lower() for h in headers}
    for fits in (lambda alias, text: alias == text, lambda alias, text: alias in text):
        for field, aliases in HEADER_ALIASES.items():
            if field in taken:
                continue
            hit = next((h for a in aliases for h, text in free.items() if fits(a, text)), None)
            if hit is not None:
                taken[field] = hit
                del free[hit]
    return taken


def class_records(raw: DataFrame) -> DataFrame:
    """Raw string export -> class records; rows without a class name drop out."""
    found = resolve_headers(raw.columns)
    if "class_name" not in found:
        raise ValueError(f"no class-name column among {raw.columns}")

    def text(field: str) -> Column:
        return C(f"`{found[field]}`").cast("string") if field in found else F.lit(None).cast("string")

    rows = raw.select(
        F.trim(text("class_name")).alias("class_name"), parse_date(text("date")).alias("class_date"),
        parse_int(text("enrolled")).alias("enrolled"), parse_int(text("capacity")).alias("capacity"),
        parse_price(text("price")).alias("price"), blank_to_null(text("city")).alias("city"),
        location_name(text("location")).alias("location"), blank_to_null(text("status")).alias("status"),
        (is_blank(text("end_date")) if "end_date" in found else F.lit(False)).alias("end_blank"),
        (is_blank(text("hours")) if "hours" in found else F.lit(False)).alias("hours_blank"),
    )
    return typed_classes(rows.where(F.coalesce(C("class_name"), F.lit("")) != ""))


def location_dimension(raw: DataFrame, abbr: str, name: str, position: str) -> DataFrame:
    """One row per place key: first row wins, ambiguity and duplicates flagged,
    ZIP withheld when several differ.  State per key is a handful of extremes,
    so a key that holds most rows still aggregates map-side."""
    p = raw.select(location_key(C(abbr)).alias("place_key"), C(position).alias("pos"),
                   address_parts(C(name)).alias("a"))
    p = p.where(C("place_key") != "").select("place_key", "pos", "a.city", "a.state", "a.zip")
    spot = F.when(C("city").isNotNull() | C("state").isNotNull(),
                  F.concat_ws("|", F.coalesce(C("city"), F.lit("")), F.coalesce(C("state"), F.lit(""))))
    return p.groupBy("place_key").agg(
        F.min_by(F.struct("city", "state", "zip"), C("pos")).alias("first"),
        F.count("*").alias("copies"),
        (F.min(spot) != F.max(spot)).alias("differs"),
        F.min("zip").alias("zip_lo"), F.max("zip").alias("zip_hi"),
    ).select(
        "place_key", C("first.city").alias("city"), C("first.state").alias("state"),
        F.when(~F.coalesce(C("zip_lo") != C("zip_hi"), F.lit(False)), C("first.zip")).alias("zip"),
        C("copies"), F.coalesce(C("differs"), F.lit(False)).alias("ambiguous"),
    )


def attach_locations(records: DataFrame, places: DataFrame) -> DataFrame:
    """Fill city/state/zip of records without a city, skipping ambiguous keys.

    The dimension is small by nature but grows with the business, so the join
    strategy is left to AQE instead of a forced broadcast."""
    p = places.select(C("place_key"), C("city").alias("p_city"), C("state").alias("p_state"), C("zip").alias("p_zip"),
                      C("ambiguous"))
    # records that need no match get spread-out keys that hit nothing; NULL keys
    # would all hash to one task
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*records.columns), F.lit(4096)).cast("string"))
    wanted = C("location").isNotNull() & C("city").isNull()
    key = F.when(wanted, location_key(C("location"))).otherwise(spread)
    j = records.withColumns({"place_key": key, "_wanted": wanted}).join(p, "place_key", "left")
    usable = C("ambiguous") == F.lit(False)
    return j.withColumns({
        "match": pick((~C("_wanted"), "not_needed"), (C("ambiguous"), "ambiguous"), (usable, "matched"),
                      default="unmatched"),
        "city": F.coalesce(C("city"), F.when(usable, C("p_city"))),
        "state": F.when(usable, C("p_state")) if "state" not in records.columns
        else F.coalesce(C("state"), F.when(usable, C("p_state"))),
        "zip": F.when(usable, C("p_zip")) if "zip" not in records.columns
        else F.coalesce(C("zip"), F.when(usable, C("p_zip"))),
    }).drop("p_city", "p_state", "p_zip", "ambiguous", "place_key", "_wanted")


def class_quality(records: DataFrame, cutoff: str) -> DataFrame:
    """Data-quality counters of a class table in one pass."""
    e, cap = C("enrolled"), C("capacity")
    cols = [
        F.count("*").alias("classes_loaded"),
        n(C("class_date").isNull()).alias("missing_start_date"),
        n((cap > 0) & (e > cap)).alias("capacity_overfilled"),
        n((cap == 0) & (e > 0)).alias("zero_seats_with_students"),
        n(F.coalesce(e, F.lit(0)) == 0).alias("zero_student_rows"),
        n(is_held(cutoff)).alias("held_classes"),
        n(C("zip").isNull()).alias("missing_zip"),
        n(C("price").isNull()).alias("missing_price"),
    ]
    return records.agg(*cols)


# --- held classes -----------------------------------------------------------------

def is_held(cutoff: str) -> Column:
    """Ran with students, not cancelled, in a completed month (undated rows stay)."""
    return F.coalesce(
        (C("enrolled") > 0) & ~F.coalesce(C("cancelled"), F.lit(False))
        & (C("month").isNull() | (C("month") < cutoff)), F.lit(False))


def held(df: DataFrame, cutoff: str) -> DataFrame:
    return df.where(is_held(cutoff))


def usable(df: DataFrame, cutoff: str) -> DataFrame:
    return held(df, cutoff).where(C("course_type") != "unknown_course_type")


# --- aggregates -------------------------------------------------------------------

def fill_pct(digits: int = 1) -> Column:
    """Ratio of sums over rows with both numbers and seats."""
    ok = C("enrolled").isNotNull() & (C("capacity") > 0)
    return rnd(ratio(F.sum(F.when(ok, C("enrolled"))) * 100.0, F.sum(F.when(ok, C("capacity")))), digits)


def mean_fill_pct() -> Column:
    """Mean of per-class ratios (the benchmark reading of fill)."""
    ok = C("enrolled").isNotNull() & (C("capacity") > 0)
    return rnd(F.avg(F.when(ok, C("enrolled") / C("capacity"))) * 100.0, 1)


def mean_students(digits: int = 2) -> Column:
    return rnd(ratio(F.sum("enrolled"), F.count("enrolled")), digits)


def revenue(modeled_price: float | None) -> list[Column]:
    """Export prices when any row has one, else the modelled price."""
    priced = C("enrolled").isNotNull() & C("price").isNotNull()
    cents = F.sum(F.when(priced, (C("enrolled") * C("price")).cast("decimal(24,2)")))
    modeled = F.sum("enrolled") * F.lit(modeled_price).cast("double")
    return [
        F.coalesce(cents.cast("double"), rnd(modeled, 2)).alias("revenue_estimate"),
        pick((F.max(priced), "export_price"), (modeled.isNotNull(), "modeled_median")).alias("revenue_basis"),
    ]


def reference_avg(df: DataFrame) -> DataFrame:
    """One row: overall mean students per class with students, newest date."""
    pos = F.when(C("enrolled") > 0, C("enrolled"))
    return df.agg(rnd(ratio(F.sum(pos), F.count(pos)), 2).alias("reference_avg"), iso(F.max("class_date")).alias("latest_date"))


def course_metrics(df: DataFrame, key: str = "course_type", modeled_price: float | None = None) -> DataFrame:
    e = C("enrolled")
    known_c = F.count("cancelled")
    return df.groupBy(key).agg(
        F.count("*").alias("total_classes"), F.count("enrolled").alias("classes_with_enrollment"),
        n(e > 0).alias("classes_held"), F.sum("enrolled").alias("total_students"),
        mean_students().alias("average_students"),
        rnd(ratio(F.sum(F.when(e > 0, e)), n(e > 0)), 2).alias("average_held"),
        rnd(F.median("enrolled"), 2).alias("median_students"),
        fill_pct().alias("fill_rate_percent"),
        F.when(known_c > 0, n(C("cancelled"))).alias("cancelled_classes"),
        rnd(ratio(n(C("cancelled")) * 100.0, F.nullif(known_c, F.lit(0))), 1).alias("cancellation_rate_percent"),
        *revenue(modeled_price),
        F.coalesce(F.bool_or(e.isNotNull()), F.lit(False)).alias("enrollment_known"),
        F.coalesce(F.bool_or(e.isNotNull() & (C("capacity") > 0)), F.lit(False)).alias("capacity_known"),
        F.coalesce(F.bool_or(e.isNotNull() & C("price").isNotNull()), F.lit(False)).alias("price_known"),
    )


def area_filter(df: DataFrame, city: str) -> DataFrame:
    """City text, then its comma parts from the right: the first needle that hits
    anything decides; no hit at all keeps every row."""
    parts = [p.strip().lower() for p in city.split(",") if p.strip()]
    needles = list(dict.fromkeys([city.strip().lower(), *(reversed(parts) if "," in city else [])]))
    hay = [F.lower(C(c)) for c in ("city", "location") if c in df.columns]

    def hit(needle: str) -> Column:
        out = F.lit(False)
        for h in hay:
            out = out | F.coalesce(h.contains(needle), F.lit(False))
        return out

    tier = pick(*[(hit(t), i) for i, t in enumerate(needles)])
    tiered = df.withColumn("_tier", tier)
    best = tiered.agg(F.min("_tier").alias("b")).scalar()
    return tiered.where(F.coalesce(C("_tier") == best, best.isNull())).drop("_tier")


def area_match(df: DataFrame, city: str = "", state: str = "", location: str = "") -> DataFrame:
    """Best tier of: exact place, city, city alias, place prefix (state must agree)."""
    norm = lambda s: " ".join(s.strip().lower().split())
    city_n, state_n, loc_n = norm(city), norm(state), norm(location)
    aliases = list(dict.fromkeys(
        ([city_n] if city_n else []) + ([norm(p) for p in reversed(city.split(",")) if norm(p)] if "," in city else [])))
    place = squeeze(C("location")) if "location" in df.columns else F.lit("")
    town = squeeze(C("city"))
    cases: list[tuple[Column, str]] = []
    if loc_n:
        cases.append(((place == loc_n) | (town == loc_n), "location"))
    for a in aliases:
        cases.append(((town == a) | (place == a), "city" if a == city_n else "city_alias"))
        cases.append((place.startswith(a + " "), "location_prefix"))
    if not cases:
        return df.where(F.lit(False)).withColumn("match_type", F.lit("none"))
    rows = df.where(squeeze(C("state")) == state_n) if state_n else df
    rows = rows.withColumns({
        "_tier": pick(*[(c, i) for i, (c, _) in enumerate(cases)]),
        "match_type": pick(*cases),
    })
    best = rows.agg(F.min("_tier").alias("b")).scalar()
    return rows.where(C("_tier") == best).drop("_tier")


def split_by(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Classes, students and average by one key (day part, place or month)."""
    return df.withColumn(name, key).where(C(name).isNotNull()).groupBy(name).agg(
        F.count("*").alias("classes"), F.sum("enrolled").alias("total_students"), mean_students().alias("average_students"))


def rollup_stats(df: DataFrame) -> DataFrame:
    """How raw course types went into (or fell out of) the decision courses."""
    return df.groupBy("course_type", "decision").agg(F.count("*").alias("classes")).select(
        "course_type", "decision", "classes",
        pick((C("decision").isNull(), "dropped"), (C("decision") != C("course_type"), "merged"), default="kept").alias("outcome"))


def growth(df: DataFrame, keys: list[str]) -> DataFrame:
    """Later-half over earlier-half mean of monthly means.  The window runs over
    months, already aggregated, so its partitions stay small for any key."""
    months = df.where(C("month").isNotNull() & C("enrolled").isNotNull()).groupBy(*keys, "month").agg(
        F.avg("enrolled").alias("m_avg"))
    part = W.partitionBy(*keys)
    placed = months.withColumns({
        "pos": F.row_number().over(part.orderBy("month")), "n_months": F.count("*").over(part)})
    early = C("pos") <= F.floor(C("n_months") / 2)
    out = placed.where(C("n_months") >= 2).groupBy(*keys).agg(
        F.max("n_months").alias("months"),
        F.avg(F.when(early, C("m_avg"))).alias("earlier"), F.avg(F.when(~early, C("m_avg"))).alias("later"))
    return out.withColumn("growth_raw", F.when(C("earlier") > 0, C("later") / C("earlier"))).withColumn(
        "growth_ratio", rnd(C("growth_raw"), 2))


def top_per(df: DataFrame, keys: list[str], order: list[Column], limit: int, name: str = "rn") -> DataFrame:
    """Top rows per group.  Spark's window group limit trims each task's rows
    before the shuffle, so a hot group never lands whole in one task."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(C(name) <= limit)


def location_performance(df: DataFrame, key: Column, modeled_price: float | None = None) -> DataFrame:
    """Rollup by place with utilisation, growth, revenue and best/worst courses."""
    base = df.withColumn("key", F.coalesce(blank_to_null(key), F.lit("Unknown")))
    main = base.groupBy("key").agg(
        F.count("*").alias("classes"), F.sum("enrolled").alias("total_students"), mean_students().alias("average_students"),
        fill_pct().alias("utilization_percent"), *revenue(modeled_price))
    # courses per place: at most the size of the fixed catalogue, so lists are bounded
    named = base.where(C("enrolled").isNotNull() & (C("course_type") != "unknown_course_type")).groupBy("key", "course_type").agg(
        mean_students().alias("avg_c"))
    best = F.array_sort(F.collect_list(F.struct((-C("avg_c")).alias("o"), C("course_type"))))
    courses = named.groupBy("key").agg(best.alias("b")).select(
        "key", joined(F.slice(C("b.course_type"), 1, 3)).alias("top_courses"),
        F.when(F.size("b") > 3, joined(F.reverse(F.slice(C("b.course_type"), F.greatest(F.size("b") - 2, F.lit(1)), F.lit(3)))))
        .otherwise("").alias("weakest_courses"))
    g = growth(base, ["key"]).select("key", "growth_ratio")
    return main.join(g, "key", "left").join(courses, "key", "left")


def schedule_slots(df: DataFrame) -> DataFrame:
    """Classes and mean students per weekday and per calendar month (long form)."""
    dated = df.where(C("class_date").isNotNull())
    slots = dated.select(
        "enrolled", F.explode(F.array(
            F.struct(F.lit("weekday").alias("kind"), F.weekday("class_date").alias("slot")),
            F.struct(F.lit("month").alias("kind"), F.month("class_date").alias("slot")))).alias("s"))
    return slots.groupBy(C("s.kind").alias("kind"), C("s.slot").alias("slot")).agg(
        F.count("*").alias("classes"), mean_students().alias("average_students"))


def best_slots(df: DataFrame) -> DataFrame:
    """Best weekday and month: by average among slots with two classes, else by volume."""
    s = schedule_slots(df)
    enough = C("classes") >= 2
    good = F.when(enough & C("average_students").isNotNull(), F.struct("average_students", "classes", (-C("slot")).alias("neg")))
    by_volume = F.struct(enough.cast("int").alias("e"), C("classes"), (-C("slot")).alias("neg"))
    out = s.groupBy("kind").agg(F.max(good).alias("g"), F.max(by_volume).alias("v"))
    return out.select(
        "kind", (-F.coalesce(C("g.neg"), C("v.neg"))).alias("slot"), F.coalesce(C("g.classes"), C("v.classes")).alias("classes"),
        C("g.average_students").alias("average_students"),
        F.when(C("g").isNotNull(), "enrollment").otherwise("volume").alias("basis"))


def benchmarks(df: DataFrame, courses: list[str]) -> DataFrame:
    """Course benchmarks against the overall mean of all usable classes."""
    overall = df.agg(F.struct(mean_students().alias("a"), mean_fill_pct().alias("f")).alias("s")).scalar()
    ok = C("enrolled").isNotNull() & (C("capacity") > 0)
    rows = df.where(C("course_type").isin(courses)).groupBy("course_type").agg(
        mean_students().alias("average_students"), mean_fill_pct().alias("average_fill_pct"),
        n(ok).alias("fill_rate_class_count"), F.sum("enrolled").alias("total_students"),
        F.count("enrolled").alias("class_count"), rnd(F.median("enrolled"), 2).alias("median_students"),
        F.min("enrolled").alias("min_students"), F.max("enrolled").alias("max_students"))
    rows = rows.withColumns({"overall_average": overall.getField("a"), "overall_fill_pct": overall.getField("f")})
    diff = rnd(C("average_students") - C("overall_average"), 2)
    rows = rows.withColumn("difference", diff)
    rows = rows.withColumn("percent_vs_average", rnd(ratio(C("difference") * 100.0, F.nullif(C("overall_average"), F.lit(0.0))), 1))
    return rows.withColumns({
        "confidence": F.when(C("class_count") < 10, "low").otherwise("normal"),
        "note": pick(
            (C("class_count") < 10, "limited_sample"),
            (C("difference").isNull() | C("percent_vs_average").isNull(), "no_benchmark"),
            ((C("difference") >= 0.75) | (C("percent_vs_average") >= 12), "strong"),
            (C("difference") >= -0.25, "near_average"), default="below_average"),
    })


HALF_LIFE_MONTHS = 6.0


def forecast(df: DataFrame, modeled_price: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """Recency-weighted expectation per course: a class six months older counts half.

    Rows collapse to (course, month) sums first; the newest month then comes
    from a window over those few rows."""
    keys = ["course_type"] if keys is None else keys
    base = df.withColumn("idx", F.year("class_date") * 12 + F.month("class_date"))
    fill_ok = C("enrolled").isNotNull() & (C("capacity") > 0)
    m = base.groupBy(*keys, "idx").agg(
        F.count("*").alias("rows"), F.sum("enrolled").alias("s_e"), F.count("enrolled").alias("n_e"),
        F.sum(F.when(fill_ok, 100.0 * C("enrolled") / C("capacity"))).alias("s_f"), n(fill_ok).alias("n_f"),
        F.sum("price").alias("s_p"), F.count("price").alias("n_p"))
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    newest, oldest = F.max("idx").over(part), F.min("idx").over(part)
    age = newest - F.coalesce(C("idx"), oldest)
    m = m.withColumn("w", F.coalesce(F.pow(F.lit(0.5), age / HALF_LIFE_MONTHS), F.lit(1.0))).withColumn("dated", newest.isNotNull())

    def wmean(s: str, c: str) -> Column:
        return ratio(F.sum(C(s) * C("w")), F.nullif(F.sum(C(c) * C("w")), F.lit(0.0)))

    out = m.groupBy(*keys).agg(
        F.sum("rows").alias("sample_size"), wmean("s_e", "n_e").alias("es"), wmean("s_f", "n_f").alias("ef"),
        wmean("s_p", "n_p").alias("ep"), F.sum("n_e").alias("n_enrolled"), F.max("dated").alias("dated"))
    price = F.coalesce(C("ep"), F.lit(modeled_price).cast("double"))
    return out.select(
        *keys, "sample_size", rnd(C("es"), 2).alias("expected_students"), rnd(C("ef"), 1).alias("expected_fill_percent"),
        rnd(C("es") * price, 2).alias("expected_revenue"),
        pick((C("ep").isNotNull(), "export_price"), (price.isNotNull(), "modeled_median")).alias("revenue_basis"),
        F.when(C("dated"), "recency").otherwise("uniform").alias("weighting"),
        pick((C("n_enrolled") >= 12, "high"), (C("n_enrolled") >= 5, "medium"), default="low").alias("confidence"))


def historical_score(df: DataFrame, keys: list[str], reference: float | Column | None) -> DataFrame:
    """Area history score: enrolment 45, fill 30, growth 25 (renormalised); under
    three classes unknown, under eight pulled toward 50."""
    pos = F.when(C("enrolled") > 0, C("enrolled"))
    ok = C("enrolled").isNotNull() & (C("capacity") > 0)
    base = df.groupBy(*keys).agg(
        F.avg(pos).alias("avg_s"), F.count(pos).alias("sample_size"),
        ratio(F.sum(F.when(ok, C("enrolled"))) * 100.0, F.sum(F.when(ok, C("capacity")))).alias("fill"))
    g = growth(df, keys).select(*keys, "growth_raw")
    j = base.join(g, keys, "left")
    ref = reference if isinstance(reference, Column) else F.lit(reference).cast("double")
    enrol = clamp(F.when(ref > 0, ratio(50.0 * C("avg_s"), ref)).otherwise(100.0 * C("avg_s") / 12.0))
    trend = clamp(50.0 + 50.0 * (C("growth_raw") - 1.0))
    fill = clamp(C("fill"))
    raw = renorm([(enrol, 0.45), (fill, 0.30), (trend, 0.25)])
    shrunk = F.when(C("sample_size") < 8, 50.0 + (raw - 50.0) * C("sample_size") / 8.0).otherwise(raw)
    parts = 1 + C("fill").isNotNull().cast("int") + C("growth_raw").isNotNull().cast("int")
    return j.select(
        *keys, "sample_size", F.when(C("sample_size") >= 3, rnd(clamp(shrunk), 1)).alias("score"),
        F.when(C("sample_size") >= 3, pick(
            ((C("sample_size") >= 20) & (parts >= 2), "high"), (C("sample_size") >= 8, "medium"), default="low")).alias("confidence"),
        rnd(enrol, 1).alias("enrollment_score"), rnd(fill, 1).alias("fill_score"), rnd(trend, 1).alias("growth_score"))


def strong_weak(df: DataFrame, key: Column, reference: Column, limit: int = 8, band: float = 0.15) -> DataFrame:
    """Places at least 15 % (``band``) above or below the overall mean, best eight of each."""
    g = df.withColumn("name", blank_to_null(key)).where(C("name").isNotNull()).groupBy("name").agg(
        F.count("*").alias("classes"), F.count("enrolled").alias("known"), mean_students().alias("average_students"))
    g = g.where((C("known") >= 3) & (C("classes") >= 5)).withColumn("ref", reference)
    side = pick((C("average_students") >= C("ref") * F.lit(1 + band), "strong"), (C("average_students") <= C("ref") * F.lit(1 - band), "weak"))
    g = g.withColumn("side", side).where(C("side").isNotNull())
    sign = F.when(C("side") == "strong", -1.0).otherwise(1.0)
    ranked = top_per(g, ["side"], [sign * C("average_students"), -C("classes"), C("name")], limit)
    return ranked.select("side", "name", "classes", "average_students",
                         rnd(C("average_students") - C("ref"), 2).alias("delta"), C("rn").alias("position"))


def frequency(df: DataFrame, key: Column, limit: int = 12) -> DataFrame:
    name = F.coalesce(blank_to_null(key), F.lit("Unknown"))
    return df.groupBy(name.alias("name")).agg(F.count("*").alias("classes")).orderBy(C("classes").desc(), "name").limit(limit)


def recent_activity(df: DataFrame, keys: list[str], days: int = 180) -> DataFrame:
    """Classes in the last days before each group's newest date: counts per day
    first, so the look-back never needs a group's rows together."""
    daily = df.where(C("class_date").isNotNull()).groupBy(*keys, "class_date").agg(F.count("*").alias("k"))
    newest = F.max("class_date").over(W.partitionBy(*keys))
    return daily.withColumn("latest", newest).groupBy(*keys).agg(
        iso(F.max("latest")).alias("latest_class_date"),
        F.coalesce(F.sum(F.when(C("class_date") >= F.date_sub(C("latest"), days), C("k"))), F.lit(0)).alias("recent_classes"))
