"""Operations: market supply, instructors, rooms, sites, economics and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from demandgrid.functions.exprs import clamp, flags, joined, lookup, n, nonzero, opt, pick, ratio, rnd, stages, total, zero
from demandgrid.functions.text import plain_name
from demandgrid.operators.classes import iso, top_per
from demandgrid.operators.geo import nearest, within
from demandgrid.operators.pyramid import nearest_k
from demandgrid.operators.ranks import quantiles
from demandgrid.session import ensure_checkpoint_dir

C = F.col

# --- market supply and demand per ZIP -----------------------------------------------


def competitor_supply(df: DataFrame) -> DataFrame:
    """Class supply per ZIP and course: counts, distinct providers, price range,
    six providers and three places by name.

    Rows without ZIP or course type are counted, but have no median.
    The name lists come from distinct names cut per group before they are
    collected, so no list grows with the data."""
    keys = ["zip", "course_type"]
    main = df.groupBy(*keys).agg(F.count("*").alias("class_count"), F.countDistinct("provider").alias("provider_count"),
                                 F.min("price").alias("min_price"), F.max("price").alias("max_price"))
    # prices of a busy key are counted and ranked in many tasks, never held in one
    keyed = df.where(C("zip").isNotNull() & C("course_type").isNotNull()).select(*keys, C("price").cast("double").alias("price"))
    main = main.join(quantiles(keyed, "price", {"median_price": 0.5}, keys), keys, "left")

    def names(col: str, k: int) -> DataFrame:
        few = top_per(df.where(C(col).isNotNull()).select(*keys, col).distinct(), keys, [C(col)], k)
        return few.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(col)), "; ").alias(f"{col}s"))

    return main.join(names("provider", 6), keys, "left").join(names("location", 3), keys, "left")


def local_demand(df: DataFrame) -> DataFrame:
    """Students, classes, instructors, newest date and top three courses per home ZIP."""
    main = df.groupBy("home_zip").agg(F.count("*").alias("student_count"), F.countDistinct("class_id").alias("class_count"),
                                      F.countDistinct("instructor").alias("instructor_count"), iso(F.max("reg_date")).alias("latest_registration"))
    counts = df.where(C("course").isNotNull()).groupBy("home_zip", "course").agg(F.count("*").alias("k"))
    top = top_per(counts, ["home_zip"], [C("k").desc(), C("course")], 3)
    text = F.transform(F.array_sort(F.collect_list(F.struct("rn", "course", "k"))), lambda s: F.concat(s["course"], F.lit(" ("), s["k"].cast("string"), F.lit(")")))
    return main.join(top.groupBy("home_zip").agg(F.array_join(text, "; ").alias("top_courses")), "home_zip", "left")


# fixed values: name beginnings that are no instructor
NOT_INSTRUCTORS = ["cancel", "tentative", "hold", "test", "n/a", "tbd", "pending", "unassigned", "staff", r"\("]


def is_real_instructor(name: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return (t != "") & ~t.isin("nan", "none") & ~t.rlike("^(" + "|".join(NOT_INSTRUCTORS) + ")")


def discipline_course(d: Column) -> Column:
    t = F.upper(F.trim(F.coalesce(d, F.lit(""))))
    arc = t.contains("ARC") | t.contains("RED CROSS")
    bls = t.contains("BLS") | t.contains("BASIC LIFE SUPPORT")
    cpr = t.contains("CPR") | t.contains("FIRST AID") | t.contains("AED")
    return pick((t == "", None), (arc & bls, "ARC_BLS"), (arc, "ARC_CPR_FA_AED"), (t.contains("AHA") | t.contains("AMERICAN HEART") | bls, "AHA_BLS"), (cpr, "ARC_CPR_FA_AED"))


def track_record(df: DataFrame, roster: DataFrame) -> DataFrame:
    """Students, classes, ZIPs and course counts per instructor with the home place.

    ``df``: instructor, class_id, home_zip, discipline, reg_date; ``roster``: name, city, state, zip."""
    rows = df.where(is_real_instructor(C("instructor"))).withColumn("course", discipline_course(C("discipline")))
    agg = rows.groupBy("instructor").agg(
        F.count("*").alias("students"), F.countDistinct("class_id").alias("classes"), F.countDistinct("home_zip").alias("zips"),
        n(C("course") == "AHA_BLS").alias("aha_bls_students"), n(C("course") == "ARC_BLS").alias("arc_bls_students"), n(C("course") == "ARC_CPR_FA_AED").alias("arc_cpr_students"),
        iso(F.max("reg_date")).alias("last_taught"))
    home = roster.select(F.lower("name").alias("_n"), C("city").alias("home_city"), C("state").alias("home_state"), C("zip").alias("home_zip"))
    out = agg.withColumn("_n", F.lower("instructor")).join(home, "_n", "left").drop("_n")
    return out.withColumns({
        "students_per_class": rnd(ratio(C("students"), F.nullif(C("classes"), F.lit(0))), 1), "teaches_aha": C("aha_bls_students") > 0,
        "teaches_arc": C("arc_bls_students") + C("arc_cpr_students") > 0})


def proven_courses() -> Column:
    return flags((C("aha_bls_students") > 0, "AHA_BLS"), (C("arc_bls_students") > 0, "ARC_BLS"), (C("arc_cpr_students") > 0, "ARC_CPR_FA_AED"))


def performance(df: DataFrame) -> DataFrame:
    """Volume 45, class size 25, reach 15, course mix 15; tier and company grade."""
    one = lambda c, full: F.least(F.lit(1.0), c / full)
    df = df.withColumn("proven", proven_courses())
    s = 45.0 * one(zero(C("students")), 500.0) + 25.0 * one(zero(C("students_per_class")), 8.0) + 15.0 * one(zero(C("zips")), 120.0) + 15.0 * one(F.size("proven").cast("double"), 3.0)
    df = stages(df, {"performance_score": rnd(s, 1)})
    p = C("performance_score")
    return df.withColumns({
        "performance_tier": pick((p >= 70, "Top Performer"), (p >= 45, "Solid"), (p >= 25, "Developing"), default="Low"),
        "company_grade": pick((p >= 95, "A+"), (p >= 90, "A"), (p >= 80, "B"), (p >= 70, "C"), (p >= 60, "D"), default="E")})


def can_bridge(course: str) -> Column:
    """Proven in the other product line only."""
    aha, arc = ["AHA_BLS"], ["ARC_BLS", "ARC_CPR_FA_AED"]
    other = arc if course in aha else aha
    return ~F.array_contains("proven", course) & F.arrays_overlap(C("proven"), F.array(*[F.lit(x) for x in other]))


def winning_profile(df: DataFrame, course: str, sample: int) -> DataFrame:
    """Medians of the best instructors of a course (a bounded sample by design)."""
    top = df.where(F.array_contains("proven", course)).orderBy(C("performance_score").desc(), "instructor").limit(sample)
    return top.agg(F.count("*").alias("sample"), rnd(F.median("students"), 1).alias("median_students"), rnd(F.median("students_per_class"), 1).alias("median_class_size"),
                   rnd(F.median("zips"), 1).alias("median_zips"), n(C("teaches_aha")).alias("teach_aha"), n(C("teaches_arc")).alias("teach_arc"))


def sourcing_plan(df: DataFrame, course: str, state: Column, zip3: Column, limit: int) -> DataFrame:
    """Lanes 'activate' (already proven) and 'bridge', near people first."""
    near = (F.coalesce(C("home_state") == state, F.lit(False)) | F.coalesce(F.substring("home_zip", 1, 3) == zip3, F.lit(False)))
    lane = pick((F.array_contains("proven", course), "activate"), (can_bridge(course), "bridge"))
    rows = df.withColumns({"near": near, "lane": lane}).where(C("lane").isNotNull())
    return top_per(rows, ["lane"], [C("near").desc(), C("performance_score").desc(), C("instructor")], limit, "position")


# --- sites and coverage ---------------------------------------------------------------

BREAK_EVEN = 1067.0
STATUSES = ["CRITICAL", "WATCH", "STABLE", "STRONG", "LEAKAGE"]


def site_health(df: DataFrame) -> DataFrame:
    """Status checked against the list, default break-even gap, strength and warnings."""
    st = F.upper(F.trim(F.coalesce(C("health_status"), F.lit(""))))
    df = df.withColumn("health_status", F.when(st.isin(STATUSES), st).otherwise("WATCH"))
    gap = F.coalesce(C("break_even_gap"), rnd(C("monthly_avg_revenue") - BREAK_EVEN, 2))
    df = df.withColumn("break_even_gap", gap)
    s = C("health_status")
    return df.withColumns({
        "is_weak": s.isin("CRITICAL", "LEAKAGE"), "is_strong": s == "STRONG",
        "warnings": joined(flags((s == "LEAKAGE", "leakage"), (s == "CRITICAL", "critical"), (C("break_even_gap") < 0, "below_break_even"),
                                 ((C("monthly_avg_revenue") >= BREAK_EVEN) & (C("period_net_profit") < 0), "period_net_loss")))})


def coverage(targets: DataFrame, sites: DataFrame) -> DataFrame:
    """Nearest active and inactive site of every target with the opening decision.

    ``targets``: zip, lat, lng; ``sites``: site_id, s_lat, s_lng, active, is_weak, is_strong."""
    def near(kind: DataFrame, name: str) -> DataFrame:
        hit = nearest(targets, "lat", "lng", kind, "site_id", "s_lat", "s_lng", 100.0)
        return hit.select("lat", "lng", C("site_id").alias(name), rnd(C("distance"), 1).alias(f"{name}_miles"))

    t = targets.join(near(sites.where(C("active")), "active_site"), ["lat", "lng"], "left").join(near(sites.where(~C("active")), "inactive_site"), ["lat", "lng"], "left")
    health = sites.select(C("site_id").alias("active_site"), "is_weak", "is_strong")
    t = t.join(health, "active_site", "left")
    d = C("active_site_miles")
    covered, nearby = F.coalesce(d <= 6.0, F.lit(False)), F.coalesce(d <= 12.0, F.lit(False))
    weak, strong = F.coalesce(C("is_weak"), F.lit(False)), F.coalesce(C("is_strong"), F.lit(False))
    decision = pick((d.isNull() | (d > 15.0), "OPEN_TEST_OK"), (covered & weak, "FIX_CURRENT_FIRST"), (covered, "USE_EXISTING_SITE"), (nearby & strong, "CANNIBALIZATION_RISK"),
                    (nearby & weak, "FIX_CURRENT_FIRST"), default="OPEN_TEST_OK")
    return t.withColumns({"covered": covered, "coverage_decision": decision, "cannibalization_risk": (decision == "CANNIBALIZATION_RISK") | (covered & strong)})


# --- instructor leads -----------------------------------------------------------------------

LEVELS = {1: "Institutional Signal", 2: "Named Lead", 3: "Past Instructor", 4: "Contacted / Interested", 5: "Credential Verified", 6: "Confirmed Instructor"}
LEVEL_BASE = {1: 12, 2: 30, 3: 58, 4: 65, 5: 85, 6: 100}


def lead_level() -> Column:
    status, cred = F.upper(F.coalesce(C("outreach_status"), F.lit("NEW"))), F.upper(F.coalesce(C("credential_status"), F.lit("UNKNOWN")))
    past = F.coalesce(C("past_instructor"), F.lit(False)) | F.coalesce(C("source").isin("past_instructor", "enrollment_performance"), F.lit(False))
    signal = F.coalesce(C("source") == "zip_enrichment_signal", F.lit(False)) | (cred == "SIGNAL_ONLY")
    return pick((status == "CONFIRMED", 6), ((cred == "VERIFIED") | status.isin("CREDENTIAL_VERIFIED", "AVAILABLE"), 5), (status.isin("CONTACTED", "REPLIED", "INTERESTED"), 4),
                (past, 3), (signal, 1), (F.trim(F.coalesce(C("name"), F.lit(""))) != "", 2), default=1)


def lead_confidence() -> Column:
    """0..100 from credentials, wording, origin, distance, contact and interest."""
    cred = F.coalesce(C("credential_status"), F.lit("UNKNOWN"))
    hay = F.lower(F.concat_ws(" ", F.coalesce(C("signals"), F.lit("")), F.coalesce(C("organization"), F.lit(""))))
    d, radius = C("distance_miles"), F.coalesce(nonzero(C("travel_radius_miles")), F.lit(20.0))
    s = pick((cred == "VERIFIED", 40), (cred == "NEEDS_VERIFICATION", 22), (cred == "SIGNAL_ONLY", 8), (cred == "EXPIRED", 10), default=0) \
        + pick((hay.rlike("bls|cpr|aha instructor|red cross instructor|arc instructor"), 20),
               (hay.rlike("aha|american heart|red cross|acls|pals|emt|paramedic|nursing|simulation lab|clinical education|first aid"), 10), default=0) \
        + F.when(C("source") == "roster_import", 15).otherwise(0) + pick((d.isNull(), 0), (d <= 10, 12), (d <= radius, 7), default=-10) \
        + F.when(C("contactable"), 8).otherwise(0) + F.when(F.coalesce(C("organization"), F.lit("")) != "", 5).otherwise(0) \
        + pick((C("interest") == "YES", 8), (C("interest") == "MAYBE", 4), (C("interest") == "NO", -8), default=0)
    return F.when(cred == "REJECTED", 0.0).otherwise(rnd(clamp(s.cast("double")), 1))


def match_score(course: str | None) -> Column:
    d = C("distance_miles")
    proven = F.coalesce(C("proven"), F.array().cast("array<string>"))
    fit = F.lit(0) if course is None else pick((F.array_contains(proven, course), 8), (F.array_contains(C("courses_possible"), course), 4), default=-6)
    s = lookup(C("lead_level"), LEVEL_BASE) + pick((d.isNull(), 0), (d <= 10, 8), (d <= 20, 3), default=-12) + fit \
        + pick((C("performance_tier") == "Top Performer", 6), (C("performance_tier") == "Solid", 3), default=0) + F.when(C("contactable"), 4).otherwise(0)
    return rnd(clamp(s.cast("double")), 1)


def match_instructors(targets: DataFrame, people: DataFrame, leads: DataFrame, miles: float, fallback: int = 3) -> DataFrame:
    """Leads and past instructors around every target ZIP.

    Stored leads of the ZIP and past instructors with the same plain name become
    one row; instructors beyond the radius are taken only where nobody real is
    near, the nearest ``fallback`` of them.  Counts of people by cell tell each such
    target how far it must look, so it meets a few cells, never everybody.

    ``targets``: zip, lat, lng; ``people``: person, h_lat, h_lng, proven, performance_tier;
    ``leads``: zip, name, source, ..."""
    p = people.withColumn("nname", plain_name(C("person")))
    near = within(targets, p, ("lat", "lng"), ("h_lat", "h_lng"), miles, miles)
    past = near.select("zip", "nname", "person", rnd(C("distance"), 1).alias("p_miles"), "proven", "performance_tier")
    stored = leads.withColumn("nname", plain_name(C("name"))).withColumn("merge", (C("source") != "zip_enrichment_signal") & (C("nname") != ""))
    # the person's own track is joined by name wherever they live
    track = p.select("nname", C("proven").alias("t_proven"), C("performance_tier").alias("t_tier"), F.lit(True).alias("t_past"))
    real = stored.where("merge").join(track, "nname", "left").join(past.select("zip", "nname", "p_miles"), ["zip", "nname"], "left")
    crm = real.select("zip", "name", "source", "outreach_status", "credential_status", "contactable", F.coalesce("distance_miles", "p_miles").alias("distance_miles"),
                      C("t_proven").alias("proven"), C("t_tier").alias("performance_tier"), F.coalesce("t_past", F.lit(False)).alias("past_instructor"))
    sig = stored.where(~C("merge")).select("zip", "name", "source", "outreach_status", "credential_status", "contactable", "distance_miles",
                                           F.lit(None).cast("array<string>").alias("proven"), F.lit(None).cast("string").alias("performance_tier"), F.lit(False).alias("past_instructor"))
    def as_lead(df: DataFrame) -> DataFrame:
        return df.select("zip", C("person").alias("name"), F.lit("enrollment_performance").alias("source"), F.lit("NEW").alias("outreach_status"),
                         F.lit("NEEDS_VERIFICATION").alias("credential_status"), F.lit(False).alias("contactable"), C("p_miles").alias("distance_miles"), "proven", "performance_tier",
                         F.lit(True).alias("past_instructor"))

    known = stored.where("merge").select("zip", "nname")
    fresh = as_lead(past.join(known, ["zip", "nname"], "left_anti"))
    crowd = crm.select("zip").unionByName(fresh.select("zip")).distinct()
    ensure_checkpoint_dir(targets.sparkSession)
    alone = targets.join(crowd, "zip", "left_anti").checkpoint()
    # one home spot can fill a list with at most ``fallback`` people
    few = top_per(p, ["h_lat", "h_lng"], [C("person")], fallback, "_r").drop("_r").checkpoint()
    hits = nearest_k(alone, "zip", "lat", "lng", few, "h_lat", "h_lng", fallback)
    far = top_per(hits, ["zip"], [C("distance"), C("person")], fallback).select("zip", "nname", "person", rnd(C("distance"), 1).alias("p_miles"), "proven", "performance_tier")
    return crm.unionByName(sig).unionByName(fresh).unionByName(as_lead(far))


def roster_near(targets: DataFrame, roster: DataFrame, max_radius: float, default_radius: float = 20.0) -> DataFrame:
    """Roster people within 1.5 times their own travel radius; the same ZIP always.

    ``roster``: person, h_zip, h_lat, h_lng, travel_radius_miles."""
    own = F.coalesce(nonzero(C("travel_radius_miles")), F.lit(default_radius)) * 1.5
    near = within(targets, roster, ("lat", "lng"), ("h_lat", "h_lng"), own, max_radius * 1.5)
    same = targets.select("zip").join(roster.where(C("h_lat").isNull()).select("person", C("h_zip").alias("zip")), "zip")
    return near.select("zip", "person", rnd(C("distance"), 1).alias("miles")).unionByName(same.select("zip", "person", F.lit(None).cast("double").alias("miles")))


def instructor_readiness(leads: DataFrame, keys: list[str]) -> DataFrame:
    """Ladder 100/80/65/50/25/0 with stage and counts."""
    ok = ~F.coalesce(C("outreach_status") == "REJECTED", F.lit(False)) & ~F.coalesce(C("credential_status") == "REJECTED", F.lit(False))
    near = F.coalesce(C("distance_miles") <= F.coalesce(nonzero(C("travel_radius_miles")), F.lit(20.0)), F.lit(True))
    named = ok & C("credential_status").isin("NEEDS_VERIFICATION", "VERIFIED") & (F.coalesce(C("name"), F.lit("")) != "") & near
    agg = leads.groupBy(*keys).agg(
        n(ok & (C("credential_status") == "VERIFIED") & C("outreach_status").isin("CONFIRMED", "AVAILABLE", "CREDENTIAL_VERIFIED") & near).alias("confirmed"),
        n(ok & (C("source") == "roster_import") & near).alias("roster_nearby"), n(named).alias("named"), n(named & (C("confidence_score") >= 40)).alias("strong_named"),
        n(ok & (C("credential_status") == "SIGNAL_ONLY")).alias("signals"), n(ok).alias("usable"), F.count("*").alias("pool"))
    c = C
    score = pick((c("confirmed") > 0, 100.0), (c("roster_nearby") > 0, 80.0), (c("strong_named") > 0, 65.0), (c("signals") >= 2, 50.0), ((c("signals") > 0) | (c("named") > 0), 25.0), default=0.0)
    stage = pick((c("confirmed") > 0, "Confirmed"), ((c("named") > 0) | (c("roster_nearby") > 0), "Candidate Found"), (c("signals") > 0, "Signal Only"),
                 ((c("pool") > 0) & (c("usable") == 0), "Blocked"), default="No Signal")
    return agg.withColumns({"score": score, "stage": stage})


# --- rooms ----------------------------------------------------------------------------------

def room_flags() -> Column:
    """Hard eliminations: only an explicit 'no' counts."""
    no = lambda c: F.coalesce(C(c) == F.lit(False), F.lit(False))
    notes = F.lower(F.concat_ws(" ", F.coalesce(C("notes"), F.lit("")), F.coalesce(C("floor_space_notes"), F.lit("")), F.coalesce(C("parking_notes"), F.lit(""))))
    return flags((no("training_use_allowed"), "training_not_allowed"), (no("access_control_possible"), "no_access_control"), (no("camera_allowed"), "no_camera"), (no("wifi"), "bad_wifi"),
                 (no("recurring_available"), "no_recurring"), (notes.rlike("unsafe|no lighting|sketchy at night"), "unsafe_entry"),
                 (notes.rlike("uncooperative|landlord refused|hostile"), "uncooperative"), (notes.rlike("unsuitable|no open floor|fixed seating|pillars block|too small"), "room_unsuitable"))


ROOM_FACTS = {"movable_tables_chairs": 8, "weekend_available": 12, "evening_available": 6, "recurring_available": 12, "wifi": 5, "restroom_access": 5, "ada_access": 4, "training_use_allowed": 8}


def room_fit(df: DataFrame, min_capacity: float = 8.0, max_hourly: float | None = None, max_daily: float | None = None) -> DataFrame:
    """Room score: known facts add, unknown adds nothing, an elimination zeroes."""
    floor, park = F.lower(F.coalesce(C("floor_space_notes"), F.lit(""))), F.lower(F.coalesce(C("parking_notes"), F.lit("")))
    cap = C("capacity")
    rate = F.coalesce(F.when(F.lit(max_hourly is not None) & C("hourly_rate").isNotNull(), C("hourly_rate") <= F.lit(max_hourly or 0.0)),
                      F.when(F.lit(max_daily is not None) & C("daily_rate").isNotNull(), C("daily_rate") <= F.lit(max_daily or 0.0)))
    policy = F.trim(F.coalesce(C("cancellation_policy"), F.lit(""))) != ""
    pts = lambda c, v: F.when(c, float(v)).otherwise(0.0)
    score = pts(cap >= max(min_capacity, 6.0), 15) + pts(floor.rlike("open floor|manikin|movable|flexible|clear space"), 12) + total([pts(C(k), v) for k, v in ROOM_FACTS.items()]) \
        + pick((park.rlike("free|lot|ample|garage|available|good"), 6.0), (park.contains("street"), 2.0), default=0.0) + F.when(rate, 7.0).when(~rate, -8.0).otherwise(0.0) + pts(policy, 3)
    known = total([x.cast("int") for x in (cap.isNotNull(), floor != "", park != "", rate.isNotNull(), policy)] + [C(k).isNotNull().cast("int") for k in ROOM_FACTS])
    out = stages(df, {"eliminations": room_flags(), "_s": score, "_k": known})
    return out.withColumns({"classroom_fit_score": F.when(F.size("eliminations") > 0, 0.0).otherwise(rnd(clamp(C("_s")), 1)),
                            "confidence_score": rnd(F.least(F.lit(100.0), C("_k") * 10.0), 1), "eliminations": joined(C("eliminations"))}).drop("_s", "_k")


def room_readiness(rooms: DataFrame, keys: list[str]) -> DataFrame:
    """Ladder 100/80/60/40/20/0 with stage and counts."""
    st = C("outreach_status")
    ok = (C("eliminations") == "") & ~F.coalesce(st == "REJECTED", F.lit(False))
    agg = rooms.groupBy(*keys).agg(
        n(ok & ((st == "CONFIRMED") | ((st == "GOOD_FIT") & C("recurring_available")))).alias("confirmed"), n(ok & (C("classroom_fit_score") >= 55)).alias("likely"),
        n(ok & (C("source") != "zip_enrichment_signal")).alias("named_rooms"), n(ok & st.isin("TOO_EXPENSIVE", "NO_WEEKEND_ACCESS", "BAD_FLOOR_SPACE")).alias("limited"),
        n(ok & (C("source") == "zip_enrichment_signal")).alias("signals"), n(ok).alias("usable"), F.count("*").alias("pool"))
    score = pick((C("confirmed") > 0, 100.0), (C("likely") >= 2, 80.0), (C("named_rooms") > 0, 60.0), (C("limited") > 0, 40.0), (C("signals") > 0, 20.0), default=0.0)
    stage = pick((C("confirmed") > 0, "Confirmed"), (C("named_rooms") > 0, "Candidate Found"), (C("signals") > 0, "Signal Only"), ((C("pool") > 0) & (C("usable") == 0), "Blocked"), default="No Signal")
    return agg.withColumns({"score": score, "stage": stage, "eliminated": C("pool") - C("usable")})


# --- manual commercial checks ------------------------------------------------------------

def commercial_summary(df: DataFrame) -> DataFrame:
    """Checked spaces per ZIP: rents, parking, classroom fit, readiness.

    ``df``: zip, monthly_rent, available, parking, classroom_fit, updated_at."""
    low = lambda c: F.lower(F.trim(F.coalesce(C(c), F.lit(""))))
    avail, park, fit = low("available"), low("parking"), low("classroom_fit")
    yes = park.isin("yes", "y", "true", "good", "available", "ample", "ok")
    agg = df.where(C("zip").isNotNull()).groupBy("zip").agg(
        F.count("*").alias("space_count"), n(avail.isin("yes", "y", "true", "available", "1")).alias("available_space_count"), F.min("monthly_rent").alias("rent_min"),
        F.max("monthly_rent").alias("rent_max"), rnd(F.avg("monthly_rent"), 0).alias("rent_avg"), n(park != "").alias("_p"), n(yes).alias("_py"), n(fit != "").alias("_f"),
        n(fit.isin("good", "great", "excellent")).alias("_fg"), n(fit.isin("possible", "ok", "fair", "maybe", "limited")).alias("_fp"), F.max(F.when(C("updated_at") != "", C("updated_at"))).alias("updated_at"))
    out = agg.withColumns({
        "parking_summary": pick((C("_p") == 0, "Unknown"), (C("_py") == C("_p"), "Yes"), (C("_py") == 0, "No"), default="Mixed"),
        "classroom_fit_summary": pick((C("_f") == 0, "Unknown"), (C("_fg") > 0, "Good"), (C("_fp") > 0, "Possible"), default="Limited")})
    ready = (C("available_space_count") > 0) & C("parking_summary").isin("Yes", "Mixed") & C("classroom_fit_summary").isin("Good", "Possible")
    return out.withColumn("commercial_ready", ready).drop("_p", "_py", "_f", "_fg", "_fp")


# --- economics and readiness ---------------------------------------------------------------

# fixed values: cost model and default prices
ECONOMICS = {"saas": 25.0, "consumables": 2.0, "payment_fee": 0.03, "fixed": 650.0, "amortization": 420.0, "instructor_per_class": 45.0, "students_per_class": 7.0}
COURSE_PRICE = {"AHA_BLS": 95.0, "ARC_BLS": 85.0, "ARC_CPR_FA_AED": 75.0}
CARD_COST = {"AHA_BLS": 25.0, "ARC_BLS": 20.0, "ARC_CPR_FA_AED": 18.0}
SITE_TARGET = 108


def unit_economics(df: DataFrame, econ: dict[str, float] = ECONOMICS) -> DataFrame:
    """Contribution and break-even of (course, price, card_cost, instructor_cost) rows."""
    per = max(1.0, econ["students_per_class"])
    df = df.withColumn("variable_cost", rnd(C("card_cost") + econ["saas"] + econ["consumables"] + econ["payment_fee"] * C("price"), 2))
    df = stages(df, {"contribution": rnd(C("price") - C("variable_cost") - C("instructor_cost") / per, 2)})
    fixed = econ["fixed"] + econ["amortization"]
    df = stages(df, {"break_even_students": F.when(C("contribution") > 0, rnd(F.lit(fixed) / C("contribution"), 1))})
    return df.withColumns({"contribution_pct": F.when(C("price") > 0, rnd(100.0 * C("contribution") / C("price"), 1)), "break_even_classes": rnd(C("break_even_students") / per, 1)})


def monthly_pnl(df: DataFrame, econ: dict[str, float] = ECONOMICS) -> DataFrame:
    """Profit and loss at a monthly volume (``students`` column)."""
    s = C("students")
    revenue = C("price") * s
    cost = F.coalesce(C("card_cost"), F.lit(18.0)) * s + (econ["saas"] + econ["consumables"]) * s + econ["payment_fee"] * revenue \
        + C("instructor_cost") * s / max(1.0, econ["students_per_class"]) + econ["fixed"] + econ["amortization"]
    return df.withColumns({"revenue": rnd(revenue, 2), "total_cost": rnd(cost, 2), "net_profit": rnd(revenue - cost, 2),
                           "net_margin_pct": F.when(revenue > 0, rnd(100.0 * (revenue - cost) / revenue, 1))})


def site_economics(zips: DataFrame, supply: DataFrame, demand: DataFrame) -> DataFrame:
    """Per ZIP and course: price (competitor median, else default), break-even and
    the easiest course against real monthly students."""
    med = supply.groupBy("zip").agg(F.max(F.when(C("course_type") == "BLS", C("median_price"))).alias("bls"), F.max(F.when(C("course_type") == "CPR", C("median_price"))).alias("cpr"))
    rows = zips.select("zip").join(med, "zip", "left").withColumn("course", F.explode(F.array(*[F.lit(c) for c in COURSE_PRICE])))
    market = nonzero(F.when(C("course") == "ARC_CPR_FA_AED", C("cpr")).otherwise(C("bls")))
    rows = rows.withColumns({"price": F.coalesce(market, lookup(C("course"), COURSE_PRICE)), "price_source": F.when(market.isNotNull(), "competitor_median").otherwise("default"),
                             "card_cost": lookup(C("course"), CARD_COST), "instructor_cost": F.lit(ECONOMICS["instructor_per_class"])})
    u = unit_economics(rows)
    order = F.when(C("break_even_students").isNotNull(), F.struct("break_even_students", "course"))
    best = u.groupBy("zip").agg(F.min(order).alias("b"))
    d = best.join(demand.select(C("home_zip").alias("zip"), "student_count"), "zip", "left").withColumn("per_month", rnd(C("student_count") / 6.0, 1))
    return d.select("zip", C("b.course").alias("easiest_course"), C("b.break_even_students").alias("break_even_students"), "per_month",
                    F.bround(100.0 * C("per_month") / C("b.break_even_students"), 0).alias("demand_vs_break_even_pct"), (C("per_month") >= C("b.break_even_students")).alias("clears_break_even"),
                    (C("per_month") >= SITE_TARGET).alias("meets_company_target"))


READINESS_WEIGHTS = {"OVERALL": (0.40, 0.25, 0.25, 0.10), "ARC_BLS": (0.40, 0.25, 0.25, 0.10), "ARC_CPR_FA_AED": (0.40, 0.25, 0.25, 0.10), "AHA_BLS": (0.35, 0.40, 0.15, 0.10)}


def economics_penalty(pct: Column) -> Column:
    cover = clamp(pct / 100.0, 0, 1)
    return F.when(pct.isNotNull() & (cover < 1), rnd((1.0 - cover) * 15.0, 1)).otherwise(0.0)


def course_readiness(df: DataFrame) -> DataFrame:
    """Demand, instructors, rooms and proof to feasibility and the next action for
    four course views.

    Reads: base_demand, bls_demand, cpr_demand, instructor_score, room_score, proof,
    saturation_penalty, cannibalization, demand_vs_break_even_pct, weekly_signups, total_signups, risk_flags."""
    x = df.withColumn("course", F.explode(F.array(*[F.lit(c) for c in READINESS_WEIGHTS])))
    tilt = pick((C("course").isin("AHA_BLS", "ARC_BLS"), C("bls_demand")), (C("course") == "ARC_CPR_FA_AED", C("cpr_demand")))
    demand = F.coalesce(F.when(C("base_demand").isNotNull() & tilt.isNotNull(), rnd(0.5 * C("base_demand") + 0.5 * tilt, 1)), rnd(C("base_demand"), 1), tilt)
    x = stages(x, {"demand": demand, "penalty": rnd(zero(C("saturation_penalty")) + zero(C("cannibalization")), 1) + economics_penalty(C("demand_vs_break_even_pct"))})
    weight = lambda i: lookup(C("course"), {c: w[i] for c, w in READINESS_WEIGHTS.items()})
    raw = C("demand") * weight(0) + C("instructor_score") * weight(1) + C("room_score") * weight(2) + F.coalesce(C("proof"), F.lit(50.0)) * weight(3) - C("penalty")
    x = stages(x, {"feasibility": rnd(clamp(raw), 1)})
    passed = (F.coalesce(C("weekly_signups"), F.lit(0)) > 5) | (F.coalesce(C("total_signups"), F.lit(0)) >= 10)
    d, i, r = C("demand"), C("instructor_score"), C("room_score")
    action = pick((d.isNull(), "RESEARCH_NEEDED"), (d < 40, "NOT_READY_DEMAND_WEAK"), (i <= 0, "NOT_READY_NO_INSTRUCTOR"), (i < 80, "INSTRUCTOR_OUTREACH_NEEDED"), (r <= 0, "NOT_READY_NO_SPACE"),
                  (r < 80, "SPACE_OUTREACH_NEEDED"), (passed & (C("feasibility") >= 85) & (C("risk_flags") == ""), "PERMANENT_CENTER_CANDIDATE"), (passed, "RECURRING_CLASS_CANDIDATE"),
                  (d < 55, "RESEARCH_NEEDED"), default="TEST_CLASS_READY")
    missing = F.array_compact(F.array(
        pick((d.isNull(), "demand_not_modeled"), (d < 40, "sufficient_demand")), pick((i <= 0, "any_instructor"), (i < 65, "named_instructor"), (i < 80, "verified_instructor")),
        pick((r <= 0, "any_room"), (r < 60, "specific_room"), (r < 80, "confirmed_room"))))
    return x.withColumns({"action": action, "missing": joined(missing)})


def posting_urgency(instructor: Column, pct: Column, students: Column) -> Column:
    i = F.coalesce(instructor, F.lit(100.0))
    s = pick((i < 50, 2), (i < 80, 1), default=0) + pick((pct >= 100, 2), (pct >= 40, 1), default=0) + F.when(students >= 20, 1).otherwise(0)
    return pick((s >= 3, "high"), (s >= 1, "medium"), default="low")


def zip_signals_as_leads(df: DataFrame) -> DataFrame:
    """Institution counts as lead rows (one per kind with at least one)."""
    kinds = {"nursing_school_count": "NURSING_PROFESSOR", "training_school_count": "EMT_INSTRUCTOR", "health_program_school_count": "UNKNOWN_HEALTHCARE_TRAINER",
             "hospital_count": "HOSPITAL_EDUCATOR", "competitor_count": "CPR_BUSINESS_OWNER"}
    rows = F.array(*[F.struct(F.lit(v).alias("candidate_type"), F.coalesce(C(k).cast("int"), F.lit(0)).alias("institutions")) for k, v in kinds.items()])
    return df.select("zip", F.explode(rows).alias("r")).select("zip", "r.*").where(C("institutions") >= 1)
