"""Signals read out of stored texts: review complaints, page capabilities,
job-posting wording.  Patterns run on whole texts inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.text import words
from demandgrid.functions.exprs import n, pick, stages
from demandgrid.operators.classes import top_per
from demandgrid.operators.pyramid import near_sums

C = F.col

# fixed values: complaint themes
THEMES = {
    "parking": r"\bpark(ing|ed)?\b",
    "scheduling": r"\b(reschedul\w*|cancel\w*|schedul\w*|booking|booked|appointment|enroll\w*|orientation|sign[- ]?up|wait[- ]?list|availability|no openings|fully booked)\b",
    "instructor_quality": r"\b(instructor|teacher|trainer|rude|unprofessional|unprepared|disorganiz\w*|condescending|incompetent|dismissive|didn'?t care|not helpful|unqualified)\b",
    "wait_time": r"\b(wait\w*|crowded|long line|in line|packed|slow|took (forever|too long|hours)|hour(s)? (of )?wait)\b",
    "refund": r"\b(refund\w*|money back|non-?refundable|charged|overcharg\w*|keep(s)? your money|won'?t (give|return) (my )?money)\b",
    "booking_ux": r"\b(website|online (booking|registration|sign)|web ?site|app (was )?(broken|confusing)|couldn'?t (book|register) online|portal)\b",
    "price": r"\b(overpriced|expensive|pricey|too much money|rip[- ]?off|not worth|waste of money|cost too much)\b",
    "customer_service": r"\b(rude|unhelpful|horrible|worst|terrible|awful|avoid|unresponsive|never (called|emailed|got) back|hung up|no one (answered|responded|helped)|disrespect\w*)\b",
    "certification_issues": r"\b(certif\w*|(my )?card (never|didn'?t)|expired|not (AHA|American Heart Association)|didn'?t get (my )?(card|certificate)|invalid)\b",
}
# fixed values: capabilities a page can show
PAGE_SIGNALS = {
    "online_booking": r"\b(book now|register now|register online|enroll now|sign up|reserve (a )?(seat|spot)|checkout|cart|appointment|booking)\b",
    "class_schedule": r"\b(class schedule|course schedule|upcoming classes|training calendar|calendar|schedule a class|schedule your class)\b",
    "pricing": r"(\$\s?\d{2,4}|\b(pricing|prices|tuition|course fee|class fee|fees)\b)",
    "multilingual_support": r"\b(español|espanol|spanish|中文|mandarin|cantonese|tagalog|vietnamese|korean|arabic|hindi|multilingual|language)\b|hreflang=",
    "certification_keywords": r"\b(CPR|BLS|AED|first aid|AHA|American Heart Association|Red Cross|certification|certified|instructor)\b",
    "acls_pals_offered": r"\b(ACLS|PALS|advanced cardiac life support|pediatric advanced life support)\b",
    "group_corporate_offered": r"\b(group (training|classes|rates|booking)|corporate (training|classes|programs)|on-?site (training|classes)|workplace training|employer (training|programs)|company (training|programs))\b",
    "weekend_classes_offered": r"\b(weekend (classes|courses|sessions|availability)|saturday (class|classes|courses)|sunday (class|classes|courses)|evening (classes|courses))\b",
}
CONTACT = r"(mailto:|\btel:|\bcontact\b|\bcall\b|\bphone\b|\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4})"
OUTDATED = r"\b(flash player|under construction|coming soon)\b"
# fixed values: posting wording
CERTIFICATIONS = {"bls": r"\b(BLS|basic life support)\b", "cpr": r"\bCPR\b", "first_aid": r"\bfirst aid\b", "acls": r"\bACLS\b", "pals": r"\bPALS\b",
                  "aha_red_cross": r"\b(AHA|American Heart Association|Red Cross)\b"}
ROLES = {
    "healthcare_role": r"\b(nurse|rn|lvn|lpn|medical assistant|clinician|patient care|hospital|clinic|healthcare)\b",
    "emt_role": r"\b(EMT|paramedic|ambulance)\b",
    "cna_role": r"\b(CNA|certified nursing assistant)\b",
    "caregiver_role": r"\b(caregiver|home health aide|care aide)\b",
    "dental_role": r"\b(dental assistant|dental hygienist|dentist)\b",
    "childcare_role": r"\b(childcare|daycare|preschool|teacher aide)\b",
}


def found(text: Column, pattern: str) -> Column:
    return words(text, "(?i)" + pattern)


def themes(text: Column) -> Column:
    """Labels of the complaint themes a text touches."""
    return F.array_compact(F.array(*[F.when(found(text, p), F.lit(k)) for k, p in THEMES.items()]))


def complaint_summary(reviews: DataFrame) -> DataFrame:
    """Themes over reviews rated three or lower (or unrated), with the first
    example by id.  Only ids and short examples leave the text stage."""
    low = reviews.where((C("rating").isNull() | (C("rating") <= 3)) & found(C("text"), "|".join(THEMES.values())))  # one pass finds the few texts to look at
    hits = low.select("doc_id", F.substring(F.trim("text"), 1, 160).alias("example"), F.explode(themes(C("text"))).alias("theme"))
    return hits.groupBy("theme").agg(F.count("*").alias("reviews"), F.min("doc_id").alias("first_doc"), F.min_by("example", "doc_id").alias("example"))


def review_confidence(df: DataFrame) -> DataFrame:
    k = F.count("*")
    return df.agg(k.alias("reviews_scanned"), n(C("rating") <= 3).alias("negative_reviews"), pick((k >= 12, "high"), (k >= 5, "medium"), default="low").alias("confidence"))


def page_signals(pages: DataFrame, as_of_year: int) -> DataFrame:
    """Capability flags per page; 'outdated' is unknown when no year is shown."""
    t = C("text")
    years = F.transform(F.regexp_extract_all(t, F.lit(r"(20\d{2})"), 1), lambda y: y.cast("int"))
    newest = F.array_max(years)
    outdated = F.when(found(t, OUTDATED), True).when(newest.isNotNull(), newest <= as_of_year - 4)
    return pages.select("page_id", *[F.coalesce(found(t, p), F.lit(False)).alias(k) for k, p in PAGE_SIGNALS.items()],
                        (~F.coalesce(found(t, CONTACT), F.lit(False))).alias("contact_friction"), outdated.alias("outdated_website"))


def signal_sets(flags: DataFrame) -> DataFrame:
    """Detected / missing / unknown signal names per page, sorted."""
    names = [c for c in flags.columns if c != "page_id"]
    # contact friction and an outdated page are findings, the rest are offers
    pick_ = lambda test: F.array_sort(F.array_compact(F.array(*[F.when(test(C(c)), F.lit(c)) for c in names])))
    return flags.select("page_id", F.array_join(pick_(lambda c: c), ",").alias("detected"), F.array_join(pick_(lambda c: ~c), ",").alias("missing"),
                        F.array_join(pick_(lambda c: c.isNull()), ",").alias("unknown"))


def posting_flags(df: DataFrame, text: Column) -> DataFrame:
    flags = {**{f"{k}": found(text, p) for k, p in CERTIFICATIONS.items()}, **{k: found(text, p) for k, p in ROLES.items()}}
    # fenced: the patterns run once per posting, not once per candidate it meets
    out = stages(df, {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    any_cert = F.lit(False)
    for k in CERTIFICATIONS:
        any_cert = any_cert | C(k)
    return out.withColumn("certification", any_cert)


def posting_spots(flags: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Postings of one place, radius and state as one row of counts.

    Copies and bulk postings at one address then meet candidates once."""
    keys = ["jlat", "jlng", "radius", "state", *(extra or [])]
    return flags.groupBy(*keys).agg(F.count("*").alias("postings"), n(C("certification")).alias("certified"), *[n(C(k)).alias(k) for k in [*CERTIFICATIONS, *ROLES]])


def covered(cands: DataFrame, spots: DataFrame, sums: list[str], keys: list[str], max_radius: float) -> DataFrame:
    """Sums over the posting spots that cover each distinct candidate place (own radius,
    state equal when the posting names one).  ``cands``: lat, lng, state."""
    at = cands.where(C("lat").isNotNull()).select("lat", "lng", C("state").alias("c_state")).distinct()
    near = near_sums(at, ("lat", "lng"), spots, ("jlat", "jlng"), sums, keys=["state", *keys], own="radius", max_miles=max_radius)
    met = at.join(near, ["lat", "lng"]).where((F.coalesce(C("state"), F.lit("")) == "") | (C("state") == F.upper("c_state")))
    return met.groupBy("lat", "lng", "c_state", *keys).agg(*[F.sum(c).alias(c) for c in sums])


def _per_candidate(cands: DataFrame, per: DataFrame) -> DataFrame:
    c = cands.where(C("lat").isNotNull()).select("candidate_id", "lat", "lng", "state").alias("c")
    p = per.alias("p")
    same = (C("c.lat") == C("p.lat")) & (C("c.lng") == C("p.lng")) & C("c.state").eqNullSafe(C("p.c_state"))
    return c.join(p, same).select("c.candidate_id", *[f"p.{x}" for x in per.columns if x not in ("lat", "lng", "c_state")])


def posting_demand(cands: DataFrame, flags: DataFrame, max_radius: float) -> DataFrame:
    """Counts per candidate over the postings whose radius covers it."""
    kinds = [*CERTIFICATIONS, *ROLES]
    counts = covered(cands, posting_spots(flags), ["postings", "certified", *kinds], [], max_radius).select(
        "lat", "lng", "c_state", C("postings").alias("active_postings_count"), C("certified").alias("certification_postings_count"), *[C(k).alias(f"{k}_count") for k in kinds])
    name = F.lower(F.trim("employer"))
    who = flags.where(name != "").groupBy("jlat", "jlng", "radius", "state", name.alias("who")).agg(F.count("*").alias("postings"))
    employers = covered(cands, who, ["postings"], ["who"], max_radius).groupBy("lat", "lng", "c_state").agg(F.count("*").alias("unique_employers_count"))
    j = counts.alias("a").join(employers.alias("b"), (C("a.lat") == C("b.lat")) & (C("a.lng") == C("b.lng")) & C("a.c_state").eqNullSafe(C("b.c_state")), "left")
    both = j.select("a.*", F.coalesce("b.unique_employers_count", F.lit(0)).alias("unique_employers_count"))
    return _per_candidate(cands, both)


def top_employers(cands: DataFrame, flags: DataFrame, max_radius: float, limit: int = 10) -> DataFrame:
    who = F.when(F.trim("employer") == "", "unknown").otherwise(F.trim("employer"))
    per = flags.withColumn("who", who).groupBy("jlat", "jlng", "radius", "state", "who").agg(F.count("*").alias("postings"))
    sums = covered(cands, per, ["postings"], ["who"], max_radius).withColumnRenamed("who", "employer")
    return _per_candidate(cands, top_per(sums, ["lat", "lng", "c_state"], [C("postings").desc(), C("employer")], limit, "position"))
