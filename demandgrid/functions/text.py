"""Parsers and classifiers as column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandgrid.functions.exprs import lookup, pick

# --- fixed values: course catalogue (key -> display label) -------------------
COURSE_LABELS = {
    "arc_cpr": "ARC CPR",
    "arc_bls": "ARC BLS",
    "aha_bls": "AHA BLS",
    "aha_cpr": "AHA CPR / Heartsaver",
    "house_bls": "HOUSE BLS",
    "house_cpr": "HOUSE CPR",
    "acls": "ACLS",
    "pals": "PALS",
    "cpr_first_aid_blended": "CPR / First Aid (hybrid)",
    "skills_session": "Skills session",
    "unknown_course_type": "HOUSE",
}
DECISION_COURSES = ["aha_bls", "arc_bls", "arc_cpr"]
BUCKETS = ["ARC_CPR", "ARC_BLS", "AHA_BLS"]
COURSE_BUCKET = {
    "arc_cpr": "ARC_CPR",
    "cpr_first_aid_blended": "ARC_CPR",
    "aha_cpr": "ARC_CPR",
    "arc_bls": "ARC_BLS",
    "aha_bls": "AHA_BLS",
}
# --- end of fixed values ------------------------------------------------------


def low(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def words(text: Column, pattern: str) -> Column:
    """Pattern search whose word classes and boundaries follow Unicode letters, whatever the JDK's default,
    so an accented word is a whole word."""
    return text.rlike("(?U)" + pattern)


def squeeze(c: Column) -> Column:
    """Lower-cased, trimmed, inner whitespace collapsed."""
    return F.trim(F.regexp_replace(low(c), r"\s+", " "))


def provider(name: Column, own_pattern: str = r"\bhouse\b") -> Column:
    """Training brand named in a lower-cased class title, '' when none; the operator's
    own brand is whatever ``own_pattern`` finds, and is called house."""
    return pick(
        (name.rlike(own_pattern), "house"),
        (name.rlike("arc|red cross|redcross"), "arc"),
        (name.rlike("aha|american heart|heartsaver|heartcode|heart association"), "aha"),
        default="",
    )


def title_signals(class_name: Column, own_pattern: str = r"\bhouse\b") -> dict[str, Column]:
    """What a class title mentions; named columns, so each regex runs once."""
    name = low(class_name)
    return {
        "t_name": name,
        "t_brand": provider(name, own_pattern),
        "t_aid": name.rlike(r"first\s*aid"),
        "t_cpr": words(name, r"\bcpr\b|heartsaver"),
        "t_bls": words(name, r"\bbls\b|basic life support"),
    }


def course_type(t: dict[str, Column]) -> Column:
    """Title signals -> one of the catalogue keys (first rule wins)."""
    name, brand, aid, cpr, bls = t["t_name"], t["t_brand"], t["t_aid"], t["t_cpr"], t["t_bls"]
    return pick(
        (name == "", "unknown_course_type"),
        (name.rlike("skills|skill session|rqi"), "skills_session"),
        (words(name, r"\bacls\b|advanced cardiac life support|advanced cardiovascular life support"), "acls"),
        (words(name, r"\bpals\b|pediatric advanced life support"), "pals"),
        ((brand == "arc") & bls, "arc_bls"),
        ((brand == "arc") & (cpr | aid), "arc_cpr"),
        ((brand == "aha") & bls, "aha_bls"),
        ((brand == "aha") & (cpr | aid), "aha_cpr"),
        ((brand == "house") & bls, "house_bls"),
        ((brand == "house") & cpr, "house_cpr"),
        (~bls & (name.contains("blend") | (aid & cpr) | (aid & name.contains("aed"))), "cpr_first_aid_blended"),
        default="unknown_course_type",
    )


def demand_bucket(ctype: Column, t: dict[str, Column]) -> Column:
    """Charted demand channel; a branded BLS skills session is BLS demand."""
    skills_bls = (ctype == "skills_session") & t["t_bls"]
    return pick(
        (skills_bls & (t["t_brand"] == "arc"), "ARC_BLS"),
        (skills_bls & (t["t_brand"] == "aha"), "AHA_BLS"),
        default=F.coalesce(lookup(ctype, COURSE_BUCKET), F.lit("OTHER")),
    )


def decision_course(ctype: Column, t: dict[str, Column]) -> Column:
    """Roll up to the three decision courses, NULL when the title proves none."""
    brand, bls = t["t_brand"], t["t_bls"]
    return pick(
        (ctype.isin(DECISION_COURSES), ctype),
        ((brand == "aha") & bls, "aha_bls"),
        ((brand == "arc") & bls, "arc_bls"),
        ((brand == "arc") & words(t["t_name"], r"\bcpr\b|first\s*aid|\baed\b"), "arc_cpr"),
    )


def cancelled(status: Column) -> Column:
    s = F.lower(status)
    return pick(
        (s.rlike("cancel|void|deleted"), True),
        (s.rlike("complete|held|active|scheduled|confirmed|open"), False),
    )


def course_label(ctype: Column) -> Column:
    return F.coalesce(lookup(ctype, COURSE_LABELS), ctype)


# --- parsers -------------------------------------------------------------------

# fixed values: words that mean "no value"
NA_WORDS = ["", "na", "n/a", "none", "unknown"]
BLANK_WORDS = ["", "na", "n/a", "none", "nan", "null"]

# fixed values: date layouts tried in order after ISO
DATE_LAYOUTS = [
    "M/d/yyyy", "M/d/yy", "M-d-yyyy", "yyyy/M/d",
    "M/d/yy H:mm", "M/d/yy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss",
    "MMM d, yyyy", "MMMM d, yyyy", "d-MMM-yyyy", "d MMM yyyy",
]
_DATE_GUARD = {
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "M/d/yy": r"^\d{1,2}/\d{1,2}/\d{2}$",
    "M-d-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "M/d/yy H:mm": r"^\d{1,2}/\d{1,2}/\d{2} \d{1,2}:\d{2}$",
    "M/d/yy H:mm:ss": r"^\d{1,2}/\d{1,2}/\d{2} \d{1,2}:\d{2}:\d{2}$",
    "M/d/yyyy H:mm": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$",
    "M/d/yyyy H:mm:ss": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$",
    "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
    "MMMM d, yyyy": r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$",
    "d-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
}


def is_blank(c: Column) -> Column:
    return c.isNull() | low(c).isin(BLANK_WORDS)


def parse_number(c: Column) -> Column:
    t = F.regexp_replace(F.trim(c), "[,$]", "")
    value = t.try_cast("double")
    return F.when(~F.lower(t).isin(NA_WORDS) & ~F.isnan(value) & (F.abs(value) != float("inf")), value)


def parse_int(c: Column) -> Column:
    t = F.regexp_replace(F.trim(c), ",", "")
    value = t.try_cast("double")
    ok = ~F.lower(t).isin(NA_WORDS) & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(ok, F.bround(value, 0).cast("bigint"))


def parse_price(c: Column) -> Column:
    return F.round(parse_number(c), 2)


def _pivot(ts: Column, layout: str) -> Column:
    """Two-digit years 69..99 belong to the last century."""
    if "yyyy" in layout:
        return ts.cast("date")
    d = ts.cast("date")
    return F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)


def parse_date(c: Column) -> Column:
    """First layout that fits; anything else is unknown."""
    t = F.trim(c)
    iso = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})(?:[T ].*)?$", 1)
    tries = [F.try_to_timestamp(F.when(iso != "", iso), F.lit("yyyy-MM-dd")).cast("date")]
    for layout in DATE_LAYOUTS:
        # the guard keeps each text away from layouts that only partly fit it
        text = F.when(t.rlike(_DATE_GUARD[layout]), t)
        if "MMM" in layout:
            text = F.initcap(text)
        tries.append(_pivot(F.try_to_timestamp(text, F.lit(layout)), layout))
    return F.coalesce(*tries)


def sortable_date(c: Column) -> Column:
    """M/D/YY, M/D/YYYY or ISO to a date that sorts; unreadable is NULL (lowest)."""
    t = F.trim(c)
    day = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"), F.regexp_extract(t, r"^(\d{1,2}/\d{1,2}/\d{4})", 1))
    short = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{2}(?!\d)"), F.regexp_extract(t, r"^(\d{1,2}/\d{1,2}/\d{2})", 1))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(t, 1, 10))
    return F.coalesce(
        F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"),
        F.try_to_timestamp(day, F.lit("M/d/yyyy")).cast("date"),
        F.try_to_timestamp(short, F.lit("M/d/yy")).cast("date"),
    )


_PAREN = "[（(].*?[)）]"


def location_name(c: Column) -> Column:
    """Place name without parenthetical qualifiers; NULL when nothing is left."""
    t = F.regexp_replace(F.regexp_replace(c, _PAREN, ""), r"\s+", " ")
    t = F.regexp_replace(t, r"^[ \-–·,]+|[ \-–·,]+$", "")
    return F.when(~is_blank(c) & (t != ""), t)


def location_key(c: Column) -> Column:
    """Join key of a place abbreviation."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), _PAREN, ""), r"\s+", " ")))


ADDRESS = r",\s*([A-Za-z .'\-]+?)\s*,\s*([A-Z]{2})\b[,\s]*(\d{5})"


def address_parts(c: Column) -> Column:
    """struct(city, state, zip) out of 'Name(street, City, ST 12345)'."""
    t = F.coalesce(c, F.lit(""))
    hit = F.regexp_extract(t, ADDRESS, 3) != ""
    lead = F.trim(F.regexp_extract(t, "^([^（(]*)", 1))
    return F.struct(
        F.when(hit, F.initcap(F.trim(F.regexp_replace(F.regexp_extract(t, ADDRESS, 1), r"\s+", " "))))
        .otherwise(F.when(lead != "", lead)).alias("city"),
        F.when(hit, F.upper(F.regexp_extract(t, ADDRESS, 2))).alias("state"),
        F.when(hit, F.regexp_extract(t, ADDRESS, 3)).alias("zip"),
    )


def address_zip(c: Column) -> Column:
    """ZIP of a formatted address: at the end, else the last of several."""
    t = F.trim(F.regexp_replace(F.trim(c), r"(?i),?\s*(usa|united states)\.?$", ""))
    tail = F.regexp_extract(t, r"\b(\d{5})(?:-\d{4})?\s*$", 1)
    runs = F.regexp_extract_all(t, F.lit(r"\b(\d{5})(?:-\d{4})?\b"), 1)
    return F.when(tail != "", tail).when(F.size(runs) > 1, F.element_at(runs, -1))


def zip5(c: Column) -> Column:
    """First five-digit run, else whatever digits there are, zero padded."""
    t = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\.0$", "")
    run = F.regexp_extract(t, r"(\d{5})", 1)
    digits = F.regexp_replace(t, r"\D", "")
    return F.when(run != "", run).when(digits != "", F.lpad(digits, 5, "0"))


def lines(c: Column) -> Column:
    """Items of a newline-, comma- or semicolon-separated cell."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[\n;,]+"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def list_cell(c: Column) -> Column:
    """Delimited cell: ';' when present, else '|'."""
    t = F.coalesce(c, F.lit(""))
    parts = F.when(t.contains(";"), F.split(t, ";")).otherwise(F.split(t, r"\|"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


# fixed values: yes/no words of the import files
YES_WORDS = ["yes", "y", "true", "1", "required", "confirmed"]
NO_WORDS = ["no", "n", "false", "0", "not required", "optional"]


def tri_bool(c: Column) -> Column:
    t = low(c)
    return pick((t.isin(YES_WORDS), True), (t.isin(NO_WORDS), False))


def money(c: Column) -> Column:
    """Positive amount, NULL for anything else."""
    v = F.regexp_replace(F.trim(c), "[$,]", "").try_cast("double")
    return F.when(v > 0, v)


def plain_name(c: Column) -> Column:
    """Lower case, everything but letters and digits to single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def name_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(plain_name(c), " "), lambda x: x != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token arrays, 0 when either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared)).otherwise(F.lit(0.0))


def target_line(c: Column, default_state: str) -> Column:
    """struct(place, state): a trailing two-letter part is the state."""
    parts = F.transform(F.split(F.trim(c), ","), lambda x: F.trim(x))
    last = F.element_at(parts, -1)
    has = (F.size(parts) > 1) & last.rlike("^[A-Za-z]{2}$")
    place = F.when(has, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), ", ")).otherwise(F.array_join(parts, ", "))
    return F.struct(place.alias("place"), F.when(has, F.upper(last)).otherwise(F.lit(default_state)).alias("state"))


def has_id(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return (t != "") & ~F.lower(t).isin("nan", "nat", "none", "0", "0.0")


def teachable_courses(aha_id: Column, hsi_id: Column, certificates: Column) -> Column:
    """Courses somebody may be offered for, from ids and certificate wording."""
    t = F.lower(F.coalesce(certificates, F.lit("")))
    arc = t.contains("arc") | t.contains("red cross") | has_id(hsi_id)
    return F.array_compact(F.array(F.when(has_id(aha_id) | t.contains("aha") | t.contains("american heart"), "AHA_BLS"), F.when(arc, "ARC_BLS"), F.when(arc, "ARC_CPR_FA_AED")))


def certification_signals(aha_id: Column, hsi_id: Column, certificates: Column) -> Column:
    ids = F.array_compact(F.array(F.when(has_id(aha_id), "AHA instructor ID on file"), F.when(has_id(hsi_id), "HSI/ASHI instructor ID on file")))
    return F.array_distinct(F.concat(lines(certificates), ids))


def salary(notes: Column) -> Column:
    """'$45' out of '#Salary: $45.' in free notes, else blank."""
    raw = F.regexp_extract(F.coalesce(notes, F.lit("")), r"(?i)#?\s*Salary\s*[:=]\s*\$?\s*([\d,.]+)", 1)
    amount = F.regexp_replace(F.regexp_replace(raw, ",", ""), r"\.+$", "")
    return F.when(amount != "", F.concat(F.lit("$"), amount)).otherwise("")
