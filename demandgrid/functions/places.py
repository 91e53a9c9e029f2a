"""Judging place records by type, name and address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandgrid.functions.exprs import pick

# fixed values: place types that can hold no classroom
NON_COMMERCIAL_TYPES = [
    "transit_station", "transit_depot", "bus_station", "subway_station", "light_rail_station", "train_station", "police", "fire_station", "prison",
    "cemetery", "funeral_home", "embassy", "courthouse", "local_government_office", "post_office", "route", "intersection", "street_address", "premise",
    "subpremise", "natural_feature", "political", "parking", "airport", "storage",
]
COMMERCIAL_TYPES = [
    "shopping_mall", "store", "clothing_store", "convenience_store", "department_store", "electronics_store", "grocery_or_supermarket", "home_goods_store",
    "supermarket", "book_store", "furniture_store", "hardware_store", "drugstore", "pharmacy", "shoe_store", "bicycle_store", "florist", "pet_store",
    "jewelry_store", "liquor_store", "movie_theater", "gym", "hospital", "doctor", "dentist", "physiotherapist", "school", "university", "library", "health",
    "real_estate_agency", "insurance_agency", "lawyer", "accounting",
]
COMMERCIAL_WORDS = [
    "medical office building", "medical office", "medical plaza", "medical center", "medical building", "office building", "office tower", "office plaza",
    "office park", "professional building", "business park", "business center", "corporate center", "training center", "learning center", "education center",
    "executive suites", "retail center", "retail plaza", "shopping plaza", "shopping center", "co-working", "coworking", "wework", "plaza", "mall", "centre",
    "marketplace", "shopping", "center",
]
# fixed values: name patterns of unusable places, and of fake listings
BAD_NAMES = [
    r"\brail\s*yard\b", r"\bswitching\s*yard\b", r"\bintermodal\b", r"\bfreight\s+(depot|terminal|yard)\b", r"\brental\s*car\b", r"\bcar\s+rental\b",
    r"\bsubstation\b", r"\bpower\s+plant\b", r"\b(water|wastewater|sewage)\s+treatment\b", r"\bpumping\s+station\b", r"\blandfill\b", r"\brefinery\b",
    r"\b(oil|gas)\s+terminal\b", r"\bquarry\b", r"\bcorrectional\b", r"\bmilitary\s+base\b", r"\barmory\b", r"\bcustoms\b", r"\bcargo\b",
    r"\bport\s+(authority|terminal)\b", r"\bcell\s+tower\b", r"\bdata\s+center\b", r"\b(distribution|fulfillment)\s+center\b", r"\bnot\s+a\s+public\s+stop\b",
    r"\bparking\s+(lot|garage|structure|deck)\b", r"\bbus\s+(stop|shelter)\b", r"\b(bart|caltrain|amtrak|muni)\s+station\b", r"\b(subway|metro)\s+station\b",
    r"^[2-9CFGHJMPQRVWX]{4,8}\+[2-9CFGHJMPQRVWX]{2,3}\b", r"\bambulance\s+bay\b", r"\bloading\s+dock\b", r"\breceiving\s+(bay|dock|area)\b",
    r"\bemergency\s+(entrance|exit|bay)\b", r"\bservice\s+entrance\b",
]
SPAM_NAMES = [
    r"\bgift\s*cards?\s+generator\b", r"\bfree\b[\w\s'.\-]{0,30}\bgift\s*cards?\b",
    r"\b(free|unlimited)\b[\w\s'.\-]{0,20}\b(generator|robux|v-?bucks|bitcoins?|coins?|gems?|crypto|giveaways?|followers?|likes?|wallet\s+codes?|redeem\s+codes?|promo\s+codes?)\b",
    r"\b(robux|v-?bucks|psn|xbox|steam|itunes|netflix|spotify)\s+(generator|codes?|free|hack)\b", r"\bgiveaways?\b[\w\s'.\-]{0,20}\b(free|bitcoins?|crypto|cash|cards?)\b",
    r"\bno\s+(human\s+)?(survey|verification)\b", r"\b(aimbot|mod\s*apk|cheat\s+codes?)\b", r"\bmake\s+money\s+(fast|online|now|today|from\s+home)\b", r"\b100%\s*free\b",
    r"\bclick\s+here\b",
]
_SUFFIX = r"(?:St|Street|Ave|Avenue|Blvd|Boulevard|Rd|Road|Way|Dr|Drive|Pl|Place|Ln|Lane|Ct|Court|Pkwy|Parkway|Hwy|Highway|Ter|Terrace)"
CROSSING = rf"\b\w[\w'.\- ]*?\s+{_SUFFIX}\.?\s*(?:&|and)\s*\w[\w'.\- ]*?\s+{_SUFFIX}\b"
# fixed values: leasable buildings (first tier) and retail centres (second tier)
SITE_TYPES = ["university", "college", "school", "primary_school", "secondary_school", "doctor", "dentist", "physiotherapist", "medical_lab", "dental_clinic"]
SITE_WORDS = [
    "coworking", "co-working", "wework", "regus", "executive suite", "executive suites", "commercial suite", "office suite", "medical office building",
    "medical office", "medical building", "medical plaza", "medical center", "medical arts", "office building", "office tower", "office park", "office plaza",
    "professional building", "professional center", "professional plaza", "training center", "training centre", "learning center", "education center",
    "career center", "conference center", "community center", "community centre", "college", "university", "campus",
]
PLAZA_TYPES = ["shopping_mall"]
PLAZA_WORDS = [
    "shopping plaza", "shopping center", "shopping centre", "shopping mall", "retail center", "retail plaza", "retail park", "power center", "business park",
    "business center", "business plaza", "commerce center", "commercial center", "commercial plaza", "commercial park", "town center", "town centre",
    "marketplace", "market place", "galleria", "outlets", "outlet center", "plaza", "mall", "centre",
]
ANCHOR_QUALITY = {"verified_commercial_site": 90, "commercial_plaza": 70, "area_proxy": 45, "invalid_anchor": 8}


def _first_shared(types: Column, names: list[str]) -> Column:
    """Alphabetically first type both lists hold."""
    low = F.transform(F.coalesce(types, F.array().cast("array<string>")), lambda t: F.lower(t))
    shared = F.array_sort(F.array_intersect(low, F.array(*[F.lit(x) for x in names])))
    return F.try_element_at(shared, F.lit(1))


def _longest_word(name: Column, words: list[str]) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    ordered = sorted(words, key=len, reverse=True)
    return pick(*[(low.contains(w), w) for w in ordered])


def viability_reason(types: Column, name: Column, address: Column) -> Column:
    """Why a place cannot anchor a site; NULL when it can."""
    t = F.trim(F.coalesce(name, F.lit("")))
    bad_type = _first_shared(types, NON_COMMERCIAL_TYPES)
    addr = F.lower(F.coalesce(address, F.lit("")))
    return F.coalesce(
        F.when(bad_type.isNotNull(), F.concat(F.lit("type:"), bad_type)), F.when(t.rlike("(?i)" + "|".join(SPAM_NAMES)), "spam_listing"),
        F.when(t.rlike("(?i)" + "|".join(BAD_NAMES)), "bad_name"), F.when(t.rlike("(?i)" + CROSSING), "intersection"),
        F.when(addr.rlike("rail yard|freight terminal"), "bad_address"))


def commercial_signal(types: Column, name: Column) -> Column:
    """Commercial type, else the longest commercial word in the name."""
    return F.coalesce(_first_shared(types, COMMERCIAL_TYPES), _longest_word(name, COMMERCIAL_WORDS))


def anchor_status(types: Column, name: Column, address: Column) -> Column:
    shared = lambda names: _first_shared(types, names).isNotNull()
    word = lambda words: _longest_word(name, words).isNotNull()
    return pick((viability_reason(types, name, address).isNotNull(), "invalid_anchor"), (shared(SITE_TYPES) | word(SITE_WORDS), "verified_commercial_site"),
                (shared(PLAZA_TYPES) | word(PLAZA_WORDS), "commercial_plaza"), default="area_proxy")


def matches(types: Column, name: Column, want_types: list[str], words: list[str]) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w)
    if want_types:
        hit = hit | F.coalesce(F.arrays_overlap(types, F.array(*[F.lit(t) for t in want_types])), F.lit(False))
    return hit


def area_name(city: Column, state: Column, neighborhood: Column, address: Column) -> Column:
    """Neighbourhood, street corridor, then city and state."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    c, s, nb = blank(city), blank(state), blank(neighborhood)
    street = F.trim(F.regexp_replace(F.trim(F.element_at(F.split(blank(address), ","), 1)), r"^\s*\d+[A-Za-z]?\s+", ""))
    street = F.when(~F.lower(street).isin("n", "s", "e", "w", "ne", "nw", "se", "sw", ""), street)
    return pick(((nb != "") & (c != ""), F.concat(nb, F.lit(", "), c)), (nb != "", nb), (street.isNotNull() & (c != ""), F.concat(c, F.lit(" — "), street, F.lit(" corridor"))),
                ((c != "") & (s != ""), F.concat(c, F.lit(", "), s, F.lit(" area"))), (c != "", c), (s != "", s), default="Candidate area")


def source_quality(name: Column, url: Column) -> Column:
    t, u = F.lower(F.coalesce(name, F.lit(""))), F.coalesce(url, F.lit(""))
    return pick((t.rlike("stub|not yet integrated"), "stub"), (t.contains("manual rent override"), "manual_override"), (t.rlike("job postings csv|job posting"), "manual_public_csv"),
                (t.rlike("census|bls"), "official"), (t.rlike("google places|google geocoding"), "platform_api"),
                (t.contains("competitor website") | u.startswith("http://") | u.startswith("https://"), "web_fetch"), (u != "", "external"), default="unknown")


# fixed values: source family by name part, first hit wins
FAMILIES = [("nearby search", "Google Places Nearby Search"), ("text search", "Google Places Text Search"), ("place details", "Google Places Details"), ("geocod", "Google Geocoding"),
            ("competitor website", "Competitor Website Fetch"), ("census", "Census ACS"), ("acs", "Census ACS"), ("job posting", "Job Postings CSV"), ("rent override", "Rent Override"),
            ("manual rent", "Rent Override"), ("bls", "BLS / Labor Market"), ("labor", "BLS / Labor Market")]


def source_family(name: Column) -> Column:
    t = F.lower(F.coalesce(name, F.lit("")))
    return pick(*[(t.contains(k), v) for k, v in FAMILIES], default=F.coalesce(name, F.lit("Other source")))


def clean_url(url: Column) -> Column:
    """URL without query parameters that can carry secrets."""
    parts = F.split(F.coalesce(url, F.lit("")), r"\?", 2)
    query = F.element_at(F.split(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), "#", 2), 1)
    frag = F.regexp_extract(F.coalesce(url, F.lit("")), r"(#.*)$", 1)
    secret = r"(?i)^(key|api_key|apikey|signature|[^=]*token[^=]*|[^=]*secret[^=]*|[^=]*_key)(=|$)"
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(secret)), "&")
    base = F.element_at(F.split(F.element_at(parts, 1), "#", 2), 1)
    return F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), frag)


# fixed values: words that make a place a healthcare site, a training school or a competitor
HEALTHCARE_TYPES = ["hospital", "doctor", "physiotherapist", "medical_lab", "wellness_center", "skilled_nursing_facility"]
HEALTHCARE_WORDS = [
    "hospital", "urgent care", "clinic", "medical center", "medical centre", "medical group", "doctor", "physician", "health center", "health centre",
    "family medicine", "primary care", "pediatric", "cardiology", "dialysis", "surgery center", "nursing home", "nursing facility", "skilled nursing",
    "rehabilitation center",
]
TRAINING_WORDS = [
    "cpr", "bls", "acls", "pals", "first aid", "life support", "nursing school", "school of nursing", "nursing program", "emt", "emergency medical technician",
    "paramedic", "medical assistant", "phlebotomy", "cna ", "certified nursing assistant", "allied health", "health science", "vocational", "community college",
]
COMPETITOR_WORDS = ["cpr", "bls", "acls", "pals", "first aid", "basic life support", "advanced cardiac life support", "aha training", "red cross training", "heartsaver"]
