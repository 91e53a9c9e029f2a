"""SQL text of the domain tables and small snippets for the checking queries.

The checking SQL is written apart from the DataFrame operators on purpose: it
spells each rule out in plain ANSI SQL so the two can disagree.
"""

from __future__ import annotations

VIEWS = {
    "v_class": """
 SELECT l.l_orderkey * 10 + l.l_linenumber AS class_id,
  CASE l.l_partkey % 8
    WHEN 0 THEN 'AHA BLS Provider' WHEN 1 THEN 'Red Cross Basic Life Support'
    WHEN 2 THEN 'Red Cross First Aid/CPR/AED' WHEN 3 THEN 'AHA Heartsaver CPR'
    WHEN 4 THEN 'ACLS Provider' WHEN 5 THEN 'Red Cross BLS Skills Session'
    WHEN 6 THEN 'Adult First Aid/CPR/AED Blended' ELSE 'Group Training' END AS class_name,
  CAST(l.l_shipdate AS DATE) AS class_date,
  CASE WHEN l.l_returnflag = 'R' THEN 0 WHEN l.l_linenumber = 5 THEN NULL
       ELSE CAST(l.l_quantity AS INT) END AS enrolled,
  CASE WHEN l.l_linenumber = 4 THEN NULL WHEN l.l_linenumber = 3 THEN 0 ELSE 40 END AS capacity,
  CAST(l.l_partkey % 90 + 40 AS DOUBLE) AS price,
  CASE o.o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Scheduled' ELSE 'Cancelled' END AS status,
  n.n_name AS city, r.r_name AS state,
  CASE WHEN l.l_suppkey % 11 = 0 THEN NULL ELSE lpad(CAST(l.l_suppkey AS VARCHAR), 5, '0') END AS zip
 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
 JOIN supplier s ON l.l_suppkey = s.s_suppkey
 JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    # typed class records: the eight titles and their course types, listed out
    "c": """
 SELECT v.*, strftime(class_date, '%Y-%m') AS month,
  CASE WHEN isodow(class_date) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_part,
  CASE status WHEN 'Cancelled' THEN true ELSE false END AS cancelled,
  CASE class_name WHEN 'AHA BLS Provider' THEN 'aha_bls' WHEN 'Red Cross Basic Life Support' THEN 'arc_bls'
   WHEN 'Red Cross First Aid/CPR/AED' THEN 'arc_cpr' WHEN 'AHA Heartsaver CPR' THEN 'aha_cpr'
   WHEN 'ACLS Provider' THEN 'acls' WHEN 'Red Cross BLS Skills Session' THEN 'skills_session'
   WHEN 'Adult First Aid/CPR/AED Blended' THEN 'cpr_first_aid_blended' ELSE 'unknown_course_type' END AS course_type,
  CASE class_name WHEN 'AHA BLS Provider' THEN 'AHA_BLS' WHEN 'Red Cross Basic Life Support' THEN 'ARC_BLS'
   WHEN 'Red Cross First Aid/CPR/AED' THEN 'ARC_CPR' WHEN 'AHA Heartsaver CPR' THEN 'ARC_CPR'
   WHEN 'Red Cross BLS Skills Session' THEN 'ARC_BLS' WHEN 'Adult First Aid/CPR/AED Blended' THEN 'ARC_CPR'
   ELSE 'OTHER' END AS bucket,
  CASE class_name WHEN 'AHA BLS Provider' THEN 'aha_bls' WHEN 'Red Cross Basic Life Support' THEN 'arc_bls'
   WHEN 'Red Cross First Aid/CPR/AED' THEN 'arc_cpr' WHEN 'Red Cross BLS Skills Session' THEN 'arc_bls' END AS decision
 FROM v_class v""",
    "held": "SELECT * FROM c WHERE enrolled > 0 AND NOT cancelled AND (month IS NULL OR month < '2001-01')",
    "v_centroid": """
 SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS zip,
  CAST(37000 + s_suppkey * 7919 % 600 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lat,
  CAST(-122300 + s_suppkey * 104729 % 600 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lng FROM supplier""",
    "v_point": """
 SELECT c_custkey AS point_id, c_name AS name, c_mktsegment AS category, c_acctbal AS score,
  CASE WHEN c_custkey % 97 = 0 THEN NULL
       ELSE CAST(370000 + c_custkey * 3571 % 6500 AS DOUBLE) / CAST(10000 AS DOUBLE) END AS lat,
  CAST(-1223000 + c_custkey * 7457 % 6500 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lng FROM customer""",
    "v_zip_signal": """
 SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS zip,
  CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE CAST(500 + s_suppkey * 977 % 60000 AS DOUBLE) END AS population,
  CASE WHEN s_suppkey % 17 = 0 THEN 0 ELSE CAST(1 + s_suppkey % 29 AS DOUBLE) END AS land_sqmi,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(40000 + s_suppkey * 1543 % 120000 AS DOUBLE) END AS median_household_income,
  CAST(55 + s_suppkey % 26 AS DOUBLE) / CAST(100 AS DOUBLE) AS working_age_share,
  CAST(50 + s_suppkey * 3 % 26 AS DOUBLE) / CAST(100 AS DOUBLE) AS employment_rate,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(5 + s_suppkey % 21 AS DOUBLE) / CAST(100 AS DOUBLE) END AS healthcare_employment_share,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey % 26 AS DOUBLE) END AS competitor_count
 FROM supplier""",
    "v_poi": """
 SELECT p_partkey AS place_id, concat(p_name, ' ', CASE p_size % 6 WHEN 0 THEN 'hospital'
    WHEN 1 THEN 'urgent care' WHEN 2 THEN 'nursing school' WHEN 3 THEN 'CPR training'
    WHEN 4 THEN 'parking garage' ELSE 'shopping plaza' END) AS name,
  CASE p_size % 6 WHEN 0 THEN 'hospital'
    WHEN 1 THEN 'urgent care' WHEN 2 THEN 'nursing school' WHEN 3 THEN 'CPR training'
    WHEN 4 THEN 'parking garage' ELSE 'shopping plaza' END AS kind,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(30 + p_partkey % 21 AS DOUBLE) / CAST(10 AS DOUBLE) END AS rating,
  CAST(p_partkey * 37 % 300 AS INT) AS review_count,
  CAST(370000 + p_partkey * 2903 % 6000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lat,
  CAST(-1223000 + p_partkey * 6121 % 6000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lng
 FROM part""",
    "v_student": """
 SELECT event_id AS reg_id, lpad(CAST(user_id % 100 AS VARCHAR), 5, '0') AS home_zip,
  event_id % 2003 AS class_id, event_type AS course,
  concat('Instructor ', CAST(user_id % 17 AS VARCHAR)) AS instructor, CAST(ts AS DATE) AS reg_date FROM events""",
    "v_review": """
 SELECT d.doc_id, concat_ws(' ', ['Parking was hard to find.', 'They canceled my appointment.', 'The instructor was unprepared.', 'Very crowded, took forever.', 'No refund, they keep your money.',
    'The website did not load.', 'Overpriced and not worth it.', 'Nobody helped, the worst.', 'My card never came, the certificate expired.', 'Great class!'][d.doc_id % 10 + 1], d.text) AS text, CASE WHEN b.toxic = 1 THEN 1 WHEN b.quality = 1 THEN 5
    WHEN b.quality = 0 THEN 3 END AS rating FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id""",
    "v_page": "SELECT page_id, url, html AS text FROM pages",
}
NEEDS = {"c": ["v_class"], "held": ["v_class", "c"]}


def extend(name: str, sql: str, needs: list[str] | None = None) -> None:
    """Add a named checking view for use by with_views."""
    VIEWS[name] = sql
    NEEDS[name] = list(needs or [])


def _order(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        for dep in _order(NEEDS.get(name, [])) + [name]:
            if dep not in out:
                out.append(dep)
    return out


def with_views(names: str, body: str, raw: str | None = None, **ctes: str) -> str:
    """WITH the named views (then CTE text and extra CTEs, in order), then the body."""
    parts = [f"{v} AS ({VIEWS[v]})" for v in _order(names.split())]
    parts += [raw] if raw else []
    parts += [f"{k} AS ({v})" for k, v in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


def R(x: str, digits: int) -> str:
    """Round half up on the decimal value (same contract as exprs.rnd)."""
    return f"CAST(round(CAST({x} AS DECIMAL(36,10)), {digits}) AS DOUBLE)"


def CLAMP(x: str, lo: float = 0.0, hi: float = 100.0) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest({float(lo)}, least({float(hi)}, ({x}))) END)"


def RENORM(parts: list[tuple[str, float]]) -> str:
    num = " + ".join(f"coalesce(({x}), 0.0) * {w}" for x, w in parts)
    den = " + ".join(f"(CASE WHEN ({x}) IS NULL THEN 0.0 ELSE {w} END)" for x, w in parts)
    return f"(({num}) / nullif(({den}), 0))"


def SCALE(x: str, lo: float, hi: float) -> str:
    return CLAMP(f"(CAST({x} AS DOUBLE) - {float(lo)}) / {float(hi - lo)} * 100.0")


def LOG_SCALE(x: str, full: float) -> str:
    return CLAMP(f"ln(1.0 + greatest(CAST({x} AS DOUBLE), 0.0) + ({x}) * 0) / ln(1.0 + {float(full)}) * 100.0")


def HAV(a: str, b: str, c: str, d: str, radius: float = 3958.8) -> str:
    h = (f"pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * "
         f"pow(sin(radians({d} - {b}) / 2), 2)")
    return f"(2.0 * {radius} * asin(sqrt(CASE WHEN {h} > 1 THEN 1.0 ELSE {h} END)))"
