"""Registered queries: history against model, QA, course evaluation, text signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandgrid.functions import text as T
from demandgrid.functions.exprs import lookup, rnd, rnd_far
from demandgrid.operators import classes as K
from demandgrid.operators import evaluation as E
from demandgrid.operators import geo as G
from demandgrid.operators import history as H
from demandgrid.operators import quality as Q
from demandgrid.operators import texts as X
from demandgrid.operators.ranks import global_rank
from demandgrid.plans import q_candidates, q_zips  # noqa: F401  (their checking views are used below)
from demandgrid.plans import views as V
from demandgrid.plans.q_classes import AVG2, FILL, _ES, held
from demandgrid.plans.q_modeled import layer, model, prio
from demandgrid.plans.registry import query
from demandgrid.plans.sql import CLAMP, HAV, R, RENORM, extend, with_views
from demandgrid.plans.zip_table import zips
from demandgrid.session import ensure_checkpoint_dir

C = F.col

# --- history vs model ---------------------------------------------------------------

_tot = "coalesce(total_students, nullif(class_count, 0) * nullif(avg_students, 0))"
_k = "nullif(class_count, 0)"
PROVEN = layer("v_zip", {
    "proven_demand_score": R(RENORM([(CLAMP("nullif(avg_students, 0) * 100.0 / 12"), 0.30), (CLAMP(f"{_tot} * 100.0 / 300"), 0.25), (CLAMP("fill_rate * 100.0 / 80"), 0.20),
                                     (f"CASE WHEN {_k} < 5 THEN 40.0 * class_count / 5 WHEN {_k} < 20 THEN 40 + (class_count - 5) * 35.0 / 15 WHEN {_k} < 50 THEN 75 + (class_count - 20) * 25.0 / 30 WHEN {_k} >= 50 THEN 100.0 END", 0.15)]), 1),
    "historical_confidence": "CASE WHEN coalesce(class_count, 0) < 5 THEN 'low' WHEN class_count < 20 THEN 'medium' ELSE 'high' END", "proven_total_students": R(_tot, 1)},
    {f"proven_{c}_s": R(f"coalesce(least(100.0, coalesce({c}_students, 0) * 100.0 / 150), 0) * CASE historical_confidence WHEN 'low' THEN 0.65 WHEN 'medium' THEN 0.85 ELSE 1.0 END", 1) for c in ("arc_cpr", "arc_bls", "aha_bls")},
    {"tt": "coalesce(arc_cpr_students, 0) + coalesce(arc_bls_students, 0) + coalesce(aha_bls_students, 0)", "mx": "greatest(coalesce(arc_cpr_students, 0), coalesce(arc_bls_students, 0), coalesce(aha_bls_students, 0))"},
    {"best_historical_course": "CASE WHEN tt > 0 THEN CASE WHEN coalesce(arc_cpr_students, 0) = mx THEN 'arc_cpr' WHEN coalesce(arc_bls_students, 0) = mx THEN 'arc_bls' ELSE 'aha_bls' END END",
     "share_cpr": R("coalesce(coalesce(arc_cpr_students, 0) / nullif(tt, 0), 0)", 3)})
extend("proven", PROVEN, ["v_zip"])


HIST = ["zip", "avg_students", "total_students", "class_count", "fill_rate", "arc_cpr_students", "arc_bls_students", "aha_bls_students", "demand_score"]


def history(spark, sf):
    return zips(spark, sf).select(*HIST)


@query("m30_proven_demand", with_views("proven", "SELECT zip, proven_demand_score, historical_confidence, proven_total_students, proven_arc_cpr_s AS proven_arc_cpr_score, proven_aha_bls_s AS proven_aha_bls_score, best_historical_course, share_cpr AS mix_arc_cpr FROM proven"))
def _(spark, sf):
    return H.proven_demand(history(spark, sf)).select("zip", "proven_demand_score", "historical_confidence", "proven_total_students", "proven_arc_cpr_score", "proven_aha_bls_score",
                                                      "best_historical_course", "mix_arc_cpr")


@query("c25_history_components", with_views("v_zip", f"""SELECT zip, {R(f"CASE WHEN class_count <= 0 THEN 0 WHEN class_count < 5 THEN 40.0 * class_count / 5 WHEN class_count < 20 THEN 40 + (class_count - 5) * 35.0 / 15 WHEN class_count < 50 THEN 75 + (class_count - 20) * 25.0 / 30 WHEN class_count >= 50 THEN 100 END", 4)} AS class_score,
 CASE WHEN historical_status = 'has_history' THEN 80.0 WHEN historical_status = 'no_history' THEN 30.0 END::DOUBLE AS trend FROM v_zip"""))
def _(spark, sf):
    words = lookup(C("historical_status"), {"has_history": "Growing fast", "no_history": "in decline, decreasing"})
    return zips(spark, sf).select("zip", rnd(H.class_count_score(C("class_count")), 4).alias("class_score"), H.trend_score(words).alias("trend"))


_b = lambda x: f"CASE WHEN {x} >= 65 THEN 'high' WHEN {x} >= 45 THEN 'medium' WHEN {x} IS NOT NULL THEN 'low' ELSE 'missing' END"
VALID = f"""SELECT *, CASE WHEN overall IS NULL OR pd IS NULL OR hc = 'low' THEN 'insufficient_history' WHEN mb = 'high' AND pb = 'high' THEN 'model_agrees_high' WHEN mb = 'low' AND pb = 'low' THEN 'model_agrees_low'
 WHEN mb = 'high' AND pb = 'low' THEN 'model_overpredicts' WHEN mb = 'low' AND pb = 'high' THEN 'model_underpredicts' WHEN mb = 'medium' AND pb = 'high' THEN 'hidden_opportunity' WHEN mb = 'high' THEN 'test_carefully' ELSE 'mixed' END AS model_agreement_v,
 CASE WHEN overall IS NULL OR cs IS NULL THEN 'no_overlap' WHEN overall >= 60 AND cs < 30 THEN 'false_positive' WHEN overall < 40 AND cs >= 60 THEN 'false_negative' WHEN overall >= 60 AND cs >= 60 THEN 'confirmed_high' WHEN overall < 40 AND cs < 30 THEN 'confirmed_low' ELSE 'mixed' END AS validation_case
 FROM (SELECT m.zip, m.overall, m.bls_demand, m.cpr_demand, p.* EXCLUDE zip, p.proven_demand_score AS pd, p.historical_confidence AS hc, coalesce(p.proven_demand_score, p.demand_score) AS cs, {_b('m.overall')} AS mb, {_b('p.proven_demand_score')} AS pb FROM modeled m JOIN proven p ON m.zip = p.zip)"""
extend("valid", VALID, ["modeled", "proven"])


def valid_rows(spark, sf):
    return H.validation_rows(model(spark, sf).select("zip", "overall", "bls_demand", "cpr_demand"), history(spark, sf))


@query("m31_model_agreement", with_views("valid", f"SELECT zip, {R('pd - overall', 1)} AS model_error, model_agreement_v AS model_agreement FROM valid"))
def _(spark, sf):
    return valid_rows(spark, sf).select("zip", "model_error", "model_agreement")


@query("m32_validation_case", with_views("valid", "SELECT validation_case, count(*) AS zips FROM valid GROUP BY 1"))
def _(spark, sf):
    return valid_rows(spark, sf).groupBy("validation_case").agg(F.count("*").alias("zips"))


@query("j07_modeled_with_history", with_views("valid", "SELECT zip, overall, proven_demand_score, historical_confidence, validation_case FROM valid"))
def _(spark, sf):
    return valid_rows(spark, sf).select("zip", "overall", "proven_demand_score", "historical_confidence", "validation_case")


_pairs = [(k, a, b.replace("_score", "_s") if b.startswith("proven_a") else b) for k, a, b in H.METRIC_PAIRS]
PAIRS = " UNION ALL ".join(f"SELECT '{k}' AS metric, {a} AS x, {b} AS y FROM valid WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for k, a, b in _pairs)
_fitq = f"""SELECT metric, count(*) AS sample_size, {R("sum((x-ax)*(y-ay)) / sqrt(sum((x-ax)*(x-ax)) * sum((y-ay)*(y-ay)))", 4)} AS correlation,
 {R("pow(sum((x-ax)*(y-ay)), 2) / (sum((x-ax)*(x-ax)) * sum((y-ay)*(y-ay)))", 4)} AS r2, {R("sum((x-ax)*(y-ay)) / sum((x-ax)*(x-ax))", 4)} AS slope,
 {R("max(ay) - sum((x-ax)*(y-ay)) / sum((x-ax)*(x-ax)) * max(ax)", 4)} AS intercept FROM (SELECT *, avg(x) OVER (PARTITION BY metric) AS ax, avg(y) OVER (PARTITION BY metric) AS ay FROM prs) GROUP BY 1"""


@query("a54_backtest_metrics", with_views("valid", _fitq, prs=PAIRS))
def _(spark, sf):
    return H.backtest_metrics(valid_rows(spark, sf))


@query("a54_agreement_summary", with_views("valid", "SELECT model_agreement_v AS model_agreement, count(*) AS zips FROM valid GROUP BY 1"))
def _(spark, sf):
    return valid_rows(spark, sf).groupBy("model_agreement").agg(F.count("*").alias("zips"))


@query("u03_key_intersection", with_views("v_zip prof", "SELECT zip FROM v_zip INTERSECT SELECT zip FROM prof"))
def _(spark, sf):
    return zips(spark, sf).select("zip").intersect(held(spark, sf).select("zip"))


_SIGNALS = ["population", "median_household_income", "hospital_count", "healthcare_facility_count", "demand_score"]
_sigs = " UNION ALL ".join(f"SELECT '{s}' AS signal, {s} AS x, fill_rate AS y FROM v_zip WHERE {s} IS NOT NULL AND fill_rate IS NOT NULL" for s in _SIGNALS)
_corr = lambda a, b: f"sum(({a}-m{a})*({b}-m{b})) / sqrt(sum(({a}-m{a})*({a}-m{a})) * sum(({b}-m{b})*({b}-m{b})))"


@query("r05_signal_backtest", with_views("v_zip", f"""SELECT signal, count(*) AS n, {R(_corr('x', 'y'), 6)} AS pearson, {R(_corr('rx', 'ry'), 6)} AS spearman,
 CASE WHEN abs({_corr('rx', 'ry')}) >= 0.7 THEN 'strong' WHEN abs({_corr('rx', 'ry')}) >= 0.4 THEN 'moderate' WHEN abs({_corr('rx', 'ry')}) >= 0.2 THEN 'weak' ELSE 'negligible' END AS strength,
 CASE WHEN {_corr('rx', 'ry')} >= 0 THEN 'positive' ELSE 'negative' END AS direction
FROM (SELECT *, {", ".join(f"avg({c}) OVER (PARTITION BY signal) AS m{c}" for c in ("x", "y", "rx", "ry"))} FROM (
 SELECT *, rank() OVER (PARTITION BY signal ORDER BY x) + (count(*) OVER (PARTITION BY signal, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY signal ORDER BY y) + (count(*) OVER (PARTITION BY signal, y) - 1) / 2.0 AS ry FROM s)) GROUP BY 1""", s=_sigs))
def _(spark, sf):
    return H.signal_backtest(zips(spark, sf), _SIGNALS, "fill_rate")


@query("j09_history_status", with_views("v_zip prof", "SELECT z.zip, CASE WHEN p.zip IS NULL THEN 'no_history' ELSE 'has_history' END AS historical_status FROM v_zip z LEFT JOIN prof p ON z.zip = p.zip"))
def _(spark, sf):
    return H.history_status(zips(spark, sf).select("zip"), held(spark, sf).where("zip IS NOT NULL").select("zip"))


@query("j10_history_with_modeled", with_views("prof modeled", "SELECT p.zip, p.total_classes, m.overall FROM prof p LEFT JOIN modeled m ON p.zip = m.zip"))
def _(spark, sf):
    from demandgrid.plans.q_zips import profiles
    return profiles(spark, sf).select("zip", "total_classes").join(model(spark, sf).select("zip", "overall"), "zip", "left")


@query("m60_prediction_success", with_views("v_zip", "SELECT zip, avg_students >= 8 AS success FROM v_zip"))
def _(spark, sf):
    return zips(spark, sf).select("zip", H.success(C("demand_score"), C("avg_students"), 8.0).alias("success"))


RANKS = "SELECT zip, row_number() OVER (ORDER BY overall DESC, zip) AS old_rank, row_number() OVER (ORDER BY final_site_priority_score DESC, zip) AS new_rank FROM prio WHERE overall IS NOT NULL AND final_site_priority_score IS NOT NULL"


def ranks(spark, sf):
    p = prio(spark, sf).select("zip", "overall", "final_site_priority_score").where("overall IS NOT NULL AND final_site_priority_score IS NOT NULL")
    old = global_rank(p.select("zip", "overall"), [C("overall").desc(), C("zip").asc()], "old_rank").select("zip", "old_rank")
    new = global_rank(p.select("zip", "final_site_priority_score"), [C("final_site_priority_score").desc(), C("zip").asc()], "new_rank").select("zip", "new_rank")
    return old.join(new, "zip").withColumn("rank_change", C("old_rank") - C("new_rank"))


@query("w02_rank_changes", with_views("prio", "SELECT zip, old_rank, new_rank, old_rank - new_rank AS rank_change FROM rk", rk=RANKS))
def _(spark, sf):
    return ranks(spark, sf)


@query("a55_formula_comparison", with_views("prio", """SELECT count(*) AS row_count, count(CASE WHEN old_rank > new_rank THEN 1 END) AS risers, count(CASE WHEN old_rank < new_rank THEN 1 END) AS fallers,
 max(old_rank - new_rank) AS largest_rise, min(old_rank - new_rank) AS largest_fall FROM rk""", rk=RANKS))
def _(spark, sf):
    d = C("rank_change")
    return ranks(spark, sf).agg(F.count("*").alias("row_count"), F.count_if(d > 0).alias("risers"), F.count_if(d < 0).alias("fallers"), F.max(d).alias("largest_rise"), F.min(d).alias("largest_fall"))


# --- QA ----------------------------------------------------------------------------------

_q = lambda p: R(f"quantile_cont(v, {p})", 3)
_DIST = f"""count(*) AS count, {R('min(v)', 3)} AS min, {R('max(v)', 3)} AS max, {R('avg(v)', 3)} AS mean, {_q(0.5)} AS median, {_q(0.1)} AS p10, {_q(0.25)} AS p25, {_q(0.75)} AS p75, {_q(0.9)} AS p90,
 count(CASE WHEN v >= 70 THEN 1 END) AS above_70, count(CASE WHEN v >= 55 THEN 1 END) AS above_55, count(CASE WHEN v >= 40 THEN 1 END) AS above_40, count(CASE WHEN v < 40 THEN 1 END) AS below_40"""
_LONG = " UNION ALL ".join(f"SELECT 'S' || CAST(zip AS INT) % 5 AS state, '{f}' AS field, {f} AS v FROM modeled WHERE {f} IS NOT NULL" for f in ("overall", "bls_demand", "cpr_demand"))


def stated(spark, sf):
    return model(spark, sf).withColumn("state", F.concat(F.lit("S"), (C("zip").cast("int") % 5).cast("string")))


@query("a40_score_distribution", with_views("modeled", f"SELECT field, {_DIST} FROM l GROUP BY 1", l=_LONG))
def _(spark, sf):
    return Q.distribution(model(spark, sf), ["overall", "bls_demand", "cpr_demand"])


@query("a41_state_summary", with_views("modeled", f"SELECT state, field, {_DIST} FROM l WHERE field = 'overall' GROUP BY 1, 2", l=_LONG))
def _(spark, sf):
    return Q.distribution(stated(spark, sf), ["overall"], ["state"])


@query("a41_state_top", with_views("modeled", """SELECT state, zip, overall, CAST(rn AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY overall DESC, zip) AS rn FROM (
 SELECT 'S' || CAST(zip AS INT) % 5 AS state, zip, overall FROM modeled WHERE overall IS NOT NULL)) WHERE rn <= 10"""))
def _(spark, sf):
    rows = stated(spark, sf).where("overall IS NOT NULL").select("state", "zip", "overall")
    return K.top_per(rows, ["state"], [C("overall").desc(), C("zip")], 10, "position")


@query("k02_top_rows", with_views("modeled", "SELECT zip, cpr_demand FROM modeled WHERE cpr_demand IS NOT NULL ORDER BY cpr_demand DESC, zip LIMIT 50"))
def _(spark, sf):
    return model(spark, sf).where("cpr_demand IS NOT NULL").orderBy(C("cpr_demand").desc(), "zip").limit(50).select("zip", "cpr_demand")


_o, _p, _d = "coalesce(overall, 0)", "coalesce(population, 0)", "coalesce(population_density, 0)"
_kinds = {"high_score_low_population": f"{_o} >= 70 AND {_p} < 5000", "high_score_low_density": f"{_o} >= 70 AND {_d} < 300", "missing_coordinates": "lat IS NULL OR lng IS NULL",
          "missing_acs_fields": "population IS NULL OR population_density IS NULL OR median_household_income IS NULL OR healthcare_employment_share IS NULL",
          "high_income_weak_population_density": f"median_household_income >= 150000 AND ({_p} < 5000 OR {_d} < 300)", "high_density_weak_demand": f"{_d} >= 8000 AND {_o} < 40"}


@query("f10_outliers", with_views("modeled", "SELECT kind, zip, overall, CAST(rn AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY zip) AS rn FROM ("
       + " UNION ALL ".join(f"SELECT '{k}' AS kind, zip, overall FROM modeled WHERE {c}" for k, c in _kinds.items()) + ")) WHERE rn <= 50"))
def _(spark, sf):
    return Q.outliers(model(spark, sf).withColumn("median_income", C("median_household_income")))


@query("a42_omission_reasons", with_views("v_zip", """SELECT CASE WHEN population IS NULL THEN 'missing_population' WHEN population_density IS NULL THEN 'missing_land_area_or_density' ELSE 'other' END AS reason, count(*) AS zips
FROM v_zip WHERE zip NOT IN (SELECT zip FROM v_zip WHERE CAST(zip AS INT) % 3 > 0) GROUP BY 1"""))
def _(spark, sf):
    z = zips(spark, sf)
    return Q.omissions(z, z.where(C("zip").cast("int") % 3 > 0))


@query("u04_matched_minus_scored", with_views("v_zip", "SELECT zip FROM v_zip EXCEPT SELECT zip FROM v_zip WHERE population IS NOT NULL"))
def _(spark, sf):
    z = zips(spark, sf)
    return z.select("zip").join(z.where("population IS NOT NULL").select("zip"), "zip", "left_anti")


@query("a43_qa_report", with_views("modeled", """SELECT count(*) AS total_modeled_rows, count(lat) AS rows_with_lat_lng, count(population) AS rows_with_population, count(CASE WHEN land_sqmi > 0 THEN 1 END) AS rows_with_land_area,
 count(overall) AS rows_with_scores, count(CASE WHEN data_confidence = 'ok' THEN 1 END) AS ok, count(CASE WHEN data_confidence = 'partial' THEN 1 END) AS partial, count(CASE WHEN data_confidence = 'missing' THEN 1 END) AS missing FROM modeled"""))
def _(spark, sf):
    return Q.coverage(model(spark, sf))


# --- course evaluation -------------------------------------------------------------------

_w = "pow(0.5, (max(idx) OVER (PARTITION BY zip, decision) - idx) / 6.0)"
EV0 = f"""SELECT a.*, z.demand_score AS pub_demand, z.competition_gap_score AS gap_score, l.local_all, (SELECT {AVG2} FROM held) AS overall_avg, f.expected_students, f.forecast_confidence FROM (
 SELECT zip, decision AS course_type, count(*) AS total_classes, {AVG2} AS local_avg, {FILL} AS fill FROM held WHERE zip IS NOT NULL AND decision IS NOT NULL GROUP BY 1, 2) a
 JOIN v_zip z ON a.zip = z.zip JOIN (SELECT zip, {AVG2} AS local_all FROM held WHERE zip IS NOT NULL GROUP BY 1) l ON a.zip = l.zip
 LEFT JOIN (SELECT zip, decision AS course_type, {R(_ES, 2)} AS expected_students, CASE WHEN count(enrolled) >= 12 THEN 'high' WHEN count(enrolled) >= 5 THEN 'medium' ELSE 'low' END AS forecast_confidence FROM (
   SELECT *, {_w} AS w FROM (SELECT *, year(class_date) * 12 + month(class_date) AS idx FROM held WHERE zip IS NOT NULL AND decision IS NOT NULL)) GROUP BY 1, 2) f ON a.zip = f.zip AND a.course_type = f.course_type AND CAST(a.zip AS INT) % 4 > 0"""
_cw = "CASE {} WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.7 WHEN 'low' THEN 0.45 WHEN 'none' THEN 0.1 ELSE {} END"
_nodes = ["historical_performance", "public_demand", "course_relative_performance", "competition_gap", "schedule_strength", "forecast_expected_students"]
GRAPH = layer("ev0",
              {"hist_confidence": "CASE WHEN total_classes >= 12 THEN 'high' WHEN total_classes >= 5 THEN 'medium' ELSE 'low' END",
               "hist_score": R("CASE WHEN fill IS NULL THEN least(100.0, 50.0 * local_avg / local_all) ELSE 0.7 * least(100.0, 50.0 * local_avg / local_all) + 0.3 * least(100.0, fill) END", 1)},
              {"s_historical_performance": "hist_score", "s_public_demand": "pub_demand", "s_course_relative_performance": "CASE WHEN local_avg IS NOT NULL THEN least(100.0, 50.0 * local_avg / overall_avg) END", "s_competition_gap": "gap_score", "s_schedule_strength": "62.0",
               "s_forecast_expected_students": "CASE WHEN expected_students IS NOT NULL THEN least(100.0, 50.0 * expected_students / overall_avg) END", "k1": _cw.format("hist_confidence", 0.6), "k6": _cw.format("forecast_confidence", 0.45)},
              {"used": " + ".join(f"CASE WHEN s_{k} IS NOT NULL THEN {w} ELSE 0 END" for k, w in E.NODE_WEIGHTS.items())},
              {**{f"c_{k}": f"coalesce({R(f'{w} / used * s_{k}', 2)}, 0.0)" for k, w in E.NODE_WEIGHTS.items()},
               "graph_confidence": R("(0.35 * k1 + CASE WHEN s_public_demand IS NOT NULL THEN 0.12 ELSE 0 END + 0.15 * 0.6 + CASE WHEN s_competition_gap IS NOT NULL THEN 0.055 ELSE 0 END + 0.05 + CASE WHEN s_forecast_expected_students IS NOT NULL THEN 0.10 * k6 ELSE 0 END) / used", 2),
               "penalty": "CAST(CASE WHEN total_classes < 10 THEN 20 WHEN total_classes < 30 THEN 10 WHEN total_classes < 100 THEN 4 ELSE 0 END + CASE WHEN fill IS NULL THEN 2 ELSE 0 END + CASE WHEN expected_students IS NULL THEN 2 ELSE 0 END + CASE WHEN forecast_confidence = 'low' THEN 1 ELSE 0 END AS DOUBLE)"},
              {"final_score": "round_even(round(greatest(0.0, least(100.0, " + " + ".join(f"c_{k}" for k in _nodes) + " - penalty)), 6), 0)"},
              {"confidence_level": "CASE WHEN penalty <= 4 THEN 'high' WHEN penalty <= 12 THEN 'medium' WHEN penalty <= 25 THEN 'low' ELSE 'very_low' END",
               "action": "CASE WHEN final_score >= 70 THEN 'EXPAND' WHEN final_score >= 50 THEN 'MAINTAIN' WHEN final_score >= 30 THEN 'TEST_ONLY' ELSE 'AVOID' END"})
extend("ev0", EV0, ["held", "v_zip"])
extend("graph", GRAPH, ["ev0"])


def graph(spark, sf):
    h = held(spark, sf).where("zip IS NOT NULL")
    d = h.where("decision IS NOT NULL").withColumn("course_type", C("decision"))
    a = d.groupBy("zip", "course_type").agg(F.count("*").alias("total_classes"), K.mean_students().alias("local_avg"), K.fill_pct().alias("fill"))
    local = h.groupBy("zip").agg(K.mean_students().alias("local_all"))
    # every class is forecast; every fourth ZIP is then without one, as NULLs
    known = lambda c: F.when(C("zip").cast("int") % 4 > 0, C(c))
    fc = K.forecast(d, keys=["zip", "course_type"]).select("zip", "course_type", known("expected_students").alias("expected_students"), known("confidence").alias("forecast_confidence"))
    z = zips(spark, sf).select("zip", "demand_score", C("competition_gap_score").alias("gap_score"))
    j = a.join(z, "zip").join(local, "zip").join(fc, ["zip", "course_type"], "left").withColumn("overall_avg", held(spark, sf).agg(K.mean_students().alias("a")).scalar())
    enrol = F.least(F.lit(100.0), 50.0 * C("local_avg") / C("local_all"))
    j = j.withColumns({"hist_confidence": E.history_confidence(C("total_classes")), "hist_avg": C("local_avg"), "best_day_basis": F.lit("enrollment"),
                       "hist_score": rnd(F.coalesce(0.7 * enrol + 0.3 * F.when(C("fill").isNotNull(), F.least(F.lit(100.0), C("fill"))), enrol), 1)})
    return E.score_graph(j)


@query("m39_course_score_graph", with_views("graph", "SELECT zip, course_type, final_score, graph_confidence, penalty, confidence_level FROM graph"))
def _(spark, sf):
    return graph(spark, sf).select("zip", "course_type", "final_score", "graph_confidence", "penalty", "confidence_level")


@query("c24_graph_evidence", with_views("graph", " UNION ALL ".join(f"SELECT zip, course_type, '{k}' AS node, {R(f's_{k}', 2)} AS subscore, c_{k} AS contribution, s_{k} IS NULL AS missing FROM graph" for k in _nodes)))
def _(spark, sf):
    return E.graph_nodes(graph(spark, sf))


@query("m40_confidence_penalty", with_views("graph", "SELECT confidence_level, penalty, count(*) AS courses FROM graph GROUP BY 1, 2"))
def _(spark, sf):
    return graph(spark, sf).groupBy("confidence_level", "penalty").agg(F.count("*").alias("courses"))


@query("m41_course_action", with_views("graph", "SELECT zip, course_type, action, CASE action WHEN 'EXPAND' THEN 'Primary' WHEN 'MAINTAIN' THEN 'Secondary' ELSE 'Avoid / test only' END AS display_group FROM graph"))
def _(spark, sf):
    return graph(spark, sf).select("zip", "course_type", "action", E.display_group(C("action")).alias("display_group"))


@query("k11_courses_by_group", with_views("graph", """SELECT zip, coalesce(string_agg(CASE WHEN action = 'EXPAND' THEN course_type END, ',' ORDER BY final_score DESC, course_type), '') AS primary_courses,
 coalesce(string_agg(CASE WHEN action = 'MAINTAIN' THEN course_type END, ',' ORDER BY final_score DESC, course_type), '') AS secondary_courses,
 coalesce(string_agg(CASE WHEN action IN ('TEST_ONLY','AVOID') THEN course_type END, ',' ORDER BY final_score DESC, course_type), '') AS avoid_courses FROM graph GROUP BY 1"""))
def _(spark, sf):
    # three decision courses at most per ZIP, so the lists are bounded
    g = graph(spark, sf).withColumn("g", E.display_group(C("action")))
    names = lambda v: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(C("g") == v, F.struct((-C("final_score")).alias("o"), C("course_type"))))), lambda s: s["course_type"]), ",")
    return g.groupBy("zip").agg(names("Primary").alias("primary_courses"), names("Secondary").alias("secondary_courses"), names("Avoid / test only").alias("avoid_courses"))


_base = "CASE WHEN final_score >= 80 THEN 0 WHEN final_score >= 65 THEN 1 WHEN final_score >= 50 THEN 2 ELSE 3 END + CASE confidence_level WHEN 'low' THEN 1 WHEN 'very_low' THEN 2 ELSE 0 END"


@query("c28_center_opening", with_views("graph", f"SELECT zip, course_type, final_score, ['OPEN','TEST','WATCH','AVOID'][CAST(least(3, {_base}) + 1 AS INT)] AS decision FROM graph"))
def _(spark, sf):
    return graph(spark, sf).select("zip", "course_type", "final_score", E.opening_decision(C("final_score"), C("confidence_level")).alias("decision"))


@query("r04_regression_validation", with_views("graph", f"""SELECT count(*) AS n, {R("sum((x-ax)*(y-ay)) / sum((x-ax)*(x-ax))", 4)} AS slope, {R("max(ay) - sum((x-ax)*(y-ay)) / sum((x-ax)*(x-ax)) * max(ax)", 4)} AS intercept,
 {R("pow(sum((x-ax)*(y-ay)), 2) / (sum((x-ax)*(x-ax)) * sum((y-ay)*(y-ay)))", 4)} AS r_squared FROM (SELECT *, avg(x) OVER () AS ax, avg(y) OVER () AS ay FROM (SELECT final_score AS x, local_avg AS y FROM graph))"""))
def _(spark, sf):
    from demandgrid.operators.ranks import fit
    f = fit(graph(spark, sf), "final_score", "local_avg")
    return f.select("n", rnd(C("slope"), 4).alias("slope"), rnd(C("intercept"), 4).alias("intercept"), rnd(C("r_squared"), 4).alias("r_squared"))


@query("c27_course_points", with_views("graph", "SELECT zip, course_type, coalesce(final_score, hist_score) AS score, local_avg AS actual_enrollment FROM graph"))
def _(spark, sf):
    return graph(spark, sf).select("zip", "course_type", F.coalesce(C("final_score"), C("hist_score")).alias("score"), C("local_avg").alias("actual_enrollment"))


_cd = "CASE WHEN s IS NULL THEN 2 WHEN s >= 80 THEN 0 WHEN s >= 60 THEN 1 WHEN s >= 50 THEN CASE WHEN d >= 75 THEN 1 ELSE 2 END ELSE CASE WHEN d >= 70 THEN 2 ELSE 3 END END"


@query("m42_center_decision", with_views("v_candw", f"""SELECT candidate_id, ['OPEN','TEST','WATCH','AVOID'][CAST(CASE WHEN c < 50 AND g <= 1 THEN g + 1 ELSE g END + 1 AS INT)] AS decision, CASE WHEN NOT v THEN 'Weak' WHEN s >= 80 THEN 'Strong' ELSE 'Moderate' END AS readiness FROM (
 SELECT *, CASE WHEN NOT v AND b = 0 THEN 1 ELSE b END AS g FROM (SELECT *, {_cd} AS b FROM (SELECT candidate_id, history_score AS s, CAST(candidate_id * 7 % 101 AS DOUBLE) AS d, CAST(candidate_id * 11 % 101 AS DOUBLE) AS c, coalesce(validated, false) AS v FROM v_candw)))"""))
def _(spark, sf):
    from demandgrid.plans.q_candidates import cands
    k = C("candidate_id")
    return cands(spark, sf).select("candidate_id", E.center_decision(C("history_score"), F.lit(None).cast("double"), (k * 11 % 101).cast("double"), C("validated"), (k * 7 % 101).cast("double")).alias("decision"),
                                   E.readiness(C("validated"), C("history_score")).alias("readiness"))


@query("c29_site_status", with_views("v_candw", """SELECT candidate_id, CASE WHEN coalesce(validated, false) THEN 'Validated commercial site' ELSE 'Not validated — not a confirmed leasing opportunity' END AS site_status,
 CASE WHEN history_score IS NULL THEN 'Unknown data confidence' WHEN history_score >= 85 THEN 'Very high data confidence' WHEN history_score >= 70 THEN 'High data confidence' WHEN history_score >= 50 THEN 'Medium data confidence' ELSE 'Low data confidence' END AS label FROM v_candw"""))
def _(spark, sf):
    from demandgrid.plans.q_candidates import cands
    return cands(spark, sf).select("candidate_id", E.site_status(C("validated"), C("broker_notes")).alias("site_status"), E.confidence_label(C("history_score")).alias("label"))


@query("m43_zip_decision", with_views("modeled", """SELECT zip, CASE WHEN coalesce(overall, 0) >= 60 AND coalesce(bls_demand, 0) / 100 >= 0.6 THEN CASE WHEN coalesce(commercial_ready, false) THEN 'Commercially promising — validate in person' ELSE 'Strong test area' END WHEN coalesce(overall, 0) >= 40 THEN 'Possible opportunity' ELSE 'Lower priority' END AS modeled_decision,
 CASE WHEN coalesce(demand_score, 0) >= 60 AND coalesce(mix_arc_bls, 0) >= 0.6 THEN CASE WHEN coalesce(commercial_ready, false) THEN 'Commercially promising — validate in person' ELSE 'Strong test area' END WHEN coalesce(demand_score, 0) >= 60 THEN 'Possible opportunity' WHEN coalesce(mix_arc_bls, 0) >= 0.6 THEN 'Keep watching' ELSE 'Lower priority' END AS history_decision FROM modeled"""))
def _(spark, sf):
    return model(spark, sf).select("zip", E.zip_decision("modeled", C("overall"), C("bls_demand") / 100, C("commercial_ready")).alias("modeled_decision"),
                                   E.zip_decision("historical", C("demand_score"), C("mix_arc_bls"), C("commercial_ready")).alias("history_decision"))


# --- text signals -------------------------------------------------------------------------

# DuckDB word boundaries are ASCII: both sides look at texts reduced to ASCII
_ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g')"
THEME_HITS = " UNION ALL ".join(f"SELECT doc_id, t, '{k}' AS theme FROM rv WHERE regexp_matches(t, '(?i){p.replace(chr(39), chr(39) * 2)}')" for k, p in X.THEMES.items())


def ascii_(df):
    return df.withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", " "))


@query("p26_complaint_themes", with_views("v_review", "SELECT doc_id, string_agg(theme, ',' ORDER BY theme) AS themes FROM h GROUP BY 1",
                                          rv=f"SELECT doc_id, rating, {_ASCII} AS t FROM v_review", h=THEME_HITS))
def _(spark, sf):
    r = ascii_(V.reviews(spark, sf)).select("doc_id", F.array_join(F.array_sort(X.themes(C("text"))), ",").alias("themes"))
    return r.where("themes <> ''")


@query("a38_complaint_summary", with_views("v_review", "SELECT h.theme, count(*) AS reviews, min(h.doc_id) AS first_doc, arg_min(substr(trim(t), 1, 160), h.doc_id) AS example FROM h GROUP BY 1",
                                           rv=f"SELECT doc_id, {_ASCII} AS t FROM v_review WHERE rating IS NULL OR rating <= 3", h=THEME_HITS))
def _(spark, sf):
    return X.complaint_summary(ascii_(V.reviews(spark, sf)))


@query("a38_review_confidence", with_views("v_review", "SELECT count(*) AS reviews_scanned, count(CASE WHEN rating <= 3 THEN 1 END) AS negative_reviews, 'high' AS confidence FROM v_review"))
def _(spark, sf):
    return X.review_confidence(V.reviews(spark, sf))


_pg = lambda p: f"regexp_matches(t, '(?i){p}')"
PAGE = f"""SELECT page_id, {", ".join(f"{_pg(p.replace('español|', '').replace('中文|', ''))} AS {k}" for k, p in X.PAGE_SIGNALS.items())}, NOT {_pg(X.CONTACT)} AS contact_friction,
 CASE WHEN {_pg(X.OUTDATED)} THEN true WHEN len(regexp_extract_all(t, '20[0-9][0-9]')) > 0 THEN list_max(list_transform(regexp_extract_all(t, '20[0-9][0-9]'), lambda x: CAST(x AS INT))) <= 2022 END AS outdated_website
 FROM (SELECT page_id, {_ASCII} AS t FROM v_page)"""


@query("p27_page_signals", with_views("v_page", PAGE))
def _(spark, sf):
    return X.page_signals(ascii_(V.pages(spark, sf)), 2026)


_pcols = [*X.PAGE_SIGNALS, "contact_friction", "outdated_website"]
_ps = lambda test: "concat_ws(',', " + ", ".join(f"CASE WHEN {test(c)} THEN '{c}' END" for c in sorted(_pcols)) + ")"


@query("p27_signal_sets", with_views("v_page", f"SELECT page_id, {_ps(lambda c: c)} AS detected, {_ps(lambda c: 'NOT ' + c)} AS missing, {_ps(lambda c: c + ' IS NULL')} AS unknown FROM pf", pf=PAGE))
def _(spark, sf):
    return X.signal_sets(X.page_signals(ascii_(V.pages(spark, sf)), 2026))


# --- job postings: documents stand in for posting texts, placed by document id -------------

extend("v_job", f"""SELECT doc_id AS job_id, {_ASCII} || CASE doc_id % 7 WHEN 0 THEN ' BLS and CPR required, hospital nurse' WHEN 1 THEN ' ACLS PALS paramedic' WHEN 2 THEN ' first aid, daycare' ELSE '' END AS t,
 CASE WHEN doc_id % 9 > 0 THEN source || CAST(doc_id % 31 AS VARCHAR) ELSE ' ' END AS employer, CASE WHEN doc_id % 4 = 0 THEN 'ASIA' WHEN doc_id % 4 = 1 THEN '' END AS state,
 CAST(370000 + doc_id * 3571 % 6500 AS DOUBLE) / 10000 AS jlat, CAST(-1223000 + doc_id * 7457 % 6500 AS DOUBLE) / 10000 AS jlng, CAST(1 + doc_id % 6 AS DOUBLE) AS radius FROM documents""")


def jobs(spark, sf):
    k = C("doc_id")
    extra = F.when(k % 7 == 0, " BLS and CPR required, hospital nurse").when(k % 7 == 1, " ACLS PALS paramedic").when(k % 7 == 2, " first aid, daycare").otherwise("")
    return V.table(spark, sf, "documents").select(
        k.alias("job_id"), F.concat(F.regexp_replace("text", r"[^\x00-\x7F]", " "), extra).alias("t"),
        F.when(k % 9 > 0, F.concat(C("source"), (k % 31).cast("string"))).otherwise(" ").alias("employer"), F.when(k % 4 == 0, "ASIA").when(k % 4 == 1, "").alias("state"),
        ((370000 + k * 3571 % 6500).cast("double") / 10000).alias("jlat"), ((-1223000 + k * 7457 % 6500).cast("double") / 10000).alias("jlng"), (1 + k % 6).cast("double").alias("radius"))


_jf = {**X.CERTIFICATIONS, **X.ROLES}
JOBF = "SELECT * EXCLUDE t, " + ", ".join(f"regexp_matches(t, '(?i){p}') AS {k}" for k, p in _jf.items()) + " FROM v_job"
_anyc = "(" + " OR ".join(X.CERTIFICATIONS) + ")"
JM = f"""SELECT c.candidate_id, j.*, {HAV('c.lat', 'c.lng', 'jlat', 'jlng', 3958.7613)} AS d FROM v_candw c CROSS JOIN jf j WHERE c.lat IS NOT NULL AND (coalesce(j.state, '') = '' OR j.state = upper(c.state))"""


def posting_flags(spark, sf):
    return X.posting_flags(jobs(spark, sf), C("t")).drop("t")


def posting_matches(spark, sf):
    from demandgrid.plans.q_candidates import cands
    ensure_checkpoint_dir(spark)
    c = cands(spark, sf).select("candidate_id", "lat", "lng", F.upper("state").alias("c_state"))
    flags = posting_flags(spark, sf).checkpoint()  # read several times; the patterns run once
    near = G.within_dense(c, flags, ("lat", "lng"), ("jlat", "jlng"), C("radius"), 6.0, 3958.7613)
    return near.where((F.coalesce(C("state"), F.lit("")) == "") | (C("state") == C("c_state")))


@query("p25_posting_flags", with_views("v_job", f"SELECT job_id, {', '.join(_jf)}, {_anyc} AS certification FROM jf", jf=JOBF))
def _(spark, sf):
    return posting_flags(spark, sf).select("job_id", *_jf, "certification")


@query("j14_postings_in_own_radius", with_views("v_candw v_job", f"SELECT candidate_id, job_id, {R('d', 3)} AS distance FROM ({JM}) WHERE d <= radius", jf=JOBF))
def _(spark, sf):
    return posting_matches(spark, sf).select("candidate_id", "job_id", rnd_far(C("distance"), 3).alias("distance"))


@query("a29_posting_demand", with_views("v_candw v_job", f"""SELECT candidate_id, count(*) AS active_postings_count, count(CASE WHEN {_anyc} THEN 1 END) AS certification_postings_count,
 count(DISTINCT nullif(lower(trim(employer)), '')) AS unique_employers_count, {", ".join(f"count(CASE WHEN {k} THEN 1 END) AS {k}_count" for k in _jf)} FROM ({JM}) WHERE d <= radius GROUP BY 1""", jf=JOBF))
def _(spark, sf):
    from demandgrid.plans.q_candidates import cands
    return X.posting_demand(cands(spark, sf), posting_flags(spark, sf), 6.0)


@query("a29_top_employers", with_views("v_candw v_job", f"""SELECT candidate_id, employer, postings, CAST(rn AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY postings DESC, employer) AS rn FROM (
 SELECT candidate_id, CASE WHEN trim(employer) = '' THEN 'unknown' ELSE trim(employer) END AS employer, count(*) AS postings FROM ({JM}) WHERE d <= radius GROUP BY 1, 2)) WHERE rn <= 10""", jf=JOBF))
def _(spark, sf):
    from demandgrid.plans.q_candidates import cands
    return X.top_employers(cands(spark, sf), posting_flags(spark, sf), 6.0)
