"""Course opportunity: six evidence nodes, a confidence penalty and the decisions
built on the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.exprs import clamp, lookup, mean_known, opt, pick, ratio, rnd, stages, total, zero

C = F.col

# fixed values: node weights and confidence words
NODE_WEIGHTS = {
    "historical_performance": 0.35,
    "public_demand": 0.20,
    "course_relative_performance": 0.15,
    "competition_gap": 0.10,
    "schedule_strength": 0.10,
    "forecast_expected_students": 0.10,
}
CONFIDENCE_WORDS = {"high": 0.9, "medium": 0.7, "low": 0.45, "none": 0.1}


def history_confidence(k: Column) -> Column:
    return pick((k >= 12, "high"), (k >= 5, "medium"), (k >= 1, "low"), default="none")


def _parity(value: Column, reference: Column) -> Column:
    """50 when equal to the reference."""
    return clamp(ratio(50.0 * value, F.when(reference != 0, reference)))


def evidence(df: DataFrame) -> DataFrame:
    """Sub-score and confidence of each node (NULL score = missing node).

    Reads: hist_score, hist_avg, hist_confidence, local_avg, overall_avg, demand_score,
    training_score, job_score, gap_score, schedule_strength, best_day_basis,
    expected_students, forecast_confidence."""
    o = lambda name, kind="double": opt(df, name, kind)
    ref = F.coalesce(F.when(o("overall_avg") != 0, o("overall_avg")), F.lit(6.0))
    hist = F.coalesce(clamp(o("hist_score")), _parity(o("hist_avg"), ref))
    basis = o("best_day_basis", "string")
    sched = F.coalesce(clamp(o("schedule_strength")), pick((basis == "enrollment", 62.0), (basis.isNotNull(), 50.0)))
    sconf = pick((o("schedule_strength").isNotNull() | (basis == "enrollment"), 0.5), default=0.35)
    return stages(df, {
        "s_historical_performance": hist, "k_historical_performance": F.coalesce(lookup(o("hist_confidence", "string"), CONFIDENCE_WORDS), F.lit(0.6)),
        "s_public_demand": mean_known([clamp(o("demand_score")), clamp(o("training_score")), clamp(o("job_score"))]), "k_public_demand": F.lit(0.6),
        "s_course_relative_performance": _parity(o("local_avg"), o("overall_avg")), "k_course_relative_performance": F.lit(0.6),
        "s_competition_gap": clamp(o("gap_score")), "k_competition_gap": F.lit(0.55), "s_schedule_strength": sched, "k_schedule_strength": sconf,
        "s_forecast_expected_students": _parity(o("expected_students"), ref),
        "k_forecast_expected_students": F.coalesce(lookup(o("forecast_confidence", "string"), CONFIDENCE_WORDS), F.lit(0.45))})


def penalty_points(classes: Column, hist_conf: Column, fill: Column, forecast_conf: Column, has_forecast: Column, freshness_days: Column) -> Column:
    k = F.coalesce(classes, F.lit(0))
    none = (k == 0) | F.coalesce(hist_conf == "none", F.lit(False))
    size = pick((none, 35.0), (k < 10, 20.0), (k < 30, 10.0), (k < 100, 4.0), default=0.0)
    gaps = F.when(fill.isNull(), 2.0).otherwise(0.0) + F.when(has_forecast, 0.0).otherwise(2.0)
    age = pick((freshness_days >= 730, 6.0), (freshness_days >= 365, 3.0), default=0.0)
    weak = F.when((forecast_conf == "low") & ~none, 1.0).otherwise(0.0)
    return size + gaps + age + weak


def penalty_level(points: Column) -> Column:
    return pick((points <= 4, "high"), (points <= 12, "medium"), (points <= 25, "low"), default="very_low")


def score_graph(df: DataFrame) -> DataFrame:
    """Final course score: renormalised node contributions less the penalty."""
    e = evidence(df)
    used = total([F.when(C(f"s_{k}").isNotNull(), w).otherwise(0.0) for k, w in NODE_WEIGHTS.items()])
    e = stages(e, {"_used": used})
    share = lambda k, w: F.try_divide(F.when(C(f"s_{k}").isNotNull(), F.lit(w)), C("_used"))
    e = stages(e, {f"c_{k}": F.coalesce(rnd(share(k, w) * C(f"s_{k}"), 2), F.lit(0.0)) for k, w in NODE_WEIGHTS.items()})
    conf = total([F.coalesce(share(k, w) * C(f"k_{k}"), F.lit(0.0)) for k, w in NODE_WEIGHTS.items()])
    points = penalty_points(C("total_classes"), C("hist_confidence"), opt(df, "fill"), opt(df, "forecast_confidence", "string"),
                            opt(df, "expected_students").isNotNull(), opt(df, "freshness_days"))
    e = stages(e, {"penalty": points, "graph_confidence": rnd(conf, 2)})
    raw = total([C(f"c_{k}") for k in NODE_WEIGHTS]) - C("penalty")
    e = stages(e, {"final_score": F.bround(rnd(clamp(raw), 6), 0)})
    return e.withColumns({"confidence_level": penalty_level(C("penalty")), "action": course_action(C("final_score"))}).drop("_used")


def course_action(score: Column) -> Column:
    return pick((score >= 70, "EXPAND"), (score >= 50, "MAINTAIN"), (score >= 30, "TEST_ONLY"), default="AVOID")


def display_group(action: Column) -> Column:
    return pick((action == "EXPAND", "Primary"), (action == "MAINTAIN", "Secondary"), default="Avoid / test only")


def graph_nodes(df: DataFrame) -> DataFrame:
    """Nodes of every course in long form."""
    rows = F.array(*[F.struct(F.lit(k).alias("node"), rnd(C(f"s_{k}"), 2).alias("subscore"), C(f"c_{k}").alias("contribution"), C(f"s_{k}").isNull().alias("missing"))
                     for k in NODE_WEIGHTS])
    return df.select("zip", "course_type", F.explode(rows).alias("r")).select("zip", "course_type", "r.*")


DECISIONS = ["OPEN", "TEST", "WATCH", "AVOID"]


def opening_decision(score: Column, level: Column) -> Column:
    """Score ladder, one step down for low confidence and two for very low."""
    base = pick((score >= 80, 0), (score >= 65, 1), (score >= 50, 2), default=3)
    down = pick((level == "low", 1), (level == "very_low", 2), default=0)
    return F.when(score.isNotNull(), F.element_at(F.array(*[F.lit(d) for d in DECISIONS]), F.least(base + down, F.lit(3)) + 1))


def center_decision(area: Column, opportunity: Column, confidence: Column, validated: Column, demand: Column) -> Column:
    s = F.coalesce(area, opportunity)
    d = F.coalesce(demand, F.lit(0.0))
    base = pick((s.isNull(), 2), (s >= 80, 0), (s >= 60, 1), (s >= 50, F.when(d >= 75, 1).otherwise(2)), default=F.when(d >= 70, 2).otherwise(3))
    gated = F.when(~F.coalesce(validated, F.lit(False)) & (base == 0), 1).otherwise(base)
    final = F.when((confidence < 50) & (gated <= 1), gated + 1).otherwise(gated)
    return F.element_at(F.array(*[F.lit(x) for x in DECISIONS]), final + 1)


def readiness(validated: Column, area: Column) -> Column:
    return pick((~F.coalesce(validated, F.lit(False)), "Weak"), (area >= 80, "Strong"), default="Moderate")


def confidence_label(c: Column) -> Column:
    return pick((c.isNull(), "Unknown data confidence"), (c >= 85, "Very high data confidence"), (c >= 70, "High data confidence"), (c >= 50, "Medium data confidence"),
                default="Low data confidence")


def site_status(validated: Column, name: Column) -> Column:
    return pick((F.coalesce(validated, F.lit(False)), "Validated commercial site"),
                (F.lower(name).contains("needs commercial site validation"), "Not validated — needs commercial site validation"),
                default="Not validated — not a confirmed leasing opportunity")


def zip_decision(layer: str, overall: Column, course_share: Column, commercial_ready: Column) -> Column:
    """Dashboard decision of a ZIP in the historical or the modelled layer."""
    s, c = F.coalesce(overall, F.lit(0.0)), F.coalesce(course_share, F.lit(0.0))
    hi, course = s >= 60, c >= 0.60
    strong = F.when(F.coalesce(commercial_ready, F.lit(False)), "Commercially promising — validate in person").otherwise("Strong test area")
    if layer == "historical":
        return pick((hi & course, strong), (hi, "Possible opportunity"), (course, "Keep watching"), default="Lower priority")
    return pick((hi & course, strong), (s >= 40, "Possible opportunity"), default="Lower priority")
