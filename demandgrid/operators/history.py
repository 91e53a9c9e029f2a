"""Real class history against the modelled layer: proven demand, agreement,
validation cases and back-test statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.exprs import clamp, known, n, nonzero, opt, pick, renorm, rnd, stages, zero
from demandgrid.operators.ranks import fit, spearman

C = F.col
COURSE_FIELDS = {"arc_cpr": "arc_cpr_students", "arc_bls": "arc_bls_students", "aha_bls": "aha_bls_students"}


def _norm(x: Column, high: float) -> Column:
    return clamp(x * 100.0 / high)


def class_count_score(k: Column) -> Column:
    """Piecewise: 40 at five classes, 75 at twenty, 100 at fifty."""
    return F.when(k.isNotNull(), pick((k <= 0, 0.0), (k < 5, 40.0 * k / 5.0), (k < 20, 40.0 + (k - 5.0) * (35.0 / 15.0)),
                                      (k < 50, 75.0 + (k - 20.0) * (25.0 / 30.0)), default=100.0))


def trend_score(text: Column) -> Column:
    t = F.lower(F.trim(text))
    grow = t.contains("grow") | t.contains("up")
    return pick((t.contains("strong") & grow, 100.0), (grow | t.contains("increas"), 80.0), (t.rlike("declin|down|decreas"), 30.0),
                (t.rlike("flat|stable|unknown"), 50.0))


def proven_demand(df: DataFrame) -> DataFrame:
    """Proven demand 0..100 from real outcomes, with confidence, course scores and mix."""
    k = F.coalesce(nonzero(known(opt(df, "class_count"))), known(opt(df, "classes")))
    avg = F.coalesce(nonzero(known(opt(df, "avg_students"))), known(opt(df, "average_students_per_class")))
    students = F.coalesce(known(opt(df, "total_students")), k * avg)
    trend = trend_score(F.coalesce(opt(df, "trend", "string"), opt(df, "historical_trend", "string")))
    df = stages(df, {"_k": k, "_avg": avg, "_tot": students, "_recent": nonzero(known(opt(df, "recent_students")))})
    k = F.coalesce(C("_k"), F.lit(0.0))
    df = stages(df, {
        "proven_demand_score": rnd(renorm([(_norm(C("_avg"), 12), 0.30), (_norm(F.coalesce(C("_recent"), C("_tot")), 300), 0.25),
                                           (_norm(known(opt(df, "fill_rate")), 80), 0.20), (class_count_score(C("_k")), 0.15), (trend, 0.10)]), 1),
        "historical_confidence": pick((k < 5, "low"), (k < 20, "medium"), default="high"), "proven_total_students": rnd(C("_tot"), 1)})
    factor = pick((C("historical_confidence") == "low", 0.65), (C("historical_confidence") == "medium", 0.85), default=1.0)
    counts = {c: zero(opt(df, f)) for c, f in COURSE_FIELDS.items()}
    total = sum(counts.values(), F.lit(0.0))
    best = F.greatest(*counts.values())
    return df.withColumns({
        **{f"proven_{c}_score": rnd(F.coalesce(_norm(v, 150), F.lit(0.0)) * factor, 1) for c, v in counts.items()},
        **{f"mix_{c}": rnd(F.coalesce(F.try_divide(v, total), F.lit(0.0)), 3) for c, v in counts.items()},
        "best_historical_course": F.when(total > 0, pick(*[(v == best, c) for c, v in counts.items()])),
    }).drop("_k", "_avg", "_tot", "_recent")


def band(x: Column) -> Column:
    return pick((x.isNull(), "missing"), (x >= 65, "high"), (x >= 45, "medium"), default="low")


def agreement(modeled: Column, proven: Column, confidence: Column) -> Column:
    m, p = band(modeled), band(proven)
    return pick(
        (modeled.isNull() | proven.isNull() | (confidence == "low"), "insufficient_history"), ((m == "high") & (p == "high"), "model_agrees_high"),
        ((m == "low") & (p == "low"), "model_agrees_low"), ((m == "high") & (p == "low"), "model_overpredicts"), ((m == "low") & (p == "high"), "model_underpredicts"),
        ((m == "medium") & (p == "high"), "hidden_opportunity"), ((m == "high") & p.isin("medium", "low"), "test_carefully"), default="mixed")


def validation_case(modeled: Column, proven: Column) -> Column:
    hi, lo = modeled >= 60, modeled < 40
    return pick((modeled.isNull() | proven.isNull(), "no_overlap"), (hi & (proven < 30), "false_positive"), (lo & (proven >= 60), "false_negative"),
                (hi & (proven >= 60), "confirmed_high"), (lo & (proven < 30), "confirmed_low"), default="mixed")


def validation_rows(modeled: DataFrame, history: DataFrame) -> DataFrame:
    """ZIPs present on both sides with error, agreement and case.

    ``modeled``: zip, overall, bls_demand, cpr_demand; ``history``: zip and outcomes."""
    h = proven_demand(history)
    j = modeled.join(h, "zip")
    proven = F.coalesce(C("proven_demand_score"), opt(h, "demand_score"))
    return j.withColumns({
        "model_error": rnd(C("proven_demand_score") - C("overall"), 1),
        "model_agreement": agreement(C("overall"), C("proven_demand_score"), C("historical_confidence")),
        "validation_case": validation_case(C("overall"), proven)})


# fixed values: (label, modelled field, outcome field)
METRIC_PAIRS = [
    ("overall_vs_historical_score", "overall", "demand_score"), ("bls_vs_aha_students", "bls_demand", "aha_bls_students"),
    ("bls_vs_arc_bls_students", "bls_demand", "arc_bls_students"), ("cpr_vs_arc_cpr_students", "cpr_demand", "arc_cpr_students"),
    ("overall_vs_class_count", "overall", "class_count"), ("overall_vs_avg_students", "overall", "avg_students"), ("overall_vs_fill_rate", "overall", "fill_rate"),
    ("modeled_overall_vs_proven_demand", "overall", "proven_demand_score"), ("modeled_bls_vs_proven_aha_bls", "bls_demand", "proven_aha_bls_score"),
    ("modeled_bls_vs_proven_arc_bls", "bls_demand", "proven_arc_bls_score"), ("modeled_cpr_vs_proven_arc_cpr", "cpr_demand", "proven_arc_cpr_score"),
]


def long_pairs(df: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), known(C(a)).alias("x"), known(C(b)).alias("y")) for k, a, b in pairs])
    return df.select(F.explode(rows).alias("r")).select("r.*")


def backtest_metrics(rows: DataFrame) -> DataFrame:
    """Correlation and fit of every metric pair in one grouped pass."""
    f = fit(long_pairs(rows, METRIC_PAIRS), "x", "y", ["metric"])
    ok = C("pearson").isNotNull()
    return f.select("metric", C("n").alias("sample_size"), rnd(C("pearson"), 4).alias("correlation"), rnd(C("pearson") * C("pearson"), 4).alias("r2"),
                    F.when(ok, rnd(C("slope"), 4)).alias("slope"), F.when(ok, rnd(C("intercept"), 4)).alias("intercept"))


def strength_word(r: Column) -> Column:
    a = F.abs(r)
    return pick((r.isNull(), "undefined"), (a >= 0.7, "strong"), (a >= 0.4, "moderate"), (a >= 0.2, "weak"), default="negligible")


def signal_backtest(df: DataFrame, signals: list[str], outcome: str) -> DataFrame:
    """Pearson and Spearman of each signal with the outcome, signals in long form."""
    pairs = long_pairs(df, [(s, s, outcome) for s in signals])
    p = fit(pairs, "x", "y", ["metric"]).select("metric", "n", "pearson")
    s = spearman(pairs, "x", "y", ["metric"]).select("metric", "spearman")
    j = p.where(C("n") >= 2).join(s, "metric", "left")
    lead = F.coalesce(C("spearman"), C("pearson"))
    return j.select(C("metric").alias("signal"), "n", rnd(C("pearson"), 6).alias("pearson"), rnd(C("spearman"), 6).alias("spearman"),
                    strength_word(lead).alias("strength"), pick((lead.isNull(), ""), (lead >= 0, "positive"), default="negative").alias("direction"))


def history_status(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Flag modelled rows by whether real history exists for the ZIP."""
    h = history.select("zip").distinct().withColumn("_h", F.lit(True))
    j = rows.join(h, "zip", "left")
    return j.withColumn("historical_status", F.when(C("_h"), "has_history").otherwise("no_history")).drop("_h")


def success(predicted: Column, actual: Column, threshold: float) -> Column:
    """Did reality reach the threshold?  Unknown without an outcome."""
    return F.when(actual.isNotNull(), actual >= threshold)
