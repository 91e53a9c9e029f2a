"""Order statistics that never sort a whole table (or a hot group) in one task.

A running total over a global order is built from a range partitioning: rows
are range-partitioned and written once (checkpoint, so the partition numbers
are facts and survive executor loss), each partition is summed, the sums of the
partitions before it become its offset, and the window runs per partition.
Ranks, exact quantiles and tie-averaged ranks all follow from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from demandgrid.functions.exprs import ratio
from demandgrid.session import ensure_checkpoint_dir

C = F.col


def running_total(df: DataFrame, order: list[Column], value: Column, name: str, keys: list[str] | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` in ``order`` (a total order), per key."""
    keys = keys or []
    ensure_checkpoint_dir(df.sparkSession)
    placed = (
        df.withColumn("_v", value).repartitionByRange(*[C(k) for k in keys], *order)
        .withColumn("_pid", F.spark_partition_id()).checkpoint()
    )
    sums = placed.groupBy(*keys, "_pid").agg(F.sum("_v").alias("_s"))
    # one row per (key, partition): at most the number of partitions per key
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_pid", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*keys, "_pid").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        placed.join(offsets, [*keys, "_pid"])
        .withColumn(name, F.sum("_v").over(inside) + C("_off")).drop("_v", "_pid", "_off")
    )


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1..n in a total order over the whole table."""
    return running_total(df, order, F.lit(1).cast("bigint"), name)


def quantiles(df: DataFrame, value: str, qs: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles, per key or overall."""
    keys = keys or []
    counts = df.where(C(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    run = running_total(counts, [C(value)], C("_n"), "_cum", keys)
    totals = run.groupBy(*keys).agg(F.max("_cum").alias("_total"))
    if keys:
        run = run.join(totals, keys)
    else:
        run = run.withColumn("_total", totals.scalar())
    aggs = []
    for name, q in qs.items():
        pos = F.lit(float(q)) * (C("_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        at = lambda k: F.max(F.when((C("_cum") - C("_n") <= k) & (k < C("_cum")), C(value)))
        aggs += [at(lo).alias(f"_lo_{name}"), at(hi).alias(f"_hi_{name}"), F.max(pos - lo).alias(f"_fr_{name}")]
    out = run.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[
        (C(f"_lo_{q}") + (C(f"_hi_{q}") - C(f"_lo_{q}")) * C(f"_fr_{q}")).alias(q) for q in qs])


def average_rank(df: DataFrame, value: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Rank with ties sharing the mean of their span.  Ranks are computed on the
    distinct values and joined back, so ties cost nothing."""
    keys = keys or []
    counts = df.where(C(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    run = running_total(counts, [C(value)], C("_n"), "_cum", keys)
    ranks = run.select(*keys, value, (C("_cum") - C("_n") + (C("_n") + 1) / 2.0).alias(name))
    return df.join(ranks, [*keys, value], "left")


def fit(df: DataFrame, x: str, y: str, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """n, Pearson, slope, intercept and R2 from one pass of sums.

    Undefined statistics are NULL, never NaN: no spread in x gives no line, no spread
    in either gives no correlation.  Unweighted moments are Spark's mergeable central
    ones; weighted ones are summed about each key's weighted means, which a first
    aggregation finds, so values far from zero lose no digits."""
    keys = keys or []
    ok = df.where(C(x).isNotNull() & C(y).isNotNull()).select(
        *keys, C(x).cast("double").alias("_x"), C(y).cast("double").alias("_y"), (C(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    ends = [F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1")]
    if weight is None:
        size = F.count("*").cast("double")
        s = ok.groupBy(*keys).agg(
            size.alias("n"), F.avg("_x").alias("mx"), F.avg("_y").alias("my"), (F.var_pop("_x") * size).alias("cxx"),
            (F.var_pop("_y") * size).alias("cyy"), (F.covar_pop("_x", "_y") * size).alias("cxy"), *ends)
    else:
        # a plain mean as the first centre: the weighted sums about it stay small
        centre = ok.groupBy(*keys).agg(F.avg("_x").alias("x_"), F.avg("_y").alias("y_"))
        if keys:
            named = centre.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
            same = F.lit(True)
            for i, k in enumerate(keys):
                same = same & C(k).eqNullSafe(C(f"_k{i}"))
            about = ok.join(named, same)
        else:
            both = centre.select(F.struct("x_", "y_")).scalar()
            about = ok.withColumns({"x_": both["x_"], "y_": both["y_"]})
        about = about.withColumns({"_dx": C("_x") - C("x_"), "_dy": C("_y") - C("y_")})
        sums = about.groupBy(*keys).agg(
            F.sum("_w").alias("n"), F.max("x_").alias("x_"), F.max("y_").alias("y_"), F.sum(C("_dx") * C("_w")).alias("sx"), F.sum(C("_dy") * C("_w")).alias("sy"),
            F.sum(C("_dx") * C("_dx") * C("_w")).alias("sxx"), F.sum(C("_dy") * C("_dy") * C("_w")).alias("syy"), F.sum(C("_dx") * C("_dy") * C("_w")).alias("sxy"), *ends)
        s = sums.withColumns({
            "mx": C("x_") + ratio(C("sx"), C("n")), "my": C("y_") + ratio(C("sy"), C("n")), "cxx": C("sxx") - ratio(C("sx") * C("sx"), C("n")),
            "cyy": C("syy") - ratio(C("sy") * C("sy"), C("n")), "cxy": C("sxy") - ratio(C("sx") * C("sy"), C("n"))})
    cxx, cyy, cxy = C("cxx"), C("cyy"), C("cxy")
    x_spread = (C("n") >= 2) & (C("x1") > C("x0"))
    y_spread = C("y1") > C("y0")
    slope = F.when(x_spread, F.try_divide(cxy, cxx))
    r = F.when(x_spread & y_spread, F.try_divide(cxy, F.sqrt(cxx) * F.sqrt(cyy)))
    return s.select(
        *keys, C("n").cast("bigint").alias("n"), r.alias("pearson"), slope.alias("slope"),
        (C("my") - slope * C("mx")).alias("intercept"),
        F.when(x_spread & y_spread, r * r).alias("r_squared"), (x_spread & ~y_spread).alias("flat_y"))


def spearman(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Pearson of tie-averaged ranks over rows where both sides are known."""
    keys = keys or []
    # equal (x, y) pairs collapse to one weighted row before any ranking
    pairs = df.where(C(x).isNotNull() & C(y).isNotNull()).groupBy(*keys, x, y).agg(F.count("*").alias("_k"))

    def ranks(col: str, name: str) -> DataFrame:
        counts = pairs.groupBy(*keys, col).agg(F.sum("_k").alias("_n"))
        run = running_total(counts, [C(col)], C("_n"), "_cum", keys)
        return run.select(*keys, col, (C("_cum") - C("_n") + (C("_n") + 1) / 2.0).alias(name))

    j = pairs.join(ranks(x, "_rx"), [*keys, x]).join(ranks(y, "_ry"), [*keys, y])
    return fit(j, "_rx", "_ry", keys, "_k").select(*keys, "n", C("pearson").alias("spearman"))
