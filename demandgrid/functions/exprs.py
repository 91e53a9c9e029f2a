"""Null-honest column helpers shared by every operator.

Rules: an unknown input stays NULL (never imputed), NaN and infinity count as
unknown, a clamp keeps NULL, and a weighted score renormalises over the parts
that are present.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(x: Column) -> Column:
    """NULL for NaN and +/-infinity."""
    d = x.cast("double")
    # NaN orders above infinity, so one comparison rules out both
    return F.when(F.abs(d) < F.lit(float("inf")), d)


def clamp(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    # greatest/least skip NULLs, so the guard is what keeps unknown unknown
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def rnd(x: Column, digits: int) -> Column:
    """Round half up on the decimal value; the inner round drops binary noise."""
    return F.round(F.round(x.cast("double"), 10), digits)


def rnd_far(x: Column, digits: int) -> Column:
    """As ``rnd``, for many values: those of 0 to a million that are clear of a tie (3 digits
    at most) are rounded by arithmetic, without a decimal number per row."""
    d = x.cast("double")
    scaled = d * F.lit(10.0**digits)
    clear = (d >= 0.0) & (d < 1e6) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-4)
    return F.when(clear, F.floor(scaled + 0.5) / F.lit(10.0**digits)).otherwise(rnd(x, digits))


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def zero(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def renorm(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the parts that are known; NULL when none is."""
    num = total([zero(x) * F.lit(float(w)) for x, w in parts])
    den = total([F.when(x.isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for x, w in parts])
    return F.try_divide(num, den)


def mean_known(parts: list[Column]) -> Column:
    return renorm([(p, 1.0) for p in parts])


def scale(x: Column, lo: float, hi: float) -> Column:
    """Linear 0..100 position of x between two bounds, clamped."""
    return clamp((x.cast("double") - F.lit(float(lo))) / F.lit(float(hi - lo)) * 100.0)


def log_scale(x: Column, full: float) -> Column:
    """log1p saturation to 100 at ``full``."""
    d = F.greatest(x.cast("double"), F.lit(0.0))
    return F.when(x.isNotNull(), F.least(F.lit(100.0), F.log1p(d) / F.log1p(F.lit(float(full))) * 100.0))


def nonzero(x: Column) -> Column:
    """Zero falls through to the next alternative of a coalesce."""
    return F.when(x != 0, x)


def blank_to_null(s: Column) -> Column:
    t = F.trim(s)
    return F.when(t != "", t)


def pick(*cases: tuple[Column, object], default: object = None) -> Column:
    """First matching (condition, value); values may be literals or columns."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = F.when(cases[0][0], as_col(cases[0][1]))
    for cond, value in cases[1:]:
        out = out.when(cond, as_col(value))
    return out if default is None else out.otherwise(as_col(default))


def flags(*cases: tuple[Column, str]) -> Column:
    """Array of the labels whose condition is true, in the given order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in cases]))


def joined(arr: Column, sep: str = ",") -> Column:
    return F.array_join(arr, sep)


def lookup(key: Column, table: dict, default: object = None) -> Column:
    """Small fixed map; the literal map folds, and the key appears only once."""
    out = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return out if default is None else F.coalesce(out, F.lit(default))


def fenced(df, names: list[str]):
    """Keep computed columns from being inlined into later filters and projects.

    Catalyst substitutes a column's expression into every filter above it, which
    re-runs regexes and multiplies nested score formulas.  Passing the computed
    columns through a one-row inline() makes them plain attributes from here on.
    Source columns stay outside, so filters on them still reach the scan."""
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*[F.col(c) for c in names]))))


def stages(df, *steps: dict[str, Column]):
    """Add columns step by step; every step computes its values exactly once."""
    for step in steps:
        df = fenced(df.withColumns(step), list(step))
    return df


def opt(df, name: str, kind: str = "double") -> Column:
    """The column if the table has it, else a typed NULL (a missing signal)."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def n(cond: Column) -> Column:
    """count_if as BIGINT."""
    return F.count_if(cond)


EARTH_MILES = 3958.8
EARTH_MILES_GRID = 3958.7613
EARTH_METERS = 6371000.0


def _hav(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat = F.radians(lat2 - lat1)
    dlng = F.radians(lng2 - lng1)
    sin_lat = F.sin(dlat / 2)
    sin_lng = F.sin(dlng / 2)
    return sin_lat * sin_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * sin_lng * sin_lng


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = EARTH_MILES) -> Column:
    """Great-circle distance; the asin input is clamped against overshoot."""
    h = _hav(lat1, lng1, lat2, lng2)
    return F.when(h.isNotNull(), F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), h))))


def haversine_meters(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    h = _hav(lat1, lng1, lat2, lng2)
    return F.lit(2.0 * EARTH_METERS) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))
