"""Numeric / conditional column functions (MTH-*, WIN-2, WIN-3, PRJ-8).

Rounding is ``floor(x * 10^d + 0.5) / 10^d`` (half-up on the binary value):
the same expression gives bit-identical results in Spark and in any SQL
engine, unlike the various built-in ``round`` implementations.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textpulse import constants as K


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def rnd(col, digits: int = 4) -> Column:
    """MTH-6: round half-up to ``digits`` places (null stays null, NaN
    becomes null: a failed score must not look like a real zero)."""
    scale = float(10 ** digits)
    value = F.nanvl(_c(col).cast("double"), F.lit(None).cast("double"))
    return (F.floor(value * scale + 0.5) / scale).cast("double")


def grid_mean(col, digits: int = 4) -> Column:
    """Mean of values that already sit on a 10^-digits grid, rounded to the
    same grid. Summed as integers so the result does not depend on the order
    rows are added in (partition layout, engine)."""
    scale = 10 ** digits
    c = F.nanvl(_c(col).cast("double"), F.lit(None).cast("double"))
    ints = F.sum(F.round(c * float(scale)).cast("long"))
    return (F.floor(F.try_divide(ints, F.count(c)) + 0.5) / float(scale)).cast("double")


def grid_std(col, digits: int = 4) -> Column:
    """Sample standard deviation (n - 1) of values on a 10^-digits grid,
    rounded to the same grid; null for fewer than two values.

    Computed from exact integer sums (n, sum k, sum k^2 with k = v * 10^d)
    so it is independent of summation order; the only floating steps are one
    division and one square root of exact integers. Sums and products are
    decimals: n * (n - 1) leaves a long above 3e9 rows in a group."""
    scale = 10 ** digits
    c = F.nanvl(_c(col).cast("double"), F.lit(None).cast("double"))
    k = F.round(c * float(scale)).cast("long")
    n = F.count(c)
    s1 = F.sum(k.cast("decimal(19,0)"))
    s2 = F.sum((k * k).cast("decimal(19,0)"))
    var = variance_of(n, s1, s2)
    return F.when(n >= 2, rnd(F.sqrt(var) / float(scale), digits))


def variance_of(n: Column, s1: Column, s2: Column) -> Column:
    """Sample variance from a count, a sum and a sum of squares of integers."""
    dec = "decimal(38,0)"
    num = n.cast(dec) * s2.cast(dec) - s1.cast(dec) * s1.cast(dec)
    return num.cast("double") / (n.cast(dec) * (n.cast(dec) - 1)).cast("double")


def pct(num, den, digits: int = 2) -> Column:
    """MTH-7: ``num / den * 100`` rounded; null when ``den`` is 0."""
    scale = float(10 ** digits)
    n = _c(num)
    d = _c(den)
    return F.when(d > 0, (F.floor(n * (100.0 * scale) / d + 0.5) / scale).cast("double"))


def to_bool(col) -> Column:
    """PRJ-8: 'true'/'false' in any case -> boolean; anything else False."""
    return F.coalesce(F.lower(_c(col).cast("string")) == "true", F.lit(False))


def argmax_name(cols: dict[str, Column], null_if_zero: bool = True) -> Column:
    """WIN-2: name of the largest of several columns, first name wins ties.

    ``cols`` maps output name -> column, in tie-break order. With
    ``null_if_zero`` the result is null when the maximum is 0.
    """
    names = list(cols)
    top = F.greatest(*[cols[n] for n in names])
    expr = None
    for n in names:
        expr = (F.when(cols[n] == top, F.lit(n)) if expr is None
                else expr.when(cols[n] == top, F.lit(n)))
    if null_if_zero:
        return F.when(top > 0, expr)
    return expr


def distress_score(anger, fear, sadness) -> Column:
    """MTH-2: (fear + sadness + 0.5 anger) / 2.5, nulls as 0, rounded."""
    w = K.DISTRESS_WEIGHTS
    total = (w["fear"] * F.coalesce(_c(fear), F.lit(0.0))
             + w["sadness"] * F.coalesce(_c(sadness), F.lit(0.0))
             + w["anger"] * F.coalesce(_c(anger), F.lit(0.0)))
    return rnd(total / K.DISTRESS_DIVISOR, 4)


def distress_level(col) -> Column:
    """MTH-3: right-closed bins, first bin closed on the left; else null."""
    c = _c(col)
    e = K.DISTRESS_EDGES
    lv = K.DISTRESS_LEVELS
    return (F.when((c >= e[0]) & (c <= e[1]), lv[0])
            .when((c > e[1]) & (c <= e[2]), lv[1])
            .when((c > e[2]) & (c <= e[3]), lv[2])
            .when((c > e[3]) & (c <= e[4]), lv[3]))


def level_ordinal(col, levels: list[str]) -> Column:
    """Position of a value inside an ordered domain (SRT-2)."""
    expr = None
    c = _c(col)
    for i, v in enumerate(levels):
        expr = F.when(c == v, F.lit(i)) if expr is None else expr.when(c == v, F.lit(i))
    return expr


def hist_bin(col, lo, hi, n: int) -> Column:
    """AGG-12 bin index for ``n`` equal bins over [lo, hi], last bin closed.

    When lo == hi the range is widened to [lo - .5, hi + .5] (NumPy rule).
    """
    c = _c(col)
    lo_c = _c(lo)
    hi_c = _c(hi)
    lo2 = F.when(lo_c == hi_c, lo_c - 0.5).otherwise(lo_c)
    hi2 = F.when(lo_c == hi_c, hi_c + 0.5).otherwise(hi_c)
    b = F.floor((c - lo2) / (hi2 - lo2) * n)
    return F.least(b, F.lit(n - 1)).cast("int")


def bin_edges(lo, hi, idx, n: int) -> tuple[Column, Column]:
    lo_c = _c(lo)
    hi_c = _c(hi)
    lo2 = F.when(lo_c == hi_c, lo_c - 0.5).otherwise(lo_c)
    hi2 = F.when(lo_c == hi_c, hi_c + 0.5).otherwise(hi_c)
    width = (hi2 - lo2) / n
    i = _c(idx)
    return lo2 + i * width, lo2 + (i + 1) * width
