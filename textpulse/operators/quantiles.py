"""Exact quantiles by repeated range refinement (AGG-9, AGG-13, SRT-5).

No task sorts or holds a group's values. For each order statistic wanted, the
range that holds it is known; a round counts the values of each range in
``BINS`` bins (with each bin's least and greatest value) and keeps the bin that
holds the rank. A range whose ends are equal is the answer. Bins are linear,
or by sign and power of two where a range spans many, so doubles of any spread
take a handful of rounds. Values outside all ranges are left behind after each
round, so later rounds read little.

Counts combine map-side: a group with a third of all rows gives each task
``BINS`` rows a range at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpulse.sources.sinks import materialize

BINS = 4096
SPREAD = float(1 << 20)


def number_or_null(col) -> Column:
    """As a double; NaN counts as null."""
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.nanvl(c, F.lit(None).cast("double")) + F.lit(0.0)  # -0.0 is 0.0


def _bin(v: Column, lo: Column, hi: Column, bins: int, first: bool) -> Column:
    """A whole number that never falls as ``v`` rises, and that differs for the
    two ends of a range."""
    linear = F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1).cast("long"))
    power = lambda x: F.when(x == float("inf"), F.lit(2200).cast("long")).otherwise(F.floor(F.log2(x)) + 1100)
    by_power = F.when(v == 0, F.lit(0).cast("long")).when(v > 0, power(v)).otherwise(-power(-v))
    if first:
        wide = F.abs(lo).isin(float("inf")) | F.abs(hi).isin(float("inf")) | ((hi - lo) == float("inf"))
    else:
        small, large = F.least(F.abs(lo), F.abs(hi)), F.greatest(F.abs(lo), F.abs(hi))
        wide = ((lo < 0) & (hi > 0)) | (large > small * SPREAD)
    return F.when(lo == hi, F.lit(0).cast("long")).when(wide, by_power).otherwise(linear)


def exact_quantiles(df: DataFrame, value_col: str, fractions: list[float], group_col: str | None = None,
                    bins: int = BINS) -> DataFrame:
    """Per group (null is a group of its own; one row without ``group_col``):
    ``n`` values that are not null, ``least``, ``greatest`` and ``quantiles``,
    one for each fraction, with linear interpolation. Groups without a value
    are left out. ``df`` is read twice: pass a written table or a scan."""
    spark = df.sparkSession
    group = F.col(group_col) if group_col else F.lit(0)
    values = df.select(group.alias("g"), number_or_null(value_col).alias("v")).where("v IS NOT NULL")
    stats = materialize(spark, values.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "quantile-groups")
    wanted = F.array(*[F.struct(F.lit(i).alias("f"), ((F.col("n") - 1) * F.lit(float(q))).alias("at"), F.lit(e).alias("up")) for i, q in enumerate(fractions) for e in (0, 1)])
    found = stats.select("g", "n", "lo", "hi", F.explode(wanted).alias("w")).select("g", "n", "lo", "hi", "w.f", "w.up", "w.at")
    rank = F.least(F.floor("at") + F.col("up"), F.col("n") - 1)
    targets = materialize(spark, found.select("g", "f", "up", "at", rank.cast("long").alias("k"), "lo", "hi", F.lit(0).cast("long").alias("below")), "quantile-targets")
    done, first = None, True
    while True:
        over = targets.where("lo = hi")
        done = over if done is None else done.unionByName(over)
        targets = targets.where("lo < hi")
        if targets.isEmpty():
            break
        ranges = targets.select(F.col("g").alias("_g"), "lo", "hi").distinct()
        inside = values.select("g", "v").join(ranges, values["g"].eqNullSafe(ranges["_g"]) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        counted = inside.groupBy("g", "lo", "hi", _bin(F.col("v"), F.col("lo"), F.col("hi"), bins, first).alias("bin")) \
            .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
        upto = F.sum("c").over(Window.partitionBy("g", "lo", "hi").orderBy("bin"))
        counted = counted.withColumn("_upto", upto).select(F.col("g").alias("_g"), F.col("lo").alias("_rlo"), F.col("hi").alias("_rhi"), "c", "_lo", "_hi", "_upto")
        here = targets["g"].eqNullSafe(counted["_g"]) & (F.col("lo") == F.col("_rlo")) & (F.col("hi") == F.col("_rhi"))
        ranked = (F.col("k") - F.col("below") < F.col("_upto")) & (F.col("k") - F.col("below") >= F.col("_upto") - F.col("c"))
        narrowed = targets.join(counted, here & ranked).select(
            "g", "f", "up", "at", "k", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), (F.col("below") + F.col("_upto") - F.col("c")).alias("below"))
        targets = materialize(spark, narrowed, "quantile-targets")
        live = targets.where("lo < hi").select(F.col("g").alias("_g"), "lo", "hi").distinct()
        # A rank counts from its range's first value, so values outside the ranges can go.
        values = materialize(spark, values.join(live, values["g"].eqNullSafe(live["_g"]) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")), "left_semi"), "quantile-values")
        first = False
    pair = done.groupBy("g", "f").agg(F.first("at").alias("at"), F.max(F.when(F.col("up") == 0, F.col("lo"))).alias("a"), F.max(F.when(F.col("up") == 1, F.col("lo"))).alias("b"))
    share = F.col("at") - F.floor("at")
    value = F.when((share == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise(F.col("a") * (1 - share) + F.col("b") * share)
    lists = pair.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("f", value.alias("q")))).alias("_q")).select(F.col("g").alias("_g"), F.transform("_q", lambda x: x["q"]).alias("quantiles"))
    out = stats.join(lists, stats["g"].eqNullSafe(lists["_g"]))
    return out.select(*([F.col("g").alias(group_col)] if group_col else []), "n", F.col("lo").alias("least"), F.col("hi").alias("greatest"), "quantiles")
