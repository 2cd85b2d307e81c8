"""Whole numbers for rows in a given order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.sources.sinks import materialize


def number_rows(df: DataFrame, order: list[Column], column: str = "number", name: str = "numbered") -> DataFrame:
    """``df`` with ``column``: 0, 1, 2, ... in ``order`` (rows that tie are
    numbered in any order).

    The rows are sorted by range over all partitions and written with their
    place in their partition; a partition's offset is the size of those before
    it. The driver holds one number for each partition."""
    placed = materialize(df.sparkSession, df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    offsets, total = [], 0
    for r in sizes:
        offsets += [F.lit(r["part"]), F.lit(total).cast("long")]
        total += r["n"]
    if not offsets:
        return placed.withColumn(column, F.lit(0).cast("long")).drop("_at")
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn(column, F.element_at(F.create_map(*offsets), F.shiftright("_at", 33)) + place).drop("_at")
