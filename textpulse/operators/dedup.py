"""Keep-first de-duplication (WIN-1 / SET-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_first(df: DataFrame, key: str, order_by: list[str], unique_order: bool = False) -> DataFrame:
    """One row per ``key``: the row that sorts first on ``order_by`` (nulls
    first). Null keys form one group, like pandas.

    With ``unique_order`` the caller vouches that ``order_by`` tells the rows of
    a key apart and is the same at every read (file and row number, say). The
    winners are then chosen on key and order alone, see ``_keep_first_late``.
    Otherwise the whole row goes through ``min_by``, which also picks one of
    rows that tie.

    Both combine map-side, so a hot key (null ids, a bot account holding a
    third of the rows) collapses before the shuffle instead of landing whole
    in one window task."""
    if unique_order:
        return _keep_first_late(df, key, order_by)
    cols = df.columns
    others = [c for c in cols if c != key]
    packed = F.struct(*[F.col(c) for c in others])
    ordering = F.struct(*[F.col(c) for c in order_by])
    best = df.groupBy(key).agg(F.min_by(packed, ordering).alias("_first"))
    return best.select(F.col(key), *[F.col("_first." + c).alias(c) for c in others]).select(*cols)


def _place(df: DataFrame, order_by: list[str]) -> Column:
    """The order as one value. Up to two whole numbers become a decimal, which
    a hash aggregate can hold; anything else is compared as a struct."""
    kinds = [df.schema[c].dataType for c in order_by]
    lowest = F.lit(-(1 << 63)).cast("long")
    number = lambda c: F.coalesce(df[c].cast("long"), lowest).cast("decimal(20,0)")
    small = (T.ByteType, T.ShortType, T.IntegerType)
    if len(kinds) == 1 and isinstance(kinds[0], T.IntegralType):
        return number(order_by[0])
    if len(kinds) == 2 and isinstance(kinds[0], small) and isinstance(kinds[1], T.IntegralType):
        first = F.coalesce(df[order_by[0]].cast("long"), F.lit(-(1 << 32)).cast("long")).cast("decimal(11,0)")
        return (first * F.lit("20000000000000000000").cast("decimal(20,0)") + number(order_by[1])).cast("decimal(38,0)")
    return F.struct(*[df[c] for c in order_by])


def _keep_first_late(df: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """Two phases; no wide column is aggregated, sorted by the aggregate or
    carried past the join by a row that goes.

    1. From key and order alone: the keys with more than one row, and the
       place of each one's first row.
    2. All rows but those that such a key has after its first (an anti join).

    The second side holds the repeated keys only. Where that is little the
    planner broadcasts it at run time and the rows never move; else they are
    shuffled once by key, and a hot key's rows may be split, since an anti
    join's left side can be."""
    place = _place(df, order_by)
    narrow = df.select(df[key].alias("_key"), place.alias("_place"))
    repeated = (narrow.groupBy("_key").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
                      .where(F.col("_n") > 1).select("_key", "_first"))
    return df.join(repeated, df[key].eqNullSafe(repeated["_key"]) & (place > repeated["_first"]), "left_anti")
