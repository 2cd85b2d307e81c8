"""Chart datasets (CHT-1..14, JOI-5, SRT-4, DAT-7): the data behind each
figure, as DataFrames. Drawing is left to the caller.

Densified outputs (4 distress levels, 6 seasons, 7 weekdays) join the
aggregate onto a literal domain with a left join, so missing groups appear
with 0 / null instead of disappearing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse import constants as K
from textpulse.functions import dates as D
from textpulse.functions.numeric import grid_mean
from textpulse.functions.text import excerpt


def _domain(spark: SparkSession, name: str, values: list, ordinal: str = "ord") -> DataFrame:
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], [name, ordinal])


def emotion_means(df: DataFrame) -> DataFrame:
    """CHT-3 / AGG-15: corpus mean of each emotion (one row)."""
    return df.agg(*[grid_mean(f"emotion_{e}").alias(f"mean_{e}") for e in K.EMOTIONS])


def emotion_by(df: DataFrame, key: str) -> DataFrame:
    """CHT-5 / CHT-6 / AGG-15: per-key mean of each emotion."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
              .agg(*[grid_mean(f"emotion_{e}").alias(f"mean_{e}") for e in K.EMOTIONS])
              .orderBy(key))


def emotion_heatmap(df: DataFrame, key: str = "forum") -> DataFrame:
    """CHT-6 in long form: (key, emotion, mean) via ``unpivot``."""
    wide = emotion_by(df, key)
    return wide.unpivot(key, [f"mean_{e}" for e in K.EMOTIONS], "emotion", "mean").select(
        key, F.regexp_replace("emotion", "^mean_", "").alias("emotion"), "mean")


def distress_levels_dense(df: DataFrame) -> DataFrame:
    """CHT-4 / JOI-5: posts per distress level, all four levels present.

    One conditional count per level in a single aggregate, then one row per
    level. (A join of the level domain onto grouped counts would make the
    optimizer infer ``isnotnull(distress_level)`` and push it, with the whole
    score derivation, into a filter under the aggregate.)"""
    lv = K.DISTRESS_LEVELS
    counts = df.agg(*[F.count_if(F.col("distress_level") == v).alias(f"_n{i}") for i, v in enumerate(lv)])
    rows = F.array(*[F.struct(F.lit(v).alias("distress_level"), F.lit(i).alias("ord"),
                              F.col(f"_n{i}").alias("n")) for i, v in enumerate(lv)])
    return counts.select(F.explode(rows).alias("r")).select("r.*").orderBy("ord")


def mean_by_lang(df: DataFrame, key: str, value: str, langs=("en", "fr", "other", "unknown")) -> DataFrame:
    """AGG-8: per-key mean of ``value``, one column per language."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
              .agg(*[grid_mean(F.when(F.col("lang") == lg, F.col(value))).alias(lg) for lg in langs])
              .orderBy(key))


def distress_season_dense(df: DataFrame) -> DataFrame:
    """CHT-7: mean distress per academic season (all six) for en / fr,
    null -> 0."""
    spark = df.sparkSession
    m = mean_by_lang(df.withColumn("season", D.season("month")), "season", "distress_score")
    dom = _domain(spark, "season", K.SEASON_ORDER)
    return (dom.join(m, "season", "left")
               .select("season", "ord", F.coalesce("en", F.lit(0.0)).alias("en"),
                       F.coalesce("fr", F.lit(0.0)).alias("fr"))
               .orderBy("ord"))


def weekday_patterns(df: DataFrame, ts_col: str = "posted_at", value: str = "score_cont") -> DataFrame:
    """CHT-8 / AGG-14: per weekday (all seven) post count, and mean score for
    en / fr (null when a weekday has none)."""
    spark = df.sparkSession
    d = df.withColumn("weekday", D.weekday_num(ts_col))
    m = (d.filter(F.col("weekday").isNotNull()).groupBy("weekday")
          .agg(F.count(F.lit(1)).alias("n"),
               grid_mean(F.when(F.col("lang") == "en", F.col(value))).alias("mean_en"),
               grid_mean(F.when(F.col("lang") == "fr", F.col(value))).alias("mean_fr")))
    dom = spark.createDataFrame([(i, n, fr) for i, (n, fr) in
                                 enumerate(zip(K.WEEKDAY_NAMES, K.WEEKDAY_LABELS_FR))],
                                "weekday int, weekday_name string, weekday_label string")
    return (dom.join(m, "weekday", "left")
               .select("weekday", "weekday_name", "weekday_label",
                       F.coalesce("n", F.lit(0)).alias("n"), "mean_en", "mean_fr")
               .orderBy("weekday"))


def monthly_counts(df: DataFrame) -> DataFrame:
    """CHT-1 / AGG-14: posts per month of year with the French label."""
    return (df.filter(F.col("month").isNotNull()).groupBy("month")
              .agg(F.count(F.lit(1)).alias("n"))
              .withColumn("month_label", D.month_label_fr("month")).orderBy("month"))


def top_distress(df: DataFrame, n: int = K.TOP_DISTRESS_POSTS) -> DataFrame:
    """CHT-9 / SRT-4 / STR-13: the n most distressed posts (nulls last, ties
    by post id) with an excerpt. ``orderBy().limit()`` plans as a per-
    partition top-n and a merge of n rows per partition; no global sort.
    The limit is the report itself (a top-k)."""
    shown = [c for c in ("post_id", "forum", "lang", "distress_score", "distress_level",
                         "sentiment_label", "emotion_dominant") if c in df.columns]
    return (df.orderBy(F.desc_nulls_last("distress_score"), F.col("post_id")).limit(n)
              .select(*shown, excerpt("text_clean").alias("excerpt")))


__all__ = ["emotion_means", "emotion_by", "emotion_heatmap", "distress_levels_dense",
           "mean_by_lang", "distress_season_dense", "weekday_patterns", "monthly_counts",
           "top_distress"]
