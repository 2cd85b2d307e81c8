"""Temporal / group summaries (AGG-1..5, AGG-17, AGG-18, DAT-4..6, SRT-1..2).

One measure builder, four key sets. Each summary is a single
``groupBy(keys).agg(*measures)``: partial aggregation on the map side, one
shuffle of at most (#groups x #partitions) rows, final aggregation. The key
sets are low-cardinality (12 months x languages x forums), so a hot forum
holding a third of all posts only grows the map-side partials, not the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse import constants as K
from textpulse.functions import dates as D
from textpulse.functions.numeric import grid_mean, grid_std, pct, rnd
from textpulse.sources.sinks import materialize

SENTIMENT_SCORES = ["score_pos", "score_neu", "score_neg", "score_cont"]


def exact_mean(col, digits: int = 4) -> Column:
    """Mean of an integer column: exact integer sum, one division, rounded."""
    c = F.col(col) if isinstance(col, str) else col
    return rnd(F.try_divide(F.sum(c).cast("double"), F.count(c)), digits)


def dominant(col) -> Column:
    """AGG-18: most frequent non-null value; ties -> smallest value."""
    return F.mode(F.col(col), True)


def measures(columns: list[str]) -> list[Column]:
    """AGG-1: the measure set, each only if its input column exists."""
    have = set(columns)
    n_all = F.count(F.lit(1))
    m = [n_all.alias("nb_posts")]
    if "lang" in have:
        m += [F.count_if(F.col("lang") == "en").alias("nb_posts_en"),
              F.count_if(F.col("lang") == "fr").alias("nb_posts_fr")]
    for c in SENTIMENT_SCORES:
        if c in have:
            m.append(grid_mean(c).alias(f"mean_{c}"))
            m.append(grid_std(c).alias(f"std_{c}"))
    if "sentiment_label" in have:
        for lab in ("positive", "neutral", "negative"):
            m.append(pct(F.count_if(F.col("sentiment_label") == lab), n_all).alias(f"pct_{lab}"))
    for e in K.EMOTIONS:
        if f"emotion_{e}" in have:
            m.append(grid_mean(f"emotion_{e}").alias(f"mean_{e}"))
    if "emotion_dominant" in have:
        m.append(dominant("emotion_dominant").alias("dominant_emotion"))
    if "distress_score" in have:
        d = F.col("distress_score")
        m += [grid_mean(d).alias("mean_distress"),
              grid_std(d).alias("std_distress"),
              rnd(F.max(d)).alias("max_distress"),
              pct(F.count_if(d >= K.HIGH_DISTRESS_THRESHOLD), n_all).alias("pct_high_distress")]
    if "distress_level" in have:
        m.append(dominant("distress_level").alias("dominant_distress_level"))
    if "topic_label" in have:
        m.append(dominant("topic_label").alias("dominant_topic"))
        m.append(F.count_distinct(F.col("topic_label")).alias("nb_unique_topics"))
    if "n_tokens" in have:
        m.append(exact_mean("n_tokens").alias("mean_nb_tokens"))
    return m


def summarize(df: DataFrame, keys: list[str]) -> DataFrame:
    """FLT-6 + AGG-1: drop rows with a null key, then one aggregate."""
    return df.dropna(subset=keys).groupBy(*keys).agg(*measures(df.columns))


def by_month(df: DataFrame) -> DataFrame:
    """AGG-2: month-of-year x lang x forum (years merged) + ``period``."""
    out = summarize(df, ["month", "lang", "forum"])
    out = out.withColumn("period", D.period_label("month"))
    return out.orderBy("month", "lang", "forum")


def by_season(df: DataFrame) -> DataFrame:
    """AGG-3: academic season x lang x forum, in season order."""
    out = summarize(df.withColumn("season", D.season("month")), ["season", "lang", "forum"])
    return out.orderBy(D.season_ordinal("season"), "lang", "forum")


def by_weekday(df: DataFrame, ts_col: str = "posted_at") -> DataFrame:
    """AGG-4: weekday name, weekday number (Mon = 0) x lang (no forum)."""
    d = (df.withColumn("weekday_name", D.weekday_name(ts_col))
           .withColumn("weekday", D.weekday_num(ts_col)))
    out = summarize(d, ["weekday_name", "weekday", "lang"])
    return out.orderBy("weekday", "lang")


def by_lang_forum(df: DataFrame) -> DataFrame:
    """AGG-5: lang x forum."""
    return summarize(df, ["lang", "forum"]).orderBy("lang", "forum")


#: The four summaries: their keys, and the order of their rows.
SUMMARIES = {
    "by_month": ["month", "lang", "forum"],
    "by_season": ["season", "lang", "forum"],
    "by_weekday": ["weekday_name", "weekday", "lang"],
    "global": ["lang", "forum"],
}
SUMMARY_KEYS = ["month", "season", "weekday_name", "weekday", "lang", "forum"]


def with_summary_keys(df: DataFrame, ts_col: str = "posted_at") -> DataFrame:
    """The keys of all summaries that ``df`` doesn't have yet."""
    return df.withColumns({"season": D.season("month"), "weekday_name": D.weekday_name(ts_col), "weekday": D.weekday_num(ts_col)})


def summaries_in_one(df: DataFrame, ts_col: str = "posted_at") -> DataFrame:
    """AGG-2..5 in one pass: ``GROUPING SETS`` over the four key sets. One scan
    of ``df`` and one shuffle of partial sums; a row of the result has its
    table's name in ``summary`` and null in the keys of the others. A row with
    a null key drops out of the tables that have this key (FLT-6)."""
    keyed = with_summary_keys(df, ts_col)
    # Copies, so that a measure may read a column that is also a key.
    copies = {f"_{k}": F.col(k) for k in SUMMARY_KEYS}
    grouped = keyed.withColumns(copies).groupingSets([[f"_{k}" for k in keys] for keys in SUMMARIES.values()], *[f"_{k}" for k in SUMMARY_KEYS])
    out = grouped.agg(F.grouping_id().alias("_set"), *measures(df.columns))
    # The bits of a grouping id are the keys that its set leaves out.
    ids = {name: sum(1 << (len(SUMMARY_KEYS) - 1 - i) for i, k in enumerate(SUMMARY_KEYS) if k not in keys) for name, keys in SUMMARIES.items()}
    name = there = None
    for n, keys in SUMMARIES.items():
        mine = F.col("_set") == ids[n]
        whole = mine
        for k in keys:
            whole = whole & F.col(f"_{k}").isNotNull()
        name = F.when(mine, n) if name is None else name.when(mine, n)
        there = whole if there is None else there | whole
    out = out.where(there).withColumn("summary", name)
    return out.select("summary", *[F.col(f"_{k}").alias(k) for k in SUMMARY_KEYS],
                      *[c for c in out.columns if not c.startswith("_") and c != "summary"])


def all_summaries(df: DataFrame, ts_col: str = "posted_at") -> dict[str, DataFrame]:
    """SNK-3 input: the four tables, as ``by_month`` and its like give them,
    cut from one written pass over ``df``."""
    one = materialize(df.sparkSession, summaries_in_one(df, ts_col), "summaries")
    cut = lambda name: one.where(F.col("summary") == name).drop("summary", *[k for k in SUMMARY_KEYS if k not in SUMMARIES[name]])
    return {"by_month": cut("by_month").withColumn("period", D.period_label("month")).orderBy("month", "lang", "forum"),
            "by_season": cut("by_season").orderBy(D.season_ordinal("season"), "lang", "forum"),
            "by_weekday": cut("by_weekday").orderBy("weekday", "lang"),
            "global": cut("global").orderBy("lang", "forum")}
