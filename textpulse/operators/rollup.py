"""Mergeable summaries (AGG-1..5, AGG-17, AGG-18): a daily state that rolls up.

The posts are read once, into two small tables that are kept:

* the state, a row for each (day, lang, forum): counts, sums and sums of
  squares as whole numbers, the greatest distress, and an HLL sketch for each
  column whose distinct values are wanted;
* the values, a row for each (day, lang, forum, measure, value): how often each
  label occurs.

Both merge by adding up, so a new day's posts are one small union, and month,
season, weekday and overall summaries come from them without the posts. All
measures are exact (the same sums as ``aggregate.measures``): modes and
distinct counts of labels come from the values; a sketch only serves columns
of too many values for that, such as authors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse import constants as K
from textpulse.functions import dates as D
from textpulse.functions.numeric import pct, rnd, variance_of
from textpulse.operators.aggregate import SENTIMENT_SCORES, SUMMARIES

KEYS = ["day", "lang", "forum"]
LABELS = {"emotion_dominant": "dominant_emotion", "distress_level": "dominant_distress_level", "topic_label": "dominant_topic"}
WHOLE = "decimal(38,0)"
SCALE = 10_000.0


def _scores(columns: list[str]) -> list[str]:
    names = [*SENTIMENT_SCORES, *[f"emotion_{e}" for e in K.EMOTIONS], "distress_score"]
    return [c for c in names if c in columns]


def daily_state(posts: DataFrame, ts_col: str = "posted_at", sketch: tuple[str, ...] = ()) -> DataFrame:
    """The state of ``posts``; posts without a time have a null day. ``sketch``
    names columns that get an HLL sketch (``hll_<column>``)."""
    have = set(posts.columns)
    n = [F.count(F.lit(1)).alias("n")]
    for c in _scores(posts.columns):
        v = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        k = F.round(v * SCALE).cast("long")
        n += [F.count(v).alias(f"n_{c}"), F.coalesce(F.sum(k.cast("decimal(19,0)")), F.lit(0)).cast(WHOLE).alias(f"s_{c}"),
              F.coalesce(F.sum((k * k).cast("decimal(19,0)")), F.lit(0)).cast(WHOLE).alias(f"q_{c}")]
    if "sentiment_label" in have:
        n += [F.count_if(F.col("sentiment_label") == x).alias(f"n_{x}") for x in ("positive", "neutral", "negative")]
    if "distress_score" in have:
        n += [F.max("distress_score").alias("max_distress"), F.count_if(F.col("distress_score") >= K.HIGH_DISTRESS_THRESHOLD).alias("n_high")]
    if "n_tokens" in have:
        n += [F.count("n_tokens").alias("n_n_tokens"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("s_n_tokens")]
    n += [F.hll_sketch_agg(F.col(c)).alias(f"hll_{c}") for c in sketch]
    return posts.withColumn("day", F.to_date(ts_col)).groupBy(*KEYS).agg(*n)


def daily_values(posts: DataFrame, ts_col: str = "posted_at") -> DataFrame:
    """(day, lang, forum, measure, value, n): counts of the labels that
    ``posts`` has."""
    pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("string").alias("value")) for c in LABELS if c in posts.columns])
    rows = posts.select(F.to_date(ts_col).alias("day"), "lang", "forum", F.explode(pairs).alias("p"))
    counted = rows.groupBy(*KEYS, F.col("p.measure").alias("measure"), F.col("p.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("value").isNotNull())


def _add(state: DataFrame, keys: list[str]) -> DataFrame:
    def added(c: str, kind: str) -> Column:
        if c.startswith("hll_"):
            return F.hll_union_agg(c)
        if c.startswith("max_"):
            return F.max(c)
        return F.sum(c).cast(kind)

    return state.groupBy(*keys).agg(*[added(f.name, f.dataType.simpleString()).alias(f.name) for f in state.schema.fields if f.name not in {*KEYS, *keys}])


def merge_states(*states: DataFrame) -> DataFrame:
    """One state of several (of other days, or of late posts of the same days)."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return _add(out, KEYS)


def merge_values(*values: DataFrame) -> DataFrame:
    out = values[0]
    for v in values[1:]:
        out = out.unionByName(v)
    return out.groupBy(*KEYS, "measure", "value").agg(F.sum("n").alias("n"))


def _keyed(df: DataFrame) -> DataFrame:
    month = F.month("day")
    return df.withColumns({"month": month, "season": D.season(month), "weekday_name": D.weekday_name("day"), "weekday": D.weekday_num("day")})


def _finished(state: DataFrame, columns: list[str]) -> list[Column]:
    """The measures from added-up state columns."""
    def mean(c):
        return (F.floor(F.try_divide(F.col(f"s_{c}").cast("long"), F.col(f"n_{c}")) + 0.5) / SCALE).cast("double")

    def std(c):
        n = F.col(f"n_{c}")
        return F.when(n >= 2, rnd(F.sqrt(variance_of(n, F.col(f"s_{c}"), F.col(f"q_{c}"))) / SCALE))

    out = [F.col("n").alias("nb_posts")]
    for c in _scores([x[2:] for x in columns if x.startswith("s_")]):
        if c in SENTIMENT_SCORES:
            out += [mean(c).alias(f"mean_{c}"), std(c).alias(f"std_{c}")]
        elif c == "distress_score":
            out += [mean(c).alias("mean_distress"), std(c).alias("std_distress"), rnd("max_distress").alias("max_distress"),
                    pct("n_high", "n").alias("pct_high_distress")]
        else:
            out.append(mean(c).alias(f"mean_{c.removeprefix('emotion_')}"))
    out += [pct(f"n_{x}", "n").alias(f"pct_{x}") for x in ("positive", "neutral", "negative") if f"n_{x}" in columns]
    if "s_n_tokens" in columns:
        out.append(rnd(F.try_divide(F.col("s_n_tokens").cast("double"), F.col("n_n_tokens"))).alias("mean_nb_tokens"))
    out += [F.hll_sketch_estimate(c).alias(f"approx_distinct_{c.removeprefix('hll_')}") for c in columns if c.startswith("hll_")]
    return out


def roll_up(state: DataFrame, values: DataFrame, summary: str) -> DataFrame:
    """One of the four summaries (``aggregate.SUMMARIES``) from state and
    values, with the rows and numbers that ``aggregate`` gives from the posts."""
    keys = SUMMARIES[summary]
    keyed = _keyed(state).dropna(subset=keys)
    en_fr = {f"nb_posts_{x}": F.when(F.col("lang") == x, F.col("n")).otherwise(0) for x in ("en", "fr")}
    keyed = keyed.withColumns(en_fr).drop(*[c for c in ("month", "season", "weekday_name", "weekday", *KEYS) if c not in keys])
    sums = _add(keyed, keys)
    table = sums.select(*keys, "nb_posts_en", "nb_posts_fr", *_finished(sums, state.columns))
    counts = _keyed(values).dropna(subset=keys).groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))
    # The most frequent label; ties go to the smaller one. Other measures' rows are null, which min_by skips.
    order = lambda c: F.when(F.col("measure") == c, F.struct(-F.col("n"), F.col("value")))
    labels = counts.groupBy(*keys).agg(*[F.min_by("value", order(c)).alias(name) for c, name in LABELS.items()],
                                       F.count_if(F.col("measure") == "topic_label").alias("nb_unique_topics"))
    return table.join(labels, keys, "left").withColumn("nb_unique_topics", F.coalesce("nb_unique_topics", F.lit(0)))
