"""Quality profile (AGG-6, AGG-7, AGG-9..13, AGG-16, STR-15, SRT-3, SRT-5).

Everything is a distributed aggregate. Statistics that need a per-group
parameter (histogram range, box-plot fences) work on one narrow table of
(group, value), so the posts are read once. Quantiles per group are exact and
come from range refinement, for any number of distinct values; the overview's
median of token counts uses Spark's ``percentile``, whose memory grows with
the number of distinct counts (bounded by the longest text), not with rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpulse.functions.numeric import bin_edges, hist_bin, pct, rnd
from textpulse.functions.text import format_count_pct
from textpulse.operators.quantiles import exact_quantiles, number_or_null
from textpulse.sources.sinks import materialize


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """AGG-6: counts per non-null value, most frequent first (ties by value).

    The null group is dropped *after* aggregating (``count(col) > 0`` on the
    aggregate output): a filter on a derived column placed before the
    aggregate would be pushed down through every projection and re-evaluate
    the whole derivation inside the filter."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias(name), F.count(col).alias("_nn"))
              .where(F.col("_nn") > 0).drop("_nn")
              .orderBy(F.desc(name), F.col(col)))


def value_counts_pct(df: DataFrame, sections: dict[str, Column]) -> DataFrame:
    """AGG-10 / SNK-5 / STR-15: long table (section, key, n, pct, label).

    One pass: each row emits one (section, key) pair per section (a narrow
    explode of small values), partial aggregation collapses them, and the
    per-section total (nulls included, as in the analysed report) comes from
    a window over the small aggregated result."""
    pairs = F.array(*[F.struct(F.lit(s).alias("section"), c.cast("string").alias("key"))
                      for s, c in sections.items()])
    counts = (df.select(F.explode(pairs).alias("p"))
                .groupBy(F.col("p.section").alias("section"), F.col("p.key").alias("key"))
                .agg(F.count(F.lit(1)).alias("n")))
    total = F.sum("n").over(Window.partitionBy("section"))
    out = counts.withColumn("total", total).filter(F.col("key").isNotNull())
    return out.select("section", "key", "n", pct("n", "total").alias("pct"),
                      format_count_pct("n", "total").alias("label"))


def lang_pivot_counts(df: DataFrame, key: Column, key_name: str,
                      langs=("en", "fr", "other", "unknown")) -> DataFrame:
    """AGG-7: row count per key, one column per language, zero filled
    (pivot with the value list given, so no extra distinct pass)."""
    return (df.filter(key.isNotNull()).groupBy(key.alias(key_name))
              .pivot("lang", list(langs)).agg(F.count(F.lit(1))).na.fill(0, list(langs)))


def overview(df: DataFrame) -> DataFrame:
    """AGG-9: corpus overview in one global aggregate."""
    n = F.count(F.lit(1))
    out = df.agg(
        n.alias("total"),
        F.count_if("is_empty").alias("n_empty"),
        F.count_if("is_too_short").alias("n_too_short"),
        F.count_if("lang_conflict").alias("n_conflict"),
        rnd(F.try_divide(F.sum("n_tokens").cast("double"), F.count("n_tokens"))).alias("mean_tokens"),
        rnd(F.percentile(F.col("n_tokens").cast("double"), F.lit(0.5))).alias("median_tokens"),
        rnd(F.try_divide(F.sum("n_chars_clean").cast("double"), F.count("n_chars_clean"))).alias("mean_length"),
        F.min("year").alias("year_min"), F.max("year").alias("year_max"))
    return out.select("*", pct("n_empty", "total").alias("pct_empty"),
                      pct("n_too_short", "total").alias("pct_too_short"),
                      pct("n_conflict", "total").alias("pct_conflict"))


def quality_flags(df: DataFrame) -> DataFrame:
    """AGG-11 / CHT-14: quality composition. ``valid_ref`` is total - empty
    - short (slices overlap, as analysed); ``valid_exact`` counts rows that
    are neither."""
    out = df.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_empty").alias("n_empty"),
                 F.count_if("is_too_short").alias("n_too_short"),
                 F.count_if("lang_conflict").alias("n_conflict"),
                 F.count_if(~F.col("is_empty") & ~F.col("is_too_short")).alias("valid_exact"))
    return out.withColumn("valid_ref", F.col("total") - F.col("n_empty") - F.col("n_too_short"))


def _values(df: DataFrame, value_col: str, group: Column, written: bool) -> DataFrame:
    """(_g, _v): group and value of each row, written once if the value has a
    costly derivation (``written`` False: a column of a table that is read
    straight). Null and NaN values stay, as nulls: a filter here would pull the
    derivation into itself (see ``value_counts``)."""
    narrow = df.select(group.alias("_g"), number_or_null(value_col).alias("_v"))
    return materialize(df.sparkSession, narrow, "values") if written else narrow


def histogram(df: DataFrame, value_col: str, n_bins: int, group_col: str | None = None, written: bool = True) -> DataFrame:
    """AGG-12: ``n_bins`` equal bins over each group's [min, max] (last bin
    closed), densified so empty bins report 0. Output: group, bin, lo, hi, n.

    Two aggregates over the values, the range and the bins; both combine in
    each task to a row a group or bin, whatever the number of distinct values."""
    values = _values(df, value_col, F.col(group_col) if group_col else F.lit(0), written)
    stats = materialize(df.sparkSession, values.groupBy("_g").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
                        .where(F.col("_lo").isNotNull()), "ranges")
    binned = values.where(F.col("_v").isNotNull()).join(stats, "_g")
    counts = (binned.withColumn("bin", hist_bin("_v", "_lo", "_hi", n_bins))
                    .groupBy("_g", "bin").agg(F.count(F.lit(1)).alias("n")))
    domain = stats.select("_g", "_lo", "_hi",
                          F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    lo, hi = bin_edges("_lo", "_hi", "bin", n_bins)
    out = (domain.join(counts, ["_g", "bin"], "left")
                 .select(*([F.col("_g").alias(group_col)] if group_col else []), "bin", lo.alias("lo"), hi.alias("hi"),
                         F.coalesce("n", F.lit(0)).cast("long").alias("n")))
    return out.orderBy(*([group_col] if group_col else []), "bin")


def boxplot(df: DataFrame, value_col: str, group_col: str, written: bool = True) -> DataFrame:
    """AGG-13: quartiles (linear), 1.5 IQR whiskers and outlier count per group
    that is not null. The quartiles are exact and come from range refinement
    (``quantiles``); no task holds a group's values."""
    values = _values(df, value_col, F.col(group_col), written)
    q = exact_quantiles(values.where(F.col("_g").isNotNull()), "_v", [0.25, 0.5, 0.75], "_g")
    q = q.select("_g", F.col("quantiles")[0].alias("q1"), F.col("quantiles")[1].alias("median"), F.col("quantiles")[2].alias("q3"))
    j = values.where(F.col("_v").isNotNull()).join(q, "_g")
    lo_f = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi_f = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    out = j.groupBy("_g", "q1", "median", "q3").agg(
        F.min(F.when(F.col("_v") >= lo_f, F.col("_v"))).alias("whisker_lo"),
        F.max(F.when(F.col("_v") <= hi_f, F.col("_v"))).alias("whisker_hi"),
        F.count_if((F.col("_v") < lo_f) | (F.col("_v") > hi_f)).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))
    return out.withColumnRenamed("_g", group_col).orderBy(group_col)


def counter_columns(df: DataFrame) -> list[Column]:
    """AGG-16: the run counters logged by the stages, as aggregate columns."""
    from textpulse.functions.numeric import grid_mean
    cols = [F.count_if("lang_conflict").cast("double").alias("conflicts"),
            F.count_if("is_too_short").cast("double").alias("too_short"),
            F.count_if(F.col("text_clean") == "").cast("double").alias("empty_after_fallback"),
            F.count_if(F.col("n_tokens") == 0).cast("double").alias("zero_token_posts"),
            rnd(F.try_divide(F.sum("n_tokens").cast("double"), F.count("n_tokens"))).alias("mean_tokens")]
    if "score_cont" in df.columns:
        cols.append(grid_mean("score_cont").alias("mean_score"))
    if "distress_score" in df.columns:
        cols.append(grid_mean("distress_score").alias("mean_distress"))
    return cols


def observe_counters(df: DataFrame, name: str = "stage_counters"):
    """AGG-16 without an extra job: attach the counters to ``df`` with
    ``DataFrame.observe``; they are filled in when ``df`` runs its action.
    Returns (observed frame, Observation)."""
    from pyspark.sql import Observation
    obs = Observation(name)
    return df.observe(obs, *counter_columns(df)), obs


def run_counters(raw: DataFrame, enriched: DataFrame, key: str = "post_id") -> DataFrame:
    """AGG-16 as a table (counter, value): duplicates removed (rows minus
    distinct ids, null ids counting as one) plus the stage counters."""
    dup = raw.agg((F.count(F.lit(1)) - F.count_distinct(key)
                   - F.max(F.when(F.col(key).isNull(), 1).otherwise(0))).cast("double").alias("duplicates_removed"))
    stats = enriched.agg(*counter_columns(enriched))
    long = [dup.unpivot([], ["duplicates_removed"], "counter", "value"),
            stats.unpivot([], stats.columns, "counter", "value")]
    return long[0].unionByName(long[1])
