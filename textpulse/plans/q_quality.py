"""Registered queries: quality profile and chart datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpulse import constants as K
from textpulse.functions import dates as D
from textpulse.functions.numeric import rnd
from textpulse.operators import charts as CH
from textpulse.operators import quality as QU
from textpulse.operators.quantiles import exact_quantiles
from textpulse.plans import fixtures as FX
from textpulse.plans import sqlgen as S
from textpulse.plans.registry import register
from textpulse.sources.sinks import materialize
from textpulse.plans.stages import clean_table, enriched_table, sentiment_table


def _clean(select: str) -> str:
    return f"WITH {S.clean_cte()}\n{select}"


def _enriched(select: str) -> str:
    return f"WITH {S.enriched_cte()}\n{select}"


def _label_sql(n: str, total: str) -> str:
    share = S.rnd(f"CAST({n} AS DOUBLE) * 100.0::DOUBLE / {total}", 1)
    return f"(CASE WHEN {total} > 0 THEN format('{{:,}}', {n}) || ' (' || printf('%.1f', {share}) || '%)' END)"


def _gmean_if(cond: str, col: str) -> str:
    return S.grid_mean(f"CASE WHEN {cond} THEN {col} END")


@register("value_counts_pct", sql=lambda: _clean(f""", pairs AS (
  SELECT 'forum' AS section, forum AS key FROM clean UNION ALL
  SELECT 'lang', lang FROM clean UNION ALL
  SELECT 'source', text_source FROM clean UNION ALL
  SELECT 'year', CAST(year AS VARCHAR) FROM clean),
counts AS (SELECT section, key, count(*) AS n FROM pairs GROUP BY section, key),
tot AS (SELECT *, sum(n) OVER (PARTITION BY section) AS total FROM counts)
SELECT section, key, n, {S.pct('n', 'total')} AS pct, {_label_sql('n', 'total')} AS label
FROM tot WHERE key IS NOT NULL"""))
def value_counts_pct_query(spark, sf_dir):
    """AGG-6, AGG-10, STR-15, SNK-5: report counts and shares by forum,
    language, text source and year."""
    c = clean_table(spark, sf_dir)
    return QU.value_counts_pct(c, {"forum": F.col("forum"), "lang": F.col("lang"),
                                   "source": F.col("text_source"), "year": F.col("year")})


@register("month_lang_pivot", sql=lambda: _clean("""
SELECT make_date(year, month, 1) AS period,
  count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'fr') AS fr,
  count(*) FILTER (WHERE lang = 'other') AS other, count(*) FILTER (WHERE lang = 'unknown') AS unknown
FROM clean WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY 1"""))
def month_lang_pivot_query(spark, sf_dir):
    """AGG-7, FLT-5, DAT-3, CHT-12: posts per month x language, pivoted."""
    c = clean_table(spark, sf_dir)
    return QU.lang_pivot_counts(c, D.month_start("year", "month"), "period")


@register("mean_by_lang_pivot", sql=lambda: _enriched(f"""
SELECT month, {_gmean_if("lang = 'en'", 'score_cont')} AS en, {_gmean_if("lang = 'fr'", 'score_cont')} AS fr,
  {_gmean_if("lang = 'other'", 'score_cont')} AS other, {_gmean_if("lang = 'unknown'", 'score_cont')} AS unknown
FROM enriched WHERE month IS NOT NULL GROUP BY month"""))
def mean_by_lang_query(spark, sf_dir):
    """AGG-8, CHT-2: monthly mean sentiment score, one column per language."""
    return CH.mean_by_lang(sentiment_table(spark, sf_dir), "month", "score_cont")


@register("overview", sql=lambda: _clean(f"""
SELECT *, {S.pct('n_empty', 'total')} AS pct_empty, {S.pct('n_too_short', 'total')} AS pct_too_short,
  {S.pct('n_conflict', 'total')} AS pct_conflict
FROM (SELECT count(*) AS total, count(*) FILTER (WHERE is_empty) AS n_empty,
  count(*) FILTER (WHERE is_too_short) AS n_too_short, count(*) FILTER (WHERE lang_conflict) AS n_conflict,
  {S.rnd('CAST(sum(n_tokens) AS DOUBLE) / count(n_tokens)')} AS mean_tokens,
  {S.rnd('quantile_cont(CAST(n_tokens AS DOUBLE), 0.5)')} AS median_tokens,
  {S.rnd('CAST(sum(n_chars_clean) AS DOUBLE) / count(n_chars_clean)')} AS mean_length,
  min(year) AS year_min, max(year) AS year_max FROM clean)"""))
def overview_query(spark, sf_dir):
    """AGG-9: corpus overview."""
    return QU.overview(clean_table(spark, sf_dir))


@register("quality_flags", sql=lambda: _clean("""
SELECT *, total - n_empty - n_too_short AS valid_ref FROM (
  SELECT count(*) AS total, count(*) FILTER (WHERE is_empty) AS n_empty,
    count(*) FILTER (WHERE is_too_short) AS n_too_short, count(*) FILTER (WHERE lang_conflict) AS n_conflict,
    count(*) FILTER (WHERE NOT is_empty AND NOT is_too_short) AS valid_exact FROM clean)"""))
def quality_flags_query(spark, sf_dir):
    """AGG-11, CHT-14: quality composition."""
    return QU.quality_flags(clean_table(spark, sf_dir))


def _hist_sql(src: str, value: str, n: int, group: str | None) -> str:
    g = group or "0"
    gsel = f"{group} AS g" if group else "0 AS g"
    lo2 = "(CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END)"
    hi2 = "(CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END)"
    width = f"(({hi2} - {lo2}) / {n})"
    out_g = f"g AS {group}, " if group else ""
    return f""", hb AS (SELECT {gsel}, CAST({value} AS DOUBLE) AS v FROM {src} WHERE {value} IS NOT NULL),
hs AS (SELECT g, min(v) AS lo, max(v) AS hi FROM hb GROUP BY g),
hc AS (SELECT hb.g, CAST(least(floor((v - {lo2}) / ({hi2} - {lo2}) * {n}), {n - 1}) AS INTEGER) AS bin, count(*) AS n
       FROM hb JOIN hs ON hb.g = hs.g GROUP BY 1, 2),
hd AS (SELECT g, lo, hi, CAST(unnest(range(0, {n})) AS INTEGER) AS bin FROM hs)
SELECT {out_g.replace("g AS", "hd.g AS")}hd.bin, {lo2} + hd.bin * {width} AS lo, {lo2} + (hd.bin + 1) * {width} AS hi,
  CAST(coalesce(hc.n, 0) AS BIGINT) AS n
FROM hd LEFT JOIN hc ON hc.g = hd.g AND hc.bin = hd.bin""".replace("{g}", g)


@register("histogram_tokens", sql=lambda: _clean(_hist_sql("clean", "n_tokens", K.TOKEN_HIST_BINS, None)))
def histogram_tokens_query(spark, sf_dir):
    """AGG-12, CHT-13: token-count histogram, 50 bins."""
    return QU.histogram(clean_table(spark, sf_dir), "n_tokens", K.TOKEN_HIST_BINS)


@register("histogram_score_lang", sql=lambda: _enriched(
    _hist_sql("(SELECT * FROM enriched WHERE lang IN ('en', 'fr'))", "score_cont", K.SCORE_HIST_BINS, "lang")))
def histogram_score_query(spark, sf_dir):
    """AGG-12, CHT-2: sentiment-score histogram per language (own range), 40 bins."""
    e = sentiment_table(spark, sf_dir).filter(F.col("lang").isin("en", "fr"))
    return QU.histogram(e, "score_cont", K.SCORE_HIST_BINS, group_col="lang")


@register("histogram_distress", sql=lambda: _enriched(
    _hist_sql("enriched", "distress_score", K.DISTRESS_HIST_BINS, None)))
def histogram_distress_query(spark, sf_dir):
    """AGG-12, CHT-4: distress-score histogram, 50 bins."""
    return QU.histogram(enriched_table(spark, sf_dir), "distress_score", K.DISTRESS_HIST_BINS)


@register("histogram_event_value", sql=lambda: "WITH " + _hist_sql(
    "events", "value", K.SCORE_HIST_BINS, "event_type").lstrip(", "))
def histogram_event_query(spark, sf_dir):
    """AGG-12 on the events table: value histogram per event type."""
    ev = FX.read_table(spark, sf_dir, "events")
    return QU.histogram(ev, "value", K.SCORE_HIST_BINS, group_col="event_type", written=False)


@register("boxplot_event_value", sql=lambda: f"""WITH
b AS (SELECT event_type, CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL),
q AS (SELECT event_type, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
      FROM b GROUP BY event_type)
SELECT b.event_type, {S.rnd('q1', 6)} AS q1, {S.rnd('median', 6)} AS median, {S.rnd('q3', 6)} AS q3,
  min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END) AS whisker_lo,
  max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_hi,
  count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_outliers,
  count(*) AS n
FROM b JOIN q USING (event_type) GROUP BY b.event_type, q1, median, q3""")
def boxplot_event_query(spark, sf_dir):
    """AGG-13, SRT-5 on a continuous column: box-plot statistics of the event
    values by event type, by range refinement."""
    ev = FX.read_table(spark, sf_dir, "events")
    out = QU.boxplot(ev, "value", "event_type", written=False)
    return out.withColumns({c: rnd(c, 6) for c in ("q1", "median", "q3")})


@register("order_price_quantiles", sql=lambda: f"""
SELECT o_orderpriority, count(*) AS n, min(v) AS least, max(v) AS greatest,
  {S.rnd('quantile_cont(v, 0.01)', 6)} AS p01, {S.rnd('quantile_cont(v, 0.5)', 6)} AS p50, {S.rnd('quantile_cont(v, 0.999)', 6)} AS p999
FROM (SELECT o_orderpriority, CAST(o_totalprice AS DOUBLE) AS v FROM orders) WHERE v IS NOT NULL GROUP BY o_orderpriority""")
def order_quantiles_query(spark, sf_dir):
    """AGG-9, SRT-5 on nearly distinct values: exact quantiles of order prices
    by priority, by range refinement."""
    o = FX.read_table(spark, sf_dir, "orders")
    q = exact_quantiles(o, "o_totalprice", [0.01, 0.5, 0.999], "o_orderpriority")
    return q.select("o_orderpriority", "n", "least", "greatest",
                    *[rnd(F.col("quantiles")[i], 6).alias(c) for i, c in enumerate(("p01", "p50", "p999"))])


@register("boxplot_lang", sql=lambda: _clean("""
, b AS (SELECT lang, CAST(n_tokens AS DOUBLE) AS v FROM clean WHERE n_tokens IS NOT NULL AND lang IS NOT NULL),
q AS (SELECT lang, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
      FROM b GROUP BY lang)
SELECT b.lang, q1, median, q3,
  min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END) AS whisker_lo,
  max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_hi,
  count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_outliers,
  count(*) AS n
FROM b JOIN q ON b.lang = q.lang GROUP BY b.lang, q1, median, q3"""))
def boxplot_query(spark, sf_dir):
    """AGG-13, SRT-5, CHT-13: token counts by language, box-plot statistics."""
    return QU.boxplot(clean_table(spark, sf_dir), "n_tokens", "lang")


@register("emotion_means", sql=lambda: _enriched(
    "SELECT " + ", ".join(f"{S.grid_mean(f'emotion_{e}')} AS mean_{e}" for e in K.EMOTIONS) + " FROM enriched"))
def emotion_means_query(spark, sf_dir):
    """AGG-15, CHT-3: corpus mean of each emotion."""
    return CH.emotion_means(enriched_table(spark, sf_dir))


@register("emotion_by_month", sql=lambda: _enriched(
    "SELECT month, " + ", ".join(f"{S.grid_mean(f'emotion_{e}')} AS mean_{e}" for e in K.EMOTIONS)
    + " FROM enriched WHERE month IS NOT NULL GROUP BY month"))
def emotion_by_month_query(spark, sf_dir):
    """AGG-15, CHT-5: month x eight emotion means."""
    return CH.emotion_by(enriched_table(spark, sf_dir), "month")


@register("emotion_heatmap", sql=lambda: _enriched(
    " UNION ALL ".join(f"SELECT forum, {S.q(e)} AS emotion, {S.grid_mean(f'emotion_{e}')} AS mean "
                       f"FROM enriched WHERE forum IS NOT NULL GROUP BY forum" for e in K.EMOTIONS)))
def emotion_heatmap_query(spark, sf_dir):
    """AGG-15, CHT-6: forum x emotion means, long form (unpivot)."""
    return CH.emotion_heatmap(enriched_table(spark, sf_dir), "forum")


@register("dominant_emotion_counts", sql=lambda: _enriched(
    "SELECT emotion_dominant, count(*) AS n FROM enriched WHERE emotion_dominant IS NOT NULL GROUP BY 1"))
def dominant_counts_query(spark, sf_dir):
    """AGG-6, CHT-3: posts per dominant emotion."""
    return QU.value_counts(enriched_table(spark, sf_dir), "emotion_dominant")


def _levels_values() -> str:
    return ", ".join(f"({S.q(v)}, {i})" for i, v in enumerate(K.DISTRESS_LEVELS))


@register("distress_levels_dense", sql=lambda: _enriched(f""", dom AS (SELECT * FROM (VALUES {_levels_values()}) t(distress_level, ord)),
c AS (SELECT distress_level, count(*) AS n FROM enriched WHERE distress_level IS NOT NULL GROUP BY 1)
SELECT dom.distress_level, CAST(dom.ord AS INTEGER) AS ord, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM dom LEFT JOIN c ON c.distress_level = dom.distress_level"""))
def distress_levels_query(spark, sf_dir):
    """JOI-5, CHT-4: posts per distress level, all four levels."""
    return CH.distress_levels_dense(enriched_table(spark, sf_dir))


@register("distress_season_dense", sql=lambda: _enriched(f""", dom AS (SELECT * FROM (VALUES {', '.join(f"({S.q(v)}, {i})" for i, v in enumerate(K.SEASON_ORDER))}) t(season, ord)),
m AS (SELECT season, {_gmean_if("lang = 'en'", 'distress_score')} AS en, {_gmean_if("lang = 'fr'", 'distress_score')} AS fr
      FROM (SELECT *, {S.season('month')} AS season FROM enriched) WHERE season IS NOT NULL GROUP BY season)
SELECT dom.season, CAST(dom.ord AS BIGINT) AS ord, coalesce(m.en, 0.0) AS en, coalesce(m.fr, 0.0) AS fr
FROM dom LEFT JOIN m ON m.season = dom.season"""))
def distress_season_query(spark, sf_dir):
    """JOI-5, CHT-7, DAT-6: mean distress per season (all six) for en / fr."""
    return CH.distress_season_dense(enriched_table(spark, sf_dir))


def _weekday_dom() -> str:
    return ", ".join(f"({i}, {S.q(n)}, {S.q(fr)})"
                     for i, (n, fr) in enumerate(zip(K.WEEKDAY_NAMES, K.WEEKDAY_LABELS_FR)))


@register("weekday_patterns", sql=lambda: _enriched(f""", dom AS (SELECT * FROM (VALUES {_weekday_dom()}) t(weekday, weekday_name, weekday_label)),
m AS (SELECT CAST((dayofweek(posted_at) + 6) % 7 AS INTEGER) AS weekday, count(*) AS n,
        {_gmean_if("lang = 'en'", 'score_cont')} AS mean_en, {_gmean_if("lang = 'fr'", 'score_cont')} AS mean_fr
      FROM enriched WHERE posted_at IS NOT NULL GROUP BY 1)
SELECT CAST(dom.weekday AS INTEGER) AS weekday, dom.weekday_name, dom.weekday_label,
  CAST(coalesce(m.n, 0) AS BIGINT) AS n, m.mean_en, m.mean_fr
FROM dom LEFT JOIN m ON m.weekday = dom.weekday"""))
def weekday_patterns_query(spark, sf_dir):
    """AGG-14, CHT-8, JOI-5: weekday counts (all seven) and mean score by language."""
    return CH.weekday_patterns(sentiment_table(spark, sf_dir))


@register("weekday_events", sql=lambda: f"""WITH dom AS (SELECT * FROM (VALUES {_weekday_dom()}) t(weekday, weekday_name, weekday_label)),
m AS (SELECT CAST((dayofweek(ts) + 6) % 7 AS INTEGER) AS weekday, count(*) AS n,
        {S.rnd('avg(value)')} AS mean_value FROM events WHERE ts IS NOT NULL GROUP BY 1)
SELECT CAST(dom.weekday AS INTEGER) AS weekday, dom.weekday_name, CAST(coalesce(m.n, 0) AS BIGINT) AS n, m.mean_value
FROM dom LEFT JOIN m ON m.weekday = dom.weekday""")
def weekday_events_query(spark, sf_dir):
    """AGG-14, DAT-4, DAT-5, JOI-5 on the events table: events per weekday
    (all seven) and mean value."""
    ev = FX.read_table(spark, sf_dir, "events")
    m = (ev.filter(F.col("ts").isNotNull()).groupBy(D.weekday_num("ts").alias("weekday"))
           .agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("value")).alias("mean_value")))
    dom = spark.createDataFrame([(i, n) for i, n in enumerate(K.WEEKDAY_NAMES)],
                                "weekday int, weekday_name string")
    return (dom.join(m, "weekday", "left")
               .select("weekday", "weekday_name", F.coalesce("n", F.lit(0)).alias("n"), "mean_value"))


@register("corpus_overview", sql=lambda: _clean(f"""
SELECT 'forum' AS dim, forum AS key, count(*) AS n FROM clean WHERE forum IS NOT NULL GROUP BY forum
UNION ALL SELECT 'lang', lang, count(*) FROM clean WHERE lang IS NOT NULL GROUP BY lang
UNION ALL SELECT 'month', {S.case_map('month', {i + 1: m for i, m in enumerate(K.MONTH_LABELS_FR)})}, count(*)
  FROM clean WHERE month IS NOT NULL GROUP BY month"""))
def corpus_overview_query(spark, sf_dir):
    """CHT-1, CHT-10, CHT-11, AGG-6, AGG-14, DAT-7: counts by forum,
    language and month (French month labels), long form."""
    c = clean_table(spark, sf_dir)
    f = QU.value_counts(c, "forum").select(F.lit("forum").alias("dim"), F.col("forum").alias("key"), "n")
    lg = QU.value_counts(c, "lang").select(F.lit("lang").alias("dim"), F.col("lang").alias("key"), "n")
    m = CH.monthly_counts(c).select(F.lit("month").alias("dim"), F.col("month_label").alias("key"), "n")
    return f.unionByName(lg).unionByName(m)


@register("timeline", sql=lambda: _clean("""
SELECT make_date(year, month, 1) AS period, lpad(CAST(month AS VARCHAR), 2, '0') AS month_label,
  count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'fr') AS fr,
  count(*) FILTER (WHERE lang = 'other') AS other, count(*) FILTER (WHERE lang = 'unknown') AS unknown
FROM clean WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY 1, 2"""))
def timeline_query(spark, sf_dir):
    """CHT-12, SRT-3, DAT-3, FLT-5: posts per calendar month, every language."""
    counts = QU.lang_pivot_counts(clean_table(spark, sf_dir), D.month_start("year", "month"), "period")
    return (counts.withColumn("month_label", D.period_label(F.month("period")))
            .select("period", "month_label", "en", "fr", "other", "unknown").orderBy("period"))


@register("top_distress", sql=lambda: _enriched("""
SELECT post_id, forum, lang, distress_score, distress_level, sentiment_label, emotion_dominant, substr(text_clean, 1, 80) || '...' AS excerpt
FROM enriched ORDER BY distress_score DESC NULLS LAST, post_id LIMIT 10"""))
def top_distress_query(spark, sf_dir):
    """SRT-4, STR-13, CHT-9: the ten most distressed posts with excerpts."""
    return CH.top_distress(enriched_table(spark, sf_dir, also=("text_clean",)))


@register("sentiment_label_counts", sql=lambda: _enriched("""
SELECT sentiment_label, lang, count(*) AS n FROM enriched WHERE sentiment_label IS NOT NULL GROUP BY 1, 2"""))
def sentiment_label_counts_query(spark, sf_dir):
    """CHT-2: posts per sentiment label and language (the shares of the pie)."""
    e = sentiment_table(spark, sf_dir)
    return (e.groupBy("sentiment_label", "lang").agg(F.count(F.lit(1)).alias("n"), F.count("sentiment_label").alias("_nn"))
             .where(F.col("_nn") > 0).drop("_nn"))


@register("distress_by_month_lang", sql=lambda: _enriched(f"""
SELECT month, {_gmean_if("lang = 'en'", 'distress_score')} AS en, {_gmean_if("lang = 'fr'", 'distress_score')} AS fr,
  {_gmean_if("lang = 'other'", 'distress_score')} AS other, {_gmean_if("lang = 'unknown'", 'distress_score')} AS unknown,
  {S.grid_mean('distress_score')} AS mean
FROM enriched WHERE month IS NOT NULL GROUP BY month"""))
def distress_by_month_query(spark, sf_dir):
    """CHT-4, AGG-8: monthly mean distress, over all and one column per language."""
    e = enriched_table(spark, sf_dir)
    from textpulse.functions.numeric import grid_mean
    means = [grid_mean(F.when(F.col("lang") == lg, F.col("distress_score"))).alias(lg) for lg in ("en", "fr", "other", "unknown")]
    return e.filter(F.col("month").isNotNull()).groupBy("month").agg(*means, grid_mean("distress_score").alias("mean"))


@register("run_counters", sql=lambda: _enriched(f"""
SELECT 'duplicates_removed' AS counter,
  CAST((SELECT count(*) FROM posts_raw) - (SELECT count(*) FROM dedup) AS DOUBLE) AS value
UNION ALL SELECT 'conflicts', CAST(count(*) FILTER (WHERE lang_conflict) AS DOUBLE) FROM enriched
UNION ALL SELECT 'too_short', CAST(count(*) FILTER (WHERE is_too_short) AS DOUBLE) FROM enriched
UNION ALL SELECT 'empty_after_fallback', CAST(count(*) FILTER (WHERE text_clean = '') AS DOUBLE) FROM enriched
UNION ALL SELECT 'zero_token_posts', CAST(count(*) FILTER (WHERE n_tokens = 0) AS DOUBLE) FROM enriched
UNION ALL SELECT 'mean_tokens', {S.rnd('CAST(sum(n_tokens) AS DOUBLE) / count(n_tokens)')} FROM enriched
UNION ALL SELECT 'mean_score', {S.grid_mean('score_cont')} FROM enriched
UNION ALL SELECT 'mean_distress', {S.grid_mean('distress_score')} FROM enriched"""))
def run_counters_query(spark, sf_dir):
    """AGG-16: stage run counters (duplicates removed, conflicts, short,
    empty, zero-token posts, mean tokens / score / distress)."""
    return QU.run_counters(FX.posts_raw(spark, sf_dir), enriched_table(spark, sf_dir, also=("text_clean",)))


@register("observed_counters", sql=lambda: _clean("""
SELECT 'conflicts' AS counter, CAST(count(*) FILTER (WHERE lang_conflict) AS DOUBLE) AS value FROM clean
UNION ALL SELECT 'too_short', CAST(count(*) FILTER (WHERE is_too_short) AS DOUBLE) FROM clean
UNION ALL SELECT 'empty_after_fallback', CAST(count(*) FILTER (WHERE text_clean = '') AS DOUBLE) FROM clean
UNION ALL SELECT 'zero_token_posts', CAST(count(*) FILTER (WHERE n_tokens = 0) AS DOUBLE) FROM clean
UNION ALL SELECT 'mean_tokens', """ + S.rnd('CAST(sum(n_tokens) AS DOUBLE) / count(n_tokens)') + """ FROM clean"""))
def observed_counters_query(spark, sf_dir):
    """AGG-16 without a job of its own: the counters are filled in while the
    clean table is written."""
    own = spark.newSession()  # a session that has observed can't send some ML models to tasks
    seen, counters = QU.observe_counters(clean_table(own, sf_dir))
    materialize(own, seen, "clean-observed")
    return spark.createDataFrame([(k, float(v)) for k, v in counters.get.items()], "counter string, value double")
