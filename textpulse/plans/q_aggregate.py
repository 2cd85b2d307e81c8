"""Registered queries: temporal aggregates (AGG-1..5, 17, 18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpulse import constants as K
from textpulse.operators import aggregate as A
from textpulse.operators import rollup as R
from textpulse.plans import sqlgen as S
from textpulse.plans.registry import register
from textpulse.plans.stages import enriched_table
from textpulse.sources.sinks import materialize


def _with(cte: str, select: str) -> str:
    return f"WITH {cte}\n{select}"


def _mode_sql(src: str, keys: list[str], col: str, alias: str) -> str:
    k = ", ".join(keys)
    return f"""{alias} AS (
  SELECT {k}, first(v ORDER BY n DESC, v ASC) AS {alias}
  FROM (SELECT {k}, {col} AS v, count(*) AS n FROM {src} WHERE {col} IS NOT NULL GROUP BY {k}, {col})
  GROUP BY {k})"""


def measures_sql(src: str, keys: list[str], extra_select: str = "", order: str = "",
                 topics: bool = False) -> str:
    """SQL twin of ``aggregate.summarize`` over the enriched CTE."""
    k = ", ".join(keys)
    notnull = " AND ".join(f"{x} IS NOT NULL" for x in keys)
    m = ["CAST(count(*) AS BIGINT) AS nb_posts",
         "CAST(count(*) FILTER (WHERE lang = 'en') AS BIGINT) AS nb_posts_en",
         "CAST(count(*) FILTER (WHERE lang = 'fr') AS BIGINT) AS nb_posts_fr"]
    for c in A.SENTIMENT_SCORES:
        m.append(f"{S.grid_mean(c)} AS mean_{c}")
        m.append(f"{S.grid_std(c)} AS std_{c}")
    for lab in ("positive", "neutral", "negative"):
        m.append(f"{S.pct(f'count(*) FILTER (WHERE sentiment_label = {S.q(lab)})', 'count(*)')} AS pct_{lab}")
    for e in K.EMOTIONS:
        m.append(f"{S.grid_mean(f'emotion_{e}')} AS mean_{e}")
    m += [f"{S.grid_mean('distress_score')} AS mean_distress",
          f"{S.grid_std('distress_score')} AS std_distress",
          f"{S.rnd('max(distress_score)')} AS max_distress",
          f"{S.pct(f'count(*) FILTER (WHERE distress_score >= {K.HIGH_DISTRESS_THRESHOLD})', 'count(*)')}"
          " AS pct_high_distress",
          f"{S.rnd('CAST(sum(n_tokens) AS DOUBLE) / count(n_tokens)')} AS mean_nb_tokens"]
    modes = [_mode_sql("base", keys, "emotion_dominant", "dominant_emotion"),
             _mode_sql("base", keys, "distress_level", "dominant_distress_level")]
    mode_names = ["dominant_emotion", "dominant_distress_level"]
    if topics:
        m.append("CAST(count(DISTINCT topic_label) AS BIGINT) AS nb_unique_topics")
        modes.append(_mode_sql("base", keys, "topic_label", "dominant_topic"))
        mode_names.append("dominant_topic")
    join = " ".join(f"LEFT JOIN {a} USING ({k})" for a in mode_names)
    return f""",
base AS (SELECT * FROM {src} WHERE {notnull}),
agg AS (SELECT {k}, {', '.join(m)} FROM base GROUP BY {k}),
{', '.join(modes)}
SELECT *{extra_select} FROM agg {join}{order}"""


def _agg_sql(src_select: str, keys: list[str], extra_select: str = "") -> str:
    return ("WITH " + S.enriched_cte() + f", src AS ({src_select})"
            + measures_sql("src", keys, extra_select=extra_select))


@register("agg_month", sql=lambda: _agg_sql(
    "SELECT * FROM enriched", ["month", "lang", "forum"],
    extra_select=", lpad(CAST(month AS VARCHAR), 2, '0') AS period"))
def agg_month(spark, sf_dir):
    """AGG-2 (+ AGG-1, 17, 18, FLT-6, STR-16, SRT-1): month x lang x forum."""
    return A.by_month(enriched_table(spark, sf_dir))


@register("agg_season", sql=lambda: _agg_sql(
    f"SELECT *, {S.season('month')} AS season FROM enriched", ["season", "lang", "forum"]))
def agg_season(spark, sf_dir):
    """AGG-3 (+ DAT-6, SRT-2): academic season x lang x forum."""
    return A.by_season(enriched_table(spark, sf_dir))


@register("agg_weekday", sql=lambda: _agg_sql(
    "SELECT *, dayname(posted_at) AS weekday_name, "
    "CAST((dayofweek(posted_at) + 6) % 7 AS INTEGER) AS weekday FROM enriched",
    ["weekday_name", "weekday", "lang"]))
def agg_weekday(spark, sf_dir):
    """AGG-4 (+ DAT-4, DAT-5): weekday name, weekday number x lang."""
    return A.by_weekday(enriched_table(spark, sf_dir))


@register("agg_global", sql=lambda: _agg_sql("SELECT * FROM enriched", ["lang", "forum"]))
def agg_global(spark, sf_dir):
    """AGG-5: lang x forum."""
    return A.by_lang_forum(enriched_table(spark, sf_dir))


def _all_sql() -> str:
    """The four summaries as one long table."""
    src = (f"SELECT *, {S.season('month')} AS season, dayname(posted_at) AS weekday_name, "
           "CAST((dayofweek(posted_at) + 6) % 7 AS INTEGER) AS weekday FROM enriched")
    parts = []
    for name, keys in A.SUMMARIES.items():
        body = measures_sql("src", keys).lstrip(", \n")
        parts.append(f"t_{name} AS (WITH {body})")
    rows = " UNION ALL BY NAME ".join(f"SELECT '{name}' AS summary, * FROM t_{name}" for name in A.SUMMARIES)
    return "WITH " + S.enriched_cte() + f", src AS ({src}), " + ", ".join(parts) + f" {rows}"


@register("agg_all", sql=_all_sql)
def agg_all(spark, sf_dir):
    """SNK-3, AGG-2..5 in one pass by grouping sets: the four summaries as one
    long table."""
    return A.summaries_in_one(enriched_table(spark, sf_dir))


@register("agg_rollup", sql=_all_sql)
def agg_rollup(spark, sf_dir):
    """AGG-1..5, AGG-18 by roll-up: daily state and label counts, written once
    for either half of the posts, merged, and rolled up to the four summaries."""
    e = materialize(spark, enriched_table(spark, sf_dir).drop("tokens"), "enriched")
    half = F.col("post_id") % 2 == 0
    states = [materialize(spark, R.daily_state(e.where(h)), "state") for h in (half, ~F.coalesce(half, F.lit(False)))]
    values = [materialize(spark, R.daily_values(e.where(h)), "values") for h in (half, ~F.coalesce(half, F.lit(False)))]
    state, value = R.merge_states(*states), R.merge_values(*values)
    out = None
    for name in A.SUMMARIES:
        one = R.roll_up(state, value, name).drop("dominant_topic", "nb_unique_topics").withColumn("summary", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def _agg_topics_sql() -> str:
    from textpulse.plans.q_topics import CTFIDF_CTE
    cte = CTFIDF_CTE.replace("FROM clean WHERE", "FROM enriched WHERE") \
                    .replace("forum AS topic", "CAST(month AS VARCHAR) AS topic")
    lab = """,
lab AS (SELECT ids.topic, topic_id,
  CASE WHEN topic_id = -1 THEN 'outlier'
       WHEN coalesce(len(words[1:3]), 0) > 0 THEN 'T' || CAST(topic_id AS VARCHAR) || ': ' || array_to_string(words[1:3], ' | ')
       ELSE 'T' || CAST(topic_id AS VARCHAR) END AS topic_label
  FROM ids LEFT JOIN words ON words.topic = ids.topic),
src AS (SELECT ti.*, lab.topic_label FROM ti LEFT JOIN lab ON lab.topic = CAST(ti.month AS VARCHAR))"""
    return "WITH " + S.enriched_cte() + cte + lab + measures_sql("src", ["lang", "forum"], topics=True)


@register("agg_topics", sql=_agg_topics_sql)
def agg_topics(spark, sf_dir):
    """AGG-1 with the topic measures (AGG-17 distinct topics, AGG-18 mode of
    the topic label) over the topic-model input, topics = class-based TF-IDF
    labels with the posting month as class; grouped by lang x forum."""
    from textpulse.operators import topics as TP
    ti = materialize(spark, TP.topic_input(enriched_table(spark, sf_dir)).withColumn(
        "_month_class", F.col("month").cast("string")), "topic-input")
    topics = TP.topic_table(ti, "_month_class", vocabulary=TP.ngram_doc_freq(ti))
    labelled = TP.assign_labels(ti, topics, "_month_class")
    return A.by_lang_forum(labelled.drop("topic_id"))
