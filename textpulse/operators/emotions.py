"""Emotion stage (EMO-1..5, JOI-2, MTH-1..5, WIN-2, WIN-3, SRC-5 filtering).

Lexicon scoring runs in the JVM, never as a per-token dictionary probe in
Python: explode -> join -> count, the same for a lexicon of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse import constants as K
from textpulse.functions.numeric import argmax_name, distress_level, distress_score, rnd
from textpulse.functions.text import bind, bind_many
from textpulse.sources.sinks import materialize


def prepare_lexicon(lexicon: DataFrame) -> DataFrame:
    """FLT-8, STR-10, SET-3: keep association 1 and the eight emotions,
    lower-case words, distinct (word, emotion) pairs."""
    lex = lexicon
    if "association" in lex.columns:
        lex = lex.filter(F.col("association") == 1)
    cols = [F.lower(F.col("word")).alias("word"), F.col("emotion")]
    if "lang" in lex.columns:
        cols.append(F.col("lang"))
    return lex.filter(F.col("emotion").isin(K.EMOTIONS)).select(*cols).distinct()


def lexicon_hits(df: DataFrame, lex: DataFrame, key: str, tokens_col: str) -> DataFrame:
    """Per key with a hit, the lexicon hits of each emotion. No size decides
    how: tokens are exploded and joined with the lexicon, and the counts of a
    post combine in its task before they are shuffled. The lexicon is written
    first, so that the planner knows its size before it plans the join: by
    runtime sizes alone it would learn of a small one when all tokens have been
    shuffled."""
    on = ["word", "lang"] if "lang" in lex.columns else ["word"]
    words = lex.groupBy(*on).agg(*[F.count_if(F.col("emotion") == e).alias(f"_e_{e}") for e in K.EMOTIONS])
    words = materialize(df.sparkSession, words, "lexicon")
    cols = [F.col(key).alias("_hit_key"), *([F.col("lang")] if "lang" in on else []), F.explode(F.col(tokens_col)).alias("word")]
    return (df.select(*cols).join(words, on).groupBy("_hit_key")
              .agg(*[F.sum(f"_e_{e}").alias(f"_h_{e}") for e in K.EMOTIONS]))


def lexicon_scores(df: DataFrame, lexicon: DataFrame, key: str = "post_id",
                   tokens_col: str = "tokens", prefix: str = "lex_") -> DataFrame:
    """EMO-1 / EMO-2 / JOI-2: per emotion, lexicon hits / token count (rounded
    to 4); all zeros and a null dominant when nothing matches or there are no
    tokens. A word may carry several emotions (one-to-many). When the lexicon
    has a ``lang`` column the lookup is on (lang, word).

    ``key`` names a row (a null key is one row, like in the clean stage); the
    counts join back null-safe. ``df`` is read twice: pass a written table.
    """
    hits = lexicon_hits(df, prepare_lexicon(lexicon), key, tokens_col)
    joined = df.join(hits, df[key].eqNullSafe(hits["_hit_key"]), "left").drop("_hit_key")
    inputs = {e: F.coalesce(F.col(f"_h_{e}"), F.lit(0)) for e in K.EMOTIONS}
    inputs["_n"] = F.size(F.col(tokens_col))

    def score(d):
        any_hit = sum((d[e] for e in K.EMOTIONS), F.lit(0)) > 0
        vals = {e: F.when(any_hit & (d["_n"] > 0), rnd(d[e] / d["_n"])).otherwise(F.lit(0.0))
                for e in K.EMOTIONS}
        return bind_many(vals, lambda v: F.struct(
            *[v[e].alias(e) for e in K.EMOTIONS],
            argmax_name({e: v[e] for e in K.EMOTIONS}).alias("dominant")))

    out = joined.withColumn("_lx", bind_many(inputs, score))
    cols = {f"{prefix}{e}": F.col("_lx")[e] for e in K.EMOTIONS}
    cols[f"{prefix}dominant"] = F.col("_lx")["dominant"]
    return out.withColumns(cols).drop("_lx", *[f"_h_{e}" for e in K.EMOTIONS])


def _emotion_of(label: Column) -> Column:
    expr = None
    for lab, emo in K.MODEL_LABEL_TO_EMOTION.items():
        expr = F.when(label == lab, emo) if expr is None else expr.when(label == lab, emo)
    return expr


def model_emotion_scores(df: DataFrame, raw_col: str = "emotion_raw",
                         prefix: str = "model_") -> DataFrame:
    """EMO-3 / MTH-5: fold model labels into the eight emotions, normalise by
    the total of mapped scores (neutral / unknown labels excluded), round 4.
    Total 0 or a failed batch (null array) -> zeros and a null dominant."""
    raw = F.col(raw_col)
    mapped = F.transform(raw, lambda x: F.struct(_emotion_of(x["label"]).alias("e"),
                                                 x["score"].alias("s")))

    def emotion_sum(m, e):
        return F.coalesce(F.aggregate(m, F.lit(0.0),
                                      lambda acc, x: acc + F.when(x["e"] == e, x["s"])
                                      .otherwise(F.lit(0.0))), F.lit(0.0))

    def normalise(d):
        total = None
        for e in K.EMOTIONS:
            total = d[e] if total is None else total + d[e]
        vals = {e: F.when(total > 0, rnd(d[e] / total)).otherwise(F.lit(0.0)) for e in K.EMOTIONS}
        return bind_many(vals, lambda v: F.struct(
            *[v[e].alias(e) for e in K.EMOTIONS],
            argmax_name({e: v[e] for e in K.EMOTIONS}).alias("dominant")))

    folded = bind(mapped, lambda m: bind_many({e: emotion_sum(m, e) for e in K.EMOTIONS}, normalise))
    out = df.withColumn("_md", folded)
    cols = {f"{prefix}{e}": F.col("_md")[e] for e in K.EMOTIONS}
    cols[f"{prefix}dominant"] = F.col("_md")["dominant"]
    return out.withColumns(cols).drop("_md")


def combine_emotions(df: DataFrame, has_model: bool = True) -> DataFrame:
    """EMO-4 / MTH-1..3: blend, dominant emotion, distress score and level."""
    inputs = {f"lex_{e}": F.coalesce(F.col(f"lex_{e}"), F.lit(0.0)) for e in K.EMOTIONS}
    if has_model:
        inputs.update({f"model_{e}": F.coalesce(F.col(f"model_{e}"), F.lit(0.0)) for e in K.EMOTIONS})

    def blend(d):
        vals = {}
        for e in K.EMOTIONS:
            if has_model:
                vals[e] = rnd(K.LEXICON_WEIGHT * d[f"lex_{e}"] + K.MODEL_WEIGHT * d[f"model_{e}"])
            else:
                vals[e] = rnd(d[f"lex_{e}"])

        def finish(v):
            score = distress_score(v["anger"], v["fear"], v["sadness"])
            return F.struct(*[v[e].alias(e) for e in K.EMOTIONS],
                            argmax_name({e: v[e] for e in K.EMOTIONS}).alias("dominant"),
                            score.alias("distress_score"),
                            bind(score, distress_level).alias("distress_level"))
        return bind_many(vals, finish)

    out = df.withColumn("_cb", bind_many(inputs, blend))
    cols = {f"emotion_{e}": F.col("_cb")[e] for e in K.EMOTIONS}
    cols["emotion_dominant"] = F.col("_cb")["dominant"]
    cols["distress_score"] = F.col("_cb")["distress_score"]
    cols["distress_level"] = F.col("_cb")["distress_level"]
    return out.withColumns(cols).drop("_cb")


def extract_emotions(df: DataFrame, lexicon: DataFrame, model_raw_col: str | None = "emotion_raw",
                     key: str = "post_id") -> DataFrame:
    """EMO-5: lexicon scores, optional model scores (``None`` = lexicon only,
    the ``--no_bert`` mode), then the combined columns. Row count is kept."""
    out = lexicon_scores(df, lexicon, key=key)
    has_model = model_raw_col is not None and model_raw_col in out.columns
    if has_model:
        out = model_emotion_scores(out, model_raw_col)
    return combine_emotions(out, has_model=has_model)
