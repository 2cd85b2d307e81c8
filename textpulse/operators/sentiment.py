"""Sentiment stage (SEN-1..4, ARR-3, MAP-1, MTH-4).

A batch model returns, per post, an array of ``{label, score}``. Folding
that array into negative / neutral / positive sums is pure column work with
higher-order functions - no shuffle, no Python. Producing the array is the
job of a scorer (``textpulse.operators.scoring``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse import constants as K
from textpulse.functions.numeric import argmax_name, rnd
from textpulse.functions.text import bind, bind_many, is_blank

SENTIMENT_OUTPUT = ["sentiment_label", "score_pos", "score_neu", "score_neg", "score_cont"]


def _unified_class(label: Column, key: Column) -> Column:
    """SEN-1 / MAP-1: model label -> class for the model named by ``key``;
    labels are lower-cased, unknown labels count as neutral."""
    lab = F.lower(label)
    expr = None
    for model, mapping in K.SENTIMENT_LABEL_MAPS.items():
        inner = None
        for raw, cls in mapping.items():
            inner = F.when(lab == raw, cls) if inner is None else inner.when(lab == raw, cls)
        branch = inner.otherwise("neutral")
        expr = F.when(key == model, branch) if expr is None else expr.when(key == model, branch)
    return expr.otherwise("neutral")


def class_sum(mapped: Column, cls: str) -> Column:
    """ARR-3: sum of the scores whose label folds into ``cls`` (in array order)."""
    return F.aggregate(mapped, F.lit(0.0),
                       lambda acc, x: acc + F.when(x["c"] == cls, x["s"]).otherwise(F.lit(0.0)))


def fold_sentiment(df: DataFrame, raw_col: str = "sentiment_raw",
                   key_col: str = "model_key") -> DataFrame:
    """SEN-1, SEN-2, MTH-4: label, 3 class scores and the continuous score.

    Ties go positive > neutral > negative. A null array (failed batch) gives
    five nulls. The continuous score is taken before rounding."""
    raw = F.col(raw_col)
    key = F.col(key_col)
    mapped = F.transform(raw, lambda x: F.struct(
        _unified_class(x["label"], key).alias("c"), x["score"].alias("s")))

    def fold(m):
        sums = {c: class_sum(m, c) for c in K.SENTIMENT_CLASSES}
        return bind_many(sums, lambda d: F.when(raw.isNotNull(), F.struct(
            argmax_name(d, null_if_zero=False).alias("sentiment_label"),
            rnd(d["positive"]).alias("score_pos"),
            rnd(d["neutral"]).alias("score_neu"),
            rnd(d["negative"]).alias("score_neg"),
            rnd(d["positive"] - d["negative"]).alias("score_cont"))))

    tmp = df.withColumn("_sent", bind(mapped, fold))
    return tmp.withColumns({c: F.col("_sent")[c] for c in SENTIMENT_OUTPUT}).drop("_sent")


def model_key(lang_col="lang") -> Column:
    """FLT-3: French posts go to the French model, all others (a null language
    too) to the English one."""
    c = F.col(lang_col) if isinstance(lang_col, str) else lang_col
    return F.when(c.eqNullSafe("fr"), F.lit("fr")).otherwise(F.lit("en"))


def placeholder_text(col) -> Column:
    """PRJ-11: blank text is sent to a model as ``"."``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(is_blank(c), F.lit(".")).otherwise(c)
