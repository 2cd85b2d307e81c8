"""Batch model scoring (UDF-3, SEN-3, SEN-4).

Two ways to obtain per-post ``array<struct<label, score>>`` model outputs:

* ``score_with``: the public extension point for any Python model (for
  example a transformer pipeline). Texts cross to Python in Arrow batches;
  the model is built once per Python worker by ``factory`` and applied to
  inner batches of ``batch_size`` texts. A batch that raises yields null
  arrays for its rows (the fold then emits nulls), like the analysed
  pipeline, and is flagged, so ``failures`` can count it.
* ``sentiment_classifier``: a Spark ML text classifier (tokens -> hashed TF
  -> IDF -> logistic regression) trained on a labelled table; all JVM, no
  Python in the scoring path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpulse.functions.text import raw_tokens
from textpulse.operators.sentiment import fold_sentiment, placeholder_text
from textpulse.sources.sinks import fresh_dir, materialize

SCORES_TYPE = T.ArrayType(T.StructType([T.StructField("label", T.StringType()),
                                        T.StructField("score", T.DoubleType())]))

_MODELS: dict[str, object] = {}


def _model(name: str, factory: Callable[[], Callable[[list[str]], list]]):
    """The model of that name in this Python worker, built on first use. Held
    in the module, so the worker's later tasks find it."""
    if name not in _MODELS:
        _MODELS[name] = factory()
    return _MODELS[name]


def score_with(df: DataFrame, text_col: str, factory: Callable[[], Callable[[list[str]], list]], name: str,
               out_col: str = "raw_scores", batch_size: int = 8) -> DataFrame:
    """Append ``out_col`` = model(text) and ``{out_col}_failed`` (the row was in
    a batch that raised; its scores are null) for every row (UDF-3).

    ``factory()`` returns ``predict(texts) -> list[list[{label, score}]]``;
    ``name`` tells models apart: one name, one model per Python worker. Blank
    texts are sent as ``"."`` (PRJ-11). Only the text crosses to Python.
    ``failures`` counts the failed rows.
    """
    kind = T.StructType([T.StructField("scores", SCORES_TYPE), T.StructField("failed", T.BooleanType())])

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _model(name, factory)
        for t in texts:
            rows = t.tolist()
            scores: list = []
            failed: list[bool] = []
            for i in range(0, len(rows), batch_size):
                chunk = rows[i:i + batch_size]
                try:
                    scores += [[{"label": str(d["label"]), "score": float(d["score"])} for d in r] for r in model(chunk)]
                    failed += [False] * len(chunk)
                except Exception:  # the fold makes nulls of the batch; the flag counts it
                    scores += [None] * len(chunk)
                    failed += [True] * len(chunk)
            yield pd.DataFrame({"scores": scores, "failed": failed})

    scored = F.pandas_udf(run, kind)(placeholder_text(text_col))
    return (df.withColumn("__scored", scored)
              .withColumns({out_col: F.col("__scored.scores"), f"{out_col}_failed": F.col("__scored.failed")}).drop("__scored"))


def failures(scored: DataFrame, out_col: str = "raw_scores") -> DataFrame:
    """One row: rows scored and rows whose batch failed. A job whose model
    always fails is green only if nobody looks here."""
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.count_if(f"{out_col}_failed").alias("failed"))


def attach(df: DataFrame, scores: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with the ``raw_scores`` of (key, raw_scores) as column ``name``;
    every row stays, a null key's too (SEN-4)."""
    other = scores.select(F.col(key).alias("_key"), F.col("raw_scores").alias(name))
    return df.join(other, df[key].eqNullSafe(other["_key"]), "left").drop("_key")


def _stored(model: PipelineModel, spark: SparkSession) -> PipelineModel:
    """The model, saved and loaded: without its training summary, which holds
    the session and can't be sent to tasks once the session has observed
    metrics."""
    path = fresh_dir(spark, "model")
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def text_classifier(df: DataFrame, labelled: DataFrame, key: str, label_col: str, tokens_col: str = "tokens",
                    num_features: int = 1 << 16, max_iter: int = 20) -> tuple[DataFrame, list[str]]:
    """Spark ML: hashed term counts -> IDF -> logistic regression on text
    labels. Returns (key, raw_scores array<struct<label, score>>) for every
    row, and the labels met in training, in order. All JVM."""
    tok = df.select(key, tokens_col)
    names = [r[0] for r in labelled.select(label_col).distinct().orderBy(label_col).collect() if r[0] is not None]
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(label_col)).cast("double") - 1
    train = tok.join(labelled.filter(F.col(label_col).isNotNull()).select(key, number.alias("label")), key)
    model = Pipeline(stages=[HashingTF(inputCol=tokens_col, outputCol="_tf", numFeatures=num_features),
                             IDF(inputCol="_tf", outputCol="_features", minDocFreq=2),
                             LogisticRegression(featuresCol="_features", labelCol="label", maxIter=max_iter,
                                                regParam=0.01, probabilityCol="_prob")]).fit(train)
    model = _stored(model, df.sparkSession)
    p = vector_to_array("_prob")
    raw = F.array(*[F.struct(F.lit(n).alias("label"), p[i].alias("score")) for i, n in enumerate(names)])
    return materialize(df.sparkSession, model.transform(tok).select(key, raw.alias("raw_scores")), "raw-scores"), names


def sentiment_classifier(docs: DataFrame, labelled: DataFrame, text_col: str = "text",
                         key: str = "doc_id", label_col: str = "quality",
                         num_features: int = 1 << 18, max_iter: int = 30) -> DataFrame:
    """SEN-4 with a Spark ML scorer: train on ``labelled`` (key, 0/1 label),
    score every row of ``docs``; class 0 -> negative, 1 -> positive, then
    the usual fold. Training reads only the labelled rows (semi-join)."""
    tok = docs.select(key, raw_tokens(text_col).alias("_tokens"))
    train = (tok.join(labelled.select(key, F.col(label_col).cast("double").alias("label")), key)
             .filter(F.col("label").isNotNull()))
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="_features", minDocFreq=2)
    lr = LogisticRegression(featuresCol="_features", labelCol="label", maxIter=max_iter,
                            regParam=0.01, probabilityCol="_prob")
    model = _stored(Pipeline(stages=[tf, idf, lr]).fit(train), docs.sparkSession)
    scored = model.transform(tok).withColumn("_p", vector_to_array("_prob"))
    raw = F.array(F.struct(F.lit("negative").alias("label"), F.col("_p")[0].alias("score")),
                  F.struct(F.lit("positive").alias("label"), F.col("_p")[1].alias("score")))
    out = scored.select(key, raw.alias("sentiment_raw"), F.lit("en").alias("model_key"))
    return fold_sentiment(out)
