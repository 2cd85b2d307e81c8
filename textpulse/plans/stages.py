"""Stage tables over the driver data: clean posts and enriched posts.

A query takes the narrowest stage that gives its columns: what needs no token
(sentiment, model emotions) stays lazy, so that the text chain is pruned; what
needs the lexicon reads one written table of the columns it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textpulse.operators.cleaning import clean_posts
from textpulse.operators.emotions import extract_emotions
from textpulse.operators.sentiment import fold_sentiment, model_key
from textpulse.plans import fixtures as FX
from textpulse.sources.sinks import materialize

#: What the summaries and charts read of a clean post: no text.
NARROW = ("post_id", "forum", "lang", "lang_conflict", "posted_at", "year", "month",
          "n_tokens", "is_empty", "is_too_short")


def clean_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLN-1 over the posts view."""
    return clean_posts(FX.posts_raw(spark, sf_dir))


def clean_written(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = (*NARROW, "tokens")) -> DataFrame:
    """The named columns of the clean table, written once to the shared
    folder: for queries that read them more than once."""
    return materialize(spark, clean_table(spark, sf_dir).select(*columns), "clean")


def with_model_scores(df: DataFrame) -> DataFrame:
    """Posts plus the (stand-in) model outputs as array<struct> columns."""
    return (df.withColumn("model_key", model_key("lang"))
              .withColumn("sentiment_raw", FX.sentiment_raw())
              .withColumn("emotion_raw", FX.emotion_raw()))


def scored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean posts with model outputs; lazy."""
    return with_model_scores(clean_table(spark, sf_dir))


def sentiment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean posts with folded sentiment (SEN-4) and nothing of the lexicon;
    lazy, so a query that reads no text column runs no text step."""
    return fold_sentiment(scored_table(spark, sf_dir))


def enriched_table(spark: SparkSession, sf_dir: str, with_model: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """Clean + sentiment (SEN-4) + emotions and distress (EMO-5), with the
    columns of ``NARROW``, the tokens and those that ``also`` names."""
    df = clean_written(spark, sf_dir, (*NARROW, "tokens", *also))
    return extract_emotions(fold_sentiment(with_model_scores(df)), FX.lexicon_df(spark),
                            model_raw_col="emotion_raw" if with_model else None)
