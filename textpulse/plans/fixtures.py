"""Forum-post view over the driver's ``documents`` table.

The driver tables hold generic documents; the library works on forum posts.
This module derives a posts table from ``documents`` with integer arithmetic
only, so the exact same rows can be produced in SQL for the oracle (see
``textpulse.plans.oracle``). It injects the artefacts the cleaning operators
exist for (URLs, mentions, contractions, emoji, duplicates, bad dates) and
stands in for the batch-model outputs with deterministic score vectors.
The view grows row-for-row with ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse import constants as K
from textpulse.functions import text as TX
from textpulse.sources.readers import spread

# FIXED VALUES of the posts view (shared with the SQL twin).
FORUMS = ["etudiants", "college", "CollegeRant", "csMajors", "Student", "Students", "Misc"]
NULL_TEXT_MOD = 17
NULL_TITLE_MOD = 11
BAD_DATE_MOD = 29
DUP_MOD = 13
FAILED_BATCH_MOD = 23
DATE_SPAN_DAYS = 730
# Emotion model label list (the 28 labels of the public emotion data set).
EMOTION_MODEL_LABELS = [
    "admiration", "amusement", "anger", "annoyance", "approval", "caring",
    "confusion", "curiosity", "desire", "disappointment", "disapproval",
    "disgust", "embarrassment", "excitement", "fear", "gratitude", "grief",
    "joy", "love", "nervousness", "optimism", "pride", "realization",
    "relief", "remorse", "sadness", "surprise", "neutral",
]
# Inline emotion lexicon: (word, emotion, association). The last two rows
# are filtered out (not one of the eight emotions / association 0).
LEXICON_ROWS = [
    ("th", "fear", 1), ("er", "sadness", 1), ("nd", "anger", 1), ("ha", "joy", 1),
    ("rewh", "trust", 1), ("orre", "surprise", 1), ("ing", "anticipation", 1),
    ("ononst", "disgust", 1), ("thatin", "fear", 1), ("thatin", "sadness", 1),
    ("th", "positive", 1), ("er", "joy", 0),
]
# Inline lemma dictionary: (lang, form, lemma).
LEMMA_ROWS = [
    ("en", "the", "the"), ("en", "ing", "in"), ("en", "ed", "e"),
    ("en", "th", "the"), ("fr", "eaux", "eau"), ("fr", "ment", "mente"),
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def posts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw forum export view: one row per document plus injected duplicates."""
    d = spread(read_table(spark, sf_dir, "documents"))
    pid = F.col("doc_id")
    src_no = F.expr("try_cast(substr(source, 4) AS BIGINT)")
    forum = None
    for i, name in enumerate(FORUMS):
        cond = (src_no % len(FORUMS)) == i
        forum = F.when(cond, name) if forum is None else forum.when(cond, name)
    suffix = (F.when(pid % 5 == 0, F.concat(F.lit(" see https://ex.org/p"), pid.cast("string")))
              .when(pid % 5 == 1, F.concat(F.lit(" thanks u/user_"), pid.cast("string")))
              .when(pid % 5 == 2, F.lit(" from r/college"))
              .when(pid % 5 == 3, F.lit(" I can't and won't"))
              .otherwise(F.lit(" \U0001F600")))
    ts = F.expr(f"TIMESTAMP_NTZ '2023-01-01 00:00:00' + "
                f"make_dt_interval(CAST((doc_id * 37) % {DATE_SPAN_DAYS} AS INT), "
                f"CAST((doc_id * 7) % 24 AS INT), 0, 0)")
    detected = (F.when(~TX.has_min_words("text", K.MIN_TOKENS), "unknown")
                .when(F.col("lang").isin("en", "fr"), F.col("lang"))
                .otherwise("other"))
    base = d.select(
        pid.alias("post_id"),
        forum.alias("forum"),
        F.when(pid % NULL_TITLE_MOD == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Title "), pid.cast("string"))).alias("title"),
        F.when(pid % NULL_TEXT_MOD == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.col("text"), suffix)).alias("text"),
        F.concat(F.lit("  "), F.col("lang"), F.lit(" ")).alias("category"),
        F.when(pid % BAD_DATE_MOD == 0, F.lit("not a date"))
         .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).alias("posted_raw"),
        detected.alias("lang_detected"),
        pid.alias("row_pos"),
    )
    # Duplicates: same post again from a later export (file_rank 1).
    ranks = F.when(F.col("post_id") % DUP_MOD == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = base.withColumn("file_rank", F.explode(ranks))
    out = out.withColumn("title", F.when(F.col("file_rank") == 1, F.lit("dup")).otherwise(F.col("title")))
    return out.select("post_id", "forum", "title", "text", "category", "posted_raw",
                      "lang_detected", "file_rank", "row_pos")


def _weights_struct_array(labels: list[str], mult: int, add: int, mod: int, pid: Column) -> Column:
    """[{label_i, w_i / sum(w)}] with w_i = (pid * (mult*i + add)) % mod + 1, i = 1..n."""
    n = len(labels)
    labs = F.array(*[F.lit(x) for x in labels])
    idx = F.sequence(F.lit(1), F.lit(n))

    def weight(i):
        return (pid * (i * mult + add)) % mod + 1

    total = F.aggregate(idx, F.lit(0).cast("long"), lambda acc, i: acc + weight(i))
    return F.transform(idx, lambda i: F.struct(
        F.element_at(labs, i).alias("label"),
        (weight(i) / total).cast("double").alias("score")))


def sentiment_raw(pid_col="post_id", key_col="model_key") -> Column:
    """Stand-in sentiment model output: star labels for the French model,
    three classes for the English one; null = failed batch."""
    pid = F.col(pid_col)
    star = _weights_struct_array(list(K.STAR_LABELS), 31, 7, 97, pid)
    three = _weights_struct_array(list(K.THREE_CLASS_LABELS), 31, 7, 97, pid)
    return (F.when(pid % FAILED_BATCH_MOD == 0, F.lit(None))
            .when(F.col(key_col) == "fr", star).otherwise(three))


def emotion_raw(pid_col="post_id") -> Column:
    """Stand-in emotion model output over the 28-label set; null = failed batch."""
    pid = F.col(pid_col)
    arr = _weights_struct_array(EMOTION_MODEL_LABELS, 17, 3, 89, pid)
    return F.when(pid % FAILED_BATCH_MOD == 0, F.lit(None)).otherwise(arr)


def lexicon_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON_ROWS, "word string, emotion string, association int")


def lemma_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEMMA_ROWS, "lang string, form string, lemma string")
