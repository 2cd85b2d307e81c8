"""Registered queries: sentiment and emotion scoring (SEN, EMO, MTH, WIN-2/3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textpulse import constants as K
from textpulse.operators import emotions as EM
from textpulse.functions.numeric import rnd
from textpulse.operators.scoring import attach, score_with, sentiment_classifier, text_classifier
from textpulse.operators.sentiment import fold_sentiment
from textpulse.plans import fixtures as FX
from textpulse.plans import sqlgen as S
from textpulse.plans.registry import register
from textpulse.sources.sinks import materialize
from textpulse.plans.stages import clean_written, enriched_table, scored_table

SENT_OUT = ["post_id", "model_key", "sentiment_label", "score_pos", "score_neu", "score_neg",
            "score_cont"]
LEX_OUT = ["post_id", "n_tokens"] + [f"lex_{e}" for e in K.EMOTIONS] + ["lex_dominant"]
MODEL_OUT = ["post_id"] + [f"model_{e}" for e in K.EMOTIONS] + ["model_dominant"]
COMB_OUT = (["post_id"] + [f"emotion_{e}" for e in K.EMOTIONS]
            + ["emotion_dominant", "distress_score", "distress_level"])
ENRICH_OUT = ["post_id", "lang", "forum", "sentiment_label", "score_cont", "lex_dominant",
              "model_dominant", "emotion_dominant", "distress_score", "distress_level"]


def _with(cte: str, select: str) -> str:
    return f"WITH {cte}\n{select}"


@register("sentiment_fold", sql=lambda: _with(S.enriched_cte(), f"SELECT {', '.join(SENT_OUT)} FROM enriched"))
def sentiment_fold_query(spark, sf_dir):
    """SEN-1, SEN-2, MTH-4, ARR-3, MAP-1: fold model label scores."""
    return fold_sentiment(scored_table(spark, sf_dir)).select(*SENT_OUT)


@register("lexicon_emotions", sql=lambda: _with(S.enriched_cte(), f"SELECT {', '.join(LEX_OUT)} FROM enriched"))
def lexicon_emotions_query(spark, sf_dir):
    """SRC-5 filter, JOI-2, EMO-1, EMO-2, SET-3, FLT-8: lexicon scores."""
    return EM.lexicon_scores(clean_written(spark, sf_dir), FX.lexicon_df(spark)).select(*LEX_OUT)


def _corpus_lexicon_sql() -> str:
    emotion = "CASE length(word) % 8 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(K.EMOTIONS)) + " END"
    hits = ", ".join(f"count(*) FILTER (WHERE emotion = '{e}') AS h_{e}" for e in K.EMOTIONS)
    total = " + ".join(f"coalesce(h_{e}, 0)" for e in K.EMOTIONS)
    score = {e: f"(CASE WHEN n_tokens > 0 AND ({total}) > 0 THEN {S.rnd(f'CAST(coalesce(h_{e}, 0) AS DOUBLE) / n_tokens')} ELSE 0.0 END)" for e in K.EMOTIONS}
    return _with(S.clean_cte() + f""",
words AS (SELECT DISTINCT unnest(tokens) AS word FROM clean),
lexicon AS (SELECT word, {emotion} AS emotion FROM words WHERE length(word) % 2 = 0),
tok AS (SELECT post_id, unnest(tokens) AS word FROM clean),
hits AS (SELECT post_id, {hits} FROM tok JOIN lexicon USING (word) GROUP BY post_id)""",
        f"SELECT c.post_id, {', '.join(f'{score[e]} AS lex_{e}' for e in K.EMOTIONS)} FROM clean c LEFT JOIN hits h ON h.post_id = c.post_id")


@register("lexicon_of_the_corpus", sql=_corpus_lexicon_sql)
def corpus_lexicon_query(spark, sf_dir):
    """JOI-2, EMO-1 with a lexicon that grows with the corpus: every second
    distinct token, its emotion by its length."""
    c = clean_written(spark, sf_dir)
    words = c.select(F.explode("tokens").alias("word")).distinct().filter(F.length("word") % 2 == 0)
    emotion = F.element_at(F.array(*[F.lit(e) for e in K.EMOTIONS]), F.length("word") % 8 + 1)
    lexicon = words.select("word", emotion.alias("emotion"), F.lit(1).alias("association"))
    return EM.lexicon_scores(c, lexicon).select("post_id", *[f"lex_{e}" for e in K.EMOTIONS])


@register("model_emotions_fold", sql=lambda: _with(S.enriched_cte(), f"SELECT {', '.join(MODEL_OUT)} FROM enriched"))
def model_emotions_query(spark, sf_dir):
    """EMO-3, MTH-5: fold emotion-model labels into the eight emotions."""
    return EM.model_emotion_scores(scored_table(spark, sf_dir)).select(*MODEL_OUT)


@register("combined_distress", sql=lambda: _with(S.enriched_cte(), f"SELECT {', '.join(COMB_OUT)} FROM enriched"))
def combined_query(spark, sf_dir):
    """EMO-4, MTH-1..3, WIN-2, WIN-3: blend, dominant, distress."""
    return enriched_table(spark, sf_dir).select(*COMB_OUT)


@register("lexicon_only_distress",
          sql=lambda: _with(S.enriched_cte(with_model=False), f"SELECT {', '.join(COMB_OUT)} FROM enriched"))
def lexicon_only_query(spark, sf_dir):
    """EMO-5 in lexicon-only mode (no model scores)."""
    return enriched_table(spark, sf_dir, with_model=False).select(*COMB_OUT)


@register("enrich_stage", sql=lambda: _with(S.enriched_cte(), f"SELECT {', '.join(ENRICH_OUT)} FROM enriched"))
def enrich_query(spark, sf_dir):
    """EMO-5, SEN-4, JOI-4: clean -> sentiment -> emotions, row count kept."""
    return enriched_table(spark, sf_dir).select(*ENRICH_OUT)


def _count_e():
    """A stand-in model for UDF-3: the share of the letter e."""
    return lambda texts: [[{"label": "positive", "score": t.count("e") / len(t)}, {"label": "negative", "score": 1 - t.count("e") / len(t)}]
                          for t in texts]


@register("score_with_model", sql=lambda: f"""
WITH t AS (SELECT doc_id, CASE WHEN {S.is_blank('text')} THEN '.' ELSE text END AS t FROM documents),
s AS (SELECT doc_id, CAST(length(t) - length(replace(t, 'e', '')) AS DOUBLE) / length(t) AS p FROM t)
SELECT doc_id, {S.rnd('p', 6)} AS positive, {S.rnd('1 - p', 6)} AS negative, false AS failed FROM s""")
def score_with_query(spark, sf_dir):
    """UDF-3, SEN-3, PRJ-11: a Python model over every document in batches."""
    out = score_with(FX.read_table(spark, sf_dir, "documents"), "text", _count_e, name="count-e")
    pick = lambda i: rnd(F.col("raw_scores")[i]["score"], 6)
    return out.select("doc_id", pick(0).alias("positive"), pick(1).alias("negative"), F.col("raw_scores_failed").alias("failed"))


@register("enrich_with_models")
def enrich_with_models_query(spark, sf_dir):
    """SEN-4, EMO-5 with trained scorers: a sentiment classifier learnt from
    the labelled documents and an emotion classifier learnt from the posts
    whose lexicon gives a dominant emotion score every post's own text; then
    fold, blend and distress (rows-only check: trained models)."""
    c = clean_written(spark, sf_dir)
    marks = FX.read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("post_id"), F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative").alias("mark"))
    sentiment, _ = text_classifier(c, marks, "post_id", "mark")
    lex = materialize(spark, EM.lexicon_scores(c, FX.lexicon_df(spark)), "lexicon-scores")
    emotion, _ = text_classifier(c, lex.select("post_id", "lex_dominant"), "post_id", "lex_dominant")
    out = attach(lex.withColumn("model_key", F.lit("en")), sentiment, "post_id", "sentiment_raw")
    out = EM.model_emotion_scores(attach(fold_sentiment(out), emotion, "post_id", "emotion_raw"))
    return EM.combine_emotions(out).select(*ENRICH_OUT)


@register("sentiment_classifier")
def sentiment_classifier_query(spark, sf_dir):
    """SEN-3, SEN-4, UDF-3: a Spark ML text classifier trained on the
    labelled documents scores every document; its probabilities become the
    ``{label, score}`` array that the fold turns into sentiment columns."""
    docs = FX.read_table(spark, sf_dir, "documents")
    labels = FX.read_table(spark, sf_dir, "labels")
    out = sentiment_classifier(docs, labels, text_col="text", key="doc_id", label_col="quality")
    return out.select("doc_id", "sentiment_label", "score_pos", "score_neu", "score_neg", "score_cont")
