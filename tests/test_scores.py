"""Golden rows for sentiment / emotion folding and distress (FIXTURES §4.3)."""

from pyspark.sql import functions as F

from textpulse.functions.numeric import distress_level
from textpulse.operators import emotions as EM
from textpulse.operators.sentiment import fold_sentiment

SCORES = "array<struct<label:string,score:double>>"


def _raw(pairs):
    return [{"label": lab, "score": s} for lab, s in pairs] if pairs is not None else None


def test_sentiment_fold(spark):
    rows = [(1, "fr", _raw([("1 star", .1), ("2 stars", .2), ("3 stars", .3), ("4 stars", .25), ("5 stars", .15)])),
            (2, "en", _raw([("positive", .4), ("neutral", .2), ("negative", .4)])),
            (3, "en", _raw([("weird", 1.0)])),
            (4, "en", None)]
    df = spark.createDataFrame(rows, f"post_id int, model_key string, sentiment_raw {SCORES}")
    out = {r["post_id"]: r for r in fold_sentiment(df).collect()}
    r = out[1]
    assert (r["score_neg"], r["score_neu"], r["score_pos"], r["sentiment_label"], r["score_cont"]) == \
        (0.3, 0.3, 0.4, "positive", 0.1)
    assert out[2]["sentiment_label"] == "positive"
    assert out[3]["score_neu"] == 1.0
    assert all(out[4][c] is None for c in ("sentiment_label", "score_pos", "score_cont"))


def test_lexicon_scores(spark):
    lex = spark.createDataFrame([("fear", "fear", 1), ("sad", "sadness", 1), ("sad", "fear", 1),
                                 ("x", "positive", 1), ("x", "joy", 0)],
                                "word string, emotion string, association int")
    df = spark.createDataFrame([(1, ["fear", "sad", "fear", "x"]), (2, ["nothing"]), (3, [])],
                               "post_id int, tokens array<string>")
    out = {r["post_id"]: r for r in EM.lexicon_scores(df, lex).collect()}
    assert out[1]["lex_fear"] == 0.75 and out[1]["lex_sadness"] == 0.25
    assert out[1]["lex_dominant"] == "fear"
    assert out[2]["lex_fear"] == 0.0 and out[2]["lex_dominant"] is None
    assert out[3]["lex_dominant"] is None


def test_model_fold_and_combine(spark):
    rows = [(1, _raw([("annoyance", .2), ("grief", .3), ("neutral", .5)]), ["fear", "sad", "fear", "x"]),
            (2, _raw([("neutral", 1.0)]), []), (3, None, [])]
    df = spark.createDataFrame(rows, f"post_id int, emotion_raw {SCORES}, tokens array<string>")
    lex = spark.createDataFrame([("fear", "fear", 1), ("sad", "sadness", 1), ("sad", "fear", 1)],
                                "word string, emotion string, association int")
    out = {r["post_id"]: r for r in EM.extract_emotions(df, lex).collect()}
    r = out[1]
    assert (r["model_anger"], r["model_sadness"], r["model_dominant"]) == (0.4, 0.6, "sadness")
    assert (r["emotion_fear"], r["emotion_sadness"], r["emotion_anger"]) == (0.225, 0.495, 0.28)
    assert r["distress_score"] == 0.344 and r["distress_level"] == "moderate"
    assert r["emotion_dominant"] == "sadness"
    assert out[2]["model_dominant"] is None and out[2]["model_anger"] == 0.0
    assert out[3]["model_dominant"] is None


def test_distress_levels(spark):
    vals = [0.0, .2, .2001, .4, .4001, .6, .6001, 1.01, 1.2, -.0005, None]
    want = ["low", "low", "moderate", "moderate", "high", "high", "severe", "severe", None, None, None]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(distress_level("v")).collect()]
    assert got == want


def test_argmax_tie_first_wins(spark):
    from textpulse.functions.numeric import argmax_name
    df = spark.createDataFrame([(0.1, 0.1)], "a double, b double")
    assert df.select(argmax_name({"anger": F.col("a"), "disgust": F.col("b")})).first()[0] == "anger"


def test_the_join_with_a_small_lexicon_shuffles_no_tokens(spark, tmp_path):
    """The written lexicon's size is known when the join is planned, also next
    to tokens that are too large to broadcast."""
    from pyspark.sql import functions as F
    from textpulse.operators.emotions import lexicon_hits, prepare_lexicon
    path = str(tmp_path / "posts")
    spark.range(3000).select(F.col("id").alias("post_id"), F.array(F.lit("sad"), F.md5(F.col("id").cast("string")), F.lit("sad")).alias("tokens")) \
        .write.parquet(path)
    lex = prepare_lexicon(spark.createDataFrame([("sad", "sadness", 1), ("sad", "fear", 1), ("ok", "joy", 1)], "word string, emotion string, association int"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        hits = lexicon_hits(spark.read.parquet(path), lex, "post_id", "tokens")
        plan = hits._jdf.queryExecution().sparkPlan().toString()
        assert "/lexicon-" in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        rows = hits.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert len(rows) == 3000 and {(r["_h_sadness"], r["_h_fear"], r["_h_joy"]) for r in rows} == {(2, 2, 0)}
