"""UDF-3: batch scorer hook with a failing batch; one model per worker."""


def test_score_with_batches_and_failures(spark):
    def _factory():  # defined inside the test so it is shipped by value
        def predict(texts):
            if any(t == "boom" for t in texts):
                raise RuntimeError("model failure")
            return [[{"label": "positive", "score": 0.75}, {"label": "negative", "score": 0.25}]
                    for _ in texts]
        return predict

    from textpulse.operators.scoring import score_with
    from textpulse.operators.sentiment import fold_sentiment

    rows = [(1, "good"), (2, ""), (3, "boom"), (4, "fine")]
    df = spark.createDataFrame(rows, "post_id int, text string").coalesce(1)
    out = score_with(df, "text", _factory, name="test-two", out_col="sentiment_raw", batch_size=2)
    assert out.columns == ["post_id", "text", "sentiment_raw", "sentiment_raw_failed"]
    from textpulse.operators.scoring import failures
    assert tuple(failures(out, "sentiment_raw").first()) == (4, 2)
    scored = {r["post_id"]: r for r in fold_sentiment(out.selectExpr("*", "'en' AS model_key")).collect()}
    assert scored[1]["sentiment_label"] == "positive" and scored[1]["score_cont"] == 0.5
    assert scored[2]["score_pos"] == 0.75          # blank text sent as "." and scored
    assert scored[3]["sentiment_label"] is None    # the failed batch (rows 3-4) -> nulls
    assert scored[4]["sentiment_label"] is None


def test_one_model_per_worker(spark, tmp_path):
    """Many tasks, few workers: the model is built once in each."""
    where = str(tmp_path)

    def _factory():
        import os
        import uuid
        open(os.path.join(where, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda texts: [[{"label": "x", "score": 1.0}] for _ in texts]

    from textpulse.operators.scoring import score_with
    df = spark.range(64).selectExpr("id", "cast(id as string) as text").repartition(32)
    assert score_with(df, "text", _factory, name="test-once").filter("raw_scores[0].score = 1").count() == 64
    import os
    built = os.listdir(where)
    assert len(built) == len({b.split("-")[0] for b in built}) <= 16
