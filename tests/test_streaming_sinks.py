"""Streaming clean stage over a file stream of the posts view, and sinks."""

import os
import tempfile

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_clean_stream_matches_batch(spark):
    from textpulse.operators.cleaning import clean_posts
    from textpulse.plans import fixtures as FX
    from textpulse.streaming.stream import clean_stream

    if not os.path.isdir(SF):
        return
    d = tempfile.mkdtemp(prefix="tp-stream-")
    raw = FX.posts_raw(spark, SF).where(F.col("posted_raw") != "not a date")
    raw.write.mode("overwrite").parquet(f"{d}/in")
    src = spark.readStream.schema(raw.schema).parquet(f"{d}/in")
    q = (clean_stream(src).select("post_id", "text_clean", "n_tokens")
         .writeStream.format("memory").queryName("tp_clean").outputMode("append")
         .option("checkpointLocation", f"{d}/ck").start())
    q.processAllAvailable()
    q.stop()
    got = {r["post_id"]: (r["text_clean"], r["n_tokens"]) for r in spark.sql("SELECT * FROM tp_clean").collect()}
    want = {r["post_id"]: (r["text_clean"], r["n_tokens"])
            for r in clean_posts(raw).select("post_id", "text_clean", "n_tokens").collect()}
    assert got == want


def test_materialize_and_csv(spark):
    from textpulse.sources.sinks import materialize, write_stage
    df = spark.createDataFrame([(1, ["a", "b"])], "id int, toks array<string>")
    m = materialize(spark, df, "t")
    assert m.collect()[0]["toks"] == ["a", "b"]
    d = tempfile.mkdtemp(prefix="tp-csv-")
    write_stage(df, f"{d}/out", fmt="csv")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{d}/out").first()
    assert back["toks"] == '["a","b"]'


def test_written_tables_can_be_released(spark):
    from textpulse.sources.sinks import fresh_dir, materialize, release
    kept = spark.createDataFrame([(1,)], "a int")
    paths = [materialize(spark, kept, "release").inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:") for _ in range(2)]
    assert all(os.path.isdir(p) for p in paths)
    fresh_dir(spark, "never-written")
    assert release(spark) >= 3 and not any(os.path.exists(p) for p in paths)
    assert release(spark) == 0 and materialize(spark, kept, "again").count() == 1
