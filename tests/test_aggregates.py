"""Aggregates, quality and chart operators on hand-made rows (FIXTURES §4.4)
plus partition invariance."""

import datetime as dt

from pyspark.sql import functions as F

from textpulse.operators import aggregate as A
from textpulse.operators import charts as CH
from textpulse.operators import quality as QU
from textpulse.operators.dedup import keep_first


def test_keep_first_null_ids(spark):
    df = spark.createDataFrame([(None, 0, 1, "r1"), (None, 0, 2, "r2"), (7, 0, 3, "r3"), (7, 0, 4, "r4")],
                               "post_id int, file_rank int, row_pos int, v string")
    got = sorted(r["v"] for r in keep_first(df, "post_id", ["file_rank", "row_pos"]).collect())
    assert got == ["r1", "r3"]


def test_mode_smallest_on_tie_and_single_row_std(spark):
    df = spark.createDataFrame([("x", "b", 0.4), ("x", "a", 0.41), ("x", "c", None), ("x", "a", None),
                                ("x", "b", None)], "k string, emotion_dominant string, distress_score double")
    r = df.groupBy("k").agg(*A.measures(["emotion_dominant", "distress_score"])).first()
    assert r["dominant_emotion"] == "a"
    assert r["pct_high_distress"] == 40.0
    one = spark.createDataFrame([("x", 0.5)], "k string, distress_score double")
    assert one.groupBy("k").agg(*A.measures(["distress_score"])).first()["std_distress"] is None


def test_season_order_and_weekday(spark):
    rows = [(dt.datetime(2023, 5, 1), 5, "en", "f"), (dt.datetime(2023, 12, 1), 12, "en", "f"),
            (dt.datetime(2024, 1, 1), 1, "en", "f"), (dt.datetime(2024, 3, 1), 3, "en", "f"),
            (None, None, "en", "f")]
    df = spark.createDataFrame(rows, "posted_at timestamp_ntz, month int, lang string, forum string")
    seasons = [r["season"] for r in A.by_season(df).collect()]
    assert seasons == ["hiver", "printemps", "examens"]
    wd = {r["weekday_name"]: r["weekday"] for r in A.by_weekday(df).collect()}
    assert wd["Monday"] == 0
    months = A.by_month(df).collect()
    assert [m["period"] for m in months] == ["01", "03", "05", "12"]


def test_quality_flags_overlap(spark):
    rows = [(i < 2, i < 3 or i == 0, False) for i in range(10)]
    df = spark.createDataFrame(rows, "is_empty boolean, is_too_short boolean, lang_conflict boolean")
    r = QU.quality_flags(df).first()
    assert (r["valid_ref"], r["valid_exact"]) == (5, 7)


def test_histogram_last_bin_and_constant(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    h = QU.histogram(df, "v", 50).collect()
    assert len(h) == 50 and h[-1]["n"] == 1 and sum(r["n"] for r in h) == 11
    c = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    hc = QU.histogram(c, "v", 4).collect()
    assert hc[0]["lo"] == 2.5 and hc[-1]["hi"] == 3.5 and sum(r["n"] for r in hc) == 2


def test_boxplot_quartiles(spark):
    df = spark.createDataFrame([("en", v) for v in (1, 2, 4, 9)], "lang string, n_tokens int")
    r = QU.boxplot(df, "n_tokens", "lang").first()
    assert (r["q1"], r["median"], r["q3"]) == (1.75, 3.0, 5.25)


def test_levels_dense_and_top(spark):
    df = spark.createDataFrame([(1, "low", 0.5, "a"), (2, None, None, "b"), (3, "low", 0.5, "c"),
                                (4, "low", 0.9, "d")],
                               "post_id int, distress_level string, distress_score double, text_clean string")
    lv = CH.distress_levels_dense(df).collect()
    assert [r["n"] for r in lv] == [3, 0, 0, 0]
    top = CH.top_distress(df.withColumn("forum", F.lit("f")).withColumn("lang", F.lit("en")), n=4).collect()
    assert [r["post_id"] for r in top] == [4, 1, 3, 2]


def test_partition_invariance(spark):
    rows = [(i % 5, i % 3, float(i % 7) / 10) for i in range(200)]
    df = spark.createDataFrame(rows, "month int, forum int, distress_score double") \
        .withColumn("lang", F.lit("en")).withColumn("forum", F.col("forum").cast("string"))
    a = sorted(map(tuple, A.summarize(df, ["month", "lang", "forum"]).collect()))
    b = sorted(map(tuple, A.summarize(df.repartition(13), ["month", "lang", "forum"]).collect()))
    assert a == b
