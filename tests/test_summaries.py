"""The four summaries in one pass and by roll-up, against the single ones."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from textpulse import constants as K
from textpulse.operators import aggregate as A
from textpulse.operators import rollup as R

SCHEMA = ("post_id long, posted_at timestamp_ntz, month int, lang string, forum string, sentiment_label string, score_cont double, "
          "emotion_joy double, emotion_dominant string, distress_score double, distress_level string, n_tokens int, topic_label string, author string")


def _posts(spark, n=800, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = None if rng.random() < 0.05 else dt.datetime(2023, 1, 1) + dt.timedelta(hours=rng.randrange(17000))
        grid = lambda lo, hi: None if rng.random() < 0.1 else round(rng.uniform(lo, hi), 4)
        rows.append((i, t, t and t.month, rng.choice(["en", "en", "fr", "other", None]), rng.choice(["hot"] * 5 + ["a", "b", None]),
                     rng.choice(["positive", "neutral", "negative", None]), grid(-1, 1), grid(0, 1), rng.choice([*K.EMOTIONS[:3], None]),
                     grid(0, 1), rng.choice([*K.DISTRESS_LEVELS, None]), rng.randrange(50), rng.choice(["T0", "T1", "T2", None]), f"u{rng.randrange(400)}"))
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def _rows(df, drop=()):
    df = df.drop(*drop)
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=str)


SINGLE = {"by_month": A.by_month, "by_season": A.by_season, "by_weekday": A.by_weekday, "global": A.by_lang_forum}


def test_one_pass_gives_the_four_tables(spark):
    df = _posts(spark)
    got = A.all_summaries(df)
    assert set(got) == set(SINGLE)
    for name, single in SINGLE.items():
        want = single(df)
        assert got[name].columns == want.columns or set(got[name].columns) == set(want.columns)
        assert [tuple(r) for r in got[name].select(want.columns).collect()] == [tuple(r) for r in want.collect()], name


def test_one_scan_and_nothing_persisted(spark, tmp_path):
    path = str(tmp_path / "posts")
    _posts(spark).write.parquet(path)
    plan = A.summaries_in_one(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Expand" in plan and "InMemoryTableScan" not in plan


def test_summaries_of_an_empty_table(spark):
    assert all(t.count() == 0 for t in A.all_summaries(_posts(spark).limit(0)).values())


def test_written_summaries_can_be_read_back(spark, tmp_path):
    from textpulse.sources.sinks import write_summaries
    df = _posts(spark, 200)
    for fmt in ("parquet", "csv"):
        write_summaries(A.all_summaries(df), str(tmp_path / fmt), fmt)
        back = {n: spark.read.option("header", True).option("inferSchema", True).format(fmt).load(str(tmp_path / fmt / n)) for n in SINGLE}
        for name, single in SINGLE.items():
            assert back[name].count() == single(df).count()
            assert back[name].agg(F.sum("nb_posts")).first()[0] == single(df).agg(F.sum("nb_posts")).first()[0]


@pytest.mark.parametrize("cuts", [1, 4])
def test_roll_up_of_merged_states(spark, cuts):
    """States of any parts of the posts merge to the summaries of all."""
    df = _posts(spark, seed=2)
    parts = [df.where(F.pmod(F.xxhash64("post_id"), F.lit(cuts)) == i) for i in range(cuts)]
    state = R.merge_states(*[R.daily_state(p) for p in parts])
    values = R.merge_values(*[R.daily_values(p) for p in parts])
    for name, single in SINGLE.items():
        want = single(df).drop("period")
        got = R.roll_up(state, values, name)
        assert _rows(got.select(sorted(want.columns))) == _rows(want.select(sorted(want.columns))), name


def test_state_is_small_and_merges_in_any_order(spark):
    df = _posts(spark, seed=3)
    state = R.daily_state(df)
    assert state.count() == df.select(F.to_date("posted_at"), "lang", "forum").distinct().count()
    a, b = R.daily_state(df.where("post_id < 300")), R.daily_state(df.where("post_id >= 300"))
    assert _rows(R.merge_states(a, b)) == _rows(R.merge_states(b, a)) == _rows(state)


def test_sketches_estimate_distinct_values(spark):
    """HLL sketches of 40,000 authors over two states: within 5 % of the exact number."""
    df = spark.range(120000).select(F.lit(dt.date(2024, 1, 1)).alias("posted_at"), F.lit("en").alias("lang"), F.lit("f").alias("forum"),
                                    (F.col("id") % 40000).cast("string").alias("author"), "id")
    parts = [df.where("id < 70000"), df.where("id >= 70000")]
    state = R.merge_states(*[R.daily_state(p, sketch=("author",)) for p in parts])
    values = R.merge_values(*[R.daily_values(p.withColumn("topic_label", F.lit("T0"))) for p in parts])
    r = R.roll_up(state, values, "global").first()
    assert r["nb_posts"] == 120000 and abs(r["approx_distinct_author"] - 40000) < 2000 and r["nb_unique_topics"] == 1
