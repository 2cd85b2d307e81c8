"""Literal expected rows for small details: dates, emoji, labels, numeric edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from textpulse import constants as K
from textpulse.functions import dates as D
from textpulse.functions import numeric as N
from textpulse.functions import text as TX
from textpulse.operators.sampling import sample_n


def one(spark, col, value="x", kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(col).first()[0]


@pytest.mark.parametrize("zone", ["UTC", "Europe/Paris"])
@pytest.mark.parametrize("text, want", [
    ("2023-03-26 02:30:00", dt.datetime(2023, 3, 26, 2, 30)),  # does not exist in Paris
    ("2023-05-01T10:00:00Z", dt.datetime(2023, 5, 1, 10)),
    ("2023-05-01 10:00:00.250", dt.datetime(2023, 5, 1, 10, 0, 0, 250000)),
    ("2023-05-01", dt.datetime(2023, 5, 1)), (" 2023-05-01 10:00 ", dt.datetime(2023, 5, 1, 10)),
    ("not a date", None), ("", None), (None, None)])
def test_dates(spark, zone, text, want):
    spark.conf.set("spark.sql.session.timeZone", zone)
    assert one(spark, D.parse_timestamp("v"), text) == want
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_typed_timestamps_pass(spark):
    t = dt.datetime(2023, 5, 1, 10, 0, 0, 250000)
    assert one(spark, D.parse_timestamp("v"), t, "timestamp_ntz") == t


@pytest.mark.parametrize("text, want", [
    ("\u2318 \u266a stay", "\u2318 \u266a stay"), ("a\u200db", "a\u200db"), ("x \u2714 y", "x  y"), ("\U0001F600!", "!"),
    ("\U0001F468\u200d\U0001F469\u200d\U0001F467 fam", " fam"), ("\u2764\ufe0f", ""), ("1\ufe0f\u20e3 #\u20e3 1", "  1"),
    ("\U0001F44D\U0001F3FD", ""), ("\U0001F1EB\U0001F1F7", ""), ("\U00010400 letter", "\U00010400 letter")])
def test_emoji(spark, text, want):
    assert one(spark, TX.remove_emoji("v"), text) == want


def test_labels():
    assert K.WEEKDAY_LABELS_FR == ["Lun", "Mar", "Mer", "Jeu", "Ven", "Sam", "Dim"]


def test_nan_is_null(spark):
    df = spark.createDataFrame([(float("nan"),), (0.12345,), (None,)], "v double")
    assert [r[0] for r in df.select(N.rnd("v")).collect()] == [None, 0.1235, None]
    assert df.agg(N.grid_mean("v")).first()[0] == 0.1235


def test_variance_of_billions_of_rows(spark):
    """n * (n - 1) and n * s2 beyond a long."""
    n = 60_000_000_000
    row = spark.range(1).select(N.variance_of(F.lit(n), F.lit(n * 5000), F.lit(n).cast("decimal(38,0)") * 25_000_000 + n)).first()
    assert row[0] == pytest.approx(1.0, rel=1e-9)


def test_grid_std_matches(spark):
    df = spark.createDataFrame([(x / 10000,) for x in (1, 5, 9, 9999)], "v double")
    assert df.agg(N.grid_std("v")).first()[0] == pytest.approx(0.4997, abs=1e-4)


def test_sample(spark):
    df = spark.range(1000).withColumnRenamed("id", "post_id")
    a = {r[0] for r in sample_n(df, 137).collect()}
    assert len(a) == 137 and a == {r[0] for r in sample_n(df.repartition(7), 137).collect()}
    assert sample_n(df, 1000).count() == 1000 and sample_n(df, 0).count() == 1000
    with pytest.raises(ValueError, match="sample of 1001"):
        sample_n(df, 1001)
