"""Exact quantiles by range refinement, and box plots and histograms on them,
against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textpulse.operators import quality as QU
from textpulse.operators import quantiles as QN

FRACTIONS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def _check(spark, groups, bins=QN.BINS, parts=6):
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(parts)
    got = {r["g"]: r for r in QN.exact_quantiles(df, "v", FRACTIONS, "g", bins).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert (got[g]["n"], got[g]["least"], got[g]["greatest"]) == (len(vs), min(vs), max(vs))
        assert np.allclose(got[g]["quantiles"], np.quantile(np.array(vs, float), FRACTIONS), rtol=1e-14, atol=0), g


def test_like_numpy(spark):
    rng = np.random.default_rng(1)
    _check(spark, {"normal": rng.normal(0, 1, 3000), "ints": rng.integers(0, 40, 3000), "one": [3.5], "two": [1.0, 2.0],
                   "same": [7.0] * 500, "hot": rng.exponential(1, 9000), None: rng.uniform(-5, 5, 200)})


@pytest.mark.parametrize("bins", [2, 16])
def test_few_bins_take_more_rounds(spark, bins):
    rng = np.random.default_rng(2)
    _check(spark, {"a": rng.normal(0, 1e-3, 200), "b": rng.integers(-3, 4, 100)}, bins, 3)


def test_values_of_any_spread(spark):
    """Powers of ten from end to end, both signs, zeros, the smallest and greatest doubles."""
    rng = np.random.default_rng(3)
    spread = 10.0 ** rng.uniform(-300, 300, 1000) * rng.choice([-1, 1], 1000)
    _check(spark, {"spread": spread, "tiny": [5e-324, 1e-323, 0.0, -5e-324, 1.0], "ends": [1e200, 1.0, 2.0, -1e200, 0.0, -0.0],
                   "near": 1.0 + np.arange(50) * 2.0 ** -52})


def test_infinities_nans_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", float("inf")), ("a", 1.0), ("a", float("-inf")), ("b", float("nan")), ("b", None), ("a", None), ("a", 2.0), ("a", 3.0)], "g string, v double")
    got = QN.exact_quantiles(df, "v", [0.0, 0.5, 0.75, 1.0], "g").collect()
    assert [(r["g"], r["n"], r["quantiles"]) for r in got] == [("a", 5, [float("-inf"), 2.0, 3.0, float("inf")])]
    assert QN.exact_quantiles(df.limit(0), "v", [0.5], "g").count() == 0
    assert QN.exact_quantiles(df.where("g = 'a' AND v < 3 AND v > 0"), "v", [0.5]).first()["quantiles"] == [1.5]


def test_each_task_gives_a_bounded_number_of_rows(spark):
    """The first round over 40,000 distinct values passes on a row a bin and task at most."""
    df = spark.range(40000).select((F.col("id") * 0.1).alias("v")).repartition(4)
    lo, hi = F.lit(0.0), F.lit(3999.9)
    one = df.groupBy(QN._bin(F.col("v"), lo, hi, 64, True).alias("bin")).agg(F.count(F.lit(1)))
    assert one.count() == 64


def test_box_plot_of_a_continuous_column(spark):
    rng = np.random.default_rng(4)
    x = {"a": np.concatenate((rng.normal(0, 1, 2000), [50.0, -40.0])), "b": rng.exponential(3, 1500), "c": [1.25]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in x.items() for v in vs] + [("a", None), ("d", None), (None, 1.0)], "g string, v double")
    for written in (True, False):
        got = {r["g"]: r for r in QU.boxplot(df, "v", "g", written).collect()}
        assert set(got) == set(x)
        for g, vs in x.items():
            v = np.array(vs)
            q1, m, q3 = np.quantile(v, [0.25, 0.5, 0.75])
            lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
            r = got[g]
            assert np.allclose([r["q1"], r["median"], r["q3"]], [q1, m, q3], rtol=1e-14)
            assert (r["whisker_lo"], r["whisker_hi"]) == (v[v >= lo].min(), v[v <= hi].max())
            assert (r["n_outliers"], r["n"]) == (((v < lo) | (v > hi)).sum(), len(v))


def test_histogram_of_a_continuous_column(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, 3000)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    got = QU.histogram(df, "v", 20, written=False).collect()
    want, edges = np.histogram(v, 20)
    assert [r["n"] for r in got] == want.tolist()
    assert np.allclose([r["lo"] for r in got], edges[:-1])
