"""Stop words are package data and equal Spark ML's defaults."""

import subprocess
import sys

import pytest

from textpulse.functions.stopwords import stop_words


@pytest.mark.parametrize("lang", ["english", "french"])
def test_equal_spark_defaults(spark, lang):
    from pyspark.ml.feature import StopWordsRemover
    assert stop_words(lang) == list(StopWordsRemover.loadDefaultStopWords(lang))


def test_oracle_sql_without_the_ml_jar():
    """Every SQL twin is built with the jar folder hidden."""
    code = ("import glob, pyspark\n"
            "pyspark.__file__ = '/nonexistent/pyspark/__init__.py'\n"
            "from textpulse.plans import registry\n"
            "s = registry.oracle_sql()\n"
            "assert len(s) >= 51 and not any('could not be built' in x for x in s.values())\n")
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_one_broken_twin_hides_no_other(monkeypatch):
    from textpulse.plans import registry
    registry.oracle_sql()
    monkeypatch.setitem(registry._SQL, "broken", lambda: 1 / 0)
    s = registry.oracle_sql()
    assert "could not be built" in s["broken"]
    assert sum("could not be built" in x for x in s.values()) == 1
