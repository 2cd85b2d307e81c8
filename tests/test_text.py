"""Golden rows for the cleaning chain (FIXTURES §4.1) and tokens."""

from pyspark.sql import functions as F

from textpulse.functions import text as TX

CASES = [
    (None, ""), ("", ""), ("   ", ""),
    ("see https://a.b/c now", "see now"),
    ("u/bob said r/college", "said"),
    ("/u/bob-x", "/-x"),
    ("and/or/this", "and/or/this"),
    ("hi \U0001F600", "hi "),
    ("\U0001F600", ""),
    ("\U0001F600 \U0001F600", " "),
    ("Won't you", "will not you"),
    ("I can't", "I cannot"),
    ("Shan't", "Sha not"),
    ("John's book", "John is book"),
    ("'really'", " areally'"),
    ("y'all're", "you all are"),
    ("t'sais", "t isais"),
    ("I’m", "I’m"),
    ("gonnas", "going tos"),
    ("é", "é"),
    ("a  b\tc\n", "a b c"),
]


def test_clean_text_golden(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", TX.clean_text("t").alias("c")).collect()}
    for i, (src, want) in enumerate(CASES):
        assert got[i] == want, (src, got[i], want)


def test_tokens_and_stop_words(spark):
    df = spark.createDataFrame([("The cats, and 42 DOGS é ok", "en"), ("le chat et les chiens", "fr"),
                                ("der Hund", "other")], "t string, lang string")
    rows = df.select(TX.tokens_for("t", "lang").alias("k")).collect()
    assert rows[0]["k"] == ["cats", "dogs", "ok"]
    assert rows[1]["k"] == ["chat", "chiens"]
    assert rows[2]["k"] == []


def test_has_min_words(spark):
    df = spark.createDataFrame([("a b c d e",), ("a b c d",), (None,), ("  a  b\nc d\te ",)], "t string")
    got = [r[0] for r in df.select(TX.has_min_words("t", 5)).collect()]
    assert got == [True, False, False, True]


def test_excerpt_and_format(spark):
    df = spark.createDataFrame([("abc", 1234, 22000)], "t string, n long, total long")
    r = df.select(TX.excerpt("t").alias("e"), TX.format_count_pct("n", "total").alias("f")).first()
    assert r["e"] == "abc..."
    assert r["f"] == "1,234 (5.6%)"
    assert df.select(TX.format_count_pct("n", F.lit(0))).first()[0] is None
