"""The guards of the cleaning chain: same values, less work."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from textpulse import constants as K
from textpulse.functions import text as TX


def test_every_emoji_class_member_is_the_same_for_the_jvm(spark):
    # The plain class tests some 190 ranges for each character.
    df = spark.range(1, 0x1FFFF).where("id NOT BETWEEN 55296 AND 57343").select(F.concat(F.lit("a"), F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"), F.lit("b ")).alias("t"))
    was, now = (F.regexp_replace("t", p, "") for p in (K.EMOJI, K.EMOJI_JVM))
    assert df.where(was != now).count() == 0
    assert df.where(now == "ab ").count() > 1000
    assert K.EMOJI_JVM != K.EMOJI


def test_only_texts_that_may_not_be_in_nfc_leave_the_jvm(spark):
    unsafe = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))  # Hangul vowels and finals join
    for i in (i for i in range(0x110000) if not 0xD800 <= i < 0xE000):
        c = chr(i)
        if not unicodedata.is_normalized("NFC", c) or unicodedata.combining(c):
            unsafe.add(i)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and "<" not in parts[0]:
            unsafe.add(int(parts[1], 16))
    df = spark.createDataFrame([(chr(i),) for i in sorted(unsafe)], "t string")
    assert df.where(~F.col("t").rlike(K.NFC_HINT)).count() == 0
    fine = ["été \U0001F600", "“cœur” – 5 €", "Привет", "漢字", "한국"]
    odd = ["é", "하", "Å", "q̣̇"]
    rows = spark.createDataFrame([(t,) for t in fine + odd], "t string")
    sent = {r["t"] for r in rows.where(F.col("t").rlike(K.NFC_HINT)).collect()}
    assert sent == set(odd)
    assert "RLIKE" in rows.select(TX.nfc("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert [r[0] for r in rows.select(TX.nfc("t")).collect()] == [unicodedata.normalize("NFC", t) for t in fine + odd]


def brute(t):
    for prefix in "ur":
        t = re.sub(rf"(^|[^\w]){prefix}/[\w]+", r"\1", t)
    t = re.sub(r"^ | $", "", re.sub(r"\s+", " ", t))
    for p, r in K.CONTRACTIONS:
        t = re.sub(p, r, t, flags=re.I | re.A)
    return t


def test_guarded_steps_equal_the_plain_ones(spark):
    rng = random.Random(5)
    bits = ["u/", "r/", "a", "ur/", " ", "  ", "\t", "\n ", "\x1c", " ", "\xa0", "can't", "ryna", "tryna", "GONNA", "y'all", "won", "'t", "'s", "é", "-", "lemme"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(3000)] + [" ", "  ", "", "can'tryna"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = TX.expand_contractions(TX.strip_spaces(TX.collapse_whitespace(TX.remove_mentions("t"))))
    got = {r["i"]: r["c"] for r in df.select("i", out.alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t


def test_a_filter_on_tokens_derives_them_once(spark):
    df = spark.createDataFrame([(1, "The cats and dogs of many big houses", "en"), (2, "le chat", "fr")], "i int, t string, lang string")
    tok = df.select("i", "lang", TX.tokens_for("t", "lang").alias("tokens"))
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    keep = F.size("tokens") >= 3
    assert plan(TX.settled(tok).where(keep)) == plan(tok) < plan(tok.where(keep))
    assert TX.settled(tok).where(keep).collect() == tok.where(keep).collect()
    assert TX.settled(tok).schema == tok.schema


def test_topic_queries_filter_behind_the_tokens(spark, tmp_path):
    from textpulse.plans import registry
    spark.createDataFrame([(i, "one two three four five six cats", "en", "src0") for i in range(1, 9)],
                          "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = registry.queries()["en_fr_min_tokens"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2  # an English and a French branch, once


def test_word_vectors_are_dealt_by_words_not_posts(spark):
    from textpulse.operators import topics as TP
    # 39,000 posts of 500 words were one task's work for each iteration.
    assert TP.training_parts(39_000 * 500) == 39
    assert TP.training_parts(0) == TP.training_parts(1000) == 1
    assert TP.training_parts(10**12) == 64


def test_content_tokens_equal_filtered_ones_without_a_test_for_each(spark):
    rng = random.Random(8)
    bits = ["a", "b1", "12", "7", "İ", "Ⅳ", "\xb2", "_", "́", "\U00020000", "\U0001d7ce", " ", "-", "Σ", "The"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 6))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.filter(TX.raw_tokens("t"), lambda t: (F.length(t) > 1) & ~t.rlike(r"^\p{N}+$"))
    got = TX.drop_stop_words(plain, "english")
    assert df.where(~TX.tokens_for("t", F.lit("en")).eqNullSafe(got)).count() == 0
    assert "RLIKE" not in df.select(TX.tokens_for("t", F.lit("en")))._jdf.queryExecution().optimizedPlan().toString()


def test_mentions_behind_letters_of_any_plane(spark):
    texts = ["\U00020000u/bob", "\U0001F600u/bob", "u/a u/b", "xu/bob", "/r/c-u/d", "u/", "eau/lait"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace(F.regexp_replace("t", r"(^|[^\p{L}\p{N}_])u/[\p{L}\p{N}_]+", "$1"), r"(^|[^\p{L}\p{N}_])r/[\p{L}\p{N}_]+", "$1")
    assert df.where(TX.remove_mentions("t") != plain).count() == 0
    assert "(^|" not in df.select(TX.remove_mentions("t"))._jdf.queryExecution().optimizedPlan().toString()


def test_contractions_run_only_where_they_occur(spark):
    df = spark.createDataFrame([("it's",), ("SHAN'T we y'ALL",), ("l'eau",), ("'shan't's",), ("can't've",)], "t string")
    rows = [r[0] for r in df.select(TX.expand_contractions("t")).collect()]
    assert rows == [brute(t) for t in ("it's", "SHAN'T we y'ALL", "l'eau", "'shan't's", "can't've")]
    plan = df.select(TX.expand_contractions("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert all(f", {p})" in plan for p, _ in K.CONTRACTIONS if "'" in p)  # Contains(low, p) before each


def test_the_emoji_hint_is_the_same_set_behind_one_wide_range(spark):
    want = {0xA9, 0xAE, 0xFE0F, *range(0x2000, 0x329A), *range(0x1F000, 0x1FB00), *range(0xE0020, 0xE0080)}
    df = spark.range(1, 0x110000).where("id NOT BETWEEN 55296 AND 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("t"))
    assert {r["id"] for r in df.where(F.col("t").rlike(K.EMOJI_HINT)).collect()} == want
    assert K.EMOJI_HINT.startswith(r"[\x{A9}-\x{E007F}&&")
