"""c-TF-IDF golden rows, topic labels, and language id against a brute-force
pandas implementation on a small fixture."""

import math
from collections import Counter

from pyspark.sql import functions as F

from textpulse.operators import langid as LID
from textpulse.operators import topics as TP


def test_ctfidf_golden(spark):
    df = spark.createDataFrame([("A", ["x", "x", "y"]), ("B", ["x", "z", "z"])],
                               "topic string, tokens array<string>")
    w = {(r["topic"], r["term"]): round(r["weight"], 4)
         for r in TP.ctfidf(TP.class_term_counts(df, "topic")).collect()}
    assert w[("A", "x")] == 1.3863 and w[("A", "y")] == 1.3863
    assert w[("B", "z")] == 1.8326 and w[("B", "x")] == 0.6931
    tops = TP.top_words(TP.ctfidf(TP.class_term_counts(df, "topic")))
    a = [r["term"] for r in tops.where("topic = 'A'").orderBy("rank").collect()]
    assert a == ["x", "y"]


def test_topic_label_format(spark):
    df = spark.createDataFrame([(-1, ["a"]), (0, ["x", "y", "z", "w"]), (3, [])],
                               "tid int, words array<string>")
    got = [r[0] for r in df.select(TP.topic_label(F.col("tid"), F.col("words"))).collect()]
    assert got == ["outlier", "T0: x | y | z", "T3"]


def _brute_force(train, test, n=3):
    counts, totals, docs = {}, Counter(), Counter()
    for text, lang in train:
        t = text.lower()
        g = [t[i:i + n] for i in range(len(t) - n + 1)]
        counts.setdefault(lang, Counter()).update(g)
        totals[lang] += len(g)
        docs[lang] += 1
    vocab = len(set().union(*[set(c) for c in counts.values()]))
    out = []
    for text in test:
        t = text.lower()
        g = [t[i:i + n] for i in range(len(t) - n + 1)]
        best = None
        for lang in sorted(counts):
            s = math.log(docs[lang] / sum(docs.values()))
            s += sum(math.log((counts[lang][x] + 1) / (totals[lang] + vocab)) for x in g)
            if best is None or s > best[0]:
                best = (s, lang)
        out.append(best[1])
    return out


def test_langid_matches_brute_force(spark):
    train = [("the cat sat on the mat with the hat", "en"), ("this is the house that jack built", "en"),
             ("le chat est sur le tapis avec le chapeau", "fr"), ("ceci est la maison que jacques a construite", "fr"),
             ("der hund ist in dem haus mit dem hut", "de")]
    test = ["the hat is on the cat", "le chapeau est sur le chat", "das haus ist mit dem hund", "zzz"]
    tr = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(train)], "doc_id int, text string, lang string")
    te = spark.createDataFrame([(i, t) for i, t in enumerate(test)], "doc_id int, text string")
    model = LID.train(tr)
    pred = {r["doc_id"]: r for r in LID.predict(te, model).collect()}
    want = _brute_force(train, test)
    assert [pred[i]["lang_pred"] for i in range(len(test))] == want
    assert pred[0]["lang_detected"] == "en" and pred[3]["lang_detected"] == "unknown"


def test_compact_model_equals_brute_force(spark):
    """The same labels as the exact model on the driver's documents, and its rules on edges."""
    import os

    import pytest
    train = [("the cat sat on the mat with the hat", "en"), ("this is the house that jack built", "en"),
             ("le chat est sur le tapis avec le chapeau", "fr"), ("ceci est la maison que jacques a construite", "fr"),
             ("der hund ist in dem haus mit dem hut", "de")]
    test = ["The Hat is on the cat", "le chapeau est sur le chat", "das haus ist mit dem hund", "zzz", "", None, "été 漢字 🙂 " * 3]
    tr = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(train)], "doc_id int, text string, lang string")
    te = spark.createDataFrame([(i, t) for i, t in enumerate(test)], "doc_id int, text string")
    exact = {r["doc_id"]: (r["lang_pred"], r["lang_detected"]) for r in LID.predict(te, LID.train(tr)).collect()}
    got = {r["doc_id"]: (r["lang_pred"], r["lang_detected"]) for r in LID.predict_compact(te, LID.train_compact(tr)).collect()}
    assert {i: exact[i] for i in (0, 1, 2, 3, 4, 6)} == {i: got[i] for i in (0, 1, 2, 3, 4, 6)}
    assert got[5][1] in ("unknown",) and len(got) == len(test)
    none = LID.train_compact(tr.limit(0))
    assert {r["lang_detected"] for r in LID.predict_compact(te, none).collect()} == {"unknown"}
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("driver test data not present")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    exact = {r["doc_id"]: r["lang_detected"] for r in LID.predict(docs, LID.train(docs)).collect()}
    for bits in (20, 16):
        got = {r["doc_id"]: r["lang_detected"] for r in LID.predict_compact(docs, LID.train_compact(docs, bits=bits)).collect()}
        assert sum(got[i] == exact[i] for i in exact) >= 0.999 * len(exact)


def test_compact_prediction_has_no_exchange(spark):
    docs = spark.createDataFrame([(1, "the cat", "en")], "doc_id int, text string, lang string")
    plan = LID.predict_compact(docs, LID.train_compact(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
