"""Suffix rules for lemmas of unseen forms, against brute force."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from textpulse.operators import tokens as TK


def brute_rules(entries, longest=6, support=2, share=0.5):
    votes = defaultdict(Counter)
    for lang, form, lemma in dict.fromkeys(entries):
        p = 0
        while p < min(len(form), len(lemma)) and form[p] == lemma[p]:
            p += 1
        cut, add = len(form) - p, lemma[p:]
        for k in range(max(cut, 1), min(len(form), longest) + 1):
            votes[lang, form[-k:]][cut, add] += 1
    out = {}
    for key, c in votes.items():
        (cut, add), n = min(c.items(), key=lambda x: (-x[1], x[0]))
        if n >= support and n >= share * sum(c.values()):
            out[key] = (cut, add, n)
    return out


def brute_lemma(lang, form, known, rules, longest=6):
    if (lang, form) in known:
        return known[lang, form], "dictionary"
    for k in range(min(len(form), longest), 0, -1):
        r = rules.get((lang, form[-k:]))
        if r and form[: len(form) - r[0]] + r[1]:
            return form[: len(form) - r[0]] + r[1], "rule"
    return form, "form"


def _dictionary(n=1500, seed=1):
    rng = random.Random(seed)
    out = {}
    for _ in range(n):
        lang = rng.choice(["en", "fr"])
        stem = "".join(rng.choices("abcdehiklmnoprstuvé", k=rng.randint(1, 7)))
        end, base = rng.choice([("s", ""), ("ing", ""), ("ing", "e"), ("ies", "y"), ("ed", ""), ("", "")] if lang == "en" else [("s", ""), ("eaux", "eau"), ("ment", ""), ("es", "e")])
        out[lang, stem + end] = stem + base
    return [(a, b, c) for (a, b), c in out.items()]


def test_rules_and_lemmas_like_brute_force(spark):
    entries = _dictionary()
    table = spark.createDataFrame(entries + entries[:50], "lang string, form string, lemma string").repartition(5)
    rules = brute_rules(entries)
    got = {(r["lang"], r["suffix"]): (r["cut"], r["add"], r["votes"]) for r in TK.lemma_rules(table).collect()}
    assert got == rules and len(rules) > 100
    known = {(a, b): c for a, b, c in entries}
    forms = [(a, b) for a, b, _ in entries[:200]] + [(lg, "".join(random.Random(i).choices("abcdeghinst", k=i % 9)) + end)
                                                     for i in range(400) for lg, end in (("en", "ing"), ("fr", "eaux"), ("de", "s"), ("en", ""))]
    df = spark.createDataFrame(forms + forms[:20] + [(None, "x"), ("en", None)], "lang string, form string").repartition(3)
    got = {(r["lang"], r["form"]): (r["lemma"], r["source"]) for r in TK.lemmas_of_forms(df, table, TK.lemma_rules(table)).collect()}
    assert got == {f: brute_lemma(*f, known, rules) for f in forms}
    assert Counter(s for _, s in got.values()).keys() == {"dictionary", "rule", "form"}


def test_unseen_forms_of_real_endings(spark):
    table = spark.createDataFrame([("en", a + "ies", a + "y") for a in ("cit", "part", "stor")] + [("en", a + "s", a) for a in ("cat", "dog", "book", "tree")],
                                  "lang string, form string, lemma string")
    df = spark.createDataFrame([(1, "en", ["stories", "ladies", "birds", "sky"]), (None, "en", ["bodies"]), (3, "xx", ["cats"]), (4, "en", [])], "post_id int, lang string, tokens array<string>")
    out = {r["post_id"]: r["lemmas"] for r in TK.lemmatize(df, TK.lemma_table(df, table)).collect()}
    assert out == {1: ["story", "lady", "bird", "sky"], None: ["body"], 3: ["cats"], 4: []}


def test_empty_dictionary(spark):
    none = spark.createDataFrame([], "lang string, form string, lemma string")
    df = spark.createDataFrame([("en", "cats")], "lang string, form string")
    assert TK.lemma_rules(none).count() == 0
    assert [tuple(r) for r in TK.lemmas_of_forms(df, none, TK.lemma_rules(none)).collect()] == [("en", "cats", "cats", "form")]


def test_lemma_texts_of_odd_rows(spark):
    """In place, as ``lemmatize`` has them: null key, null or unknown language, no tokens, every column kept."""
    from textpulse.operators import cleaning as CL
    rng = random.Random(8)
    table = spark.createDataFrame([("en", "ends", "end"), ("en", "made", "make"), ("fr", "ends", "fin"), (None, "ends", "no"), ("en", "void", None)], "lang string, form string, lemma string")
    words = ["ends", "made", "void", "other", "é"]
    rows = [(i, rng.choice(["en", "fr", None]), rng.choices(words, k=rng.randint(0, 9)), 2 * i if i % 3 else None, i % 2 == 0) for i in range(60)]
    rows += [(None, "en", ["ends", "made"], 1, None), (2**60 + 1, "en", None, 2, True), (70, "xx", ["ends"], 3, True)]
    df = spark.createDataFrame(rows, "post_id long, lang string, tokens array<string>, n long, flag boolean").withColumn("text_lemma", F.lit("old"))
    want = {r["post_id"]: " ".join(r["lemmas"]) for r in TK.lemmatize(df, table).collect()}
    got = CL.with_lemmas(df, table).collect()
    assert {r["post_id"]: r["text_lemma"] for r in got} == want and len(got) == len(rows)
    assert sorted((r["post_id"], r["lang"], r["tokens"], r["n"], r["flag"]) for r in got if r["post_id"]) == sorted(r for r in rows if r[0])
    assert want[None] == "end make" and want[70] == "ends"


def test_the_detected_clean_stage_writes_no_raw_text(spark, tmp_path, monkeypatch):
    from textpulse.plans import q_clean as Q
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["walk", "walks", "walked", "the", "house", "houses"], k=12)), rng.choice(["en", "fr"]), f"src{i % 9}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    written, plain = {}, Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda s, d, name="stage": written.setdefault(name, plain(s, d, name)))
    out = Q.clean_stage_detected(spark, str(tmp_path))
    assert out.columns == Q.CLEAN_OUT and out.count() == 40
    assert not {"text", "text_lemma", "posted_raw"} & set(written["clean-detected"].columns)
    assert all(len(r["text_lemma"].split()) == r["n_tokens"] for r in out.collect())
