"""Topic reduction, term numbers and LDA words against brute force."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textpulse.operators import topics as TP

THEMES = {"exam": ["exam", "study", "grade", "essay", "test"], "food": ["pizza", "bread", "cheese", "oven", "dough"],
          "rail": ["train", "ticket", "station", "rail", "track"], "meal": ["bread", "cheese", "soup", "oven", "plate"],
          "quiz": ["test", "grade", "quiz", "study", "mark"]}


def _posts(spark, n=240, seed=1):
    rng = random.Random(seed)
    names = list(THEMES)
    rows = [(i, names[i % 5] if i % 7 else names[0], rng.choices(THEMES[names[i % 5]] + ["the", "and"], k=rng.randint(5, 25))) for i in range(n)]
    return spark.createDataFrame(rows, "post_id int, theme string, tokens array<string>")


def brute_merges(rows):
    """Every round weighs and compares the merged topics' whole vectors anew."""
    tf, sizes = defaultdict(Counter), Counter()
    for theme, tokens in rows:
        tf[theme].update(tokens)
        sizes[theme] += 1
    f = Counter()
    for c in tf.values():
        f.update(c)
    mean = sum(f.values()) / len(tf)
    idf = {t: math.log(1 + mean / n) for t, n in f.items()}
    out = []
    while len(tf) > 1:
        vec = {c: {t: n * idf[t] for t, n in x.items()} for c, x in tf.items()}
        norm = {c: math.sqrt(sum(v * v for v in x.values())) for c, x in vec.items()}
        small = min(sizes, key=lambda c: (sizes[c], c))
        sim = {c: sum(v * vec[c].get(t, 0) for t, v in vec[small].items()) / norm[small] / norm[c] for c in tf if c != small}
        into = max(sorted(sim), key=lambda c: round(sim[c], 12))
        out.append((small, into, sim[into]))
        tf[into].update(tf.pop(small))
        sizes[into] += sizes.pop(small)
    return out


def test_merges_equal_brute_force(spark):
    df = _posts(spark)
    rows = [(r["theme"], r["tokens"]) for r in df.collect()]
    sizes = Counter(t for t, _ in rows)
    dots = {(r["a"], r["b"]): r["dot"] for r in TP.topic_similarities(TP.class_term_counts(df, "theme")).collect()}
    got, want = TP.merge_order(dict(sizes), dots), brute_merges(rows)
    assert [m[:2] for m in got] == [m[:2] for m in want]
    assert [m[2] for m in got] == pytest.approx([m[2] for m in want])


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 0])
def test_reduction_to_a_number(spark, n):
    df = _posts(spark)
    rows = [(r["theme"], r["tokens"]) for r in df.collect()]
    mapping = {t: t for t in THEMES}
    for small, into, _ in brute_merges(rows)[: max(0, 5 - (n or 5))]:
        mapping = {o: into if t == small else t for o, t in mapping.items()}
    got = {r["theme"]: r["topic_id"] for r in TP.merge_topics(df, "theme", n).collect()}
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups(got) == groups(mapping)
    sizes = Counter(got[t] for t, _ in rows)
    assert [sizes[i] for i in range(len(sizes))] == sorted(sizes.values(), reverse=True)


def test_automatic_number_cuts_at_the_largest_fall(spark):
    merges = [("a", "b", 0.9), ("c", "b", 0.85), ("d", "b", 0.3), ("e", "b", 0.2)]
    assert TP.automatic_number(merges, 5) == 3
    assert TP.automatic_number([("a", "b", 0.5)], 2) == 2 and TP.automatic_number([], 1) == 1
    df = _posts(spark)
    merges = brute_merges([(r["theme"], r["tokens"]) for r in df.collect()])
    falls = [merges[i - 1][2] - merges[i][2] for i in range(1, 3)]
    want = 5 - 1 - falls.index(max(falls)) if max(falls) > 0 else 5
    assert TP.merge_topics(df, "theme", -1).agg(F.count_distinct("topic_id")).first()[0] == want


def test_outliers_are_no_topic_and_stay(spark):
    df = _posts(spark).withColumn("theme", F.when(F.col("post_id") % 11 == 0, "none").otherwise(F.col("theme")))
    got = {r["theme"]: r["topic_id"] for r in TP.merge_topics(df, "theme", 2, outlier="none").collect()}
    assert got["none"] == -1 and set(got.values()) == {-1, 0, 1}


def test_merging_takes_a_constant_number_of_jobs(spark):
    rng = random.Random(3)
    rows = [(i, f"t{i % 30}", rng.choices([f"w{i % 30}_{k}" for k in range(5)] + ["common"], k=8)) for i in range(300)]
    df = spark.createDataFrame(rows, "post_id int, theme string, tokens array<string>")
    sc, jobs = spark.sparkContext, []
    for n in (29, 2):
        sc.setJobGroup(f"merge-{n}", "count the jobs")
        TP.merge_topics(df, "theme", n)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"merge-{n}")))
    sc.setJobGroup("", "")
    assert jobs[0] == jobs[1]


def test_term_numbers(spark):
    df = _posts(spark)
    count = Counter(t for r in df.collect() for t in set(r["tokens"]))
    want = {t: i for i, t in enumerate(sorted(count, key=lambda t: (-count[t], t)))}
    for parts in (1, 7):
        assert {r["term"]: r["number"] for r in TP.term_numbers(df.repartition(parts)).collect()} == want
    assert TP.term_numbers(df.limit(0)).count() == 0


def test_count_vectors(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (None, ["b"])], "post_id int, tokens array<string>")
    terms = TP.term_numbers(df)
    number = {r["term"]: r["number"] for r in terms.collect()}
    got = {r["post_id"]: r["features"] for r in TP.count_vectors(df, terms, "post_id").collect()}
    assert {k: {int(i): v for i, v in zip(x.indices, x.values)} for k, x in got.items()} == \
        {1: {number["a"]: 2.0, number["b"]: 1.0}, 2: {}, 3: {}, None: {number["b"]: 1.0}}


def test_lda_names_its_words(spark):
    """Planted themes: each post's topic is its theme's, and the topic's words are the theme's."""
    rng = random.Random(4)
    names = ["exam", "food", "rail"]
    rows = [(i, names[i % 3], rng.choices(THEMES[names[i % 3]], k=20)) for i in range(150)] + [(900, "none", [])]
    df = spark.createDataFrame(rows, "post_id int, theme string, tokens array<string>")
    found, topics = TP.lda_model(df, "tokens", "post_id", k=3, max_iter=30, n_words=5)
    got = {r["post_id"]: r["topic_id"] for r in found.collect()}
    assert len(got) == 151 and got[900] == -1
    of = {n: Counter(got[i] for i, t, _ in rows if t == n).most_common(1)[0] for n in names}
    # LDA may put two themes into one topic; a topic's words are then both's.
    assert all(c >= 45 for _, c in of.values()) and len({t for t, _ in of.values()}) >= 2
    words = {r["topic_id"]: r for r in topics.collect()}
    for t in {t for t, _ in of.values()}:
        own = {w for n in names if of[n][0] == t for w in THEMES[n]}
        assert set(words[t]["words"]) <= own and words[t]["weights"] == sorted(words[t]["weights"], reverse=True)
    assert sum(r["count"] for r in words.values()) == 150
    assert TP.topic_report(topics).count() == 3


def _synonyms(spark, n=600, seed=6):
    """Three topics of 100 words each; a post has five of them, among eight of 80 words that all topics share."""
    rng = random.Random(seed)
    rows = [(i, i % 3, rng.sample(rng.sample([f"t{i % 3}w{k}" for k in range(100)], 5) + rng.sample([f"x{k}" for k in range(80)], 8), 13)) for i in range(n)]
    return spark.createDataFrame(rows, "post_id int, topic int, tokens array<string>")


def _nearest_agree(vectors, topic):
    """Share of posts whose nearest other post, by cosine, is of their topic."""
    import numpy as np
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids])
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return sum(topic[ids[i]] == topic[ids[j]] for i, j in enumerate(s.argmax(1))) / len(ids)


def test_learned_vectors_beat_hashed_counts(spark):
    df = _synonyms(spark, 900)
    topic = {r["post_id"]: r["topic"] for r in df.collect()}
    read = lambda v: {r["post_id"]: r["vector"] for r in v.collect()}
    learned, hashed = read(TP.learned_vectors(df, dims=16)), read(TP.text_vectors(df, dims=256))
    good, plain = _nearest_agree(learned, topic), _nearest_agree(hashed, topic)
    assert good > 0.9 and good > plain + 0.05


def test_learned_vectors_of_odd_rows(spark):
    """Null key, no tokens, unknown words; no common direction is left; no word is frequent enough."""
    import numpy as np
    df = _synonyms(spark, 150).select("post_id", "tokens").unionByName(
        spark.createDataFrame([(None, ["t0w1", "x1"]), (900, []), (901, None), (902, ["onceonly"])], "post_id int, tokens array<string>"))
    got = {r["post_id"]: np.array(r["vector"]) for r in TP.learned_vectors(df, dims=8).collect()}
    assert len(got) == 154 and all(v.shape == (8,) for v in got.values())
    assert all((got[i] == 0).all() for i in (900, 901, 902)) and (got[None] != 0).any()
    x = np.stack(list(got.values()))
    assert np.linalg.eigvalsh(x.T @ x)[0] < 1e-9 * np.linalg.eigvalsh(x.T @ x)[-1]
    rare = TP.learned_vectors(df.where("post_id = 902"), dims=8).collect()
    assert rare[0]["vector"] == [0.0] * 8


def test_word_passes_dont_fall_with_the_posts(spark, monkeypatch):
    """Every post is learnt from as often in a large table as in a small one."""
    asked = []

    class Recorded(TP.Word2Vec):
        def __init__(self, **kw):
            asked.append(kw["maxIter"])
            super().__init__(**kw)

    monkeypatch.setattr(TP, "Word2Vec", Recorded)
    for n in (20, 21_000):
        df = spark.range(n).select(F.col("id").alias("post_id"), F.array(F.lit("a"), F.lit("b")).alias("tokens"))
        assert TP.learned_vectors(df, dims=2).count() == n
    assert asked == [TP.WORD_PASSES, TP.WORD_PASSES] == [10, 10]


def test_learned_vectors_go_by_no_order(spark):
    """The same vectors however the posts are dealt; a repeated key's posts count together."""
    import numpy as np
    df = _synonyms(spark, 120).select("post_id", "tokens").unionByName(spark.createDataFrame([(7, ["t0w1", "x1"]), (None, ["x2"]), (None, ["x3", "t1w2"])], "post_id int, tokens array<string>"))
    runs = [sorted(((r["post_id"] is None, r["post_id"], r["vector"]) for r in TP.learned_vectors(d, dims=4).collect()), key=str)
            for d in (df, df.repartition(7), df.orderBy(F.desc("post_id")))]
    for other in runs[1:]:
        assert [r[:2] for r in other] == [r[:2] for r in runs[0]]
        np.testing.assert_allclose(np.abs([r[2] for r in other]), np.abs([r[2] for r in runs[0]]), atol=1e-9)
    own = {}
    for _, k, v in runs[0]:
        own.setdefault(k, set()).add(tuple(v))
    assert len(own[7]) == len(own[None]) == 1


def test_post_means_are_weighted_means_of_their_words(spark, monkeypatch):
    """Against brute force from the word vectors that were written; texts without a known word are zero."""
    import numpy as np
    kept = {}
    plain = TP.materialize
    monkeypatch.setattr(TP, "materialize", lambda s, d, name="stage": kept.setdefault(name, plain(s, d, name)))
    df = _synonyms(spark, 150).select("post_id", "tokens").unionByName(spark.createDataFrame([(900, ["onceonly"]), (901, [])], "post_id int, tokens array<string>"))
    assert TP.learned_vectors(df, dims=4).count() == 152
    word = {r["word"]: (np.array(r["vector"], float), r["_w"]) for r in kept["word-vectors"].collect()}
    got = {r["_key"]: np.array(r["_m"]) for r in kept["post-means"].collect()}
    want = {}
    for r in df.collect():
        own = [word[t] for t in r["tokens"] if t in word]
        if own:
            want[r["post_id"]] = sum(v * w for v, w in own) / sum(w for _, w in own)
    assert set(got) == set(want) and not {900, 901} & set(got)
    for k, v in want.items():
        np.testing.assert_allclose(got[k], v, rtol=1e-6, atol=1e-9)
