"""Near-duplicates against brute force; the classifier on held-out rows."""

import random
from collections import defaultdict

import numpy as np
import pytest

from textpulse.llm import minhash, quality

SF = "/root/testdata/sf0.01"


def sets_of(text, words):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(rows, words):
    """component of each row by comparing all pairs."""
    sets = [sets_of(t, words) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return sorted([(d, len(s), min(least[find(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets))], key=repr)


@pytest.mark.parametrize("words", [2, 5])
def test_components_equal_brute_force(docs, words):
    """Chains of edits, copies, unrelated and short texts: links at, above and
    below the threshold."""
    rnd = random.Random(words)
    rows, n = [], 0
    for g in range(12):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.randint(20, 120))]
        for _ in range(rnd.randint(1, 9)):
            rows.append((n, " ".join(base)))
            n += 1
            if rnd.random() < 0.8:
                base = list(base)
                for _ in range(rnd.randint(1, 1 + len(base) // 30)):
                    base[rnd.randrange(len(base))] = f"x{rnd.randrange(99)}"
    rows += [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "One"), (n + 4, "one"), (n + 5, "a b"), (None, "a B"), (n + 6, "a b"), (n + 6, "a b"), (None, "lone one")]
    got = minhash.near_groups(docs([(d, t, "s") for d, t in rows]).repartition(5), words=words).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == brute(rows, words)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({(r.component_id, r.doc_id if r.n_shingles == 0 else None) for r in got if r.component_id is not None}) + 1  # and the lone null id
    assert all(r.doc_id == r.component_id for r in kept)


def test_large_group_makes_few_pairs(docs):
    """300 near copies, 60 rows that share half a text: all found, in order."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        t = list(base)
        t[rnd.randrange(200)] = f"y{i}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join(base[:60] + [f"z{i}_{k}" for k in range(80)])) for i in range(60)]
    got = minhash.near_groups(docs([(d, t, "s") for d, t in rows]), words=2).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == brute(rows, 2)


def test_messy_and_empty(messy, docs):
    got = minhash.deduplicate(messy, words=2)
    assert got.columns == messy.columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == [1, 2, 3, 5, 7, 8]
    assert minhash.near_groups(docs([])).count() == 0


def test_signature_estimates_resemblance():
    rng = np.random.default_rng(1)
    est = []
    for _ in range(40):
        x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        a, b = np.unique(x[:900]), np.unique(x[100:])
        est.append((minhash.signature(a) == minhash.signature(b)).mean())
    assert abs(np.mean(est) - 0.8) < 0.015


def test_isotonic():
    x, y = quality.isotonic(np.arange(6.0), np.array([0, 1, 0, 0, 1, 1.0]), np.ones(6))
    assert y.tolist() == [0.0, pytest.approx(1 / 3), 1.0] or y.tolist() == [0.0, pytest.approx(1 / 3), 1.0, 1.0]


def test_kernel_is_approximated():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((50, quality.N_STATS)) * 0.4
    phi = quality.features(a, np.zeros(quality.N_STATS), np.ones(quality.N_STATS))[:, 1:]
    d2 = ((a[:, None] - a[None]) ** 2).sum(-1)
    assert np.abs(phi @ phi.T - np.exp(-d2 / (2 * quality.WIDTH**2))).mean() < 0.06


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.score(spark.read.parquet(f"{SF}/documents.parquet"), labels).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    m = got.merge(labels.toPandas(), on="doc_id")
    held = m[m["held_out"]]
    assert len(held) > 60 and (held["predicted"] == held["quality"]).mean() > 0.93


def test_labels_edges(spark, messy, docs):
    some = spark.createDataFrame([(3, 1, 5), (5, 0, 5), (5, None, 5), (None, 1, 5)], "doc_id long, quality int, text int")
    assert quality.score(messy, some).count() == 11
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(messy, none).collect()} == {0.5}
    assert quality.score(docs([]), some).count() == 0
    assert quality.accepted(docs([]), none).columns == messy.columns
    one = spark.createDataFrame([(3, 1), (4, 1)], "doc_id long, quality int")
    got = quality.accepted(messy, one)
    assert got.columns == messy.columns and got.count() == 11


def test_score_is_of_the_text_alone(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a = {r.doc_id: r.score for r in quality.score(d, labels).collect()}
    from pyspark.sql import functions as F
    b = {r.doc_id: r.score for r in quality.score(d.withColumn("lang", F.lit("x")).withColumn("source", F.col("text")), labels).collect()}
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)
