"""Language model: gradients, sums to one, held-out gain. Fingerprints."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textpulse.llm import fingerprint as fp
from textpulse.llm import lm

SF = "/root/testdata/sf0.01"


def some_weights(rng):
    vocab = {"head_c": np.full(lm.HEAD, 3.0), "tail_c": np.full(lm.TAILS, 5.0), "tail_v": np.full(lm.TAILS, 2.0)}
    return {k: v + rng.standard_normal(v.shape) * 0.1 for k, v in lm.initial(vocab).items()}  # 64 bits


def test_gradients():
    rng = np.random.default_rng(0)
    w = some_weights(rng)
    sym, off = rng.integers(0, lm.HEAD + lm.TAILS, 60).astype(np.int32), np.array([0, 7, 20, 41, 60])
    lanes = lm.Lanes(sym, off, 2)
    steps, h = next(lanes.windows(lm.WINDOW)), np.zeros((2, lm.HIDDEN))
    g, _, _ = lm._gradients(w, lanes, steps, h)
    rows, sparse = g["x"]
    g["x"] = np.zeros_like(w["x"])
    g["x"][rows] = sparse
    n = sum(map(len, steps))
    for k in lm.SHAPES:
        flat = w[k].ravel()
        for i in np.argsort(-np.abs(g[k].ravel()))[:3]:
            was, e = flat[i], 1e-5
            flat[i] = was + e
            up = lm._gradients(w, lanes, steps, h)[2]
            flat[i] = was - e
            down = lm._gradients(w, lanes, steps, h)[2]
            flat[i] = was
            assert g[k].ravel()[i] == pytest.approx((up - down) / (2 * e) / n, rel=1e-3, abs=1e-5)


def test_state_is_carried_over_whole_documents():
    """Lanes and windows change nothing: a plain loop over each document agrees."""
    rng = np.random.default_rng(1)
    w = some_weights(rng)
    sym, off = rng.integers(0, lm.HEAD + lm.TAILS, 200).astype(np.int32), np.array([0, 3, 90, 91, 200])
    want = []
    for s, e in zip(off, off[1:]):
        h, x = np.zeros((1, lm.HIDDEN)), lm.START
        for t in sym[s:e]:
            h = lm._step(w, w["x"][[x]] + w["b"], h)[0]
            p = lm._log_softmax(h @ w["wc"] + w["bc"])[0, lm.class_of(np.array([t]))[0]]
            if t < lm.HEAD:
                c = t // lm.CLASS_WORDS
                p += lm._log_softmax(h @ w["wo"][c] + w["bo"][c])[0, t % lm.CLASS_WORDS]
            want.append(p)
            x = t
    for n in (1, 2, 9):
        assert np.allclose(lm.log_probabilities(w, sym, off, n), want, atol=1e-4)


def test_probabilities_add_up():
    """Over all classes, their words and an unseen word of each tail class."""
    rng = np.random.default_rng(2)
    w = some_weights(rng)
    h = rng.standard_normal((1, lm.HIDDEN))
    cls = np.exp(lm._log_softmax(h @ w["wc"] + w["bc"]))[0]
    heads = sum(cls[c] * np.exp(lm._log_softmax(h @ w["wo"][c] + w["bo"][c])).sum() for c in range(lm.HEADS))
    counts = [5, 1, 1]
    tail = sum(c + 0.5 for c in counts) + 0.5
    assert heads + cls[lm.HEADS :].sum() * tail / (sum(counts) + 0.5 * (len(counts) + 1)) == pytest.approx(1)


def brute_base(rows):
    words = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    c = Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    return {(d, t): (held(d), len(words(t)), sum(c[w] > 0 for w in words(t)), n,
                     sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))) for d, t in rows}


@pytest.mark.parametrize("known", [100_000, 40])
def test_counts_and_base_score(messy, docs, monkeypatch, known):
    """Whether counts are looked up or joined makes no difference."""
    monkeypatch.setattr(lm, "KNOWN_WORDS", known)
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    want = brute_base(rows)
    got = lm.score(messy).collect()
    assert len(got) == len(rows)
    by_id = {d: [want[k] for k in want if k[0] == d] for d, _ in rows}
    for r in got:
        assert any(w[:4] == (r.held_out, r.n_tokens, r.n_known, r.train_tokens) and r.base_score == pytest.approx(w[4]) for w in by_id[r.doc_id])
        assert -1e9 < r.score < 0
    assert lm.score(docs([])).count() == 0


def test_every_training_document_is_trained_on(messy, docs):
    rows = [(r.doc_id, r.text, r.source) for r in messy.collect()] + [(1000 + i, f"word{i} and more", "a") for i in range(200)]
    every = docs(rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    vocab = lm.vocabulary(lm.counts(every.filter(lm.remainder("doc_id", lm.HELD_OUT) != lm.HELD_OUT_IS)))
    numbers = lm.coded(every, vocab)
    assert numbers.count() == len(rows) and numbers.filter("round IS NULL").count() == sum(zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1 for r in rows)
    _, trained = lm.fit(numbers, vocab)
    assert trained == vocab["n"]


def test_far_logits_keep_their_softmax():
    """Shifted only where float32 would overflow; rows that are far apart too."""
    for spread in (1, 30, 200):
        x = (np.random.default_rng(spread).standard_normal((50, 9)) * spread).astype(np.float32)
        x[0] += 500
        pick = np.arange(50) % 9
        want = lm._log_softmax(x.astype(float))[np.arange(50), pick]
        assert np.allclose(lm._picked(x.copy(), pick)[0], want, rtol=1e-5, atol=1e-3)
        loss, slope = lm._loss_and_slope(x.copy(), pick, np.float32(1 / 50))
        soft = np.exp(lm._log_softmax(x.astype(float)))
        soft[np.arange(50), pick] -= 1
        assert np.allclose(slope, soft / 50, atol=1e-6) and loss == pytest.approx(-want.sum(), rel=1e-4)


@pytest.mark.parametrize("k", ["wc", "wo", "bc", "bo"])
def test_far_weights_are_noticed(k):
    """Weights that may give logits far from 0 have their rows shifted; a bound
    is told from the weights, without looking through all logits."""
    rng = np.random.default_rng(7)
    w = {n: v.astype(np.float32) for n, v in some_weights(rng).items()}
    near = lambda: (lm._are_near(w["wc"], w["bc"]), lm._are_near(w["wo"], w["bo"]))
    assert near() == (True, True)
    w[k] += np.float32(500)
    assert near() == (k[1] != "c", k[1] != "o")
    sym, off = rng.integers(0, lm.HEAD + lm.TAILS, 60).astype(np.int32), np.array([0, 7, 20, 60])
    p = lm.log_probabilities(w, sym, off)
    ln = lm.Lanes(sym, off, 2)
    assert np.isfinite(p).all() and np.isfinite(lm._gradients(w, ln, next(ln.windows(12)), np.zeros((2, lm.HIDDEN), np.float32))[2])


def test_held_out_gain(spark):
    got = lm.score(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    held = got[got["held_out"]]
    assert len(got) == 1000 and held["score"].sum() > 0.98 * held["base_score"].sum()
    assert (held["score"] > held["base_score"]).mean() > 0.8


@pytest.mark.parametrize("parts", [None, 1, 13])
def test_fingerprints_equal_brute_force(docs, parts):
    rng = np.random.default_rng(3)
    rows = [(int(i), " ".join(f"w{x}é" for x in rng.integers(0, 50, rng.integers(0, 80)))) for i in rng.permutation(400)[:150] ** 2]
    rows += [(999_999, None), (1_000_000, ""), (1_000_001, "ab"), (1_000_002, "abc")]
    got = {r.doc_id: r for r in fp.fingerprints(docs([(d, t, "s") for d, t in rows]).repartition(4), partitions=parts).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt, r = t or "", nxt or "", got[d]
        e = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.fingerprint == fp.digest(t.encode()) and r.edited_fingerprint == fp.digest(e.encode())
        assert r.near_edited == fp.likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == fp.likeness(r.fingerprint, fp.digest(nxt.encode()))


def test_fingerprint_edges(messy, docs):
    assert fp.fingerprints(messy, partitions=5).count() == 11
    assert fp.fingerprints(docs([])).count() == 0
    r = fp.fingerprints(docs([(5, "only one here", "s")])).collect()
    assert len(r) == 1 and r[0].near_next == 1.0  # its own neighbour


def test_short_texts_are_told_apart():
    texts = ["a", "b", "ab", "ba", "secret one", "public two", "one two three", "x" * 47, "y" * 47]
    digests = [fp.digest(t.encode()) for t in texts]
    assert len(set(digests)) == len(texts)
    assert fp.likeness(fp.digest(b"secret one"), fp.digest(b"public two")) < 0.99
    assert fp.digest(b"") == fp.digest(b"") and fp.likeness(fp.digest(b"secret one"), fp.digest(b"secret one")) == 1.0


def test_a_far_id_and_a_hot_id_fill_no_range(spark):
    """One id far from all others, a third of all rows with one id and text:
    the ranges stay even, and every row comes back."""
    rows = [(i, f"text of row {i} with a few words") for i in range(1200)] + [(10**15, "far away")] + [(-7, "the same text again")] * 600
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = fp.fingerprints(df, partitions=6)
    assert got.count() == len(rows) and got.filter("doc_id = -7").count() == 600
    src = df.withColumn("_uid", F.monotonically_increasing_id())
    sizes = src.repartitionByRange(6, F.desc_nulls_last("doc_id"), F.xxhash64("text"), "_uid").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 1.7 * len(rows) / 6


def test_chunks_do_not_change_counts(monkeypatch):
    data = np.random.default_rng(4).integers(0, 256, 5000).astype(np.uint8).tobytes()
    whole = fp.counts(data)
    monkeypatch.setattr(fp, "CHUNK", 100)
    assert (fp.counts(data) == whole).all()


def test_likeness_tells_edits_from_neighbours(spark):
    got = fp.fingerprints(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    long = got[got["n_chars"] > 500]
    assert (long["near_edited"] > long["near_next"]).mean() > 0.95
    assert long["near_edited"].median() > 0.5 > long["near_next"].median() and got["near_next"].between(0, 1).all()
    assert fp.difference(got["fingerprint"][0], got["fingerprint"][0]) == 0
