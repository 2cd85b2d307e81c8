"""LDA with its topics in a table."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from textpulse.operators import lda
from textpulse.operators import topics as TP

THEMES = [["exam", "study", "grade", "essay", "test", "quiz"], ["pizza", "bread", "cheese", "oven", "dough", "soup"]]


def test_digamma_and_trigamma():
    for f, g in ((lda.digamma, math.lgamma), (lda.trigamma, lambda x: float(lda.digamma(np.array(x))))):
        for x in (0.05, 0.5, 1.0, 7.3, 120.0):
            h = 1e-5 * x
            assert float(f(np.array(x))) == pytest.approx((g(x + h) - g(x - h)) / (2 * h), rel=1e-4, abs=1e-6)


def test_first_weights_are_gamma_and_the_same_anywhere():
    w = lda.first_weights(np.arange(20_000), 4, 42)
    assert w.min() > 0 and w.mean() == pytest.approx(1, abs=0.002) and w.std() == pytest.approx(0.1, abs=0.002)
    assert np.abs(np.corrcoef(w.T) - np.eye(4)).max() < 0.03
    assert (lda.first_weights(np.array([17, 5]), 4, 42) == w[[17, 5]]).all()


def test_state_and_topics_by_table(spark):
    rng = random.Random(3)
    rows = [(i, rng.choices(THEMES[i % 2], k=rng.randint(20, 60))) for i in range(600)] + [(900, []), (None, ["exam", "study", "exam"]), (901, None)]
    df = spark.createDataFrame(rows, "post_id int, tokens array<string>")
    found, topics = TP.lda_model(df, "tokens", "post_id", k=2, max_iter=10, local_cells=0)
    got = {r["post_id"]: r for r in found.collect()}
    assert found.count() == len(rows) and got[900]["topic_id"] == -1 and got[901]["topic_id"] == -1 and got[900]["topic_prob"] is None
    side = [{got[i]["topic_id"] for i in range(600) if i % 2 == s} for s in (0, 1)]
    assert all(len(s) == 1 for s in side) and side[0] != side[1] and got[None]["topic_id"] in side[0]
    words = {r["topic_id"]: r for r in topics.collect()}
    for s in (0, 1):
        t = words[next(iter(side[s]))]
        assert set(t["words"][:6]) == set(THEMES[s]) and t["weights"] == sorted(t["weights"], reverse=True)
    assert sum(r["count"] for r in words.values()) == 601


def test_sums_follow_the_state(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.choices(THEMES[i % 2], k=30)) for i in range(300)], "post_id int, tokens array<string>")
    terms = TP.term_numbers(df)
    docs = TP.term_counts(df, terms, "post_id").selectExpr("post_id", "_c.number AS numbers", "_c.n AS counts").cache()
    model = lda.learn(docs, terms, 3, 1, 3)
    rows = model.weights(terms, False).collect()
    assert len(rows) == 12
    assert np.array([[r[c] for c in model.columns] for r in rows]).sum(0) == pytest.approx(model.sums())
    assert (model.alpha > 0).all()


def _infer_one(beta, counts, alpha, gamma):
    """One text by plain sums."""
    k = len(alpha)
    psi = lambda x: float(lda.digamma(np.array(x)))
    theta = lambda g: [math.exp(psi(x) - psi(sum(g))) for x in g]
    ratio = lambda t: [c / sum(b[i] * t[i] for i in range(k)) for b, c in zip(beta, counts)]
    while True:
        t = theta(gamma)
        r = ratio(t)
        was, gamma = gamma, [alpha[i] + t[i] * sum(b[i] * x for b, x in zip(beta, r)) for i in range(k)]
        if sum(abs(a - b) for a, b in zip(gamma, was)) / k <= lda.CLOSE:
            return gamma, theta(gamma), ratio(theta(gamma))


@pytest.mark.parametrize("at_once", [1, 40, 10_000])
def test_texts_inferred_together_as_one_by_one(monkeypatch, at_once):
    monkeypatch.setattr(lda, "CELLS_AT_ONCE", at_once)
    rng = np.random.default_rng(5)
    table, alpha = rng.random((60, 3)) ** 3 + 1e-3, np.array([0.2, 0.5, 0.3])
    sizes = rng.integers(1, 25, 30)
    place, counts = rng.integers(0, 60, sizes.sum()), rng.integers(1, 5, sizes.sum()).astype(float)
    start = lda.first_weights(np.arange(30), 3, 1)
    gamma, theta, ratio = lda.infer_block(table, place, counts, sizes, alpha, start)
    for i, (a, n) in enumerate(zip(np.cumsum(sizes) - sizes, sizes)):
        want = _infer_one(table[place[a : a + n]].tolist(), counts[a : a + n].tolist(), alpha.tolist(), start[i].tolist())
        assert gamma[i] == pytest.approx(want[0]) and theta[i] == pytest.approx(want[1]) and ratio[a : a + n] == pytest.approx(want[2])


def test_a_step_reads_few_tables_and_a_term_once_a_block(spark):
    """The gains of earlier steps are added up now and then, and a block's texts share the rows of their terms."""
    rng = random.Random(6)
    df = spark.createDataFrame([(i, rng.choices(THEMES[i % 2], k=30)) for i in range(400)], "post_id int, tokens array<string>")
    terms = TP.term_numbers(df)
    docs = TP.term_counts(df, terms, "post_id").selectExpr("post_id", "_c.number AS numbers", "_c.n AS counts").cache()
    model = lda.learn(docs, terms, 2, 1, 9)
    assert 1 <= len(model.gains) <= lda.GAINS_APART
    shape = lambda texts, numbers, beta, place, sizes, *_: pd.DataFrame({"texts": [len(texts)], "terms": [len(numbers)], "cells": [len(place)]})
    dealt = lda.deal(docs.selectExpr("post_id AS uid", "numbers", "counts"), model.cells)
    out = model._inferred(dealt, 0, shape, "texts long, terms long, cells long").collect()
    assert sum(r["texts"] for r in out) == 400 and all(r["terms"] <= 12 for r in out) and sum(r["cells"] for r in out) == model.cells
