"""Online variational LDA whose topics are rows of a table (ML-9).

Spark ML's LDA holds a number for each topic and term at the driver, in several
copies. This is the same method (minibatches, variational inference of each
text's topics, updates with a falling weight, an optimised prior of the texts)
with the same defaults, for vocabularies of any size.

The state of a term after some steps is ``d * (first + sum of its gains) + e``:
``first`` is its random start, drawn from its number, ``d`` and ``e`` are one
number for all terms, and only the terms of a step's texts gain. So each step
writes the gains of its own terms, and a term's state is its gains added up. The
driver holds a few numbers for each topic; a task holds one block of texts and the
rows of its distinct terms (``blocks``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.operators.blocks import deal, meet
from textpulse.sources.sinks import materialize

TAU, KAPPA, FRACTION, SHAPE = 1024.0, 0.51, 0.05, 100.0
CLOSE = 1e-3  # mean change of a text's topics at which inference ends
CELLS_AT_ONCE = 60_000  # counts of texts that are worked on together
GAINS_APART = 4  # steps whose gains are read one by one before they are added up


def digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(6):
        low = x < 6
        out, x = out - np.where(low, 1 / x, 0), np.where(low, x + 1, x)
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))


def trigamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(6):
        low = x < 6
        out, x = out + np.where(low, 1 / (x * x), 0), np.where(low, x + 1, x)
    i = 1 / (x * x)
    return out + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))


def first_weights(numbers: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Gamma(SHAPE, 1 / SHAPE) values for each number and topic, the same
    wherever they are drawn (Wilson and Hilferty's cube of a normal value)."""
    key = numbers.astype(np.uint64)[:, None] * np.uint64(2 * k) + np.arange(2 * k, dtype=np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        key = (key ^ key >> np.uint64(30)) * np.uint64(m)
    u = ((key ^ key >> np.uint64(31)) >> np.uint64(11)).astype(float) / (1 << 53)
    z = np.sqrt(-2 * np.log1p(-u[:, :k])) * np.cos(2 * np.pi * u[:, k:])
    return (1 - 1 / (9 * SHAPE) + z / (3 * np.sqrt(SHAPE))) ** 3


def infer(beta: np.ndarray, counts: np.ndarray, sizes: np.ndarray, alpha: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(topics, exp of their expected logarithm, counts over the norm) of texts,
    whose ``sizes`` columns of ``beta`` follow each other; each text goes on until
    its own topics change little."""
    gammas, thetas, ratios = np.empty_like(start), np.empty_like(start), np.empty(len(counts))
    text, cell, ended = np.arange(len(sizes)), np.arange(len(counts)), np.zeros(len(sizes), bool)

    def step(gamma):
        theta = np.exp(digamma(gamma) - digamma(gamma.sum(1))[:, None])
        return theta, counts / (np.einsum("ij,ij->j", beta, np.repeat(theta.T, sizes, axis=1)) + 1e-100)

    gamma = start
    theta, ratio = step(gamma)
    while True:
        at = np.cumsum(sizes) - sizes
        was, gamma = gamma, theta * np.add.reduceat(beta * ratio, at, axis=1).T + alpha
        theta, ratio = step(gamma)
        done = (np.abs(gamma - was).mean(1) <= CLOSE) & ~ended
        if done.any():
            own = np.repeat(done, sizes)
            gammas[text[done]], thetas[text[done]], ratios[cell[own]] = gamma[done], theta[done], ratio[own]
            ended |= done
            if ended.all():
                return gammas, thetas, ratios
            if ended.sum() >= 0.25 * len(ended):
                go, on = ~ended, np.repeat(~ended, sizes)
                beta, counts, ratio, cell = beta[:, on], counts[on], ratio[on], cell[on]
                sizes, text, gamma, theta, ended = sizes[go], text[go], gamma[go], theta[go], ended[go]


def infer_block(beta: np.ndarray, place: np.ndarray, counts: np.ndarray, sizes: np.ndarray, alpha: np.ndarray, start: np.ndarray):
    """``infer`` for any number of texts, some at a time; ``place`` is each
    count's row of ``beta``."""
    gammas, thetas, ratios = np.empty_like(start), np.empty_like(start), np.empty(len(counts))
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        first = ends[i] - sizes[i]
        j = max(i + 1, int(np.searchsorted(ends, first + CELLS_AT_ONCE, "right")))
        c = slice(first, ends[j - 1])
        gammas[i:j], thetas[i:j], ratios[c] = infer(np.ascontiguousarray(beta[place[c]].T), counts[c], sizes[i:j], alpha, start[i:j])
        i = j
    return gammas, thetas, ratios


class Topics:
    """The topics after some steps: ``weights`` gives terms their rows."""

    def __init__(self, docs: DataFrame, terms: DataFrame, k: int, seed: int):
        self.spark, self.docs, self.terms, self.k, self.seed = docs.sparkSession, docs, terms, k, seed
        self.columns = [f"w{i}" for i in range(k)]
        self.kind = ", ".join(f"{c} double" for c in self.columns)
        self.gains: list[DataFrame] = []
        self.alpha, self.eta = np.full(k, 1.0 / k), 1.0 / k
        self.d, self.e, self.gained = 1.0, 0.0, np.zeros(k)

        columns = self.columns

        def firsts(batches):
            for b in batches:
                yield pd.DataFrame([first_weights(b["number"].to_numpy(), k, seed).sum(0)], columns=columns)

        total = terms.select("number").mapInPandas(firsts, self.kind).agg(*[F.sum(c).alias(c) for c in self.columns]).first()
        self.first = np.array([x or 0.0 for x in total])
        self.size = terms.count()
        r = docs.where("size(numbers) > 0").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("numbers")).alias("cells")).first()
        self.texts, self.cells = r["n"], r["cells"] or 0

    def sums(self) -> np.ndarray:
        return self.d * (self.first + self.gained) + self.size * self.e

    def _gained(self) -> DataFrame | None:
        """(number, w0, w1, ...): the gains of each term that has any."""
        if not self.gains:
            return None
        gains = self.gains[0]
        for g in self.gains[1:]:
            gains = gains.unionByName(g)
        return gains if len(self.gains) == 1 else gains.groupBy("number").agg(*[F.sum(c).alias(c) for c in self.columns])

    def _state(self):
        """A function of (numbers, rows with their gains) to the terms' state, or
        to the exp of its expected logarithm."""
        k, seed, d, e, columns, total = self.k, self.seed, self.d, self.e, self.columns, digamma(self.sums())

        def state(rows: pd.DataFrame, logarithms: bool) -> np.ndarray:
            x = first_weights(rows["number"].to_numpy(), k, seed)
            if columns[0] in rows:
                x = x + rows[columns].fillna(0.0).to_numpy()
            return np.exp(digamma(d * x + e) - total) if logarithms else d * x + e

        return state

    def weights(self, numbers: DataFrame, logarithms: bool) -> DataFrame:
        """(number, w0, w1, ...) of distinct numbers: the state, or the exp of
        its expected logarithm."""
        rows, gained, columns, state = numbers.select("number"), self._gained(), self.columns, self._state()
        if gained is not None:
            rows = rows.join(gained, "number", "left")

        def given(batches):
            for b in batches:
                yield pd.DataFrame(state(b, logarithms), columns=columns).assign(number=b["number"].to_numpy())

        return rows.mapInPandas(given, f"number long, {self.kind}")

    def _inferred(self, docs: DataFrame, turn: int, work, schema: str) -> DataFrame:
        """``work`` on each block of ``docs`` (uid, numbers, counts, block), given
        its texts, its distinct terms with the exp of their expected logarithm, and
        what ``infer`` finds; random starts by uid and ``turn``."""
        k, seed, alpha, state = self.k, self.seed, self.alpha, self._state()

        def block(texts: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("number")
            numbers, beta = rows["number"].to_numpy(), state(rows, True)
            sizes = texts["numbers"].map(len).to_numpy()
            place = np.searchsorted(numbers, np.concatenate(texts["numbers"].to_list()))
            counts = np.concatenate(texts["counts"].to_list()).astype(float)
            start = first_weights(texts["uid"].to_numpy(), k, seed + 7919 * turn)
            return work(texts, numbers, beta, place, sizes, *infer_block(beta, place, counts, sizes, alpha, start))

        return meet(docs, "numbers", self._gained(), "number", "left", block, schema)

    def step(self, t: int) -> None:
        """One minibatch."""
        k, columns = self.k, self.columns
        batch = self.docs.where("size(numbers) > 0").sample(True, FRACTION, self.seed + t).select("numbers", "counts").withColumn("uid", F.monotonically_increasing_id())
        batch = materialize(self.spark, deal(batch, int(self.cells * FRACTION)), "lda-batch")
        n = batch.count()
        if not n:
            return

        def learn(texts, numbers, beta, place, sizes, gamma, theta, ratio):
            gains = [np.bincount(place, ratio * np.repeat(theta[:, i], sizes), len(numbers)) for i in range(k)]
            mine = (digamma(gamma) - digamma(gamma.sum(1))[:, None]).sum(0)
            return pd.DataFrame(np.vstack([np.column_stack(gains) * beta, mine]), columns=columns).assign(number=np.append(numbers, -1))

        found = self._inferred(batch, t + 1, learn, f"{self.kind}, number long").groupBy("number").agg(*[F.sum(c).alias(c) for c in columns])
        found = materialize(self.spark, found, "lda-found")
        total = {r["prior"]: np.array(r[1:]) for r in found.groupBy((F.col("number") < 0).alias("prior")).agg(*[F.sum(c) for c in columns]).collect()}  # two rows
        rho = (TAU + t + 1) ** -KAPPA
        self.d, self.e = self.d * (1 - rho), self.e * (1 - rho) + rho * self.eta
        scale = rho * self.texts / n / self.d
        self.gained += total[False] * scale
        self.gains.append(found.where("number >= 0").select("number", *[(F.col(c) * scale).alias(c) for c in columns]))
        if len(self.gains) > GAINS_APART:
            self.gains = [materialize(self.spark, self._gained(), "lda-gains")]
        self._prior(total[True] / n, n, rho)

    def _prior(self, mean: np.ndarray, n: int, rho: float) -> None:
        """A weighted Newton step on the texts' prior, while it stays positive."""
        a = self.alpha
        slope = n * (mean - digamma(a) + digamma(a.sum()))
        c, q = n * float(trigamma(a.sum())), -n * trigamma(a)
        new = a - rho * (slope - (slope / q).sum() / (1 / c + (1 / q).sum())) / q
        if (new > 0).all():
            self.alpha = new

    def found(self, key: str) -> DataFrame:
        """(key, topic, weight) for every text; both null without tokens."""
        docs = materialize(self.spark, deal(self.docs.withColumn("uid", F.monotonically_increasing_id()), self.cells), "lda-texts")

        def best(texts, numbers, beta, place, sizes, gamma, theta, ratio):
            return pd.DataFrame({"_uid": texts["uid"].to_numpy(), "topic": gamma.argmax(1).astype(np.int32), "weight": gamma.max(1) / gamma.sum(1)})

        named = self._inferred(docs.where("size(numbers) > 0").select("uid", "numbers", "counts", "block"), 0, best, "_uid long, topic int, weight double")
        return docs.select(key, "uid").join(named, F.col("uid") == F.col("_uid"), "left").select(key, "topic", "weight")

    def described(self, n_words: int) -> DataFrame:
        """(topic, number, weight): each topic's heaviest terms."""
        k, columns, total = self.k, self.columns, self.sums()

        def heaviest(batches):
            for b in batches:
                x, n = b[columns].to_numpy() / total, b["number"].to_numpy()
                for i in range(k):
                    at = np.lexsort((n, -x[:, i]))[:n_words]
                    yield pd.DataFrame({"topic": np.full(len(at), i), "number": n[at], "weight": x[at, i]})

        rows = materialize(self.spark, self.weights(self.terms, False).mapInPandas(heaviest, "topic int, number long, weight double"), "lda-heavy")
        out = None
        for i in range(k):
            one = rows.where(F.col("topic") == i).orderBy(F.desc("weight"), "number").limit(n_words)
            out = one if out is None else out.unionByName(one)
        return out


def learn(docs: DataFrame, terms: DataFrame, k: int, seed: int, max_iter: int) -> Topics:
    """``docs`` (key, numbers, counts) and ``terms`` (term, number) are read in
    every step: pass written tables."""
    topics = Topics(docs, terms, k, seed)
    for t in range(max_iter):
        topics.step(t)
    return topics
