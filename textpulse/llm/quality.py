"""Quality classifier: random Fourier features of document statistics, ridge
regression from summed normal equations, isotonic calibration.

The statistics of a whole text are standardised by the mean and deviation of
all documents. Random Fourier features approximate a Gaussian kernel over
them. Each task sums its labelled rows' normal equations; the sums of all
tasks are added by Spark and solved on the driver, whose matrix has a fixed
size. The raw score of each training row comes from the ridge of the other
folds, and is counted on a grid of ``GRID`` steps; pooling adjacent violators
over the grid gives the calibration. All labelled rows count; none is sampled.

Only the text enters a score.

Defined results: null or empty text gets a score like any other; null labels
don't count, several labels of one id each count; null ids are scored and
never match a label; rows that repeat are each scored; with no label, or one
class only, the score is the share of label 1 (one half without any); an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.llm.common import materialize, remainder, text_of

FEATURES = 192
WIDTH = 3.0      # of the kernel, in deviations
RIDGE = 0.3
FOLDS = 4
GRID = 1024
HELD_OUT = 4     # a row is held out if crc32(doc_id) modulo this ...
HELD_OUT_IS = 2  # ... is this
ACCEPT = 0.7

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "#$%&*@^~<>{}[]\\=+_`"]] = True


def statistics(text: str) -> list[float]:
    """Rates and two logarithms. Rates count some more bytes, words and lines
    than there are, so those of very short texts stay moderate."""
    data = text.encode("utf-8", "surrogatepass")
    a = np.frombuffer(data, np.uint8)
    n = len(a) + 30.0
    c = np.bincount(a, minlength=256)
    words = data.split()
    m = len(words) + 6.0
    same = a[1:] == a[:-1]
    marks = _MARK[a]
    lines = [x for x in data.split(b"\n") if x]
    letters = c[_LETTER].sum()
    return [
        np.log(n), np.log(m), c[_UPPER].sum() / (letters + 30.0), letters / n, c[128:].sum() / n, c[48:58].sum() / n,
        c[33] / m, c[124] / m, c[_MARK].sum() / m, (c[44] + c[46]) / m, c[32] / n, len(lines) / m,
        float((same & marks[1:]).sum()) / m, float(same.sum()) / n,
        len(set(words)) / m, sum(map(eq, words, words[1:])) / m, len(set(lines)) / (len(lines) + 2.0),
        sum(map(bytes.isupper, words)) / m,
    ]


N_STATS = len(statistics(""))
_RNG = np.random.default_rng(11)
_W = _RNG.standard_normal((N_STATS, FEATURES)) / WIDTH
_PHASE = _RNG.uniform(0, 2 * np.pi, FEATURES)


def features(stats: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """A one and the Fourier features of standardised statistics."""
    z = np.clip((stats - mean) / deviation, -6, 6)
    return np.column_stack((np.ones(len(z)), np.sqrt(2 / FEATURES) * np.cos(z @ _W + _PHASE)))


def _stats_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "stats": [statistics(t) for t in b["text"]]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(run, "doc_id long, stats array<double>")


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    penalty = np.full(len(a), RIDGE)
    penalty[0] = 1e-9
    return np.linalg.solve(a + np.diag(penalty), b)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the middle and the value of each block."""
    out: list[list[float]] = []
    for p, v, w in zip(x.tolist(), y.tolist(), weight.tolist()):
        out.append([p * w, v * w, w])
        while len(out) > 1 and out[-2][1] / out[-2][2] >= out[-1][1] / out[-1][2]:
            last = out.pop()
            out[-1] = [p + q for p, q in zip(out[-1], last)]
    return np.array([o[0] / o[2] for o in out]), np.array([o[1] / o[2] for o in out])


def fit(stats: DataFrame, labels: DataFrame) -> dict:
    """The model, as a few small arrays, from stats (doc_id, stats) and labels (doc_id, quality)."""
    each = [F.col("stats")[i] for i in range(N_STATS)]
    moments = stats.agg(*[F.avg(x) for x in each], *[F.stddev_pop(x) for x in each]).first()
    mean = np.array([x or 0.0 for x in moments[:N_STATS]])
    deviation = np.array([x if x and x > 1e-9 else 1.0 for x in moments[N_STATS:]])
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter("y IS NOT NULL")
    rows = stats.join(marked, "doc_id").filter(remainder("doc_id", HELD_OUT) != HELD_OUT_IS) \
        .select("stats", "y", (F.xxhash64("doc_id") % FOLDS + FOLDS).alias("f")).withColumn("f", (F.col("f") % FOLDS).cast("int"))
    rows = materialize(rows, "quality-rows")
    size = FEATURES + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FOLDS, size, size + 1))
        for b in batches:
            phi, y, f = features(np.stack(b["stats"].to_list()), mean, deviation), b["y"].to_numpy(), b["f"].to_numpy()
            for k in range(FOLDS):
                own = phi[f == k]
                total[k, :, :size] += own.T @ own
                total[k, :, size] += own.T @ y[f == k]
        if total.any():
            for k in range(FOLDS):
                yield pd.DataFrame({"k": k, "i": range(size), "row": list(total[k])})

    summed = (rows.mapInPandas(sums, "k int, i int, row array<double>").withColumn("v", array_to_vector("row"))
              .groupBy("k", "i").agg(Summarizer.sum(F.col("v")).alias("s")).select("k", "i", vector_to_array("s").alias("s")))
    total = np.zeros((FOLDS, size, size + 1))
    for r in summed.collect():  # FOLDS * size rows, whatever the input
        total[r["k"], r["i"]] = r["s"]
    everything = total.sum(0)
    n, ones = everything[0, 0], everything[0, size]
    model = {"mean": mean, "deviation": deviation, "share": ones / n if n else 0.5}
    if not 0 < ones < n:
        return model
    others = np.stack([_solve(*np.split(everything - t, [size], axis=1)).ravel() for t in total])

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            phi = features(np.stack(b["stats"].to_list()), mean, deviation)
            s = (phi * others[b["f"].to_numpy()]).sum(1)
            yield pd.DataFrame({"bin": np.clip(np.round(s * GRID), -GRID, 2 * GRID).astype(np.int64), "y": b["y"]})

    bins = sorted(rows.mapInPandas(raw, "bin long, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).collect())
    x, y = isotonic(np.array([r["bin"] for r in bins]) / GRID, np.array([r["y"] for r in bins]), np.array([r["n"] for r in bins], float))
    return model | {"w": _solve(everything[:, :size], everything[:, size]), "x": x, "y": y}


def apply(model: dict, stats: np.ndarray) -> np.ndarray:
    if "w" not in model:
        return np.full(len(stats), float(model["share"]))
    return np.interp(features(stats, model["mean"], model["deviation"]) @ model["w"], model["x"], model["y"])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    stats = materialize(_stats_of(docs), "quality-stats")
    model = fit(stats, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                s = apply(model, np.stack(b["stats"].to_list()))
                yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": s, "predicted": (s >= ACCEPT).astype(np.int32)})

    scored = stats.mapInPandas(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (remainder("doc_id", HELD_OUT) == HELD_OUT_IS).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that the classifier accepts, with all their columns."""
    model = fit(materialize(_stats_of(docs), "quality-stats"), labels)
    names = docs.columns

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(apply(model, np.array([statistics(t) for t in text]).reshape(-1, N_STATS)))

    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = F.coalesce(F.col(f"c{names.index('text')}").cast("string"), F.lit(""))
    return plain.withColumn("_score", scored(text)).filter(F.col("_score") >= ACCEPT).drop("_score").toDF(*names)
