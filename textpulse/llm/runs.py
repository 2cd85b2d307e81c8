"""Periodic runs of words, by online dyadic square catching.

A run is a stretch of words with smallest period q (words q apart are equal),
long enough, that neither neighbour extends. Words are appended to a stream;
each completed, aligned block of 2^k words gets a catcher that waits for the
block's text to come again p words later, for the periods 2^(k+1) - 1 to
2^(k+2) - 2. So on each level exactly two catchers wait for an appended word,
and each period has one level. Windows that end in an appended word are named
by doubling (the name of a window is a 64-bit hash of its halves' names), which
makes a comparison one look at two names.

A run of three periods holds a block of its level that comes again, wherever
it begins. Catches of adjacent blocks at one period are squares of one stretch
and merge; the merged stretch is extended word by word at either end, by less
than a block, and kept if long enough. Of stretches with equal bounds the
smallest period is the run's (others are its multiples).

The texts of a task's batch are one stream in groups of like length, with a
mark of its own after each text, so no square spans two texts. Memory follows
the longest text. Words are compared as numbers dealt in the group, exactly;
windows by their 64-bit names.

Defined results: null and empty texts have no words, no run and an empty
collapsed text; null ids are kept; rows that repeat each give a row; ties of
runs (equal start) are in the order of period; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.llm.common import mix64, text_of

LEAST_WORDS = 24
LEAST_PERIODS = 3
GROUP_WORDS = 1 << 16
APPEND_WORDS = 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Catchers:
    """The catchers of a stream of word numbers, for periods whose runs fit in
    ``longest`` words."""

    def __init__(self, longest: int, least_periods: int = LEAST_PERIODS):
        levels = 0
        while least_periods * ((2 << levels) - 1) <= longest:
            levels += 1
        self.n = 0
        self.named = [(np.zeros(0, np.uint64), 0)] * levels  # names of the latest windows, and where the first starts
        self.caught: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(levels)]

    def append(self, words: np.ndarray) -> None:
        old, self.n = self.n, self.n + len(words)
        new, half, half_at = mix64(words.astype(np.uint64)), None, 0
        for k in range(len(self.named)):
            m = 1 << k
            first = max(0, old - m + 1)  # new windows of m words start here and after
            if self.n - m < first:
                break
            if k:
                i = first - half_at
                count = self.n - m + 1 - first
                new = mix64(half[i : i + count] * _ODD + half[i + m // 2 : i + m // 2 + count])
            tail, at = self.named[k]
            half, half_at = np.concatenate((tail, new)) if len(tail) else new, at if len(tail) else first
            start = np.arange(first, first + len(new))
            block = (start - (2 * m - 1)) // m * m
            for b in (block, block - m):
                come = np.flatnonzero((b >= 0) & (half[np.maximum(b - half_at, 0)] == new))
                if len(come):
                    self.caught[k].append((b[come], start[come] - b[come]))
            keep = max(0, len(half) - 5 * m)
            self.named[k] = (half[keep:], half_at + keep)


def stretches(words: np.ndarray, caught: Catchers, least_words: int = LEAST_WORDS,
              least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the stream ``words``, in order."""
    found: dict[tuple[int, int], int] = {}
    of = np.full(len(words) + 1, -1)  # a run over each word, if one is known
    ends: list[tuple[int, int, int]] = []
    for k, parts in enumerate(caught.caught):
        if not parts:
            continue
        m = 1 << k
        block, period = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((block, period))
        block, period = block[order], period[order]
        breaks = np.flatnonzero((np.diff(period) != 0) | (np.diff(block) != m)) + 1
        i, j = np.concatenate(([0], breaks)), np.concatenate((breaks, [len(block)])) - 1
        first, upto, p = block[i], block[j] + m, period[i]
        enough = upto - first + 2 * (m - 1) + p >= np.maximum(least_words, least_periods * p)
        for a, e, q in zip(first[enough].tolist(), upto[enough].tolist(), p[enough].tolist()):
            r = of[a]
            if r >= 0:
                s0, e0, q0 = ends[r]
                if s0 <= a and e + q <= e0 and q % q0 == 0:
                    continue  # a multiple of a run's period, inside it
            back = words[max(0, a - m) : a] == words[max(0, a - m) + q : a + q]
            miss = np.flatnonzero(~back)
            s = max(0, a - m) + (int(miss[-1]) + 1 if len(miss) else 0)
            on = words[e + q : e + q + m]
            miss = np.flatnonzero(words[e : e + len(on)] != on)
            t = e + q + (int(miss[0]) if len(miss) else len(on))
            if t - s >= max(least_words, least_periods * q) and q < found.get((s, t), q + 1):
                found[s, t] = q
                of[s:t] = len(ends)
                ends.append((s, t, q))
    return sorted((s, t - s, q) for (s, t), q in found.items())


def runs_of(texts: list[list], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, given as lists of words."""
    number = defaultdict(itertools.count().__next__)
    sizes = [len(t) for t in texts]
    stream = np.empty(sum(sizes) + len(texts), np.int64)
    begin, at = [], 0
    for i, t in enumerate(texts):
        begin.append(at)
        stream[at : at + sizes[i]] = np.fromiter(map(number.__getitem__, t), np.int64, sizes[i])
        at += sizes[i] + 1
        stream[at - 1] = -1 - i  # a mark that comes once
    caught = Catchers(max(sizes, default=0), least_periods)
    for i in range(0, len(stream), APPEND_WORDS):
        caught.append(stream[i : i + APPEND_WORDS])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, n, q in stretches(stream, caught, least_words, least_periods):
        i = int(np.searchsorted(begin, s, "right")) - 1
        out[i].append((s - begin[i], n, q))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, each run cut to its first period."""
    if runs:
        kept = np.ones(len(words), bool)
        for s, n, q in runs:
            kept[s + q : s + n] = False
        words = list(itertools.compress(words, kept.tolist()))
    return b" ".join(words)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def find_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """Per document: doc_id, n_words, runs (in the order of start and period)
    and the collapsed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(sizes, kind="stable")
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes[order]) // (6 * GROUP_WORDS))) + 1 if len(order) else []
            for part in np.split(order, cuts):
                rows = b.take(pa.array(part))
                texts = [t.encode("utf-8", "surrogatepass").split() for t in rows.column(1).to_pylist()]
                runs = runs_of(texts, least_words, least_periods)
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], pa.list_(RUN)),
                    pa.array([collapse(t, r).decode("utf-8", "surrogatepass") for t, r in zip(texts, runs)], pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return src.mapInArrow(run, FOUND)


# -- the contract's texts and digests -------------------------------------------

SPACE = r"[\x20\x09-\x0D]+"


def with_tails_repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where the crc32 of the id ends in 0, the words from
    word a on become repeats of p words, a and p by the id and the number of words."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    bound = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  a value that is used often, computed once

    def places(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.floor(h / 10) % n
        return F.struct(w.alias("w"), a.alias("a"), (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.floor(h / 10) % 8))).alias("p"))

    def repeated(x: Column) -> Column:
        w, a, p = x["w"], x["a"], x["p"]
        return F.array_join(F.transform(w, lambda v, i: F.when(i < a, v).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    words = F.filter(F.split(text_of(), SPACE), lambda x: x != "")
    changed = bound(words, lambda w: F.when(F.size(w) > 0, bound(places(w), repeated)).otherwise(F.lit("")))
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text").cast("string")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row of numbers and digests for each row of ``find_runs``."""
    less = lambda c: F.when(c, F.lit(-1))

    def before(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return (less(x > y).when(x < y, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))

    best = F.get(F.array_sort("runs", before), F.lit(0))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return (found.withColumn("_best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"),
                    F.col("_best.period").alias("period"), F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
