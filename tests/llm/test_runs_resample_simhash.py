"""Periodic runs, importance resampling and SimHash groups against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from textpulse.llm import resample, runs, simhash

SPACE = re.compile("[\x20\x09-\x0d]+")


def _words(text):
    return [w for w in SPACE.split(text or "") if w]


def _rows(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: (r[key] is None, r[key] or 0))


# -- runs -----------------------------------------------------------------------

def brute_runs(w, least_words=24, least_periods=3):
    best = {}
    for p in range(1, len(w) // least_periods + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > s and i + p - s >= max(least_words, least_periods * p):
                best.setdefault((s, i + p), p)
            i += i == s
    return sorted((s, e - s, p) for (s, e), p in best.items())


def brute_long(w, least_words=24, least_periods=3):
    x, best = np.unique(w, return_inverse=True)[1], {}
    for p in range(1, len(x) // least_periods + 1):
        edge = np.diff(np.concatenate(([0], x[:-p] == x[p:], [0])).astype(int))
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if e + p - s >= max(least_words, least_periods * p):
                best.setdefault((s, e + p), p)
    return sorted((s, e - s, p) for (s, e), p in best.items())


def _periodic(rng, most):
    n, kinds, w = rng.randint(0, most), rng.choice([1, 2, 3, 5]), []
    while len(w) < n:
        if rng.random() < 0.3:
            u = [rng.randrange(kinds) for _ in range(rng.randint(1, 30))]
            w += (u * 8)[: rng.randint(1, 8 * len(u))]
        else:
            w += [rng.randrange(50) for _ in range(rng.randint(1, 20))]
    return w


def test_catchers_find_the_runs_of_brute_force(monkeypatch):
    rng = random.Random(1)
    for step in (1, 7, 64, 1 << 16):  # words appended at a time
        monkeypatch.setattr(runs, "APPEND_WORDS", step)
        for _ in range(150):
            texts = [_periodic(rng, 200) for _ in range(rng.randint(1, 4))]
            least = rng.choice([24, 24, 6, 1])
            assert runs.runs_of(texts, least) == [brute_runs(t, least) for t in texts]


def test_long_periodic_texts_stay_cheap():
    import time
    t0 = time.perf_counter()
    assert runs.runs_of([["a"] * 200_000]) == [[(0, 200_000, 1)]]
    nested = runs.runs_of([(["a"] * 100 + ["b"]) * 1000])[0]
    assert (0, 101_000, 101) in nested and len(nested) == 1001
    assert time.perf_counter() - t0 < 20


def test_runs_of_a_table(spark, docs, messy):
    """Whole contract: repeated tails, digests, best run; nulls, ties, repeated rows."""
    rng = random.Random(3)
    rows = [(i, " \t".join(f"w{x}" for x in _periodic(rng, 300)), "a") for i in range(200)]
    table = docs(rows).unionByName(messy).repartition(5)
    got = runs.digests(runs.find_runs(runs.with_tails_repeated(table)))
    want = []
    for doc_id, text in [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]:
        w = _words(text)
        h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute_runs(w) if n < 1000 else brute_long(w)
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in found)]
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        want.append((doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
                     hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
                     hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_of_an_empty_table(docs, messy):
    assert runs.digests(runs.find_runs(runs.with_tails_repeated(messy.limit(0)))).count() == 0


# -- resampling -----------------------------------------------------------------

def brute_resample(rows, target, percent=25, least=20, buckets=10_000, seed=7):
    def feats(text):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower) if x]
        return len(w), [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]
    own = [(i, *feats(t)) for i, t in rows]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, _, f in own:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, feats(x)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, n, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    order = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(order[: percent * len(order) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


def _drawn(df):
    return [tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()]


def test_resample_like_brute_force(spark, docs, messy):
    rng = random.Random(5)
    words = ["alpha", "BETA", "gämma", "δ", "x1", "9", "e-mail", "don't", "漢字"]
    rows = [(i, " ".join(rng.choices(words, weights=range(1, 10), k=rng.randint(0, 60))), "a") for i in range(300)]
    target = [" ".join(rng.choices(words, weights=range(9, 0, -1), k=40)) for _ in range(20)] + [None, ""]
    table = docs(rows).unionByName(messy).repartition(6)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    want = brute_resample([(r["doc_id"], r["text"]) for r in table.collect()], target)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(_drawn(resample.resample(table, bench)), key=key) == sorted(want, key=key)
    # Another layout of the rows gives the same draw.
    assert sorted(_drawn(resample.resample(table.coalesce(1), bench)), key=key) == sorted(want, key=key)


def test_resample_repeated_rows_and_empty_tables(spark, docs):
    text = " ".join(f"w{i}" for i in range(25))
    table = docs([(7, text, "a")] * 40 + [(8, "short", "a")])
    none = spark.createDataFrame([], "item_id long, text string")
    got = _drawn(resample.resample(table, none))
    assert len(got) == 41 and sorted(r[4] for r in got if r[4]) == list(range(1, 11))
    assert got.count(next(r for r in got if r[0] == 8)) == 1
    assert resample.resample(table.limit(0), none).count() == 0


def test_resample_draws_what_is_like_the_target(spark, docs):
    rng = random.Random(6)
    near, far = [f"near{i}" for i in range(50)], [f"far{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choices(near if i % 10 == 0 else far, k=60)), "a") for i in range(400)]
    bench = spark.createDataFrame([(i, " ".join(rng.choices(near, k=60))) for i in range(20)], "item_id long, text string")
    drawn = [r["doc_id"] for r in resample.resample(docs(rows), bench).filter("rank IS NOT NULL").collect()]
    assert len(drawn) == 100 and sum(d % 10 == 0 for d in drawn) >= 36


# -- simhash --------------------------------------------------------------------

def brute_print(text):
    w = _words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, radius=3):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def _clustered(rng, centres, each, most=4):
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            x = c
            for b in rng.sample(range(64), rng.randint(0, most)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_ball_hashing_joins_what_brute_force_joins(spark):
    rng = random.Random(11)
    some = rng.getrandbits(64)
    prints = sorted({*_clustered(rng, 40, 8), *_clustered(rng, 3, 40, 3), 0, 1, 7, 1 << 63, (1 << 64) - 1,
                     *(some ^ b for b in (0, 1 << 40, 0b111, 0b1111 << 20, 1 << 35 | 1 << 3 | 1 << 60))})
    df = spark.createDataFrame([(_signed(p),) for p in prints], "print long").repartition(5)
    of = brute_groups(prints)
    want = sorted(sorted(p for p, g in zip(prints, of) if g == k) for k in set(of))
    # As a rule; the larger groups by whole variants; in many turns.
    for how in ({}, {"hot_halves": 10_000, "least_hot": 3}, {"variants": 3000}):
        links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df, **how).collect()]
        assert all(1 <= (a ^ b).bit_count() <= 3 for a, b in links)
        at = {p: i for i, p in enumerate(prints)}
        parent = list(range(len(prints)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i
        for a, b in links:
            parent[find(at[a])] = find(at[b])
        got = [find(i) for i in range(len(prints))]
        assert sorted(sorted(p for p, g in zip(prints, got) if g == k) for k in set(got)) == want


def test_hot_halves_are_found(spark):
    prints = [7 << 32 | i for i in range(300)] + [i << 32 | i * 77 for i in range(1000, 1500)]
    df = spark.createDataFrame([(_signed(p),) for p in prints], "print long")
    keys = {r["key"] for r in simhash.hot_keys(df).collect()}
    assert keys == {7} | {7 | 1 << b for b in range(3, 32)}
    assert simhash.hot_keys(df, least_hot=400).count() == 0


def test_links_of_a_dense_group_are_no_pairs(spark):
    """Many prints in one ball: each variant links to its centre, so links are
    bounded by variants, not by pairs."""
    rng = random.Random(12)
    prints = _clustered(rng, 1, 3000, 2)
    df = spark.createDataFrame([(_signed(p),) for p in prints], "print long")
    pairs = sum(1 for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3)
    n = simhash.links(df).count()
    assert n < pairs and n <= 66 * len(prints)


def test_groups_of_a_table(spark, docs, messy):
    rng = random.Random(13)
    base = [[f"w{rng.randrange(2000)}" for _ in range(rng.randint(150, 400))] for _ in range(25)]
    rows = []
    for i in range(200):
        w = list(base[i % 25])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((1000 - i, (" " if i % 2 else "\t\n").join(w).upper() if i % 3 else " ".join(w), "a"))
    table = docs(rows).unionByName(messy).repartition(4)
    got = _rows(simhash.near_groups(table))
    rows = sorted(((r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0))
    prints = [brute_print(t) for _, t in rows]
    of = brute_groups(prints)
    least = {g: min((i for (i, _), k in zip(rows, of) if k == g and i is not None), default=None) for g in set(of)}
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, of)), key=key) == sorted(map(tuple, got), key=key)
    assert len({r["component_id"] for r in got}) < 120  # near copies are found
    assert simhash.near_groups(table.limit(0)).count() == 0


def test_hot_keys_join_like_others(spark):
    from textpulse.llm.common import join_hot
    rows = spark.range(9000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k")
    one = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    got = join_hot(rows, one, "k", "n")
    assert got.count() == 9000 and got.filter("k = 7").selectExpr("min(least)", "count(1)").first()[:] == (0, 3001)
    assert join_hot(rows.limit(0), one.limit(0), "k", "n").count() == 0


def test_spark_hash_is_the_same(spark):
    """The contract's XXH64 is also Spark's, so prints can be checked in SQL."""
    words = ["a", "one two three", "漢字 é 🙂", "x" * 200]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()
    assert [r[0] % (1 << 64) for r in got] == [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
