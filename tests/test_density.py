"""Density clusters and connected components against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from textpulse.operators import density as DN
from textpulse.operators.graph import connected_components


def brute_dbscan(x, radius, min_points):
    """Per row: cluster (least row of its core component; None: noise), core, distance."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = d <= radius
    core = near.sum(1) >= min_points
    label = np.arange(len(x))
    while True:
        new = np.array([label[near[i] & core].min() if core[i] else i for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    out = []
    for i in range(len(x)):
        if core[i]:
            out.append((int(label[i]), True, None))
        elif (near[i] & core).any():
            j = min(np.flatnonzero(near[i] & core), key=lambda j: d[i, j])
            out.append((int(label[j]), False, d[i, j]))
        else:
            out.append((None, False, None))
    return out


def _frame(spark, x, parts=5):
    rows = [(i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "id int, v array<double>, node string").repartition(parts)


def _compare(got, want, n):
    rows = {r["id"]: r for r in got.collect()}
    assert len(rows) == n
    for i, (cluster, core, distance) in enumerate(want):
        assert rows[i]["core"] == core and (rows[i]["cluster"] is None) == (cluster is None), i
        assert (distance is None) == (rows[i]["distance"] is None) and (distance is None or abs(distance - rows[i]["distance"]) < 1e-9)
    pairs = {(rows[i]["cluster"], want[i][0]) for i in range(len(want))}
    assert len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})


def _planted(rng, dims=5):
    parts = [rng.normal(c * 3, 0.25, (60, dims)) for c in range(4)]
    parts += [np.stack([np.linspace(0, 6, 60), *[np.full(60, -4.0)] * (dims - 1)], 1)]  # a chain
    parts += [rng.uniform(-20, 20, (60, dims))]
    parts += [np.repeat(rng.uniform(30, 40, (2, dims)), [12, 3], axis=0)]  # copies: a core point and noise
    return np.concatenate(parts)


def test_clusters_like_brute_force(spark):
    x = _planted(np.random.default_rng(1))
    want = brute_dbscan(x, 0.5, 5)
    _compare(DN.density_clusters(_frame(spark, x), "v", "id", 0.5, 5), want, len(x))


def test_large_buckets_are_dealt_in_blocks(spark, monkeypatch):
    """All points in a few buckets, blocks of 16: same clusters, each pair compared once."""
    x = _planted(np.random.default_rng(2))
    monkeypatch.setattr(DN, "WIDTH", 400.0)
    want = brute_dbscan(x, 0.5, 5)
    _compare(DN.density_clusters(_frame(spark, x), "v", "id", 0.5, 5, block=16), want, len(x))
    points = DN._points(_frame(spark, x).select(F.col("id").alias("_key"), F.col("v").alias("x")))
    dealt = DN._dealt(points, 0.5, 1, 16, 42)
    assert dealt.groupBy("bucket", "i", "j").count().agg(F.max("count")).first()[0] < 80


def test_nulls_copies_and_empty_tables(spark):
    x = [(0.0, 0.0)] * 3 + [(0.1, 0.0)] + [None, None] + [(9.0, 9.0)]
    got = {r["id"]: r for r in DN.density_clusters(_frame(spark, x, 3), "v", "id", 0.5, 4).collect()}
    assert [got[i]["core"] for i in range(7)] == [True] * 4 + [False] * 3
    assert len({got[i]["cluster"] for i in range(4)}) == 1 and all(got[i]["cluster"] is None for i in (4, 5, 6))
    assert DN.density_clusters(_frame(spark, x).limit(0), "v", "id", 0.5, 4).count() == 0
    repeated = spark.createDataFrame([(None, [1.0]), (7, [1.0]), (7, [1.0])], "id int, v array<double>")
    assert [r["core"] for r in DN.density_clusters(repeated, "v", "id", 0.1, 3).collect()] == [True] * 3


def test_recall_of_the_similarity_join():
    """Pairs just inside the radius meet in a band at least as often as asked for."""
    rng = np.random.default_rng(3)
    a = rng.normal(0, 5, (20000, 5))
    step = rng.normal(0, 1, a.shape)
    b = a + step / np.sqrt((step ** 2).sum(1, keepdims=True)) * 0.999
    for recall in (0.9, 0.99):
        bands = DN.bands_for(recall)
        met = (DN.band_keys(a, 1.0, bands) == DN.band_keys(b, 1.0, bands)).any(1).mean()
        assert met >= recall - 0.005
    far = a + step / np.sqrt((step ** 2).sum(1, keepdims=True)) * 60
    assert (DN.band_keys(a, 1.0, DN.bands_for(0.9)) == DN.band_keys(far, 1.0, DN.bands_for(0.9))).any(1).mean() < 0.2


def test_components_like_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 5000)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for i in parent}


def test_density_topics_of_the_embeddings(spark):
    """The registered query against brute force over its reduced vectors."""
    import os

    import pytest

    from textpulse import constants as K
    from textpulse.operators import topics as TP
    from textpulse.plans.q_topics import topic_density_query
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("driver test data not present")
    emb = spark.read.parquet(f"{sf}/embeddings.parquet")
    red = {r["vec_id"]: r["x"] for r in TP.reduced_vectors(emb, "embedding", "vec_id").collect()}
    ids = sorted(red)
    x = np.array([red[i] for i in ids])
    want = brute_dbscan(x, K.DENSITY_RADIUS, K.DENSITY_MIN_POINTS)
    got = {r["vec_id"]: r["topic_id"] for r in topic_density_query(spark, sf).collect()}
    sizes = {}
    for c, _, _ in want:
        sizes[c] = sizes.get(c, 0) + 1
    groups = {}
    for i, (c, _, _) in zip(ids, want):
        groups.setdefault(c if c is not None and sizes[c] >= K.MIN_TOPIC_SIZE else None, []).append(i)
    assert {frozenset(v) for c, v in groups.items() if c is not None} == \
        {frozenset(i for i in ids if got[i] == t) for t in set(got.values()) if t >= 0}
    assert sorted(i for i in ids if got[i] == -1) == sorted(groups.get(None, []))


def test_discovered_topics_by_density_keep_every_post(spark):
    """Planted topics, a null id, a post without words: each post comes back once."""
    from textpulse.operators import topics as TP
    rng = random.Random(9)
    kinds = [["exam", "study", "grade", "essay"], ["pizza", "bread", "cheese", "oven"], ["train", "ticket", "station", "rail"]]
    rows = [(i, rng.choices(kinds[i % 3], k=30)) for i in range(90)] + [(None, rng.choices(kinds[0], k=30)), (500, []), (501, None)]
    df = spark.createDataFrame(rows, "post_id int, tokens array<string>")
    vectors = TP.text_vectors(df.where("tokens IS NOT NULL"), "tokens", "post_id", dims=64)
    posts, topics = TP.discover_topics(df, vectors=vectors, cluster=lambda v, c, key: TP.density_topics(v, c, key, radius=0.4, min_points=5, dims=3, min_size=10))
    got = {r["post_id"]: r["topic_id"] for r in posts.collect()}
    assert posts.count() == len(rows) and got[501] == -1
    assert [len({got[i] for i in range(k, 90, 3)}) for k in range(3)] == [1, 1, 1] and len({got[0], got[1], got[2]}) == 3
    assert got[None] == got[0]
    assert {r["topic_id"] for r in topics.collect()} == set(got.values())


def test_dense_points_are_not_all_compared(spark, monkeypatch):
    """Where each point is near hundreds of others, few are compared with all
    of the cells around; the clusters stay those of brute force. Two dense groups
    side by side stay apart, a bridge of few points joins two others."""
    rng = np.random.default_rng(4)
    dense = rng.normal(0, 0.1, (2000, 5))
    beside = rng.normal(0, 0.02, (300, 5)) + [1.0, 0, 0, 0, 0]
    parted = rng.normal(0, 0.02, (300, 5)) + [1.0, 0.35, 0, 0, 0]
    bridge = np.stack([np.linspace(0, 1, 200), *[np.zeros(200)] * 4], 1)
    x = np.concatenate([dense, beside, parted, bridge, rng.uniform(-3, 3, (100, 5))])
    sent, keep = [], DN._met
    monkeypatch.setattr(DN, "_met", lambda left, home, pairs: sent.append(left.count()) or keep(left, home, pairs))
    _compare(DN.density_clusters(_frame(spark, x), "v", "id", 0.15, 10, block=64), brute_dbscan(x, 0.15, 10), len(x))
    assert len(sent) == 2 and sent[0] < len(x) / 4 and sent[1] < len(x) / 2


def test_vectors_longer_than_a_grid_meet_in_bands(spark):
    x = _planted(np.random.default_rng(6), dims=DN.GRID_DIMS + 2)
    _compare(DN.density_clusters(_frame(spark, x), "v", "id", 0.5, 5), brute_dbscan(x, 0.5, 5), len(x))
