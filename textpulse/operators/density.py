"""Density clustering of vectors (ML-3).

Points within ``radius`` (Euclidean) are neighbours. A point with
``min_points`` points within the radius, itself included, is a core point;
core points that are neighbours share a cluster; a point that is no core point
joins its nearest core point's cluster (ties: the smaller number of the point's
vector); all others are noise.

Vectors of up to ``GRID_DIMS`` coordinates (reduced ones have five) meet in
cells whose side is the radius, so the result is exact, and where points are
dense they needn't all be compared:

1. A point with ``min_points`` near it in its block of a cell (at most about
   ``BLOCK`` points, in any of ``GRIDS`` shifted grids) is a core point.
2. The others, which few points are near, are compared with all points of the
   cells around theirs; that also gives the border points' core points.
3. Core points near each other in a block are linked, which joins most of a
   cluster. Points whose labels still differ are compared wherever their cells
   touch; cells whose points and neighbours share a label are left alone.

Steps 1 and 3 compare a point with a block at most, so they grow with the
points; step 2 grows with the points in thin places. What can still grow with
the square of the points is clusters that are dense along a gap of less than two
radii, where step 3 compares the points along it.

Longer vectors meet by a locality-sensitive similarity join: each band has
``HASHES`` random projections cut into steps of ``WIDTH`` radii, and points
whose steps agree in a band meet in a bucket. The number of bands follows from
the wanted ``recall`` of two points that are just a radius apart; nearer ones
meet more surely. Two passes over the buckets give rows in proportion to the
points: the first sums each point's neighbours, the second, which knows the core
points, gives a spanning forest of each block's core links and the nearest core
point of each other point. A pair that meets in several bands counts in the
first of them only. A bucket of over ``BLOCK`` points is dealt as pairs of blocks
over many tasks, whose pairs are all compared.

No cell or bucket has to fit into one task; equal vectors are one point with a
weight, so copies cost nothing.

Null vectors are noise; null keys and repeated rows are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.operators.graph import connected_components
from textpulse.sources.sinks import materialize

HASHES = 3
WIDTH = 6.0
RECALL = 0.9999
BLOCK = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)
PAIRS = 1 << 20  # pairs that a task compares at a time
GRID_DIMS = 5    # a cell has 3 ** 5 cells around it
GRIDS = 4


def collision_chance(width: float = WIDTH) -> float:
    """That one projection puts two points one radius apart in one step of
    ``width`` radii."""
    tail = 0.5 * math.erfc(width / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-width * width / 2))


def bands_for(recall: float = RECALL, hashes: int = HASHES, width: float = WIDTH) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - collision_chance(width) ** hashes)))


def band_keys(x: np.ndarray, radius: float, bands: int, seed: int = 42) -> np.ndarray:
    """A 64-bit key for each point and band."""
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((x.shape[1], bands * HASHES))
    b = rng.random(bands * HASHES)
    steps = np.floor(x @ a / (WIDTH * radius) + b).astype(np.int64).reshape(len(x), bands, HASHES)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _ODD, (len(x), bands)).copy()
    for h in range(HASHES):
        key = (key + steps[:, :, h].astype(np.uint64)) * _ODD
        key = (key ^ key >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _points(vectors: DataFrame) -> DataFrame:
    """(x, node, weight): distinct vectors, written."""
    points = vectors.where("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("weight"))
    return materialize(vectors.sparkSession, points.withColumn("node", F.monotonically_increasing_id()), "density-points")


def _dealt(points: DataFrame, radius: float, bands: int, block: int, seed: int) -> DataFrame:
    """The points of each bucket with two or more, dealt as pairs of blocks."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(keys=list(band_keys(np.stack(b["x"].to_list()), radius, bands, seed)))

    rows = points.select("node", "x", "weight").mapInPandas(keyed, "node long, x array<double>, weight long, keys array<long>")
    rows = rows.select("*", F.posexplode("keys").alias("band", "bucket"))
    rows = materialize(points.sparkSession, rows, "density-buckets")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "x", "keys", "weight", "band")
    return materialize(points.sparkSession, rows, "density-dealt")


def _starts(g: pd.DataFrame) -> np.ndarray:
    """Where each group (bucket, i, j) of sorted rows begins."""
    new = np.ones(len(g), bool)
    new[1:] = False
    for c in ("bucket", "i", "j"):
        v = g[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (bucket, i, j), cut so that no group is parted and the
    pairs of a part stay near ``PAIRS`` (or one group's)."""
    held = None
    for b in batches:
        held = b if held is None else pd.concat([held, b], ignore_index=True)
        starts = _starts(held)
        sizes = np.diff(starts).astype(np.int64)  # the last group may go on
        load, begin = 0, 0
        for k, n in enumerate(sizes):
            load += n * n
            if load >= PAIRS:
                yield held.iloc[begin : starts[k + 1]]
                load, begin = 0, starts[k + 1]
        if begin:
            held = held.iloc[begin:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def _near(g: pd.DataFrame, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, distance): rows of one group within the radius, each pair of
    points in the first band where it meets and, of a bucket's pairs of
    blocks, in one."""
    starts = np.append(_starts(g), len(g))
    x, keys = np.stack(g["x"].to_list()), np.stack(g["keys"].to_list())
    band, cross = g["band"].to_numpy(), (g["i"] != g["j"]).to_numpy()
    side = g["own"].to_numpy()
    out = []
    # Rows are compared with the next row of their group, the one after, and so on.
    end = np.repeat(starts[1:], np.diff(starts))
    a, step = np.arange(len(g)), 1
    while True:
        a = a[a + step < end[a]]
        if not len(a):
            break
        for part in np.array_split(a, max(1, len(a) * x.shape[1] // (PAIRS * 4) + 1)):
            b = part + step
            d = np.sqrt(((x[part] - x[b]) ** 2).sum(1))
            near = (d <= radius) & (~cross[part] | (side[part] != side[b]))
            p, q, d = part[near], b[near], d[near]
            if len(p):
                first = (keys[p] == keys[q]).argmax(1) == band[p]
                out.append((p[first], q[first], d[first]))
        step += 1
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def _count(radius: float, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for g in _groups(batches):
        a, b, _ = _near(g, radius)
        w = g["weight"].to_numpy()
        total = np.bincount(a, w[b], len(g)) + np.bincount(b, w[a], len(g))
        there = np.flatnonzero(total)
        yield pd.DataFrame({"node": g["node"].to_numpy()[there], "near": total[there].astype(np.int64)})


def _link(radius: float, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Core links as a forest (distance null), and offers of a core point to
    another point (a: that point, b: the core point)."""
    for g in _groups(batches):
        a, b, d = _near(g, radius)
        node, core = g["node"].to_numpy(), g["core"].to_numpy(bool)
        both = core[a] & core[b]
        p, q = a[both], b[both]
        if len(p):
            # A point may have rows in several groups: one number for each point.
            u, at = np.unique(node, return_inverse=True)
            own = np.arange(len(u))
            p, q = at[p], at[q]
            while True:
                low = np.minimum(own[p], own[q])
                new = own.copy()
                np.minimum.at(new, p, low)
                np.minimum.at(new, q, low)
                np.minimum.at(new, own[p], low)
                np.minimum.at(new, own[q], low)
                new = new[new]
                if (new == own).all():
                    break
                own = new
            label = u[own]
            moved = np.flatnonzero(label != u)
            yield pd.DataFrame({"a": u[moved], "b": label[moved], "distance": np.full(len(moved), np.nan)})
        one = core[a] != core[b]
        p, q, d = np.where(core[a], b, a)[one], np.where(core[a], a, b)[one], d[one]
        if len(p):
            offers = pd.DataFrame({"a": node[p], "b": node[q], "distance": d}).sort_values(["a", "distance", "b"])
            yield offers.drop_duplicates("a")


def _celled(points: DataFrame, radius: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(rows, cells): each point once for each grid with its cell (the grid's
    number and steps) and its block of the cell, and the cells with their number
    ``at`` and size ``n``."""
    side = radius * (1 + 1e-9)  # rounding must not part points a radius apart by two steps

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_list())
                for g in range(GRIDS):
                    steps = np.floor(x / side + g / GRIDS).astype(np.int64)
                    yield b.assign(cell=list(np.column_stack([np.full(len(x), g), steps])))

    rows = points.select("node", "x", "weight").mapInPandas(keyed, "node long, x array<double>, weight long, cell array<long>")
    rows = materialize(points.sparkSession, rows, "density-rows")
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("at", F.monotonically_increasing_id())
    cells = materialize(points.sparkSession, cells, "density-cells")
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = rows.join(cells, "cell").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    return materialize(points.sparkSession, rows, "density-celled"), cells


def _around(cells: DataFrame) -> DataFrame:
    """(at, other): each cell of the first grid with itself and its neighbours
    that hold points."""

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for cell, at in zip(b["cell"], b["at"]):
                moves = np.array(list(product((-1, 0, 1), repeat=len(cell) - 1)), np.int64).reshape(-1, len(cell) - 1)
                yield pd.DataFrame({"cell": list(np.column_stack([np.zeros(len(moves), np.int64), moves + cell[1:]])), "at": at})

    first = cells.where("cell[0] = 0")
    near = first.select("cell", "at").mapInPandas(neighbours, "cell array<long>, at long")
    return near.join(first.select("cell", F.col("at").alias("other")), "cell").select("at", "other")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each group (at, block) of sorted rows."""
    held = None
    for b in batches:
        held = b if held is None else pd.concat([held, b], ignore_index=True)
        at, block = held["at"].to_numpy(), held["block"].to_numpy()
        cuts = np.flatnonzero((at[1:] != at[:-1]) | (block[1:] != block[:-1])) + 1
        for lo, hi in zip(np.append(0, cuts), cuts):
            if hi - lo > 1:
                yield held.iloc[lo:hi]
        if len(cuts):
            held = held.iloc[cuts[-1]:].reset_index(drop=True)
    if held is not None and len(held) > 1:
        yield held


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))


def _count_in_block(radius: float, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for g in _blocks(batches):
        x = np.stack(g["x"].to_list())
        w = g["weight"].to_numpy()
        near = (_distances(x, x) <= radius) @ w - w
        yield pd.DataFrame({"node": g["node"].to_numpy(), "near": near})


def _link_in_block(radius: float, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A forest of the links of each block: a point and the least that it reaches."""
    for g in _blocks(batches):
        x, node = np.stack(g["x"].to_list()), g["node"].to_numpy()
        near = _distances(x, x) <= radius
        label, left = node.copy(), np.ones(len(g), bool)
        while left.any():
            one = np.zeros(len(g), bool)
            one[left.argmax()] = True
            new = one
            while new.any():
                new = near[new].any(0) & ~one
                one = one | new
            label[one] = node[one].min()
            left &= ~one
        moved = np.flatnonzero(label != node)
        yield pd.DataFrame({"a": node[moved], "b": label[moved]})


def _met(left: DataFrame, home: DataFrame, pairs: DataFrame) -> DataFrame:
    """The points of ``left`` (node, x, at, label) dealt to the blocks of all
    cells that ``pairs`` (at, other) name, behind those blocks' own points."""
    out = ["at", "block", "side", "node", "x", "weight", "label"]
    blocks = home.groupBy(F.col("at").alias("other")).agg(F.first("blocks").alias("blocks"))
    sent = left.join(pairs, "at").drop("at").join(blocks, "other").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.withColumnRenamed("other", "at").withColumn("side", F.lit(1)).withColumn("weight", F.lit(0).cast("long"))
    there = home.join(sent.select("at").distinct(), "at", "left_semi").withColumn("side", F.lit(0))
    return there.select(*out).unionByName(sent.select(*out)).repartition("at", "block").sortWithinPartitions("at", "block", "side")


def _visits(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """(points of a block, some points sent to it), until all have been there."""
    key, held = None, []
    for b in batches:
        for k, g in b.groupby(["at", "block"], sort=False):
            if k != key:
                key, held = k, []
            own, sent = g[g["side"] == 0], g[g["side"] == 1]
            if len(own):
                held.append(own)
            if held and len(sent):
                held = [pd.concat(held)]
                size = max(1, PAIRS // len(held[0]))
                for i in range(0, len(sent), size):
                    yield held[0], sent.iloc[i:i + size]


def _count_around(radius: float, min_points: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a point sent to a block: the weight near it (b null) and, if it may
    be no core point, the points near it."""
    for own, sent in _visits(batches):
        d = _distances(np.stack(sent["x"].to_list()), np.stack(own["x"].to_list()))
        a, b = sent["node"].to_numpy(), own["node"].to_numpy()
        near = (d <= radius) & (a[:, None] != b[None])
        total = near @ own["weight"].to_numpy()
        there = np.flatnonzero(total)
        yield pd.DataFrame({"a": a[there], "b": pd.array([None] * len(there), "Int64"), "distance": np.nan, "near": total[there]})
        p, q = np.nonzero(near & (total < min_points)[:, None])
        yield pd.DataFrame({"a": a[p], "b": pd.array(b[q], "Int64"), "distance": d[p, q], "near": 0})


def _link_around(radius: float, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labels of points that are near each other."""
    for own, sent in _visits(batches):
        a, b = sent["label"].to_numpy(), own["label"].to_numpy()
        other = a[:, None] != b[None]
        if other.any():
            p, q = np.nonzero(other & (_distances(np.stack(sent["x"].to_list()), np.stack(own["x"].to_list())) <= radius))
            if len(p):
                yield pd.DataFrame({"a": a[p], "b": b[q]}).drop_duplicates()


def _merged(named: DataFrame, home: DataFrame, around: DataFrame, radius: float) -> DataFrame:
    """``named`` (node, component) with the components joined that have points
    near each other."""
    spark = named.sparkSession
    core = materialize(spark, home.join(named.withColumnRenamed("component", "label"), "node"), "density-labelled")
    most = core.groupBy("label").count().orderBy(F.desc("count"), "label").first()
    if most is None:
        return named
    labels = core.groupBy("at").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    there = labels.select(F.col("at").alias("other"), F.col("lo").alias("lo_other"), F.col("hi").alias("hi_other"))
    pairs = around.join(labels, "at").join(there, "other").where("least(lo, lo_other) <> greatest(hi, hi_other)")
    # One of two points of different labels isn't of the commonest one.
    left = core.where(F.col("label") != most["label"]).select("node", "x", "at", "label")
    links = _met(left, core, pairs.select("at", "other")).mapInPandas(partial(_link_around, radius), "a long, b long").distinct()
    links = materialize(spark, links, "density-touching")
    if links.isEmpty():
        return named
    joined = connected_components(links, "density-joined").withColumnRenamed("component", "to")
    return named.join(joined.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))


def _by_cells(points: DataFrame, radius: float, min_points: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(named, nearest): the core points' (node, component), and each border
    point's (a, n: distance and node of its core point)."""
    spark = points.sparkSession
    rows, cells = _celled(points, radius, block)
    home = rows.where("cell[0] = 0").select("node", "x", "weight", "at", "block", "blocks", F.lit(0).cast("long").alias("label"))
    around = materialize(spark, _around(cells), "density-around")
    by_block = lambda d: d.repartition("at", "block").sortWithinPartitions("at", "block")
    dealt = rows.where("n > 1").select("at", "block", "node", "x", "weight")
    some = by_block(dealt).mapInPandas(partial(_count_in_block, radius), "node long, near long").groupBy("node").agg(F.max("near").alias("near"))
    sure = points.join(some, "node", "left").select("node", (F.col("weight") + F.coalesce("near", F.lit(0)) >= min_points).alias("core"))
    sure = materialize(spark, sure, "density-sure")
    open_ = home.join(sure.where("NOT core"), "node").select("node", "x", "at", "label")
    found = _met(open_, home, around).mapInPandas(partial(_count_around, radius, min_points), "a long, b long, distance double, near long")
    found = materialize(spark, found, "density-near")
    whole = found.where("b IS NULL").groupBy("a").agg(F.sum("near").alias("near"))
    late = points.join(whole, F.col("node") == F.col("a")).where(F.col("weight") + F.col("near") >= min_points)
    cores = materialize(spark, sure.where("core").select("node").unionByName(late.select("node")), "density-core")
    links = by_block(dealt.join(cores, "node", "left_semi")).mapInPandas(partial(_link_in_block, radius), "a long, b long")
    each = cores.select(F.col("node").alias("a"), F.col("node").alias("b"))
    named = _merged(connected_components(links.unionByName(each), "density-components"), home.drop("label"), around, radius)
    border = found.where("b IS NOT NULL").join(cores.withColumnRenamed("node", "b"), "b", "left_semi").join(cores.withColumnRenamed("node", "a"), "a", "left_anti")
    return named, border.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("n"))


def _by_bands(points: DataFrame, radius: float, min_points: int, recall: float, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """As ``_by_cells``, for vectors of any length."""
    spark = points.sparkSession
    dealt = _dealt(points, radius, bands_for(recall), block, seed)
    by_group = lambda d: d.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    counted = by_group(dealt).mapInPandas(partial(_count, radius), "node long, near long").groupBy("node").agg(F.sum("near").alias("near"))
    state = points.join(counted, "node", "left").select("node", (F.col("weight") + F.coalesce("near", F.lit(0)) >= min_points).alias("core"))
    state = materialize(spark, state, "density-core")
    found = by_group(dealt.join(state, "node")).mapInPandas(partial(_link, radius), "a long, b long, distance double")
    found = materialize(spark, found, "density-links")
    links = found.where("distance IS NULL").select("a", "b")
    cores = state.where("core").select("node")
    named = connected_components(links.unionByName(cores.select(F.col("node").alias("a"), F.col("node").alias("b"))), "density-components")
    return named, found.where("distance IS NOT NULL").groupBy("a").agg(F.min(F.struct("distance", "b")).alias("n"))


def density_clusters(df: DataFrame, vec_col: str, key: str, radius: float, min_points: int, recall: float = RECALL,
                     block: int = BLOCK, seed: int = 42) -> DataFrame:
    """(key, cluster, core, distance): ``cluster`` is the number of one of its
    vectors, null for noise; ``distance`` is that of a point that is no core
    point to its nearest core point."""
    rows = df.select(F.col(key).alias("_key"), F.col(vec_col).cast("array<double>").alias("x"))
    points = _points(rows)
    dims = points.agg(F.max(F.size("x"))).first()[0] or 0
    if dims <= GRID_DIMS:
        named, nearest = _by_cells(points, radius, min_points, block)
    else:
        named, nearest = _by_bands(points, radius, min_points, recall, block, seed)
    edge = nearest.select("a", F.col("n.distance").alias("distance"), F.col("n.b").alias("b")).join(named, F.col("b") == F.col("node")) \
        .select(F.col("a").alias("node"), "component", F.lit(False).alias("core"), "distance")
    of = named.select("node", "component", F.lit(True).alias("core"), F.lit(None).cast("double").alias("distance")).unionByName(edge)
    placed = points.select("node", "x").join(of, "node").select("x", F.col("component").alias("cluster"), "core", "distance")
    out = rows.join(placed, "x", "left")
    return out.select(F.col("_key").alias(key), "cluster", F.coalesce("core", F.lit(False)).alias("core"), "distance")
