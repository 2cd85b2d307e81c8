"""Near-duplicates by min-max hashing, confirmed on whole shingle sets.

1. Each text becomes its set of word shingles, as 64-bit hashes. Under each of
   ``PERMUTATIONS`` permutations both the least and the greatest value are
   kept: two values of a signature for one hash evaluation. The ``2 *
   PERMUTATIONS`` values are cut into bands of ``ROWS``; two sets that are 0.8
   alike share no band with a chance of about 5e-6.
2. Equal sets are one node from here on, so copies cost nothing more.
3. Each band's bucket has a centre: its node whose buckets are the largest (the
   original of a group of edits shares most bands with it). All others are
   compared with the centre: as many pairs as nodes. Links are confirmed on
   the full sets, and linked nodes get one label.
4. Where a bucket still holds several labels, each node outside its largest
   label is compared with all nodes of other labels, in blocks of ``BLOCK``
   nodes by ``BLOCK``: a task counts common shingles over an index of its
   block and gives back confirmed links only, never pairs. No candidate is
   dropped; large groups of copies, which have one label by then, cost nothing.

Sets of documents that have no partner in any bucket are never moved.

Defined results: null or empty texts have the empty set, are linked with
nothing and stay; a null id ranks after all ids; rows that repeat have equal
sets, and only one of them is kept; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.llm.common import materialize, mix64, text_of, word_hashes

PERMUTATIONS = 120
ROWS = 6
PERCENT = 80
SHINGLE_WORDS = 5
ROW_CHUNK = 4096
BLOCK = 512

_A = (np.random.default_rng(7).integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = np.random.default_rng(8).integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words
    than a shingle is one shingle, one without words has none."""
    h, off = word_hashes(texts)
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        rolled = mix64(rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - words + 1 + k]) if len(rolled) else rolled
    out = []
    for s, e in zip(off[:-1].tolist(), off[1:].tolist()):
        if e - s >= words:
            out.append(np.unique(rolled[s : e - words + 1]))
        elif e > s:
            one = np.uint64(e - s)
            for x in h[s:e]:
                one = mix64(np.array([one * np.uint64(0xD6E8FEB86659FD93) ^ x]))[0]
            out.append(np.array([one]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """Minima, then maxima, under all permutations."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for i in range(0, len(x), ROW_CHUNK):
        m = x[i : i + ROW_CHUNK, None] * _A + _B
        np.minimum(low, m.min(0), out=low)
        np.maximum(high, m.max(0), out=high)
    return np.concatenate((low, high))


def bands(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    v = signatures.astype(np.uint64).reshape(len(signatures), -1, ROWS)
    key = np.broadcast_to(np.arange(1, v.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), v.shape[:2]).copy()
    for r in range(ROWS):
        key = mix64(key * np.uint64(0xFF51AFD7ED558CCD) + v[:, :, r])
    return key


SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>"


def _set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _signed(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.iloc[i : i + 1000]
                sets = shingle_sets(part["text"].tolist(), words)
                keys = bands(np.stack([signature(s) for s in sets])).view(np.int64)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(object, na_value=None), "n_shingles": [len(s) for s in sets],
                                    "set_key": [_set_key(s) for s in sets],
                                    "bands": [k if len(s) else [] for k, s in zip(keys, sets)]}).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(run, SIGNED)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the wanted (node, doc_id, set_key)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 500):
                sets = shingle_sets(b["text"].iloc[i : i + 500].tolist(), words)
                yield pd.DataFrame({"set_key": [_set_key(s) for s in sets], "shingles": [s.view(np.int64) for s in sets]})

    src = docs.select(F.col("doc_id").cast("long").alias("_id"), text_of().alias("text"))
    ids = wanted.select(F.col("doc_id").alias("_w")).distinct()
    texts = src.join(ids, F.col("_id").eqNullSafe(F.col("_w")), "left_semi").select("text")
    made = texts.mapInPandas(run, "set_key binary, shingles array<long>")
    return made.join(wanted.select("node", "set_key"), "set_key").select("node", "shingles").dropDuplicates(["node"])


def components(links: DataFrame, what: str = "labels") -> DataFrame:
    """(node, label): the least node that links (a, b) reach, for nodes with a
    link. Least labels spread along links and by pointer jumping, until none
    changes."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{what}-links")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), what)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        new = materialize(step.join(jump, F.col("label") == F.col("_n"), "left")
                          .select("node", "old", F.least("label", F.coalesce("_l", "label")).alias("label")), what)
        labels = new.select("node", "label")
        if new.filter("old <> label").isEmpty():
            return labels


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are alike enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb"))
    common = F.size(F.array_intersect("_sa", "_sb")).cast("long")
    union = F.size("_sa") + F.size("_sb") - common
    return pairs.join(left, "a").join(right, "b").filter(100 * common >= percent * union).select("a", "b")


def _across_labels(known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between nodes of one bucket and different labels;
    ``known`` has (key, node, label)."""
    per_label = known.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = (per_label.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n"),
                                          F.max(F.struct("n", "label")).alias("most"))
             .filter("labels > 1")
             .select("key", F.col("most.label").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("rows_in"),
                     F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("probes_in")))
    open_rows = known.join(mixed, "key")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = open_rows.select("key", "node", "label", block("rows_in").alias("i"), every("probes_in").alias("j"), F.lit(False).alias("probe"))
    probes = open_rows.filter("label <> main").select("key", "node", "label", every("rows_in").alias("i"), block("probes_in").alias("j"), F.lit(True).alias("probe"))

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        p, r = g[g["probe"]], g[~g["probe"]]
        a, b = [], []
        if len(p) and len(r):
            own, labels = r["node"].to_numpy(), r["label"].to_numpy()
            sizes = r["shingles"].map(len).to_numpy()
            whole = np.concatenate(r["shingles"].to_list())
            order = np.argsort(whole, kind="stable")
            owner = np.repeat(np.arange(len(r)), sizes)[order]
            values, first = np.unique(whole[order], return_index=True)
            first = np.append(first, len(whole))
            for node, label, s in zip(p["node"], p["label"], p["shingles"]):
                at = np.searchsorted(values, s)
                at = at[at < len(values)]
                at = at[np.isin(values[at], s)]
                n = first[at + 1] - first[at]
                hit = owner[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                common = np.bincount(hit, minlength=len(r))
                found = np.flatnonzero((100 * common >= percent * (sizes + len(s) - common)) & (labels != label))
                a += np.minimum(own[found], node).tolist()
                b += np.maximum(own[found], node).tolist()
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    dealt = rows.unionByName(probes).join(sets, "node")
    return dealt.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def near_groups(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept, n_links (confirmed
    links of its set to other sets that were compared)."""
    signed = materialize(_signed(docs, words).withColumn("_uid", F.monotonically_increasing_id()), "near-signed")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("_uid").alias("uid"))
    # Nodes: one for each distinct set, named by the row that ranks first.
    nodes = (signed.filter("n_shingles > 0").groupBy("set_key", "n_shingles").agg(F.min(rank).alias("r"))
             .select("set_key", "n_shingles", F.col("r.uid").alias("node"), F.col("r.doc_id").alias("doc_id")))
    nodes = materialize(nodes, "near-nodes")
    member = (signed.select("_uid", "bands").join(nodes.select("node"), F.col("_uid") == F.col("node"), "left_semi")
              .select(F.explode("bands").alias("key"), F.col("_uid").alias("node")))
    buckets = member.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    member = materialize(member.join(buckets, "key"), "near-buckets")
    popular = member.join(member.groupBy("node").agg(F.sum("size").alias("pop")), "node")
    centres = popular.groupBy("key").agg(F.max(F.struct("pop", "node"))["node"].alias("centre"))
    pairs = (member.join(centres, "key").filter("node <> centre")
             .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())

    sizes = nodes.select("node", "n_shingles")
    small, large = F.least("_na", "_nb"), F.greatest("_na", "_nb")
    fitting = (pairs.join(sizes.toDF("a", "_na"), "a").join(sizes.toDF("b", "_nb"), "b")
               .filter(100 * small >= percent * large).select("a", "b"))  # else sizes alone rule a link out
    partners = member.select("node").distinct().join(nodes, "node").select("node", "doc_id", "set_key")
    sets = materialize(_sets(docs, partners, words), "near-sets")
    links = materialize(_confirmed(fitting, sets, percent), "near-links")
    labels = components(links)

    known = member.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    more = materialize(_across_labels(known, sets, percent), "near-links")
    links = links.unionByName(more)
    # A link across labels joins all that carries them.
    name = labels.select("node", "label")
    at = lambda c: more.join(name.toDF(c, f"_{c}"), c, "left").select("a", "b", F.coalesce(f"_{c}", c).alias(f"_{c}"))
    of_labels = at("a").join(at("b"), ["a", "b"]).select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()
    merged = components(of_labels, "near-merged").toDF("label", "_merged")
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    labels = (ends.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(merged, "label", "left")
              .select("node", F.coalesce("_merged", "label").alias("label")))

    degree = (links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
              .groupBy("node").agg(F.count(F.lit(1)).alias("n_links")))
    of = nodes.select("set_key", "node").join(labels, "node", "left").join(degree, "node", "left") \
        .select("set_key", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    rows = signed.select("_uid", "doc_id", "n_shingles", "set_key")
    full = materialize(rows.filter("n_shingles > 0").join(of, "set_key").drop("set_key"), "near-rows")
    best = full.groupBy("label").agg(F.min(rank).alias("r")).select("label", F.col("r.doc_id").alias("component_id"), F.col("r.uid").alias("winner"))
    grouped = full.join(best, "label").select("doc_id", "n_shingles", "component_id", (F.col("_uid") == F.col("winner")).alias("kept"), "n_links")
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(0).cast("long").alias("n_links"))
    return grouped.unionByName(alone)


def deduplicate(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of documents that stay, with all their columns; rows that share
    an id stay or go together."""
    kept = near_groups(docs, words, percent).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    ident = F.col(f"c{docs.columns.index('doc_id')}").cast("long")
    return plain.join(kept, ident.eqNullSafe(F.col("_kept_id")), "left_semi").toDF(*docs.columns)
