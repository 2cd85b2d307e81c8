"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has a bit for each of 64 places: one if the hashes of
more than half of its word shingles have it. Fingerprints within ``RADIUS`` = 3
differing bits are linked.

Two fingerprints with at most three differing bits meet in the middle: some
value lies at most two bits from one and at most one bit from the other. Not
all values within two bits are needed. Call the 32 upper and 32 lower bits
halves; one half holds at most one of the differing bits. So it is enough that
each fingerprint emits, for each half kept as it is, all variants of the other
half within two bits; and, for each zero of the half, the value with that bit
alone set. Of two linked fingerprints whose half differs in a bit, the one with
the zero sets it and the other changes up to two bits in the rest; where the
half is equal, both change the rest.

The shuffle key is the half of the variant. All variants with one half travel
as one row, about 34 rows for each distinct fingerprint, and a task spells out
the whole variants of the rows it has got, as many at a time as its memory
takes. Halves that over a thousandth of all fingerprints share, fewer than 2000
therefore, are dealt out over tasks by the whole variant instead, so no such
group is gathered.

Colliding fingerprints are not paired: among those with one variant, any that
changed at most one bit is within three bits of every other one. One such is the
centre; each other is linked to it and the link is verified. Two that both
changed two bits, if they are linked, meet elsewhere, one with one change.
Links give components, and each document takes its fingerprint's.

Defined results: null, empty and blank texts have fingerprint zero and are
linked like any other; a null id ranks after all ids; rows that repeat have one
fingerprint and each give a row; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.llm.common import LOWER, join_hot, materialize, mix64, text_of, word_spans
from textpulse.llm.minhash import components

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
HOT_HALVES = 1000        # a half with over 1 / HOT_HALVES of the prints is hot
LEAST_HOT = 256          # and has more than so many
VARIANTS = 1 << 18       # that a task holds

_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
_ALL = np.uint64(0xFFFFFFFF)
_I, _J = np.triu_indices(32, 1)
#: Changes of at most two bits of the lower half, and how many bits each changes.
_LOW = np.concatenate((np.zeros(1, np.uint64), _BIT[:32], _BIT[_I] | _BIT[_J]))
_CHANGED = np.concatenate(([0], np.ones(32, int), np.full(len(_I), 2)))


def fingerprint(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text (A-Z lowered)."""
    data = b" ".join(text.encode("utf-8", "surrogatepass").translate(LOWER).split())
    if not data:
        return 0
    _, start, end = word_spans(data)
    if len(start) > words:
        ones, total = np.zeros(64, np.int64), len(start) - words + 1
        spans = zip(start[:total].tolist(), end[words - 1 :].tolist())
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(data[s:e], seed) for s, e in spans), np.uint64, total)
        for i in range(0, total, 1 << 16):
            ones += np.unpackbits(h[i : i + (1 << 16), None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        return int(_BIT[2 * ones > total].sum(dtype=np.uint64))
    return xxhash.xxh64_intdigest(data, seed)


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, print): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t.as_py(), words, seed) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, print long")


# -- variants -------------------------------------------------------------------

def _halves(prints: DataFrame) -> DataFrame:
    """(side, half, print): the upper half is side 0."""
    p = F.col("print")
    return prints.select(p, F.posexplode(F.array(F.shiftrightunsigned(p, 32), p.bitwiseAND(0xFFFFFFFF))).alias("side", "half"))


def _keys_of(half: Column) -> Column:
    """The half, and the half with one of its zeros set."""
    zeros = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)),
                     lambda bit: half.bitwiseAND(bit) == 0)
    return F.concat(F.array(half), F.transform(zeros, lambda bit: half.bitwiseOR(bit)))


def emitted(prints: DataFrame) -> DataFrame:
    """(key, print) for each half of each distinct print; ``key`` is the
    variant's half and its side."""
    return _keyed(_halves(prints)).select("key", "print")


def _keyed(halves: DataFrame) -> DataFrame:
    return halves.withColumn("key", F.explode(_keys_of(F.col("half")))).withColumn("key", F.col("key") + F.shiftleft(F.col("side").cast("long"), 32))


def hot_keys(prints: DataFrame, hot_halves: int = HOT_HALVES, least_hot: int = LEAST_HOT) -> DataFrame:
    """(key): keys to which a hot half sends rows, at most 33 for each of
    fewer than 2 * ``hot_halves`` halves."""
    counted = _halves(prints).groupBy("side", "half").agg(F.count(F.lit(1)).alias("n"))
    total = prints.count()
    hot = counted.filter((F.col("n") > least_hot) & (F.col("n") * hot_halves > total))
    return _keyed(hot).select("key").distinct()


def _spelt(key: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole variants of rows: (variant, bits changed, row). The upper half of
    a variant is its key's half; prints of side 1 have their halves swapped."""
    swapped = np.where(key >> 32 == 1, prints << np.uint64(32) | prints >> np.uint64(32), prints)
    change = (key.view(np.uint64) & _ALL) ^ (swapped >> np.uint64(32))
    own, one = np.flatnonzero(change == 0), np.flatnonzero(change)
    many = (swapped[own, None] ^ _LOW).ravel()
    alone = swapped[one] ^ (change[one] << np.uint64(32))
    return (np.concatenate((many, alone)), np.concatenate((np.tile(_CHANGED, len(own)), np.ones(len(one), np.int64))),
            np.concatenate((np.repeat(own, len(_LOW)), one)))


def _weights(key: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """How many variants each row stands for."""
    half = np.where(key >> 32 == 1, prints & _ALL, prints >> np.uint64(32))
    return np.where(half == key.view(np.uint64) & _ALL, len(_LOW), 1)


def _met(key: np.ndarray, prints: np.ndarray, radius: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the rows of whole keys. Their variants are spelt out in as
    many turns, by hash, as it takes to hold no more than about ``most``."""
    turns = -(-int(_weights(key, prints).sum()) // most)
    for turn in range(turns):
        parts = []
        for i in range(0, len(key), 4096):
            k, p = key[i : i + 4096], prints[i : i + 4096]
            variant, changed, row = _spelt(k, p)
            name = mix64(variant ^ (k[row] >> 32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # sides apart
            mine = name % np.uint64(turns) == turn if turns > 1 else slice(None)
            parts.append((name[mine], changed[mine], p[row[mine]]))
        yield _linked(*(np.concatenate(x) for x in zip(*parts)), radius)


def _linked(variant: np.ndarray, changed: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (print, centre) among the rows with one variant."""
    order = np.lexsort((prints, changed, variant))
    variant, changed, prints = variant[order], changed[order], prints[order]
    first = np.flatnonzero(np.concatenate(([True], variant[1:] != variant[:-1]))) if len(variant) else np.zeros(0, int)
    size = np.diff(np.append(first, len(variant)))
    centre = np.repeat(prints[first], size)
    near = np.repeat(changed[first] <= 1, size) & (centre != prints)
    a, b = prints[near], centre[near]
    close = np.bitwise_count(a ^ b) <= radius
    pairs = np.unique(np.stack((np.minimum(a, b)[close], np.maximum(a, b)[close]), 1), axis=0) if close.any() else np.zeros((0, 2), np.uint64)
    return pairs[:, 0], pairs[:, 1]


def links(prints: DataFrame, radius: int = RADIUS, hot_halves: int = HOT_HALVES, least_hot: int = LEAST_HOT, variants: int = VARIANTS) -> DataFrame:
    """Links (a, b) that join all distinct ``prints`` within ``radius`` bits."""
    rows = emitted(prints)
    hot = materialize(hot_keys(prints, hot_halves, least_hot), "simhash-hot")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by key: whole keys at a time."""
        keys, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in itertools.chain(batches, [None]):
            if b is not None:
                keys, prints = np.concatenate((keys, b["key"].to_numpy(np.int64))), np.concatenate((prints, b["print"].to_numpy(np.int64).view(np.uint64)))
            upto = len(keys) if b is None else int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if upto:
                _, n = np.unique(keys[:upto], return_counts=True)
                meeting = np.repeat(n > 1, n)  # keys with one print are done
                k, p = keys[:upto][meeting], prints[:upto][meeting]
                keys, prints = keys[upto:], prints[upto:]
                # Parts of whole keys, of about as many variants as are held at a time.
                starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, int)
                before = (np.cumsum(_weights(k, p)) // variants)[starts - 1] if len(k) else starts
                cuts = np.append(starts[np.concatenate(([True], np.diff(before[1:], prepend=0) > 0))], len(k)) if len(k) else starts
                for i, j in zip(cuts, cuts[1:]):
                    for x, y in _met(k[i:j], p[i:j], radius, variants):
                        yield pd.DataFrame({"a": x.view(np.int64), "b": y.view(np.int64)})

    few = rows.join(F.broadcast(hot), "key", "left_anti")
    found = few.repartition("key").sortWithinPartitions("key").mapInPandas(near, "a long, b long")

    # Hot halves: the whole variant is the shuffle's key.
    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 1024):
                key, p = (b[c].iloc[i : i + 1024].to_numpy(np.int64) for c in ("key", "print"))
                variant, changed, row = _spelt(key, p.view(np.uint64))
                yield pd.DataFrame({"variant": variant.view(np.int64), "side": (key[row] >> 32).astype(np.int32),
                                    "changed": changed.astype(np.int32), "print": p[row]})

    met = rows.join(F.broadcast(hot), "key", "left_semi").mapInPandas(spell, "variant long, side int, changed int, print long")
    met = materialize(met, "simhash-spelt")
    centre = met.groupBy("variant", "side").agg(F.min(F.struct("changed", "print")).alias("c"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND c.changed <= 1")
    pairs = met.join(centre, ["variant", "side"]).select(F.col("print").alias("a"), F.col("c.print").alias("b")).filter("a <> b")
    pairs = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return found.unionByName(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def near_groups(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = materialize(fingerprints(docs, words, seed), "simhash-prints")
    # One row for each distinct print, with its number of rows and least id.
    prints = materialize(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    labels = components(materialize(links(prints.select("print"), radius), "simhash-links"), "simhash-labels")
    named = prints.join(labels, prints["print"] == labels["node"], "left").select("print", "n", "least", F.coalesce("label", "print").alias("label"))
    of_label = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_print = materialize(named.join(of_label, "label").select("print", "n", "component_id"), "simhash-components")
    out = join_hot(rows, of_print, "print", "n")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
