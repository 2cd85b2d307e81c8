"""Importance resampling towards a target distribution.

Features are the hashed runs of one and two words. Their counts over all
source rows and all target rows give each bucket a gain, the logarithm of how
much likelier the target is; a text's weight is the mean gain of its features.
The draw takes the rows of the greatest weight plus Gumbel noise, which is a
draw without replacement in proportion to the exponential of the weights.

The text work is Arrow kernels inside tasks: ``ascii_lower``,
``split_pattern_regex`` and ``list_flatten`` give the words of a batch,
``dictionary_encode`` numbers them. Indices shifted by one place form the word
pairs; a CRC is computed once for each distinct word and each distinct pair,
and ``take`` spreads its bucket (or the bucket's gain) over the occurrences,
which are summed by text.

Spark sums the bucket counts of the tasks (``buckets`` rows at most, which the
driver holds), and ranks in two steps: the count of each score, a whole number,
gives the score below which no row is drawn; the rows above it are sorted by
range over all tasks, and a row's rank is its place in its partition after the
sizes of the partitions before.

Defined results: null and empty texts have no words, no features and weight 0;
a null id counts as the empty string in the noise and ranks after all ids;
rows that repeat are drawn each for itself; empty tables give an empty table
(an empty target gives every bucket its smoothed count); extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.llm.common import materialize, text_of

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SCALE = 1000
SEED = 7
CHUNK_BYTES = 4 << 20

#: What parts words: ASCII that is neither a digit nor a lower-case letter.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; for each feature its text and its bucket."""
    words = pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATORS)
    text = pc.list_parent_indices(words)
    flat = pc.list_flatten(words)
    real = pc.not_equal(flat, "")  # a text that begins or ends with a separator
    flat, text = flat.filter(real), text.filter(real).to_numpy()
    coded = flat.dictionary_encode()
    index, spelt = coded.indices.to_numpy(), [w.encode("utf-8", "surrogatepass") for w in coded.dictionary.to_pylist()]
    single = pa.array([zlib.crc32(w) % buckets for w in spelt], pa.int64())
    ahead = [zlib.crc32(b" ", zlib.crc32(w)) for w in spelt]  # a pair's CRC goes on from here
    same = text[1:] == text[:-1]
    code = index[:-1][same].astype(np.int64) * len(spelt) + index[1:][same]
    pairs, where = np.unique(code, return_inverse=True)
    left, right = np.divmod(pairs, max(len(spelt), 1))
    double = pa.array([zlib.crc32(spelt[b], ahead[a]) % buckets for a, b in zip(left.tolist(), right.tolist())], pa.int64())
    found = np.concatenate((single.take(coded.indices).to_numpy(), double.take(pa.array(where)).to_numpy()))
    return np.bincount(text, minlength=len(texts)), np.concatenate((text, text[1:][same])), found


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``CHUNK_BYTES`` of text (or one text)."""
    if batch.num_rows:
        size = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // CHUNK_BYTES)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            yield batch.slice(i, j - i)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features in each bucket that has one, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for part in _chunks(b, 0):
                n += np.bincount(features(part.column(0), buckets)[2], minlength=buckets)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(n[there])], names=["bucket", "n"])

    return docs.select(text_of().alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS, scale: int = SCALE) -> np.ndarray:
    """Each bucket's gain, a whole number of ``scale`` parts of a nat."""
    both = np.zeros((2, buckets), np.int64)
    counted = bucket_counts(source, buckets).withColumn("of", F.lit(0)).unionByName(bucket_counts(target, buckets).withColumn("of", F.lit(1)))
    for r in counted.collect():  # two rows a bucket
        both[r["of"], r["bucket"]] = r["n"]
    s, t = both.astype(float)
    return np.floor(scale * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


WEIGHED = "doc_id long, n_words long, n_features long, weight long"


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """Words, features and weight (the floored mean gain) of each text."""
    buckets, table = len(gain), gain.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.array(np.frombuffer(table, np.int64))
        for b in batches:
            for part in _chunks(b, 1):
                words, text, found = features(part.column(1), buckets)
                n = np.bincount(text, minlength=part.num_rows)
                order = np.argsort(text, kind="stable")
                each = of.take(pa.array(found[order])).to_numpy()
                total = np.zeros(part.num_rows, np.int64)
                if len(each):
                    total[n > 0] = np.add.reduceat(each, (np.cumsum(n) - n)[n > 0])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)],
                                                 names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, WEIGHED)


def ranked(scored: DataFrame, n: int) -> DataFrame:
    """(_uid, rank) of the ``n`` rows with the greatest score; ties go to the
    smaller doc_id, then to the smaller _uid."""
    by_score = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("score"))
    least, above = None, 0
    for r in by_score.toLocalIterator():  # a row for each score, a whole number
        if above >= n:
            break
        least, above = r["score"], above + r["n"]
    if least is None:
        return scored.select("_uid", F.lit(None).cast("long").alias("rank")).limit(0)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_uid")]
    # A global sort: its partitions are ranges, and the id counts rows in each.
    place = materialize(scored.filter(F.col("score") >= least).select("_uid", "doc_id", "score").orderBy(*order)
                        .select("_uid", F.monotonically_increasing_id().alias("_at")), "resample-sorted")
    part, within = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = place.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before, at = {}, 0
    for r in sizes.orderBy("_part").collect():  # a row for each partition
        before[r["_part"]], at = at, at + r["_n"]
    offset = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv])
    rank = F.element_at(offset, F.shiftright("_at", 33)) + within + 1
    return place.select("_uid", rank.cast("long").alias("rank")).filter(F.col("rank") <= n)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_features, weight, score and, if drawn, rank."""
    gain = gains(docs, target, buckets)
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-float(SCALE)) * F.log(-F.log((draw + 0.5) / 4294967296.0)))
    scored = materialize(weigh(docs, gain).withColumn("score", F.col("weight") + noise).withColumn("_uid", F.monotonically_increasing_id()), "resample-scored")
    able = scored.filter(F.col("n_words") >= least_words)
    ranks = ranked(able, percent * able.count() // 100)
    return scored.join(ranks, "_uid", "left").drop("_uid")
