"""Document fingerprints: a digest of quartile-coded buckets.

Hashed byte triplets are counted in ``BUCKETS`` buckets. Triplets are taken
from a sliding window: its first byte with two of the later ones, for each
pair of distances in ``PAIRS``. (Distances are wide on purpose: close bytes
mostly tell the language, bytes further apart the document. Texts of fewer than
``SHORT`` bytes are taken with ``NEAR`` distances and zeros after their end, so
that every byte counts.) The digest holds, for each bucket,
in which quarter of the buckets' counts its count lies (two bits), and the
length on a logarithmic scale (one byte).

Two digests differ by the summed distance of the quarters (0 to 3 a bucket,
where a step of three counts twice) and by a bounded penalty for length; the
likeness is 1 at no difference and 0 at ``WORST`` or beyond.

Defined results: null text is empty; empty texts count nothing and are alike;
equal texts have equal digests; null ids come last in descending
order; rows that repeat stand side by side; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.llm.common import materialize, text_of

BUCKETS = 256
#: Distances from a window's first byte to the other two of a triplet.
PAIRS = ((5, 11), (7, 13))
CHUNK = 1 << 18
WORST_SHARE = 0.75  # of a difference of two quarters in every bucket
SHORT = 48
NEAR = ((1, 2), (1, 3), (2, 3))


def counts(data: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of hashed triplets by bucket, worked through in chunks."""
    pairs = PAIRS if len(data) >= SHORT else NEAR
    out, reach = np.zeros(buckets, np.int64), max(b for _, b in pairs)
    if 0 < len(data) < SHORT:
        data += bytes(reach)
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    for s in range(0, len(a), CHUNK):
        x = a[s : s + CHUNK + reach]
        for k, (i, j) in enumerate(pairs):
            n = min(CHUNK, len(x) - j)
            if n > 0:
                h = x[:n] | x[i : i + n] << 8 | x[j : j + n] << 16
                h = (h + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35)
                out += np.bincount(h >> np.uint32(32 - (buckets.bit_length() - 1)), minlength=buckets)
    return out


def digest(data: bytes, buckets: int = BUCKETS) -> str:
    """Hex: one byte for the length, then two bits a bucket."""
    c = counts(data, buckets)
    q = np.sort(c)[[buckets // 4 - 1, buckets // 2 - 1, 3 * buckets // 4 - 1]]
    code = (c[:, None] > q[None, :]).sum(1).astype(np.uint8).reshape(-1, 4)
    packed = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    return bytes([min(255, int(8 * np.log2(len(data) + 1)))]).hex() + packed.tobytes().hex()


_STEP = np.array([0, 1, 2, 6])
_TABLE = np.array([[sum(_STEP[abs((a >> s & 3) - (b >> s & 3))] for s in (0, 2, 4, 6)) for b in range(256)] for a in range(256)])


def difference(x: str, y: str) -> int:
    """Bucket steps plus one for each 1/8 of a doubling in length past the first, at most 24."""
    a, b = np.frombuffer(bytes.fromhex(x), np.uint8), np.frombuffer(bytes.fromhex(y), np.uint8)
    length = abs(int(a[0]) - int(b[0]))
    return int(_TABLE[a[1:], b[1:]].sum()) + min(24, max(0, length - 8))


def likeness(x: str, y: str, buckets: int = BUCKETS) -> float:
    worst = WORST_SHARE * 2 * buckets
    return max(0.0, 1.0 - difference(x, y) / worst)


def edited(text: str, following: str) -> str:
    """The last floor(n / 3) code points replaced by the first as many of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


FINGERPRINTS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                "near_edited double, near_next double")


#: 0: a finished row; 1: the first row of a partition; 2: the last.
WORKED = FINGERPRINTS + ", _part int, _kind int, _text string"


def _row(d, text: str, own: str, following: str, theirs: str, buckets: int) -> tuple:
    e = edited(text, following).encode("utf-8", "surrogatepass")
    f = digest(e, buckets)
    return (d, len(text), hashlib.sha256(e).hexdigest(), own, f, likeness(own, f, buckets), likeness(own, theirs, buckets))


def _of(text: str, buckets: int) -> str:
    return digest(text.encode("utf-8", "surrogatepass"), buckets)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def fingerprints(docs: DataFrame, buckets: int = BUCKETS, partitions: int | None = None) -> DataFrame:
    """Each document with its own fingerprint, that of its edited text, and the
    likeness to that and to the next document, in descending order of doc_id
    (after the last: the first; rows of one id by their texts' hash).

    Documents are sorted by range: Spark cuts the ranges by quantiles of (id,
    text hash, row), so neither a far id nor a repeated one fills a range, and
    every text moves once. A task streams over its range; what is left are the
    first and the last row of each range, one pair a range, which are joined by
    the range's number. ``partitions`` fixes the number of ranges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last = TaskContext.get().partitionId(), None  # (id, text, digest) that waits for its neighbour
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"]):
                now = _of(t, buckets)
                rows.append((*_row(*last, t, now, buckets), part, 0, None) if last else (d, 0, "", now, "", 0.0, 0.0, part, 1, t))
                last = (d, t, now)
            yield _frame(rows, WORKED)
        if last:
            yield _frame([(last[0], 0, "", last[2], "", 0.0, 0.0, part, 2, last[1])], WORKED)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _frame([_row(d, t, own, following, theirs, buckets) for d, t, own, following, theirs in
                          zip(b["doc_id"], b["_text"], b["fingerprint"], b["_following"], b["_theirs"])], FINGERPRINTS)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.monotonically_increasing_id().alias("_uid"))
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text"), F.col("_uid")]
    ranged = src.repartitionByRange(partitions, *order).sortWithinPartitions(*order) if partitions else src.orderBy(*order)
    worked = materialize(ranged.select("doc_id", "text").mapInPandas(run, WORKED), "fingerprints")
    names = [c.split()[0] for c in FINGERPRINTS.split(", ")]
    parts = sorted(r["_part"] for r in worked.filter("_kind = 2").select("_part").collect())  # a number for each range
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "_part int, _next int")
    first = worked.filter("_kind = 1").select(F.col("_part").alias("_next"), F.col("_text").alias("_following"), F.col("fingerprint").alias("_theirs"))
    edge = worked.filter("_kind = 2").join(after, "_part").join(first, "_next").mapInPandas(finish, FINGERPRINTS)
    return worked.filter("_kind = 0").select(*names).unionByName(edge)
