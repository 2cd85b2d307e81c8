"""Helpers shared by the operators: tables, shared storage, words, hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the separators of words in every contract of this package.
SPACES = b"\t\n\x0b\x0c\r "
#: Bytes with A-Z lowered (every other byte is itself).
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_SHARED: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local master may go without the setting: it then gets a folder of
    its own. On a cluster a missing setting is an error, since executors
    would write to their own disks.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _SHARED:
        _SHARED[app] = tempfile.mkdtemp(prefix="textpulse-llm-")
    return _SHARED[app]


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the
    lineage, and the rows outlive the executors that made them."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


HOT_KEYS = 1000


def join_hot(rows: DataFrame, one: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` joined with ``one``, which has a row for each key and, in ``n``,
    the number of rows with it. Keys with over 1 / ``HOT_KEYS`` of all rows,
    fewer than ``HOT_KEYS`` therefore, are broadcast; so no task gathers the rows
    of a hot key. Both frames should be written tables."""
    total = one.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HOT_KEYS > total
    few = one.filter(hot).drop(n)
    keys = [r[0] for r in few.select(key).collect()]  # fewer than HOT_KEYS
    apart = F.coalesce(F.col(key).isin(keys), F.lit(False))
    common = rows.filter(apart).join(F.broadcast(few), key)
    return rows.filter(~apart).join(one.filter(~hot).drop(n), key).unionByName(common)


def remainder(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


# -- words as 64-bit hashes, vectorised -------------------------------------

_BASE = 0x9E3779B97F4A7C15  # odd, so every power has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        both = []
        for b in (_BASE, _INVERSE):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes as an array and the [start, end) of each run without white space."""
    a = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate(([True], _IS_SPACE[a], [True])).astype(np.int8))
    return a, np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def span_hashes(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each [start, end) of bytes, mixed with its
    length; equal words have equal hashes wherever they stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(a) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * up[: len(a)], dtype=np.uint64)))
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[str], chunk: int = 1 << 20, endings: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts (A-Z lowered), and for each text the
    place of its first word, with one more for the end. Texts are worked
    through in groups of about ``chunk`` bytes, so memory follows the longest
    text, not the batch. ``endings`` gets each word's last two bytes as a
    number."""
    out, counts, group, size = [], [], [], 0

    def flush() -> None:
        nonlocal group, size
        if group:
            data = b" ".join(group).translate(LOWER)
            a, s, e = word_spans(data)
            out.append(span_hashes(a, s, e))
            if endings is not None:
                endings.append(np.where(e - s > 1, a[np.maximum(e - 2, 0)], 0).astype(np.uint16) << 8 | a[e - 1] if len(e) else np.zeros(0, np.uint16))
            ends = np.cumsum([len(g) + 1 for g in group])
            upto = np.searchsorted(s, ends)
            counts.extend(np.diff(np.concatenate(([0], upto))).tolist())
            group, size = [], 0

    for t in texts:
        b = t.encode("utf-8", "surrogatepass")
        group.append(b)
        size += len(b)
        if size >= chunk:
            flush()
    flush()
    offsets = np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int64)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), offsets
