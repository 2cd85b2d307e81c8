"""WARC archives: writing, reading back, and revisit resolution.

Archives are written by Spark's text writer with the record end
``CR LF CR LF`` as its line separator: a row is a record, files are committed
by the job, and any store that Spark writes to will do. A file takes as many
records as come to about ``archive_bytes``. Archives are read back as whole
compressed files, unpacked piece by piece and framed by Content-Length, so
payloads may hold anything and a task holds one record of plain bytes at a time.

Revisit resolution works on headers alone: they are shuffled by payload
digest and length, the smallest id of a group becomes the response, and the
others become revisits that name it. A group's response is found by an
aggregate, which combines in each task first, and a payload with over a
thousandth of all records is joined by broadcast, so it is no hot spot. Payloads are never shuffled by digest.

Defined results: a null payload is empty; a null id is written as an empty
record id and ranks last; rows that repeat (same id, same payload) are one
response and revisits to it; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm.common import fresh_path, join_hot, materialize

END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, page_id long, record_type string, target string, payload_digest string, payload_bytes long, refers_to string, payload binary"
HEADERS = RECORD.removesuffix(", payload binary")

ARCHIVE_BYTES = 1 << 28


def _digests(rows: DataFrame) -> DataFrame:
    """id, url, payload and its length and base32 SHA-1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(digest=[base64.b32encode(hashlib.sha1(x).digest()).decode() for x in b["payload"]])

    return rows.mapInPandas(run, "_uid long, page_id long, url string, payload binary, digest string")


def record_id(page_id: Column, uid: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), uid.cast("string"), F.lit(">"))


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """_uid, record_type and the response's page_id and _uid for revisits, from
    _uid, page_id, digest, payload_bytes. Payloads under ``least_bytes`` are
    always responses."""
    rank = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id"), F.col("_uid"))
    able = headers.filter(F.col("payload_bytes") >= least_bytes)
    groups = able.groupBy("digest").agg(F.min(rank).alias("_first"), F.count(F.lit(1)).alias("_n"))
    groups = materialize(groups, "warc-groups")
    small = headers.filter(F.col("payload_bytes") < least_bytes)
    # A payload that a third of all records have is joined without gathering them.
    joined = join_hot(able, groups, "digest", "_n").unionByName(small, allowMissingColumns=True)
    revisit = F.col("_first").isNotNull() & (F.col("_first._uid") != F.col("_uid"))
    return joined.select("_uid", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("_first.page_id")).alias("refers_page"), F.when(revisit, F.col("_first._uid")).alias("refers_uid"))


def _record(payload: Column) -> Column:
    """A record without its end: headers, blank line, payload unless revisit."""
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    body = F.when(revisit, F.lit("")).otherwise(payload.cast("string"))
    length = F.when(revisit, F.lit(0)).otherwise(F.octet_length(payload)).cast("string")
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("_uid"))),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.col("url"))).otherwise(""),
        line("WARC-Date", F.col("date")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)),
                                 line("WARC-Refers-To", record_id(F.col("refers_page"), F.col("refers_uid"))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", length), F.lit("\r\n"), body)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", files: int | None = None, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One record a row, deduplicated by payload, as gzipped archives in ``path``."""
    url = F.regexp_replace(F.col(url_col).cast("string"), "[\\r\\n]", "%0A")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"),
                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload")) \
        .withColumn("_uid", F.monotonically_increasing_id()).select("_uid", "page_id", "url", "payload")
    found = materialize(_digests(rows), "warc-payloads")
    types = resolve(found.select("_uid", "page_id", "digest", F.octet_length("payload").cast("long").alias("payload_bytes")), least_bytes)
    full = found.join(types, "_uid").withColumn("date", F.lit(date))
    if files:
        full = full.repartition(files)
    mean = found.agg(F.avg(F.octet_length("payload"))).first()[0] or 0
    records = max(1, int(archive_bytes / (mean + 512)))
    (full.select(_record(F.col("payload")).alias("value")).write.option("lineSep", END).option("compression", "gzip")
         .option("maxRecordsPerFile", records).text(path))


def _plain(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The plain bytes of an archive, gzipped (in one or many members) or not,
    piece by piece."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    z, at = zlib.decompressobj(31), 0
    while at < len(data):
        yield z.decompress(data[at : at + step])
        at += step
        while z.eof and (z.unused_data or at < len(data)):
            rest, z = z.unused_data, zlib.decompressobj(31)
            if not rest:
                break
            yield z.decompress(rest)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    held, end, done = bytearray(), END.encode(), 0
    for piece in itertools.chain(_plain(data), [None]):
        if piece is not None:
            held += piece
        at = 0
        while True:
            stop = held.find(end, at)
            if stop < 0:
                break
            lines = bytes(held[at:stop]).decode("utf-8", "surrogateescape").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no record at byte {done + at}: {quote(lines[0][:40])}")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            last = stop + 4 + int(headers["content-length"])
            if len(held) < last + 4:
                break
            if held[last : last + 4] != end:
                raise ValueError(f"record not closed at byte {done + last}")
            yield headers, bytes(held[stop + 4 : last])
            at = last + 4
        done += at
        del held[:at]
    if held:
        raise ValueError(f"record not closed at byte {done + len(held)}")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of all archives in ``path``; digest and length are of
    the block that was read. Without ``payloads`` only headers leave the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in (RECORD if payloads else HEADERS).split(", ")]
        for b in batches:
            for data in b["content"]:
                rows = []
                for h, block in parse(bytes(data)):
                    page = h["warc-record-id"].split(":")[2]
                    revisit = h["warc-type"] == "revisit"
                    rows.append((h["warc-record-id"], int(page) if page else None, h["warc-type"], h.get("warc-target-uri"),
                                 h["warc-payload-digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(block).digest()).decode(),
                                 None if revisit else len(block), h.get("warc-refers-to"), None if revisit else block)[: len(names)])
                out = pd.DataFrame(rows, columns=names)
                for c in ("page_id", "payload_bytes"):
                    out[c] = out[c].astype("Int64")
                yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(run, RECORD if payloads else HEADERS)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records
    that were read back: revisits are joined to the response they name, and
    take its length; their digests must agree."""
    r = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("_page"),
                                                          F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    revisits = records.filter("record_type = 'revisit'").join(r, "refers_to", "left")
    same = F.when(F.col("payload_digest") == F.col("_digest"), F.col("_bytes")).otherwise(
        F.raise_error(F.concat(F.lit("no response with this payload: "), F.col("refers_to"))))
    # Responses need no join, so a page with many revisits is the only hot key,
    # and its build side is a single row.
    return (records.filter("record_type = 'response'")
            .select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
            .unionByName(revisits.select("page_id", same.cast("long").alias("payload_bytes"), "payload_digest", "record_type",
                                         F.col("_page").alias("refers_to"))))


def round_trip(pages: DataFrame, least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write the archives, read them back and resolve the revisits."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(pages, path, least_bytes)
    return resolved(materialize(read_archives(spark, path, payloads=False), "warc-headers"))
