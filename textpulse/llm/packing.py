"""Best-fit packing of token sequences, certified by lower bounds.

Every document becomes its token ids and an end id; documents longer than a
sequence are cut into whole sequences, the first piece taking what is left
over. Pieces are dealt to partitions of bounded size and packed there by
best-fit decreasing. Dual feasible functions give each partition a lower
bound of its bins; as many bins certify it. Partitions with a gap hand over the
pieces of all their unfilled bins, certified ones those of their emptiest (a
bound is rounded up, so that bin may be one too many over all); they are dealt
anew among fewer partitions and packed again. Rounds end when nothing is left,
or when a round within one partition, or without gain, shows that exchange has
no more to give; a round never makes the packing worse.

With an order (a mix, say) partitions are ranges of consecutive documents, and
each round joins neighbouring ranges into wider ones, so that a sequence holds
documents from one stretch of the order; sequences are then numbered by the
mean place of their pieces. Without one, pieces are dealt by hash.

Only lengths and ids move between partitions, never texts.

Defined results: null or empty text is the end id alone; null ids are packed
like others; rows that repeat are each packed; an empty table packs to an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.llm.common import materialize, span_hashes, text_of
from textpulse.operators.numbering import number_rows

SEQUENCE = 2048
END_ID = 0
GROUP_PIECES = 65536
CACHE_WORDS = 600_000
CHUNK_CHARS = 3_000_000

ORDERED_PIECES = 4096

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
CUT = PIECES + ", _at long"
PACKED = CUT + ", _uid long, sequence_id long, offset long, _gap long"



@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


#: White space that is neither a blank nor a line end.
_OTHER_SPACE = re.compile("[\x09\x0b-\x0d\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


_KIND = np.zeros(256, np.uint8)  # 1: ASCII letter, 2: ASCII mark
_KIND[[c for c in range(33, 127) if chr(c).isalpha()]] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = 2


#: Byte-level models write each byte as a visible character: printable Latin-1
#: as it is, the other bytes, in order, from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_VISIBLE = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTED)}
_LETTERS_TO = "\u0250"  # letters before it are the same in every Unicode version


class Encoder:
    """Token ids of whole texts, each distinct word tokenized once.

    The tokenizer splits a text before a blank or line end that stands alone
    between two visible characters, and no token spans that place. So a text
    whose white space is all of that kind is the sequence of its words, each
    with the white space before it; other texts, and those that hold an added
    token's content, are tokenized as they are.
    Words are told apart by 64-bit hashes; the memory of words is bounded."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.tok, self.most = _tokenizer(path), cache_words
        self.seen: dict[int, bytes] = {}
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([_OTHER_SPACE.pattern, *map(re.escape, added)]))
        self.marks = dict(zip(" \n", self.encode([" ", "\n"])))

    def words(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that ``_words`` has cut. A word of letters, with the
        blank before it, is one piece for the byte-pair model."""
        out, rest, model, marks = [b""] * len(parts), [], self.tok.model, self.marks
        for i, p in enumerate(parts):
            lead, core = (p[0], p[1:]) if p[:1] in marks else ("", p)
            if core.isalpha() and (core.isascii() or max(core) < _LETTERS_TO):
                seen = core if core.isascii() else core.encode().decode("latin-1").translate(_VISIBLE)
                out[i] = array("I", [t.id for t in model.tokenize(_VISIBLE[32] + seen if lead == " " else seen)]).tobytes()
                if lead == "\n":
                    out[i] = marks[lead] + out[i]
            else:
                rest.append(i)
        for i, x in zip(rest, self.encode([parts[i] for i in rest]) if rest else ()):
            out[i] = x
        return out

    def encode(self, parts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tok.encode_batch_fast(parts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        plain, out = [], [b""] * len(texts)
        for i, t in enumerate(texts):
            if self.whole.search(t):
                out[i] = self.encode([t])[0]
            elif t:
                plain.append(i)
        group, size = [], 0
        for i in plain:
            group.append(i)
            size += len(texts[i])
            if size >= CHUNK_CHARS:
                self._words(texts, group, out)
                group, size = [], 0
        if group:
            self._words(texts, group, out)
        return out

    def _words(self, texts: list[str], group: list[int], out: list[bytes]) -> None:
        docs = [texts[i].encode("utf-8", "surrogatepass") for i in group]
        data = b"\n" + b"\n".join(docs) + b"\n"
        first = np.cumsum([1] + [len(d) + 1 for d in docs])  # where each text begins; one more for the end
        a = np.frombuffer(data, np.uint8)
        space = (a == 32) | (a == 10)
        # White space beside white space (a text's edges count as such): not words alone.
        odd = np.zeros(len(docs) + 1, bool)
        beside = np.flatnonzero(space[1:] & space[:-1])
        odd[np.searchsorted(first, beside, "right") - 1] = True
        odd[np.searchsorted(first, beside + 1, "right") - 1] = True
        # A part begins at a single white space, at a text's first letter, and
        # where ASCII letters and ASCII marks (no apostrophe) meet.
        kind = _KIND[a]
        cuts = np.zeros(len(a) + 1, bool)
        cuts[1:-1] = (kind[1:] + kind[:-1]) == 3
        cuts[:-1] |= space
        cuts[first] = True
        cuts[np.concatenate(([0], first[1:] - 1))] = False  # the line ends between texts are no one's
        begin = np.flatnonzero(cuts)
        begin, end = begin[:-1], np.minimum(begin[1:], first[np.minimum(np.searchsorted(first, begin[:-1], "right"), len(docs))] - 1)
        word0 = np.searchsorted(begin, first)
        keys, one, at = np.unique(span_hashes(a, begin, end), return_index=True, return_inverse=True)
        known = [self.seen.get(k) for k in keys.tolist()]
        new = [j for j, x in enumerate(known) if x is None]
        if new:
            made = self.words([data[begin[one[j]] : end[one[j]]].decode("utf-8", "surrogatepass") for j in new])
            if len(self.seen) + len(new) > self.most:  # keep what this batch used, rare words go first
                self.seen = {int(keys[j]): x for j, x in enumerate(known) if x is not None}
            for j, x in zip(new, made):
                known[j] = self.seen[int(keys[j])] = x
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        pool, at0 = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes
        n = sizes[at]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = pool[np.repeat(at0[at] - upto[:-1], n) + np.arange(upto[-1])]
        for k, i in enumerate(group):
            out[i] = self.encode([texts[i]])[0] if odd[k] else ids[upto[word0[k]] : upto[word0[k + 1]]].tobytes()


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One for each Python worker, so that its words serve all its tasks."""
    return Encoder(path)


def cut(ids: bytes, sequence: int = SEQUENCE) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of each piece of a document."""
    n = len(ids) // 4
    first = n - (n - 1) // sequence * sequence if n else 0
    bounds = [0, first, *range(first + sequence, n + 1, sequence)] if n else []
    return [(k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(bounds, bounds[1:]))]


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, order_col: str | None = None) -> DataFrame:
    """One row per piece of each document; ``_at`` is the document's
    ``order_col``, its place from 0 on (null without one)."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(tokenizer)
        for b in batches:
            rows = [(d, *p, at) for d, at, ids in zip(b["doc_id"], b["_at"], enc.ids(b["text"].tolist())) for p in cut(ids + end, sequence)]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "_at"])
            out["doc_id"], out["_at"] = out["doc_id"].astype("Int64"), out["_at"].astype("Int64")
            yield out

    at = F.col(order_col).cast("long") if order_col else F.lit(None).cast("long")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), at.alias("_at"))
    return src.mapInPandas(run, CUT)


# -- lower bounds -------------------------------------------------------------

def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The best of a family of dual feasible functions: no packing into bins of
    ``size`` has fewer bins. For each threshold t: lengths over size - t count as
    a whole bin, lengths under t as nothing, the others as their share; and for
    each k the rounding function that gives floor((k + 1) x / size) / k."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1)
    best = -(-int((n * x).sum()) // size)
    upto, weight = np.cumsum(n), np.cumsum(n * x)
    t = np.arange(1, size // 2 + 1)
    whole = upto[size] - upto[size - t]
    middle = weight[size - t] - weight[t - 1]
    best = max(best, int((whole + -(-middle // size)).max()))
    for k in range(1, 64):
        scaled = (k + 1) * x
        f = np.where(scaled % size == 0, x * k, (scaled // size) * size)  # times k * size
        best = max(best, -(-int((n * f).sum()) // (k * size)))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each piece, and each bin's fill.

    Open bins are kept by the room they have; a bit set of rooms finds the
    smallest that holds the next piece."""
    order = np.argsort(-lengths, kind="stable")
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, fill = 0, []
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = size, len(fill)
            fill.append(0)
        place[i], offset[i] = b, fill[b]
        fill[b] += n
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return place, offset, np.array(fill, np.int64)


def _pack_groups(rows: DataFrame, round_no: int, sequence: int) -> DataFrame:
    """Pack each _group; pieces whose _gap isn't 0 are for exchange. Where the
    group came with a packing that is no worse, that one stays."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        lengths = g["length"].to_numpy(np.int64)
        place, offset, fill = best_fit(lengths, sequence)
        bins, least = len(fill), lower_bound(lengths, sequence)
        before = g["sequence_id"].nunique() if round_no else bins + 1
        if before <= bins:
            bins, filled = before, g.groupby("sequence_id")["length"].transform("sum").to_numpy()
        else:
            g = g.assign(sequence_id=(round_no << 56) + (int(key[0]) << 24) + place, offset=offset)
            filled = fill[place]
        # Full bins are done. Of a certified group only the emptiest bin goes
        # on, as its bound was rounded up; of others, every bin with room.
        on = filled < sequence
        if bins == least and on.any():
            on = g["sequence_id"].to_numpy() == g["sequence_id"].to_numpy()[np.argmin(filled)]
        return g.assign(_gap=np.where(on, 1 + bins - least, 0))[PACKED_COLS]

    return rows.groupBy("_group").applyInPandas(run, PACKED)


PACKED_COLS = [c.split()[0] for c in PACKED.split(", ")]


def pack(found: DataFrame, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES, ordered: bool = False) -> DataFrame:
    """Pieces (see ``pieces``) with sequence_id and offset. ``ordered``: by their
    ``_at``, and sequences numbered 0, 1, 2, ... along it."""
    rows = found.withColumn("_uid", F.monotonically_increasing_id()) \
        .withColumn("sequence_id", F.lit(None).cast("long")).withColumn("offset", F.lit(None).cast("long"))
    rows = materialize(rows, "pack-pieces")
    n, last = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("_at"), F.lit(0))).first()
    settled, round_no, before, groups = [], 0, None, -(-n // group_pieces)
    width = -(-(last + 1) // max(groups, 1))  # places in a range
    while n:
        if ordered:
            group = F.floor(F.coalesce("_at", F.lit(0)) / width).cast("long")
            groups = last // width + 1
        else:
            # Pieces that share a bin stay together, so a kept packing stays whole.
            key = F.xxhash64(F.lit(round_no), F.col("sequence_id") if round_no else F.col("_uid"))
            groups = -(-n // group_pieces)
            group = F.pmod(key, F.lit(groups))
        packed = materialize(_pack_groups(rows.withColumn("_group", group), round_no, sequence), "pack-round")
        bins, left, n = packed.agg(F.count_distinct("sequence_id"), F.count_distinct(F.when(F.col("_gap") > 0, F.col("sequence_id"))),
                                   F.count(F.when(F.col("_gap") > 0, 1))).first()
        stuck = groups == 1 or (round_no and bins >= before and not ordered)
        settled.append(packed if stuck else packed.filter("_gap = 0"))
        if stuck:
            break
        rows, before, round_no = packed.filter("_gap > 0").drop("_gap"), left, round_no + 1
        # Whole ranges are joined, so a bin's pieces stay in one.
        width *= max(2, group_pieces * groups // max(n, 1))
    names = [c.split()[0] for c in PIECES.split(", ")] + ["sequence_id", "offset"]
    if not settled:
        return rows.select(*names)
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return _numbered(out).select(*names) if ordered else out.select(*names)


def _numbered(packed: DataFrame) -> DataFrame:
    """Sequences numbered by the mean place of their pieces' documents."""
    place = packed.groupBy("sequence_id").agg(F.avg("_at").alias("_mean"), F.min("_uid").alias("_least"))
    numbers = number_rows(place, [F.col("_mean"), F.col("_least")], "_number", "pack-numbers").select("sequence_id", "_number")
    return packed.join(numbers, "sequence_id").withColumn("sequence_id", F.col("_number"))


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE,
                   end_id: int = END_ID, group_pieces: int | None = None, order_col: str | None = None) -> DataFrame:
    """The packing of ``docs``; with ``order_col`` (whole places from 0 on)
    along that order, in ranges of ``ORDERED_PIECES`` pieces."""
    found = pieces(docs, tokenizer or default_tokenizer(), sequence, end_id, order_col)
    return pack(found, sequence, group_pieces or (ORDERED_PIECES if order_col else GROUP_PIECES), order_col is not None)
