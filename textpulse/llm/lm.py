"""Gated recurrent language model: counts, training and scoring.

Vocabulary. Words and their counts are gathered from all training texts. The
``HEAD`` most frequent words have output vectors of their own, in classes of
``CLASS_WORDS``; every other word belongs to one of ``TAILS`` classes by its
last two bytes, known or not.

Model. A gated recurrent unit reads a document word by word. The output is
factored: a softmax over the classes, then, in a head class, a softmax over
its words; in a tail class the word's share of the class by smoothed counts,
with one more share for words that were never seen. The factors of all words
add up to one. Biases begin at the logarithms of the counts, so an untrained
model is a unigram model.

Training. Truncated backpropagation over windows of ``WINDOW`` words, in
numpy, with the state carried from window to window. The training documents
are dealt over ``ROUNDS`` rounds by hash, so each is trained on in one of them,
whole. A round trains one replica for about ``REPLICA_DOCS`` of its documents
and averages the replicas by their number of words. Texts are cut into tokens
twice, for the counts and for a written table of each document's input numbers,
which training and scoring read.

Scoring. All documents, whole, in lanes that carry the state from the first
word to the end. Counts of frequent words are looked up in a table of bounded
size; the other words of a document are joined with the counts.

Defined results: null or empty texts are the end alone; a null id counts as
the empty string where the held-out part is chosen; rows that repeat are each
counted and scored; without training words every factor is its smoothed
default; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.llm.common import materialize, mix64, remainder, text_of, word_hashes

HELD_OUT, HELD_OUT_IS = 5, 1
HIDDEN = 32
CLASS_WORDS = 64
HEAD = 2048
TAILS = 96
HEADS = HEAD // CLASS_WORDS
CLASSES = HEADS + TAILS
START = HEAD + TAILS     # the input before a document's first word
WINDOW = 12
ROUNDS = 3
REPLICA_DOCS = 4000
KNOWN_WORDS = 100_000    # counts that each task holds
LANES = 256
TRAIN_LANES = 256
GROUP_WORDS = 600_000
RATE = 0.01
CHUNK = 8192             # weights a row when replicas are averaged

END = int(mix64(np.array([0xE0F], np.uint64)).view(np.int64)[0])
_TAIL_OF = (mix64(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(TAILS)).astype(np.int32)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (signed) and tail classes of all tokens, an end after each text,
    and where each text begins, with one more for the end."""
    ends: list[np.ndarray] = []
    h, off = word_hashes(texts, endings=ends)
    tail = _TAIL_OF[np.concatenate(ends)] if ends else np.zeros(0, np.int32)
    n = len(texts)
    return (np.insert(h.view(np.int64), off[1:], END), np.insert(tail, off[1:], 0), off + np.arange(n + 1))


# -- counts -------------------------------------------------------------------

def counts(docs: DataFrame) -> DataFrame:
    """(h, tail, c): every distinct token of the training texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 1000):
                h, tail, _ = tokens(b["text"].iloc[i : i + 1000].tolist())
                u, at, c = np.unique(h, return_index=True, return_counts=True)
                yield pd.DataFrame({"h": u, "tail": tail[at], "c": c})

    found = docs.select("text").mapInPandas(run, "h long, tail int, c long")
    return materialize(found.groupBy("h").agg(F.min("tail").alias("tail"), F.sum("c").alias("c")), "lm-counts")


def vocabulary(counted: DataFrame) -> dict:
    """What each task needs to know of the counts, of bounded size: totals,
    head words, counts of the most frequent words, totals of tail classes."""
    n, v = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # The least count at which no more than KNOWN_WORDS words are left.
    step = F.floor(F.log2("c") * 8).cast("int")
    least, room = None, KNOWN_WORDS
    for r in sorted(counted.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).collect(), reverse=True):
        room -= r["n"]
        if room < 0:
            break
        least = r["c"]
    known = counted.filter(F.col("c") >= least).toPandas() if least is not None else pd.DataFrame({"h": [], "tail": [], "c": []})
    known = known.sort_values(["c", "h"], ascending=[False, True])
    head = known[known["h"] != END].head(HEAD - 1)
    ends = known.loc[known["h"] == END, "c"].sum() if least is not None else 0
    if v and not ends:
        ends = (counted.filter(F.col("h") == END).agg(F.sum("c")).first()[0]) or 0
    head_h = np.concatenate(([END], head["h"].to_numpy(np.int64)))
    head_c = np.concatenate(([ends], head["c"].to_numpy(np.int64))).astype(float)
    # The end is always known, be it with count 0: it has an output of its own.
    known = pd.concat([known[known["h"] != END], pd.DataFrame({"h": [END], "tail": [0], "c": [int(ends)]})]).sort_values("h")
    totals, kinds = np.zeros(TAILS), np.zeros(TAILS)
    for r in counted.groupBy("tail").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        totals[r["tail"]], kinds[r["tail"]] = r["c"], r["v"]
    np.subtract.at(totals, head["tail"].to_numpy(int), head["c"].to_numpy(float))
    np.subtract.at(kinds, head["tail"].to_numpy(int), 1.0)
    totals[0] -= ends  # the end was counted with tail 0
    kinds[0] -= 1 if ends else 0
    order = np.argsort(head_h)
    return {"n": int(n), "v": int(v), "head": head_h[order], "head_id": order.astype(np.int32), "head_c": head_c,
            "known": known["h"].to_numpy(np.int64), "known_c": known["c"].to_numpy(np.int64), "tail_c": totals, "tail_v": kinds,
            "tail_norm": np.log10(totals + 0.5 * (kinds + 1.0))}


def _find(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted table, and whether each value is there."""
    if not len(table):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return at, table[at] == h


def symbols(vocab: dict, h: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Input number of each token: its place in the head, or HEAD + its tail class."""
    at, there = _find(vocab["head"], h)
    return np.where(there, vocab["head_id"][at], HEAD + tail).astype(np.int32)


# -- the model ----------------------------------------------------------------

SHAPES = {"x": (HEAD + TAILS + 1, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,),
          "wo": (HEADS, HIDDEN, CLASS_WORDS), "bo": (HEADS, CLASS_WORDS)}


def initial(vocab: dict) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(5)
    w = {k: (rng.standard_normal(s) * (0.1 if k == "x" else 0.3 / np.sqrt(HIDDEN))).astype(np.float32) for k, s in SHAPES.items()}
    w["b"][:] = 0
    head = np.zeros(HEAD)
    head[: len(vocab["head_c"])] = vocab["head_c"] + 0.5
    words = head.reshape(HEADS, CLASS_WORDS)
    w["bo"][:] = np.log(np.maximum(words, 1e-6)) - np.log(np.maximum(words.sum(1, keepdims=True), 1e-6))
    classes = np.concatenate((words.sum(1), vocab["tail_c"] + 0.5 * (vocab["tail_v"] + 1.0)))
    w["bc"][:] = np.log(np.maximum(classes, 1e-6) / max(classes.sum(), 1e-6))
    w["wc"] *= 0.1
    w["wo"] *= 0.1
    return w


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES])


def unflat(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = v[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def _room(n: int, kind: np.dtype) -> tuple:
    """What ``_step`` fills for ``n`` rows: see there."""
    return tuple(np.empty((n, c * HIDDEN), kind) for c in (1, 2, 1, 3))


def _step(w: dict, gates: np.ndarray, h: np.ndarray, room: tuple | None = None) -> tuple:
    """One step from the state ``h``; ``gates`` are the rows of its inputs with
    the biases added. (new state, update and reset gate, candidate, the gates'
    part from the state)."""
    k = HIDDEN
    new, zr, n, a = room or _room(len(h), h.dtype)
    np.matmul(h, w["u"], out=a)
    np.add(gates[:, : 2 * k], a[:, : 2 * k], out=zr)
    np.negative(zr, out=zr)
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    np.multiply(zr[:, k:], a[:, 2 * k :], out=n)
    n += gates[:, 2 * k :]
    np.tanh(n, out=n)
    np.subtract(h, n, out=new)
    new *= zr[:, :k]
    new += n
    return new, zr, n, a


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    logits = logits - logits.max(1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True))


FAR = 80.0  # float32 holds the exponential of anything nearer to 0, and its sums


def _are_near(weights: np.ndarray, biases: np.ndarray) -> bool:
    """Whether no state gives logits far from 0. A state is in -1 to 1."""
    return float((np.abs(weights).sum(-2) + np.abs(biases)).max()) < FAR - 1


def _picked(logits: np.ndarray, pick: np.ndarray, near: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The picked column of each row's log softmax, and each row's sum of the
    exponentials, which take the place of ``logits``. Rows are shifted by their
    greatest only where some logit is far from 0; ``near``: none is."""
    if not near and len(logits) and (logits.max() > FAR or logits.min() < -FAR):
        logits -= logits.max(1, keepdims=True)
    chosen = logits[np.arange(len(logits)), pick]
    np.exp(logits, out=logits)
    total = logits.sum(1)
    return chosen - np.log(total), total


def _loss_and_slope(logits: np.ndarray, pick: np.ndarray, scale: np.floating, near: bool = False) -> tuple[float, np.ndarray]:
    """Minus the sum of the picked log softmax, and the slope of its mean over
    1 / ``scale`` rows by the logits, which are used up."""
    chosen, total = _picked(logits, pick, near)
    logits *= (scale / total)[:, None]
    logits[np.arange(len(logits)), pick] -= scale
    return -float(chosen.sum()), logits


class HeadRows:
    """The rows whose word is in the head, class after class."""

    def __init__(self, sym: np.ndarray):
        rows = np.flatnonzero(sym < HEAD)
        cls = sym[rows] // CLASS_WORDS
        order = np.argsort(cls.astype(np.int16), kind="stable")
        self.rows, n = rows[order], np.bincount(cls, minlength=HEADS)
        self.word = sym[self.rows] % CLASS_WORDS
        ends = np.cumsum(n)
        self.parts = [(c, i, j) for c, (i, j) in enumerate(zip((ends - n).tolist(), ends.tolist())) if j > i]

    def logits(self, w: dict, states: np.ndarray) -> np.ndarray:
        """Of the words of each row's class; ``states`` are the rows' own."""
        out = np.empty((len(self.rows), CLASS_WORDS), states.dtype)
        for c, i, j in self.parts:
            np.matmul(states[i:j], w["wo"][c], out=out[i:j])
            out[i:j] += w["bo"][c]
        return out


def class_of(sym: np.ndarray) -> np.ndarray:
    return np.where(sym < HEAD, sym // CLASS_WORDS, sym - HEAD + HEADS)


class Lanes:
    """Documents laid end to end in lanes, longest lane first; step t of the
    first ``active(t)`` lanes is a row of tokens."""

    def __init__(self, sym: np.ndarray, off: np.ndarray, lanes: int):
        sizes = np.diff(off)
        heap = [(0, i) for i in range(max(1, min(lanes, len(sizes))))]
        own: list[list[int]] = [[] for _ in heap]
        for d in np.argsort(-sizes, kind="stable").tolist():
            n, i = heapq.heappop(heap)
            own[i].append(d)
            heapq.heappush(heap, (n + int(sizes[d]), i))
        own.sort(key=lambda ds: -sum(int(sizes[d]) for d in ds))
        docs = np.array([d for ds in own for d in ds], np.int64)
        n = sizes[docs]
        self.source = np.repeat(off[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())  # lane order -> token
        self.sym = sym[self.source]
        self.first = np.zeros(len(self.sym), bool)
        self.first[np.cumsum(n) - n] = True
        self.input = np.concatenate(([START], self.sym[:-1])).astype(np.int32)
        self.input[self.first] = START
        self.length = np.array([sizes[ds].sum() for ds in own])
        self.start = np.cumsum(self.length) - self.length

    def windows(self, size: int) -> Iterator[list[np.ndarray]]:
        """For each window, the tokens' places of each step."""
        t, most, shorter = 0, int(self.length[0]) if len(self.length) else 0, -self.length
        while t < most:
            steps = range(t, min(t + size, most))
            yield [self.start[:n] + s for s, n in zip(steps, np.searchsorted(shorter, [-s for s in steps], "left").tolist())]
            t += size


def _any(first: np.ndarray, steps: list[np.ndarray]) -> list[bool]:
    """Whether a document begins in each step."""
    return np.logical_or.reduceat(first, np.cumsum([0, *map(len, steps[:-1])])).tolist()


def log_probabilities(w: dict, sym: np.ndarray, off: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """Natural log of the class, and in head classes of the word, for each
    token; the state runs through each whole document."""
    ln, k, kind = Lanes(sym, off, lanes), HIDDEN, w["u"].dtype
    out = np.zeros(len(sym))
    h, rooms = np.zeros((len(ln.length), k), kind), [_room(len(ln.length), kind) for _ in range(2)]
    inputs, near = w["x"] + w["b"], (_are_near(w["wc"], w["bc"]), _are_near(w["wo"], w["bo"]))
    for steps in ln.windows(WINDOW):
        at, i = np.concatenate(steps), 0
        gates, first, hs = np.take(inputs, ln.input[at], axis=0), ln.first[at], np.empty((len(at), k), kind)
        for n, new in zip(map(len, steps), _any(first, steps)):
            h = h[:n]
            if new:
                h[first[i : i + n]] = 0
            rooms.reverse()  # the state before is in the other one
            h = _step(w, gates[i : i + n], h, tuple(x[:n] for x in rooms[0]))[0]
            hs[i : i + n] = h
            i += n
        s = ln.sym[at]
        logits = hs @ w["wc"]
        logits += w["bc"]
        p = _picked(logits, class_of(s), near[0])[0]
        head = HeadRows(s)
        p[head.rows] += _picked(head.logits(w, hs[head.rows]), head.word, near[1])[0]
        out[ln.source[at]] = p
    return out


def _gradients(w: dict, ln: Lanes, steps: list[np.ndarray], h: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Truncated backpropagation through one window from the state ``h``.

    The input rows' gradient is sparse: ``g["x"]`` is (rows, their gradients).
    The window's tokens lie in flat arrays, step after step, so that only what
    depends on the step before runs step by step."""
    k, at = HIDDEN, np.concatenate(steps)
    n, x, first, kind = len(at), ln.input[at], ln.first[at], w["u"].dtype
    cuts = np.cumsum([0, *map(len, steps)]).tolist()
    gates = np.take(w["x"], x, axis=0)
    gates += w["b"]
    h0, room, begins = np.empty((n, k), kind), _room(n, kind), _any(first, steps)
    for i, j, new in zip(cuts, cuts[1:], begins):
        h0[i:j] = h[: j - i]
        if new:
            h0[i:j][first[i:j]] = 0
        h = _step(w, gates[i:j], h0[i:j], tuple(x[i:j] for x in room))[0]
    hs, zr, cand, a = room
    an = a[:, 2 * k :]
    s = ln.sym[at]
    g = {}
    scale = kind.type(1.0 / n)
    logits = hs @ w["wc"]
    logits += w["bc"]
    loss, d = _loss_and_slope(logits, class_of(s), scale, _are_near(w["wc"], w["bc"]))
    g["wc"], g["bc"], dh = hs.T @ d, d.sum(0), d @ w["wc"].T
    g["wo"], g["bo"] = np.zeros_like(w["wo"]), np.zeros_like(w["bo"])
    head = HeadRows(s)
    own = hs[head.rows]
    more, d = _loss_and_slope(head.logits(w, own), head.word, scale)
    back = np.empty_like(own)
    for c, i, j in head.parts:
        np.matmul(own[i:j].T, d[i:j], out=g["wo"][c])
        g["bo"][c] = d[i:j].sum(0)
        np.matmul(d[i:j], w["wo"][c].T, out=back[i:j])
    dh[head.rows] += back
    loss += more
    # Slopes of each step's state by its candidate and gates, for all steps at once.
    z, r = zr[:, :k].copy(), zr[:, k:].copy()
    by_cand = (1 - z) * (1 - cand * cand)
    by_z = (h0 - cand) * z * (1 - z)
    by_r = an * r * (1 - r)
    da, after, ut = np.empty((n, 3 * k), kind), np.zeros((0, k), kind), np.ascontiguousarray(w["u"].T)
    dcand = np.empty((n, k), kind)
    for i, j, begin in zip(cuts[-2::-1], cuts[:0:-1], begins[::-1]):
        new, part, dn = dh[i:j], da[i:j], dcand[i:j]
        new[: len(after)] += after
        np.multiply(new, by_cand[i:j], out=dn)
        np.multiply(new, by_z[i:j], out=part[:, :k])
        np.multiply(dn, by_r[i:j], out=part[:, k : 2 * k])
        np.multiply(dn, r[i:j], out=part[:, 2 * k :])
        after = part @ ut
        after += new * z[i:j]
        if begin:
            after[first[i:j]] = 0
    g["u"] = h0.T @ da
    da[:, 2 * k :] = dcand
    order = np.argsort(x.astype(np.int16), kind="stable")
    own = x[order]
    begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    g["x"] = own[begin], np.add.reduceat(np.take(da, order, axis=0), begin, axis=0)
    g["b"] = da.sum(0)
    return g, h, loss


def train(w: dict, sym: np.ndarray, off: np.ndarray, rate: float = RATE) -> dict:
    """One pass over the documents with Adam; of the input rows only those that
    a window has met take a step."""
    longest = int(np.diff(off).max()) if len(off) > 1 else 1
    lanes = int(np.clip(len(sym) // max(longest, WINDOW * 100), 4, TRAIN_LANES))  # lanes of like length
    ln = Lanes(sym, off, lanes)
    w = {k: v.copy() for k, v in w.items()}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    h, t = np.zeros((len(ln.length), HIDDEN), np.float32), 0
    for steps in ln.windows(WINDOW):
        g, h, _ = _gradients(w, ln, steps, h)
        t += 1
        at, g["x"] = g["x"]
        norm = np.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
        clip = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
        step = np.float32(rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t))
        for k, x in g.items():
            if clip < 1:
                x *= clip
            first, second = (np.take(m[k], at, axis=0), np.take(v[k], at, axis=0)) if k == "x" else (m[k], v[k])
            first *= np.float32(0.9)
            first += np.float32(0.1) * x
            x *= x
            second *= np.float32(0.99)
            second += np.float32(0.01) * x
            np.sqrt(second, out=x)
            x += np.float32(1e-6)
            np.divide(first, x, out=x)
            x *= step
            if k == "x":
                m[k][at], v[k][at] = first, second
                w[k][at] = np.subtract(np.take(w[k], at, axis=0), x, out=x)
            else:
                w[k] -= x
    return w


# -- documents as numbers -------------------------------------------------------

CODED = "doc_id long, n_tokens long, found long, base double, tails double, rest array<long>, sym binary"


def coded(docs: DataFrame, vocab: dict) -> DataFrame:
    """Each document's input numbers (``sym``, 16 bits a token) and what of its
    scores needs no network: tokens, those of the count table that occur in
    training, the logarithms of their smoothed counts (``base``), those of
    tokens in tail classes within their class (``tails``), and the tokens that
    are not in the table (``rest``). Texts are read and cut into tokens here
    once; training and scoring read the numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # What a word of the count table has: its logarithm, and its place in the head (-1: none).
        logs = np.log10(vocab["known_c"] + 0.5)
        place, there = _find(vocab["head"], vocab["known"])
        head = np.where(there, vocab["head_id"][place], -1).astype(np.int32)
        whole = bool(np.isin(vocab["head"], vocab["known"]).all())
        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.iloc[i : i + 1000]
                h, tail, off = tokens(part["text"].tolist())
                at, there = _find(vocab["known"], h)
                if whole:
                    sym = np.where(there, head[at], -1)
                    sym = np.where(sym < 0, HEAD + tail, sym)
                else:
                    sym = symbols(vocab, h, tail)
                smooth = np.where(there, logs[at], 0.0)
                met = there & (vocab["known_c"][at] > 0)
                is_tail = sym >= HEAD
                tails = np.where(is_tail, smooth - vocab["tail_norm"][np.where(is_tail, sym - HEAD, 0)], 0.0)
                per = lambda x: np.add.reduceat(x, off[:-1])  # noqa: E731  each document has a token
                cuts = np.cumsum(per((~there).astype(np.int64)))[:-1]
                raw = sym.astype("<u2")
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").reset_index(drop=True), "n_tokens": np.diff(off), "found": per(met.astype(np.int64)),
                                    "base": per(smooth), "tails": per(tails), "rest": np.split(h[~there], cuts),
                                    "sym": [raw[s:e].tobytes() for s, e in zip(off[:-1].tolist(), off[1:].tolist())]})

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    bucket = F.pmod(F.xxhash64("doc_id", F.xxhash64("sym")), F.lit(ROUNDS))
    held = remainder("doc_id", HELD_OUT) == HELD_OUT_IS
    out = src.mapInPandas(run, CODED).withColumns({"_uid": F.monotonically_increasing_id(), "round": F.when(~held, bucket)})
    return materialize(out, "lm-coded")


def _groups(syms: list[bytes], size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Documents i to j, of about ``size`` tokens: (i, j, tokens, where each
    document begins, with one more for the end)."""
    i = 0
    while i < len(syms):
        j, n = i, 0
        while j < len(syms) and (n == 0 or n < 2 * size):
            n += len(syms[j])
            j += 1
        yield i, j, np.frombuffer(b"".join(syms[i:j]), "<u2").astype(np.int32), np.concatenate(([0], np.cumsum([len(x) // 2 for x in syms[i:j]])))
        i = j


def fit(numbers: DataFrame, vocab: dict) -> tuple[dict, int]:
    """Rounds of replicas trained in tasks and averaged by Spark; the driver
    holds one set of weights. With them, the number of words trained on.
    ``numbers`` has each document's ``sym`` and its round (null: held out)."""
    w, trained = initial(vocab), 0
    total = sum(int(np.prod(s)) for s in SHAPES.values())
    sizes = {r["round"]: r["n"] for r in numbers.groupBy("round").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each round
    for r in range(ROUNDS):
        if not sizes.get(r):
            continue
        now = flat(w)

        def run(batches: Iterator[pd.DataFrame], now=now, r=r) -> Iterator[pd.DataFrame]:
            own, words = unflat(now), 0
            for b in batches:
                for _, _, s, off in _groups(b["sym"].tolist(), 4 * GROUP_WORDS):
                    own = train(own, s, off, RATE / (1 + r))
                    words += len(s)
            if words:
                v = flat(own)
                yield pd.DataFrame({"i": range(-(-total // CHUNK)), "n": float(words), "v": [v[i : i + CHUNK] for i in range(0, total, CHUNK)]})

        part = numbers.filter(F.col("round") == r).select("sym").coalesce(max(1, -(-sizes[r] // REPLICA_DOCS)))
        rows = part.mapInPandas(run, "i int, n double, v array<float>").withColumn("x", array_to_vector(F.col("v").cast("array<double>")))
        mean = rows.groupBy("i").agg(Summarizer.mean(F.col("x"), F.col("n")).alias("m"), F.sum("n").alias("n")).select("i", vector_to_array("m").alias("m"), "n").collect()
        if mean:
            trained += int(mean[0]["n"])
            w = unflat(np.concatenate([x["m"] for x in sorted(mean, key=lambda x: x["i"])]))
    return w, trained


SCORED = "doc_id long, n_tokens long, found long, base double, neural double, _uid long"


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    held = remainder("doc_id", HELD_OUT) == HELD_OUT_IS
    counted = counts(rows.filter(~held))
    vocab = vocabulary(counted)
    numbers = coded(rows, vocab)
    weights = flat(fit(numbers, vocab)[0])
    norm = float(np.log10(vocab["n"] + 0.5 * (vocab["v"] + 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = unflat(weights)
        for b in batches:
            b = b.iloc[b["n_tokens"].argsort(kind="stable")].reset_index(drop=True)  # lanes of like length
            for i, j, sym, off in _groups(b["sym"].tolist(), GROUP_WORDS):
                p = np.add.reduceat(log_probabilities(w, sym, off), off[:-1]) / np.log(10)
                part = b.iloc[i:j]
                yield part.drop(columns=["sym", "tails"]).assign(doc_id=part["doc_id"].astype("Int64"), neural=p + part["tails"])[[c.split()[0] for c in SCORED.split(", ")]]

    narrow = numbers.select("doc_id", "n_tokens", "found", "base", "tails", "_uid", "sym")
    scored = materialize(narrow.mapInPandas(run, SCORED), "lm-scored")
    rare = numbers.select("_uid", F.explode("rest").alias("h"))
    c = F.coalesce(F.col("c"), F.lit(0))
    added = (rare.join(counted.select("h", "c"), "h", "left").groupBy("_uid")
             .agg(F.sum(F.log10(c + 0.5)).alias("more"), F.count(F.when(c > 0, 1)).alias("seen")))
    out = scored.join(added, "_uid", "left")
    more, seen = F.coalesce("more", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", (F.col("found") + seen).alias("n_known"),
                      F.lit(vocab["n"]).cast("long").alias("train_tokens"),
                      (F.col("base") + more - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("neural") + more).alias("score"))
