"""Secret scanning with one deterministic automaton for all rules.

The rule expressions are parsed into one nondeterministic automaton that may
begin any rule at any byte. Subset construction and minimisation turn it into
an array of transitions over byte classes, and each text is scanned by that
array once, byte by byte, for all rules together. Where the automaton leaves
an accepting state, a rule's longest match ends; the same construction over
the reversed rule, run backwards from there, finds where it began.

Rules of one kind don't overlap: a match must begin at or after the end of
the match before it, and the leftmost goes first. Offsets are code points.

Defined results: null or empty text has no span; ids may be null or repeat
(each row is scanned); an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.llm.common import text_of


@dataclass(frozen=True)
class Rule:
    """``parts``: (set of bytes, least, most or None) or a tuple of word
    alternatives, in order. A match whose last part is shorter than
    ``least_value`` counts as found, so no other begins in it, and drops out.
    (A length check there keeps the automaton small: a counter in it would
    multiply its states with those of every rule that can match beside it.)"""

    kind: str
    parts: tuple
    least_value: int = 0


def _set(spec: str) -> frozenset:
    out, i = set(), 0
    while i < len(spec):
        if spec[i + 1 : i + 2] == "-" and i + 2 < len(spec):
            out |= set(range(ord(spec[i]), ord(spec[i + 2]) + 1))
            i += 3
        else:
            out.add(ord(spec[i]))
            i += 1
    return frozenset(out)


def _lit(word: str, fold: bool = False) -> tuple:
    return tuple((frozenset({ord(c.lower()), ord(c.upper())}) if fold else frozenset({ord(c)}), 1, 1) for c in word)


def _any(*words: str, fold: bool = False) -> tuple:
    return tuple(_lit(w, fold) for w in words)


_WORD = _set("A-Za-z0-9+/_.=-")
#: The base kinds come first; spans of one start are listed in this order.
BASE = (
    Rule("assign", (_any("password", "passwd", "secret", "token", "apikey", "api_key", fold=True),
                    (_set("\"'"), 0, 1), (_set(" "), 0, None), (_set(":="), 1, 1), (_set(" "), 0, None),
                    (_set("\"'"), 0, 1), (_WORD, 1, None)), 6),
    Rule("access", (*_lit("AKIA"), (_set("A-Z0-9"), 1, None)), 16),
    Rule("hex", ((_set("0-9a-f"), 24, None),)),
)
MORE = (
    Rule("github", (_any("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), (_set("A-Za-z0-9"), 1, None)), 20),
    Rule("slack", (_any("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), (_set("A-Za-z0-9-"), 1, None)), 10),
    Rule("private_key", (*_lit("-----BEGIN "), (_set("A-Z "), 0, None), *_lit("PRIVATE KEY-----"))),
)


# -- nondeterministic automaton, subset construction, minimisation ------------

class _Nfa:
    def __init__(self):
        self.steps: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []
        self.accept: dict[int, int] = {}

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def add(self, at: int, part) -> int:
        if isinstance(part[0], frozenset):
            chars, least, most = part
            for _ in range(least):
                nxt = self.state()
                self.steps[at].append((chars, nxt))
                at = nxt
            if most is None:
                loop = self.state()
                self.free[at].append(loop)
                self.steps[loop].append((chars, loop))
                return loop
            end = self.state()
            self.free[at].append(end)
            for _ in range(most - least):
                nxt = self.state()
                self.steps[at].append((chars, nxt))
                self.free[nxt].append(end)
                at = nxt
            return end
        end = self.state()  # alternatives
        for word in part:
            x = at
            for p in word:
                x = self.add(x, p)
            self.free[x].append(end)
        return end


def _reversed_part(part):
    return part if isinstance(part[0], frozenset) else tuple(tuple(reversed(w)) for w in part)


@dataclass(frozen=True)
class Automaton:
    classes: bytes            # byte -> class, for bytes.translate
    width: int                # number of classes
    table: np.ndarray         # state * width + class -> state
    accepts: tuple            # state -> rules that accept here, as a bit set


def automaton(rules: tuple[Rule, ...], anywhere: bool = True, backwards: bool = False) -> Automaton:
    """The minimal deterministic automaton of all rules together."""
    nfa = _Nfa()
    root = nfa.state()
    for i, r in enumerate(rules):
        at = nfa.state()
        nfa.free[root].append(at)
        for p in (tuple(_reversed_part(p) for p in reversed(r.parts)) if backwards else r.parts):
            at = nfa.add(at, p)
        nfa.accept[at] = nfa.accept.get(at, 0) | (1 << i)
    # Bytes that no set tells apart are one class.
    sets = list({c for s in nfa.steps for c, _ in s})
    seen: dict[tuple, int] = {}
    classes = bytes(seen.setdefault(tuple(b in s for s in sets), len(seen)) for b in range(256))
    width = len(seen)
    one = [classes.index(k) for k in range(width)]  # a byte of each class
    member = {c: [k for k in range(width) if one[k] in c] for c in sets}

    @functools.cache
    def closure(s: int) -> frozenset:
        out, todo = {s}, [s]
        while todo:
            for t in nfa.free[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)

    moves = [[(member[c], closure(t)) for c, t in s] for s in nfa.steps]
    first = closure(root)
    ids, rows, order = {first: 0}, [], [first]
    for states in order:  # grows as subsets are found
        to = [set(first) if anywhere else set() for _ in range(width)]
        for s in states:
            for ks, target in moves[s]:
                for k in ks:
                    to[k] |= target
        row = []
        for t in map(frozenset, to):
            if t not in ids:
                ids[t] = len(order)
                order.append(t)
            row.append(ids[t])
        rows.append(row)
    delta = np.array(rows, np.int64)
    bits = np.array([functools.reduce(int.__or__, (nfa.accept.get(s, 0) for s in states), 0) for states in order], np.int64)
    # Minimise: split the states by what they accept, then by the parts that
    # their transitions lead to, until nothing splits.
    part = np.unique(bits, return_inverse=True)[1]
    while True:
        _, new = np.unique(np.column_stack((part, part[delta])), axis=0, return_inverse=True)
        new = new.ravel()
        if new.max() == part.max():
            break
        part = new
    # State 0 stays the first; accepting states get the last numbers.
    n = part.max() + 1
    some = np.zeros(n, np.int64)
    some[part] = np.arange(len(part))
    rank = np.argsort(np.argsort(np.where(np.arange(n) == part[0], -1, bits[some] != 0), kind="stable"), kind="stable")
    table, accepts = np.zeros((n, width), np.int64), np.zeros(n, np.int64)
    table[rank] = rank[part[delta[some]]]
    accepts[rank] = bits[some]
    return Automaton(classes, width, table.ravel(), tuple(accepts.tolist()))


class Scanner:
    """Finds all spans of the rules in a text."""

    def __init__(self, rules: tuple[Rule, ...] = BASE + MORE):
        self.rules = rules
        a = automaton(rules)
        self.classes, self.accepts = a.classes, a.accepts
        # A state is a row of the table, as a tuple of rows' numbers times the
        # width, so that one addition and one look-up make a step.
        self.width = a.width
        self.table = (a.table * a.width).tolist()
        self.first = next((s for s, x in enumerate(a.accepts) if x), len(a.accepts)) * a.width
        self.back = [automaton((r,), anywhere=False, backwards=True) for r in rules]

    def _ends(self, data: bytes) -> list[tuple[int, int]]:
        """(rule, end) of each longest match, by end: where a rule stops accepting."""
        table, first, width, accepts = self.table, self.first, self.width, self.accepts
        s, on, out = 0, 0, []
        for i, c in enumerate(data.translate(self.classes)):
            s = table[s + c]
            if s >= first:
                now = accepts[s // width]
                if gone := on & ~now:
                    out += [(k, i) for k in range(len(self.rules)) if gone >> k & 1]
                on = now
            elif on:
                out += [(k, i) for k in range(len(self.rules)) if on >> k & 1]
                on = 0
        if on:
            out += [(k, len(data)) for k in range(len(self.rules)) if on >> k & 1]
        return out

    def _begin(self, k: int, data: bytes, end: int, least: int) -> int:
        """The leftmost start, not before ``least``, of a match of rule k that ends here; -1: none."""
        a, s, best, i = self.back[k], 0, -1, end
        dead = a.table.reshape(-1, a.width)
        while i > least:
            i -= 1
            s = int(dead[s, a.classes[data[i]]])
            if a.accepts[s]:
                best = i
            elif not a.accepts[s] and (dead[s] == s).all():
                break
        return best

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end), by start, then by kind as listed."""
        data = text.encode("utf-8", "surrogatepass")
        after, found = [0] * len(self.rules), []
        for k, end in self._ends(data):
            begin = self._begin(k, data, end, after[k])
            if begin < 0:
                continue
            after[k] = end
            r = self.rules[k]
            if r.least_value and end - self._value_at(r, data, begin, end) < r.least_value:
                continue
            found.append((begin, k, end))
        found.sort()
        if len(data) == len(text):
            return [(self.rules[k].kind, b, e) for b, k, e in found]
        point = lambda at: len(data[:at].decode("utf-8", "surrogatepass"))
        return [(self.rules[k].kind, point(b), point(e)) for b, k, e in found]

    @staticmethod
    def _value_at(rule: Rule, data: bytes, begin: int, end: int) -> int:
        """Where the last part of a match begins: the parts before it are read
        in order, each as long as it can be."""
        at = begin
        for part in rule.parts[:-1]:
            if isinstance(part[0], frozenset):
                n = 0
                while at < end and data[at] in part[0] and (part[2] is None or n < part[2]):
                    at, n = at + 1, n + 1
            else:
                at += max(len(w) for w in part if all(data[at + j : at + j + 1] and data[at + j] in c[0] for j, c in enumerate(w)))
        return at


@functools.lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = BASE + MORE) -> Scanner:
    return Scanner(rules)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in spans)


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id, counts of the base kinds, a digest of the base spans, all spans."""

    s, base = scanner(rules), [r.kind for r in BASE]  # built once, and sent with the job

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"]):
                spans = s.spans(t)
                own = [x for x in spans if x[0] in base]
                rows.append((d, *(sum(x[0] == k for x in own) for k in base), hashlib.sha256(_joined(own).encode()).hexdigest(), _joined(spans)))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCANNED.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(run, SCANNED)
