"""Main text of web pages by structure and a host suffix array.

A page is read into blocks: runs of text between block-level tags, with
character references decoded and white space made one space. A block is
*chrome* if it stands in a menu, header, footer, sidebar, notice, advert,
form, comment section, script or style; *main* if it stands in the page's
article; else it is *open*. Chrome goes, main stays. (Repetition may not
decide about them: menus differ from page to page of a host, and articles
quote each other.) If chrome holds a page's only article, the elements around
it are none, unless they are hidden.

Within an article a class, id or role whose words are all marks or parts of a
page ("reader-comments", "ad-slot") is chrome, and ids of headings, paragraphs
and inline elements say nothing. A mark among other words ("social-history",
"sponsor-quiz") makes its element a suspect, which its content decides: form
controls, two signed or dated entries, or half of its words in links make it
chrome. Without such evidence its blocks are *doubtful*.

Open and doubtful blocks are decided by repetition on their host: the word
streams of its pages are concatenated, a
suffix array over them gives all runs of at least ``LEAST_WORDS`` words that
occur on two distinct pages, covered words are boilerplate and go, and what is
unique stays. Hosts are worked through in groups of ``GROUP_PAGES`` pages, so
a host with a third of all pages is many tasks. A run that two groups of a
host share is found by the hashes of its ``LEAST_WORDS``-word windows, summed
over the groups of a host.

Defined results: null html is empty and gives the empty text; pages without
any text too; null urls share one host; null ids and repeated rows are each
extracted (rows of one id or of equal blocks are one page for repetition); an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.llm.common import materialize, mix64

LEAST_WORDS = 8
GROUP_PAGES = 256

#: Elements whose content is no text, and elements that are never the article.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "head", "object", "canvas", "math"}
CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
          "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
          "var", "wbr"}
#: Words of a class, id or role that mark chrome.
MARKS = {"ad", "ads", "advert", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "nav", "navbar", "navigation",
         "menu", "menubar", "breadcrumb", "breadcrumbs", "sidebar", "side", "aside", "complementary", "header", "masthead", "footer",
         "contentinfo", "cookie", "cookies", "consent", "notice", "gdpr", "newsletter", "subscribe", "signup", "login", "search", "form",
         "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "related", "share", "sharing", "social", "popup",
         "modal", "toolbar", "pagination", "pager", "widget"}

# A tag's attributes end at the next tag's beginning, and nothing is tried twice
# (possessive), so a page is read in time proportional to its length however
# malformed it is.
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/<>]*+)"
                  r"(?P<attrs>(?:[^<>\"']|<(?![A-Za-z/!?])|\"[^\"]*\"|'[^']*')*+)>|<[!?][^<>]*+>", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORDS = re.compile(r"[A-Za-z]+")


#: Words that make such a mark a word about the layout ("with-sidebar").
LAYOUT = {"has", "with", "without", "no", "layout"}
#: Marks that an article's own parts may carry ("entry-header").
OWN = {"header", "masthead"}


#: Words that leave such a mark whole within an article ("comment-list",
#: "reader-comments", "ad-slot"): parts of a page, places, and who writes.
PARTS_OF = {"area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "center", "column", "container", "content", "count",
            "feed", "form", "group", "holder", "icon", "icons", "inline", "inner", "item", "items", "left", "link", "links", "list", "main",
            "message", "middle", "module", "more", "outer", "panel", "place", "placeholder", "post", "posts", "right", "row", "section",
            "slot", "space", "stories", "story", "text", "this", "thread", "threads", "title", "tool", "tools", "top", "unit", "wrap",
            "wrapper", "zone", "article", "articles", "page", "pages", "reader", "readers", "user", "users", "visitor", "visitors", "guest"}
#: Elements whose ids are made from their text.
TITLED = INLINE | {"h1", "h2", "h3", "h4", "h5", "h6", "p"}
CONTROLS = {"input", "button", "select", "textarea", "form", "fieldset", "iframe"}
#: Words of a class that belong to a signed and dated entry.
SIGNED = {"author", "avatar", "byline", "date", "datetime", "posted", "timestamp", "username", "vcard"}
LINK_SHARE = 0.5

OPEN, MAIN_TEXT, DOUBTFUL = 0, 1, 2
NO, YES, HIDDEN, SUSPECT = 0, 1, 2, 3


def _is_chrome(name: str, attrs: str, main: bool) -> int:
    """NO, YES, HIDDEN (yes, and whatever is inside), or SUSPECT: within an
    article a mark stands among words of another kind ("social-history")."""
    if name in CHROME:
        return NO if main and name in OWN else HIDDEN if _HIDDEN.search(attrs) else YES
    if not attrs or name in ("html", "body"):
        return NO
    if _HIDDEN.search(attrs):
        return HIDDEN
    found = NO
    for m in _ATTR.finditer(attrs):
        if main and name in TITLED and m[1].lower() == "id":
            continue
        for token in (m[2] or m[3] or m[4] or "").lower().split():
            words = set(_WORDS.findall(token))
            if not words & (MARKS - OWN if main else MARKS) or words & LAYOUT:
                continue
            if not main or not words - MARKS - PARTS_OF:
                return YES
            found = SUSPECT
    return found if name not in TITLED else NO


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of each non-empty block in page order.

    Within an article, headers belong to it (``header`` there holds its
    title); every other chrome goes. End tags close the nearest open element
    of their name, and what was left open inside it."""
    out, around = _Reader(page, frozenset()).read()
    return _Reader(page, around).read()[0] if around else out


class _Reader:
    """One pass over a page; elements that begin at ``spared`` are no chrome.

    The stack holds (name, chrome, main, own verdict, place, counts at its
    begin). Counts of open names, overall and since the last container, say
    whether an end tag has something to close, so that a page of unmatched tags
    takes no longer than another."""

    def __init__(self, page: str, spared: frozenset[int]):
        self.page, self.spared = page, spared
        self.out: list[tuple[int, str]] = []
        self.parts: list[str] = []
        self.stack: list[tuple] = []
        self.open: Counter = Counter()
        self.inline: list[Counter] = [Counter()]
        self.hidden = self.links = 0
        # What suspects are judged by: words, words in links, controls, signs of entries.
        self.words = self.linked = self.controls = self.signed = 0
        self.chrome = self.main = self.head_seen = self.first_seen = self.outside = False
        self.around: frozenset[int] = frozenset()

    def flush(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            if text:
                self.out.append((MAIN_TEXT if self.main else OPEN, text))
            self.parts.clear()

    def text(self, raw: str) -> None:
        if self.chrome or not raw:
            return
        self.parts.append(raw)
        n = len(raw.split())
        self.words += n
        self.linked += n if self.links else 0

    def push(self, name: str, attrs: str, place: int) -> None:
        own = NO if place in self.spared else _is_chrome(name, attrs, self.main)
        self.controls += name in CONTROLS
        if self.main and not self.chrome:
            signs = {w for m in _ATTR.finditer(attrs) for w in _WORDS.findall((m[2] or m[3] or m[4] or "").lower())}
            self.signed += name == "time" or bool(signs & SIGNED)
        begin = (len(self.out), self.words, self.linked, self.controls, self.signed) if own == SUSPECT else None
        self.stack.append((name, self.chrome or own in (YES, HIDDEN), self.main or (name in MAIN and not self.chrome), own, place, begin))
        self.open[name] += 1
        self.hidden += own == HIDDEN
        self.links += name == "a"
        if name in INLINE or name == "p":
            self.inline[-1][name] += 1
        else:
            self.inline.append(Counter())
        if name in MAIN:
            self.outside = self.outside or not self.stack[-1][1]
            if not self.first_seen and not self.hidden:
                self.first_seen = True
                self.around = frozenset(x[4] for x in self.stack if x[3] in (YES, HIDDEN))

    def pop(self) -> str:
        name, _, _, own, _, begin = self.stack.pop()
        self.open[name] -= 1
        self.hidden -= own == HIDDEN
        self.links -= name == "a"
        if name in INLINE or name == "p":
            self.inline[-1][name] -= 1
        else:
            self.inline.pop()
        if begin:
            at, words, linked, controls, signed = begin
            n = self.words - words
            if self.controls > controls or self.signed - signed >= 2 or (n and (self.linked - linked) >= LINK_SHARE * n):
                del self.out[at:]
                self.doubted = min(self.doubted, at)
            else:
                for i in range(max(at, self.doubted), len(self.out)):
                    self.out[i] = (DOUBTFUL, self.out[i][1])
                self.doubted = len(self.out)
        return name

    #: Blocks before it have had their doubt; so nested suspects mark each once.
    doubted = 0

    def close(self, name: str) -> None:
        # An inline or paragraph end tag doesn't reach out of its container.
        there = self.inline[-1] if name in INLINE or name == "p" else self.open
        if there[name]:
            while self.pop() != name:
                pass

    def raw(self, name: str, at: int) -> int:
        """Where reading goes on after the begin of an element without text."""
        if name == "head":
            if self.head_seen:
                return at
            self.head_seen = True
        close = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(self.page, at)
        if name != "head":
            return close.end() if close else len(self.page)
        return close.end() if close and not re.compile(r"<body\b", re.I).search(self.page, at, close.start()) else at

    def read(self) -> tuple[list[tuple[int, str]], frozenset[int]]:
        """Blocks; and, if every article is inside chrome, where the chrome
        around the first begins."""
        page, at, length = self.page, 0, len(self.page)
        while at < length:
            m = _TAG.search(page, at)
            if m is None:
                self.text(page[at:])
                break
            self.text(page[at : m.start()])
            at = m.end()
            if m["cdata"] is not None:
                self.text(m["cdata"].replace("&", "&amp;"))
            if m["name"] is None:
                continue
            name, attrs = m["name"].lower(), m["attrs"]
            if name not in INLINE:
                self.flush()
            if m["end"]:
                self.close(name)
            elif name in RAW and not attrs.endswith("/"):
                self.controls += name in CONTROLS
                at = self.raw(name, at)
            elif name in VOID or attrs.endswith("/"):
                self.controls += name in CONTROLS
            else:
                self.push(name, attrs, m.start())
            self.chrome, self.main = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (False, False)
        self.flush()
        while self.stack:
            self.pop()
        return self.out, frozenset() if self.outside else self.around


# -- repeated runs ------------------------------------------------------------

def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling prefixes."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        nxt = np.full(n, -1, np.int64)
        nxt[: n - step] = rank[step:]
        order = np.lexsort((nxt, rank))
        r, x = rank[order], nxt[order]
        new = np.concatenate(([0], np.cumsum((r[1:] != r[:-1]) | (x[1:] != x[:-1]))))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


def common_prefixes(tokens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Words that each suffix has in common with the one before it in order."""
    n, at = len(tokens), np.empty(len(tokens), np.int64)
    at[order] = np.arange(n)
    out, k, t, place, seq = [0] * n, 0, tokens.tolist(), at.tolist(), order.tolist()
    for i in range(n):
        p = place[i]
        if not p:
            k = 0
            continue
        j = seq[p - 1]
        while i + k < n and j + k < n and t[i + k] == t[j + k]:
            k += 1
        out[p] = k
        k = max(0, k - 1)
    return np.array(out, np.int64)


def repeated(streams: list[np.ndarray], pages: list[int], least: int) -> list[np.ndarray]:
    """For each page's words, whether a run of at least ``least`` words that
    occurs on two distinct pages covers them."""
    sizes = [len(s) for s in streams]
    if sum(sizes) < 2 * least:
        return [np.zeros(n, bool) for n in sizes]
    # A separator that occurs once follows each stream, so no run spans pages.
    all_words = np.unique(np.concatenate(streams), return_inverse=True)[1].astype(np.int64)
    joined, owner, pos, at = [], [], [], 0
    for i, n in enumerate(sizes):
        joined += [all_words[at : at + n], np.array([-1 - i])]
        owner.append(np.full(n + 1, pages[i]))
        pos.append(np.arange(n + 1))
        at += n
    tokens, page = np.concatenate(joined), np.concatenate(owner)
    order = suffix_array(tokens)
    lcp = common_prefixes(tokens, order)
    # Neighbours in order with enough in common form a group; in a group with
    # two pages each suffix is covered as far as it shares with another page.
    cover = np.zeros(len(tokens) + 1, np.int64)
    group = np.cumsum(lcp < least)
    who = page[order]
    spread = np.zeros(group[-1] + 1, bool)
    first = np.full(group[-1] + 1, -1, np.int64)
    first[group[::-1]] = who[::-1]
    spread[group[who != first[group]]] = True
    hit = np.flatnonzero(spread[group])
    cover[order[hit]] += 1  # the group shares `least` words; longer runs are covered by the suffixes that follow
    np.add.at(cover, np.minimum(order[hit] + least, len(tokens)), -1)
    covered = np.cumsum(cover[:-1]) > 0
    out, at = [], 0
    for n in sizes:
        out.append(covered[at : at + n])
        at += n + 1
    return out


def _word_ids(words: list[str]) -> np.ndarray:
    import xxhash
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def hash_of(kinds, texts) -> int:
    """A hash of a page's blocks."""
    import xxhash
    return xxhash.xxh3_64_intdigest("\0".join(f"{k}{t}" for k, t in zip(kinds, texts))) - (1 << 63)


def windows(ids: np.ndarray, least: int) -> np.ndarray:
    """A hash of each run of ``least`` words."""
    n = len(ids) - least + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(least):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n])
    return h


PARSED = "page_id long, url string, host string, fixed boolean, kinds array<int>, texts array<string>"
KEPT = "page_id long, url string, host string, fixed boolean, kinds array<int>, texts array<string>, marks binary, found array<long>, same long"
OUT = "page_id long, url string, text string, n_chars long"


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", url or "")
    return (m[1].rsplit("@", 1)[-1].lower() if m else "")


def parse_pages(pages: DataFrame) -> DataFrame:
    """Blocks of each page; ``fixed`` if structure alone decides (no open block)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, u, h in zip(b["page_id"], b["url"], b["html"]):
                found = blocks(h)
                fixed = all(k == MAIN_TEXT for k, _ in found)
                rows.append((p, u, host_of(u), fixed, [k for k, _ in found], [t for _, t in found]))
            out = pd.DataFrame(rows, columns=["page_id", "url", "host", "fixed", "kinds", "texts"])
            out["page_id"] = out["page_id"].astype("Int64")
            yield out

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return src.mapInPandas(run, PARSED)


def _open_words(kinds, texts) -> list[str]:
    return [w for k, t in zip(kinds, texts) if k != MAIN_TEXT for w in t.split(" ")]


def extract(pages: DataFrame, least_words: int = LEAST_WORDS, group_pages: int = GROUP_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    parsed = materialize(parse_pages(pages), "html-blocks")
    done = parsed.filter("fixed").select("page_id", "url", F.array_join("texts", " ").alias("text"))
    rest = parsed.filter("NOT fixed")
    hosts = rest.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / group_pages).cast("int").alias("_groups"))
    grouped = rest.join(hosts, "host").withColumn("_group", F.pmod(F.xxhash64("page_id", "url", "texts"), F.col("_groups")))

    def in_group(g: pd.DataFrame) -> pd.DataFrame:
        streams = [_word_ids(_open_words(k, t)) for k, t in zip(g["kinds"], g["texts"])]
        pages_of = pd.factorize(g["page_id"], use_na_sentinel=False)[0].tolist()
        # Equal pages are one page: the first of them stands for all.
        same = pd.Series([hash_of(k, t) for k, t in zip(g["kinds"], g["texts"])])
        first = np.flatnonzero(~same.duplicated())
        judged_once = dict(zip(same.iloc[first], repeated([streams[i] for i in first], [pages_of[i] for i in first], least_words)))
        marks = [judged_once[x] for x in same]
        shared = [np.unique(windows(s, least_words)).view(np.int64).tolist() if g["_groups"].iloc[0] > 1 else [] for s in streams]
        return g.assign(marks=[np.packbits(m).tobytes() for m in marks], found=shared, same=same.to_numpy())[[c.split()[0] for c in KEPT.split(", ")]]

    judged = materialize(grouped.groupBy("host", "_group").applyInPandas(in_group, KEPT), "html-groups")
    # Windows that two pages of a host share, whichever groups they are in.
    judged = judged.withColumn("_page", F.coalesce(F.col("page_id").cast("string"), F.lit("")))  # a null id is a page too
    seen = judged.select("host", "_page", "same", F.explode("found").alias("w"))
    common = (seen.groupBy("host", "w").agg(F.min("_page").alias("a"), F.max("_page").alias("b"), F.min("same").alias("c"), F.max("same").alias("d"))
              .filter("a <> b AND c <> d").select("host", "w"))
    marked = seen.join(common, ["host", "w"]).groupBy("host", "_page").agg(F.collect_set("w").alias("shared"))
    final = judged.drop("found", "same").join(marked, ["host", "_page"], "left")

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for kinds, parts, marks, shared in zip(b["kinds"], b["texts"], b["marks"], b["shared"]):
                words = _open_words(kinds, parts)
                gone = np.unpackbits(np.frombuffer(marks, np.uint8), count=len(words)).astype(bool)
                if shared is not None and len(shared):
                    hit = np.flatnonzero(np.isin(windows(_word_ids(words), least_words).view(np.int64), np.asarray(shared, np.int64)))
                    for k in range(least_words):
                        gone[hit + k] = True
                out, at = [], 0
                for k, t in zip(kinds, parts):
                    if k != MAIN_TEXT:
                        own = t.split(" ")
                        t = " ".join(w for w, g in zip(own, gone[at : at + len(own)]) if not g)
                        at += len(own)
                    if t:
                        out.append(t)
                texts.append(" ".join(out))
            yield b[["page_id", "url"]].assign(page_id=b["page_id"].astype("Int64"), text=texts)

    stripped = final.select("page_id", "url", "kinds", "texts", "marks", "shared").mapInPandas(strip, "page_id long, url string, text string")
    out = done.unionByName(stripped)
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
