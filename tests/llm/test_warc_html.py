"""Archives (round trip) and main text (structure and repetition)."""

import base64
import gzip
import hashlib

import numpy as np
import pytest

from textpulse.llm import html, warc
from textpulse.llm.common import fresh_path

SCHEMA = "page_id long, url string, html string, digest string, host string, _uid int"


@pytest.fixture()
def pages(spark):
    return lambda rows: spark.createDataFrame([(p, u, h, "d", "h", 1) for p, u, h in rows], SCHEMA)


TRICKY = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n\r\n\r\n"


@pytest.mark.parametrize("least", [0, 4])
def test_round_trip(pages, least):
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://b/", None), (4, "http://b/", ""), (5, "u\r\nX: y", TRICKY),
            (6, "u", TRICKY), (6, "u", TRICKY), (7, "ü", "é🙂\r\n\r\n"), (None, "n", "<p>x</p>")]
    got = warc.round_trip(pages(rows), least).collect()
    payload = lambda h: (h or "").encode()
    want = []
    seen = {}
    for p, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = payload(h)
        first = len(b) < least or b not in seen
        refers = None if first else seen[b]
        seen.setdefault(b, p)
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", refers))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_payloads_come_back(spark, pages):
    path = fresh_path(spark, "t")
    warc.write_archives(pages([(1, "a", TRICKY), (2, "b", "x"), (3, "c", "x")]), path)
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert bytes(got[1].payload) == TRICKY.encode() and bytes(got[2].payload) == b"x"
    assert got[3].record_type == "revisit" and got[3].payload is None and got[3].refers_to == got[2].record_id


def test_empty_tables(pages):
    assert warc.round_trip(pages([])).count() == 0 and html.extract(pages([])).count() == 0


def test_parse_members_and_errors():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert [b for _, b in warc.parse(gzip.compress(one) + gzip.compress(one))] == [b"hi", b"hi"]
    with pytest.raises(ValueError):
        list(warc.parse(one.replace(b"2", b"1")))
    with pytest.raises(ValueError):
        list(warc.parse(b"HTTP/1.1 200\r\n\r\n"))


def test_unresolved_revisit_is_an_error(spark):
    r = spark.createDataFrame([("a", 1, "revisit", "u", "D", None, "b")], warc.HEADERS)
    with pytest.raises(Exception, match="no response with this payload"):
        warc.resolved(r).collect()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></ul></nav><!-- <article>no</article> --><div class="ad">Buy &amp; sell</div>
<div role="main" id="content" class="page-with-sidebar"><article class="post"><header><h1>Title&nbsp;A</h1></header><p>One <b>bold</b>ly
 &lt;two&gt; &amp;amp; &eacute;&#x41;<br>three<p>four<ul><li>five<li>six</ul><form><input>no</form><aside>no</aside>
<div class="comment-list"><p>no</p></div><div hidden>no</div><noscript>no</noscript><div class="social-share">no</div><div class="entry-header">seven</div></article><div class="site-header">no</div></div>
<footer>&copy; me</footer></body>"""


def test_structure(pages):
    got = html.extract(pages([(1, "http://h/1", PAGE), (2, None, None), (3, "", ""), (None, "http://h/2", "<article>a<p>a</article>"), (4, "x", "<script>never closed <p>a")])).collect()
    text = {r.page_id: (r.text, r.n_chars) for r in got}
    want = "Title A One boldly <two> &amp; éA three four five six seven"
    assert text == {1: (want, len(want)), 2: ("", 0), 3: ("", 0), None: ("a a", 3), 4: ("", 0)}


@pytest.mark.parametrize("page, want", [
    ('<article><h2 id="related-work">Related</h2><p id="search">one<span id="share"> two</span></p></article>', "Related one two"),
    ('<article><section id="search-methods">a</section><div class="social-history">b</div><div class="widget theory">no</div></article>', "a b"),
    ('<article>a<div class="related-posts">no</div><div class="comment-list">no</div><div class="share">no</div></article>', "a"),
    ('<div class="menu">no</div><div class="content sidebar-right"><h1>T</h1><article>a<div class="ad">no</div></article></div>', "T a"),
    ('<main class="search-results"><p>a</p></main><footer>no</footer>', "a"),
    ('<form id="page"><article>a</article><div class="comments"><article>no</article></div></form>', "a"),
    ('<article>a</article><div class="related"><article>no</article></div>', "a"),
    ('<div hidden class="ad"><article>no</article></div>', ""),
])
def test_marks_take_no_article_text(page, want):
    assert " ".join(t for _, t in html.blocks(page)) == want


@pytest.mark.parametrize("name", ["reader-comments", "user-comments", "comment-thread", "ad-slot", "advert-top", "related-articles", "share-this",
                                  "comments", "ads", "comment_list", "sponsored-links", "newsletter-box"])
def test_comments_and_adverts_inside_an_article_go(name):
    for attr in (f'class="{name}"', f"id='{name}'", f"class='x {name} y'"):
        assert html.blocks(f"<article><p>one<div {attr}><p>no <b>no</b><ul><li>no</ul></div><p>two</article>") == [(1, "one"), (1, "two")]


@pytest.mark.parametrize("inside, goes", [
    ("<p>The social history of the town is long.</p>", False),
    ("<ul><li><a href=x>first story</a><li><a href=y>second story</a></ul>", True),
    ("<p>Tell us <input name=a> now</p>", True),
    ("<div><span class=author>A</span> wrote well</div><div><time>1 May</time> B agrees</div>", True),
    ("<p>See <a href=x>one</a> of the many long sources of this part</p>", False),
])
def test_content_decides_about_suspects(inside, goes):
    got = html.blocks(f'<article><p>one</p><section class="social-history">{inside}</section><p>two</p></article>')
    assert [t for k, t in got if k == html.MAIN_TEXT] == ["one", "two"]
    assert any(k == html.DOUBTFUL for k, _ in got) == (not goes)


def test_doubtful_blocks_go_where_the_host_repeats_them(pages):
    same = "join our weekly letter of news for all friends of this fine paper"
    rows = [(i, f"http://h/{i}", f"<article><p>page {i} text</p><div class='subscribe-teaser'>{same}</div></article>") for i in range(4)]
    rows += [(None, "http://h/n", f"<article><p>page null text</p><div class='subscribe-teaser'>{same}</div></article>")]
    rows += [(9, "http://h/9", "<article><p>page 9 text</p><div class='search-theory'>the theory of search is told in this one part of the page alone</div></article>")]
    for group in (1, 100):
        got = {r.page_id: r.text for r in html.extract(pages(rows), group_pages=group).collect()}
        assert got == {i: f"page {i} text" for i in range(4)} | {None: "page null text", 9: "page 9 text the theory of search is told in this one part of the page alone"}


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '", "<!x", "<![CDATA[", "<!--", "<head>", "<head><body>", "<div>", "</p>", "<p><div>", "</div>", "<i><div><b>",
                                   "<article hidden>", "<article>", '<div class="ad ', "<script", "<textarea>", "&amp", "<a<b", '<div class="social-history">',
                                   '<article><div class="social-history">x'])
def test_time_is_linear_in_malformed_pages(piece):
    import time

    def spent(n):
        page = "<i><div><p>" + piece * (n // len(piece)) + "</i></p>" * 10 + "</q>" * (n // 40) + "</p>" * (n // 40)
        t = time.process_time()
        html.blocks(page)
        return time.process_time() - t
    small, large = min(spent(50_000) for _ in range(2)), spent(800_000)
    assert large < 0.5 + 40 * small and large < 20


@pytest.mark.parametrize("group", [2, 100])
def test_repeated_runs_go_whatever_the_groups(pages, group):
    """Pages without an article: what a host repeats goes, what is unique stays."""
    same = "all of our pages begin with these very same ten words"
    rows = [(i, f"http://h.example/{i}", f"<div>{same}</div><p>body{i} " + " ".join(f"u{i}_{k}" for k in range(20)) + "</p>") for i in range(9)]
    rows += [(100, "http://other.example/", f"<div>{same}</div>")]
    got = {r.page_id: r.text for r in html.extract(pages(rows), group_pages=group).collect()}
    for i in range(9):
        assert got[i] == f"body{i} " + " ".join(f"u{i}_{k}" for k in range(20))
    assert got[100] == same  # another host


@pytest.mark.parametrize("group", [1, 100])
def test_equal_pages_keep_their_text(pages, group):
    text = " ".join(f"w{k}" for k in range(20))
    got = html.extract(pages([(i, f"http://h/{i}", f"<p>{text}</p>") for i in range(4)]), group_pages=group).collect()
    assert {r.page_id: r.text for r in got} == dict.fromkeys(range(4), text)


def test_articles_may_quote(pages):
    same = "a passage of ten words that two articles of a host share"
    got = html.extract(pages([(i, "http://h/", f"<article><p>{same}</p></article>") for i in range(3)])).collect()
    assert {r.text for r in got} == {same}


def test_repeated_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        streams = [rng.integers(0, 3, rng.integers(0, 30)).astype(np.uint64) for _ in range(4)]
        pages_of = [0, 1, 1, 2]
        got = html.repeated(streams, pages_of, 4)
        for i, s in enumerate(streams):
            want = np.zeros(len(s), bool)
            for p in range(len(s) - 3):
                if any((s[p : p + 4] == q[k : k + 4]).all() for j, q in enumerate(streams) if pages_of[j] != pages_of[i] for k in range(len(q) - 3)):
                    want[p : p + 4] = True
            assert (want == got[i]).all()
