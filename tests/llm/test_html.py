"""Operator 13 on pages made for it: what must stay, what must go, and figures by definition."""

import html
import math
import random
import re
import time
from html.parser import HTMLParser

import pytest

from tellscan.llm import htmltext
from tellscan.llm.htmltext import main_text

WORDS = "stone river light under seven wooden boats carry salt along quiet shore while gulls turn".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


LINKS = "".join(f'<li><a href="/{w}">{w.title()}</a></li>' for w in WORDS[:6])
CHROME = {
    "menu": f"<nav><ul>{LINKS}</ul></nav>",
    "menu of divs": f'<div class="main-menu"><ul>{LINKS}</ul></div>',
    "header": '<header class="top"><h1>The Site</h1><p>All the news of the shore, every day of the year.</p></header>',
    "footer": "<footer><p>&copy; The Site &middot; All rights reserved by the keepers of the shore and the boats.</p></footer>",
    "footer by name": '<div id="page-footer"><p>Imprint and terms of use of the keepers of the shore.</p></div>',
    "sidebar": f"<aside><h3>Most read</h3><ul>{LINKS}</ul><p>{'A box beside the text that goes on and on. ' * 5}</p></aside>",
    "sidebar by name": f'<div class="sidebar-right"><p>{"A box beside the text that goes on and on. " * 5}</p></div>',
    "advert": '<div class="ad">Buy two boats and get a third for nothing, today only, while stocks last.</div>',
    "sponsored": '<section class="sponsored-content"><p>Our partners have boats to sell to every reader.</p></section>',
    "cookies": '<div id="cookieConsent" role="dialog"><p>We use cookies to make this page better for you and for us.</p><button>Accept</button></div>',
    "notice": '<div class="notice"><p>You are reading an old browser. Please update it to see our boats.</p></div>',
    "form": '<form action="/s"><label>Your mail</label><input name="q"><select><option>One<option>Two</select><textarea>Type here</textarea></form>',
    "script": '<script>var t = "</p><p>not text</p>"; if (a < b) { go(); }</script><noscript>Please turn it on.</noscript>',
    "style": "<style>p > b { margin: 0 }</style>",
    "comment": "<!-- <p>not text</p> -->",
    "readers": f'<section id="comments"><h2>3 comments</h2>{"".join(f"<div><b>Reader {k}</b><p>{"I have seen these boats and they were wooden, all seven of them. " * 6}</p></div>" for k in range(3))}</section>',
    "readers as articles": f'<div class="comments-area">{"".join(f"<article><p>{"I have seen these boats and they were wooden. " * 8}</p></article>" for _ in range(3))}</div>',
    "hidden": '<div style="display: none"><p>Nobody sees these words about the boats.</p></div><p hidden>Nor these.</p>',
    "share": '<ul class="share-buttons"><li>Post</li><li>Send</li></ul>',
}


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><article>{}</article></main>", '<div id="content">{}</div>', '<div class="page has-sidebar"><div class="post">{}</div></div>'])
@pytest.mark.parametrize("inside", [False, True])
def test_everything_beside_the_article_goes(wrap, inside):
    rng = random.Random(str((wrap, inside)))
    for names in [[n] for n in CHROME] + [rng.sample(list(CHROME), 6) for _ in range(30)]:
        blocks = ["A heading of it"] + [prose(rng, rng.choice([25, 40, 60])) for _ in range(6)]
        parts = [f"<h1>{blocks[0]}</h1>", *[f"<p>{b}</p>" for b in blocks[1:]]]
        before, after = [], []
        for n in names:
            if inside and n not in ("header", "readers as articles"):
                parts.insert(rng.randrange(1, len(parts) + 1), CHROME[n])
            else:
                (after if "readers" in n or "footer" in n else before).append(CHROME[n])
        page = f"<!DOCTYPE html><html><head><title>Title</title></head><body>{''.join(before)}{wrap.format(''.join(parts))}{''.join(after)}</body></html>"
        assert main_text(page) == "\n".join(blocks), (names, page)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("<html></html>", ""), ("just words", "just words"), ("<p>one<p>two", "one\ntwo"),
        ("<article><p>a\n  b\t c&nbsp;d<br>e</p><p> </p><p>f</p></article>", "a b c d e\nf"),
        ("<p>5 &lt; 6 &amp;amp; 7 &#233;&#x20AC; &am &amp x</p>", "5 < 6 &amp; 7 é€ &am & x"),
        ("<p>a <b>bold</b><i>er</i> word</p>", "a bolder word"),
        ("<p><b>first<br><p>second</b> part", "first\nsecond part"),
        ("<ul><li>one<li>two<ul><li>three</ul><li>four</ul>", "one\ntwo\nthree\nfour"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
        ("<div>lead<p>inner</p>tail</div>", "lead\ninner\ntail"),
        ("<p>x < y and y > z</p>", "x < y and y > z"),
        ("<p title='a > b' data-x=\"<p>\">kept</p>", "kept"),
        ("<p>open <a href='x", "open"),
        ("<p>seen</p><!-- never ended <p>x</p>", "seen"), ("<p>seen</p><script>never ended", "seen"), ("<!--><p>seen</p>", "seen"),
        ("<SCRIPT>x</SCRIPT><P>Seen</P>", "Seen"), ("<p>a</p></div></p></span><p>b</p>", "a\nb"),
        ("<pre>a\n  b</pre>", "a b"), ("<article><header><h1>Head</h1><p>By Someone</p></header><p>Body of it.</p><footer>Tags</footer></article>", "Head\nBody of it."),
        ("<div class='sidebar-layout'><div class='entry-header'><h1>Head</h1></div><p>Kept as it is most of the page.</p></div><div class='promo'><p>Boats</p></div>", "Head\nKept as it is most of the page."),
        ("<body class='no-comments with-sidebar'><p>Kept</p></body>", "Kept"),
    ],
)
def test_small_pages(page, text):
    assert main_text(page) == text


def test_blocks_equal_those_of_a_parser_of_its_own():
    """Pages of random inline mark-up and references in plain paragraphs, read by the standard library's parser."""

    class Blocks(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.on, self.done = [], False, False

        def handle_starttag(self, tag, attrs):
            if tag in ("p", "h1") and not self.done:
                self.out.append("")
                self.on = True
            elif tag == "br" and self.on:
                self.out[-1] += " "

        def handle_endtag(self, tag):
            self.on = self.on and tag not in ("p", "h1", "article")
            self.done = self.done or tag == "article"

        def handle_data(self, data):
            if self.on:
                self.out[-1] += data

    rng = random.Random(11)
    inline = ["<b>{}</b>", "<i>{}", "{}<br>", "<span class='x'>{}</span>", "{}&amp;", "&eacute;{}", "{}", "<a href='/x?a=1&b=2'>{}</a>"]
    for _ in range(200):
        body = "".join(f"<p>{' '.join(rng.choice(inline).format(rng.choice(WORDS)) for _ in range(rng.randrange(1, 30)))}{rng.choice(['</p>', ''])}" for _ in range(rng.randrange(1, 9)))
        page = f"<html><body>{CHROME['menu']}<article><h1>Head</h1>{body}</article>{CHROME['footer']}</body></html>"
        parser = Blocks()
        parser.feed(page)
        parser.close()
        assert main_text(page) == "\n".join(x for x in (" ".join(b.split()) for b in parser.out) if x)


def test_densities_by_definition():
    rng = random.Random(2)

    def node(depth):
        """A random tree as (tag, own text, children)."""
        return (rng.choice(["div", "a", "span", "section"]), prose(rng, rng.randrange(1, 8)) if rng.random() < 0.7 else "", [node(depth - 1) for _ in range(rng.randrange(3))] if depth else [])

    def write(x):
        return f"<{x[0]}>{x[1]}{''.join(map(write, x[2]))}</{x[0]}>"

    def count(x, link=False):
        link = link or x[0] == "a"
        c, lc, t, lt = len(x[1]), len(x[1]) if link else 0, 0, 0
        for y in x[2]:
            a = count(y, link)
            c, lc, t, lt = c + a[0], lc + a[1], t + a[2] + 1, lt + a[3] + (y[0] == "a")
        return c, lc, t, lt

    for _ in range(100):
        body = ("body", "", [node(4) for _ in range(3)])
        whole, found, sums, link = count(body), [], [], {}

        def density(x, inside=False):
            c, lc, t, lt = count(x, inside)
            if not c:
                return 0.0
            base = math.log(c / max(c - lc, 1) * lc + whole[1] / whole[0] * c + math.e)
            adjusted = math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1), base) if base > 1 else 1.0
            return c / max(t, 1) * max(0.0, adjusted)

        def walk(x, inside=False):
            inside = inside or x[0] == "a"
            found.append(density(x, inside))
            sums.append(sum(density(y, inside) for y in x[2]))
            for y in x[2]:
                walk(y, inside)

        if not whole[0]:
            continue
        walk(body)
        tree = htmltext.parse(f"<body>{''.join(map(write, body[2]))}</body>")
        got = htmltext.densities(tree, [False] * len(tree.tags))
        assert got[0] == pytest.approx(found) and got[1] == pytest.approx(sums)


def test_long_deep_and_broken_pages_take_time_in_proportion():
    rng = random.Random(4)
    body = "".join(f"<p>{prose(rng, 30)}</p>" for _ in range(10_000))
    makers = [
        lambda n: f"<article>{body[: len(body) // 4 * n]}</article>", lambda n: "<div>" * (20_000 * n) + "deep", lambda n: "<b>x</i>" * (20_000 * n), lambda n: "<p><b>x" * (15_000 * n),
        lambda n: "<a href='x" * (20_000 * n), lambda n: "<a " * (20_000 * n), lambda n: "<!-" * (20_000 * n), lambda n: "<" * (40_000 * n), lambda n: "&amp" * (40_000 * n), lambda n: "<ul><li>x" * (10_000 * n),
        lambda n: "<table><tr><td>" * (8_000 * n), lambda n: "<article class='a'>x" * (10_000 * n), lambda n: "<a class=" * (20_000 * n), lambda n: "<div class='" + "a " * (20_000 * n) + "'>x</div>",
    ]
    for k, make in enumerate(makers):
        took = []
        for n in (1, 4):
            page = make(n)
            began = time.process_time()
            main_text(page)
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.2, (k, took)
    assert main_text(f"<article>{body}</article>").count("\n") == 9_999


def test_rows_columns_nulls_and_repeats(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, None), (2, "v", "", "y"), (3, "w", "<article>" + "<p>word </p>" * 100_000 + "</article>", "z")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, Main_Text string")
    out = {(r.page_id, r["_main_text"].count("\n"), r.Main_Text) for r in htmltext.extract(frame).collect()}
    assert out == {(1, 0, "x"), (None, 0, None), (2, 0, "y"), (3, 99_999, "z")}
    found = htmltext.report(frame.select("page_id", "url", "html")).collect()
    assert sorted(((r.page_id, r.url, r.n_chars) for r in found), key=repr) == sorted([(1, "u", 1), (1, "u", 1), (None, None, 0), (2, "v", 0), (3, "w", 499_999)], key=repr)
    assert htmltext.report(frame.limit(0)).count() == 0


def test_whole_pages_table(spark):
    """Every page of the table: the blocks of its one article, by a pattern."""
    from tellscan.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    found = {r.page_id: r for r in QUERIES["op13_html_extraction"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(found) == len(pages)
    for p in pages:
        pieces = re.split("</?(?:h1|p)>", re.search("<article>(.*?)</article>", p.html, re.S)[1])
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", " ", y)).split()) for y in pieces) if x)
        assert (found[p.page_id].text, found[p.page_id].n_chars, found[p.page_id].url) == (want, len(want), p.url)
