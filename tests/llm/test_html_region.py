"""Main text of pages, by markup of several kinds."""

import html
import re

import pytest

from trialframe.llm import html_region as h
from trialframe.llm.catalog import QUERIES, table

WEIGHTS = h.Weights({"nav": (0, 900), "div.ad": (0, 400), "p": (9000, 100), "li": (30, 900), "footer": (0, 700), "h1": (500, 0)})


def text_of(page):
    return h.main_text(page, WEIGHTS)


@pytest.mark.parametrize("page", [None, "", " \n ", "<p>", "<!-- only", "<script>var x = 1;</script>", "<nav><a>Menu</a></nav>", "<", "</p></div>"])
def test_no_main_text(page):
    assert text_of(page) in ("", "<")


def test_boilerplate_is_left_out():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header class="site-header"><h2>Site name here</h2></header><nav><ul><li><a>Home</a></li><li><a>About</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies for all sorts of things, please accept them all now.</p></div>
    <div class="ad">Buy many cheap things today at our shop.</div>
    <article><h1>A &amp; B &lt;3&nbsp;C</h1><p>First   <b>bold</b>word
    here.<p>Second paragraph <a href="/x">with link</a> inside.<ul><li>item one of the list</li><li>item two</li></ul>
    <div class="share-buttons">Share on this and on that</div><aside>Read also another article on this page</aside>
    <form>Sign up <input type=text> <button>Go on then</button></form>
    <blockquote>A quotation that ends it.</blockquote></article>
    <section id="comments"><p>I think that this article is wrong in so many ways, said a reader.</p></section>
    <footer>&copy; all of us</footer></body></html>"""
    assert text_of(page) == (
        "A & B <3 C\nFirst boldword here.\nSecond paragraph with link inside.\nitem one of the list\nitem two\nA quotation that ends it.")


def test_without_an_article_element():
    page = '<body><div id="menu"><a>One</a> <a>Two</a></div><div class="content"><p>This is the only text of the page.</p><p>It goes on.</p></div><div class="footer">Some words at the end</div>'
    assert text_of(page) == "This is the only text of the page.\nIt goes on."


def test_broken_and_long_markup():
    assert text_of("<article><p>Open <b>tags and a quote \"<p>Next one") == 'Open tags and a quote "\nNext one'
    assert text_of('<article><p title="a > b">Kept words</p><p class=x"y>More words here</p>') == "Kept words\nMore words here"
    long = "<article>" + "<p>word one</p>" * 50_000 + "</article>"
    assert text_of(long) == "\n".join(["word one"] * 50_000)
    assert text_of("<p>" + "<" * 20_000 + " x").endswith("< x")
    assert text_of("<article><p>a b c</p>" + "<a \"" * 3000) == "a b c"


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in table(spark, folder, "pages").collect()}
    got = QUERIES["op1_html_region"](spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_edges(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<article><p>some words here</p></article>"), (2, "v", "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = h.main_texts(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.text, r.n_chars) for r in got.collect()) == [("", 0)] * 3 + [("some words here", 15)]
    assert h.main_texts(df.limit(0)).count() == 0
