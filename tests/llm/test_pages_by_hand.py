"""Main text of pages written by hand, which the generator of training pages knows nothing of, and the reader's time."""

import time

import pytest

from tessera.llm import html_extract as hx
from tessera.llm.html_tree import parse

PAGES = [
    ("<article><h1>T</h1><p>See here.</p><ul><li><a>see this linked item</a></li><li>second</li></ul><p>Ok</p></article>", "T See here. see this linked item second Ok"),
    ('<article class="post"><section class="more"><p>Body text of it.</p></section></article>', "Body text of it."),
    ('<main><div class="widget-text share"><p>Body text of it.</p></div></main>', "Body text of it."),
    ('<article><p>One.</p><p class="warning">Mind the gap here.</p><p>Two.</p></article>', "One. Mind the gap here. Two."),
    ("<article><p>We have <math><mi>x</mi><mo>=</mo><mn>1</mn></math> there.</p></article>", "We have x=1 there."),
    (
        '<body><nav><a href=/>Home</a> <a href=/b>Blog</a></nav><form id=f><div class="content"><h1>Title of it</h1><p>The body is long enough to be one. It has two sentences.</p></div></form><footer>&copy; Us</footer></body>',
        "Title of it The body is long enough to be one. It has two sentences.",
    ),
    (
        '<header><a href=/>Site</a></header><main><h1>How it went</h1><p>First we went out. Then we came back.</p><div class="ad">Buy this now.</div><p>And that was it.</p><section class="comments"><h3>2 comments</h3><div><p>I like this a lot. Really good.</p></div><div><p>Me too, thanks.</p></div></section></main><aside><h3>Related</h3><ul><li><a href=/1>One more</a></li></ul></aside>',
        "How it went First we went out. Then we came back. And that was it.",
    ),
    (
        '<div class="cookie-banner"><p>We use cookies. Accept?</p><button>OK</button></div><div id="page"><div class="sidebar"><ul><li><a>A</a><li><a>B</a></ul></div><div class="entry"><h2>Recipe</h2><p>Mix it all well.</p><ol><li>Stir.<li>Bake it.</ol><blockquote>So good!</blockquote></div></div>',
        "Recipe Mix it all well. Stir. Bake it. So good!",
    ),
    (
        '<article><header><h1>Big news</h1></header><p>It was seen.</p><figure><img src=x><figcaption>A view.</figcaption></figure><div class="share"><a>Tweet</a><a>Post</a></div><p>End of it all.</p></article><div class="newsletter">Sign up for our letter. It is free.</div>',
        "Big news It was seen. A view. End of it all.",
    ),
    ('<nav><ul><li><a href=/>a</a></ul></nav><article><h1>x &amp; y</h1><p>A b.<br>c</p></article><script>var t="</article>";</script>', "x & y A b. c"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert hx.default_model().text(page) == text


@pytest.mark.parametrize(
    "page",
    ["<div>" * 100_000, "<div>" * 50_000 + "</b>" * 50_000, "<ul>" + "<b><li>" * 50_000, "<b><table><td>" + "<div>" * 50_000 + "</b>" * 50_000, "<head>" + "<div>" * 50_000, "<p><a>" * 50_000, "<a '>" * 50_000 + '"'],
)
def test_time_grows_with_length(page):
    took = []
    for p in (page[: len(page) // 8], page):
        began = time.process_time()
        parse(p)
        took.append(time.process_time() - began)
    assert took[1] < max(3.0, 30 * took[0])


def test_deep_page_is_read_whole():
    page = "<div>" * 30_000 + "<article><p>Deep text that is long enough to be found. It has two sentences.</p></article>"
    assert hx.default_model().text(page) == "Deep text that is long enough to be found. It has two sentences."


def test_every_page_of_the_tables():
    import html
    import re

    import pyarrow.parquet as pq

    for x in pq.read_table("/root/testdata/sf0.1/pages.parquet")["html"].to_pylist():
        inner = x[x.find("<article>") + 9 :].split("</article>")[0]
        plain = re.sub(r"<[^>]*(>|$)", "", re.sub(r"<(/?(p|h1)|br)[^>]*>", " ", inner))
        assert hx.default_model().text(x) == " ".join(html.unescape(plain).split())


def test_rows(spark):
    rows = [(1, "u", PAGES[0][0], 5), (1, "u", PAGES[0][0], 6), (None, None, None, 7), (2, "u", " ", 8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in hx.extract_text(df).collect())
    assert got == [(0, "", 0), (1, PAGES[0][1], len(PAGES[0][1])), (1, PAGES[0][1], len(PAGES[0][1])), (2, "", 0)]
