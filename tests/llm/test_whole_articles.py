"""Articles whose text stands beside their best scored container, and wrappers with marks in their class names."""

import time

import pytest
from pyspark.sql import functions as F

from plumbline.llm import html

LONG = [f"Paragraph {i}, with commas, and words, and more words, so that it scores well, all in all." for i in range(5)]
FIVE = "".join(f"<p>{t}</p>" for t in LONG)


@pytest.mark.parametrize("page, text", [
    (f"<nav>menu</nav><article><h1>T</h1><p>Lead.</p><div>{FIVE}</div><h2>More</h2><blockquote>Quote</blockquote><pre>code</pre><section><p>End.</p></section></article><footer>f</footer>",
     ["T", "Lead.", *LONG, "More", "Quote", "code", "End."]),
    (f"<nav>menu</nav><main><h1>T</h1><article><div>{FIVE}</div><aside>a</aside></article><div><p>Short.</p></div></main>", ["T", *LONG, "Short."]),
    (f"<div id=page><div><h1>T</h1></div><div>{FIVE}</div><div>End.</div></div><div class=sidebar>s</div>", ["T", *LONG, "End."]),
    (f"<body><nav>menu</nav><h1>T</h1><div>{FIVE}</div>Bare.<pre>code</pre><div>Small print</div></body>", ["T", *LONG, "Bare.", "code"]),
    (f"<div class='content with-sidebar'>{FIVE}</div><div class='sidebar'>s</div>", LONG),
    (f"<div class='share-enabled post'>{FIVE}</div>", LONG),
    (f"<div class='sidebar-layout'>{FIVE}<div class='share-buttons'>Share this</div></div><div class='site-footer'>f</div>", LONG),
    (f"<div>{FIVE}</div><div class='comments-area'>{FIVE * 3}</div>", LONG),
])
def test_nothing_else_is_dropped(page, text):
    assert html.main_text(page) == "\n".join(text)


@pytest.mark.parametrize("part, kept", [
    ("<p title='the hidden cost of it'>Kept.</p>", "Kept."),
    ("<figure><img src=x><figcaption>A caption</figcaption></figure>", "A caption"),
    ("<p>Let <math><mi>x</mi></math> be.</p>", "Let x be."),
    ("<div data-id='comment-5'>Kept</div>", "Kept"),
    ("<p class='social'>Social questions stay.</p>", "Social questions stay."),
    ("<p id=related>So do related ones.</p>", "So do related ones."),
    ("<p>A <span class='related-term'>word</span> inside.</p>", "A word inside."),
    ("<ul><li><a>one</a> <a>two</a> <a>three</a> <a>four</a></ul>", "one two three four"),
    ("<div class='related-work'><h2>Related work</h2><p>Others did it before.</p></div>", "Related work\nOthers did it before."),
    ("<div class='related-posts'><h2>Related posts</h2><ul><li><a>An older post, with a long title</a></ul></div>", ""),
    ("<div class='share-buttons'><a>Share</a></div><div class=social>Share this</div>", ""),
    ("<div hidden>no</div><p style='display: none'>no</p><p aria-hidden=true>no</p><p hidden>no</p>", ""),
    ("<div class=outer-sidebar><div class=related><p>Prose in a sidebar goes with it.</p></div></div>", ""),
])
def test_parts_of_an_article(part, kept):
    page = f"<nav>menu</nav><article><h1>T</h1>{FIVE}{part}{FIVE}</article>"
    assert html.main_text(page) == "\n".join(["T", *LONG, *([kept] if kept else []), *LONG])


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "text", "<div>x, y" * 100_000, "<div>" * 5000 + "</span></p></b>" * 65_000, "<a " * 330_000, "<a \">\"" * 150_000,
    "<b>x" * 200_000, "<b>" * 100_000 + "</i>" * 100_000, "<div class='side-bar sidebar-x'>a, b" * 30_000, "<script>" * 120_000, "<" * 1_000_000,
], ids=range(10))
def test_time_is_linear(page):
    start = time.process_time()
    html.main_text(page)
    assert time.process_time() - start < 20  # one or two seconds; a climb per element takes many minutes


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "u", ""), (2, None, "<p>a</p>"), (2, None, "<p>a</p>"), (3, "v", "<p>" + "long, " * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(9))
    got = sorted(((r.page_id, r.url, r.n_chars) for r in html.extract_pages(pages).collect()), key=str)
    assert got == sorted([(None, None, 0), (1, "u", 0), (2, None, 1), (2, None, 1), (3, "v", 6 * 300_000 - 1)], key=str)
    assert html.extract_pages(pages.limit(0)).count() == 0
