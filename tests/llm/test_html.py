import os

import pytest
from pyspark.sql import functions as F

from quillmark.llm import html

DATA = "/root/testdata/sf0.001"

LONG = "It was the best of times and it was the worst of times, for all of us who were there in the city and by the sea. " * 3
PAGE = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style></head><body>
<!-- <p>not this</p> --><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav>
<div class="cookie-notice">We use cookies on the site and you are to accept them.</div>
<article><h1>Title &amp; more</h1><p>{LONG}</p><p>Short<br>one &copy;&#8217;<b> bold</b>er.</p><script>var t="</p><p>bad";</script>
<div class="ad">Buy this now.</div><ul><li>first</li><li>second</ul><p>Last, <a href="x">with a link</a> in it.</article>
<aside>Aside</aside><section id="comments"><p>{LONG}</p></section><form><p>Sign up</p></form><footer>Bye</footer></body></html>"""


def test_article_without_the_rest():
    want = ["Title & more", LONG.strip(), "Short one ©’ bolder.", "first", "second", "Last, with a link in it."]
    assert html.main_text(PAGE) == "\n\n".join(want)


def test_page_without_article_element():
    page = f"""<body><div class="menu"><a href="/">Home</a></div><div><a href="/1">One</a> <a href="/2">Two</a></div>
    <h2>Heading</h2><p>{LONG}</p><p>A short one.</p><p>{LONG}</p><div>© 2020 by them</div><div><a href="/3">Three of the links here</a></div></body>"""
    assert html.main_text(page) == "\n\n".join(["Heading", LONG.strip(), "A short one.", LONG.strip()])


def test_broken_pages():
    assert html.main_text("plain text only") == "plain text only"
    assert html.main_text("<p>a < b and c</p><p") == "a < b and c"
    assert html.main_text("<article><p>one<p>two") == "one\n\ntwo"
    assert html.main_text("<article><p>one</p><!-- open <p>two") == "one"
    assert html.main_text("<article><p>one</p><script>open <p>two") == "one"
    assert html.main_text("<nav><a>x</a></nav>") == ""
    assert html.main_text("<" * 20000) == "<" * 20000


def test_names_that_only_hold_a_known_word_and_inline_elements_stay():
    page = f'<article><p>Text with <span class="share">42 percent</span> of it.</p><div class="related-work">Related work is here.</div><p class="notice-of-award">The award.</p><div class="related-posts">Other posts</div><div class="ad-slot-2">Buy</div><p>Seen <span hidden>not</span> here.</p><h2 class="banner">Head</h2><p>{LONG}</p></article>'
    assert html.main_text(page) == "\n\n".join(["Text with 42 percent of it.", "Related work is here.", "The award.", "Seen here.", "Head", LONG.strip()])


def test_parts_of_an_article_with_doubtful_names():
    links = '<div class="related"><a href="/1">One other page of the site</a> <a href="/2">Two other pages of the site and more</a> of it</div>'
    page = f'<body><nav>Menu</nav><article><h2 id="discussion">Discussion</h2><section class="discussion"><p>{LONG}</p><p>Yes.</p></section><div class="box recommended">Recommended dose is 5 mg.</div><p class="social">Social life of bees.</p><p class="widget">A widget.</p><p>Energy holds: <math><mi>E</mi></math> is it.</p>{links}<p>{LONG}</p><p>So.</p><p>It.</p></article><footer>Bye</footer></body>'
    assert html.main_text(page) == "\n\n".join(["Discussion", LONG.strip(), "Yes.", "Recommended dose is 5 mg.", "Social life of bees.", "A widget.", "Energy holds: E is it.", LONG.strip(), "So.", "It."])


def test_very_deep_and_very_long_pages():
    import time

    began = time.time()
    assert html.main_text("<div>" * 30000 + f"<p>{LONG}</p>" + "</section>" * 30000 + "</div>" * 30000) == LONG.strip()
    assert len(html.main_text(f"<article>{'<p>word</p>' * 50000}</article>")) == 6 * 50000 - 2
    assert time.time() - began < 30


def test_pages_without_article_give_the_same_text(spark):
    """Labelled comparison: the article element is the label, and pages are read again with divs in its place."""
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    from collections import Counter

    same = missed = extra = 0
    for r in spark.read.parquet(f"{DATA}/pages.parquet").where("html is not null").collect():
        want = Counter(html.main_text(r.html).split())
        got = Counter(html.main_text(r.html.replace("<article", "<div").replace("</article", "</div")).split())
        same += (want & got).total()
        missed += (want - got).total()
        extra += (got - want).total()
    print("recall", same / (same + missed), "precision", same / (same + extra))
    assert same / (same + missed) >= 0.95 and same / (same + extra) >= 0.95


def test_table(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (1, "u", PAGE), (None, "w", "<p>x</p>"), (4, "l", f"<article>{'<p>word</p>' * 20000}</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(3))
    got = html.extract_pages(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got if r.page_id in (2, 3, None)} == {2: "", 3: "", None: "x"}
    assert [len(r.text) for r in got if r.page_id == 4] == [6 * 20000 - 2]
    assert html.extract_pages(pages.limit(0)).count() == 0
