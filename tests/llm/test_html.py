from __future__ import annotations

from kelpline.llm.html import blocks
from kelpline.llm.sitetree import main_text, style_tree

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><article><h1>Head {0}</h1><p><b>First &amp; {0}.<br><p>Second
 line&nbsp;{0}</p><div class="share-buttons">Share</div><ul><li>one {0}<li>two {0}</ul></article><section id="comments"><p>Nice post!</p></section><form><p>Mail</p></form>
<aside>Side</aside><footer>&copy; Site</footer></body></html>"""


def test_blocks_and_templates(spark):
    rows = [(i, f"https://www.site{i % 2}.org/p/{i}", PAGE.format(i)) for i in range(30)]
    got = {x.page_id: x for x in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(30):
        assert got[i].text == f"Head {i}\n\nFirst & {i}.\n\nSecond line {i}\n\none {i}\n\ntwo {i}" and got[i].n_chars == len(got[i].text)


def test_repeated_branches_without_names_are_cut(spark):
    """No element says what it is: the repeated lines go, the changing ones stay."""
    rows = [(i, "http://h.org/x", f"<div><div>Always the same menu</div><div><div>Text number {i} of the page</div></div><div>Also always here</div></div>") for i in range(40)]
    rows += [(100, "http://small.org/", "<div>Only page of its host</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in main_text(pages).collect()}
    assert all(got[i] == f"Text number {i} of the page" for i in range(40)) and got[100] == "Only page of its host"
    assert {x.page_id: x.text for x in main_text(pages, held=0).collect()} == got
    assert style_tree(pages).count() == 3  # both repeated lines have one style path


def test_odd_rows(spark):
    rows = [(1, None, None, 1, "x"), (2, "::bad::", "", 2, "x"), (None, "http://a", "<p>x", 3, "y"), (4, "http://a", "a < b & c &lt;p&gt; &#x41; &unknown; <p", 4, "z"), (4, "http://a", "<b>" * 5000 + "deep", 4, "z"), (5, "http://[bad", "<script>never", 1, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host long, path string")
    got = [(x.page_id, x.text) for x in main_text(pages).collect()]
    assert sorted(got, key=str) == sorted([(1, ""), (2, ""), (None, "x"), (4, "a < b & c <p> A &unknown; <p"), (4, "deep"), (5, "")], key=str)
    assert main_text(pages.limit(0)).collect() == []


def test_entities_and_unclosed_elements():
    page, _ = blocks("<p>a<p>b<table><tr><td>c<td>d<tr><td>e</table><!-- x --><pre>  f\n g </pre>tail")
    assert [b.text for b in page] == ["a", "b", "c d", "e", "f g", "tail"]


def test_copies_of_a_page_do_not_cut_the_bodies_of_others(spark):
    """900 copies of one page and 100 others on a host, without names; and a host whose pages differ in a branch of their own only."""
    page = "<div><div>Always the same menu</div><section><div>Body {0} of a page</div></section></div>"
    rows = [(i, "http://h.org/x", page.format(min(i, 100))) for i in range(1000)]
    rows += [(2000 + i, "http://k.org/x", f"<div><p>Same body</p></div><nav>Menu {i}</nav>") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in main_text(pages).collect()}
    assert all(got[i] == f"Body {min(i, 100)} of a page" for i in range(1000))
    assert all(got[2000 + i] == "Same body" for i in range(20))
    assert {x.page_id: x.text for x in main_text(pages, held=0).collect()} == got


def test_long_and_deep_sources_take_time_in_proportion():
    import time

    began = time.process_time()
    page, _ = blocks("<a b " * 200_000)
    assert len(page) == 1
    assert [b.text for b in blocks("<div>" * 40_000 + "x")[0]] == ["x"]
    assert time.process_time() - began < 20


def test_names_within_an_article_are_read_whole(spark):
    """A title block, related work and a section of notices stay; share buttons and comments go."""
    html = """<article><div class="article-header"><h1>Title {0}</h1></div><p>Body {0}</p><div class="related-work"><p>Work {0}</p></div>
<section id="notices"><p>Notice {0}</p></section><div class="share-buttons">Share</div><div class="comment-list"><p>Nice {0}</p></div></article>"""
    rows = [(i, "http://h.org/", html.format(i)) for i in range(20)]
    got = {x.page_id: x.text for x in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\n\nBody {i}\n\nWork {i}\n\nNotice {i}" for i in range(20))
