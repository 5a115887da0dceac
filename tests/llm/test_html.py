"""HTML extraction: expected texts of broken and odd pages, marginals by brute force, linear time."""

import itertools
import math
import random
import time

import numpy as np
import pytest

from waymark.llm import html_extract
from waymark.llm.html_extract import Model, Page, count

PAGE = '<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><article><h1>H &amp; h</h1><p>One\n <b>two</b><br><p>Three&nbsp;&lt;x&gt; and so on</article><div class="ad">Buy</div><footer>End</footer>'


@pytest.fixture(scope="module")
def model():
    return Model(count([PAGE] * 50))


@pytest.mark.parametrize(
    ("inside", "want"),
    [
        ("<p>One <svg/> two</p><p>Three</p>", "One two\nThree"),
        ("<p>One <svg><title>no</title><text>no</text></svg> two</p><p>Three</p>", "One two\nThree"),
        ("<p>One</p><svg><path d=x><p>Two</p>", "One\nTwo"),
        ("<p>One</p><select><option>no<p>Two</p><p>Three</p>", "One\nTwo\nThree"),
        ("<p>One</p><select><option>no</select><p>Two</p>", "One\nTwo"),
        ("<p title=it's>One</p><p>Two</p><p>don't</p><p>Three >", "One\nTwo\ndon't\nThree >"),
        ('<p title="a > b" class=\'x\'>One</p><p a="open>Two</p><p>Three</p>', "One\nTwo\nThree"),
        ("<p>One <math><mi>x</mi><mo>=</mo><mn>2</mn></math> two</p>", "One x=2 two"),
        ("<p>One</p><noscript><p>Two</p></noscript><p>Three</p>", "One\nTwo\nThree"),
        ("<p>One <object data=x>two</object></p>", "One two"),
        ("<p>One</p><video><p>no player</p></video><p>Two</p>", "One\nTwo"),
        ("<p>One</p><video src=x><p>Two</p>", "One\nTwo"),
        ("<p>One</p><iframe src=x><p>Two</p>", "One\nTwo"),
        ("<p>One</p><textarea>no</textarea><p>Two</p>", "One\nTwo"),
        ("<p>a < b and <3 but <!-- no --> c<!> d</p>", "a < b and <3 but c d"),
        ("<p>One <x-y>two</x-y> three</p>", "One two three"),
        ("</div></div><p>One</p></table></p><p>Two", "One\nTwo"),
        ("<table><tr><td>a<td>b<tr><td>c</table><p>One</p>", "a\nb\nc\nOne"),
        ("<ul><li>a<li>b</ul><p>One", "a\nb\nOne"),
        ("<h2>T</h2><ul><li>a<li>b</ul><blockquote>q</blockquote><pre>c</pre><div class=comments><p>No comment here at all, or a long one that goes on</p></div><form><p>never</p></form><aside><p>side</p></aside>", "T\na\nb\nq\nc"),
        ("<form><p>no</p></form><p>One</p><script>x</script  ><p>Two</p><style>p{", "One\nTwo"),
        ("<p>&#x4e2d;&amp;amp; &eacute;&nbsp;&nbsp;x</p>", "中&amp; é x"),
    ],
)
def test_no_text_is_lost(model, inside, want):
    tail = "" if "style>p{" in inside else "</article><footer>End</footer>"
    for page in (f"<html><body><nav><a href=x>Menu</a></nav><article>{inside}{tail}", f"<div class=nav><a href=x>Menu</a></div><main>{inside}"):
        assert model.text(page) == want


@pytest.mark.parametrize(("page", "want"), [("only  words\nstand here", "only words stand here"), ("One <b>two</b> &amp; three", "One two & three"), ("", ""), ("<p", ""), ("<!-- x", ""), ("<p>Hello world", "Hello world"), ("<html><body>Hello<br>plain text", "Hello plain text"), ("<div id=menu><a href=x>a</a></div><div><p>Some text.</p><ul><li>a<li>b</ul></div><div class=footer><p>End</p></div>", "Some text.\na\nb")])
def test_pages_without_an_article(model, page, want):
    assert model.text(page) == want


def test_boilerplate_goes(model):
    assert model.text(PAGE) == "H & h\nOne two\nThree <x> and so on"


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "</b></p></q>" * 1 + "</x>" * 100_000, "<p>a</i></p></div>" * 40_000, "<ul>" + "<div>" * 3000 + "<li>x" * 50_000, "<a <" * 100_000, "<p a=\"" * 60_000 + "'" * 9, "<title>" * 60_000, "<svg>" * 50_000 + "<p>x", "<video>" * 50_000 + "</video>", "<td>" * 50_000 + "</p>" * 50_000])
def test_linear_time(model, page):
    began = time.time()
    model.text(page)
    assert time.time() - began < 8


def test_marginals_by_brute_force():
    rng = random.Random(3)
    m = Model(count([PAGE] * 50))
    for _ in range(12):
        page = Page("".join(rng.choice(("<div>", "</div>", "<p class=ad>", "<p>", "text ", "<ul><li>", "<a>x</a>", "<article>", "</article>")) for _ in range(10)))
        n = len(page.parent)
        assert n <= 14
        own = [1 / (1 + math.exp(-max(-30, min(30, sum(m.node.get(f, 0) for f in x))))) for x in page.features()]
        sums, total = np.zeros(n), 0.0
        for z in itertools.product((0, 1), repeat=n - 1):
            z = (0, *z)
            w = math.prod((own[k] if z[k] else 1 - own[k]) * m.edge[page.regions()[k]][z[page.parent[k]]][z[k]] for k in range(1, n))
            total += w
            sums += w * np.array(z)
        assert np.allclose(m.marginals(page)[1:], (sums / total)[1:], atol=1e-6)


def test_rows(spark):
    """Null, empty and repeated pages, clashing columns, an empty table; counting by Spark is counting by hand."""
    schema = "page_id long, url string, html string, text string, feature string"
    rows = [(1, "u", PAGE, "x", "y"), (1, "u", PAGE, "x", "y"), (2, None, None, "x", "y"), (None, "v", "", "x", "y"), (3, "w", PAGE.replace("Menu", "Liste"), "x", "y")]
    pages = spark.createDataFrame(rows, schema)
    got = sorted((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in html_extract.extract(pages, Model(count([PAGE] * 50))).collect())
    want = "H & h\nOne two\nThree <x> and so on"
    assert got == [(0, "v", "", 0), (1, "u", want, len(want)), (1, "u", want, len(want)), (2, "", "", 0), (3, "w", want, len(want))]
    assert html_extract.train(pages).node == Model(count([PAGE, rows[4][2]])).node
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0


def test_all_pages_of_the_table(spark):
    """The query over its whole table: each page's text is that of its article's blocks, as the page states them."""
    import html
    import re

    from waymark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op8_html_extraction"](spark, sf).collect():
        (article,) = re.findall(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)
        parts = re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", article.replace("<br>", " "))
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
        assert r["text"] == "\n".join(x for x in blocks if x) and r["n_chars"] == len(r["text"])
