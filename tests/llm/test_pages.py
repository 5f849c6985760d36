from __future__ import annotations

import random

import pytest

from cohortwise.llm import pages

TEMPLATE = """<!DOCTYPE html><html lang="en"><head><title>T t</title><style>p{{}}</style><script>var t="</p><p>no";</script></head>
<body><nav><ul><li><a href="/a">menu one</a><li><a href='/b>c'>two</a></ul></nav><!-- <p>hidden</p> -->
<div class="ad">Buy this now please</div>{open}<h1>Head &amp; line</h1>{body}{close}
<section class="comments"><p>reader says hello there and much more</p></section><aside>side words</aside>
<form><label>Name</label><input value="x>y"><button>Go</button></form><div id="cookie-notice">we use cookies</div>
<footer>&copy; all rights</footer></body></html>"""
PARAGRAPHS = ["<p>One  two\n three &lt;b&gt; &#233;&nbsp;x</p>", "<p><b>bold</b>er word<br>next<p>unclosed &hellip;", "<p>" + "many words here " * 30 + "</p>",
              "<div class='ad'>advert in it</div>", "<script>if (a<b) {}</script>", "<p>last 1 < 2 ok</p>"]
TEXT = "\n".join(["Head & line", "One two three <b> é x", "bolder word next", "unclosed …", ("many words here " * 30).strip(), "last 1 < 2 ok"])


def page(open_="<article>", close="</article>"):
    return TEMPLATE.format(open=open_, close=close, body="".join(PARAGRAPHS))


@pytest.fixture
def table(spark):
    rng = random.Random(2)
    rows = [(i, f"http://x/{i}", page() if i % 3 else TEMPLATE.format(open="<article>", close="", body="".join(rng.sample(PARAGRAPHS, 4)))) for i in range(30)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_article_with_and_without_the_element(table):
    weights = pages.learn(table)
    assert pages.extract(page(), weights) == TEXT
    assert pages.extract(page("<div>", "</div>"), weights) == TEXT
    assert pages.extract(page("<main>", "</main>"), {}) == TEXT
    assert pages.extract(page("<ARTICLE id=x>", "</ARTICLE>"), {}) == TEXT


PLAIN = "<p>" + "plain words of a page " * 20 + "</p>"


@pytest.mark.parametrize("before, after", [
    ("<article class='post category-legal'>", "</article>"), ("<main class='no-sidebar'>", "</main>"), ("<main class='sidebar'>", "</main>"),
    ("<div id='content-with-sidebar'>", "</div>"), ("<form id=aspnet action=/>", "</form>"), ("<form><article class=legal>", "</article></form>"),
    ("<div class='sidebar'><div>", "</div></div>"), ("<body class='modal'><section class='header'><main>", "</main></section>")])
def test_names_of_boilerplate_around_the_main_text(table, before, after):
    whole = f"<html><body>{before}{PLAIN}<div class='ad'>Buy now</div>{after}<div class='cookie-notice legal'>we use cookies</div><nav>a b</nav></body></html>"
    sidebars = [page().replace("<aside>", "<div class='sidebar'>go here</div><div class='legal'>rights</div><aside>")] * 9
    learned = pages.learn(table.union(table.sparkSession.createDataFrame([(500 + i, "u", p) for i, p in enumerate(sidebars)], table.schema)))
    assert learned["div.sidebar"] < 0 and learned["div.ad"] < 0
    for weights in ({}, learned):
        assert pages.extract(whole, weights) == ("plain words of a page " * 20).strip()
    assert sum(n for (k, inside), n in pages.count(whole).items() if inside and k == "p") == (100 if "<article" in before else 0)


def test_rows_of_all_kinds(spark, table):
    odd = [(100, "u", None), (101, None, ""), (102, "u", "<p"), (103, "u", "plain text\n only"), (104, "u", "<script>x"), (104, "u", "<script>x"),
           (None, "u", "<p>" + "w " * 300_000), (105, "u", "<!-- never closed <p>x</p>"), (106, "u", "a < b & c &bogus; &#x41;"), (107, "u", "<nav>menu</nav>")]
    frame = table.limit(2).union(spark.createDataFrame(odd, table.schema)).selectExpr("*", "1 as text", "'z' as __tag")
    found = {(r.page_id, r.url): r for r in pages.main_text(frame, pages.learn(table)).collect()}
    text = {i: found[i, u].text for i, u, _ in odd}
    assert text == {100: "", 101: "", 102: "", 103: "plain text only", 104: "", None: ("w " * 300_000).strip(), 105: "", 106: "a < b & c &bogus; A", 107: ""}
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_no_labelled_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert pages.learn(empty) == {} and pages.main_text(empty, {}).count() == 0


def test_query_finds_the_articles_of_the_given_pages(spark):
    """Articles of the given tables against a plain reading of their one template."""
    import html
    import re

    from cohortwise.llm.queries import op6_html_extraction

    folder = "/root/testdata/sf0.001"
    source = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in op6_html_extraction(spark, folder).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)
