import html as entities
import re

from pyspark.sql import functions as F

from sonarmill.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><p>tagline</p></header>
<nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div><div class="page-wrap"><main>
<article class="post-12 no-comments"><h1>Title &amp; more</h1><p>First <b>para</b>&nbsp;with
 <a href="#">a link</a>.<p>Second<br>line<script>var a = "</p>";</script></p><aside>By the way</aside><div class="ad">Buy</div>
<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><form><input><button>Go</button></form></article>
<section id="comments"><p>A reader's comment that is quite long, longer than much of the article itself, and yet no part of it.</p></section>
</main><div class=sidebar>More to read</div></div><footer>&copy; x</footer></body></html>"""


def test_article_without_the_rest():
    assert h.text_at(h.parse(PAGE), None) == "Title & more\nFirst para with a link.\nSecond line\none\ntwo\nc1\nc2"


def test_pages_without_structure():
    assert h.text_at(h.parse("plain &lt;text&gt;"), None) == "plain <text>"
    assert h.text_at(h.parse("<body><div>a<div>b</div>c</div>"), None) == "a\nb\nc"
    assert h.text_at(h.parse(""), None) == ""
    assert h.text_at(h.parse("<p>open <b>bold <p>next < 5 & 6 <x"), None).startswith("open bold\nnext < 5 & 6")
    assert h.text_at(h.parse('<div title="a > b">t</div><!-- c --><![CDATA[d]]>'), None) == "t"


def test_consensus_overrules_a_page(spark):
    normal = "<html><body><div class='box'><div class='body-7'><p>" + "real words in a row, more of them. " * 6 + "</p></div></div><div class='teaser'><p>short</p></div></body></html>"
    odd = "<html><body><div class='box'><div class='body-9'><p>Tiny real text.</p></div></div><div class='teaser'><p>" + "promoted words that outnumber the text. " * 9 + "</p></div></body></html>"
    rows = [(k, "http://Host.example/x", normal) for k in range(5)] + [(9, "https://u@host.example:80/y", odd), (10, "http://other.example", odd), (11, None, normal), (12, "http://host.example", None), (13, "http://host.example", "")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    for limit in (20_000, 0):
        got = {r["page_id"]: r for r in h.extract(pages, max_sent_hosts=limit).collect()}
        assert len(got) == len(rows)
        assert got[9]["text"] == "Tiny real text." and got[9]["n_chars"] == 15
        assert got[10]["text"].startswith("promoted")
        assert got[11]["text"].startswith("real words")
        assert got[12]["text"] == got[13]["text"] == "" and got[12]["n_chars"] == 0
    assert h.extract(pages.limit(0)).count() == 0


def test_long_and_repeated_pages_and_ties_of_paths(spark):
    long = "<html><body><article><p>" + "words in a very long page. " * 40_000 + "</p></article></body></html>"
    one, two = (f"<html><body><div class='{c}'><p>{'some real words, told at length. ' * 8}</p></div></body></html>" for c in ("alpha", "beta"))
    rows = [(1, "http://a.example", long), (2, "http://a.example", long), (2, "http://a.example", long), (3, "http://b.example", one), (4, "http://b.example", two), (None, None, one)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["n_chars"], len(r["text"])) for r in h.extract(pages).collect()), key=str)
    n, m = len("words in a very long page. " * 40_000) - 1, len("some real words, told at length. " * 8) - 1
    assert got == sorted([(1, n, n), (2, n, n), (2, n, n), (3, m, m), (4, m, m), (None, m, m)], key=str)
    paths = {r["host"]: r["path"] for r in h.host_paths(pages.selectExpr("*", "coalesce(url, '') as host")).collect()}
    again = {r["host"]: r["path"] for r in h.host_paths(pages.orderBy(F.desc("page_id")).selectExpr("*", "coalesce(url, '') as host")).collect()}
    assert paths == again  # of tied paths the least by name


def test_supplied_pages(spark, small):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in h.op1_main_text(spark, small).collect():
        body = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))
        want = [" ".join(entities.unescape(re.sub("<[^>]+>", "", b)).split()) for b in blocks]
        assert r["text"] == "\n".join(filter(None, want)) and r["n_chars"] == len(r["text"])
