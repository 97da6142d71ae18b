import random
import re
import time
from html import unescape

import pytest

from tidemark.llm.html_extract import main_text, parse
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = "It rained all day, so we stayed at home, read the papers, and waited for news of the boat that had not come in."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>Title</title>{head}</head><body>{body}</body></html>"


def article_blocks(html):
    """Blocks of pages as plain as those of the test tables: no block in another but in the article."""
    inner = re.search(r"<article>(.*?)</article>", html, re.DOTALL)[1]
    blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_table(spark):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = QUERIES["op11_html_extract"](spark, SF).collect()
    assert {r.page_id: r.text for r in found} == {i: article_blocks(h) for i, h in html.items()}
    assert all(r.n_chars == len(r.text) for r in found)


NOISE = {
    "menu": "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News, sport, weather</a></ul></nav>",
    "header": "<header><p>The Daily Example, founded long ago, read by many, printed each morning before dawn in town.</p></header>",
    "footer": "<footer><p>Copyright, all rights reserved, no part may be copied, printed, or stored without leave from us.</p></footer>",
    "sidebar": f'<div class="col sidebar"><p>{LONG} Not this.</p></div>',
    "aside": f"<aside><p>{LONG} Not this.</p></aside>",
    "notice": '<div id="cookie-notice"><p>We use cookies, as all do, to learn what you read, when, and for how long you do so.</p><button>Yes</button></div>',
    "advert": f'<div class="ad"><p>{LONG} Buy now.</p></div>',
    "advert by camel case": f'<div id="adSlot3"><p>{LONG} Buy now.</p></div>',
    "form": "<form action=/s><label>Your name, please</label><input name=q value='typed, text'><select><option>One, two<option>Three</select><textarea>Write, here</textarea></form>",
    "comments": f'<section class="comments"><h2>Comments</h2><article class="comment"><p>{LONG} I agree, fully, with all of it, every word, and more.</p></article></section>',
    "script": '<script>var x = "</p><p>not, this, either</p>"; if (1 < 2) f();</script>',
    "style": "<style>p > a { color: red }</style>",
    "comment": "<!-- <p>not, this</p> -->",
    "hidden": f'<div style="display: none"><p>{LONG}</p></div><p hidden>{LONG}</p>',
    "role": f'<div role="complementary"><p>{LONG}</p></div>',
    "noscript": "<noscript><p>Please, turn on scripts.</p></noscript><iframe>old, text</iframe><svg><text>x</text></svg>",
    "links": "<ul><li><a href=1>One more, story</a></li><li><a href=2>Another, story</a></li><li><a href=3>A third</a></li></ul>",
}
TEXT = [f"First. {LONG}", f"Second. {LONG}", "Short.", f"Fourth. {LONG}"]


@pytest.mark.parametrize("container", ["article", "main", 'div class="post-content"', 'div id="x1"', "table><tr><td"])
@pytest.mark.parametrize("kind", sorted(NOISE))
def test_leaves_out(kind, container):
    end = "".join(f"</{t}>" for t in reversed(re.findall(r"(?:^|<)([a-z]+)", container)))
    inner = "".join(f"<p>{t}</p>" for t in TEXT)
    assert main_text(page(f"{NOISE[kind]}<{container}>{inner}{end}{NOISE[kind]}")) == "\n".join(TEXT)


@pytest.mark.parametrize("kind", sorted(set(NOISE) - {"header"}))
def test_leaves_out_within(kind):
    inner = "".join(f"<p>{t}</p>" for t in TEXT)
    assert main_text(page(f"<article>{inner}{NOISE[kind]}</article>")) == "\n".join(TEXT)


def test_keeps_all_of_an_article():
    body = f"<main><article><header><h1>Head &amp; line</h1></header><section><h2>One</h2><p>{LONG}</p></section><section><h2>Two</h2><p>Few.</p><ul><li>a, b</li><li>c</li></ul><blockquote>said <i>he</i></blockquote><pre>x\n  y</pre><table><tr><td>1</td><td>2</td></tr></table><figure><img src=x><figcaption>Caption</figcaption></figure></section></article></main>"
    assert main_text(page(body)) == f"Head & line\nOne\n{LONG}\nTwo\nFew.\na, b\nc\nsaid he\nx y\n1\n2\nCaption"


def test_siblings_of_the_best_container():
    body = f"<h1>Head</h1><div id=a><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div id=b><p>{LONG}</p></div><p>{LONG} End.</p><div id=c>Tiny</div>"
    assert main_text(page(body)) == f"Head\n{LONG}\n{LONG}\n{LONG}\n{LONG}\n{LONG} End."


def test_whole_page_in_a_form():
    assert main_text(page(f"<form id=aspnet><div><p>{LONG}</p><p>{LONG}</p><input value=x></div></form>")) == f"{LONG}\n{LONG}"


def test_names_that_say_something_of_others():
    assert main_text(page(f'<div class="content has-sidebar"><p>{LONG}</p></div>')) == LONG
    assert main_text(page(f'<div class="no-comments entry"><p>{LONG}</p></div>')) == LONG
    assert main_text(page(f'<div class="widget"><p>{LONG}</p></div>')) == LONG  # there is nothing else
    assert main_text(f'<html><body class="page-with-sidebar ad"><p>{LONG}</p>') == LONG


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("plain", "plain"),
        ("a < b, c", "a < b, c"),
        ("<p>one<p>two", "one\ntwo"),
        ("<p><b>one<br>1<p>two</b> three", "one 1\ntwo three"),
        ("<article><div>a<p>b</div>c", "a\nb\nc"),
        ("<p>&lt;b&gt; &eacute;&#8212;&#x41; &amp;amp; &nbsp; x &copy; &nosuch;", "<b> é—A &amp; x © &nosuch;"),
        ("<p>&am<b>p;</b>", "&amp;"),
        ("<p>a<i>b</i>c <b> d</b>", "abc d"),
        ("<p title='a > b' data-x=\"</p>\" y=1/>one", "one"),
        ("<p a=\"x>one", "one"),
        ("<p>one<p class=", "one"),
        ("<p>one<!-- two", "one"),
        ("<p>one<!---->two<!-->three", "onetwothree"),
        ("<p>one<script>two", "one"),
        ("<p>one</SCRIPT></nosuch></ p>two<?php x ?>", "onetwo"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<main><table><tr><td>a<td>b<tr><td>c<table><tr><td>d</table>e</table>f", "a\nb\nc\nd\ne\nf"),
        ("<head><title>t</title><p>one", "one"),
        ("<p>one</body></html>two", "onetwo"),
        ("<article></article>", ""),
        ("<h1>Only</h1>", "Only"),
        ("<p>日本語、本文。</p>", "日本語、本文。"),
    ],
)
def test_markup(html, text):
    assert main_text(html) == text


def test_long_and_deep_pages_take_linear_time():
    deep = "<div>" * 50_000 + f"<p>{LONG}"
    wide = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    odd = "<p><b><i>" * 20_000 + "</div></b>" * 20_000 + '<a b="' * 20_000
    begin = time.time()
    assert main_text(deep) == LONG
    assert main_text(wide).count("\n") == 19_999
    main_text(odd), main_text("<" * 200_000), main_text("<!" * 100_000), main_text("<li>" * 50_000), main_text("<a href=x>" * 50_000)
    assert time.time() - begin < 30


def test_any_bytes():
    draw = random.Random(1)
    parts = ["<", ">", "</", "p", "div", "article", " ", "class='ad'", '"', "'", "=", "<!--", "-->", "&amp;", "text, ", "<td>", "</table>", "<table>", "<a>", "</a>", "<script>", "</script>", "<form>", "\n", "é"]
    for _ in range(3_000):
        html = "".join(draw.choices(parts, k=draw.randrange(40)))
        tree = parse(html)
        assert all(p < i for i, p in enumerate(tree.parent))
        assert all(line == " ".join(line.split()) != "" for line in main_text(html).split("\n")) or main_text(html) == ""


def test_rows(spark):
    rows = [(1, "u", page(f"<p>{LONG}")), (1, "u", page(f"<p>{LONG}")), (None, None, None), (2, "", "")]
    from tidemark.llm.html_extract import extract

    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "5 AS points")
    found = extract(pages)
    assert found.columns == ["page_id", "url", "html", "points", "text"]
    assert sorted(r.text for r in found.collect()) == ["", "", LONG, LONG]
    assert extract(pages.limit(0)).collect() == []
