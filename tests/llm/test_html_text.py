"""Main text of hand-made pages, and of the pages table against its articles."""

from __future__ import annotations

import html
import re

import pytest

from riskloom.llm.html_text import extract, extract_pages
from riskloom.llm.queries import table

LONG = "This is a long sentence of the article that says something in many plain words. " * 3
PAGES = [
    (None, ""), ("", ""), ("  \n", ""), ("just text &amp; more", "just text & more"),
    (f"<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>{LONG}</p></article><footer>f</footer>", f"T {LONG}"),
    (f"<div class=sidebar><p>{LONG}</p></div><div><p>{LONG}</p><p>b&nbsp;c</p></div>", f"{LONG} b c"),
    (f"<main><p>{LONG}<p>second<ul><li>x<li>y</ul></main><section id=comments><p>{LONG}</section>", f"{LONG} second x y"),
    (f"<article><p>{LONG}<b>bold</b>er<br>next</p><form>{LONG}<button>go</button></form><script>{LONG}</script></article>", f"{LONG}bolder next"),
    (f"<div><div class='cookie-notice'>{LONG}</div><div class=post><p>{LONG}</p></div></div>", LONG),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("</div></p><p>ok</i>", "ok"), ("<p>cut &am", "cut &am"),
    ("<div>" * 3000 + "deep", "deep"), ("<p>" + "word " * 100_000 + "</p>", "word " * 100_000), ("<script>only()</script>", ""),
]


@pytest.mark.parametrize("page, text", PAGES, ids=range(len(PAGES)))
def test_pages(page, text):
    assert extract(page) == " ".join(text.split())


def test_articles_of_the_table(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S).group(1)
        want[r["page_id"]] = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
    got = extract_pages(pages).collect()
    assert {r["page_id"]: r["text"].split() for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_nulls_and_other_columns(spark):
    rows = [(None, None, None, 1), (1, "u", "<p>a</p>", 2), (1, "u", "<p>a</p>", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(map(repr, (tuple(r) for r in extract_pages(pages).collect())))
    assert got == sorted(map(repr, [(None, None, "", 0), (1, "u", "a", 1), (1, "u", "a", 1)]))
    assert extract_pages(pages.limit(0)).count() == 0


def _section(tag, name, paragraphs=5):
    return f"<{tag}><h2>{name}</h2>" + "".join(f"<p>{name} {i} {LONG}</p>" for i in range(paragraphs)) + f"</{tag}>"


MENU = "<div>" + "".join(f"<a href=/{i}>Place {i}</a> " for i in range(12)) + "</div>"
WHOLE = [
    ("<body><nav>n</nav><article><h1>Title</h1>" + "".join(_section("section", x) for x in "ABC") + "</article></body>", "ABC"),
    ("<body>" + MENU + "<div><h1>Title</h1>" + "".join(_section("div", x) for x in "ABCDE") + "</div></body>", "ABCDE"),
    ("<body>" + MENU + "<h1>Title</h1>" + _section("div", "A") + MENU + _section("div", "B", 3) + _section("div", "C") + "</body>", "ABC"),
]


@pytest.mark.parametrize("page, names", WHOLE, ids=range(len(WHOLE)))
def test_pages_of_several_sections(page, names):
    want = "Title"
    for x in names:
        n = 3 if (x == "B" and "B 3" not in page) else 5
        want += f" {x} " + " ".join(f"{x} {i} {LONG.strip()}" for i in range(n))
    assert extract(page) == want


def test_names_of_furniture():
    """A word in a longer name, or the name of a paragraph, is no furniture."""
    for around in ("<div class='share-price'>{}</div>", "<div class=commentFree>{}</div>", "<div><p class=notice>{}</p></div>"):
        assert extract(f"<div><p>{LONG}</p>" + around.format(f"kept {LONG}") + "</div>") == f"{LONG}kept {LONG}".strip()
    for name in ("site-header", "ad", "x adBox", "nav_menu"):
        assert extract(f"<div><p>{LONG}</p><div class='{name}'>{LONG}</div></div>") == LONG.strip()
