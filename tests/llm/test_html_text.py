from __future__ import annotations

import html
import re

import pytest

from tidegauge.llm import html_text, queries
from tidegauge.llm.html_text import main_text

LINE = "A sentence with enough words, commas, and other things to count as a paragraph of text."


def soup(inside: str, around: str = "") -> str:
    return f"<html><head><title>t</title><style>p {{}}</style></head><body>{around}{inside}</body></html>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), (None, ""), (" \n", ""), ("plain", "plain"), ("<p>only", "only"), ("a < b &amp; c", "a < b & c"),
        ("<p>a<br>b</p>&nbsp;c  d", "a b\nc d"), ("<table><tr><td>a<td>b</table>", "a\nb"),
        ("<p>&#x41;&eacute;&lt;p&gt;</p>", "Aé<p>"), ("<p>x<!-- y --><script>'</p>'</script>z</p>", "xz"),
        ("<p>x<b>y<i>z</p><p>w", "xyz\nw"), ("<ul><li>one<li>two</ul>", "one\ntwo"), ("<p>a</p></div></b>b", "a\nb"),
    ],
)
def test_small_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "junk",
    [
        f"<nav><p>{LINE * 4}</p></nav>", f"<header><p>{LINE}</p></header>", f"<footer><p>{LINE * 9}</p></footer>",
        f"<aside><p>{LINE * 9}</p></aside>", f"<form><p>{LINE}</p><input value=x></form>", f"<div class='ad-slot'>{LINE}</div>",
        f"<div id=sidebar><p>{LINE * 9}</p></div>", f"<div class='cookie-notice'><p>{LINE * 9}</p></div>",
        f"<section id=comments><article class=comment><p>{LINE * 9}</p></article></section>", f"<script>{LINE}</script>",
        f"<div class=userComments><p>{LINE * 20}</p></div>", f"<div role=navigation>{LINE}</div>", f"<div hidden>{LINE}</div>",
        "<ul class=x><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul>", f"<div style='display:none'>{LINE}</div>",
        f"<div class='related-posts'><p>{LINE}</p></div>", f"<noscript><p>{LINE}</p></noscript>",
    ],
)
@pytest.mark.parametrize("inside", [False, True])
@pytest.mark.parametrize("shell", ["<article>%s</article>", "<div class=content>%s</div>", "<main><div>%s</div></main>"])
def test_what_is_no_article_goes(junk, inside, shell):
    body = f"<h1>Title</h1><p>{LINE}</p><p>Short.</p><p>{LINE} {LINE}</p>"
    want = f"Title\n{LINE}\nShort.\n{LINE} {LINE}"
    page = soup(shell % (body + junk)) if inside else soup(shell % body, junk)
    assert main_text(page) == want


def test_a_short_article_beats_long_surroundings():
    assert main_text(soup("<article><p>Few words.</p></article>", f"<div><p>{LINE * 5}</p></div>")) == "Few words."


def test_siblings_with_a_good_score_stay():
    page = soup(f"<div class=wrap><div><p>{LINE * 8}</p></div><div><p>{LINE * 6}</p><p>{LINE * 6}</p></div></div>")
    assert main_text(page).count(LINE) == 20


def test_depth_and_length():
    assert main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert len(main_text("<article>" + f"<p>{LINE}</p>" * 5000 + "</article>")) == 5000 * (len(LINE) + 1) - 1
    assert main_text("<" * 2000) == "<" * 2000
    main_text("<p a='" * 2000)


def test_op1(spark, folder):
    def want(page):
        inner = page[page.index("<article>") :].split("</article>")[0]
        blocks = re.split(r"</?(?:p|h1|article)>", inner)
        return "\n".join(filter(None, (" ".join(html.unescape(re.sub("<b>|<br>", "", x)).split()) for x in blocks)))

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = queries.op1_main_text(spark, folder)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r["text"], r["url"]) == (want(pages[r["page_id"]]["html"]), pages[r["page_id"]]["url"])
        assert r["n_chars"] == len(r["text"])


def test_odd_rows(spark):
    rows = [(1, None, "x", 3), (None, "<p>a</p>", None, 4), (1, None, "x", 3)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id int, html string, text string, n_chars int"))
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "", 0), (1, "", 0), (None, "a", 1)]
    assert html_text.extract(spark.createDataFrame([], "page_id int, html string")).count() == 0
