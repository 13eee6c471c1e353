"""Main text of pages: whole tables against plain expressions, and pages made by hand."""

from __future__ import annotations

import html
import re

import pytest
from fixtures import DATA, clashing, rows_of
from pyspark.sql import functions as F

from offerlens.llm import html_text, queries

PROSE = "The first sentence of this text is long enough, has a comma, and says something that a reader would read."
MENU = "".join(f'<li><a href="/{i}">entry number {i}, with a comma</a></li>' for i in range(20))


def by_hand(source):
    """The given pages hold one article element, whose blocks are h1 and p."""
    inner = re.search(r"<article>(.*?)(?:</article>|<footer>)", source, re.S)[1].replace("<br>", " ")
    texts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner))
    return "\n".join(t for t in texts if t)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_all_pages(spark):
    pages = spark.read.parquet(str(DATA.parent / "sf0.01/pages.parquet"))
    got = rows_of(queries.op11_html(spark, str(DATA.parent / "sf0.01")), "page_id", "url", "text", "n_chars")
    assert got == sorted(((r.page_id, r.url, t := by_hand(r.html), len(t)) for r in pages.collect()), key=repr)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""),
        ("", ""),
        (" \n ", ""),
        ("plain text", "plain text"),
        ("<nav><a href=x>only a menu</a></nav><div class=ad>Buy, buy, buy.</div>", ""),
        (f"<ul>{MENU}</ul>", ""),
        (f"<div id=nav><ul>{MENU}</ul></div><div id=main><h1>Title</h1><p>{PROSE}<p>Short.</div><div id=comments><p>{PROSE * 9}</div>", f"Title\n{PROSE}\nShort."),
        (f"<div><div class=part><p>{PROSE}</p></div><div class=part><p>{PROSE}</p></div></div>", f"{PROSE}\n{PROSE}"),
        (f"<article><header><h1>A &amp; B</h1></header><p>{PROSE}</p><aside>More, more.</aside><footer>By me.</footer></article><footer>&copy; us</footer>", f"A & B\n{PROSE}"),
        (f"<nav><ul>{MENU}<article><p>{PROSE}</p></article>", PROSE),
        (f"<article><p>one<br>two&nbsp; three</p><p>a<br><br>b</p><table><tr><td>1<td>2<tr><td>3</table><pre> x\n  y </pre><p>{PROSE}</article>", f"one two three\na\nb\n1\n2\n3\nx y\n{PROSE}"),
        (f"<article><p>so <span class=ad>Buy</span>it <script>'<p>no</p>'</script>is &lt;b&gt; &#x41;&#66;<style>p{{}}</style></p><p>{PROSE}<!-- <p>gone</p> --></p><form><p>Send, {PROSE}</form>", f"so it is <b> AB\n{PROSE}"),
        (f"<article><p title='a > b' class=\"x\">{PROSE}</b></i></div><p>2 < 3 and 4 > 1<p>{PROSE}<div", f"{PROSE}\n2 < 3 and 4 > 1\n{PROSE}"),
        (f"<body><div class=cookie-notice>We use, and keep, cookies.</div><div class='content-with-sidebar'><p>{PROSE}</p><ul>{MENU}</ul></div><div class=sidebar>{PROSE}</div>", PROSE),
        (f"<article><p>{PROSE}</p></article><article class=comment><p>{PROSE}</p></article>", PROSE),
        (f"<ARTICLE><P>{PROSE}<SCRIPT>never closed <p>", PROSE),
    ],
)
def test_by_hand(source, want):
    assert html_text.main_text(source) == want


def test_long_deep_and_broken_pages():
    assert html_text.main_text("<div>" * 20_000 + PROSE).endswith(PROSE)
    assert html_text.main_text("<article>" + f"<p>{PROSE}" * 5_000) == "\n".join([PROSE] * 5_000)
    assert html_text.main_text("<p " * 20_000) == ""
    assert html_text.main_text("<article><p>" + "<b>" * 20_000 + "deep") == "deep"


def test_awkward_table(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>x, y"), (2, "v", "")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(1))
    assert rows_of(html_text.extracted(pages), "*") == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "x, y", 4), (2, "v", "", 0)], key=repr)
    assert html_text.extracted(pages.limit(0)).count() == 0
