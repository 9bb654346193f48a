"""The main text of pages: written out pages with known texts, and the driver's pages by their one article."""

import re
from html import unescape

import pytest

from tidemark.llm.html_text import extract, main_text

LOREM = "Some words follow here, as they do in any text, and go on for a good while until the line is long enough to count"


def paragraphs(n):
    return "".join(f"<p>{LOREM} {i}.</p>" for i in range(n)), [f"{LOREM} {i}." for i in range(n)]


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>if (a < b) document.write('<p>no</p>')</script></head><body>{body}</body></html>"


P3, T3 = paragraphs(3)
P9, T9 = paragraphs(9)
CHROME = '<div id="header"><a href="/">Home</a> Site name</div><div class="cookie-notice">We use cookies, and like them, very much, so please agree, as all do.</div>'
COMMENTS = '<section id="comments"><h2>Comments</h2><div class="comment"><p>First, I think, this is, in short, wrong.</p></div></section>'
CASES = {
    "semantic": (page(f"<header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></li></ul></nav><main><article><h1>Title</h1>{P3}</article><aside><p>{LOREM}</p></aside></main><footer>c</footer>"), ["Title", *T3]),
    "plain divs": (page(f'{CHROME}<div id="page"><div class="sidebar"><p>{LOREM}</p></div><div class="post-content"><h1>Title</h1>{P3}</div>{COMMENTS}</div>'), ["Title", *T3]),
    "wrapper named for its sidebar": (page(f'<div class="with-sidebar"><div class="content">{P3}</div><div class="sidebar"><p>{LOREM}</p></div></div>'), T3),
    "header in the article": (page(f'<article><header><h1>Title</h1><p>By someone</p></header>{P3}<footer>tags</footer></article>'), ["Title", *T3]),
    "comments in the article": (page(f"<article>{P3}{COMMENTS}</article>"), T3),
    "a page in a form": (page(f'<form action="/"><input name="x"><main>{P3}</main></form>'), T3),
    "subscription form": (page(f"<article>{P3}<form><p>Give us your address, please.</p><input></form></article>"), T3),
    "sections": (page(f"<div><div>{P3}</div><div>{P3}</div></div><div class=ad>{LOREM}, {LOREM}, {LOREM}</div>"), T3 + T3),
    "sections of an article": (page(f"<article><section>{P9}</section><section><p>Short.</p></section></article>"), [*T9, "Short."]),
    "one word beside a long advert": (page(f'<div class="ad">{LOREM}, {LOREM}, {LOREM}</div><article><p>Word.</p></article>'), ["Word."]),
    "unclosed": (f"<body><article><h1>A&amp;B<p>one<b>two<br>three<p>f<i>ou</i>r</b><ul><li>x<li>y</ul>z", ["A&B", "onetwo three", "four", "x", "y", "z"]),
    "references": ("<article><p>&lt;b&gt; &amp;amp; &#233;&#x20AC;&nbsp;x &nosuch; &amp y</p></article>", ["<b> &amp; é€ x &nosuch; & y"]),
    "comments and text of tags": ("<article><!-- <p>no</p> --><p>a<!-- x -->b < c</p><script>'<p>no</p>'</script><p>d</p></article>", ["ab < c", "d"]),
    "related links": (page(f'<article>{P3}<ul><li><a href="/1">One other text</a></li><li><a href="/2">Two other texts</a></li><li><a href="/3">Three</a></li></ul></article>'), T3),
    "link in a paragraph": (page(f'<article>{P3}<p><a href="/1">All of it is a link</a></p></article>'), [*T3, "All of it is a link"]),
    "menu by its links alone": (page(f'<div><a href="/1">One</a><a href="/2">Two</a><a href="/3">Three</a></div><div>{P3}</div>'), T3),
    "hidden": (page(f'<article>{P3}<p hidden>no</p><div style="display: none">no</div><p aria-hidden="true">no</p></article>'), T3),
    "heading before the container": (page(f'<div id="main"><h1>Title</h1><div class="x">{P3}</div></div>'), ["Title", *T3]),
    "table": (page(f"<article>{P3}<table><tr><td>a<td>b<tr><td>c</table></article>"), [*T3, "a", "b", "c"]),
    "nothing else": ("just text\n\n of a page", ["just text of a page"]),
    "script only": (page("<script>x</script>"), []),
    "cut in a tag": (f"<article><p>{LOREM}</p><p class='x", [LOREM]),
    "cut in a script": (f"<article><p>{LOREM}</p><script>var x = '<p>", [LOREM]),
    "empty": ("", []),
    "null": (None, []),
}


@pytest.mark.parametrize("name", CASES)
def test_page(name):
    html, want = CASES[name]
    assert main_text(html) == "\n\n".join(want)


def test_long_pages_take_linear_time():
    assert len(main_text("<div>" * 30_000 + "<p>deep")) == 4
    assert main_text("<a x=\"" * 60_000) == ""
    assert main_text("</p></x>" * 60_000 + "<p>end") == "end"
    assert main_text("<b>" * 40_000 + "<p>x</i>" * 4_000).count("x") == 4_000
    assert main_text("<" * 200_000) == "<" * 200_000


def test_pages_of_the_driver(spark, sf):
    """Each has one article of h1 and p with b and br: its blocks are the text."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = (" ".join(unescape(re.sub(r"</?br?>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        want = "\n\n".join(b for b in blocks if b)
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, want, len(want))


def test_edges(spark):
    rows = [(1, None, None, "x", 5), (1, None, None, "x", 5), (None, "u", "", None, None), (2, "u", "<p>a\x00퟿😀</p>", "y", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, `n chars` int")
    out = extract(pages)
    assert out.columns == ["page_id", "url", "n chars", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out.collect()) == [(0, "", 0), (1, "", 0), (1, "", 0), (2, "a\x00퟿😀", 4)]
    assert extract(pages.where("false")).count() == 0
