"""Hand-made pages and the chunks that they give."""

import random

import pytest

from graphloom.functions import html


def short(page, **kw):
    """Chunks as (kind, text), with level, rows or the image's three fields after them where there are any."""
    return [(c["kind"], c["text"], *([c["level"]] if c["level"] else []), *([c["rows"]] if c["rows"] else []), *([tuple(c["image"].values())] if c["image"] else [])) for c in html.chunks_of(page, **kw)]


def runs(page):
    return [[(r["text"], "".join(k[0] for k in html.STYLES if r[k])) for r in c["inline"]] for c in html.chunks_of(page) if c["inline"]]


P = "paragraph"


@pytest.mark.parametrize(("page", "want"), [
    ("", []),
    ("  \n ", []),
    ("plain text", [(P, "plain text")]),
    ("<html><head><title>x</title><style>p{}</style></head><body><h5>Big</h5><p>one <b>two</b></p><ol><li>n</li></ol><ul><li>b</li></ul><script>no</script>tail</body></html>", [("heading", "Big", 3), (P, "one two"), ("numberedListItem", "n"), ("bulletListItem", "b"), (P, "tail")]),
    # structure that passes through
    ("<section>a<article>b</article><header>c</header></section> <nav>d</nav><footer>e</footer>", [(P, "abc de")]),
    ("a<p>b<p>c</p>d<div>e<div>f</div>g</div>h<br>i", [(P, x) for x in "abcdefghi"]),
    ("<blockquote>a</blockquote><pre>\n b\n  c</pre>", [(P, "a"), (P, "b c")]),
    # lists: the innermost kind, items that do not end, an item alone, text between items
    ("<ul><li>a<ol><li>b</ol><li>c</ul>after", [(P, "a"), ("numberedListItem", "b"), ("bulletListItem", "c"), (P, "after")]),
    ("<li>alone", [("bulletListItem", "alone")]),
    ("<ol>x<li>a</li>y</ol>z", [(P, "x"), ("numberedListItem", "a"), (P, "yz")]),
    ("<ul><li><p>a</p></li><li><p>b</p>c</li></ul>", [(P, "a"), (P, "b"), ("bulletListItem", "c")]),
    # images: a URL is needed, what machines say is no name
    ('<p>x<img src="u" alt="A screenshot of x">y<img alt="no"><img src=" " alt="n"></p>', [(P, "x"), ("image", "image-2", ("image-2", "image/png", "u")), (P, "y"), ("image", "n", ("n", "image/png", " "))]),
    ('<img src="data:image/gif;base64,R0" alt="  a  cat ">', [("image", "a  cat", ("a  cat", "image/gif", "data:image/gif;base64,R0"))]),
    ('<img src="u" alt="A dog. Description automatically generated"><img src="v">', [("image", "image-1", ("image-1", "image/png", "u")), ("image", "image-2", ("image-2", "image/png", "v"))]),
    # tables
    ("<table><tr><td>1</td><td>2</td></tr></table>", [("table", "1\t2", [["1", "2"]])]),
    ("a<table><tr><th>h<tr><td>1<td>2 <b>b</b><p>p</p>q<br>r<tr></table>b", [(P, "a"), ("table", "h\t\n1\t2 b\np\nq\nr", [["h", ""], ["1", "2 b\np\nq\nr"]]), (P, "b")]),
    ("<table><caption>c</caption><thead><td>x</thead><tbody><td>y</table>", [("table", "x\ny", [["x"], ["y"]])]),
    ("<table><tr><td>a<table><tr><td>in</table>z</table>", [("table", "ainz\nin", [["ainz"], ["in"]])]),
    ("<p>q<table>stray<tr><td>1</table>", [(P, "q"), (P, "stray"), ("table", "1", [["1"]])]),
    ("<table></table>x<td>cell<tr>y", [(P, "xcelly")]),
    ("<table><tr><td><ul><li>i</li><li>j</ul><h2>k</h2></table>", [("table", "i\nj\nk", [["i\nj\nk"]])]),
    # headings: what lies before the first break is the title
    ("<h1>a <i>b</i></h1><h2> </h2><h6>c</h6>", [("heading", "a b", 1), ("heading", "c", 3)]),
    ("<h1>a<br>b</h1>c", [(P, "a"), ("heading", "a", 1), (P, "c")]),
    ('<h2>a<img src="u">b</h2>', [(P, "a"), ("image", "image-2", ("image-2", "image/png", "u")), ("heading", "a", 2)]),
    ("<h1>a<h2>b</h2>", [("heading", "a", 1), ("heading", "b", 2)]),
    # entities, comments, white space that is not a break
    ("&copy;&nbsp;a &amp b&amp;lt;&#39;<!-- no -->c　d﻿", [(P, "© a & b&lt;'c d")]),
    ("<p>a</p></p>b<template>no</template><textarea>t</textarea>", [(P, "a"), (P, "bt")]),
    ("x</body>y<p>z", [(P, "xy"), (P, "z")]),
])
def test_pages(page, want):
    assert short(page) == want


def test_scripts():
    assert short("<body><script>no</script>x<style>p</style></body>") == [(P, "x")]
    assert short("<body><script>a < b</script></body>", keep_scripts=True) == [(P, "a < b")]


def test_runs():
    assert runs("a<b>b<i>c</i></b><u>d</u><s>e</s><code>f</code> <span>g</span>") == [[("a", ""), ("b", "b"), ("c", "bi"), ("d", "u"), ("e", "s"), ("f", "c"), (" g", "")]]
    assert runs("<strong>a</strong><b>b</b> <em>c</em><del>d</del><kbd>e</kbd><samp>f</samp>") == [[("ab", "b"), (" ", ""), ("c", "i"), ("d", "s"), ("ef", "c")]]
    # white space stays in runs
    assert runs("<p> a\n <b> b </b></p>") == [[(" a\n ", ""), (" b ", "b")]]
    # formatting goes on over blocks until it ends, an element that is none of it ends with its block
    assert runs("<p><b>a<p>b</b>c") == [[("a", "b")], [("b", "b"), ("c", "")]]
    assert runs("<p><del>a<p>b") == [[("a", "s")], [("b", "")]]
    assert runs("<b><p>a</b>b</p>c") == [[("a", "b"), ("b", "")], [("c", "")]]
    assert runs("<div><i>a</div>b</i>c") == [[("a", "i")], [("b", "i"), ("c", "")]]
    assert runs("<b><i>a</b>b</i>c") == [[("a", "bi"), ("b", "i"), ("c", "")]]
    # formatting of a cell ends with it
    assert runs("<table><tr><td><b>x</table>y") == [[("y", "")]]


def test_deep_and_broken_pages_end():
    assert short("<div>" * 3000 + "x" + "</div>" * 10) == [(P, "x")]
    assert short("<table><tr><td>" * 400 + "x")[0][0] == "table"
    rnd = random.Random(1)
    tags = ["p", "/p", "b", "/b", "i", "/i", "div", "/div", "table", "/table", "tr", "/tr", "td", "/td", "li", "/li", "ul", "/ul", "h1", "/h1", "a", "/a", "br", "img src=u", "body", "/body", "head", "title", "/title", "button", "/button", "caption", "template", "/template"]
    for _ in range(2000):
        page = "".join(rnd.choice([f"<{rnd.choice(tags)}>", rnd.choice("xyz ")]) for _ in range(rnd.randint(0, 40)))
        for c in html.chunks_of(page):
            assert c["kind"] == "table" or c["text"]


def test_table_of_pages(spark):
    pages = spark.createDataFrame([(1, "<p>a<b>b</b><table><tr><td>1</table><img src=u>", "k"), (2, None, "k"), (3, "", "k")], "page_id long, html string, kind string")
    rows = html.html_chunks(pages).orderBy("pos").collect()
    assert [(r.page_id, r.pos, r.kind, r.rows) for r in rows] == [(1, 0, P, None), (1, 1, "table", [["1"]]), (1, 2, "image", None)]
    assert rows[0].inline[1].bold and rows[2].image.url == "u" and html.html_chunks(pages.limit(0)).count() == 0


def test_plain_cells_are_taken_at_once(monkeypatch):
    """The same tree as tag by tag, wherever the cells stand, and no call for each of them."""
    seen = []
    monkeypatch.setattr(html.Page, "handle_starttag", lambda self, tag, attrs, f=html.Page.handle_starttag: (seen.append(tag), f(self, tag, attrs))[1])
    page = "<table>" + "".join(f"<tr>{''.join(f'<td>w{k}</td>' for k in range(50))}</tr>" for _ in range(20)) + "</table>"
    assert html.tables_of(page) == [[[f"w{k}" for k in range(50)]] * 20] and seen.count("td") == 0
    rnd = random.Random(4)
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>a</td>", "<td></td><td> b  c\n</td>", "<td>&amp;</td>", "<td>x", "</td>", "<b>", "</b>", "<p>", "text", "<script>", "</script>", "<!--", "-->", "<a title='", "'>", "<tbody>", "<td>y</td><td>z</td>", "<title>", "</title>", "<th>h</th>", "<pre>\n", "<template>", "</template>", "<"]
    pages = ["".join(rnd.choices(bits, [6, 2, 8, 4, 8, 5, 2, 2, 2, 2, 2, 2, 3, 0.3, 1, 0.3, 1, 0.3, 1, 2, 8, 0.3, 1, 2, 1, 0.3, 1, 0.5], k=rnd.randint(1, 40))) for _ in range(3000)]
    got = [html.chunks_of(p) for p in pages]
    monkeypatch.setattr(html, "_PLAIN_CELLS", html.re.compile("(?!)"))
    assert got == [html.chunks_of(p) for p in pages] and sum(any(c["rows"] for c in g) for g in got) > 1000
