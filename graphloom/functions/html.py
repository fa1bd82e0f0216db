"""Web pages as typed chunks, in document order.

A page becomes a tree as browsers build it: end tags that are left out, formatting that goes
on across blocks, cells without rows, and text that strays between cells are put where the HTML standard puts
them. Every piece of text keeps the styles that hold where it stands. The tree is then read as a flow of texts, breaks,
images and tables, and the flow is cut into chunks at its breaks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import BOILERPLATE
from graphloom.functions.batches import pieces
from graphloom.session import reach_workers

STYLES = ("bold", "italic", "underline", "strike", "code")
#: The style that a tag gives.
STYLE_OF = {"strong": "bold", "b": "bold", "em": "italic", "i": "italic", "u": "underline", "s": "strike", "strike": "strike", "del": "strike", "code": "code", "kbd": "code", "samp": "code"}
#: Tags around which text breaks, and those within a cell.
BREAKS = frozenset("p div blockquote pre tr td br".split())
CELL_BREAKS = frozenset("p div br li ul ol pre blockquote h1 h2 h3 h4 h5 h6".split())

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup listing main menu nav ol pre search section summary ul".split())
CLOSES_P = BLOCKS | HEADINGS | frozenset("dd dt form hr li p plaintext table xmp".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
LIMITS = frozenset("applet body caption html marquee object table td template th".split())
SPECIAL = BLOCKS | HEADINGS | LIMITS | frozenset("button colgroup dd dt form iframe li noembed noframes noscript p script select style tbody textarea tfoot thead title tr".split())
GROUPS, CELLS = ("tbody", "thead", "tfoot"), ("td", "th")
IN_TABLE = ("table", *GROUPS, "tr")
SPACE = "[\t-\r    -     　﻿]"
_SPACES, _ENDS, _MACHINE = re.compile(f"{SPACE}+"), re.compile(f"^{SPACE}+|{SPACE}+$"), [re.compile(p) for p in BOILERPLATE]


#: Cells without attributes that hold text without references.
_PLAIN_CELLS = re.compile("(?:<td>[^<&\0]*</td>)+")


@dataclass
class Text:
    text: str
    styles: frozenset[str]


@dataclass
class Cells(Text):
    """Cells of a row that hold nothing but text."""

    cells: list[str]


@dataclass(eq=False)
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    parent: Element | None = None


class Page(HTMLParser):
    """Builds the body of a page as a tree of :class:`Element` and :class:`Text`."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.body = Element("body")
        self.open = [self.body]  # elements that are open, the innermost last
        self.active: list[Element | None] = []  # formatting that goes on; None where a cell began
        self.begun = self.fresh_pre = False
        self.take(html.replace("\r\n", "\n").replace("\r", "\n"))
        self.close()

    def take(self, html: str) -> None:
        """Feed a page. Runs of cells that hold nothing but text become elements at once where a row is open."""
        at = 0
        for run in _PLAIN_CELLS.finditer(html):
            self.feed(html[at : run.start()])
            at = run.start()
            if self.rawdata or self.cdata_elem is not None:
                break  # within a tag, a comment or a script
            if self.open[-1].tag != "tr":
                continue
            row = self.open[-1]
            # cells of a row are no break in the text of a cell around them, so that their text is one there
            styles = frozenset(STYLE_OF[e.tag] for e in self.open if e.tag in STYLE_OF)
            cells = run[0][4:-5].split("</td><td>")
            row.children.append(Cells("".join(cells), styles, cells))
            at = run.end()
        self.feed(html[at:])

    # where things are

    def within(self, tags, limits=LIMITS) -> int | None:
        """The place of the innermost open element with one of the tags, if no limit lies around it."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                return k
            if self.open[k].tag in limits:
                return None
        return None

    def leave(self, k: int | None) -> bool:
        """Close all from the k-th open element on."""
        if k is None:
            return False
        for element in self.open[k:]:
            if element.tag in ("td", "th", "caption", "applet", "marquee", "object") and None in self.active:
                del self.active[len(self.active) - 1 - self.active[::-1].index(None) :]
        del self.open[k:]
        return True

    def leave_p(self) -> None:
        self.leave(self.within(("p",), LIMITS | {"button"}))

    def put(self, node: Element | Text) -> None:
        """Add a node where text goes now: before the table, if that has no place for it."""
        parent = self.open[-1]
        if parent.tag in IN_TABLE and not (isinstance(node, Element) and node.tag in (*IN_TABLE, *CELLS, "caption", "colgroup", "col", "script", "style", "template")):
            table = next(e for e in reversed(self.open) if e.tag == "table")
            home = table.parent.children
            home.insert(next(k for k in range(len(home) - 1, -1, -1) if home[k] is table), node)
            parent = table.parent
        else:
            parent.children.append(node)
        if isinstance(node, Element):
            node.parent = parent

    def enter(self, tag: str, attrs: dict[str, str] | None = None) -> Element:
        element = Element(tag, attrs or {})
        self.put(element)
        if tag not in VOID:
            self.open.append(element)
        return element

    def resume(self) -> None:
        """Open formatting again that a block has closed."""
        k = len(self.active)
        while k and self.active[k - 1] is not None and not any(e is self.active[k - 1] for e in self.open):
            k -= 1
        for j in range(k, len(self.active)):
            self.active[j] = self.enter(self.active[j].tag, self.active[j].attrs)

    # what comes

    def handle_data(self, data: str) -> None:
        data = data.replace("\0", "")
        if self.fresh_pre:
            self.fresh_pre = False
            data = data.removeprefix("\n")
        if not data or not self.begun and not data.strip("\t\n\f\r "):
            return
        if self.open[-1].tag in HEAD and not self.begun:
            return
        self.begun = True
        blank = not data.strip("\t\n\f\r ")
        if blank and self.open[-1].tag in IN_TABLE:
            return
        if self.open[-1].tag not in ("script", "style", "title", "textarea", "template"):
            self.resume()
        self.put(Text(data, frozenset(STYLE_OF[e.tag] for e in self.open if e.tag in STYLE_OF)))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        held: dict[str, str] = {}
        for k, v in attrs:
            held.setdefault(k, v or "")
        self.fresh_pre = False
        if tag in ("html", "head"):
            return
        if tag == "body":
            self.begun = True
            return
        if not self.begun:
            if tag in HEAD:
                if tag not in VOID:
                    self.open.append(Element(tag))
                return
            self.leave(1 if len(self.open) > 1 else None)
            self.begun = True
        if tag == "image":
            tag = "img"
        if tag in ("caption", "colgroup", "col", *GROUPS, "tr", *CELLS):
            self.table_part(tag, held)
            return
        if tag in CLOSES_P:
            if tag in ("li", "dd", "dt"):
                self.leave_item(("li",) if tag == "li" else ("dd", "dt"))
            if tag == "table" and self.open[-1].tag in IN_TABLE:
                self.leave(self.within(("table",), ("template",)))
            self.leave_p()
            if tag in HEADINGS and self.open[-1].tag in HEADINGS:
                self.leave(len(self.open) - 1)
            self.enter(tag, held)
            self.fresh_pre = tag in ("pre", "listing")
            return
        if tag in ("script", "style", "title", "template", "noframes"):
            self.enter(tag, held)
            return
        if tag == "button":
            self.leave(self.within(("button",)))
        if tag == "a" and any(e is not None and e.tag == "a" for e in self.since_mark()):
            self.end_formatting("a")
        self.resume()
        element = self.enter(tag, held)
        if tag in FORMATTING:
            same = [e for e in self.since_mark() if e.tag == tag and e.attrs == held]
            if len(same) >= 3:
                self.active.remove(same[0])
            self.active.append(element)
        elif tag in ("applet", "marquee", "object"):
            self.active.append(None)

    def since_mark(self) -> list[Element]:
        k = len(self.active)
        while k and self.active[k - 1] is not None:
            k -= 1
        return self.active[k:]

    def leave_item(self, tags: tuple[str, ...]) -> None:
        """A new item ends the open one, unless a block lies between."""
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in tags:
                self.leave(k)
                return
            if tag in SPECIAL and tag not in ("address", "div", "p"):
                return

    def table_part(self, tag: str, attrs: dict[str, str]) -> None:
        """Rows, cells and their groups; outside of a table they are nothing."""
        table = self.within(("table",), ("template",))
        if table is None or tag == "col":
            return
        within = {"tr": GROUPS, "td": ("tr",), "th": ("tr",)}.get(tag, ())
        keep = next((k for k in range(len(self.open) - 1, table, -1) if self.open[k].tag in within), table)
        self.leave(keep + 1)
        if tag in ("tr", *CELLS) and keep == table:
            self.leave(next((k for k in range(table + 1, len(self.open)) if self.open[k].tag not in GROUPS), len(self.open)))
            if self.open[-1].tag not in GROUPS:
                self.enter("tbody")
        if tag in CELLS and self.open[-1].tag != "tr":
            self.enter("tr")
        self.enter(tag, attrs)
        if tag in (*CELLS, "caption"):
            self.active.append(None)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash says nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        self.fresh_pre = False
        if not self.begun:
            if len(self.open) > 1 and self.open[-1].tag == tag:
                self.open.pop()
            if tag != "br":
                return
        if tag in ("html", "body", "head"):
            return
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag == "p":
            if self.within(("p",), LIMITS | {"button"}) is None:
                self.enter("p")
            self.leave_p()
        elif tag == "li":
            self.leave(self.within(("li",), LIMITS | {"ol", "ul"}))
        elif tag in HEADINGS:
            self.leave(self.within(HEADINGS))
        elif tag in ("table", *GROUPS, "tr", *CELLS, "caption"):
            self.leave(self.within((tag,), ("table", "template") if tag != "table" else ("template",)))
        elif tag in FORMATTING:
            self.end_formatting(tag)
        elif tag in BLOCKS or tag in ("dd", "dt", "form", "button", "applet", "marquee", "object"):
            self.leave(self.within((tag,)))
        else:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == tag:
                    self.leave(k)
                    return
                if self.open[k].tag in SPECIAL:
                    return

    def end_formatting(self, tag: str) -> None:
        element = next((e for e in reversed(self.since_mark()) if e.tag == tag), None)
        if element is None:
            k = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == tag or self.open[k].tag in SPECIAL), None)
            if k is not None and self.open[k].tag == tag:
                self.leave(k)
            return
        del self.active[next(k for k in range(len(self.active) - 1, -1, -1) if self.active[k] is element)]
        k = next((k for k, e in enumerate(self.open) if e is element), None)
        if k is None:
            return
        block = next((j for j in range(k + 1, len(self.open)) if self.open[j].tag in SPECIAL), None)
        if block is None:
            self.leave(k)
        else:
            # a block goes on without the formatting that began around it
            self.open[k:block] = [e for e in self.open[k + 1 : block] if any(e is a for a in self.active)]


def plain(text: str) -> str:
    return _SPACES.sub(" ", text).strip(" ")


def walk(children: list, effect) -> Iterator[tuple]:
    """Nodes in document order with an explicit stack; ``effect`` gives what a tag yields before and after its children, or None to pass over it."""
    todo = [(iter(children), (), None)]
    while todo:
        rest, after, state = todo[-1]
        node = next(rest, None)
        if node is None:
            yield from after
            todo.pop()
        elif isinstance(node, Text):
            yield "text", node.text, node.styles
        elif (found := effect(node, state)) is not None:
            before, after, inner, children = found
            yield from before
            todo.append((iter(children), after, inner))


def cell_text(cell: Element, hidden: frozenset[str]) -> str:
    """The text of a cell, a line for each block in it."""
    if len(cell.children) == 1 and isinstance(cell.children[0], Text):
        return plain(cell.children[0].text)

    def effect(node: Element, _) -> tuple | None:
        around = (("break",),) if node.tag in CELL_BREAKS else ()
        return None if node.tag in hidden else (around, around, None, node.children)

    parts = [""]
    for item in walk(cell.children, effect):
        if item[0] == "break":
            parts.append("")
        else:
            parts[-1] += item[1]
    return "\n".join(t for p in parts if (t := plain(p)))


def grid(table: Element, hidden: frozenset[str]) -> list[list[str]]:
    """Cells of all rows with any, short rows filled up; rows of tables within cells come after the row around them."""
    rows, todo = [], [table]
    while todo:
        node = todo.pop()
        if node.tag == "tr":
            row: list[str] = []
            for c in node.children:
                if isinstance(c, Cells):
                    row += map(plain, c.cells) if _SPACES.search(c.text) else c.cells
                elif isinstance(c, Element) and c.tag in CELLS:
                    row.append(cell_text(c, hidden))
            rows.append(row)
        todo += [c for c in reversed(node.children) if isinstance(c, Element)]
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows if r]


def flow(body: Element, hidden: frozenset[str]) -> Iterator[tuple]:
    """``("text", text, styles)``, ``("break", kind)``, ``("title", level)``, ``("end", level)``, ``("image", attributes)``, ``("table", rows)``."""
    line = ("break", "paragraph")

    def effect(node: Element, lists: str | None) -> tuple | None:
        tag = node.tag
        if tag in hidden:
            return None
        if tag in HEADINGS:
            level = min(3, int(tag[1]))
            return (line, ("title", level)), (("end", level),), lists, node.children
        if tag == "img":
            return (line, ("image", node.attrs)), (), lists, ()
        if tag == "table":
            return (line, ("table", grid(node, hidden))), (), lists, ()
        if tag in ("ul", "ol"):
            return (line,), (), tag, node.children
        if tag == "li":
            return (line,), (("break", "numberedListItem" if lists == "ol" else "bulletListItem"),), lists, node.children
        around = (line,) if tag in BREAKS else ()
        return around, around, lists, node.children

    yield from walk(body.children, effect)
    yield line


def image_of(attrs: dict[str, str], number: int) -> dict:
    """Name, MIME type and URL of an image; what a machine has written about it is no name."""
    url, alt = attrs["src"], _ENDS.sub("", attrs.get("alt", ""))
    if not plain(alt) or any(p.search(plain(alt)) for p in _MACHINE):
        alt = f"image-{number}"
    kind = re.match("data:([^;]+)", url)
    return {"name": alt, "mime": kind[1] if kind else "image/png", "url": url}


def chunks_of(html: str, keep_scripts: bool = False) -> list[dict]:
    """Chunks ``kind, level, text, inline, image, rows`` of everything in the body.

    Text up to a break is one chunk, its white space collapsed; its runs keep theirs. A title is what a
    heading holds up to the first break in it: what lies between breaks there is a paragraph too,
    and what follows the last one is left out. An image needs a URL.
    """
    hidden = frozenset(("template",)) if keep_scripts else frozenset(("template", "script", "style"))
    out: list[dict] = []
    held: list[dict] = []  # runs up to the next break
    around: list[tuple[list, list]] = []  # runs outside of the open headings, and their titles

    def add(kind: str, text: str, **more) -> None:
        out.append({"kind": kind, "level": None, "text": text, "inline": None, "image": None, "rows": None} | more)

    for what, *item in flow(Page(html).body, hidden):
        if what == "text":
            styles = {k: k in item[1] for k in STYLES}
            if held and all(held[-1][k] == styles[k] for k in STYLES):
                held[-1]["text"] += item[0]
            else:
                held.append({"text": item[0]} | styles)
        elif what == "break" and held:
            if text := plain("".join(r["text"] for r in held)):
                add(item[0], text, inline=held)
            held = []
        elif what == "title":
            title: list[dict] = []
            around.append((held, title))
            held = title
        elif what == "end":
            held, title = around.pop()
            if text := plain("".join(r["text"] for r in title)):
                add("heading", text, level=item[0], inline=title)
        elif what == "image" and item[0].get("src"):
            image = image_of(item[0], len(out) + 1)
            add("image", image["name"], image=image)
        elif what == "table" and item[0]:
            add("table", "\n".join("\t".join(r) for r in item[0]), rows=item[0])
    return out


def tables_of(html: str) -> list[list[list[str]]]:
    """The rows of every table of a page that does not lie in another."""
    return [c["rows"] for c in chunks_of(html) if c["rows"]]


_RUN = [("text", "string"), *((k, "boolean") for k in STYLES)]
_ARROW = {"string": pa.string(), "boolean": pa.bool_()}
#: What :func:`html_chunks` gives for each chunk, as DDL and in Arrow.
FIELDS = "pos int, kind string, level int, text string, inline array<struct<" + ", ".join(f"{k}: {t}" for k, t in _RUN) + ">>, image struct<name: string, mime: string, url: string>, rows array<array<string>>"
_TYPES = {
    "pos": pa.int32(), "kind": pa.string(), "level": pa.int32(), "text": pa.string(), "inline": pa.list_(pa.struct([(k, _ARROW[t]) for k, t in _RUN])),
    "image": pa.struct([(k, pa.string()) for k in ("name", "mime", "url")]), "rows": pa.list_(pa.list_(pa.string())),
}


def html_chunks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep_scripts: bool = False) -> DataFrame:
    """``(id, pos, kind, level, text, inline, image, rows)``; a narrow map over whole pages. A null page has no chunks.

    The text of an image is its name, that of a table its cells with tabs between.
    """
    reach_workers(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [(i, {"pos": pos} | c) for i, html in enumerate(batch.column(1).to_pylist()) for pos, c in enumerate(chunks_of(html or "", keep_scripts))]
            ids = batch.column(0).take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([c[k] for _, c in found], t) for k, t in _TYPES.items())], ["_id", *_TYPES])

    rows = pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html"))
    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, {FIELDS}").withColumnRenamed("_id", id_col)
