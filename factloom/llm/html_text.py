"""HTML extraction: a tree builder with implied tags, visibility rules, and a layout renderer.

Each page is parsed into a tree with the elements that HTML implies (html, head, body, tbody, tr;
ends of p, li, dd, dt, option, td, th, tr and table sections) and rendered as all its visible text:
blocks on lines of their own, paragraphs, headings and tables set off by a blank line, nested lists
with bullets or numbers, table cells in aligned columns, and white space kept in preformatted text.

Never visible: head, script, style, template, noscript, and the like, comments, elements that are
`hidden`, inputs of type hidden, closed `details` but for their summary, and what an inline style
sets to display:none, visibility:hidden (visible again where a descendant says so) or opacity:0.

Defined cases: null html gives null text, empty html an empty one; unclosed, stray or badly nested
tags never fail; nesting deeper than `DEEPEST` is flattened; references that HTML doesn't know stay
as they are; repeated rows are each rendered; an empty table gives an empty result. Work is a map
over pages, page by page, with no shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("textarea title".split())
HIDDEN = frozenset("head script style template noscript noembed noframes iframe object audio video canvas svg datalist math title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form header"
    " h1 h2 h3 h4 h5 h6 hgroup hr html legend li listing main menu nav ol p pre search section summary table tr ul caption".split()
)
#: Blocks with a blank line before and after them.
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr menu dir listing".split())
ENDS_P = BLOCK - frozenset("html body tr caption dd dt legend".split()) | frozenset(("dd", "dt"))
IN_HEAD = frozenset("base link meta title style script noscript template".split())
#: What a start tag ends, up to what.
SCOPES = {
    "li": (("li",), ("ul", "ol", "menu", "dir", "table")),
    "dd": (("dd", "dt"), ("dl", "table")),
    "dt": (("dd", "dt"), ("dl", "table")),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("td", "th", "tr", "caption", "colgroup"), ("tbody", "thead", "tfoot", "table")),
    "tbody": (("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "rt": (("rt", "rp"), ("ruby",)),
    "rp": (("rt", "rp"), ("ruby",)),
}
SCOPES["thead"] = SCOPES["tfoot"] = SCOPES["tbody"]
#: Where only rows and cells may stand, what may stand there, and what holds anything again.
ROWS = frozenset("table tbody thead tfoot tr".split())
IN_TABLE = frozenset("tbody thead tfoot tr td th caption colgroup col script style template".split())
CELLS = frozenset("td th caption".split())
DEEPEST = 200

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|</>|</[^A-Za-z>][^>]*(?:>|\Z)"
    r"""|<(?P<start>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*?)(?P<closed>/?)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s/>="'][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
SPACE = re.compile(r"[ \t\r\n\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Builder:
    """A tree of Nodes and strings from markup."""

    def __init__(self):
        self.root = Node("html", {})
        self.head = Node("head", {})
        self.body = Node("body", {})
        self.root.children = [self.head, self.body]
        self.open = [self.root, self.head]
        self.in_body = False
        self.beyond = 0  # elements that are open beyond the deepest level

    def parse(self, markup: str) -> Node:
        at = 0
        for found in iter(lambda: TOKEN.search(markup, at), None):
            if found.start() > at:
                self.text(html.unescape(markup[at : found.start()]))
            at = max(found.end(), found.start() + 1)
            if found["start"]:
                tag = found["start"].lower()
                attrs = {}
                for name, *values in ATTRIBUTE.findall(found["attrs"]) if found["attrs"].strip() else ():
                    attrs.setdefault(name.lower(), html.unescape(values[0] or values[1] or values[2]))
                self.start(tag, attrs, bool(found["closed"]))
                if tag in RAW or tag in ESCAPABLE:
                    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(markup, at)
                    inner = markup[at : end.start()]
                    if inner:
                        self.open[-1].children.append(html.unescape(inner) if tag in ESCAPABLE else inner)
                    at = end.end()
                    self.end(tag)
            elif found["end"]:
                self.end(found["end"].lower())
            elif found["cdata"] is not None:
                self.text(found["cdata"])
        if at < len(markup):
            self.text(html.unescape(markup[at:]))
        return self.root

    def into_body(self) -> None:
        if not self.in_body:
            self.in_body = True
            self.open = [self.root, self.body]

    def text(self, text: str) -> None:
        top = self.open[-1]
        if not self.in_body:
            if top is self.head or top is self.root:
                if not text.strip():
                    return
                self.into_body()
                top = self.open[-1]
        if top.tag in ROWS and text.strip():
            self.before_table(text)
            return
        top.children.append(text)

    def before_table(self, child) -> None:
        """What may not stand in a table stands before it."""
        at = max(i for i, n in enumerate(self.open) if n.tag == "table")
        parent, own = self.open[at - 1], self.open[at]
        where = next((i for i, c in enumerate(parent.children) if c is own), len(parent.children))
        parent.children.insert(where, child)

    def close(self, names: tuple[str, ...], limits: tuple[str, ...]) -> None:
        """Ends the outermost open element of these names inside the innermost limit."""
        outer = None
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag in limits:
                break
            if self.open[i].tag in names:
                outer = i
        if outer is not None:
            del self.open[outer:]

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag in ("html", "body", "head"):
            if tag == "body":
                self.into_body()
            target = {"html": self.root, "body": self.body, "head": self.head}[tag]
            target.attrs = attrs | target.attrs
            return
        if not self.in_body and not (tag in IN_HEAD or self.open[-1] is not self.head):
            self.into_body()
        if tag in ENDS_P:
            self.close(("p",), ("button", "table", "td", "th", "caption", "object"))
        if tag in SCOPES:
            self.close(*SCOPES[tag])
        if tag in IN_TABLE:
            # elements that stand before a table end where it goes on
            last = max((i for i, n in enumerate(self.open) if n.tag in ROWS or n.tag in CELLS), default=0)
            if self.open[last].tag in ROWS:
                del self.open[last + 1 :]
        top = self.open[-1].tag
        if top in ROWS and tag not in IN_TABLE:
            if tag == "table":
                self.end("table")
            else:
                node = Node(tag, attrs)
                self.before_table(node)
                if tag not in VOID and len(self.open) < DEEPEST:
                    self.open.append(node)
                elif tag not in VOID:
                    self.beyond += 1
                return
        if tag in ("td", "th") and top in ("table", "tbody", "thead", "tfoot"):
            if top == "table":
                self.push(Node("tbody", {}))
            self.push(Node("tr", {}))
        elif tag == "tr" and top == "table":
            self.push(Node("tbody", {}))
        elif tag == "a":
            self.close(("a",), ("table", "td", "th", "caption", "div", "p", "li"))
        node = Node(tag, attrs)
        if tag in VOID:
            self.open[-1].children.append(node)
        else:
            self.push(node)

    def push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        if len(self.open) < DEEPEST:
            self.open.append(node)
        else:  # flattened: what it holds stands beside it
            self.beyond += 1

    def end(self, tag: str) -> None:
        if tag == "head":
            if not self.in_body:
                del self.open[2:]
            return
        if tag in ("html", "body"):
            return
        if self.beyond:
            self.beyond -= 1
            return
        if tag == "br":
            self.start("br", {}, True)
            return
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self.start("p", {}, False)
        limits = ("table",) if tag not in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption") else ()
        cells = ("td", "th", "caption") if limits else ()
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in limits or self.open[i].tag in cells:
                return


def width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text) if not text.isascii() else len(text)


class Layout:
    """Lines of text under way; blocks ask for line breaks and blank lines, which never add up."""

    def __init__(self):
        self.lines: list[str] = []
        self.line = ""
        self.space = False
        self.gap = 0  # line ends asked for: 1 a new line, 2 a blank line

    def inline(self, text: str) -> None:
        """Text whose white space collapses."""
        text = SPACE.sub(" ", text)
        core = text.strip(" ")
        self.space = self.space or text[:1] == " "
        if core:
            self.put(core)
            self.space = text[-1:] == " "

    def put(self, piece: str) -> None:
        self.settle()
        if self.space and self.line:
            self.line += " "
        self.space = False
        self.line += piece

    def settle(self) -> None:
        if self.gap:
            if self.line:
                self.lines.append(self.line.rstrip(" "))
                self.line = ""
            if self.gap == 2 and self.lines and self.lines[-1] != "":
                self.lines.append("")
            self.gap = 0
            self.space = False

    def block(self, gap: int) -> None:
        self.gap = max(self.gap, gap)

    def newline(self) -> None:
        self.settle()
        self.lines.append(self.line.rstrip(" "))
        self.line, self.space = "", False

    def exact(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").split("\n")
        if first:
            self.settle()
            self.line += first
        for piece in rest:
            self.settle()
            self.lines.append(self.line)
            self.line = piece

    def rows(self, lines: list[str]) -> None:
        """Ready lines, each on its own."""
        for line in lines:
            if line:
                self.exact(line)
                self.block(1)
            else:
                self.block(2)

    def result(self) -> list[str]:
        lines = [*self.lines, self.line.rstrip(" ")] if self.line else [*self.lines]
        while lines and not lines[0].strip():
            del lines[0]
        while lines and not lines[-1].strip():
            del lines[-1]
        return lines


DECLARATION = re.compile(r"([a-zA-Z-]+)\s*:\s*([^;!]+)")


def style_of(node: Node) -> dict[str, str]:
    return {k.lower(): v.strip().lower() for k, v in DECLARATION.findall(node.attrs["style"])} if "style" in node.attrs else {}


def gone(node: Node, style: dict[str, str]) -> bool:
    return (
        node.tag in HIDDEN
        or "hidden" in node.attrs
        or (node.tag == "input" and node.attrs.get("type", "").lower() == "hidden")
        or style.get("display") == "none"
        or style.get("opacity", "1") in ("0", "0.0", "0%")
    )


def render(node: Node, out: Layout, seen: bool = True, pre: bool = False) -> None:
    ordered = 0
    first_summary = True
    for child in node.children:
        if isinstance(child, str):
            if seen and not (node.tag == "details" and "open" not in node.attrs):
                out.exact(child) if pre else out.inline(child)
            continue
        style = style_of(child)
        if gone(child, style):
            continue
        tag = child.tag
        if node.tag == "details" and "open" not in node.attrs:
            if tag != "summary" or not first_summary:
                continue
            first_summary = False
        visible = seen if "visibility" not in style else style["visibility"] not in ("hidden", "collapse")
        kept = pre or tag in ("pre", "textarea", "listing") or style.get("white-space", "").startswith("pre")
        if tag == "br":
            if seen:
                out.newline()
        elif tag == "hr":
            out.block(2)
        elif tag == "img":
            if visible and child.attrs.get("alt", "").strip():
                out.inline(child.attrs["alt"])
        elif tag == "input":
            shown = child.attrs.get("value") or child.attrs.get("placeholder", "")
            if visible and shown and child.attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number"):
                out.inline(shown)
        elif tag == "table":
            out.block(2)
            out.rows(table_lines(child, visible))
            out.block(2)
        elif tag == "li":
            ordered += 1
            out.block(1)
            number = child.attrs.get("value") or str(ordered + (int(node.attrs.get("start", "1")) if node.attrs.get("start", "1").lstrip("-").isdigit() else 1) - 1)
            mark = f"{number}. " if node.tag == "ol" else "- "
            lines = sub_lines(child, visible, kept)
            out.rows([(" " * len(mark) if k else mark) + line if line else "" for k, line in enumerate(lines)])
        elif tag in ("blockquote", "dd"):
            out.block(2 if tag == "blockquote" else 1)
            out.rows(["  " + line if line else "" for line in sub_lines(child, visible, kept)])
            out.block(2 if tag == "blockquote" else 1)
        elif tag == "option":
            out.block(1)
            render(child, out, visible, kept)
            out.block(1)
        elif tag in BLOCK or style.get("display") in ("block", "flex", "grid", "list-item"):
            gap = 1 if tag not in APART or (tag in ("ul", "ol", "menu", "dir") and node.tag == "li") else 2
            out.block(gap)
            render(child, out, visible, kept)
            out.block(gap)
        else:
            render(child, out, visible, kept)
            if tag in ("td", "th"):
                out.inline(" ")


def sub_lines(node: Node, seen: bool, pre: bool) -> list[str]:
    inner = Layout()
    render(node, inner, seen, pre)
    return inner.result()


def rows_of(node: Node, seen: bool):
    """(row or caption, visible) below a table, not those of tables in it."""
    for child in node.children:
        if isinstance(child, Node) and not gone(child, style := style_of(child)):
            visible = seen if "visibility" not in style else style["visibility"] not in ("hidden", "collapse")
            if child.tag in ("tbody", "thead", "tfoot"):
                yield from rows_of(child, visible)
            elif child.tag in ("tr", "caption"):
                yield child, visible


def span(node: Node, name: str) -> int:
    value = node.attrs.get(name, "1").strip()
    return min(max(1, int(value)), 1000) if value.isascii() and value.isdigit() else 1


def table_lines(node: Node, seen: bool) -> list[str]:
    """Rows with cells padded to the widths of their columns, two spaces apart."""
    top, grid, taken = [], [], {}
    for row, visible in rows_of(node, seen):
        if row.tag == "caption":
            top += sub_lines(row, visible, False)
            continue
        cells, column, below = {}, 0, {}
        for cell in row.children:
            if not isinstance(cell, Node) or cell.tag not in ("td", "th") or gone(cell, style := style_of(cell)):
                continue
            while taken.get(column):
                column += 1
            shown = visible if "visibility" not in style else style["visibility"] not in ("hidden", "collapse")
            wide, tall = span(cell, "colspan"), span(cell, "rowspan")
            cells[column] = (sub_lines(cell, shown, False), wide)
            for k in range(column, column + wide):
                if tall > 1:
                    below[k] = tall
            column += wide
        taken = {k: n - 1 for k, n in taken.items() if n > 1} | {k: n - 1 for k, n in below.items()}
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for column, (lines, wide) in cells.items():
            if wide == 1:
                widths[column] = max(widths.get(column, 0), max((width(x) for x in lines), default=0))
    starts, at = {}, 0
    used = sorted({c for cells in grid for c in cells} | set(widths))
    for column in used:
        starts[column] = at
        at += widths.get(column, 0) + (2 if widths.get(column, 0) else 0)
    out = list(top)
    for cells in grid:
        for k in range(max((len(lines) for lines, _ in cells.values()), default=0)):
            line, length = "", 0
            for column, (lines, _) in sorted(cells.items()):
                if k < len(lines) and lines[k]:
                    pad = starts[column] - length
                    pad = pad if pad > 0 else 2 * bool(length)
                    line += " " * pad + lines[k]
                    length += pad + width(lines[k])
            out.append(line)
    return out


def extract(markup: str | None) -> str | None:
    """All visible text of a page."""
    if markup is None:
        return None
    out = Layout()
    root = Builder().parse(markup)
    style = style_of(root) | style_of(root.children[1])
    if not gone(Node("div", root.attrs | root.children[1].attrs), style):
        render(root.children[1], out, style.get("visibility") not in ("hidden", "collapse"))
    return "\n".join(out.result())


def html_text(pages: DataFrame, markup: str = "html", out: str = "text") -> DataFrame:
    """pages with the column `out`, which replaces one of that name."""

    @F.pandas_udf("string")
    @frugal
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(extract, na_action="ignore")

    return pages.withColumn(out, text(F.col(markup)))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url and text of all of `pages`."""
    return html_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text")
