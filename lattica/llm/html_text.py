"""Visible text of HTML pages, laid out: a tree builder with implied tags, visibility rules,
then rendering with block spacing, lists and aligned table cells."""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"'=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
HIDING = re.compile(r"(?<![-\w])display\s*:\s*none(?![-\w])", re.I)
VISIBILITY = re.compile(r"(?<![-\w])visibility\s*:\s*(visible|hidden|collapse|inherit)(?![-\w])", re.I)

# Fixed element classes of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title object video audio canvas datalist".split())
VALUED = frozenset("submit button reset text search email url tel number date datetime-local month week time".split())  # inputs that show their value
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote dl figure ol ul menu dir pre table fieldset hr".split())  # a blank line before and after
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
LISTS = frozenset("ul ol menu dir".split())
#: An opening tag ends these open elements, up to the nearest of the bounds.
IMPLIED = {
    "li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, {"table"}), "thead": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
WIDEST, TALLEST = 1000, 65534  # the language's limits of colspan and rowspan


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(source: str) -> Node:
    root = Node("html", {})
    open_: list[Node] = [root]
    count: Counter[str] = Counter()  # open elements by tag
    at, n = 0, len(source)

    def push(node: Node) -> None:
        open_.append(node)
        count[node.tag] += 1

    def pop(i: int) -> None:
        for x in open_[i:]:
            count[x.tag] -= 1
        del open_[i:]

    def close(tags, bounds) -> None:
        """End all open elements of these tags, up to the nearest of the bounds."""
        if not any(count[t] for t in tags):
            return
        cut = 0
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in bounds:
                break
            if open_[i].tag in tags:
                cut = i
        if cut:
            pop(cut)

    while at < n:
        mark = source.find("<", at)
        if mark < 0:
            mark = n
        if mark > at:
            text = source[at:mark]
            if open_[-1].tag == "head" and text.strip():  # text ends the head
                close({"head"}, set())
            open_[-1].children.append(html.unescape(text))
            at = mark
            continue
        found = TOKEN.match(source, at)
        if not found:
            open_[-1].children.append("<")
            at += 1
            continue
        at = found.end()
        if found[1]:
            tag = found[1].lower()
            if tag == "br":
                open_[-1].children.append(Node("br", {}))
            if not count[tag]:
                continue
            stop = {"table", "td", "th"} - {tag} if tag not in {"table", "tr", "tbody", "thead", "tfoot"} else {"table"} - {tag}
            close_at = next((i for i in range(len(open_) - 1, 0, -1) if open_[i].tag == tag or open_[i].tag in stop), 0)
            if close_at and open_[close_at].tag == tag:
                pop(close_at)
            continue
        if not found[2]:
            if source.startswith("<![CDATA[", found.start()):
                open_[-1].children.append(source[found.start() + 9 : at].removesuffix("]]>"))
            continue
        tag, attrs = found[2].lower(), {}
        for m in ATTRIBUTE.finditer(found[3] or ""):
            attrs.setdefault(m[1].lower(), html.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
        if tag == "html" or tag == "body" and count["body"]:
            continue
        if tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "button", "li"} if tag != "p" else {"table", "td", "th", "button"})
        if open_[-1].tag == "head" and tag not in ("meta", "link", "base", "title", "style", "script", "noscript", "template"):
            close({"head"}, set())
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ("td", "th") and open_[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr", {})
            open_[-1].children.append(row)
            push(row)
        node = Node(tag, attrs)
        open_[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            stop = end.start() if end else n
            if tag in ("textarea", "title"):
                node.children.append(html.unescape(source[at:stop]))
            at = end.end() if end else n
        elif tag not in VOID:
            push(node)
            if len(open_) * 8 > sys.getrecursionlimit():  # what renders the tree calls itself
                sys.setrecursionlimit(len(open_) * 16)
    return root


def hidden(node: Node) -> bool:
    """Elements that a browser doesn't show, with all that is in them."""
    a = node.attrs
    return (
        node.tag in UNSEEN
        or "hidden" in a
        or ("style" in a and HIDING.search(a["style"]) is not None)
        or (node.tag == "input" and a.get("type", "text").lower() not in VALUED)
        or (node.tag == "dialog" and "open" not in a)
    )


def visible(node: Node, shown: bool) -> bool:
    """Whether text right inside the element is seen: its own visibility or else its parent's."""
    found = VISIBILITY.findall(node.attrs["style"]) if "style" in node.attrs else []
    return shown if not found or found[-1].lower() == "inherit" else found[-1].lower() == "visible"


def columns_of(text: str) -> int:
    """Columns that a text takes up where wide characters take two."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines of text; blank lines between blocks that ask for one."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.run: list[str] = []
        self.blank = False

    def text(self, piece: str, keep: bool = False) -> None:
        if not keep:
            piece = SPACE.sub(" ", piece)
            if not self.run or self.run[-1].endswith((" ", "\n")):
                piece = piece.removeprefix(" ")
        if piece:
            self.run.append(piece)

    def end(self, apart: bool = False, keep: bool = False) -> None:
        """End the current line."""
        line = "".join(self.run)
        line = line.rstrip("\n") if keep else line.rstrip(" ")
        self.run = []
        if line.strip():
            if self.blank and self.lines:
                self.lines.append("")
            self.lines += [x.rstrip() for x in line.split("\n")]
            self.blank = False
        self.blank |= apart


def _span(cell: Node, name: str, most: int) -> int:
    found = cell.attrs.get(name, "1").strip()
    return min(int(found), most) if found.isdecimal() and len(found) < 9 else 1


def _table(node: Node, shown: bool) -> list[str]:
    """Captions and stray text, then the rows: each cell under the others of its column."""
    rows: list[list[tuple[int, list[str], int]]] = []  # (column, lines, columns) of each cell
    captions: list[str] = []
    taken: dict[int, int] = {}  # columns of cells from rows above -> rows still to go

    def stray(c: Node | str, seen: bool) -> None:
        if isinstance(c, Node):
            if not hidden(c):
                captions.extend(_lines(c, visible(c, seen)))
        elif seen and c.strip():
            captions.append(SPACE.sub(" ", c).strip())

    def row(node: Node, seen: bool) -> None:
        cells, col = [], 0
        for d in node.children:
            if not (isinstance(d, Node) and d.tag in ("td", "th")):
                stray(d, seen)
                continue
            if hidden(d):
                continue
            while taken.get(col, 0):
                col += 1
            width, height = _span(d, "colspan", WIDEST) or 1, _span(d, "rowspan", TALLEST) or TALLEST
            cells.append((col, _lines(d, visible(d, seen)), width))
            for k in range(col, col + width):
                taken[k] = height + 1  # this row and the next, counted down below
            col += width
        for k in [k for k, left in taken.items() if left]:
            taken[k] = max(0, taken[k] - (2 if any(c <= k < c + w for c, _, w in cells) else 1))
        if cells:
            rows.append(cells)

    def walk(x: Node, seen: bool) -> None:
        for c in x.children:
            if isinstance(c, Node) and c.tag == "tr":
                if not hidden(c):
                    row(c, visible(c, seen))
            elif isinstance(c, Node) and c.tag in ("tbody", "thead", "tfoot"):
                if not hidden(c):
                    taken.clear()  # cells end with their group
                    walk(c, visible(c, seen))
                    taken.clear()
            else:
                stray(c, seen)

    walk(node, shown)
    width: dict[int, int] = {}
    for cells in rows:
        for col, lines, span in cells:
            if span == 1:
                width[col] = max(width.get(col, 0), max(map(columns_of, lines), default=0))
    start, far = {}, 0  # where each column begins
    for col in range(max((c + w for cells in rows for c, _, w in cells), default=0)):
        start[col] = far
        far += width.get(col, 0) + 2
    out = []
    for cells in rows:
        for i in range(max((len(lines) for _, lines, _ in cells), default=0)):
            line, at = [], 0
            for col, lines, _ in cells:
                if i < len(lines) and lines[i]:
                    room = max(start[col] - at, 2 if line else 0)
                    line.append(" " * room + lines[i])
                    at += room + columns_of(lines[i])
            if line:
                out.append("".join(line).rstrip())
    return captions + out


def _lines(node: Node, shown: bool) -> list[str]:
    page = Page()
    _render(node, page, False, shown)
    page.end()
    return page.lines


def _drawn(node: Node, page: Page, shown: bool, inside: bool = False) -> None:
    """Text elements of a drawing."""
    for child in node.children:
        if isinstance(child, str):
            if inside and shown:
                page.text(child)
        elif not hidden(child):
            if child.tag == "text":
                page.text(" ")
            _drawn(child, page, visible(child, shown), inside or child.tag == "text")


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"\s*-?\d{1,9}\s*", text) else None


def _render(node: Node, page: Page, pre: bool, shown: bool) -> None:
    step = -1 if node.tag == "ol" and "reversed" in node.attrs else 1
    number = _number(node.attrs.get("start")) if node.tag == "ol" else 1
    if number is None:
        number = 1 if step == 1 else sum(isinstance(c, Node) and c.tag == "li" and not hidden(c) for c in node.children)
    closed = node.tag == "details" and "open" not in node.attrs
    for child in node.children:
        if isinstance(child, str):
            if shown and not closed:
                page.text(child, pre)
            continue
        if hidden(child) or (closed and child.tag != "summary"):
            continue
        tag, seen = child.tag, visible(child, shown)
        if tag == "br":
            page.run.append("\n")
            continue
        if tag == "input":
            if seen:
                page.text(child.attrs.get("value", ""))
            continue
        if tag == "svg":
            _drawn(child, page, seen)
            continue
        if tag not in BLOCK:
            if tag == "q" and seen:
                page.text('"')
            _render(child, page, pre, seen)
            if tag == "q" and seen:
                page.text('"')
            continue
        apart = tag in APART and not (tag in LISTS and node.tag == "li")
        page.end(apart, pre)
        if tag == "hr":
            if seen:
                page.text("-" * 8)
        elif tag in ("li", "dd", "blockquote", "table"):
            lines = _table(child, seen) if tag == "table" else _lines(child, seen)
            if tag == "li" and node.tag == "ol":
                own = _number(child.attrs.get("value"))
                number = number if own is None else own
            lead = f"{number}. " if tag == "li" and node.tag == "ol" else "- " if tag == "li" else "  " if tag == "dd" else "> " if tag == "blockquote" else ""
            if tag == "li":
                number += step
            rest = lead if tag == "blockquote" else " " * len(lead)
            if lines:
                page.run.append("\n".join(((lead if i == 0 else rest) + x).rstrip() for i, x in enumerate(lines)))
            page.end(apart, True)
        else:
            _render(child, page, pre or tag == "pre", seen)
        page.end(apart, pre or tag == "pre")


def render(source: str | None) -> str:
    """All visible text of a page; '' for null or empty pages and pages without any."""
    return "\n".join(_lines(parse(source), True)) if source else ""


def _rendered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for at in batches:
        yield pd.DataFrame({"page_id": at["page_id"], "text": [render(x) for x in at["html"]]})


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) -> (page_id, text, n_chars), a row for each input row; null ids
    and repeated rows pass through, other columns are ignored."""
    return pages.select("page_id", "html").mapInPandas(_rendered, "page_id long, text string").selectExpr("page_id", "text", "cast(length(text) as bigint) n_chars")
