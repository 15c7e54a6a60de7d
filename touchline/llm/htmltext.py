"""Layout-aware text of web pages.

A tree builder closes what HTML lets authors leave open (paragraphs, list items, table rows and cells, options,
definitions) and skips what a browser does not show. The tree is then written out as a browser would lay it out: blocks on
lines of their own, paragraphs apart, lists with marks and indents, preformatted text as it is, tables in aligned columns.
All visible text is kept.

Pages are independent, so this runs where they are read, without a shuffle. Neither the builder nor the writer recurses,
so nesting may be of any depth. Defined results: null and empty pages give an empty text, equal rows equal texts, an empty
table no rows; other columns do not take part.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from touchline.llm.common import table

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template noscript iframe object audio video canvas datalist meter progress noframes".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
APART = HEADINGS | frozenset("p blockquote pre table ul ol dl figure fieldset form".split())
LINES = CLOSES_P | frozenset("html body legend caption tr thead tbody tfoot option optgroup".split())
# An element is closed by the start of one of these, looking no further up than the listed containers.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
SCOPE = {"td", "th", "table", "caption", "button", "object"}
SPACES = re.compile(r"[ \t\n\f\r]+")
MOST_COLSPAN, MOST_ROWSPAN = 1000, 65_534
WIDEST_PADDED = 60


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.count: Counter = Counter()

    def _pop(self, to: int) -> None:
        for node in self.open[to:]:
            self.count[node.tag] -= 1
        del self.open[to:]

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def _close(self, tags: set[str], limits: set[str]) -> None:
        """Close the outermost open element of ``tags`` inside the nearest of ``limits``."""
        if not any(self.count[t] > 0 for t in tags):
            return
        found = None
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at].tag
            if tag in limits:
                break
            if tag in tags:
                found = at
        if found is not None:
            self._pop(found)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self._close({"p"}, SCOPE)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._pop(len(self.open) - 1)
        if tag in IMPLIED_END:
            self._close(*IMPLIED_END[tag])
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push("tr", {})
        if tag in ("html", "body") and self.count[tag]:
            return
        self._push(tag, {k: v or "" for k, v in attrs})

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not self.count["p"]:
            self._push("p", {})
        if tag == "br":
            self._push("br", {})
        if not self.count[tag] or tag in ("html", "body"):
            return
        limits = set() if tag in SCOPE else {"td", "th", "table", "caption"} if tag not in ("tr", "thead", "tbody", "tfoot") else {"table"}
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                return self._pop(at)
            if self.open[at].tag in limits:
                return None
        return None

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


class Page:
    """Lines under construction: white space collapses inside a line, margins collapse between blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False
        self.margin = 0

    def text(self, data: str) -> None:
        body = SPACES.sub(" ", data)
        if body == " ":
            self.gap = self.gap or bool(self.now)
        elif body:
            if self.now and (self.gap or body[0] == " "):
                self.now.append(" ")
            self.now.append(body.strip(" "))
            self.gap = body[-1] == " "

    def raw(self, data: str) -> None:
        first, *others = data.split("\n")
        self.now.append(first)
        for line in others:
            self.end_line(force=True)
            self.now.append(line)

    def end_line(self, force: bool = False) -> None:
        if force or any(self.now):
            self.add(["".join(self.now)])
        self.now, self.gap = [], False

    def block(self, margin: int) -> None:
        self.end_line()
        self.margin = max(self.margin, margin)

    def add(self, lines: list[str]) -> None:
        if lines:
            self.lines += [""] * (self.margin if self.lines else 0)
            self.margin = 0
            self.lines += lines

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def width(text: str) -> int:
    return len(text) if text.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in text)


def _span(value: str, most: int) -> int:
    return min(max(int(value), 1), most) if value.isascii() and value.isdigit() and len(value) < 7 else 1


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, colspan, rowspan) with columns of equal width; cells past ``WIDEST_PADDED`` do not widen."""
    grid, held = [], {}
    for row in rows:
        placed, at = {}, 0
        for lines, across, down in row:
            while held.get(at, 0):
                at += 1
            placed[at] = lines
            for c in range(at, at + across):
                held[c] = max(held.get(c, 0), down)
            at += across
        held = {c: n - 1 for c, n in held.items() if n > 1}
        grid.append(placed)
    widths: dict[int, int] = {}
    for placed in grid:
        for at, lines in placed.items():
            widths[at] = max([widths.get(at, 0), *(w for w in map(width, lines) if w <= WIDEST_PADDED)])
    out = []
    for placed in grid:
        columns = [c for c in sorted(widths) if c <= max(placed, default=-1)]
        for k in range(max((len(lines) for lines in placed.values()), default=0)):
            cells = [(placed.get(c, []) + [""] * (k + 1))[k] for c in columns]
            out.append("  ".join(t + " " * (widths[c] - width(t)) for c, t in zip(columns, cells)).rstrip())
    return out


def _hidden(node: Node) -> bool:
    style = node.attrs.get("style", "").lower().replace(" ", "")
    return node.tag in UNSEEN or "hidden" in node.attrs or "display:none" in style or node.tag == "dialog" and "open" not in node.attrs


def render(root: Node) -> str:
    """All visible text of a tree, laid out."""
    pages, lists, tables = [Page()], [], []
    visible, pre = [True], 0
    todo: list[tuple[bool, Node | str, Node | None]] = [(False, root, None)]
    while todo:
        leave, node, parent = todo.pop()
        page = pages[-1]
        if isinstance(node, str):
            if visible[-1]:
                page.raw(node) if pre else page.text(node)
            continue
        tag = node.tag
        if not leave:
            if _hidden(node) or parent is not None and parent.tag == "details" and "open" not in parent.attrs and tag != "summary":
                continue
            if tag == "br":
                page.end_line(force=True)
            elif tag == "hr":
                page.block(1)
            elif tag == "input":
                shown = node.attrs.get("value", "") if node.attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number") else ""
                page.text(f" {shown} " if shown else "")
            if tag in VOID:
                continue
            style = node.attrs.get("style", "").lower().replace(" ", "")
            shows = True if "visibility:visible" in style else False if "visibility:hidden" in style or "visibility:collapse" in style else visible[-1]
            visible.append(shows)
            if tag in LINES or tag in APART:
                inner_list = tag in ("ul", "ol", "dl") and lists
                page.block(1 if tag in APART and not inner_list else 0)
            if tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start", "")
                lists.append([tag == "ol", int(start) if start.isascii() and start.isdigit() and len(start) < 10 else 1])
            elif tag in ("li", "td", "th", "blockquote", "dd", "caption"):
                pages.append(Page())
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            pre += tag in ("pre", "textarea")
            todo.append((True, node, parent))
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if not isinstance(c, str)]
            todo += [(False, child, node) for child in reversed(children)]
            continue
        visible.pop()
        pre -= tag in ("pre", "textarea")
        if tag in ("li", "td", "th", "blockquote", "dd", "caption"):
            lines = pages.pop().done()
            page = pages[-1]
            if tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((lines, _span(node.attrs.get("colspan", ""), MOST_COLSPAN), _span(node.attrs.get("rowspan", ""), MOST_ROWSPAN)))
            else:
                mark = "  "
                if tag == "li" and lists:
                    mark = f"{lists[-1][1]}. " if lists[-1][0] else "- "
                    lists[-1][1] += 1
                elif tag == "li":
                    mark = "- "
                elif tag in ("caption", "td", "th"):
                    mark = ""
                page.block(0)
                page.add([(mark if k == 0 else " " * len(mark)) + line if line else "" for k, line in enumerate(lines)])
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag == "table":
            rows = tables.pop()
            page.block(0)
            page.add(aligned(rows))
        if tag in LINES or tag in APART:
            page.block(1 if tag in APART and not (tag in ("ul", "ol", "dl") and lists) else 0)
    return "\n".join(line.rstrip() for line in pages[0].done()).replace("\xa0", " ").strip("\n")


def page_text(html: str | None) -> str:
    return render(parse(html)) if html else ""


def extract_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Key and ``text`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # long pages: few texts at once
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([page_text(h.as_py()) for h in part.column(1)], pa.string())], names=[key, "text"])

    return pages.select(key, html).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, text string")


def op4_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages."""
    return extract_text(table(spark, sf_dir, "pages"))
