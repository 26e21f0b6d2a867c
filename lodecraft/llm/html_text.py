"""HTML extraction: a tree with implied tags, rendered as the text that a reader sees."""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>?", re.I) for x in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
HIDDEN = frozenset("head title script style template noscript meta link base iframe noembed noframes audio video canvas datalist desc metadata defs symbol annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul xmp caption".split())
#: Start tags that stay in an open head; any other, and text, ends it.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure xmp menu dir".split())
LISTS = frozenset(("ul", "ol", "menu", "dir"))
_P_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul xmp li dd dt".split())
#: A start tag ends these open elements, looked for up to the barrier.
CLOSES = {
    "li": (frozenset(("li",)), LISTS),
    **{t: (frozenset(("dd", "dt")), frozenset(("dl",))) for t in ("dd", "dt")},
    "tr": (frozenset(("tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
    **{t: (frozenset(("td", "th")), frozenset(("tr", "table"))) for t in ("td", "th")},
    **{t: (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup")), frozenset(("table",))) for t in ("thead", "tbody", "tfoot")},
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "body": (frozenset(("head",)), frozenset()),
}
_BARRIERS = frozenset("table td th caption html body button object template".split())
#: Elements nested deeper are not built: their text goes to the last one that is, unless one of them is hidden.
MAX_DEPTH = 2000
# How far cells may span, as in the HTML standard.
MAX_COLUMNS, MAX_ROWS = 1000, 65534
#: Width up to which cells are padded, what aligned rows may take beside the text they hold, and spans that a table's rows look at before spans down are no longer followed.
PAD, GROWTH, STEPS = 200, 16, 5_000_000
_NOT_SHOWN = re.compile(r"(?<![\w-])(?:display\s*:\s*none|content-visibility\s*:\s*hidden)", re.I)
_VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(\w+)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def get(self, name: str) -> str | None:
        if name not in self.attributes.lower():
            return None
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return unescape(next((x for x in m.groups()[1:] if x is not None), ""))
        return None


def _close(stack: list[Node], tags: frozenset[str], barrier: frozenset[str]) -> None:
    """End the outermost open element among ``tags`` above the nearest barrier."""
    at = None
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in barrier:
            break
        if stack[i].tag in tags:
            at = i
    if at is not None:
        del stack[at:]


def _say(stack: list[Node], text: str) -> None:
    """Add text; the head ends where text begins."""
    if stack[-1].tag == "head" and text.strip(" \t\n\r\f"):
        _leave_head(stack)
    stack[-1].children.append(text)


def _leave_head(stack: list[Node]) -> None:
    while stack[-1].tag == "head":
        stack.pop()


def parse(html: str) -> Node:
    """The tree. Missing end tags are implied; end tags that close nothing are dropped (``</p>`` and ``</br>`` too)."""
    root = Node("#root")
    stack, at, n = [root], 0, len(html)
    over: list[tuple[str, bool]] = []  # open elements under the deepest that is built: tag, and whether it hides its text
    silent = 0  # how many of them do
    foreign = 0  # where the open svg or math element is in the stack, else 0
    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            if not silent:
                _say(stack, html[at:])
            break
        if m.start() > at and not silent:
            _say(stack, html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA[") and not silent:
                _say(stack, m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = m[2].lower()
        if m[1] and over:
            for i in range(len(over) - 1, -1, -1):
                if over[i][0] == tag:
                    silent -= sum(hides for _, hides in over[i:])
                    del over[i:]
                    break
            continue
        if m[1]:
            barrier = _BARRIERS - {tag}
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in barrier and tag not in ("table", "body", "html", "tr", "tbody", "thead", "tfoot"):
                    break
            continue
        if over:
            if tag in RAW:
                end = RAW[tag].search(html, at)
                at = end.end() if end else n
            elif tag not in VOID:
                over.append((tag, not visible(Node(tag, m[3]))))
                silent += over[-1][1]
            continue
        if tag in CLOSES:
            _close(stack, *CLOSES[tag])
        if tag in _P_CLOSERS:
            _close(stack, frozenset(("p",)), _BARRIERS)
        if tag not in IN_HEAD:
            _leave_head(stack)
        foreign = foreign if 0 < foreign < len(stack) else 0
        parent = stack[-1]
        if tag in ("td", "th") and parent.tag in ("table", "tbody", "thead", "tfoot"):
            parent.children.append(row := Node("tr"))
            stack.append(row)
            parent = row
        node = Node(tag, m[3])
        parent.children.append(node)
        if tag in RAW and not (foreign and m[3].rstrip().endswith("/")):
            end = RAW[tag].search(html, at)
            node.children.append(html[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not ((foreign or tag in ("svg", "math")) and m[3].rstrip().endswith("/")):  # a slash ends only foreign elements
            if len(stack) < MAX_DEPTH:
                if tag in ("svg", "math") and not foreign:
                    foreign = len(stack)
                stack.append(node)
            else:
                parent.children.pop()
                over.append((tag, not visible(node)))
                silent += over[-1][1]
    return root


def visible(node: Node) -> bool:
    if node.tag in HIDDEN:
        return False
    if not node.attributes:
        return node.tag != "dialog"
    if node.get("hidden") is not None and (node.get("hidden") or "").lower() != "until-found":
        return False
    if node.tag == "dialog" and node.get("open") is None:
        return False
    style = node.get("style")
    return not (style and _NOT_SHOWN.search(style))


def _shown(node: Node, inherited: bool) -> bool:
    """Whether the element's own text shows: ``visibility`` is inherited, and may be given back to a descendant."""
    found = _VISIBILITY.search(node.get("style") or "") if node.attributes else None
    return inherited if found is None or found[1].lower() not in ("visible", "hidden", "collapse") else found[1].lower() == "visible"


def _width(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Page:
    """Lines of text with collapsed white space and margins."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.margin = 0

    def text(self, raw: str, keep: bool) -> None:
        raw = unescape(raw) if "&" in raw else raw
        if keep:
            pieces = raw.replace("\r\n", "\n").split("\n")
            for k, piece in enumerate(pieces):
                if k:
                    self.newline()
                if piece:
                    self.put(piece)
            return
        flat = _SPACES.sub(" ", raw)
        if flat == " " or not flat:
            self.space = self.space or bool(flat)
            return
        if flat[0] == " ":
            self.space, flat = True, flat[1:]
        trailing = flat[-1] == " "
        self.put(flat[:-1] if trailing else flat)
        self.space = trailing

    def put(self, text: str) -> None:
        if self.margin:
            if self.lines:
                self.lines.extend([""] * (self.margin - 1))
            self.margin = 0
        if self.space and self.parts:
            self.parts.append(" ")
        self.space = False
        self.parts.append(text)

    def newline(self) -> None:
        if self.margin and self.lines:
            self.lines.extend([""] * (self.margin - 1))
        self.margin = 0
        self.lines.append("".join(self.parts).rstrip())
        self.parts, self.space = [], False

    def edge(self, margin: int) -> None:
        """The border of a block: the line ends, and ``margin`` - 1 blank lines part it from what follows."""
        if self.parts:
            self.lines.append("".join(self.parts).rstrip())
            self.parts = []
        self.space = False
        if self.lines:
            self.margin = max(self.margin, margin)

    def block(self, lines: list[str]) -> None:
        for line in lines:
            self.put(line)
            self.newline()

    def done(self) -> list[str]:
        self.edge(1)
        return self.lines


def _number(text: str | None, default: int) -> int:
    return int(text) if text and re.fullmatch(r"\s*[+-]?\d{1,9}\s*", text) else default


def _flow(node: Node, page: _Page, keep: bool, shown: bool = True) -> None:
    count = _number(node.get("start"), 1) if node.tag == "ol" else None
    closed = node.tag == "details" and node.get("open") is None
    for child in node.children:
        if isinstance(child, str):
            if shown and not closed:
                page.text(child, keep)
            continue
        tag = child.tag
        if not visible(child) or closed and tag != "summary":
            continue
        inside = _shown(child, shown)
        if tag == "br":
            page.newline()
        elif tag == "hr":
            page.edge(1)
        elif tag == "table":
            page.edge(2)
            page.block(_table(child, keep, inside))
            page.edge(2)
        elif tag == "li":
            page.edge(1)
            count = _number(child.get("value"), count) if count is not None else None
            mark = f"{count}. " if count is not None else "- "
            count = count + 1 if count is not None else None
            inner = _Page()
            _flow(child, inner, keep, inside)
            lines = inner.done() or [""]
            if inside or any(lines):
                pad = " " * len(mark)
                page.block([(mark if k == 0 else pad if line else "") + line for k, line in enumerate(lines)])
            page.edge(1)
        elif tag in BLOCK:
            margin = 2 if tag in SPACED and not (tag in LISTS and node.tag == "li") else 1
            page.edge(margin)
            _flow(child, page, keep or tag in ("pre", "xmp"), inside)
            page.edge(margin)
        else:
            _flow(child, page, keep or tag == "textarea", inside)


_SECTIONS = frozenset(("thead", "tbody", "tfoot"))


def _has_row(node: Node) -> bool:
    todo = [node]
    while todo:
        for child in todo.pop().children:
            if isinstance(child, Node) and child.tag != "table":
                if child.tag == "tr":
                    return True
                todo.append(child)
    return False


def _parts(node: Node, shown: bool) -> Iterator[tuple[Node | str, bool]]:
    """The rows of a table, and what else is in it, each with whether it shows. Sections, and elements that wrap rows, are looked into."""
    for child in node.children:
        if isinstance(child, str):
            yield child, shown
        elif visible(child) and child.tag not in ("colgroup", "col"):
            inside = _shown(child, shown)
            if child.tag in _SECTIONS or child.tag not in ("tr", "table", "caption") and _has_row(child):
                yield from _parts(child, inside)
            else:
                yield child, inside


def _cells(row: Node, keep: bool, shown: bool) -> Iterator[tuple[list[str], int, int]]:
    """(lines, columns, rows) of each cell; text and elements that are no cells are cells of one column."""
    for cell in row.children:
        page = _Page()
        if isinstance(cell, str):
            if shown:
                page.text(cell, keep)
            if lines := page.done():
                yield lines, 1, 1
        elif visible(cell):
            _flow(Node("#cell") if cell.tag == "br" else cell, page, keep, _shown(cell, shown))
            yield page.done(), min(max(_number(cell.get("colspan"), 1), 1), MAX_COLUMNS), min(max(_number(cell.get("rowspan"), 1), 1), MAX_ROWS)


class _Spans:
    """Columns that cells of rows above still take: (first, end, last row), by column. Neighbours that end in one row are one."""

    def __init__(self):
        self.held: list[tuple[int, int, int]] = []
        self.steps = STEPS

    def place(self, row: int, cells: list[tuple]) -> list[tuple[int, list[str], int, int]]:
        """(column, lines, across, down) of a row's cells: each stands in the first column that is free."""
        held = [x for x in self.held if x[2] >= row] if self.steps > 0 else []
        out, new, column, at = [], [], 0, 0
        self.steps -= len(held)
        for lines, across, down in cells:
            while at < len(held) and held[at][0] <= column:
                column = max(column, held[at][1])
                at += 1
            out.append((column, lines, across, down))
            if down > 1:
                new.append((column, column + across, row + down - 1))
            column += across
        self.held = []
        for x in sorted(held + new):
            if self.held and self.held[-1][1] == x[0] and self.held[-1][2] == x[2]:
                x = (self.held.pop()[0], *x[1:])
            self.held.append(x)
        self.last = max([column, *(x[1] for x in self.held)]) - 1
        return out


def _aligned(grid: list[tuple[list[tuple], int]]) -> list[str] | None:
    """Rows whose cells are padded to their columns' widths; None if that is longer than the text allows.

    A cell wider than ``PAD`` is neither padded nor counted for its column. ``GROWTH`` times what the cells hold, blanks left out, bounds the output.
    """
    widths: dict[int, int] = {}
    held = cells = 0
    for row, _ in grid:
        for k, lines, _, _ in row:
            if lines:
                sizes = [w for x in lines if (w := _width(x)) <= PAD]
                widths[k] = max(widths.get(k, 0), *sizes, 0)
                held += sum(len(x) - x.count(" ") for x in lines)
            cells += 1
    filled = sorted(widths)
    before = [0]
    for k in filled:
        before.append(before[-1] + widths[k])
    size = 0
    for row, last in grid:
        height = max((len(lines) for _, lines, _, _ in row), default=0)
        size += height * (3 * (last + 1) + before[bisect_right(filled, last)]) + sum(len(x) for _, lines, _, _ in row for x in lines)
    if size > GROWTH * (held + 3 * cells) + 200:
        return None
    out = []
    for row, last in grid:
        of = {k: lines for k, lines, _, _ in row}
        for i in range(max((len(lines) for lines in of.values()), default=0)):
            texts = [of[k][i] if k in of and i < len(of[k]) else "" for k in range(last + 1)]
            out.append(" | ".join(x + " " * (widths.get(k, 0) - _width(x)) for k, x in enumerate(texts)).rstrip())
    return out


def _table(node: Node, keep: bool, shown: bool) -> list[str]:
    """Captions and stray content first, then rows whose cells are padded to their columns' widths and parted by `` | `` (``_aligned``).

    A cell stands in the first column that no cell from above reaches into; its text is in its first row and column. Where aligned rows would be
    out of proportion, a row is its filled cells, line by line, parted by `` | ``.
    """
    before, grid, spans = _Page(), [], _Spans()
    for part, seen in _parts(node, shown):
        if isinstance(part, str):
            if seen:
                before.text(part, keep)
        elif part.tag != "tr":
            before.edge(1)
            holder = Node("#part")
            holder.children.append(part)
            _flow(holder, before, keep, seen)
            before.edge(1)
        else:
            row = spans.place(len(grid), list(_cells(part, keep, seen)))
            grid.append((row, spans.last))
    out = before.done()
    lines = _aligned(grid)
    if lines is None:
        lines = []
        for row, _ in grid:
            full = [x for _, x, _, _ in row if x]
            if len(full) == 1 or any(len(x) > 1 for x in full):
                lines += [line for x in full for line in x]
            elif full:
                lines.append(" | ".join(x[0] for x in full))
    return out + lines


def _title(root: Node) -> str | None:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "title":
            return " ".join(unescape("".join(x for x in node.children if isinstance(x, str))).split())
        todo.extend(x for x in reversed(node.children) if isinstance(x, Node))
    return None


def render(html: str | None) -> tuple[str | None, str | None]:
    """(title, visible text); both null for null."""
    if html is None:
        return None, None
    root = parse(html)
    page = _Page()
    if sys.getrecursionlimit() < 8 * MAX_DEPTH:
        sys.setrecursionlimit(8 * MAX_DEPTH)
    _flow(root, page, False)
    lines = page.done()
    while lines and not lines[-1]:
        lines.pop()
    return _title(root), "\n".join(lines)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, title, text, n_chars) of every row: the visible text of the whole page, in one narrow pass.

    Start and end tags that HTML lets authors leave out are implied. Head, scripts, styles, templates, ``hidden`` elements,
    closed details and dialogs and elements styled ``display:none`` are not visible, nor is text styled ``visibility:hidden``
    unless a descendant is made visible again. Text of svg, math and object elements is. Only inline styles are read.
    Blocks begin lines; paragraphs, headings, lists and tables have a blank line around them; list items are
    marked and indented; cells are aligned in columns, spans counted and wide characters as two. What stands in a table outside its rows comes before them. White space is collapsed except in ``pre`` and ``textarea``.

    Null html: null text and title. Empty html: empty text. Text without any tag is itself. Pages are rendered one by one, and tables whose aligned form would be
    out of proportion are not aligned (``_aligned``), so memory is bounded by some twenty times the longest page, of any length. Repeated rows are rendered each; ids may be null. Other columns, whatever their names, are
    ignored. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [render(x) for x in part.column(1).to_pylist()]
                titles, texts = ([x[k] for x in found] for k in (0, 1))
                sizes = [None if x is None else len(x) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(titles, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["page_id", "title", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, title string, text string, n_chars long")
