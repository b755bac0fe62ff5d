"""HTML extraction as layout-aware rendering.

A tree builder closes what HTML leaves open (implied end tags, void elements, stray end tags) and a renderer emits all visible
text of the tree: blocks on lines of their own with blank lines around paragraphs and headings, list items with their bullet
or number and indented by depth, table cells of several lines and several rows or columns padded to their column's width
(East Asian wide characters count twice), preformatted text as it is.

Visibility follows elements that have no text of their own on a page, the ``hidden`` attribute, closed ``details`` and
``dialog``, and ``display``, ``opacity`` and ``visibility`` in ``style``; visible parts of invisible elements are shown.  Of a
drop-down only the chosen option is shown, of a list box every option.  Scripts count as on, so ``noscript`` and what stands
in for media that a browser shows have no text.

Tree and page are walked with stacks of their own, so nesting has no limit; only the indentation stops to grow at
``INDENT_MOST`` columns, and the cells of tables within more than ``ALIGNED_MOST`` others, as those of tables of one column,
stand below each other.

Defined results: null and empty pages give empty text; unclosed, stray and broken mark-up is read as far as it goes and never
fails; a very long page is one block; repeated rows are rendered each; an empty table gives an empty table; further columns of
the input are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, read_table

#: Columns that indentation takes at most, and tables within tables whose cells are set side by side.
INDENT_MOST, ALIGNED_MOST = 80, 12
#: Fixed values of HTML: elements without content, elements whose text is not shown, blocks, blocks with space around, and the
#: largest numbers of columns and rows of a cell.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template noscript object iframe audio video canvas datalist annotation annotation-xml rp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
SPAN_MOST = {"colspan": 1000, "rowspan": 65534}
#: Which open elements a start tag ends, and which elements keep it from looking further out.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
P_WALLS = {"table", "td", "th", "li", "dd", "button", "object", "blockquote", "div", "section"}
ENDS_P = BLOCK - {"html", "body", "dd", "dt", "li", "caption", "legend", "summary"} | {"hr"}
TABLE_PARTS = ("table", "tr", "tbody", "thead", "tfoot", "body", "html")
GAP = re.compile(r"[ \t\n\r\f]+")
WHITE = " \t\n\r\f"
ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]
NUMBER = re.compile(r"\s*([+-]?[0-9]+)")


class Node:
    __slots__ = ("tag", "attrs", "parts")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.parts = tag, attrs, []

    def number(self, name: str, default: int) -> int:
        """The integer that an attribute begins with, if it has one."""
        found = NUMBER.match(self.attrs.get(name, ""))
        return int(found.group(1)[:10]) if found else default


class Builder(HTMLParser):
    """Builds the tree.  ``places`` has the stack's indexes of each open tag, so that no look outwards walks the stack."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {"html": [0]}

    # The whole page is there from the start: what has no end takes the rest of it.
    def _to(self, mark: str, i: int) -> int:
        end = self.rawdata.find(mark, i)
        return len(self.rawdata) if end < 0 else end + len(mark)

    def parse_comment(self, i, report=True):
        return self._to("-->", i + 2)

    def parse_html_declaration(self, i):
        return self.parse_comment(i) if self.rawdata.startswith("<!--", i) else self._to(">", i)

    def parse_pi(self, i):
        return self._to(">", i)

    def parse_bogus_comment(self, i, report=True):
        return self._to(">", i)

    def parse_starttag(self, i):
        return len(self.rawdata) if self.rawdata.find(">", i) < 0 else super().parse_starttag(i)

    def parse_endtag(self, i):
        return len(self.rawdata) if self.rawdata.find(">", i) < 0 else super().parse_endtag(i)

    def _place(self, tags) -> int:
        """The innermost open element with one of the tags, or 0."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def _close(self, at: int) -> None:
        for node in self.open[at:]:
            self.places[node.tag].pop()
        del self.open[at:]

    def _end(self, tags: set, walls: set) -> None:
        while (at := self._place(tags)) > self._place(walls):
            self._close(at)

    def _end_head(self) -> None:
        if self.open[-1].tag == "head":
            self._close(len(self.open) - 1)

    def _push(self, node: Node) -> None:
        self.open[-1].parts.append(node)
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD:
            self._end_head()
        if tag in ENDS_P:
            self._end({"p"}, P_WALLS)
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push(Node("tr", {}))
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        if tag in VOID:
            self.open[-1].parts.append(node)
        else:
            self._push(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in ("svg", "math") or self._place(("svg", "math")):
            self._end_head()
            self.open[-1].parts.append(Node(tag, {k: v or "" for k, v in attrs}))
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self._end_head()
            self.open[-1].parts.append(Node("br", {}))
            return
        at = self._place((tag,))
        if at and (tag in TABLE_PARTS or at >= self._place(("table", "td", "th"))):
            self._close(at)

    def handle_data(self, data: str) -> None:
        if data.strip(WHITE):
            self._end_head()
        self.open[-1].parts.append(data)


def styles(node: Node) -> dict:
    found = {}
    for rule in node.attrs.get("style", "").split(";"):
        name, colon, value = rule.partition(":")
        if colon:
            found[name.strip().lower()] = value.partition("!")[0].strip().lower()
    return found


def gone(node: Node) -> bool:
    """Whether neither the element nor anything in it is shown."""
    if node.tag in UNSEEN:
        return True
    attrs = node.attrs
    if not attrs:
        return node.tag == "dialog"
    own = styles(node) if "style" in attrs else {}
    if own.get("display") == "none" or re.fullmatch(r"0*\.?0*%?", own.get("opacity", "1")):
        return True
    return ("hidden" in attrs and "display" not in own) or (node.tag == "dialog" and "open" not in attrs)


def seen_within(node: Node, seen: bool) -> bool:
    """Visibility is inherited, and may be set anew."""
    if "style" not in node.attrs:
        return seen
    value = styles(node).get("visibility")
    return seen if value in (None, "inherit", "unset") else value not in ("hidden", "collapse")


class Page:
    """Lines of text; blank lines never repeat."""

    def __init__(self, tables: int = 0):
        self.tables = tables
        self.lines: list[str] = []
        self.now: list[str] = []
        self.spaced = True  # nothing on the line, or a space at its end
        self.indent = 0
        self.mark = ""

    def text(self, data: str) -> None:
        data = GAP.sub(" ", data.replace("\xa0", " "))
        if self.spaced:
            data = data.lstrip(" ")
        if data:
            self.now.append(data)
            self.spaced = data[-1] == " "

    def _begin(self) -> str:
        begin = " " * min(self.indent, INDENT_MOST) + self.mark
        self.mark = " " * len(self.mark)
        return begin

    def line(self) -> None:
        now = "".join(self.now).rstrip(" ")
        if now:
            self.lines.append(self._begin() + now)
        self.now, self.spaced = [], True

    def blank(self) -> None:
        self.line()
        if self.lines and self.lines[-1]:
            self.lines.append("")

    def rows(self, rows: list[str]) -> None:
        self.line()
        for row in rows:
            self.lines.append((self._begin() + row).rstrip())

    def whole(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def plain(node: Node, seen: bool) -> str:
    """The text of an element as it stands, for preformatted ones."""
    out, todo = [], [(p, seen) for p in reversed(node.parts)]
    while todo:
        part, seen = todo.pop()
        if isinstance(part, str):
            if seen:
                out.append(part)
        elif part.tag == "br":
            out.append("\n")
        elif part.tag and not gone(part):
            seen = seen_within(part, seen)
            if part.tag in BLOCK:
                todo.append((Node("", {}), seen))
                if out and not out[-1].endswith("\n"):
                    out.append("\n")
            todo += [(p, seen) for p in reversed(part.parts)]
        elif not part.tag and out and not out[-1].endswith("\n"):  # a block ends
            out.append("\n")
    return "".join(out)


def width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in text)


def ordinal(n: int, kind: str) -> str:
    """An item's number in the kind of its list, where that can write it."""
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(97 + k) + out
        return out.upper() if kind == "A" else out
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, letters in ROMAN:
            out += letters * (n // value)
            n %= value
        return out.upper() if kind == "I" else out
    return str(n)


class Counter:
    """The numbers of a list's items."""

    def __init__(self, node: Node):
        self.step = -1 if "reversed" in node.attrs else 1
        items = sum(isinstance(p, Node) and p.tag == "li" and not gone(p) for p in node.parts) if self.step < 0 else 1
        self.next, self.kind = node.number("start", items), node.attrs.get("type", "1")

    def mark(self, item: Node) -> str:
        n = item.number("value", self.next)
        self.next = n + self.step
        return ordinal(n, self.kind) + ". "


#: A walk is a generator of the walks within it; ``run`` keeps them on a stack of its own.
Walk = Iterator["Walk"]


def run(walk: Walk) -> None:
    stack = [walk]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


class Grid:
    """A table's cells: (row, column, rows, columns, lines)."""

    def __init__(self):
        self.cells: list[tuple[int, int, int, int, list[str]]] = []
        self.row, self.column = -1, 0
        self.above: list[tuple[int, int, int]] = []  # columns (from, to) that cells of earlier rows take, and up to which row

    def begin_row(self) -> None:
        self.row, self.column = self.row + 1, 0
        self.above = sorted(c for c in self.above if c[2] > self.row)

    def end_group(self) -> None:
        self.above = []

    def add(self, lines: list[str], rows: int, columns: int) -> None:
        for begin, end, _ in self.above:
            if begin <= self.column < end:
                self.column = end
        if rows > 1:
            self.above.append((self.column, self.column + columns, self.row + rows))
        self.cells.append((self.row, self.column, rows, columns, lines))
        self.column += columns

    def written(self) -> list[str]:
        """The rows as lines, columns padded; columns where no cell begins take no place, and empty rows none."""
        begins = sorted({c for _, c, _, _, _ in self.cells})
        place = {c: i for i, c in enumerate(begins)}
        room = [0] * len(begins)
        wide = []
        for _, c, _, n, lines in self.cells:
            size = max(map(width, lines), default=0)
            end = bisect_left(begins, c + n)
            if end - place[c] <= 1:
                room[place[c]] = max(room[place[c]], size)
            else:
                wide.append((place[c], end, size))
        for begin, end, size in wide:
            room[end - 1] += max(0, size - sum(room[begin:end]) - 2 * (end - begin - 1))
        rows: dict[int, list] = {}
        for r, c, _, n, lines in self.cells:
            rows.setdefault(r, []).append((place[c], bisect_left(begins, c + n), lines))
        out = []
        for r in sorted(rows):
            for k in range(max(len(lines) for _, _, lines in rows[r])):
                line, at = [], 0
                for begin, end, lines in sorted(rows[r], key=lambda cell: cell[0]):
                    line.append(" " * sum(w + 2 for w in room[at:begin]))
                    text = lines[k] if k < len(lines) else ""
                    line.append(text + " " * (sum(w + 2 for w in room[begin:end]) - width(text)))
                    at = end
                out.append("".join(line).rstrip())
        return out


def columns(node: Node) -> int:
    """The most cells that a row of the table has."""
    most, todo = 0, [node]
    while todo:
        for p in todo.pop().parts:
            if isinstance(p, Node):
                if p.tag == "tr":
                    most = max(most, sum(isinstance(c, Node) and c.tag in ("td", "th") for c in p.parts))
                elif p.tag in ("thead", "tbody", "tfoot"):
                    todo.append(p)
    return most


def table(page: Page, node: Node, seen: bool) -> Walk:
    """Text and elements that stand outside rows come first, then captions and rows."""
    grid, captions = Grid(), []
    aligned = page.tables < ALIGNED_MOST and columns(node) > 1
    below: list[tuple[Node, bool]] = []

    def cell(part: Node, seen: bool) -> Walk:
        if not aligned:
            below.append((part, seen))
            return
        inner = Page(page.tables + 1)
        yield children(inner, part, seen, None)
        rows = part.number("rowspan", 1)
        if rows == 0:
            rows = SPAN_MOST["rowspan"]
        grid.add(inner.whole(), *(min(max(n, 1), SPAN_MOST[name]) for n, name in ((rows, "rowspan"), (part.number("colspan", 1), "colspan"))))

    def row(part: Node, seen: bool) -> Walk:
        grid.begin_row()
        for p in part.parts:
            if isinstance(p, Node):
                if p.tag in ("td", "th"):
                    if not gone(p):
                        yield cell(p, seen_within(p, seen))
                else:
                    yield render(page, p, seen)
            elif seen:
                page.text(p if p.strip(WHITE) else "")

    def group(part: Node, seen: bool) -> Walk:
        for p in part.parts:
            if isinstance(p, str):
                if seen and p.strip(WHITE):
                    page.text(p)
            elif p.tag in ("caption", "tr", "thead", "tbody", "tfoot", "colgroup"):
                within = seen_within(p, seen)
                if gone(p):
                    continue
                if p.tag == "caption":
                    captions.append((p, seen))
                elif p.tag == "tr":
                    yield row(p, within)
                else:
                    grid.end_group()
                    yield group(p, within)
                    grid.end_group()
            else:
                yield render(page, p, seen)

    yield group(node, seen)
    page.line() if page.indent or page.mark else page.blank()
    for caption, seen in captions:
        yield render(page, caption, seen)
    for part, seen in below:
        page.line()
        yield children(page, part, seen, None)
        page.line()
    page.rows([line for line in grid.written() if line])


def chosen(node: Node) -> list[Node]:
    """The options of a select that are in sight."""
    options, todo = [], list(reversed(node.parts))
    while todo:
        part = todo.pop()
        if isinstance(part, Node) and not gone(part):
            if part.tag in ("option", "optgroup"):
                options.append(part)
            if part.tag != "option":
                todo += reversed(part.parts)
    if "multiple" in node.attrs or node.number("size", 1) > 1:
        return options
    options = [o for o in options if o.tag == "option"]
    marked = [o for o in options if "selected" in o.attrs] or [o for o in options if "disabled" not in o.attrs][:1]
    return marked[-1:]


def control(page: Page, node: Node) -> None:
    """What the browser draws of an input."""
    kind = node.attrs.get("type", "text").lower()
    if kind in ("submit", "button", "reset"):
        page.text(" " + node.attrs.get("value", "") + " ")
    elif kind == "image":
        page.text(node.attrs.get("alt", ""))
    elif kind not in ("hidden", "password", "checkbox", "radio", "range", "color", "file"):
        page.text(" " + (node.attrs.get("value") or node.attrs.get("placeholder", "")) + " ")


def render(page: Page, node: Node, seen: bool = True, counter: Counter | None = None) -> Walk:
    tag = node.tag
    if gone(node):
        return
    seen = seen_within(node, seen)
    if tag == "br":
        if not page.now and page.lines and page.lines[-1]:
            page.blank()
        page.line()
    elif tag == "hr":
        page.blank()
    elif tag == "img":
        page.text(node.attrs.get("alt", "") if seen else "")
    elif tag == "input":
        if seen:
            control(page, node)
    elif tag == "select":
        for option in chosen(node):
            if seen:
                page.text(" ")
                page.text(node_label(option))
                page.line() if "multiple" in node.attrs or node.number("size", 1) > 1 else page.text(" ")
    elif tag in ("svg", "math"):
        yield drawing(page, node, seen)
    elif tag in BLOCK:
        space = page.blank if tag in SPACED and not (page.indent or page.mark) else page.line
        space()
        yield block(page, node, seen, counter)
        (page.blank if tag in SPACED and not (page.indent or page.mark) else page.line)()
    elif tag == "textarea":
        page.rows(plain(node, seen).strip("\n").split("\n"))
    else:
        yield children(page, node, seen, counter)


def node_label(option: Node) -> str:
    return option.attrs.get("label", "") if option.tag == "optgroup" else option.attrs.get("label") or plain(option, True)


def drawing(page: Page, node: Node, seen: bool) -> Walk:
    """Formulas as their text; of a picture only what stands in text elements."""
    for p in node.parts:
        if isinstance(p, str):
            if node.tag != "svg" and seen:
                page.text(p)
        elif p.tag in ("text", "foreignobject", "tspan", "textpath"):
            page.text(" ")
            yield children(page, p, seen_within(p, seen), None)
            page.text(" ")
        elif p.tag not in ("desc", "metadata", "defs", "symbol") and not gone(p):
            inner = Node("svg" if node.tag == "svg" else p.tag, p.attrs)
            inner.parts = p.parts
            yield drawing(page, inner, seen_within(p, seen))


def block(page: Page, node: Node, seen: bool, counter: Counter | None) -> Walk:
    tag, before = node.tag, (page.indent, page.mark)
    if tag == "pre":
        page.rows(plain(node, seen).strip("\n").split("\n"))
    elif tag == "table":
        yield table(page, node, seen)
    elif tag == "li":
        page.mark = ("- " if counter is None else counter.mark(node)) if seen else ""
        yield children(page, node, seen, counter)
        page.line()
        page.mark = before[1]
    elif tag in ("ul", "ol", "menu", "dir"):
        page.indent, page.mark = page.indent + len(page.mark), ""
        yield children(page, node, seen, Counter(node) if tag == "ol" else None)
        page.line()
        page.indent, page.mark = before
    elif tag in ("blockquote", "dd"):
        page.indent += 2
        yield children(page, node, seen, counter)
        page.line()
        page.indent = before[0]
    elif tag == "details" and "open" not in node.attrs:
        summary = next((p for p in node.parts if isinstance(p, Node) and p.tag == "summary"), None)
        if summary is not None:
            yield render(page, summary, seen, counter)
    else:
        yield children(page, node, seen, counter)


def children(page: Page, node: Node, seen: bool, counter: Counter | None) -> Walk:
    for p in node.parts:
        if isinstance(p, Node):
            yield render(page, p, seen, counter)
        elif seen:
            page.text(p)


def html_text(html: str) -> str:
    builder = Builder()
    builder.feed(html)
    builder.close()
    page = Page()
    run(render(page, builder.root))
    return "\n".join(page.whole())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col`` and text, n_chars, n_lines of every page."""

    def make(pages: list[str]) -> dict:
        texts = [html_text(p) for p in pages]
        return {"text": texts, "n_chars": [len(t) for t in texts], "n_lines": [t.count("\n") + 1 if t else 0 for t in texts]}

    return map_texts(pages, [id_col], html_col, "text string, n_chars long, n_lines long", make)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages").select("page_id", "html"))
