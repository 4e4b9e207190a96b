"""Text of web pages as a reader sees it.

A tree builder opens and closes elements as HTML implies (list items, paragraphs, rows, cells, options end each other;
a cell without a row gets one). An element is laid out when it closes, from what its children left: inline text runs
together with white space collapsed, blocks begin on a line of their own, those with margins are set apart by an empty
line, list items carry their bullet or number and indent what is in them, and the cells of a table are padded to
columns. Text that isn't displayed is left out: head, scripts, styles, templates and the like, ``hidden``, ``display:
none``, ``visibility: hidden`` unless a child is visible again, closed dialogs, and all but the summary of closed
details. Of drawings the texts are shown, and of formulas all but annotations.

The lines of a cell stand below each other in its column, whatever its width; a cell over several columns widens the last
of them if it needs to. Spans end at ``ACROSS`` columns and ``DOWN`` rows, the limits that HTML sets.

Elements nested deeper than ``DEPTH`` are laid out at that depth, as browsers do; their text stays. Blanks take at most
``PADDING`` times a table's text, or ``FREE`` characters if that is more: where they would take more (one very long cell
above very many rows), columns are padded to the greatest width that fits, and longer cells stand out; where even the bars
between columns would (stairs of cells that cover thousands of rows), rows show their own cells only. No text is lost.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, small_batches

DEPTH = 512
ACROSS, DOWN = 1000, 65534
PADDING, FREE = 16, 1 << 20
COLUMN = " | "

# Elements of HTML by their role in layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template noscript iframe object audio video canvas datalist noembed noframes".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre figure fieldset hr details".split())
PLAIN = frozenset(
    "html body div section article aside nav header footer main address form center li dt dd tr caption figcaption legend summary dialog hgroup search option optgroup".split()
)
ITEMS = frozenset("ul ol menu dir".split())
# An opening tag ends open elements of these names, up to the nearest one of those it cannot reach beyond.
ENDS = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "option": ("option", "select datalist"),
    "optgroup": ("option optgroup", "select"),
    "td": ("td th", "table"),
    "th": ("td th", "table"),
    "tr": ("tr", "table"),
    "thead": ("thead tbody tfoot caption colgroup", "table"),
    "tbody": ("thead tbody tfoot caption colgroup", "table"),
    "tfoot": ("thead tbody tfoot caption colgroup", "table"),
    "body": ("head", "html"),
}
ENDS = {tag: (frozenset(ended.split()), frozenset(wall.split())) for tag, (ended, wall) in ENDS.items()}
ROW_GROUPS = frozenset("table thead tbody tfoot".split())
P_WALLS = frozenset("table td th caption button object".split())
# Everything that may stand in an open head; any other element ends it.
IN_HEAD = frozenset("base link meta title style script noscript template basefont bgsound".split())
# Foreign content: drawings show the text of these, formulas that of all but annotations; HTML may stand in the points.
NOT_DRAWN = frozenset("defs symbol clippath mask pattern marker lineargradient radialgradient filter metadata desc title".split())
NOT_READ = frozenset("annotation annotation-xml".split())
BUTTONS = frozenset("submit button reset".split())
TOKENS = frozenset("mi mo mn ms mtext".split())
POINTS = TOKENS | {"foreignobject"}
# Opening tags that end a drawing or formula in which they stand.
HTML_ONLY = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
_BLANK = re.compile(r"[ \t\n\r\f]+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(\w+)", re.I)


class Block:
    def __init__(self, lines: list[str], margin: bool):
        self.lines, self.margin = lines, margin


class Row:
    def __init__(self, cells: list[tuple[list[str], int, int]]):
        self.cells = cells


BREAK = object()


class Node:
    __slots__ = ("tag", "attrs", "shown", "visible", "pre", "parts", "number", "foreign", "drawn")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None):
        self.tag, self.attrs = tag, attrs
        style = attrs.get("style") or ""
        outer = parent.foreign if parent is not None and parent.tag not in POINTS else None
        self.foreign = tag if tag in ("svg", "math") else outer
        self.drawn = outer != "svg" and tag != "svg" or tag == "text" or outer == "svg" and parent.drawn or tag == "foreignobject"
        unseen = UNSEEN | NOT_DRAWN if outer == "svg" else UNSEEN | NOT_READ if outer == "math" else UNSEEN
        hidden = tag in unseen or "hidden" in attrs or bool(_NOT_SHOWN.search(style)) or tag == "dialog" and "open" not in attrs
        if parent is not None and parent.tag == "details" and "open" not in parent.attrs:
            hidden = hidden or tag != "summary"
        self.shown = not hidden and (parent is None or parent.shown)
        said = _VISIBILITY.search(style)
        inherited = parent is None or parent.visible
        self.visible = said[1].lower() not in ("hidden", "collapse") if said and said[1].lower() != "inherit" else inherited
        self.pre = tag in ("pre", "textarea") or parent is not None and parent.pre
        own = parent is None or tag in SPACED or tag in PLAIN or tag in ("td", "th")
        self.parts: list = [] if own else parent.parts
        self.number = int(attrs["start"]) if tag == "ol" and re.fullmatch(r"-?\d{1,9}", attrs.get("start") or "") else 1


def flow(parts: list) -> list[str]:
    """The lines of inline text, breaks and blocks, one after the other."""
    if len(parts) == 1 and isinstance(parts[0], Block):
        return parts[0].lines
    lines: list[str] = []
    line: list[str] = []
    gap = False

    rows: list[Row] = []  # in a row, of row groups outside a table

    def place(block: Block) -> None:
        nonlocal gap
        end()
        if block.lines:
            if lines and (gap or block.margin):
                lines.append("")
            lines.extend(block.lines)
            gap = block.margin

    def end() -> None:
        nonlocal gap
        text = "".join(line).rstrip(" ")
        line.clear()
        if text:
            if gap and lines:
                lines.append("")
            lines.append(text)
            gap = False

    for part in parts:
        if isinstance(part, Row):
            rows.append(part)
            continue
        if rows and not (isinstance(part, str) and not _BLANK.sub("", part)):
            place(Block(table_lines(rows), False))
            rows.clear()
        if part is BREAK:
            end()
        elif isinstance(part, str):
            text = _BLANK.sub(" ", part)
            if text.startswith(" ") and (not line or line[-1].endswith(" ")):
                text = text[1:]
            if text:
                line.append(text)
        elif isinstance(part, tuple):  # preformatted
            for i, text in enumerate(part[0].split("\n")):
                if i:
                    end()
                if text:
                    line.append(text)
        elif isinstance(part, Block):
            place(part)
    if rows:
        place(Block(table_lines(rows), False))
    end()
    return lines


def _span(attrs: dict[str, str | None], name: str) -> int:
    said = attrs.get(name) or ""
    return min(ACROSS if name == "colspan" else DOWN, max(1, int(said))) if re.fullmatch(r"\d{1,9}", said) else 1


def _column_widths(grid: list[dict[int, tuple[list[str], int]]]) -> dict[int, int]:
    """Each column's widest line, then what cells over several columns need beyond them."""
    width: dict[int, int] = {}
    wide: dict[tuple[int, int], int] = {}
    for placed in grid:
        for c, (lines, across) in placed.items():
            longest = max(map(len, lines), default=0)
            if across == 1:
                width[c] = max(width.get(c, 0), longest)
            else:
                wide[c, across] = max(wide.get((c, across), 0), longest)
                for i in range(c, c + across):
                    width.setdefault(i, 0)
    for (c, across), longest in sorted(wide.items(), key=lambda x: x[0][::-1]):
        room = sum(width[i] for i in range(c, c + across)) + len(COLUMN) * (across - 1)
        width[c + across - 1] += max(0, longest - room)
    return width


def _fitting(width: dict[int, int], lines: int, text: int) -> dict[int, int]:
    """The widths, limited to the greatest one at which ``lines`` padded lines stay within the allowance."""
    allowed = max(FREE, PADDING * text)
    takes = lambda most: lines * sum(min(most, w) for w in width.values())
    low, high = 0, max(width.values(), default=0)
    if takes(high) <= allowed:
        return width
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if takes(middle) <= allowed else (low, middle - 1)
    return {c: min(low, w) for c, w in width.items()}


def _trimmed(lines: list[str]) -> list[str]:
    """A cell's lines without trailing blanks and without empty ones around them."""
    lines = [x.rstrip() for x in lines]
    held = [i for i, x in enumerate(lines) if x]
    return lines[held[0] : held[-1] + 1] if held else []


def table_lines(rows: list[Row]) -> list[str]:
    """Rows with their cells in columns, each as many lines high as its highest cell. A table of one column is laid out as blocks."""
    grid: list[dict[int, tuple[list[str], int]]] = []
    held: list[tuple[int, int, int]] = []  # from and to which column a cell from above still covers how many rows
    blocks: list[str] = []
    for row in rows:
        placed: dict[int, tuple[list[str], int]] = {}
        at = above = 0
        down_from: list[tuple[int, int, int]] = []
        for lines, across, down in row.cells:
            while above < len(held) and held[above][0] <= at:
                at = max(at, held[above][1])
                above += 1
            placed[at] = (_trimmed(lines), across)
            blocks.extend(lines)
            if down > 1:
                down_from.append((at, at + across, down))
            at += across
        held = sorted((start, end, n - 1) for start, end, n in [*held, *down_from] if n > 1)
        grid.append(placed)
    if all(set(p) <= {0} and all(s == 1 for _, s in p.values()) for p in grid):
        return blocks
    # columns at which no cell begins or ends take no room
    edges = sorted({x for placed in grid for c, (_, across) in placed.items() for x in (c, c + across)})
    column = {x: i for i, x in enumerate(edges)}
    grid = [{column[c]: (lines, column[c + across] - column[c]) for c, (lines, across) in placed.items()} for placed in grid]
    heights = [max((len(lines) for lines, _ in placed.values()), default=0) for placed in grid]
    text = sum(len(x) for placed in grid for lines, _ in placed.values() for x in lines)
    width = _fitting(_column_widths(grid), sum(heights), text)
    ends = [max((c + s for c, (_, s) in placed.items()), default=0) for placed in grid]
    if len(COLUMN) * sum(map(operator.mul, ends, heights)) > max(FREE, PADDING * text):
        # stairs of cells that cover very many rows: each row's own cells, not in columns
        grid, width = [dict(enumerate((lines, 1) for lines, _ in placed.values())) for placed in grid], {}
        ends = list(map(len, grid))
    out = []
    for placed, height, last in zip(grid, heights, ends):
        for line in range(height):
            cells = []
            c = 0
            while c < last:
                lines, across = placed.get(c, ((), 1))
                room = sum(width.get(i, 0) for i in range(c, c + across)) + len(COLUMN) * (across - 1)
                cells.append((lines[line] if line < len(lines) else "").ljust(room))
                c += across
            out.append(COLUMN.join(cells).rstrip())
    return out


class Page(HTMLParser):
    """Feeds a page's tags and texts to the tree; ``text`` is the page as read."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Node("html", {}, None)]

    def handle_starttag(self, tag: str, given: list[tuple[str, str | None]]) -> None:
        attrs = dict(reversed(given))
        if tag == "html":
            return
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self._close(len(self.open) - 1)
        while tag in HTML_ONLY and self.open[-1].foreign and self.open[-1].tag not in POINTS:
            self._close(len(self.open) - 1)
        if tag in ENDS:
            self._end(*ENDS[tag])
        if (tag in SPACED or tag in PLAIN) and tag not in ("tr", "caption", "option", "optgroup"):
            self._end(frozenset(("p",)), P_WALLS)
        if tag in ("td", "th") and self.open[-1].tag in ROW_GROUPS:
            self.open.append(Node("tr", {}, self.open[-1]))
        top = self.open[-1]
        if tag == "br" or tag == "hr":
            top.parts.append(BREAK if tag == "br" else Block([], True))
        elif tag == "input":
            self._button(attrs)
        elif tag not in VOID and (len(self.open) < DEPTH or tag in UNSEEN or tag in ("svg", "math") or top.foreign):
            node = Node(tag, attrs, top)
            self._apart(node)
            self.open.append(node)
        elif tag in SPACED or tag in PLAIN:
            top.parts.append(BREAK)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("br", "html", "body"):
            if tag == "br":
                self.open[-1].parts.append(BREAK)
            return
        wall = frozenset() if tag == "table" else frozenset(("table", "td", "th", "caption")) - {tag} if tag not in ("tr", "thead", "tbody", "tfoot") else frozenset(("table",))
        self._end(frozenset((tag,)), wall)

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if top.tag == "head" and data.strip():
            self._close(len(self.open) - 1)
            top = self.open[-1]
        shown = top.shown and top.visible and top.drawn and not (top.tag == "details" and "open" not in top.attrs)
        if shown:
            top.parts.append((data,) if top.pre else data)

    def _button(self, attrs: dict[str, str | None]) -> None:
        """Buttons show their value."""
        if (attrs.get("type") or "").lower() in BUTTONS:
            node = Node("input", attrs, self.open[-1])
            if node.shown and node.visible and node.drawn:
                self.handle_data(f" {attrs.get('value') or ''} ")

    def _apart(self, node: Node) -> None:
        """A drawing's texts and a formula's tokens stand apart by a space."""
        if node.foreign == "svg" and node.tag in ("text", "foreignobject") or node.foreign == "math" and node.tag in TOKENS:
            node.parts.append(" ")

    def _end(self, names: frozenset[str], wall: frozenset[str]) -> None:
        """Close the nearest open element of these names, unless a wall stands before it."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in names:
                self._close(i)
                return
            if self.open[i].tag in wall:
                return

    def _close(self, down_to: int) -> None:
        while len(self.open) > down_to:
            node = self.open.pop()
            parent = self.open[-1]
            if not node.shown:
                continue
            self._apart(node)
            tag = node.tag
            if tag in ("td", "th"):
                lines = flow(node.parts)
                cell = (lines, _span(node.attrs, "colspan"), _span(node.attrs, "rowspan"))
                parent.parts.append(cell if parent.tag == "tr" else Block(lines, False))
            elif tag == "tr":
                cells = [x for x in node.parts if isinstance(x, tuple) and len(x) == 3]
                rest = flow([x for x in node.parts if not (isinstance(x, tuple) and len(x) == 3)])
                row = Row(([(rest, 1, 1)] if rest else []) + cells)
                parent.parts.append(row if parent.tag in ROW_GROUPS else Block(table_lines([row]), False))
            elif tag == "table":
                rows = [x for x in node.parts if isinstance(x, Row)]
                rest = flow([x for x in node.parts if not isinstance(x, Row)])
                parent.parts.append(Block(rest + table_lines(rows), True))
            elif tag == "li":
                lists = next((n for n in reversed(self.open) if n.tag in ITEMS), None)
                mark = "- "
                if lists is not None and lists.tag == "ol":
                    mark, lists.number = f"{lists.number}. ", lists.number + 1
                lines = flow(node.parts)
                parent.parts.append(Block([(mark if i == 0 else " " * len(mark) * bool(x)) + x for i, x in enumerate(lines)], False))
            elif tag in SPACED or tag in PLAIN:
                nested = tag in ITEMS and any(n.tag == "li" for n in reversed(self.open))
                parent.parts.append(Block(flow(node.parts), tag in SPACED and not nested))

    def text(self) -> str:
        self.close()
        self._close(1)
        return "\n".join(flow(self.open[0].parts))


def page_text(html: str | None) -> str:
    page = Page()
    page.feed(html or "")
    return page.text()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_lines of every row of ``pages`` (page_id, url, html).

    A null or empty page has an empty text and no lines. Repeated rows stay. An empty table gives no rows.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(h) for h in batch.column(2).to_pylist()]
            lines = [t.count("\n") + 1 if t else 0 for t in texts]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(lines, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_lines"])

    given = only(pages, "page_id", "url", "html")
    schema = given.selectExpr("page_id", "url", "'' AS text", "0L AS n_lines").schema
    return given.mapInArrow(run, schema)
