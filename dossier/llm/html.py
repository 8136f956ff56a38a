"""Visible text of HTML pages: a tree builder with implied tags, visibility rules and a layout-aware renderer."""

from __future__ import annotations

import html
import re
import textwrap
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import column, map_batches, with_row

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head title rp script style template noscript iframe object embed audio video canvas datalist noembed noframes".split())
#: Parts of drawings and formulas that name or describe what is shown, and so are not shown.
UNDRAWN = frozenset("title desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul tr caption thead tbody tfoot".split()
)
#: Blocks with an empty line before and behind them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: Start tags that close an open p.
CLOSES_P = BLOCK - frozenset("body html tr thead tbody tfoot caption li dd dt legend option optgroup".split())
#: By start tag: open elements that it ends, and those that bar the search.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("optgroup", "option"), ("select",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
}
#: By start tag of a table's part: the open elements that it can stand in.
GROUPS = ("tbody", "thead", "tfoot")
PARTS = dict.fromkeys((*GROUPS, "caption", "colgroup"), ("table",)) | {"tr": (*GROUPS, "table"), "td": ("tr", *GROUPS, "table"), "th": ("tr", *GROUPS, "table"), "col": ("colgroup", "table")}
#: End tags that reach past open cells and tables.
CROSSES = frozenset("tr tbody thead tfoot table td th".split())
SCOPE = frozenset("html table td th caption template button".split())
#: Fixed values of the standard: columns that a cell spans at most, and equal formatting elements that are opened again.
MOST_SPAN, MOST_AGAIN = 1000, 3
#: Spaces before a line at most; characters at which a table's cells are wrapped, the first that keeps padding under PADDED times its text.
MOST_INDENT, PADS, PADDED = 80, (120, 60, 30, 15, 8), 8

# A quote opens a value only after '='; elsewhere it is an ordinary character.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\x00]*)"
    r"((?:[\s/]|[^\s/>][^\s/>=]*+(?:\s*=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)?)?)*+)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*(?=;|\Z)", re.IGNORECASE)
DRAWN = frozenset(("svg", "math"))
BUTTONS = {"submit": "Submit", "reset": "Reset", "button": ""}
BLANK = re.compile(r"[ \t\n\r\f]+")


@dataclass(slots=True)
class Node:
    name: str
    attributes: str = ""
    children: list = field(default_factory=list)

    def get(self, wanted: str) -> str | None:
        """An attribute's value; '' if it stands without one, None if it isn't there."""
        if wanted not in self.attributes.lower():
            return None
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == wanted:
                return html.unescape(next((v for v in m.groups()[1:] if v is not None), ""))
        return None

    def removed(self) -> bool:
        """Neither the element nor anything below it is rendered."""
        if self.name in HIDDEN:
            return True
        if not self.attributes:
            return self.name == "dialog" or self.name == "input"
        if self.name == "input" and self.label() is None:
            return True
        shown = self.declared("display")
        if shown is not None:
            return shown == "none"
        return self.get("hidden") is not None or (self.name == "dialog" and self.get("open") is None)

    def declared(self, wanted: str) -> str | None:
        """The value of display or visibility in the element's style: the last declaration, of important ones if there are any."""
        style = self.get("style") if self.attributes else None
        if not style:
            return None
        found = [(bool(m[3]), m[2].lower()) for m in DECLARATION.finditer(re.sub(r"/\*.*?(?:\*/|\Z)", "", style, flags=re.DOTALL)) if m[1].lower() == wanted]
        return ([v for important, v in found if important] or [v for _, v in found] or [None])[-1]

    def unseen(self, above: bool) -> bool:
        """Text right below the element is not visible; visibility goes down from ``above`` until an element sets it anew."""
        value = self.declared("visibility") if self.attributes else None
        return above if value in (None, "inherit", "unset") else value in ("hidden", "collapse")

    def label(self) -> str | None:
        """What a button made by an input shows; None for other inputs."""
        kind = (self.get("type") or "").lower()
        if kind == "image":
            return self.get("alt") or ""
        return None if kind not in BUTTONS else BUTTONS[kind] if (value := self.get("value")) is None else value


class Stack:
    """The open elements, with the places of each name, so that a search costs the same however deep the tree is."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = defaultdict(list)

    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.top().children.append(node)
        self.places[node.name].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> list[Node]:
        """Closes all elements from place ``at`` on and gives those below it."""
        gone = self.nodes[at:]
        for node in gone:
            self.places[node.name].pop()
        del self.nodes[at:]
        return gone[1:]

    def last(self, names) -> int:
        """Place of the innermost open element of ``names``; 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places[n]), default=0)

    def first_after(self, names, bar: int) -> int | None:
        """Place of the outermost open element of ``names`` inside the one at ``bar``."""
        found = [p[k] for n in names if (p := self.places[n]) and (k := bisect_right(p, bar)) < len(p)]
        return min(found, default=None)


def build(source: str) -> Node:
    """The tree of a page. End tags may lack, stand astray or cross; all text lands somewhere."""
    root = Node("html")
    stack = Stack(root)
    reopen: list[Node] = []
    at = 0

    def text(part: str) -> None:
        if part:
            if reopen and BLANK.sub("", part):
                restore()
            stack.top().children.append(html.unescape(part) if "&" in part else part)

    def restore() -> None:
        for node in reopen:
            stack.push(Node(node.name, node.attributes))
        reopen.clear()

    def close_at(place: int) -> None:
        """Ends the element at ``place``; the formatting elements inside go on, MOST_AGAIN equal ones at most."""
        again = [x for x in stack.cut(place) if x.name in FORMATTING] + reopen
        seen: dict[tuple, int] = defaultdict(int)
        kept = []
        for x in reversed(again):
            seen[x.name, x.attributes] += 1
            if seen[x.name, x.attributes] <= MOST_AGAIN:
                kept.append(x)
        reopen[:] = kept[::-1]

    def close(names, bars) -> bool:
        """Ends the outermost open element of ``names`` above the next one of ``bars``."""
        found = stack.first_after(names, stack.last(bars))
        if found is not None:
            close_at(found)
        return found is not None

    def end_tag(name: str) -> None:
        if name in FORMATTING:
            for node in reversed(reopen):
                if node.name == name:
                    reopen.remove(node)
                    return
            inner = stack.last((name,))
            if inner and inner > stack.last(SCOPE):
                close_at(inner)
        elif name == "p":
            if not close(("p",), SCOPE):
                stack.top().children.append(Node("p"))
        elif name == "br":
            stack.top().children.append(Node("br"))
        elif name not in ("html", "body"):
            inner = stack.last((name,))
            if inner and (name in CROSSES or inner > stack.last(("td", "th", "table"))):
                close_at(inner)
        if name in ("td", "th", "tr", "table", "caption"):
            reopen.clear()

    def start_tag(name: str, attributes: str, at: int) -> int:
        """Opens an element; what follows the tag is read on from the place that comes back."""
        if name in ("html", "head") and len(stack.nodes) > 1:
            return at
        if stack.top().name == "head" and name not in ("title", "style", "script", "meta", "link", "base", "template", "noscript"):
            stack.cut(len(stack.nodes) - 1)
        if name in ("html", "body"):
            target = root if name == "html" else stack.nodes[place] if (place := stack.last(("body",))) else None
            if target is not None:
                target.attributes = target.attributes or attributes
                return at
        if name in CLOSES_P:
            close(("p",), SCOPE)
        if name in IMPLIED:
            close(*IMPLIED[name])
        if name in PARTS and stack.last(("table",)):
            while stack.top().name not in PARTS[name]:
                stack.cut(len(stack.nodes) - 1)
            if name in ("td", "th") and stack.top().name != "tr":
                stack.push(Node("tr"))
        if name in FORMATTING and reopen:
            restore()
        node = Node(name, attributes.rstrip("/"))
        if name in RAW:
            stack.top().children.append(node)
            end = re.compile(f"</{name}(?=[\\s/>])|</{name}\\Z", re.IGNORECASE | re.ASCII).search(source, at)
            inner = source[at : end.start()] if end else source[at:]
            node.children.append(html.unescape(inner) if name in ("textarea", "title") else inner)
            gt = source.find(">", end.start()) if end else -1
            return len(source) if gt < 0 else gt + 1
        if name in VOID or (name == "form" and stack.top().name in ("table", "tr", *GROUPS)):
            stack.top().children.append(node)
        else:
            stack.push(node)
        return at

    for m in TOKEN.finditer(source):
        if m.start() < at:
            continue
        text(source[at : m.start()])
        at = m.end()
        if m[2] and m[1]:
            end_tag(m[2].lower())
        elif m[2]:
            at = start_tag(m[2].lower(), m[3] or "", at)
    text(source[at:])
    return root


class Layout:
    """Lines of text under the block rules: blank runs are one space, blocks start lines, spaced blocks part them."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False
        self.prefix = ""
        self.mark = ""

    def write(self, text: str) -> None:
        part = BLANK.sub(" ", text)
        if part.startswith(" ") and (not self.line or self.line[-1].endswith(" ")):
            part = part[1:]
        if part:
            self.line.append(part)

    def end_line(self) -> None:
        line = "".join(self.line).strip(" ")
        self.line = []
        if line:
            self.put(line)

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append((self.prefix[:MOST_INDENT] + self.mark + line).rstrip(" "))
        if self.mark:
            self.indent(len(self.mark))
            self.mark = ""

    def indent(self, by: int) -> None:
        self.prefix = (self.prefix + " " * by)[:MOST_INDENT]

    def space(self) -> None:
        self.end_line()
        self.gap = True


def run(step: Iterator) -> None:
    """Runs a step and the steps that it yields, each to its end before the one that asked for it goes on.

    Steps call each other as functions would, but the depth of a page is not that of Python's calls.
    """
    steps = [step]
    while steps:
        inner = next(steps[-1], None)
        if inner is None:
            steps.pop()
        else:
            steps.append(inner)


def render(node: Node, out: Layout, ordinal: list[int] | None = None, unseen: bool = False, drawn: bool = False) -> Iterator:
    """Writes a node's visible text to ``out``; a step for ``run``. ``ordinal``: the last number of an ordered list.

    ``unseen``: text right below the node isn't visible; elements below may be again. ``drawn``: inside a drawing or formula.
    """
    for child in node.children:
        if isinstance(child, str):
            if not unseen:
                out.write(child)
            continue
        if child.removed() or (drawn and child.name in UNDRAWN):
            continue
        name, dark = child.name, child.unseen(unseen)
        if name in DRAWN or drawn:
            if child.name in ("text", "tspan", "foreignobject", "mtd", "mtr") or name in DRAWN:
                out.write(" ")
            yield render(child, out, None, dark, child.name != "foreignobject")
            out.write(" ")
            continue
        if name == "br":
            if out.line:
                out.end_line()
            else:
                out.gap = True
        elif name == "img":
            if not dark and (alt := child.get("alt")):
                out.write(alt)
        elif name == "input":
            if not dark:
                out.write(f" {child.label()} ")
        elif name == "pre":
            out.space()
            for line in "".join(flat(child, dark)).strip("\n").split("\n"):
                out.put(line.rstrip())
            out.gap = True
        elif name == "table":
            out.space()
            yield table(child, out, dark)
            out.gap = True
        elif name == "li":
            out.end_line()
            was, mark = out.prefix, out.mark
            if ordinal is not None:
                own = child.get("value") or ""
                ordinal[0] = int(own) if re.fullmatch(r"-?\d{1,9}", own) else ordinal[0] + 1
            out.mark = "- " if ordinal is None else f"{ordinal[0]}. "
            yield render(child, out, None, dark)
            out.end_line()
            out.prefix, out.mark = was, mark
        elif name in BLOCK:
            spaced = name in SPACED and not (name in ("ul", "ol") and out.prefix + out.mark)
            out.space() if spaced else out.end_line()
            was = out.prefix
            if name in ("blockquote", "dd"):
                out.indent(2)
            start = child.get("start") if name == "ol" else None
            yield render(child, out, [int(start) - 1 if start and re.fullmatch(r"-?\d{1,9}", start) else 0] if name == "ol" else None, dark)
            out.end_line()
            out.prefix = was
            out.gap = out.gap or spaced
        elif name in ("button", "select"):
            out.write(" ")
            yield render(child, out, None, dark)
            out.write(" ")
        elif child.children:
            yield render(child, out, ordinal, dark)


def flat(node: Node, unseen: bool = False):
    """The visible strings below a node in order, without layout."""
    todo = [(iter(node.children), unseen)]
    while todo:
        rest, dark = todo[-1]
        child = next(rest, None)
        if child is None:
            todo.pop()
        elif isinstance(child, str):
            if not dark:
                yield child
        elif child.name == "br":
            yield "\n"
        elif child.removed():
            continue
        elif child.name in ("img", "input"):
            if not child.unseen(dark):
                yield (child.get("alt") if child.name == "img" else child.label()) or ""
        else:
            todo.append((iter(child.children), child.unseen(dark)))


def rows_of(node: Node, unseen: bool) -> list[tuple[Node, Node, bool]]:
    """The rows of a table in order, each with the element that it stands in and whether its own text is not visible."""
    rows, todo = [], [(node, iter(node.children), unseen)]
    while todo:
        parent, rest, dark = todo[-1]
        child = next(rest, None)
        if child is None:
            todo.pop()
        elif isinstance(child, str) or child.removed():
            continue
        elif child.name in GROUPS:
            todo.append((child, iter(child.children), child.unseen(dark)))
        elif child.name == "tr":
            rows.append((child, parent, child.unseen(dark)))
    return rows


def stray(node: Node, out: Layout, unseen: bool) -> Iterator:
    """Writes what a table or row group has besides its rows."""
    for child in node.children:
        if isinstance(child, str):
            if not unseen:
                out.write(child)
        elif child.name == "tr" or child.removed():
            continue
        elif child.name in (*GROUPS, "colgroup"):
            yield stray(child, out, child.unseen(unseen))
        elif child.name == "caption":
            yield render(child, out, None, child.unseen(unseen))
            out.end_line()
        else:
            yield render(Node("div", "", [child]), out, None, unseen)
            out.end_line()


def span(cell: Node, name: str) -> int:
    value = cell.get(name) or ""
    return int(value) if re.fullmatch("[0-9]{1,9}", value) else 1


class Below:
    """Columns that cells of rows above cover: stretches with the last row that each reaches."""

    def __init__(self):
        self.stretches: list[tuple[int, int, int]] = []

    def free(self, column: int, row: int) -> int:
        """The first column from ``column`` on that is free in ``row``."""
        for start, stop, last in self.stretches:
            if start <= column < stop and last >= row:
                column = stop
        return column

    def cover(self, start: int, stop: int, last: int, row: int) -> None:
        kept = [x for x in self.stretches if x[2] >= row]
        kept.append((start, stop, last))
        joined: list[tuple[int, int, int]] = []
        for x in sorted(kept):
            if joined and joined[-1][1] == x[0] and joined[-1][2] == x[2]:
                joined[-1] = (joined[-1][0], x[1], x[2])
            else:
                joined.append(x)
        self.stretches = joined


def table(node: Node, out: Layout, unseen: bool) -> Iterator:
    """A table's caption, stray content and rows; cells are parted by bars and padded so that columns align, within the limits above."""
    yield stray(node, out, unseen)
    out.end_line()
    grid: list[list[tuple[int, list[str]]]] = []
    group, below = None, Below()
    for number, (row, parent, dark) in enumerate(rows_of(node, unseen)):
        if parent is not group:
            group, below = parent, Below()
        cells: list[tuple[int, list[str]]] = []
        at = 0
        for cell in row.children:
            if isinstance(cell, str):
                if dark or not BLANK.sub("", cell):
                    continue
                cell = Node("td", "", [cell])
            if cell.removed():
                continue
            at = below.free(at, number)
            inner = Layout()
            own = cell.name in ("td", "th")
            yield render(cell if own else Node("td", "", [cell]), inner, None, cell.unseen(dark) if own else dark)
            inner.end_line()
            cells.append((at, inner.lines or [""]))
            stop = at + min(max(1, span(cell, "colspan")), MOST_SPAN)
            if (down := span(cell, "rowspan")) != 1:
                below.cover(at, stop, number + down - 1 if down else 1 << 40, number)
            at = stop
        if cells:
            grid.append(cells)
    grid, width = fitted(grid)
    place = {at: k for k, at in enumerate(sorted(width))}
    for cells in grid:
        for k in range(max(len(lines) for _, lines in cells)):
            parts = [""] * (place[cells[-1][0]] + 1 if width else len(cells))
            for n, (at, lines) in enumerate(cells):
                parts[place[at] if width else n] = lines[k] if k < len(lines) else ""
            last = max((n for n, text in enumerate(parts) if text.strip()), default=-1)
            if last >= 0:
                before = [text.ljust(width[at]) for text, at in zip(parts[:last], place, strict=False)] if width else parts[:last]
                out.put(" | ".join([*before, parts[last].rstrip(" ")]))


Grid = list[list[tuple[int, list[str]]]]


def fitted(grid: Grid) -> tuple[Grid, dict[int, int]]:
    """The rows with wide cells wrapped, and the width of each column that a cell begins in.

    Cells before the last one of a row are wrapped at the largest of PADS with which padding keeps the table under PADDED times its text.
    Only where the bars alone are longer than that, as with rows far to the right, are there no widths.
    """
    text = sum(len(line) for cells in grid for _, lines in cells for line in lines)
    for most in PADS:
        rows = [[(at, wrapped(lines, most) if n + 1 < len(cells) else lines) for n, (at, lines) in enumerate(cells)] for cells in grid]
        width: dict[int, int] = defaultdict(int)
        for cells in rows:
            for at, lines in cells:
                width[at] = max(width[at], min(most, max(map(len, lines))))
        place, ends = {at: k for k, at in enumerate(sorted(width))}, [0]
        for at in place:
            ends.append(ends[-1] + width[at] + 3)
        if sum(ends[place[cells[-1][0]]] * max(len(lines) for _, lines in cells) for cells in rows) <= PADDED * text + 10_000:
            return rows, dict(width)
    return grid, {}


def wrapped(lines: list[str], most: int) -> list[str]:
    """``lines`` broken at blanks where they are longer than ``most``; longer words stay whole."""
    if max(map(len, lines)) <= most:
        return lines
    return [part for line in lines for part in (textwrap.wrap(line, most, expand_tabs=False, replace_whitespace=False, break_long_words=False, break_on_hyphens=False) if len(line) > most else [line]) or [""]]


def visible_text(source: str) -> str:
    """The visible text of a page, a line of text for each line of its layout."""
    out = Layout()
    run(render(build(source), out))
    out.end_line()
    return "\n".join(out.lines)


def extract(pages: DataFrame) -> DataFrame:
    """row (a struct of the columns of ``pages`` but html) and text of each row; a null html has an empty text.

    Pages are read one by one where they lie, so nothing is shuffled; repeated rows come back each. A page takes
    time and memory in proportion to its length, however deep its tree is or its tables are.
    """
    rest = pages.select(*[column(c) for c in pages.columns if c != "html"])
    rows = pages.select(F.struct(*map(column, rest.columns)).alias("row"), "html")

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [visible_text(h) if h else "" for h in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.string())], ["row", "text"])

    return map_batches(rows, read, with_row(rest, "text string"))
