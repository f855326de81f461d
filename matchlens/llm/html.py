"""Operator 8: the visible text of web pages, laid out as a reader would see it.

A page is cut into tags and text, and a tree is built with the usual implied tags (a new list
item, paragraph, row or cell ends the one before it; an end tag ends what is open inside it).
Elements that are not rendered, by name, by the ``hidden`` attribute or by ``display:none``, are
left out with all they hold; ``visibility`` is inherited and may be taken back inside. Everything
else is rendered, navigation, footers, drawings, formulas, list boxes and what stands in for an
object included; drop-down menus and input fields are values of a form and are not.
Blocks stand on lines of their own, paragraphs and the like are set off by an empty line, list
items have a bullet or their number, and the cells of a table column start at one position.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.llm.store import ship

# Element names of HTML by how they are parsed and rendered.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
UNSEEN = frozenset(
    "head script style title noscript iframe noembed noframes template datalist audio video "
    "canvas desc metadata defs annotation annotation-xml".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure hr".split())
BLOCK = SPACED | frozenset(
    "address article aside body caption center dd details dialog dir div dt fieldset figcaption "
    "footer form header hgroup html legend li main menu nav optgroup search section summary "
    "tbody tfoot thead tr".split()
)
CELLS, GROUPS = frozenset(("td", "th")), frozenset(("tbody", "thead", "tfoot"))
#: What is set apart by a blank where it stands in a line: cells of tables that are not laid out,
#: and the pieces of text in a drawing.
BESIDE = CELLS | {"text"}
#: What has lines of its own: blocks, and the options of a list box.
OWN_LINES = BLOCK | {"option"}
#: A start tag ends an open element of the second, unless one of the third stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
#: What a block that cannot be inside a paragraph ends.
PARAGRAPH = ({"p"}, {"table", "td", "th", "button", "caption"})

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_GONE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.IGNORECASE)
_SPACE = re.compile(r"[ \t\n\r\f]+")
GAP = "  "
#: Lists and tables inside each other beyond ``DEPTH`` are rendered as plain blocks, elements
#: nested beyond ``STACK`` as if they stood side by side: no page can exhaust the stack.
DEPTH, STACK = 20, 100
#: Most columns and rows that a cell may span, as HTML defines it.
WIDEST, TALLEST = 1000, 65534


class Node:
    """An element. What is not ``seen`` is left out with all it holds; what is not ``shown`` takes
    its place without its own text, and elements inside it may be shown again."""

    __slots__ = ("attributes", "children", "name", "seen", "shown")

    def __init__(self, name: str, seen: bool, shown: bool, attributes: dict[str, str]) -> None:
        self.name, self.seen, self.shown, self.attributes = name, seen, shown, attributes
        self.children: list[Node | str] = []


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape("".join(values)))
    return found


def _is_seen(name: str, attributes: dict[str, str]) -> bool:
    return not (
        name in UNSEEN
        or "hidden" in attributes
        or name == "input"
        or name == "dialog" and "open" not in attributes
        or name == "select" and not ("multiple" in attributes or _number(attributes, "size", 1) > 1)
        or _GONE.search(attributes.get("style", ""))
    )


def _is_shown(parent: bool, attributes: dict[str, str]) -> bool:
    said = _VISIBILITY.findall(attributes.get("style", ""))
    return said[-1].lower() == "visible" if said else parent


def _number(attributes: dict[str, str], name: str, otherwise: int) -> int:
    said = attributes.get(name, "").strip()
    return int(said) if re.fullmatch(r"[0-9]{1,9}", said) else otherwise


def parse(page: str) -> Node:
    """The tree of a page. Every page gives one: what is not understood is text."""
    root = Node("", True, True, {})
    stack, at = [root], 0

    def close(names: set[str], barriers: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                del stack[i:]
                return
            if stack[i].name in barriers:
                return

    while token := _TOKEN.search(page, at):
        if at < token.start():
            stack[-1].children.append(html.unescape(page[at : token.start()]))
        at = max(token.end(), token.start() + 1)
        if not (name := token["name"]):
            continue
        name = name.lower()
        if token["end"]:
            barriers = {"table"} if name not in BLOCK else {"td", "th"} - {name}
            close({name}, barriers if name != "table" else set())
            continue
        if name in ENDS:
            ended, barriers = ENDS[name]
            for _ in range(3 if name in ("tr", "tbody", "thead", "tfoot") else 1):
                close(ended, barriers)
        if name in BLOCK:
            close(*PARAGRAPH)
        attributes = _attributes(token["rest"]) if token["rest"].strip() else {}
        shown = _is_shown(stack[-1].shown, attributes)
        node = Node(name, stack[-1].seen and _is_seen(name, attributes), shown, attributes)
        stack[-1].children.append(node)
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            node.children.append(html.unescape(page[at : stop.start() if stop else len(page)]))
            at = stop.end() if stop else len(page)
        elif name not in VOID and (len(stack) < STACK or not node.seen):
            stack.append(node)
    if at < len(page):
        stack[-1].children.append(html.unescape(page[at:]))
    return root


class _Lines:
    """Lines of text so far; white space is folded, empty lines are kept apart by request."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line, self.blank, self.gap = "", False, False

    def text(self, said: str, kept: bool = False) -> None:
        if kept:
            first, *others = said.replace("\r\n", "\n").split("\n")
            self._put(first)
            for other in others:
                self.end(always=True)
                self._put(other)
            return
        folded = _SPACE.sub(" ", said)
        if folded[:1] == " ":
            self.gap = bool(self.line)
        if words := folded.strip(" "):
            self._put(" " * self.gap + words)
            self.gap = folded[-1] == " "

    def _put(self, said: str) -> None:
        if said:
            if not self.line:
                if self.blank and self.lines:
                    self.lines.append("")
                self.blank = False
            self.line += said.replace("\xa0", " ")

    def space(self) -> None:
        self.gap = bool(self.line)

    def end(self, always: bool = False) -> None:
        if self.line.strip() or always:
            self.lines.append(self.line.rstrip())
        self.line, self.gap = "", False

    def set_off(self) -> None:
        self.end()
        self.blank = True


def _width(said: str) -> int:
    if said.isascii():
        return len(said)
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in said)


def _groups(node: Node) -> Iterator[list[list[Node]]]:
    """The cells of each row of each group of rows, without those of tables inside it. What
    stands outside a group is one itself."""
    rows: list[list[Node]] = []
    loose: list[Node] = []
    for child in node.children:
        if isinstance(child, str) or not child.seen:
            continue
        if child.name == "tr":
            rows.append([c for c in child.children if isinstance(c, Node) and c.seen and c.name in CELLS])
        elif child.name in GROUPS:
            if rows:
                yield rows
                rows = []
            yield from _groups(child)
        elif child.name in CELLS:
            loose.append(child)
    if loose:
        rows.append(loose)
    if rows:
        yield rows


def _placed(rows: list[list[Node]]) -> Iterator[list[tuple[int, Node]]]:
    """The column of each cell of a group: a cell stands right of the one before it and of cells
    that reach down into its row. A cell of zero rows reaches to the end of its group."""
    reaching: list[tuple[int, int, int]] = []
    for i, row in enumerate(rows):
        reaching = sorted(r for r in reaching if r[2] > i)
        taken, column, k, placed = reaching, 0, 0, []
        for cell in row:
            while k < len(taken) and taken[k][0] <= column:
                column = max(column, taken[k][1])
                k += 1
            placed.append((column, cell))
            wide = min(max(_number(cell.attributes, "colspan", 1), 1), WIDEST)
            tall = min(_number(cell.attributes, "rowspan", 1), TALLEST) or len(rows)
            if tall > 1:
                reaching = [*reaching, (column, column + wide, i + tall)]
            column += wide
        yield placed


def _table(node: Node, depth: int) -> list[str]:
    """Its caption and other text outside cells first, then its rows with aligned cells. Columns
    in which no cell begins take no room."""
    grid = [
        {column: _render(cell, depth).split("\n") for column, cell in row}
        for group in _groups(node)
        for row in _placed(group)
    ]
    columns = sorted(set().union(*grid))
    widths = dict.fromkeys(columns, 0)
    for row in grid:
        for column, cell in row.items():
            if column != columns[-1]:
                widths[column] = max(widths[column], *map(_width, cell))
    outside = _Lines()
    _loose(node, outside, depth)
    outside.end()
    lines = outside.lines
    for row in grid:
        last = max(row, default=-1)
        for i in range(max(map(len, row.values()), default=0)):
            cells = [(c, row[c][i] if c in row and i < len(row[c]) else "") for c in columns if c <= last]
            padded = [said + " " * (widths[c] - _width(said)) for c, said in cells]
            lines.append(GAP.join(padded).rstrip())
    return lines


def _loose(node: Node, out: _Lines, depth: int) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.text(child if node.shown else "")
        elif (child.name in GROUPS or child.name == "tr") and child.seen:
            _loose(child, out, depth)
        elif child.name not in CELLS:
            _node(child, out, depth, False)


def _node(node: Node, out: _Lines, depth: int, kept: bool) -> None:
    name = node.name
    if not node.seen:
        return
    if name == "br":
        out.end(always=True)
        return
    if name == "img":
        out.text(node.attributes.get("alt", "") if node.shown else "")
        return
    (out.set_off if name in SPACED else out.end if name in OWN_LINES else bool)()
    if name == "table" and depth < DEPTH:
        for line in _table(node, depth + 1):
            out.text(line, kept=True)
            out.end(always=True)
    elif name in ("ul", "ol", "menu"):
        _list(node, out, depth, kept)
    else:
        _walk(node, out, depth, kept or name == "pre")
    (out.set_off if name in SPACED else out.end if name in OWN_LINES else bool)()


def _list(node: Node, out: _Lines, depth: int, kept: bool) -> None:
    start = node.attributes.get("start", "")
    number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, Node) and child.name == "li" and child.seen and depth < DEPTH:
            mark = f"{number}. " if node.name == "ol" else "- "
            number += 1
            mark = mark if child.shown else " " * len(mark)
            said = _render(child, depth + 1)
            for i, line in enumerate(said.split("\n") if said else []):
                out.text((mark if i == 0 else " " * len(mark)) + line, kept=True)
                out.end(always=True)
        elif isinstance(child, str):
            out.text(child if node.shown else "", kept)
        else:
            _node(child, out, depth, kept)


def _walk(node: Node, out: _Lines, depth: int, kept: bool) -> None:
    for child in node.children:
        if isinstance(child, str):
            out.text(child if node.shown else "", kept)
        else:
            if child.name in BESIDE and node.name:
                out.space()
            _node(child, out, depth, kept)


def _render(node: Node, depth: int = 0) -> str:
    out = _Lines()
    _walk(node, out, depth, node.name == "pre")
    out.end()
    return "\n".join(out.lines).strip("\n")


def visible_text(page: str | None) -> str:
    return _render(parse(page or ""))


def extract_text(pages: DataFrame, out: str = "text") -> DataFrame:
    """(page_id, ``out``) of every row of ``pages``: the visible text of ``html``.

    Null and empty pages give an empty text. What is no well-formed HTML is read as text.
    Repeated rows are kept; other columns are ignored; an empty table gives no rows. Pages are
    rendered whole, one at a time.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(page) for page in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], names=["page_id", out]
            )

    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("html").cast("string"))
    return rows.mapInArrow(render, f"page_id long, `{out}` string")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
