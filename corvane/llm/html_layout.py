"""Layout-aware text of HTML pages: a small tree builder, visibility rules, a renderer.

The builder knows void and raw-text elements, implied end tags (p, li, dt, dd, option,
table parts) and closes what an end tag leaves open.  Hidden are head, script, style,
template, noscript and the like, ``hidden`` attributes, ``display:none``, hidden
inputs, closed details (but their summary), and ``visibility:hidden`` until a
descendant is visible again, also in preformatted text.  The text of options, formulas
and drawings is shown.  The renderer keeps block spacing (paragraphs and
headings apart by a blank line, other blocks by a line break), preformatted text, list
markers with indentation, and tables with aligned columns.

Defined results: null or empty pages give an empty text; text outside any tag is kept;
broken markup never fails; tables nested more than ``DEEPEST`` deep come as blocks; repeated pages are rendered row by row; an empty table gives
an empty table; extra columns are not carried.
"""

from __future__ import annotations

import bisect
import bisect
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm._shared import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title noscript plaintext".split())
HIDDEN = frozenset("head script style template noscript noembed noframes iframe title datalist object audio video canvas".split())
#: Blocks with a blank line around them, and blocks with a line break only.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset".split())
BLOCKS = SPACED | frozenset("html body div article section nav header footer main aside address form li dt dd tr caption details summary figcaption legend center menu dir hgroup search dialog optgroup option".split())
_CLOSES_P = SPACED | frozenset("div article section nav header footer main aside address form details center menu dir figcaption hgroup dl li dt dd".split()) - {"table"}
#: A start tag closes these open elements, up to but not beyond the named limits.
_IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "td": (frozenset({"td", "th", "caption", "colgroup"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th", "caption", "colgroup"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"tr", "td", "th", "caption", "colgroup"}), frozenset({"table"})),
    "thead": (frozenset({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}), frozenset({"table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}), frozenset({"table"})),
    "body": (frozenset({"head"}), frozenset()),
}
#: Elements whose end tags also end open cells.
_TABLE_PARTS = frozenset({"table", "tr", "tbody", "thead", "tfoot"})
_SCOPE = frozenset({"td", "th", "caption", "table", "button", "html", "template"})

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>?",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_INVISIBLE = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return out


class Node:
    __slots__ = ("tag", "raw", "kids", "_attrs")

    def __init__(self, tag: str, raw: str = ""):
        self.tag, self.raw, self.kids, self._attrs = tag, raw, [], None

    @property
    def attrs(self) -> dict[str, str]:
        if self._attrs is None:
            self._attrs = attributes(self.raw) if self.raw else {}
        return self._attrs


class _Stack(list):
    """Open elements, with the places of each tag, so that no search walks over them."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self))
        self.append(node)

    def cut(self, at: int) -> None:
        for node in self[at:]:
            self.places[node.tag].pop()
        del self[at:]

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of the tags, 0 if there is none."""
        at = 0
        for t in tags:
            p = self.places.get(t)
            if p and p[-1] > at:
                at = p[-1]
        return at


def _close(stack: _Stack, wanted: frozenset, limits: frozenset) -> None:
    """Close the outermost open element of ``wanted`` that is inside the nearest limit."""
    found = [p for t in wanted if (p := stack.places.get(t))]
    if not found:
        return
    limit = stack.last(*(limits - wanted))
    inside = [p[bisect.bisect_right(p, limit)] for p in found if p[-1] > limit]
    if inside:
        stack.cut(min(inside))


_RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}


def build_tree(html: str) -> Node:
    root = Node("html")
    stack, at, n = _Stack(root), 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            stack[-1].kids.append(html[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(html[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "p" and not stack.last("p"):
                stack[-1].kids.append(Node("p"))
            elif tag == "br":
                stack[-1].kids.append(Node("br"))
            elif at_tag := stack.last(tag):
                if tag in _TABLE_PARTS or at_tag >= stack.last("td", "th", "caption"):
                    stack.cut(at_tag)
            continue
        name = m[2] or m[4]
        if not name:
            continue  # comments, declarations, instructions
        tag, raw = name.lower(), m[3] if m[2] else m[5]
        if tag in ("html", "body") and not (tag == "body" and stack[-1].tag in ("html", "head")):
            if tag == "html":
                continue
        if tag in _CLOSES_P and (at_p := stack.last("p")) and at_p > stack.last(*_SCOPE):
            stack.cut(at_p)
        if tag in _IMPLIED:
            _close(stack, *_IMPLIED[tag])
        elif tag in BLOCKS and stack[-1].tag == "head":
            stack.cut(len(stack) - 1)
        node = Node(tag, raw)
        stack[-1].kids.append(node)
        if tag in RAW:
            found = _RAW_END[tag].search(html, at) if tag != "plaintext" else None
            end = found.start() if found else n
            if end > at:
                node.kids.append(html[at:end])
            close = html.find(">", end)
            at = n if close < 0 or end == n else close + 1
        elif tag not in VOID and not raw.rstrip().endswith("/") or tag in BLOCKS and tag not in VOID:
            stack.push(node)
    return root


class _Out:
    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.indent: list[str] = []
        self.marker = ""

    def flush(self) -> None:
        if self.line:
            if self.gap == 2 and self.lines:
                self.lines.append("")
            margin = "".join(self.indent)
            if self.marker:
                margin = margin[: len(margin) - len(self.marker)] + self.marker
                self.marker = ""
            self.lines.append((margin + "".join(self.line)).rstrip())
            self.line, self.gap = [], 0
        self.space = False

    def brk(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def text(self, s: str) -> None:
        words = _BLANKS.split(s)
        if not words[0]:
            self.space = True
            words = words[1:]
        tail = bool(words) and not words[-1]
        words = words[:-1] if tail else words
        if words:
            if self.space and self.line:
                self.line.append(" ")
            self.line.append(" ".join(words).replace("\xa0", " "))
            self.space = tail

    def rows(self, lines: list[str]) -> None:
        """Lines that stand as they are."""
        for x in lines:
            self.flush()
            if x.strip():
                self.line.append(x)
                self.flush()
            elif self.lines:
                self.gap = 2


def _visible(node: Node, shown: bool) -> tuple[bool, bool]:
    """(is it laid out, is its own text visible)"""
    if node.tag in HIDDEN:
        return False, False
    if node.raw:
        a = node.attrs
        if "hidden" in a or node.tag == "input" or node.tag == "dialog" and "open" not in a:
            return False, False
        style = a.get("style")
        if style:
            if _NONE.search(style):
                return False, False
            found = _INVISIBLE.search(style)
            if found:
                shown = found[1].lower() == "visible"
    elif node.tag in ("dialog", "input"):
        return False, False
    return True, shown


#: Fixed values of the HTML standard: the most columns and rows that a cell spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


def _span(value: str | None, most: int) -> int:
    return min(int(value), most) if value and value.isascii() and value.isdigit() and 0 < len(value.lstrip("0")) < 10 else 1


def _rows_of(table: Node) -> tuple[list[Node], list]:
    rows, rest, todo = [], [], list(reversed(table.kids))
    while todo:
        kid = todo.pop()
        if isinstance(kid, Node) and kid.tag in ("thead", "tbody", "tfoot") and _visible(kid, True)[0]:
            todo.extend(reversed(kid.kids))
        elif isinstance(kid, Node) and kid.tag == "tr":
            rows.append(kid)
        elif isinstance(kid, Node) and kid.tag != "colgroup" or isinstance(kid, str) and kid.strip():
            rest.append(kid)
    return rows, rest


#: Tables nested deeper are laid out as blocks, since a row in a row is laid out again at each level.
DEEPEST = 64


def _table(table: Node, out: _Out, shown: bool, depth: int) -> None:
    rows, rest = _rows_of(table)
    for kid in rest:  # captions, and what should not be here
        _render([kid], out, shown, depth)
        out.brk(1)
    grid: list[dict[int, tuple[list[str], int]]] = []  # column to lines and columns spanned
    held: dict[int, int] = {}
    for tr in rows:
        laid, row_shown = _visible(tr, shown)
        if not laid:
            continue
        cells, col, loose = {}, 0, []  # loose: text that stands in the row, not in a cell
        for kid in tr.kids:
            if isinstance(kid, str):
                if row_shown and kid.strip():
                    loose.append(" ".join(unescape(kid).split()))
                continue
            laid, _ = _visible(kid, row_shown)
            if not laid:
                continue
            while held.get(col, 0) > 0:
                held[col] -= 1
                col += 1
            inner = _Out()
            _render([kid] if kid.tag not in ("td", "th") else kid.kids, inner, _visible(kid, row_shown)[1], depth + 1)
            inner.flush()
            width = _span(kid.attrs.get("colspan"), MOST_COLUMNS)
            down = _span(kid.attrs.get("rowspan"), MOST_ROWS)
            cells[col] = loose + [x for x in inner.lines if x], width
            loose = []
            if down > 1:
                for k in range(col, col + width):
                    held[k] = down - 1
            col += width
        if loose:
            cells[col] = loose, 1
        for k in [k for k in held if k >= col and held[k] > 0]:
            held[k] -= 1
        if any(lines for lines, _ in cells.values()):
            grid.append(cells)
    # a column is as wide as its widest cell; a cell over several columns widens the last of them only
    columns = sorted({c for cells in grid for c in cells})
    widths = dict.fromkeys(columns, 0)
    for cells in grid:
        for c, (lines, span) in cells.items():
            if span == 1:
                widths[c] = max(widths[c], *map(len, lines), 0)
    for cells in grid:
        for c, (lines, span) in cells.items():
            if span > 1 and lines:
                own = columns[bisect.bisect_left(columns, c) : bisect.bisect_left(columns, c + span)]
                lack = max(map(len, lines)) - sum(widths[x] for x in own) - 2 * (len(own) - 1)
                if lack > 0 and own[-1] != columns[-1]:
                    widths[own[-1]] += lack
    for cells in grid:
        for k in range(max(len(lines) for lines, _ in cells.values())):
            line, c = [], 0
            while c < len(columns):
                lines, span = cells.get(columns[c], ([], 1))
                upto = c + 1 if span == 1 else max(c + 1, bisect.bisect_left(columns, columns[c] + span))
                room = sum(widths[x] for x in columns[c:upto]) + 2 * (upto - c - 1)
                line.append((lines[k] if k < len(lines) else "").ljust(room))
                c = upto
            out.brk(1)
            text = "  ".join(line).rstrip()
            if text:
                out.line.append(text)
            out.flush()


def _render(kids: list, out: _Out, shown: bool = True, depth: int = 0) -> None:
    todo: list = [(k, shown) for k in reversed(kids)]
    counters: list[list] = []
    while todo:
        kid, shown = todo.pop()
        if isinstance(kid, str):
            if shown:
                out.text(unescape(kid) if "&" in kid else kid)
            continue
        if isinstance(kid, tuple):  # the end of an element
            what, arg = kid
            if what == "block":
                out.brk(arg)
            elif what == "list":
                counters.pop()
            elif what == "item":
                out.flush()
                out.marker = ""
                out.indent.pop()
            continue
        tag = kid.tag
        laid, seen = _visible(kid, shown)
        if not laid:
            continue
        if tag == "br":
            if out.line:
                out.brk(1)
            elif out.lines:
                out.gap = 2
            continue
        if tag == "table" and depth < DEEPEST:
            out.brk(2)
            _table(kid, out, seen, depth)
            out.brk(2)
            continue
        if tag in ("pre", "textarea", "xmp", "plaintext"):
            out.brk(2)
            parts, deep = [], [(kid, shown)]
            while deep:
                x, bare = deep.pop()
                if isinstance(x, str):
                    if bare:
                        parts.append(unescape(x))
                    continue
                laid, bare = _visible(x, bare)
                if laid:
                    if x.tag == "br":
                        parts.append("\n")
                    deep.extend((y, bare) for y in reversed(x.kids))
            if parts:
                out.rows("".join(parts).replace("\r\n", "\n").expandtabs(4).strip("\n").split("\n"))
            out.brk(2)
            continue
        if tag == "details" and "open" not in kid.attrs:
            kid_list = [x for x in kid.kids if isinstance(x, Node) and x.tag == "summary"][:1]
        else:
            kid_list = kid.kids
        if tag in ("td", "th"):
            out.space = True
        if tag in BLOCKS:
            gap = 2 if tag in SPACED and not (tag in ("ul", "ol") and out.indent) else 1
            out.brk(gap)
            todo.append((("block", gap), shown))
        if tag in ("ul", "ol", "menu", "dir"):
            start = kid.attrs.get("start", "")
            counters.append([tag, int(start) if start.lstrip("-").isascii() and start.lstrip("-").isdigit() and len(start) < 9 else 1])
            todo.append((("list", None), shown))
        elif tag == "li":
            if counters and counters[-1][0] == "ol":
                marker = f"{counters[-1][1]}. "
                counters[-1][1] += 1
            else:
                marker = "- "
            out.indent.append(" " * len(marker))
            out.marker = marker
            todo.append((("item", None), shown))
        elif tag in ("dd", "blockquote"):
            out.indent.append("    " if tag == "dd" else "  ")
            todo.append((("item", None), shown))
        todo.extend((k, seen) for k in reversed(kid_list))


def render(html: str | None) -> str:
    """All visible text of a page, laid out in lines."""
    if not html:
        return ""
    out = _Out()
    _render(build_tree(html.replace("\x00", "")).kids, out)
    out.flush()
    return "\n".join(out.lines)


def rendered(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, n_lines, n_chars) of every whole page."""
    source = df.select(F.col(id_col), F.col(html_col).cast("string").alias("__html"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            texts = [render(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array([x.count("\n") + 1 if x else 0 for x in texts], pa.int64()), pa.array(list(map(len, texts)), pa.int64())], [id_col, "text", "n_lines", "n_chars"]
            )

    return source.mapInArrow(run, f"`{id_col}` {kind}, text string, n_lines long, n_chars long")
