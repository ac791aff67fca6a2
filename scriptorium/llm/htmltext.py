"""Operator 10: layout-aware HTML to text.

``TreeBuilder`` turns the tag stream into a tree: it ends paragraphs, list
items, table cells and options where the next tag implies it, adds the rows that
cells imply, moves text that stands between table tags in front of the table
and survives unclosed and crossed tags.  ``render`` walks the tree without
recursion and emits all visible text:

- not visible: head, scripts, styles, templates, fallback content of embedded
  media, closed dialogs, elements with ``hidden``, ``display:none``, and text under
  ``visibility:hidden`` unless a descendant is ``visible`` again;
- white space collapses, except in ``pre`` and ``textarea``; a no-break blank becomes a blank;
- blocks start a new line, paragraphs, headings, lists, quotes and tables have
  an empty line around them; list items carry their bullet or number and are
  indented by depth; cells of a table row stand side by side, padded to the
  width of their column (long cells are wrapped inside their column).

Defined results: null and empty pages give an empty text; text that is no
markup is kept as it is apart from white space; rows are independent of each other, so
ties and repeated rows give equal results; all input columns are returned, a clashing name replaced.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns

# Element groups (fixed by the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title iframe object canvas video audio map datalist svg math noframes area".split())
HEAD_ONLY = frozenset("base link meta script style template title noscript".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre figure fieldset table".split())
LINES = frozenset("address article aside body center details dialog dir div dd dt figcaption footer form header hgroup legend li main nav option optgroup search section summary tr caption tbody thead tfoot html".split())
BLOCKS = PARAGRAPHS | LINES | {"hr"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("tbody thead tfoot".split())
CELLS = frozenset("td th".split())
#: Inline tags that may be crossed by blocks.
FORMATTING = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var".split())
TABLE_PARTS = SECTIONS | CELLS | {"tr", "caption", "colgroup", "col"}
#: A start tag ends the named open elements, unless an element of the second set is open inside of them.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "td", "th"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "tbody": (SECTIONS | {"tr", "caption", "colgroup"}, {"table"}),
    "thead": (SECTIONS | {"tr", "caption", "colgroup"}, {"table"}),
    "tfoot": (SECTIONS | {"tr", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption", "colgroup"}, {"table"}),
    "colgroup": ({"caption", "colgroup"}, {"table"}),
}
_END_P = (BLOCKS - {"tr", "caption", "option", "optgroup", "body", "html"} - SECTIONS) | {"plaintext"}
_WALLS = CELLS | {"caption", "table", "button"}
_SPACE = re.compile("[ \t\n\f\r]+")
#: Cells with longer lines are wrapped, so that one long cell does not widen every row.
CELL_WIDTH = 80
_MAX_COLSPAN, _MAX_ROWSPAN = 1000, 65534  # limits of the standard


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Open elements, and of each tag the numbers of its open ones: no tag looks through all that is open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("body", {})
        self.open = [self.root]
        self.numbers = [0]  # rising numbers of the open elements
        self.of_tag: dict[str, list[int]] = {}
        self.pushed = 0

    def _last(self, tags) -> int:
        """Number of the innermost open element of these tags; 0 if there is none."""
        return max((self.of_tag[t][-1] for t in tags if self.of_tag.get(t)), default=0)

    def _cut(self, at: int) -> None:
        """End the open elements from place ``at`` on."""
        for n in self.open[at:]:
            self.of_tag[n.tag].pop()
        del self.open[at:], self.numbers[at:]

    def _pop_through(self, names, walls) -> None:
        """End the outermost open element among ``names`` that no wall hides."""
        wall, found = self._last(w for w in walls if w not in names), None
        for t in names:
            own = self.of_tag.get(t)
            if own and own[-1] > wall:
                first = own[bisect.bisect_right(own, wall)]
                found = first if found is None else min(found, first)
        if found is not None:
            self._cut(bisect.bisect_left(self.numbers, found))

    def _within(self, tag: str, walls) -> bool:
        return 0 < self._last((tag,)) > self._last(w for w in walls if w != tag)

    def _add(self, what) -> None:
        """Append to the open element; what may not stand between table tags goes before the table."""
        top = self.open[-1]
        if top.tag in ("table", "tr") or top.tag in SECTIONS:
            blank = isinstance(what, str) and not what.strip(" \t\n\f\r")
            if not blank and not (isinstance(what, Node) and (what.tag in TABLE_PARTS or what.tag in UNSEEN)):
                number = self._last(("table",))
                if number:
                    i = bisect.bisect_left(self.numbers, number)
                    kids, table = self.open[i - 1].kids, self.open[i]
                    # an open table is among the last of its parent
                    kids.insert(next((k for k in range(len(kids) - 1, -1, -1) if kids[k] is table), len(kids)), what)
                    return
        top.kids.append(what)

    def handle_starttag(self, tag, attrs):
        given = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        if tag in ("html", "body"):
            for k, v in given.items():
                self.root.attrs.setdefault(k, v)
            self._end_head()
            return
        if tag == "head":
            if len(self.open) == 1 and not self.root.kids:
                self._push(Node(tag, given))
            return
        if tag not in HEAD_ONLY:
            self._end_head()
        if tag in _END_P:
            self._pop_through({"p"}, _WALLS)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._cut(len(self.open) - 1)
        if tag in TABLE_PARTS and not self._within("table", ()):
            return  # a part without a table is not an element
        if tag in IMPLIED_ENDS:
            self._pop_through(*IMPLIED_ENDS[tag])
        if tag in CELLS and not self._within("tr", {"table"}):
            self._push(Node("tr", {}))
        if tag == "table" and self.open[-1].tag == "table":
            self._cut(len(self.open) - 1)
        node = Node(tag, given)
        if tag in VOID:
            self._add(node)
        else:
            self._push(node)

    def _push(self, node: Node) -> None:
        self._add(node)
        self.pushed += 1
        self.open.append(node)
        self.numbers.append(self.pushed)
        self.of_tag.setdefault(node.tag, []).append(self.pushed)

    def _end_head(self) -> None:
        if len(self.open) > 1 and self.open[1].tag == "head":
            self._cut(1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing outside foreign content
        if tag in ("svg", "math") or self._within("svg", ()) or self._within("math", ()):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "br":
            self._add(Node("br", {}))
            return
        if tag == "head":
            self._end_head()
            return
        if tag in VOID or tag in ("html", "body"):
            return
        if tag == "p" and not self._within("p", _WALLS):
            self._add(Node("p", {}))
            return
        walls = () if tag == "table" else {"table"} if tag in TABLE_PARTS else CELLS | {"caption", "table"}
        number = self._last(HEADINGS if tag in HEADINGS else (tag,))
        if not number or self._last(w for w in walls if w != tag) > number:
            return
        i = bisect.bisect_left(self.numbers, number)
        if tag in FORMATTING and self._last(BLOCKS) > number:
            self.of_tag[tag].pop()
            del self.open[i], self.numbers[i]  # a crossed inline tag ends without ending the blocks in it
        else:
            self._cut(i)

    def handle_data(self, data):
        if len(self.open) == 2 and self.open[1].tag == "head" and data.strip(" \t\n\f\r"):
            self._end_head()
        self._add(data)


def _width(s: str) -> int:
    return len(s) if s.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in s)


class Writer:
    """Lines of one flow: the page, or one table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[tuple[str, bool]] = []  # (text, keeps its white space)
        self.gap = 0  # empty lines due before the next one
        self.indents: list[str] = []
        self.marker = ""  # bullet of a list item that has no text yet

    def text(self, s: str, keep: bool) -> None:
        if keep:
            for k, part in enumerate(s.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
                if k:
                    self.end_line(True)
                if part:
                    self.now.append((part, True))
        else:
            self.now.append((s, False))

    def end_line(self, always: bool = False) -> None:
        line = ""
        if self.now:
            if any(k for _, k in self.now):
                line = "".join(s if k else _SPACE.sub(" ", s) for s, k in self.now).rstrip(" ")
            else:
                line = _SPACE.sub(" ", "".join(s for s, _ in self.now)).strip(" ")
            self.now = []
        if line or always:
            self.put([line.replace("\xa0", " ")])

    def put(self, lines: list[str]) -> None:
        """Whole lines, indented; the first one carries a waiting bullet."""
        if self.lines and self.gap:
            self.lines += [""] * self.gap
        self.gap = 0
        for line in lines:
            indent = "".join(self.indents)
            if self.marker and self.indents:
                indent = indent[: len(indent) - len(self.marker)] + self.marker
                self.marker = ""
            self.lines.append((indent + line).rstrip(" "))

    def block(self, gap: int) -> None:
        self.end_line()
        if self.lines:
            self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        while self.lines and not self.lines[0]:
            self.lines.pop(0)
        return self.lines


def _wrap(lines: list[str], width: int) -> list[str]:
    out = []
    for line in lines:
        if _width(line) <= width:
            out.append(line)
            continue
        now, size = [], 0
        for word in line.split(" "):
            w = _width(word)
            if now and size + 1 + w > width:
                out.append(" ".join(now))
                now, size = [], 0
            size += w + (1 if now else 0)
            now.append(word)
        out.append(" ".join(now))
    return out


def _number(value, least: int, most: int, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return min(most, max(least, int(m[1]))) if m else default


class Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.caption: list[str] = []

    def layout(self) -> list[str]:
        placed, busy = [], {}  # busy: column -> rows still taken from above
        columns = 0
        for row in self.rows:
            at, c = [], 0
            for lines, across, down in row:
                while busy.get(c, 0):
                    c += 1
                at.append((c, across, lines))
                for k in range(c, c + across):
                    busy[k] = max(busy.get(k, 0), down)
                c += across
            columns = max(columns, c, *[k + 1 for k, v in busy.items() if v], 0)
            busy = {k: v - 1 for k, v in busy.items() if v > 1}
            placed.append(at)
        if not any(lines for row in placed for _, _, lines in row):
            return list(self.caption)
        several = sum(len(r) > 1 for r in placed) > 0
        widths: dict[int, int] = {}
        if several:
            placed = [[(c, n, _wrap(lines, CELL_WIDTH)) for c, n, lines in row] for row in placed]
        for wide in (False, True):
            for row in placed:
                for c, n, lines in row:
                    w = max(map(_width, lines), default=0)
                    if n == 1 and not wide:
                        widths[c] = max(widths.get(c, 0), w)
                    elif n > 1 and wide:
                        there = sum(widths.get(k, 0) for k in range(c, c + n)) + 2 * (n - 1)
                        if w > there and len(row) > 1:
                            widths[c + n - 1] = widths.get(c + n - 1, 0) + w - there
        out = list(self.caption)
        begins = [0, *accumulate(widths.get(j, 0) + 2 for j in range(columns + 1))] if several else []
        for row in placed:
            for k in range(max((len(lines) for _, _, lines in row), default=0)):
                parts, width = [], 0
                for c, _, lines in row:
                    if k < len(lines) and lines[k]:
                        gap = max((begins[c] if several else 0) - width, 2 if parts else 0)
                        parts.append(" " * gap + lines[k])
                        width += gap + _width(lines[k])
                out.append("".join(parts))
        return out


class _Flow:
    """What holds for the content of an open element."""

    __slots__ = ("shown", "keep")

    def __init__(self, shown, keep):
        self.shown, self.keep = shown, keep


def _style(attrs: dict) -> dict:
    if "style" not in attrs:
        return {}
    return {k.strip().lower(): v.replace("!important", "").strip().lower() for k, _, v in (x.partition(":") for x in attrs["style"].split(";"))}


def _unseen(node: Node, style: dict) -> bool:
    a = node.attrs
    return node.tag in UNSEEN or "hidden" in a or style.get("display") == "none" or (node.tag == "dialog" and "open" not in a) or (node.tag == "input")


def render(root: Node) -> str:
    """All visible text of a tree, in layout."""
    writers = [Writer()]
    tables: list[Table] = []
    lists: list[list] = []  # [kind, next number, step]
    style = _style(root.attrs)
    if "hidden" in root.attrs or style.get("display") == "none":
        return ""
    todo: list = [("kids", root, _Flow(style.get("visibility") not in ("hidden", "collapse"), False))]
    while todo:
        step, node, flow = todo.pop()
        w = writers[-1]
        if step == "kids":
            for kid in reversed(node.kids):
                todo.append(("text" if isinstance(kid, str) else "open", kid, flow))
        elif step == "text":
            if flow.shown:
                w.text(node, flow.keep)
        elif step == "open":
            tag, style = node.tag, _style(node.attrs)
            if _unseen(node, style):
                continue
            shown = {"visible": True, "hidden": False, "collapse": False}.get(style.get("visibility"), flow.shown)
            space = style.get("white-space", "")
            keep = True if tag in ("pre", "textarea") or space.startswith(("pre", "break-spaces")) else False if space in ("normal", "nowrap") else flow.keep
            inner = _Flow(shown, keep)
            if tag == "br":
                w.end_line(bool(w.now) or not w.gap)
                continue
            if tag == "hr":
                w.block(1)
                continue
            if tag == "table":
                w.block(1)
                tables.append(Table())
            elif tag == "tr" and tables:
                tables[-1].rows.append([])
            elif tag in CELLS and tables or tag == "caption" and tables:
                writers.append(Writer())
            elif tag in PARAGRAPHS:
                w.block(0 if tag in ("ul", "ol", "menu", "dl") and lists else 1)
            elif tag in LINES or style.get("display") in ("block", "flex", "grid", "list-item"):
                w.block(0)
            if tag in ("ul", "ol", "menu"):
                start = _number(node.attrs.get("start"), -(10**9), 10**9, sum(isinstance(k, Node) and k.tag == "li" for k in node.kids) if "reversed" in node.attrs else 1)
                lists.append([tag, start, -1 if "reversed" in node.attrs else 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1, 1]
                if kind[0] == "ol":
                    number = _number(node.attrs.get("value"), -(10**9), 10**9, kind[1])
                    kind[1] = number + kind[2]
                    mark = f"{number}. "
                else:
                    mark = "- "
                w.indents.append(" " * len(mark))
                w.marker = mark
            elif tag == "dd":
                w.indents.append("  ")
            elif tag == "blockquote":
                w.indents.append("> ")
            if tag == "pre" and node.kids and isinstance(node.kids[0], str):
                node.kids[0] = re.sub(r"\A\r?\n", "", node.kids[0])
            todo.append(("close", node, flow))
            todo.append(("kids", node, inner))
        else:
            tag, style = node.tag, _style(node.attrs)
            if tag in CELLS and tables:
                lines = writers.pop().done()
                if not tables[-1].rows:
                    tables[-1].rows.append([])
                down = _number(node.attrs.get("rowspan"), 1, _MAX_ROWSPAN, 1)
                tables[-1].rows[-1].append((lines, _number(node.attrs.get("colspan"), 1, _MAX_COLSPAN, 1), down))
            elif tag == "caption" and tables:
                tables[-1].caption += writers.pop().done()
            elif tag == "table":
                w.end_line()
                lines = tables.pop().layout()
                if lines:
                    w.put(lines)
                w.block(1)
            elif tag in PARAGRAPHS:
                if tag in ("ul", "ol", "menu"):
                    lists.pop()
                if tag == "blockquote":
                    w.end_line()
                    w.indents.pop()
                w.block(0 if tag in ("ul", "ol", "menu", "dl") and lists else 1)
            elif tag == "li" or tag == "dd":
                w.end_line()
                w.marker = ""
                w.indents.pop()
            elif tag in LINES or style.get("display") in ("block", "flex", "grid", "list-item"):
                w.block(0)
    return "\n".join(writers[0].done())


def html_to_text(page: str | None) -> str:
    if not page:
        return ""
    builder = TreeBuilder()
    # Behind the last > no tag is finished: it is text, and need not be tried as a tag from every < again.
    cut = page.rfind(">") + 1
    builder.feed(page[:cut])
    if builder.cdata_elem is not None:
        builder.feed(page[cut:])
        builder.close()
    else:
        builder.close()
        first = page.find("<", cut)
        for part in (page[cut:], "") if first < 0 else (page[cut:first], page[first:]):
            if part:
                builder.handle_data(unescape(part))
    return render(builder.root)


def extract_text(df: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Append the visible text of every page."""

    def run(batch):
        return [pa.array([html_to_text(x) for x in batch.column(html_col).to_pylist()], pa.string())]

    return append_columns(df, [T.StructField(text_col, T.StringType())], run)
