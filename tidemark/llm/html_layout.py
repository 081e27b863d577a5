"""HTML extraction by layout: what a reader would see, with the spacing of blocks.

A tree builder takes the tokens of the page and supplies what authors leave out:
omitted end tags of paragraphs, list items, table parts and options; the tbody of rows;
the end of what stays open. Visibility rules drop what no reader sees. Rendering then
emits blocks with the blank lines between them, bullets and numbers of lists by depth,
preformatted text as it is, and tables as columns padded to their widest cell.

Building and rendering use explicit stacks, so depth is bounded by memory and not by
recursion. Time and output stay linear in the page, whatever it holds: indents grow to
MOST_INDENT columns, deeper lists keep their markers there; cells wider than WIDE are not
padded to; a table whose padding would outweigh its text by far is laid out without it, and
one with far more spanned than own cells without its spans; tables nested deeper than
MOST_TABLES are blocks. All of this bounds blanks only: text is kept whole in every case.

Defined results: null or empty pages give empty text; broken markup gives what can be
read of it; equal pages give equal text.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_set = lambda words: frozenset(words.split())

VOID = _set("area base br col embed hr img input link meta param source track wbr")
#: Elements whose content is text up to their end tag.
RAW = _set("script style textarea title noscript iframe noembed noframes xmp")
HIDDEN = _set("script style head title meta link template noscript iframe object canvas audio video noembed noframes datalist annotation annotation-xml")
#: In drawings: what is not drawn where it stands.
UNDRAWN = _set("defs symbol desc metadata clippath mask pattern marker")
#: In formulas: elements whose parts stand apart.
APART = _set("mfrac msub msup msubsup munder mover munderover mroot mtr mtable")
BLOCKS = _set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul caption"
)
#: Blocks with a blank line before and after.
SPACED = _set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr menu")
#: A start tag of the key closes open elements of the value, up to the barrier.
CLOSES = {
    "li": (_set("li"), _set("ul ol menu dir")),
    "dt": (_set("dt dd"), _set("dl")),
    "dd": (_set("dt dd"), _set("dl")),
    "tr": (_set("tr td th caption colgroup"), _set("table")),
    "td": (_set("td th"), _set("tr table")),
    "th": (_set("td th"), _set("tr table")),
    "thead": (_set("thead tbody tfoot tr td th caption colgroup"), _set("table")),
    "tbody": (_set("thead tbody tfoot tr td th caption colgroup"), _set("table")),
    "tfoot": (_set("thead tbody tfoot tr td th caption colgroup"), _set("table")),
    "option": (_set("option"), _set("select datalist optgroup")),
    "optgroup": (_set("option optgroup"), _set("select")),
    "rt": (_set("rt rp"), _set("ruby")),
    "rp": (_set("rt rp"), _set("ruby")),
    "body": (_set("head"), _set("html")),
}
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - _set("li dd dt option optgroup td th tr tbody thead tfoot caption html body legend summary")
#: An end tag looks no further up than these.
SCOPE = _set("table td th caption html template")
#: HTML's own bounds on colspan and rowspan.
MOST_SPAN, MOST_DOWN = 1000, 65534
#: Bounds of blanks: columns of indent, width up to which a cell counts for its column, tables in tables that are
#: aligned, and padding (with placeholders of spans) as a multiple of what a table holds itself.
MOST_INDENT, WIDE, MOST_TABLES, MOST_PADDING = 48, 120, 6, 12

#: A quote counts only after an equals sign, and only if it is closed; nothing here is tried twice.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>\x00]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_UNSEEN_STYLE = re.compile(r"(?<![\w-])(?:display\s*:\s*none|content-visibility\s*:\s*hidden)", re.I)
_VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(hidden|collapse|visible)", re.I)
_BLANK = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        value = m.group(2) or ""
        if value[:1] in "\"'" and value:
            value = value[1:-1]
        found.setdefault(m.group(1).lower(), html.unescape(value) if "&" in value else value)
    return found


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes' source); kind: text, start, end."""
    at, n = 0, len(page)
    while at < n:
        mark = page.find("<", at)
        if mark < 0:
            yield "text", page[at:], ""
            return
        m = _TOKEN.match(page, mark)
        if not m:  # a plain "<"
            follow = page.find("<", mark + 1)
            follow = n if follow < 0 else follow
            yield "text", page[at:follow], ""
            at = follow
            continue
        if mark > at:
            yield "text", page[at:mark], ""
        at = m.end()
        if not m.group(2):
            continue
        name = m.group(2).lower()
        if m.group(1):
            yield "end", name, ""
            continue
        yield "start", name, m.group(3)
        if name in RAW and not m.group(3).endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            stop = end.start() if end else n
            if stop > at:
                yield "text", page[at:stop], ""
            yield "end", name, ""
            at = end.end() if end else n


def build(page: str) -> Node:
    """The tree of a page, with implied tags supplied."""
    root = Node("html", {})
    stack = [root]
    held: dict[str, list[int]] = {}  # depths of the open elements by tag, so a search for one walks no stack

    def cut(depth: int) -> None:
        while len(stack) > depth:
            held[stack.pop().tag].pop()

    def floor(barrier: frozenset[str]) -> int:
        """The depth of the nearest open element of barrier."""
        return max((depths[-1] for tag in barrier if (depths := held.get(tag))), default=0)

    def close(names: frozenset[str], barrier: frozenset[str]) -> None:
        """Ends the outermost open element of names above the nearest barrier."""
        some = [depths for tag in names if (depths := held.get(tag))]
        if some:
            low = floor(barrier - names)
            above = [depths[k] for depths in some if (k := bisect_right(depths, low)) < len(depths)]
            if above:
                cut(min(above))

    def open_(tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        held.setdefault(tag, []).append(len(stack))
        stack.append(node)

    for kind, name, source in tokens(page):
        if kind == "text":
            stack[-1].children.append(name)
        elif kind == "start":
            attrs = _attributes(source) if source.strip(" /\n\t") else {}
            if name in ("html", "body") and any(s.tag == name for s in stack[:3]):
                stack[0 if name == "html" else next(i for i, s in enumerate(stack) if s.tag == name)].attrs.update(attrs)
                continue
            if name in CLOSES:
                close(*CLOSES[name])
            if name in ENDS_P:
                close(_set("p"), SCOPE | {"button"})
            if name == "tr" and stack[-1].tag == "table":
                open_("tbody", {})
            if name in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                if stack[-1].tag == "table":
                    open_("tbody", {})
                open_("tr", {})
            if name in VOID:
                stack[-1].children.append(Node(name, attrs))
            else:
                open_(name, attrs)
        elif name not in VOID:
            scope = frozenset() if name in SCOPE | _set("body") else SCOPE - {"html"}
            depths = held.get(name)
            if depths:
                if depths[-1] > floor(scope):
                    cut(depths[-1])
            elif name == "p":
                stack[-1].children.append(Node("p", {}))
        if kind == "end" and name == "br":
            stack[-1].children.append(Node("br", {}))
    return root


def visible(node: Node) -> bool:
    """Whether an element is laid out at all; what is not takes its descendants with it."""
    attrs = node.attrs
    if node.tag in HIDDEN or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return False
    if node.tag == "input":
        return attrs.get("type", "").lower() in ("submit", "button", "reset")
    if node.tag == "dialog":
        return "open" in attrs
    return not ("style" in attrs and _UNSEEN_STYLE.search(attrs["style"]))


def visibility(node: Node) -> bool | None:
    """What an element says about being seen, which its descendants inherit until one says otherwise; None if nothing."""
    said = _VISIBILITY.findall(node.attrs["style"]) if "style" in node.attrs else None
    return said[-1].lower() == "visible" if said else None


def _whole(said: str | None, default: int) -> int:
    said = (said or "").strip()
    digits = said.removeprefix("-")
    return int(said) if digits.isascii() and digits.isdigit() and len(digits) < 9 else default


#: What Roman numbers are made of.
ROMAN = {1000: "m", 900: "cm", 500: "d", 400: "cd", 100: "c", 90: "xc", 50: "l", 40: "xl", 10: "x", 9: "ix", 5: "v", 4: "iv", 1: "i"}


def numbered(n: int, kind: str) -> str:
    """A list number as its type writes it; what a type cannot write is decimal."""
    said = ""
    if kind.lower() == "a" and n > 0:
        while n:
            n, letter = divmod(n - 1, 26)
            said = chr(97 + letter) + said
    elif kind.lower() == "i" and 0 < n < 4000:
        for value, letters in ROMAN.items():
            said += letters * (n // value)
            n %= value
    return (said.upper() if kind in "AI" else said) or str(n)


class _Lines:
    """Lines of output with collapsed blanks and margins between blocks."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.now: list[str] = []
        self.blank = False  # a blank is due before the next word
        self.margin = 0  # empty lines due before the next line
        self.indent = 0  # columns; what goes beyond MOST_INDENT is not written
        self.marker = ""  # of a list item, used once

    def text(self, said: str) -> None:
        if said[:1] in " \t\n\r\f":
            self.blank = True
        body = _BLANK.sub(" ", said).strip(" ")
        if not body:
            return
        if self.blank and self.now:
            self.now.append(" ")
        self.now.append(body)
        self.blank = said[-1:] in " \t\n\r\f"

    def as_is(self, said: str) -> None:
        first, *rest = said.split("\n")
        self.now.append(first)
        for line in rest:
            self.end(force=True)
            self.now.append(line)
        self.blank = False

    def end(self, force: bool = False) -> None:
        """Ends the line; an empty one only if forced."""
        line = "".join(self.now)
        self.now, self.blank = [], False
        if not line.strip() and not force:
            return
        if self.done and self.margin:
            self.done += [""] * self.margin
        self.margin = 0
        indent = " " * max(0, min(self.indent, MOST_INDENT) - len(self.marker)) + self.marker
        self.marker = ""
        self.done.append((indent + line).rstrip())

    def space(self, lines: int) -> None:
        self.end()
        self.margin = max(self.margin, lines)


def _width(said: str) -> int:
    """Columns that a cell takes: wide characters two, marks none."""
    if said.isascii():
        return len(said)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in said)


def _span(node: Node) -> int:
    said = node.attrs.get("colspan", "1").strip()
    return min(max(int(said), 1), MOST_SPAN) if said.isascii() and said.isdigit() and len(said) < 6 else 1


def _down(node: Node) -> int:
    """Rows that a cell takes; 0 is all that follow in its section."""
    said = node.attrs.get("rowspan", "1").strip()
    return min(int(said), MOST_DOWN) if said.isascii() and said.isdigit() and len(said) < 6 else 1


def _placed(rows: list[list[tuple[str, int, bool, int]]], ends: list[int]) -> list[list[tuple[str, int, bool]]]:
    """Rows of (text, columns spanned, header), with an empty cell for each run of columns that a cell from above takes.

    ends: for each row the number of the row after its section, which no cell leaves.
    """
    budget = MOST_PADDING * (sum(map(len, rows)) + len(rows) + 100)
    taken: list[tuple[int, int, int]] = []  # begin, columns and the row from which they are free, by begin
    out = []
    for k, row in enumerate(rows):
        placed: list[tuple[str, int, bool]] = []
        budget -= len(taken)
        if budget < 0:  # far more spans than cells
            return [[(said, span, header) for said, span, header, _ in row] for row in rows]
        at, new, above = 0, [], iter([*taken, (1 << 60, 0, 0)])
        begin, width, _ = next(above)

        def skip() -> None:
            nonlocal at, begin, width
            while begin <= at:
                if begin + width > at:
                    placed.append(("", begin + width - at, True))
                    at = begin + width
                begin, width, _ = next(above)

        for said, span, header, down in row:
            skip()
            placed.append((said, span, header))
            if down != 1:
                new.append((at, span, min(k + down, ends[k]) if down else ends[k]))
            at += span
        while begin < 1 << 60:
            placed += [("", begin - at, True)] * (begin > at)
            at = max(at, begin)
            skip()
        taken = sorted(t for t in taken + new if t[2] > k + 1)
        out.append(placed)
    return out


def _drawn(svg: Node, seen: bool) -> list:
    """The text elements of a drawing that are seen, blanks around them."""
    found: list = []
    work = [(child, seen) for child in reversed(svg.children)]
    while work:
        item, shown = work.pop()
        if isinstance(item, str) or not visible(item) or item.tag in UNDRAWN:
            continue
        own = visibility(item)
        shown = shown if own is None else own
        if item.tag in ("text", "foreignobject"):
            found += [" ", item, " "] if shown else []
        else:
            work.extend((child, shown) for child in reversed(item.children))
    return found


def _table_lines(rows: list[list[tuple[str, int, bool]]]) -> list[str]:
    """Rows of (text, columns spanned, header) as aligned lines; cells of several lines take several."""
    begins = sorted({at for row in rows for at in accumulate((span for _, span, _ in row), initial=0)})
    column = {at: i for i, at in enumerate(begins)}  # columns in which no cell begins or ends have no width of their own
    widths = [0] * len(begins)
    cells_of, text_size = [], 0
    for row in rows:
        at, cells = 0, []
        for said, span, _ in row:
            lines = [(line, _width(line)) for line in said.split("\n")]
            first, last = column[at], column[at + span]
            if last - first == 1:
                widths[first] = max(widths[first], max((w for _, w in lines if w <= WIDE), default=0))
            cells.append((lines, first, last))
            text_size += len(said) + 4
            at += span
        cells_of.append(cells)
    until = list(accumulate(widths, initial=0))  # the width of the columns before each
    room = lambda first, last: until[last] - until[first] + 3 * (last - first - 1)
    padding = sum(max((len(lines) for lines, *_ in cells), default=0) * sum(room(a, b) for _, a, b in cells[:-1]) for cells in cells_of)
    aligned = padding <= MOST_PADDING * text_size + 4000
    out = []
    for row, cells in zip(rows, cells_of, strict=True):
        for k in range(max((len(lines) for lines, *_ in cells), default=0)):
            parts = []
            for lines, first, last in cells:
                said, wide = lines[k] if k < len(lines) else ("", 0)
                parts.append(said + " " * max(0, room(first, last) - wide) if aligned and (first, last) != cells[-1][1:] else said)
            out.append(" | ".join(parts).rstrip())
        if row and all(header for *_, header in row):
            out.append("-+-".join("-" * w for w in (widths[:-1] if aligned else [3] * len(row))))
    return out


def render(root: Node) -> str:
    """The visible text of a tree."""
    lines = _Lines()
    #: What ends elements: a work item is a node, a text, or a function to call.
    tables: list[tuple[_Lines, list]] = []
    lists: list[list] = []
    pre = 0
    seen = True
    work: list = [root]

    def later(*items) -> None:
        work.extend(reversed(items))

    def seeing(value: bool):
        """A step from which on things are seen or not."""

        def step() -> None:
            nonlocal seen
            seen = value

        return step

    def within(node: Node, inherited: bool) -> tuple[bool, list, list]:
        """Whether a part of a table is seen, and the steps before and after what it holds."""
        own = visibility(node)
        if own is None or own == inherited:
            return inherited, [], []
        return own, [seeing(own)], [seeing(inherited)]

    def begin_cell() -> None:
        nonlocal lines
        tables.append((lines, []))
        lines = _Lines()

    while work:
        item = work.pop()
        if callable(item):
            item()
            continue
        if isinstance(item, str):
            if not seen:
                continue
            said = html.unescape(item) if "&" in item else item
            if pre:
                lines.as_is(said)
            else:
                lines.text(said.replace("\xa0", " ") if "\xa0" in said else said)
            continue
        tag = item.tag
        if not visible(item):
            continue
        own_visibility = visibility(item)
        if own_visibility is not None and own_visibility != seen:
            work.append(seeing(seen))  # comes after all that the element puts there
            seen = own_visibility
        if tag == "br":
            lines.end(force=bool(lines.now) or bool(lines.done))
        elif tag == "hr":
            lines.space(1)
            if seen:
                lines.now.append("-" * 8)
            lines.space(1)
        elif tag in ("img", "input"):
            if seen and (said := item.attrs.get("alt" if tag == "img" else "value", "")):
                lines.text(f" {said} ")
        elif tag == "wbr" or tag in VOID:
            continue
        elif tag == "pre":
            lines.space(1)
            pre += 1
            children = list(item.children)
            if children and isinstance(children[0], str) and children[0].startswith("\n"):
                children[0] = children[0][1:]

            def end_pre() -> None:
                nonlocal pre
                pre -= 1
                lines.space(1)

            later(*children, end_pre)
        elif tag in ("ul", "ol", "menu", "dir"):
            lines.space(0 if lists else 1)
            down = tag == "ol" and "reversed" in item.attrs
            items = sum(1 for c in item.children if isinstance(c, Node) and c.tag == "li" and visible(c)) if down else 1
            lists.append([tag == "ol", _whole(item.attrs.get("start"), items), -1 if down else 1, item.attrs.get("type", "1").strip()])

            def end_list() -> None:
                lists.pop()
                lines.space(0 if lists else 1)

            later(*item.children, end_list)
        elif tag == "li":
            lines.end()
            ordered = lists[-1] if lists else [False, 1, 1, "1"]
            number = _whole(item.attrs.get("value"), ordered[1])
            mark = numbered(number, item.attrs.get("type", ordered[3]).strip() or "1") + ". " if ordered[0] else "* "
            ordered[1] = number + ordered[2]
            lines.indent += len(mark)
            lines.marker = mark if seen else ""

            def end_item(wide: int = len(mark)) -> None:
                lines.end()
                lines.marker = ""
                lines.indent -= wide

            later(*item.children, end_item)
        elif tag in ("dd", "blockquote"):
            lines.space(1 if tag == "blockquote" else 0)
            lines.indent += 4

            def end_quote(space: int = int(tag == "blockquote")) -> None:
                lines.space(space)
                lines.indent -= 4

            later(*item.children, end_quote)
        elif tag == "table" and len(tables) < MOST_TABLES:
            lines.space(1)
            rows: list[list[tuple[str, int, bool, int]]] = []
            ends: list[int] = []
            captions: list[str] = []
            held = (lines, rows, captions, list(lists), pre, ends)

            def end_table(held=held) -> None:
                nonlocal lines, lists, pre
                lines, rows, captions, lists, pre = held[0], held[1], held[2], held[3], held[4]
                lines.end()
                for said in captions:
                    lines.now.append(said)
                    lines.end()
                for said in _table_lines([r for r in _placed(rows, held[5]) if any(c[0] for c in r)]):
                    lines.now.append(said)
                    lines.end()
                lines.space(1)

            lists, pre = [], 0
            steps: list = []
            for group in item.children:  # only what stands in the table's own rows is a cell
                if isinstance(group, str):
                    if group.strip():
                        steps.append(group)
                    continue
                if not visible(group):
                    continue
                group_seen, before_group, after_group = within(group, seen)
                if group.tag == "caption":
                    steps += [_cell(begin=True), *before_group, *group.children, *after_group, _cell(begin=False, into=captions)]
                elif group.tag in ("tbody", "thead", "tfoot"):
                    steps += before_group
                    for row in group.children:
                        if isinstance(row, str):
                            if row.strip():
                                steps += [row, " "]
                            continue
                        if not visible(row):
                            continue
                        if row.tag != "tr":
                            steps.append(row)
                            continue
                        own: list[tuple[str, int, bool, int]] = []
                        rows.append(own)
                        row_seen, before_row, after_row = within(row, group_seen)
                        steps += before_row
                        for cell in row.children:
                            if isinstance(cell, str):
                                if cell.strip():
                                    steps += [cell, " "]
                                continue
                            if not visible(cell):
                                continue
                            if cell.tag in ("td", "th"):
                                _, before, after = within(cell, row_seen)
                                steps += [_cell(begin=True), *before, *cell.children, *after, _cell(begin=False, into=own, span=_span(cell), header=cell.tag == "th", down=_down(cell))]
                            else:
                                steps.append(cell)
                        steps += after_row
                    steps += after_group
                    ends += [len(rows)] * (len(rows) - len(ends))
                elif group.tag not in ("colgroup", "col"):
                    steps.append(group)

            def bind(step):
                if not isinstance(step, _cell):
                    return step

                def run() -> None:
                    nonlocal lines
                    if step.begin:
                        begin_cell()
                    else:
                        lines.end()
                        said = "\n".join(lines.done).strip("\n")
                        lines, _ = tables.pop()
                        step.into.append((said, step.span, step.header, step.down) if step.span else said)

                return run

            later(*map(bind, steps), end_table)
        elif tag == "svg":
            later(*_drawn(item, seen))
        elif tag in ("button", "textarea", "select"):  # boxes of their own
            later(" ", *item.children, " ")
        elif tag in APART:
            later(*[part for child in item.children for part in (child, " ")])
        elif tag in BLOCKS:
            space = 1 if tag in SPACED else 0
            lines.space(space)
            later(*item.children, lambda space=space: lines.space(space))
        else:
            later(*item.children)
    lines.end()
    return "\n".join(lines.done).strip("\n")


class _cell:
    """Marks the begin or end of a table cell (or, with span 0, of a caption) among the steps of a table."""

    __slots__ = ("begin", "into", "span", "header", "down")

    def __init__(self, begin: bool, into: list | None = None, span: int = 0, header: bool = False, down: int = 1):
        self.begin, self.into, self.span, self.header, self.down = begin, into, span, header, down


def extract(page: str | None) -> str:
    return render(build(page)) if page else ""


def text_column(page: Column) -> Column:
    """The visible text of a page."""

    @F.pandas_udf("string")
    def layout(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(extract, na_action=None).astype(object)

    return layout(page)


def render_pages(pages: DataFrame) -> DataFrame:
    """page_id and text of every page."""
    return pages.select("page_id", text_column(F.col("html")).alias("text"))
