"""Visible text of HTML pages, laid out: blocks apart, list marks, table cells in columns.

A tree builder closes and opens the tags that HTML implies. Rendering leaves out what a browser does not
show and keeps all other text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "page_id long, text string, n_lines long"
#: Deeper elements are put beside each other, as browsers do.
DEEPEST = 150
#: A column is as wide as its widest line of at most this width. Wider lines are wrapped if cells follow them;
#: where that cannot be, as with a long word, the cells that follow stand a line below.
WIDEST_PADDING = 40
# HTML's own limits.
MOST_COLUMNS, MOST_ROWS = 1000, 65534

# Fixed values of HTML: element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
NOT_SHOWN = frozenset("head script style template noscript iframe noembed noframes object datalist audio video canvas annotation annotation-xml mphantom title area param source track link meta base".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul "
    "caption colgroup tbody td tfoot th thead tr xmp select textarea".split()
)
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr menu dir fieldset xmp".split())
CLOSES_P = BLOCK - frozenset("body html dd dt li option optgroup caption colgroup tbody td tfoot th thead tr select textarea".split())
# Opening the first closes any of the second that are open, up to the third.
IMPLIED_ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset("tbody thead tfoot table".split())),
    "tbody": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
}
SCOPES = frozenset("table td th caption button html".split())
# All that a head holds; anything else ends it.
IN_HEAD = frozenset("title meta link base basefont bgsound style script noscript noframes template".split())
# HTML that ends an open svg or math, unless it stands where these hold HTML.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p "
    "pre ruby s small span strong strike sub sup table tt u ul var".split()
)
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
# Definitions and descriptions of a drawing.
DRAWN_LATER = frozenset("defs symbol desc metadata clippath mask pattern marker".split())
# The parts of these are apart: a fraction is not its digits in a row.
MATH_APART = frozenset("mfrac msub msup msubsup munder mover munderover mmultiscripts mroot mtr mlabeledtr mtable".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>])*+)>", re.S)
# A tag or comment that the page ends in is not shown.
_UNENDED = re.compile(r"<[!?/a-zA-Z]")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_BLANK = re.compile(r"[ \t\n\r\f]*")


class Element:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def get(self, name: str) -> str | None:
        """An attribute's value, empty if it has none."""
        for key, *values in _ATTRIBUTE.findall(self.attributes):
            if key.lower() == name:
                return unescape(next((v for v in values if v), ""))
        return None


def build_tree(html: str) -> Element:
    """The elements of a page, with implied ends and implied table rows."""
    root = Element("html")
    stack, at = [root], 0
    # The outermost open svg or math and its depth.
    outer, outer_depth = None, 0

    def close(tags: frozenset[str], limits: frozenset[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in limits:
                return
            if stack[depth].tag in tags and not any(e.tag in tags for e in _upwards(stack, depth - 1, limits)):
                del stack[depth:]
                return

    def open_(tag: str, attributes: str = "") -> Element:
        element = Element(tag, attributes)
        stack[-1].children.append(element)
        if len(stack) < DEEPEST + (tag == "text"):
            stack.append(element)
        return element

    def text(raw: str) -> None:
        if stack[-1].tag == "head" and not _BLANK.fullmatch(raw):
            stack.pop()
        stack[-1].children.append(unescape(raw))

    def is_foreign() -> bool:
        """Whether the place is in svg or math and not where these hold HTML."""
        if outer is None or len(stack) <= outer_depth or stack[outer_depth] is not outer:
            return False
        inner = next(e.tag for e in reversed(stack) if e is outer or e.tag in HOLDS_HTML or e.tag in ("svg", "math"))
        return inner in ("svg", "math")

    last = html.rfind(">")
    while at <= last and (token := _TOKEN.search(html, at)):
        if token.start() > at:
            text(html[at : token.start()])
        at, (end, tag, attributes) = token.end(), token.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if end:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if stack[depth].tag in SCOPES and tag not in SCOPES and tag not in ("tr", "tbody", "thead", "tfoot"):
                    break
            continue
        if tag in ("html", "body"):
            root.attributes += f" {attributes}"
            close(frozenset(["head"]), frozenset())
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            stack.pop()
        if outer is not None and is_foreign():
            if tag in BREAKS_OUT:
                while is_foreign():
                    stack.pop()
            elif attributes.endswith("/"):
                stack[-1].children.append(Element(tag, attributes))
                continue
        if tag in CLOSES_P:
            close(frozenset(["p"]), SCOPES)
            close(frozenset(["head"]), frozenset())
        if tag in IMPLIED_ENDS:
            close(*IMPLIED_ENDS[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            open_("tr")
        if tag in VOID:
            stack[-1].children.append(Element(tag, attributes))
        elif tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I).search(html, at)
            element = Element(tag, attributes)
            inside = html[at : stop.start()]
            element.children.append(unescape(inside) if tag in ("title", "textarea") else inside)
            stack[-1].children.append(element)
            closing = html.find(">", stop.end())
            at = len(html) if stop.start() == len(html) or closing < 0 else closing + 1
        elif not attributes.endswith("/") or tag not in ("svg", "math"):
            element = open_(tag, attributes)
            if tag in ("svg", "math") and stack[-1] is element and not (outer is not None and len(stack) > outer_depth and stack[outer_depth] is outer):
                outer, outer_depth = element, len(stack) - 1
    if at < len(html):
        text(_UNENDED.split(html[at:], maxsplit=1)[0])
    return root


def _upwards(stack: list[Element], depth: int, limits: frozenset[str]) -> Iterator[Element]:
    while depth > 0 and stack[depth].tag not in limits:
        yield stack[depth]
        depth -= 1


def is_shown(element: Element) -> bool:
    if element.tag in NOT_SHOWN:
        return False
    if not element.attributes:
        return True
    if element.tag == "input" and (element.get("type") or "").lower() in ("hidden", "checkbox", "radio", "password"):
        return False
    if "hidden" in element.attributes and element.get("hidden") is not None:
        return False
    return "style" not in element.attributes or not _HIDING.search(element.get("style") or "")


class Layout:
    """Lines of a block; inline text gathers until the next block or break ends the line."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []

    def end_line(self) -> None:
        text = _BLANKS.sub(" ", "".join(self.inline)).strip(" ")
        if text:
            self.lines.append(text)
        self.inline = []

    def gap(self) -> None:
        self.end_line()
        if self.lines and self.lines[-1]:
            self.lines.append("")

    def add(self, children: list, pre: bool = False) -> Layout:
        for child in children:
            if isinstance(child, str):
                if pre:
                    first, *rest = child.replace("\r\n", "\n").split("\n")
                    self.inline.append(first)
                    for line in rest:
                        self.lines.append("".join(self.inline).rstrip())
                        self.inline = [line]
                else:
                    self.inline.append(child)
            elif is_shown(child):
                self.element(child, pre)
        return self

    def element(self, e: Element, pre: bool) -> None:
        if e.tag == "br":
            self.lines.append(_BLANKS.sub(" ", "".join(self.inline)).strip(" "))
            self.inline = []
        elif e.tag == "input":
            self.inline.append(f" {e.get('value') or ''} ")
        elif e.tag == "svg":
            self.labels(e)
        elif e.tag in MATH_APART:
            for child in e.children:
                if not isinstance(child, str) or child.strip():
                    self.inline.append(" ")
                    self.add([child], pre)
            self.inline.append(" ")
        elif e.tag not in BLOCK:
            self.add(e.children, pre)
        else:
            (self.gap if e.tag in APART else self.end_line)()
            if e.tag in ("ul", "ol", "menu", "dir"):
                self.list_items(e)
            elif e.tag == "table":
                self.table(e)
            elif e.tag in ("pre", "xmp", "textarea"):
                inner = Layout().add(e.children, True)
                self.lines += [*inner.lines, "".join(inner.inline).rstrip()]
            elif e.tag in ("dd", "blockquote"):
                self.lines += [f"    {line}" if line else "" for line in block_lines(e.children)]
            elif e.tag == "details" and e.get("open") is None:
                self.add([c for c in e.children if not isinstance(c, str) and c.tag == "summary"])
            else:
                self.add(e.children, pre)
            (self.gap if e.tag in APART else self.end_line)()

    def labels(self, e: Element) -> None:
        """The text elements of a drawing, apart from each other, and the HTML in it."""
        for child in e.children:
            if isinstance(child, str) or child.tag in DRAWN_LATER or not is_shown(child):
                continue
            if child.get("display") == "none" or child.get("visibility") in ("hidden", "collapse"):
                continue
            if child.tag in ("text", "foreignobject"):
                self.inline.append(" ")
                self.add(child.children)
                self.inline.append(" ")
            else:
                self.labels(child)

    def list_items(self, e: Element) -> None:
        number = e.get("start") if e.tag == "ol" else None
        number = int(number) if number and re.fullmatch(r"-?\d{1,9}", number) else 1
        for child in e.children:
            if isinstance(child, str) or child.tag != "li":
                self.add([child])
                continue
            if not is_shown(child):
                continue
            self.end_line()
            mark = f"{number}. " if e.tag == "ol" else "- "
            number += 1
            first, *rest = block_lines(child.children) or [""]
            self.lines.append((mark + first).rstrip())
            self.lines += [" " * len(mark) + line if line else "" for line in rest]

    def table(self, e: Element) -> None:
        rows: list[dict[int, list[str]]] = []

        def gather(children: list) -> None:
            # First column, column after the last and row after the last of cells that reach into rows below.
            open_: list[tuple[int, int, float]] = []
            for child in children:
                if isinstance(child, str):
                    if child.strip():
                        self.add([child])
                elif is_shown(child):
                    if child.tag in ("tbody", "thead", "tfoot"):
                        gather(child.children)
                        open_ = []
                    elif child.tag == "tr":
                        row, column, passed, opened = {}, 0, 0, []
                        for cell in child.children:
                            if isinstance(cell, str) or cell.tag not in ("td", "th"):
                                self.add([cell])
                            elif is_shown(cell):
                                while passed < len(open_) and open_[passed][0] <= column:
                                    column = max(column, open_[passed][1])
                                    passed += 1
                                row[column] = block_lines(cell.children)
                                after = column + (span_of(cell, "colspan", MOST_COLUMNS) or 1)
                                opened.append((column, after, len(rows) + (span_of(cell, "rowspan", MOST_ROWS) or float("inf"))))
                                column = after
                        rows.append(row)
                        open_ = sorted(o for o in (*open_, *opened) if o[2] > len(rows))
                    else:
                        self.element(child, False)

        gather(e.children)
        self.end_line()
        for row in rows:
            followed = max((c for c, cell in row.items() if cell), default=0)
            for column, cell in row.items():
                if column < followed:
                    row[column] = [part for line in cell for part in wrapped(line)]
        widths: dict[int, int] = {}
        for row in rows:
            for column, cell in row.items():
                widths[column] = max([widths.get(column, 0), *(len(line) for line in cell if len(line) <= WIDEST_PADDING)])
        begin, begins = 0, {}
        for column in sorted(widths):
            begins[column] = begin
            begin += widths[column] + 2
        for row in rows:
            for k in range(max(map(len, row.values()), default=0)):
                out = ""
                for column, cell in row.items():
                    if k < len(cell) and cell[k]:
                        if out and len(out) > begins[column] - 2:
                            self.lines.append(out.rstrip())
                            out = ""
                        out = out.ljust(begins[column]) + cell[k]
                self.lines.append(out.rstrip())


def span_of(cell: Element, name: str, most: int) -> int:
    """The number of columns or rows of a cell."""
    value = (cell.get(name) or "").strip() if cell.attributes else ""
    return min(int(value), most) if re.fullmatch(r"[0-9]{1,9}", value) else 1


def wrapped(line: str) -> list[str]:
    """A line in parts of at most the widest padding; words stay whole, lines laid out with blanks as they are."""
    if len(line) <= WIDEST_PADDING or "  " in line or line[0] == " ":
        return [line]
    out: list[list[str]] = [[]]
    room = WIDEST_PADDING
    for word in line.split(" "):
        if out[-1] and len(word) > room:
            out.append([])
            room = WIDEST_PADDING
        out[-1].append(word)
        room -= len(word) + 1
    return [" ".join(words) for words in out]


def block_lines(children: list) -> list[str]:
    """The lines of a block without blank ones at its ends and without two in a row."""
    layout = Layout().add(children)
    layout.end_line()
    out: list[str] = []
    for line in layout.lines:
        if line or (out and out[-1]):
            out.append(line)
    while out and not out[-1]:
        out.pop()
    return out


def visible_text(html: str | None) -> str:
    return "\n".join(block_lines([build_tree(html)])) if html else ""


def rendered(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, text, n_lines``, one row per page.

    Null and empty pages have empty text and no lines. Rows with null or repeated ids are rendered like
    others; other columns are not read; an empty table gives no rows.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(h) for h in batch.column("html").to_pylist()]
            yield pa.record_batch(
                [batch.column("page_id"), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())],
                names=["page_id", "text", "n_lines"],
            )

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(render, RESULT)
