"""Visible text of HTML pages, laid out: blocks, lists and aligned tables."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import text_slices

MAX_SPAN = 1000  # as in the HTML standard

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
NEVER_SHOWN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title meta link base param source track area rp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
#: An opening tag ends the open elements named first, looked for up to the elements named second.
ENDS = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist optgroup"), "optgroup": ("option optgroup", "select"),
    "tr": ("tr td th caption colgroup", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "thead": ("thead tbody tfoot tr td th caption colgroup", "table"),
    "tbody": ("thead tbody tfoot tr td th caption colgroup", "table"), "tfoot": ("thead tbody tfoot tr td th caption colgroup", "table"), "caption": ("caption", "table"), "rt": ("rt rp", "ruby"), "rp": ("rt rp", "ruby"),
}
_ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}

# A tag's attributes by the standard's states: name, before the value, quoted or bare value. Nothing is tried twice, so a page is read in one pass.
_ATTRIBUTE_SOURCE = r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?+"""
_ATTRIBUTES = "(?:" + re.sub(r"\((?=\[\^)", "(?:", _ATTRIBUTE_SOURCE) + r")*+[\s/]*+"
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*+)" + _ATTRIBUTES + r"(?:>|\Z)|<([a-zA-Z][^\s/>]*+)(" + _ATTRIBUTES + r")(>|\Z)", re.S)
_ATTRIBUTE = re.compile(_ATTRIBUTE_SOURCE)
_DECLARATION = re.compile(r"(?:^|[;{\s])(display|visibility)\s*:\s*([a-z-]+)[^;]*", re.I)
_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
_RAW_ENDS = {name: re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I | re.A) for name in RAW}
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    """gone: nothing of the element takes part in the page; shown: its own text is visible."""

    __slots__ = ("tag", "attributes", "children", "gone", "shown")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.gone, self.shown = False, True


def attributes_of(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def parse(page: str) -> Node:
    """The element tree; tags that authors may leave out are implied, stray end tags ignored.

    As in a browser, a tag that the page ends in is no tag, and what it swallowed is not shown.
    """
    root = Node("html", {})
    stack = [root]
    sheets: list[str] = []
    places: dict[str, list[int]] = {}  # per tag, where its open elements stand in the stack
    at = 0

    def text(raw: str) -> None:
        if raw:
            if len(stack) > 1 and stack[-1].tag == "head" and raw.strip():
                close(len(stack) - 1)
            stack[-1].children.append(html.unescape(raw) if "&" in raw else raw)

    def close(upto: int) -> None:
        while len(stack) > upto:
            places[stack.pop().tag].pop()

    def last(names: frozenset) -> int:
        return max((p[-1] for n in names if (p := places.get(n))), default=0)

    def find(names: frozenset, fence: frozenset) -> int:
        """The lowest open element of these names above the fence."""
        above = last(fence)
        return min((p[bisect_right(p, above)] for n in names if (p := places.get(n)) and p[-1] > above), default=0)

    while True:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        end, name = m[1], m[2]
        if name and not m[4]:
            break
        if end:
            end = end.lower()
            if end == "br":
                stack[-1].children.append(Node("br", {}))
            elif end in HEADINGS:
                i = find(HEADINGS, frozenset(("table", "td", "th")))
                close(i or len(stack))
            elif end not in ("html", "body"):
                fence = frozenset(("table",)) if end not in ("table",) and end not in _ENDS else frozenset()
                i = last(frozenset((end,)))
                if i > last(fence):
                    close(i)
            continue
        if not name:
            continue
        name, source = name.lower(), m[3]
        if name == "html":
            continue
        if len(stack) > 1 and stack[-1].tag == "head" and name not in HEAD_ONLY:
            close(len(stack) - 1)
        if name == "body":
            root.attributes |= attributes_of(source)
            continue
        if name in CLOSES_P:
            i = find(frozenset("p"), frozenset("table td th caption button".split()))
            if i:
                close(i)
            if name in HEADINGS and stack[-1].tag in HEADINGS:
                close(len(stack) - 1)
        if name in _ENDS:
            i = find(*_ENDS[name])
            if i:
                close(i)
        node = Node(name, attributes_of(source) if source.strip(" /") else {})
        stack[-1].children.append(node)
        if name in VOID:
            continue
        if name in RAW:
            stop = m.start() if (m := _RAW_ENDS[name].search(page, at)) else len(page)
            if name == "style":
                sheets.append(page[at:stop])
            if name == "textarea":
                node.children.append(html.unescape(page[at:stop]))
            at = page.find(">", stop) + 1 or len(page)
            continue
        if not (source.endswith("/") and name in ("path", "circle", "rect", "line", "use", "g")):
            places.setdefault(name, []).append(len(stack))
            stack.append(node)
    mark_visible(root, Sheet("\n".join(sheets)))
    return root


class Sheet:
    """The display and visibility that rules of style elements give by simple selectors: a tag, classes, an id, or several of them.

    Rules with combinators, pseudo-classes or attributes, at-rules and linked sheets are left aside.
    """

    def __init__(self, css: str):
        self.rules: dict[str, list[tuple]] = {}
        css = re.sub(r"/\*.*?(?:\*/|\Z)", " ", css, flags=re.S)
        if not re.search("display|visibility", css, re.I):
            return
        depth = 0
        flat = []  # only rules outside of at-rules' braces
        for piece in re.split(r"(@[^{};]*[{;]|[{}])", css):
            if depth:
                depth += piece.endswith("{") - (piece == "}")
            elif piece.startswith("@"):
                depth = int(piece.endswith("{"))
            else:
                flat.append(piece)
        for order, (selectors, body) in enumerate(_RULE.findall("".join(flat))):
            found = declared(body)
            for selector in selectors.split(",") if found else ():
                m = _SELECTOR.fullmatch(selector.strip())
                if m and m[0]:
                    tag = (m[1] or "*").lower()
                    classes, ids = re.findall(r"\.([\w-]+)", m[2]), re.findall(r"#([\w-]+)", m[2])
                    key = f"#{ids[0]}" if ids else f".{classes[0]}" if classes else tag
                    self.rules.setdefault(key, []).append(((len(ids), len(classes), tag != "*", order), tag, set(classes), set(ids), found))

    def of(self, node: Node) -> dict[str, str]:
        if not self.rules:
            return {}
        classes, ids = set(node.attributes.get("class", "").split()), {node.attributes.get("id", "")}
        keys = [*(f".{c}" for c in classes), *(f"#{i}" for i in ids), node.tag, "*"]
        fit = [(rank, found) for k in keys for rank, tag, c, i, found in self.rules.get(k, ()) if tag in ("*", node.tag) and c <= classes and i <= ids]
        out: dict[str, str] = {}
        for _, found in sorted(fit, key=lambda x: x[0]):
            out |= found
        return out


def declared(style: str) -> dict[str, str]:
    return {k.lower(): v.lower() for k, v in _DECLARATION.findall(style)}


def mark_visible(root: Node, sheet: Sheet) -> None:
    """Sets gone and shown of every element: by its kind, the hidden attribute, style elements and its own style; visibility is inherited."""
    left = [(root, True)]
    while left:
        node, shown = left.pop()
        a = node.attributes
        style = sheet.of(node)
        if "style" in a:
            style = style | declared(a["style"])
        default = ("hidden" in a and a["hidden"].lower() != "until-found") or (node.tag == "dialog" and "open" not in a) or (node.tag == "input" and a.get("type", "").lower() == "hidden")
        node.gone = node.tag in NEVER_SHOWN or (style["display"] == "none" if "display" in style else default)
        node.shown = {"visible": True, "hidden": False, "collapse": False}.get(style.get("visibility", ""), shown)
        if not node.gone:
            left += [(c, node.shown) for c in node.children if isinstance(c, Node)]


class Flow:
    """Lines of a block context; white space collapses, margins of neighbours merge into one blank line."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False

    def text(self, s: str) -> None:
        s = _SPACES.sub(" ", s)
        if s[:1] == " " and (not self.now or self.now[-1].endswith(" ")):
            s = s[1:]
        if s:
            self.now.append(s)

    def end_line(self, spaced: bool = False) -> None:
        line = "".join(self.now).rstrip(" ")
        self.now = []
        if line:
            self._put([line])
        self.gap |= spaced

    def put(self, lines: list[str], spaced: bool = False) -> None:
        self.end_line(spaced)
        if lines:
            self._put(lines)
        self.gap |= spaced

    def _put(self, lines: list[str]) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines += lines


def _int(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"[+-]?\d{1,9}", value.strip()) else default


def walk(task: Generator):
    """The result of a task; what it yields are tasks, whose results it is sent. Depth takes no Python frames."""
    tasks, result = [task], None
    while tasks:
        try:
            task = tasks[-1].send(result)
        except StopIteration as end:
            tasks.pop()
            result = end.value
        else:
            tasks.append(task)
            result = None
    return result


def lay_out(node: Node, flow: Flow) -> Generator:
    """A task for walk() that puts what the element shows into the flow."""
    counter = _int(node.attributes.get("start"), 1) if node.tag == "ol" else 0
    shut = node.tag == "details" and "open" not in node.attributes
    for child in node.children:
        if isinstance(child, str):
            if node.shown and not shut and not (node.tag in ("ul", "ol", "select", "dl") and not child.strip()):
                flow.text(child)
            continue
        tag = child.tag
        if child.gone or (shut and tag != "summary"):
            continue
        if tag == "br":
            line = "".join(flow.now).rstrip(" ")
            if line or not flow.lines or flow.gap:
                flow.end_line()
            else:
                flow.lines.append("")
        elif tag == "wbr" or tag == "img":
            continue
        elif tag == "pre":
            flow.put([x.rstrip() for x in "".join(_strings(child)).removeprefix("\n").rstrip().split("\n")], True)
        elif tag == "textarea":
            flow.put([x for x in "".join(_strings(child)).split("\n") if x.strip()])
        elif tag == "table":
            stray = Node("div", {})
            stray.children, stray.shown = list(_stray(child)), child.shown
            if stray.children:
                flow.end_line()
                yield lay_out(stray, flow)
            flow.put((yield table_lines(child)), True)
        elif tag == "li":
            own = Flow()
            yield lay_out(child, own)
            own.end_line()
            if node.tag == "ol":
                counter = _int(child.attributes.get("value"), counter)
                mark, counter = f"{counter}. ", counter + 1
            else:
                mark = "- "
            if not child.shown:  # what is visible inside stands without a mark
                flow.put(own.lines)
                continue
            lines = own.lines or [""]
            flow.put([(mark + lines[0]).rstrip(), *((" " * len(mark) + x) if x else "" for x in lines[1:])])
        elif tag == "dd":
            own = Flow()
            yield lay_out(child, own)
            own.end_line()
            flow.put([("  " + x) if x else "" for x in own.lines])
        elif tag in BLOCKS or tag in ("tr", "td", "th", "thead", "tbody", "tfoot", "caption"):
            spaced = tag in SPACED and not (tag in ("ul", "ol", "menu") and node.tag == "li")
            flow.end_line(spaced)
            yield lay_out(child, flow)
            flow.end_line(spaced)
        else:
            yield lay_out(child, flow)


def _strings(node: Node) -> Iterator[str]:
    left = [(c, node.shown) for c in node.children[::-1]]
    while left:
        child, shown = left.pop()
        if isinstance(child, str):
            if shown:
                yield child
        elif child.tag == "br":
            yield "\n"
        elif not child.gone:
            left += [(c, child.shown) for c in child.children[::-1]]


def _stray(node: Node) -> Iterator[Node | str]:
    """What stands in a table outside its cells and captions; a page shows it before the table."""
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                yield child
        elif child.tag in ("thead", "tbody", "tfoot", "tr"):
            if not child.gone:
                yield from _stray(child)
        elif child.tag not in ("td", "th", "caption", "colgroup", "col"):
            yield child


def _rows(node: Node, out: list[Node], captions: list[Node]) -> None:
    order = {"thead": 0, "tfoot": 2}
    for child in sorted((c for c in node.children if isinstance(c, Node)), key=lambda c: order.get(c.tag, 1)):
        if child.gone:
            continue
        if child.tag == "tr":
            out.append(child)
        elif child.tag in ("thead", "tbody", "tfoot"):
            _rows(child, out, captions)
        elif child.tag == "caption":
            captions.append(child)
        elif child.tag in ("td", "th"):
            if not out or out[-1].tag != "#row":
                out.append(Node("#row", {}))
            out[-1].children.append(child)


def table_lines(table: Node) -> Generator:
    """A task for walk(): the lines of rows of cells in aligned columns, two spaces apart; spans keep their columns."""
    rows, captions = [], []
    _rows(table, rows, captions)
    lines: list[str] = []
    for node in captions:
        own = Flow()
        yield lay_out(node, own)
        own.end_line()
        lines += own.lines
    grid: list[list[tuple[int, int, list[str]]]] = []  # per row: column, columns, lines
    taken: dict[int, int] = {}  # column -> rows it is still covered from above
    for row in rows:
        cells, column, covered = [], 0, {c for c, n in taken.items() if n > 0}
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        for cell in row.children:
            if isinstance(cell, str) or cell.tag not in ("td", "th") or cell.gone:
                continue
            while column in covered:
                column += 1
            own = Flow()
            yield lay_out(cell, own)
            own.end_line()
            wide, tall = min(MAX_SPAN, max(1, _int(cell.attributes.get("colspan"), 1))), _int(cell.attributes.get("rowspan"), 1)
            cells.append((column, wide, own.lines))
            if tall > 1:
                taken |= dict.fromkeys(range(column, column + wide), tall - 1)
            column += wide
        grid.append(cells)
    width: dict[int, int] = {}
    for spans in (1, 2):  # single cells first, then what spans several columns widens the last
        for cells in grid:
            for column, wide, text in cells:
                if (wide == 1) == (spans == 1):
                    need = max((len(x) for x in text), default=0)
                    have = sum(width.get(c, 0) + 2 for c in range(column, column + wide)) - 2
                    last = column + wide - 1
                    width[last] = max(width.get(last, 0), width.get(last, 0) + need - have)
    left, x = {}, 0
    for c in range(max(width, default=-1) + 1):
        left[c] = x
        x += width.get(c, 0) + 2 if width.get(c, 0) else 0
    for cells in grid:
        for i in range(max((len(text) for _, _, text in cells), default=0)):
            line = ""
            for column, _, text in cells:
                if i < len(text) and text[i]:
                    line = line.ljust(left[column]) + text[i]
            lines.append(line.rstrip())
    return lines


def render(page: str | None) -> str:
    """All visible text of a page; see extract()."""
    if not page:
        return ""
    root, flow = parse(page), Flow()
    if not root.gone:
        walk(lay_out(root, flow))
        flow.end_line()
    return "\n".join(flow.lines).strip("\n")


def extract(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """A row per page: key and its visible text.

    Tags that may be left out are implied. Nothing is shown of scripts, styles, heads
    and the like, or of elements hidden by attribute, by their own style or by simple selectors of style
    elements (see Sheet); a visible part of an invisible element is shown. Blocks start
    on new lines; paragraphs, headings, lists and tables stand apart by a blank line; list
    items are marked and indented; table cells are padded to columns; preformatted text
    is kept. A page of any length is read in one pass. A null or empty page gives an empty text; repeated rows get a row each; an
    empty table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([render(p) for p in batch.column(1).to_pylist()], pa.string())], ["page_id", "text"])

    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(source).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, text string").withColumnRenamed("page_id", key)
