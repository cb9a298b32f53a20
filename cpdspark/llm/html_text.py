"""Visible text of HTML pages, laid out: a tree builder feeds a renderer.

The builder turns a page into balanced open and close events. It supplies end tags that HTML implies
(paragraphs before blocks, items, table rows and cells, options, definition lists), ignores end tags
without a start, does not let them cross the border of a table cell, and closes what is left open.
The renderer keeps a stack of boxes instead of recursing, so depth is no limit:

- white space collapses, except in ``pre`` and ``textarea``;
- blocks stand on lines of their own; paragraphs, headings, lists and tables have a blank line around them;
- list items are marked (``-``, or their number) and indented by depth;
- table cells are aligned: columns are as wide as their widest cell up to ``CELL`` characters (wider
  cells keep all their text and only push their own line), cells over several columns or rows count.

Not visible: head, scripts, styles, templates, ``noscript`` and embedded frames, comments, elements with
``hidden``, ``display:none`` or ``visibility:hidden`` in their style or by the page's own style sheets, hidden
inputs and passwords, closed ``dialog`` and ``details`` (except the summary). Of style sheets count rules for a tag, classes and an id
of the element itself, by importance, specificity and order, and media rules as on a screen of 1280 pixels; selectors
with relations, attributes or states do not count. Of ``svg`` the texts and foreign objects are visible, of ``math`` all
but annotations, of ``object`` what stands in for it.

Each page is one row's work, in a Pandas UDF with results sent in slices. Defined cases: null and
empty pages give null and empty text; broken markup is read as far as it goes; null ids, repeated rows and
further columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

CELL = 40
INDENTS = 24  # deeper lists are not indented further
OUTPUT_CHARS = 1 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe noframes noembed textarea title xmp".split())
UNSEEN = frozenset("head script style template noscript iframe noframes noembed title datalist audio video canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul xmp".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl pre xmp blockquote table figure hr".split())
#: Start tags of HTML that end an open svg or math element.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p "
    "pre ruby s small span strong strike sub sup table tt u ul var".split()
)
_UNSEEN_SVG = frozenset("desc metadata defs symbol clippath mask pattern marker".split())
_UNSEEN_MATH = frozenset(["annotation", "annotation-xml"])
_HTML_INSIDE = ("foreignobject", "mi", "mo", "mn", "ms", "mtext")
TABLE_PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th".split())
_SECTIONS = frozenset("thead tbody tfoot".split())
#: Start tag -> what it closes, and where the search for it ends.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "option": (frozenset(["option"]), frozenset("select optgroup datalist".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset("select datalist".split())),
    "td": (frozenset("td th caption".split()), frozenset("table tr".split())),
    "th": (frozenset("td th caption".split()), frozenset("table tr".split())),
    "tr": (frozenset("tr caption colgroup".split()), frozenset(["table", *_SECTIONS])),
    **{s: (frozenset(["caption", "colgroup", *_SECTIONS]), frozenset(["table"])) for s in _SECTIONS},
    "body": (frozenset(["head"]), frozenset()),
}
_CLOSES_P = BLOCKS - frozenset("body html td th tr thead tbody tfoot caption option optgroup".split())
_SCOPE = frozenset("table td th caption".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</[^a-zA-Z][^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CSS = re.compile(r"([^{};]*)([{};])")
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_SHOWS = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([\w-]+)\s*(!\s*important)?", re.I)
_SELECTOR = re.compile(r"(?:[a-zA-Z][\w-]*|\*)?(?:[.#][\w-]+)*")
_WIDTH = re.compile(r"\(\s*(min|max)-width\s*:\s*([\d.]+)\s*(px|em|rem)?\s*\)")
_SCREEN = 1280
_SPACES = re.compile(r"[ \t\n\r\f\v ]+")
MOST_ROWS = 65_534  # that a cell covers
_VALUES = frozenset(
    ["", *"text search email url tel number date time datetime-local month week submit button reset".split()]
)  # input types whose value is seen
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def _on_screen(query: str) -> bool:
    """Whether a media query list holds on a screen of ``_SCREEN`` pixels; unknown features do not."""

    def holds(one: str) -> bool:
        one = one.strip().removeprefix("only ").strip()
        if one.startswith("not "):
            return one[4:].strip() not in ("all", "screen")
        for k, part in enumerate(re.split(r"\s+and\s+", one)):
            if k == 0 and part in ("", "all", "screen"):
                continue
            if not (m := _WIDTH.fullmatch(part)):
                return False
            width = float(m[2].strip(".") or 0) * (1 if m[3] in (None, "px") else 16)
            if (_SCREEN < width) if m[1] == "min" else (_SCREEN > width):
                return False
        return True

    return any(holds(one) for one in query.lower().split(","))


def _declared(body: str) -> Iterator[tuple[str, bool, bool]]:
    """``(property, hides, important)`` of display and visibility."""
    for name, value, important in _SHOWS.findall(body):
        yield name.lower(), value.lower() in ("none", "hidden", "collapse"), bool(important)


Rules = dict[str, list[tuple[frozenset[str], str, tuple[bool, int, int, int, int], bool]]]


def _rules(page: str) -> Rules:
    """What the page's style sheets say on display and visibility, by one name of each selector.

    A style sheet is what the tree builder calls so: not the like in comments, scripts, templates or ``noscript``.
    """
    out: Rules = {}
    order = 0
    for kind, sheet, attributes in events(page):
        if kind != "style":
            continue
        if not _on_screen(attributes.get("media", "")) or attributes.get("type", "text/css").lower() not in ("", "text/css"):
            continue
        blocks: list[bool] = []  # whether each open at-rule holds
        selectors = None
        for text, sign in _CSS.findall(_CSS_COMMENT.sub(" ", sheet)):
            text = text.strip()
            if selectors is not None:
                body += text + ";"
                if sign != "}":
                    continue
                for name in selectors:
                    if not name or not all(blocks) or not _SELECTOR.fullmatch(name):
                        continue
                    names = frozenset(x if x[0] in ".#" else x.lower() for x in re.findall(r"[.#]?[\w-]+", name))
                    ids, classes = sum(x[0] == "#" for x in names), sum(x[0] == "." for x in names)
                    for prop, hides, important in _declared(body):
                        order += 1
                        weight = (important, ids, classes, len(names) - ids - classes, order)
                        out.setdefault(max(names, default="*"), []).append((names, prop, weight, hides))
                selectors = None
            elif sign == "}":
                if blocks:
                    blocks.pop()
            elif sign == "{":
                head = text.lower()
                if head.startswith("@media"):
                    blocks.append(_on_screen(head[6:]))
                elif head.startswith("@supports"):
                    blocks.append(not head[9:].strip().startswith("not"))
                elif head.startswith("@layer"):
                    blocks.append(True)
                elif head.startswith("@"):
                    blocks.append(False)
                else:
                    selectors, body = [x.strip() for x in text.split(",")], ""
    return out


def _shown(tag: str, attributes: dict[str, str], rules: Rules) -> tuple[bool, bool | None]:
    """Whether an element has a box, and whether its visibility is set to hidden (None: as around it)."""
    if tag in UNSEEN or tag == "dialog" and "open" not in attributes:
        return False, None
    best: dict[str, tuple[tuple, bool]] = {}
    if "hidden" in attributes:  # gives way to any rule on display
        best["display"] = (False, -1), True
    if rules:
        names = {tag, "#" + attributes.get("id", ""), *("." + c for c in attributes.get("class", "").split())}
        for name in (*names, "*"):
            for needed, prop, weight, hides in rules.get(name, ()):
                if needed <= names and (prop not in best or best[prop][0] < weight):
                    best[prop] = weight, hides
    for prop, hides, important in _declared(attributes.get("style", "")):
        if prop not in best or best[prop][0] <= (important, 1 << 30):
            best[prop] = (important, 1 << 30), hides
    return not best.get("display", (0, False))[1], best["visibility"][1] if "visibility" in best else None


def events(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """Balanced ``open``, ``close`` and ``text`` events, with implied tags supplied, and ``style`` events for sheets."""
    stack: list[str] = []
    open_now: Counter[str] = Counter()  # so that a search which must fail costs nothing, however deep the stack

    def push(tag: str) -> None:
        stack.append(tag)
        open_now[tag] += 1

    def close_to(k: int):
        while len(stack) > k:
            open_now[stack[-1]] -= 1
            yield "close", stack.pop(), {}

    def find(names: frozenset[str], stop: frozenset[str]) -> int:
        """Place of the innermost open element of ``names`` before one of ``stop``; -1 if none."""
        if not any(open_now[n] for n in names):
            return -1
        for k in range(len(stack) - 1, -1, -1):
            if stack[k] in names:
                return k
            if stack[k] in stop:
                return -1
        return -1

    def foreign() -> bool:
        return bool(open_now["svg"] or open_now["math"]) and not any(open_now[t] for t in _HTML_INSIDE)

    def opened(tag: str):
        if tag in BREAKS_OUT and foreign():
            yield from close_to(min(stack.index(t) for t in ("svg", "math") if open_now[t]))
        if tag in CLOSES and (k := find(*CLOSES[tag])) >= 0:
            yield from close_to(k)
        if tag in _CLOSES_P and (k := find(_P, _SCOPE)) >= 0:
            yield from close_to(k)
        if tag in ("td", "th") and open_now["table"] and find(_TR, _TABLE) < 0:
            push("tr")
            yield "open", "tr", {}

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            yield "text", text, {}
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                yield "open", "br", {}
            elif tag == "p" and find(_P, _SCOPE) < 0:
                yield "open", "p", {}
                yield "close", "p", {}
            else:
                k = find(frozenset([tag]), _TABLE if tag in TABLE_PARTS else frozenset() if tag == "table" else _SCOPE)
                if k >= 0:
                    yield from close_to(k)
            continue
        attributes = _attributes(m[3]) if m[3] else {}
        yield from opened(tag)
        yield "open", tag, attributes
        if tag in VOID:
            continue
        if m[3].endswith("/") and (tag in ("svg", "math") or open_now["svg"] or open_now["math"]) and not open_now["foreignobject"]:
            yield "close", tag, {}
            continue
        if tag in RAW:
            end = _ENDS[tag].search(page, at)
            if tag == "style" and not open_now["template"]:
                yield "style", page[at : end.start() if end else len(page)], attributes
            if tag == "textarea":
                yield "text", page[at : end.start() if end else len(page)], {}
            if tag == "xmp":
                yield "text", html.escape(page[at : end.start() if end else len(page)], quote=False), {}
            at = end.end() if end else len(page)
            yield "close", tag, {}
            continue
        push(tag)
    yield from close_to(0)


_P, _TR, _TABLE = frozenset(["p"]), frozenset(["tr"]), frozenset(["table"])


class _Box:
    """Lines under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # a collapsed blank is due before the next text
        self.gap = False  # a blank line is due before the next line

    def text(self, s: str) -> None:
        words = _SPACES.sub(" ", s)
        if words[:1] == " ":
            self.space = True
            words = words[1:]
        if not words:
            return
        if self.space and self.line:
            self.line.append(" ")
        self.space = words[-1] == " "
        self.line.append(words[:-1] if self.space else words)

    def kept(self, s: str) -> None:
        """Text whose white space counts."""
        first, *rest = s.expandtabs(8).split("\n")
        self.line.append(first)
        for x in rest:
            self.newline(True)
            self.line.append(x)

    def newline(self, always: bool = False) -> None:
        if self.line or always:
            self.add("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def add(self, line: str) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        self.lines.append(line)

    def block(self, spaced: bool) -> None:
        self.newline()
        self.gap = self.gap or spaced

    def done(self) -> list[str]:
        self.newline()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        start = next((k for k, x in enumerate(lines) if x), len(lines))
        return lines[start:]


Cell = tuple[list[str], int, int]  # its lines, columns and rows


def _placed(rows: list[list[Cell]]) -> Iterator[list[tuple[int, list[str], int]]]:
    """``(column, lines, columns)`` of the cells of each row; cells from rows above keep their columns taken."""
    taken: dict[int, int] = {}  # column: rows that a cell above still covers
    for row in rows:
        at, cells, more = 0, [], {}
        for lines, span, down in row:
            while at in taken:
                at += 1
            cells.append((at, lines, span))
            if down > 1:
                more |= dict.fromkeys(range(at, at + span), down - 1)
            at += span
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | more
        yield cells


def aligned(rows: list[list[Cell]]) -> list[str]:
    """Lines of a table."""
    widths: dict[int, int] = {}
    placed = list(_placed(rows))
    for row in placed:
        for at, lines, span in row:
            if span == 1:
                widths[at] = max(widths.get(at, 0), min(CELL, max(map(len, lines), default=0)))
    out = []
    for row in placed:
        for k in range(max((len(lines) for _, lines, _ in row), default=0)):
            line, end = [], 0
            for at, lines, span in row:
                line += [" " * widths.get(c, 0) for c in range(end, at)]
                width = sum(widths.get(at + i, 0) for i in range(span)) + 2 * (span - 1)
                line.append((lines[k] if k < len(lines) else "").ljust(width))
                end = at + span
            out.append("  ".join(line).rstrip())
    return out


def _number(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"-?\d{1,9}", value.strip()) else default


class _Layout:
    """Takes events, gives text."""

    def __init__(self, page: str) -> None:
        self.rules = _rules(page) if "<style" in page.lower() else {}
        self.boxes = [_Box()]
        self.tables: list[list[list[Cell]]] = []
        self.lists: list[int | None] = []  # next number, or None for marks
        self.pre = self.dark = 0  # dark: depth inside what has no box
        self.veiled = False  # visibility is hidden: there are boxes, but nothing in them
        self.svg = self.math = self.shapes = 0  # shapes: inside svg, outside its texts
        self.details: list[bool] = []
        self.undo: list = []  # what to do when each open element closes

    def open(self, tag: str, attributes: dict[str, str]) -> None:
        boxed, hides = (False, None) if self.dark or self._unseen(tag) else _shown(tag, attributes, self.rules)
        if not boxed:
            if tag not in VOID:
                self.dark += 1
                self.undo.append(self._lighter)
            return
        box = self.boxes[-1]
        if tag == "br":
            box.newline(True)
        elif tag == "hr":
            box.block(True)
            box.add("---")
            box.block(True)
        elif tag == "input" and attributes.get("type", "").lower() in _VALUES and not (self.veiled if hides is None else hides):
            box.text(attributes.get("value", ""))
        if tag in VOID:
            return
        if tag in BLOCKS:
            box.block(tag in SPACED and not (tag in ("ul", "ol") and self.lists))
        before, self.veiled = self.veiled, self.veiled if hides is None else hides
        close = self._opened(tag, attributes)
        self.undo.append(close if before == self.veiled else lambda: self._unveiled(before, close))

    def _unveiled(self, before: bool, close) -> None:
        self.veiled = before
        if close:
            close()

    def _unseen(self, tag: str) -> bool:
        return bool(self.svg) and tag in _UNSEEN_SVG or bool(self.math) and tag in _UNSEEN_MATH

    def _foreign(self, tag: str):
        """Inside svg only texts and foreign objects are seen; labels stand apart."""
        before = self.svg, self.math, self.shapes
        self.svg, self.math = self.svg + (tag == "svg"), self.math + (tag == "math")
        self.shapes = int(tag == "svg")
        self.boxes[-1].text(" ")

        def after() -> None:
            self.svg, self.math, self.shapes = before
            self.boxes[-1].text(" ")

        return after

    def _lighter(self) -> None:
        self.dark -= 1

    def _opened(self, tag: str, attributes: dict[str, str]):
        if tag in ("svg", "math") or self.svg and tag in ("text", "foreignobject"):
            return self._foreign(tag)
        if tag in ("pre", "textarea", "xmp"):
            self.pre += 1
            return lambda: self._after_pre(tag)
        if tag in ("ul", "ol", "menu", "dir"):
            self.lists.append(_number(attributes.get("start"), 1) if tag == "ol" else None)
            return self._after_list
        if tag == "li":
            return self._item(attributes)
        if tag == "table":
            self.tables.append([])
            return self._after_table
        if tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.boxes.append(_Box())
            span = min(1000, max(1, _number(attributes.get("colspan"), 1)))
            down = _number(attributes.get("rowspan"), 1) or MOST_ROWS
            return lambda: self._after_cell(span, max(1, min(MOST_ROWS, down)))
        elif tag == "details" and "open" not in attributes:
            return self._closed_details()
        elif tag == "summary" and self.details and self.details[-1]:
            return self._summary()
        elif tag == "q":
            self.boxes[-1].text('"')
            return lambda: self.boxes[-1].text('"')
        if tag in BLOCKS:
            spaced = tag in SPACED
            return lambda: self.boxes[-1].block(spaced)
        return None

    def _after_pre(self, tag: str) -> None:
        self.pre -= 1
        if tag != "textarea":
            self.boxes[-1].block(True)

    def _after_list(self) -> None:
        self.lists.pop()
        self.boxes[-1].block(not self.lists)

    def _item(self, attributes: dict[str, str]):
        mark = "- "
        if self.lists and self.lists[-1] is not None:
            number = _number(attributes.get("value"), self.lists[-1])
            self.lists[-1] = number + 1
            mark = f"{number}. "
        self.boxes.append(_Box())
        indent = " " * len(mark) if len(self.lists) <= INDENTS else ""

        def after() -> None:
            lines = self.boxes.pop().done()
            for k, line in enumerate(lines):
                self.boxes[-1].add((indent if k else mark) + line if line else "")

        return after

    def _after_cell(self, span: int, down: int) -> None:
        self.tables[-1][-1].append((self.boxes.pop().done(), span, down))

    def _after_table(self) -> None:
        box = self.boxes[-1]
        box.newline()
        for line in aligned(self.tables.pop()):
            box.add(line)
        box.block(True)

    def _closed_details(self):
        """Its text goes to a box that is dropped; the summary's goes to the box before."""
        self.details.append(True)
        self.boxes.append(_Box())

        def after() -> None:
            self.details.pop()
            self.boxes.pop()

        return after

    def _summary(self):
        inner = self.boxes.pop()
        self.details[-1] = False

        def after() -> None:
            self.boxes[-1].block(False)
            self.boxes.append(inner)

        return after

    def close(self) -> None:
        if action := self.undo.pop():
            action()

    def text(self, s: str) -> None:
        if self.dark or self.shapes or self.veiled:
            return
        s = html.unescape(s) if "&" in s else s
        if self.pre:
            self.boxes[-1].kept(s)
        elif not (self.tables and len(self.boxes) == 1 and s.isspace()):
            self.boxes[-1].text(s)


def render(page: str) -> str:
    """The visible text of a page."""
    layout = _Layout(page)
    for kind, value, attributes in events(page):
        if kind == "text":
            layout.text(value)
        elif kind == "style":
            continue
        elif kind == "open":
            layout.open(value, attributes)
            if value == "br":
                continue
        else:
            layout.close()
    return "\n".join(layout.boxes[0].done())


@F.pandas_udf(T.StringType())
def _rendered(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        out, size = [], 0
        for page in pages:
            out.append(None if page is None else render(page))
            size += len(page or "")
            if size >= OUTPUT_CHARS:
                yield pd.Series(out, dtype=object)
                out, size = [], 0
        if out:
            yield pd.Series(out, dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """All columns but ``html``, and ``text``."""
    others = [F.col(f"`{c}`") for c in pages.columns if c not in ("html", "text")]
    return pages.select(*others, _rendered("html").alias("text"))
