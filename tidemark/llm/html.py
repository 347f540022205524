"""Operator 7: the visible text of HTML pages as a reader sees it laid out.

A small tree builder closes what HTML lets authors leave open (list items, paragraphs, table parts, options, terms) and
ignores end tags that match nothing. What no browser shows (scripts, styles, templates, ``hidden``, ``display:none``,
closed ``details`` but for their summary, and the like) is dropped with all that it holds; under ``visibility:hidden``
elements may show again. Both come from ``style`` attributes and from the rules of ``<style>`` whose selectors are made of
tags, classes and ids, alone, together, or within one another (``p.a.b``, ``.a .b``, ``div > p``); rules with other selectors
are passed over. MathML shows, of SVG the ``text`` elements; ``aria-hidden`` hides nothing.

Text is laid out by block: paragraphs and headings stand apart by a blank line, other blocks by a line end, list items
carry a bullet or number (``start``, ``value``, ``reversed``) with indent, ``pre`` keeps its white space. The cells of a
table stand in columns, ``colspan`` and ``rowspan`` honoured. A cell keeps its own lines, with the blocks, lists and ``pre`` in
it, and a row is as high as its highest cell. Lines of a cell that has another one behind it are broken at white space
beyond ``MEASURE`` characters, as a window breaks them, so a column is as wide as its longest line; nothing is left out.

Tree and layout work with stacks of their own, so nesting has no limit; lists indent down to the depth at which browsers stop to
nest elements, too (``DEEP``).

Defined cases: a null or empty page gives the empty text; unclosed comments, tags, quotes and elements end with the
page; ``<!-->`` is a comment; quotes only count where a value starts; repeated pages are told alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a line of a cell, and the depth that browsers nest elements to.
MEASURE, DEEP = 100, 512
#: Element classes of HTML, and its limits of spans.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "head script style template noscript title meta link iframe noembed noframes object canvas audio video datalist input annotation "
    "annotation-xml".split()
)
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
BLOCK = APART | frozenset(
    "html body div section article aside nav header footer main address li dt dd tr caption thead tbody tfoot fieldset form "
    "figcaption details summary center dialog hgroup menu search legend optgroup option".split()
)
#: An opening tag closes these elements if they are open within the scope named by STOPS.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th", "caption", "colgroup"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th", "caption", "colgroup"}, "tbody": {"tr", "td", "th", "thead", "tbody", "caption", "colgroup"},
    "tfoot": {"tr", "td", "th", "thead", "tbody", "caption", "colgroup"}, "body": {"head"},
}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"}}
_TABLE = {"table"}

MOST_COLUMNS, MOST_ROWS = 1000, 65534

_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_AT_RULE = re.compile(r"@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\})")
_COMPOUND = re.compile(r"([a-z][a-z0-9-]*|\*)?((?:[.#][\w-]+)*)", re.I)
_COMBINED = re.compile(r"\s*(>)\s*|\s+")
_DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_NUMBER = re.compile(r"\s*(-?[0-9]{1,9})")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "raw", "children")

    def __init__(self, tag: str, raw: str = ""):
        self.tag, self.raw, self.children = tag, raw, []

    def attributes(self) -> dict[str, str]:
        out: dict[str, str] = {}
        if self.raw:
            for m in _ATTRIBUTE.finditer(self.raw):
                out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        return out


def _declared(style: str) -> dict[str, tuple[bool, str]]:
    """Display and visibility of a list of declarations, each with whether it is important; the last one counts."""
    out: dict[str, tuple[bool, str]] = {}
    for name, value, important in _DECLARATION.findall(style):
        if bool(important) >= out.get(name.lower(), (False, ""))[0]:
            out[name.lower()] = bool(important), value.lower()
    return out


class Place:
    """An open element as selectors see it, and what it stands in."""

    __slots__ = ("tag", "marks", "parent")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Place | None):
        self.tag, self.parent = tag, parent
        self.marks = {f".{c}" for c in attributes.get("class", "").split()}
        if "id" in attributes:
            self.marks.add(f"#{attributes['id']}")

    def fits(self, tag: str, marks: frozenset[str]) -> bool:
        return tag in ("*", self.tag) and marks <= self.marks


def _selector(text: str) -> list[tuple[str, frozenset[str], bool]] | None:
    """Compounds from the last to the first: tag, classes and ids, and whether its parent (else any outer element) must fit the next."""
    parts = _COMBINED.split(text.strip())
    out = []
    for k in range(len(parts) - 1, -1, -2):
        m = _COMPOUND.fullmatch(parts[k])
        if not m or not m[0]:
            return None
        marks = frozenset(re.findall(r"[.#][\w-]+", m[2]))
        out.append(((m[1] or "*").lower(), marks, k > 0 and parts[k - 1] == ">"))
    return out


def _within(place: Place, selector: list[tuple[str, frozenset[str], bool]], k: int = 0) -> bool:
    """Whether ``place``, which fits the k-th compound, stands where the later ones want it."""
    if k + 1 == len(selector):
        return True
    tag, marks, _ = selector[k + 1]
    outer = place.parent
    while outer is not None:
        if outer.fits(tag, marks) and _within(outer, selector, k + 1):
            return True
        if selector[k][2]:
            return False
        outer = outer.parent
    return False


class Styles:
    """Rules for display and visibility, by an id, a class or the tag of the element that they are for."""

    def __init__(self):
        self.rules: dict[str, list[tuple[tuple, list, dict[str, tuple[bool, str]]]]] = {}
        self.count = 0

    def add(self, sheet: str) -> None:
        for selectors, body in _RULE.findall(_AT_RULE.sub("", _COMMENT.sub("", sheet))):
            declared = _declared(body)
            if not declared:
                continue
            for selector in map(_selector, selectors.split(",")):
                if selector:
                    self.count += 1
                    tag, marks, _ = selector[0]
                    every = [x for _, own, _ in selector for x in own]
                    ids = sum(x[0] == "#" for x in every)
                    weight = (0, ids, len(every) - ids, sum(t != "*" for t, _, _ in selector), self.count)
                    self.rules.setdefault(min(marks, default=tag), []).append((weight, selector, declared))

    def of(self, place: Place, attributes: dict[str, str]) -> dict[str, str]:
        """The display and visibility that win, as far as any is set."""
        found = []
        if self.rules:
            for key in {"*", place.tag, *place.marks}:
                found += [(w, d) for w, s, d in self.rules.get(key, ()) if place.fits(s[0][0], s[0][1]) and _within(place, s)]
        if "style" in attributes:
            found.append(((1,), _declared(_COMMENT.sub("", attributes["style"]))))
        best: dict[str, tuple[tuple, str]] = {}
        for weight, declared in found:
            for name, (important, value) in declared.items():
                best[name] = max(best.get(name, ((False, ()), "")), ((important, weight), value))
        return {name: value for name, (_, value) in best.items()}


def tree(html: str) -> tuple[Node, Styles]:
    root, styles = Node("#root"), Styles()
    stack, held = [root], Counter()
    at, n = 0, len(html)

    def close(names, stops) -> bool:
        if not any(held[x] for x in names):
            return False
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                held.subtract(x.tag for x in stack[k:])
                del stack[k:]
                return True
            if stack[k].tag in stops:
                return False
        return False

    while at < n:
        m = _MARKUP.search(html, at)
        if m is None:
            stack[-1].children.append(unescape(html[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not held["p"]:
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            else:
                close({tag}, _TABLE - {tag} if tag not in ("body", "html", "div", "form") else set())
            continue
        if tag in BLOCK and tag not in ("option", "optgroup"):
            close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in CLOSES:
            while close(CLOSES[tag], STOPS.get(tag, _TABLE)):
                pass
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            stop = end.start() if end else n
            if tag == "textarea":
                node.children.append(unescape(html[at:stop]))
            elif tag == "style":
                styles.add(html[at:stop])
            at = end.end() if end else n
            continue
        stack.append(node)
        held[tag] += 1
    return root, styles


class Layout:
    """Lines of text; ``gap`` is how many line ends must stand before what comes next."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = 0
        self.space = False

    def text(self, text: str) -> None:
        words = _SPACE.split(text)
        for k, word in enumerate(words):
            if k:
                self.space = True
            if word:
                if self.space and self.parts:
                    self.parts.append(" ")
                self.space = False
                self.parts.append(word)

    def end(self, blank: bool = False) -> None:
        if self.parts:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            self.lines.append("".join(self.parts).rstrip())
            self.gap = 0
        self.parts, self.space = [], False
        self.gap = max(self.gap, 2 if blank else 1)

    def line_break(self) -> None:
        if self.parts:
            self.end()
            self.gap = 1

    def put(self, lines: list[str], blank: bool) -> None:
        self.end(blank)
        if lines:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            self.lines += lines
            self.gap = 0
        self.end(blank)

    def told(self) -> list[str]:
        self.end()
        return self.lines


class Plain(Layout):
    """Text as it stands."""

    def text(self, text: str) -> None:
        self.parts.append(text)

    def end(self, blank: bool = False) -> None:
        if self.parts and not self.parts[-1].endswith("\n"):
            self.parts.append("\n")

    def line_break(self) -> None:
        self.parts.append("\n")

    def put(self, lines: list[str], blank: bool) -> None:
        self.end()
        self.parts += [x + "\n" for x in lines]

    def told(self) -> list[str]:
        text = "".join(self.parts).strip("\n")
        return text.split("\n") if text else []


def _broken(line: str) -> list[str]:
    """Lines of up to ``MEASURE`` characters, broken at white space where there is some; the indent goes on."""
    if len(line) <= MEASURE:
        return [line]
    indent = " " * min(len(line) - len(line.lstrip(" ")), MEASURE // 2)
    out = []
    while len(line) > MEASURE:
        at = line.rfind(" ", len(indent) + 1, MEASURE + 1)
        at = MEASURE if at < 0 else at
        out.append(line[:at].rstrip(" "))
        line = indent + line[at:].lstrip(" ")
    return out + [line] * bool(line.strip())


class Table(Layout):
    """Rows of cells; what stands between the parts (captions, stray text) comes before them, as browsers put it."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.taken: dict[int, int] = {}  # column -> the first row that is free again

    def row(self) -> None:
        self.rows.append([])
        self.column = 0

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        if not self.rows:
            self.row()
        number = len(self.rows) - 1
        while self.taken.get(self.column, 0) > number:
            self.column += 1
        self.rows[-1].append((self.column, columns, lines))
        for c in range(self.column, self.column + columns):
            self.taken[c] = number + rows
        self.column += columns

    def told(self) -> list[str]:
        widths: Counter = Counter()
        later = []  # spans, by their last column
        for row in self.rows:
            # nothing stands behind the last cell that holds anything
            last = max((k for k, (_, _, lines) in enumerate(row) if lines), default=0)
            row[:last] = [(column, columns, [y for x in lines for y in _broken(x)]) for column, columns, lines in row[:last]]
            for column, columns, lines in row[:last]:
                need = max(map(len, lines), default=0)
                if columns == 1:
                    widths[column] = max(widths[column], need)
                else:
                    later.append((column + columns - 1, column, need))
        for last, column, need in sorted(later):
            widths[last] += max(0, need - 2 * (last - column) - sum(widths[c] for c in range(column, last + 1)))
        ends = max((c + n for row in self.rows for c, n, _ in row), default=0)
        starts, at = [], 0
        for c in range(ends + 1):
            starts.append(at)
            at += widths[c] + 2
        out = []
        for row in self.rows:
            for k in range(max((len(lines) for _, _, lines in row), default=0)):
                line = ""
                for column, _, lines in row:
                    if k < len(lines) and lines[k]:
                        line = line.ljust(starts[column]) + lines[k]
                out.append(line)
        return [x for x in super().told() if x] + out


def _whole(value: str | None, default: int, low: int, high: int) -> int:
    m = _NUMBER.match(value or "")
    return max(low, min(high, int(m[1]))) if m else default


def render(root: Node, styles: Styles) -> list[str]:
    """Lines of the page. One entry of ``work`` per open element: its children to come, how its text shows, what to do at its end."""
    frames: list[Layout] = [Layout()]
    # whether text shows, within svg (but for its text), the list's numbers ([next, step] or None), depth of lists
    work = [(iter(root.children), (True, False, None, 0), None, None)]
    while work:
        children, (shown, drawn, numbers, deep), outer, finish = work[-1]
        x = next(children, None)
        if x is None:
            work.pop()
            if finish:
                finish()
            continue
        out = frames[-1]
        if isinstance(x, str):
            if shown and not drawn:
                out.text(x)
            continue
        tag, attributes = x.tag, x.attributes()
        place = Place(tag, attributes, outer)
        style = styles.of(place, attributes)
        if tag in UNSEEN or style.get("display") == "none" or "hidden" in attributes and "display" not in style:
            continue
        if tag == "dialog" and "open" not in attributes and "display" not in style:
            continue
        if "visibility" in style:
            shown = style["visibility"] not in ("hidden", "collapse")
        inner, finish = iter(x.children), None
        if tag == "svg":
            drawn = True
        elif drawn and tag == "text":
            drawn, out.space = False, True
        elif tag == "br":
            if shown:
                out.line_break()
        elif tag == "hr":
            out.end(True)
        elif tag == "img":
            if shown:
                out.text(attributes.get("alt", ""))
        elif tag == "details" and "open" not in attributes:
            inner = iter([y for y in x.children if isinstance(y, Node) and y.tag == "summary"][:1])
            finish = _block(out, False)
        elif tag == "pre":
            frames.append(Plain())
            finish = _put(frames, True)
        elif tag == "table":
            frames.append(Table())
            finish = _put(frames, True)
        elif tag == "tr" and isinstance(out, Table):
            out.end()
            out.row()
        elif tag in ("td", "th") and isinstance(out, Table):
            rows = _whole(attributes.get("rowspan"), 1, 0, MOST_ROWS) or MOST_ROWS  # none: to the end
            frames.append(Layout())
            finish = _cell(frames, _whole(attributes.get("colspan"), 1, 1, MOST_COLUMNS), rows)
        elif tag == "li":
            mark = "- "
            if numbers:
                numbers[0] = _whole(attributes.get("value"), numbers[0], -(10**9), 10**9)
                mark = f"{numbers[0]}. "
                numbers[0] += numbers[1]
            frames.append(Layout())
            finish = _item(frames, mark, deep <= DEEP)
        elif tag in BLOCK:
            if tag in ("ul", "ol", "menu"):
                numbers, deep = None, deep + 1
            if tag == "ol":
                back = "reversed" in attributes
                first = sum(isinstance(y, Node) and y.tag == "li" for y in x.children) if back else 1
                numbers = [_whole(attributes.get("start"), first, -(10**9), 10**9), -1 if back else 1]
            # lists within lists have no margin
            finish = _block(out, tag in APART and not (tag in ("ul", "ol") and deep > 1))
        elif tag in ("td", "th"):
            out.space = True
        work.append((inner, (shown, drawn, numbers, deep), place, finish))
    return frames[0].told()


def _block(out: Layout, blank: bool):
    out.end(blank)
    return lambda: out.end(blank)


def _put(frames: list[Layout], blank: bool):
    def finish() -> None:
        lines = frames.pop().told()
        frames[-1].put(lines, blank)

    return finish


def _trimmed(lines: list[str]) -> list[str]:
    """Without empty lines at either end."""
    full = [k for k, x in enumerate(lines) if x]
    return lines[full[0] : full[-1] + 1] if full else []


def _cell(frames: list[Layout], columns: int, rows: int):
    def finish() -> None:
        lines = _trimmed(frames.pop().told())
        frames[-1].cell(lines, columns, rows)

    return finish


def _item(frames: list[Layout], mark: str, indent: bool):
    def finish() -> None:
        lines = _trimmed(frames.pop().told())
        inset = " " * len(mark) if indent else ""
        frames[-1].put([mark + lines[0], *(inset + x if x else x for x in lines[1:])] if lines else [], False)

    return finish


def visible_text(html: str | None) -> str:
    return "\n".join(render(*tree(html))) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, n_lines, n_chars, text: one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [visible_text(h) for h in b.column("html").to_pylist()]
            counts = [[t.count("\n") + 1 if t else 0 for t in texts], list(map(len, texts))]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(texts, pa.string())],
                names=["page_id", "n_lines", "n_chars", "text"],
            )

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, n_lines long, n_chars long, text string"
    )
