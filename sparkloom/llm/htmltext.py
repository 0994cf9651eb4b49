"""HTML extraction by layout: a tree builder with implied tags and visibility rules, then rendering.

The tree builder opens and closes tags as HTML implies them (paragraphs end before blocks, list items, table
cells and rows end before the next, stray end tags are ignored, open elements end with their parent). Rendering emits
all visible text: blocks on lines of their own, an empty line around paragraphs and headings, list marks with
indentation, cells aligned in their columns (colspan and rowspan included), and preformatted text as it is.

Not displayed are script, style, head and the like, the hidden attribute, display:none and hidden inputs, with all
they hold. visibility:hidden and collapse hide text until an element inside is visible again. Of svg the text elements
are shown, of math all but annotations. What browsers show only where they can't do something (noscript, the content of
object, audio, video, canvas and iframe) is left out by choice.

A tag ends at the first ``>`` outside its quoted values; a tag that never ends takes the rest of the page with it, as in
browsers, and a quote that never closes is an ordinary character. Every character is looked at a bounded number of times, so broken
pages take time in proportion to their length. Null and empty pages give an empty text. Text without any tag is one
paragraph. Pages are handled one by one, whole; nesting beyond MAX_DEPTH is flattened into its parent, but what is not
displayed stays so. Repeated rows give equal values, whatever other columns hold; empty tables give empty results.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, small_batches, text_slices

MAX_DEPTH = 300
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
GONE = frozenset("head script style template noscript title meta link base iframe noembed noframes object datalist canvas audio video annotation annotation-xml".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre section summary table ul tr caption thead tbody tfoot td th hr".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table figure dl ul ol hr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
FOREIGN = frozenset({"svg", "math"})
#: Largest spans that HTML allows.
COLSPAN, ROWSPAN = 1_000, 65_534
#: An opening tag ends these open elements, as far as the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Elements through which an end tag or an implied end does not reach.
WALLS = frozenset({"table", "td", "th", "caption", "template", "html", "body"})
NAME = re.compile(r"[^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
SIGHT = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
SPACE = " \t\n\r\f"


class Node:
    """An element; ``hidden``: not displayed at all; ``sight``: whether its text is visible, None as its parent's."""

    __slots__ = ("attrs", "children", "hidden", "sight", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.children, self.attrs = tag, [], attrs
        self.hidden, self.sight = tag in GONE, None
        low = attrs.lower()
        if not self.hidden and ("hidden" in low or "style" in low):
            a = attributes(attrs)
            style = a.get("style", "")
            self.hidden = "hidden" in a or tag == "input" and a.get("type", "").lower() == "hidden" or bool(UNSEEN.search(style))
            seen = SIGHT.findall(style)
            self.sight = seen[-1].lower() == "visible" if seen else None


def attributes(raw: str) -> dict[str, str]:
    """Names in lower case; of several with one name the first counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        value = m.group(2) or ""
        out.setdefault(m.group(1).lower(), html.unescape(value[1:-1] if value[:1] in "\"'" and value else value))
    return out


def span_of(node: Node, name: str, most: int) -> int:
    value = attributes(node.attrs).get(name, "1").strip() if node.attrs else "1"
    return max(1, min(int(value), most)) if value.isascii() and value.isdigit() and len(value) < 10 else 1


class Tokens:
    """The tags and texts of a page: (kind, name or text, attributes), with kinds ``text``, ``open`` and ``close``."""

    def __init__(self, source: str):
        self.source, self.at = source, 0
        self.unclosed: set[str] = set()  # quotes that do not occur any more

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose attributes start at ``at``, -1 without one."""
        source = self.source
        while m := STOP.search(source, at):
            c, at = m.group(), m.end()
            if c == ">":
                return m.start()
            # A quote opens a value only behind an equals sign.
            if c not in self.unclosed and source[max(0, at - 65) : at - 1].rstrip(SPACE).endswith("="):
                to = source.find(c, at)
                if to < 0:
                    self.unclosed.add(c)
                else:
                    at = to + 1
        return -1

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        source, n = self.source, len(self.source)
        text = 0  # where the text that has not been given yet starts
        while self.at < n:
            at = source.find("<", self.at)
            if at < 0 or at + 1 >= n:
                break
            c = source[at + 1]
            name = at + 2 if c == "/" else at + 1
            letter = source[name : name + 1]
            if not (letter.isascii() and letter.isalpha()) and c not in "!?/":
                self.at = at + 1
                continue
            if at > text:
                yield "text", source[text:at], ""
            if source.startswith("<!--", at):
                to = source.find("-->", at + 4)
                to = n if to < 0 else to + 3
            elif c in "!?" or not (letter.isascii() and letter.isalpha()):
                to = source.find(">", at)
                to = n if to < 0 else to + 1
            else:
                end = NAME.match(source, name).end()
                to = self.tag_end(end)
                if to < 0:
                    self.at = text = n
                    return
                self.at = text = to + 1
                yield "close" if c == "/" else "open", source[name:end].lower(), source[end:to]
                text = self.at  # raw text may have been taken
                continue
            self.at = text = to
        if text < n:
            yield "text", source[text:], ""

    def raw(self, tag: str) -> str:
        """What stands before the end tag of ``tag``, which is passed."""
        source, n = self.source, len(self.source)
        stop = re.compile(f"</{tag}(?=[\\s/>]|$)", re.I).search(source, self.at)
        to = stop.start() if stop else n
        own, after = source[self.at : to], source.find(">", to) if stop else -1
        self.at = after + 1 if after >= 0 else n
        return own


def build(source: str) -> Node:
    """Tree of ``source``, with the tags that it leaves out."""
    root = Node("html")
    stack, tokens = [root], Tokens(source)

    def close(names, walls) -> None:
        at = len(stack)
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                at = i
            elif stack[i].tag in walls:
                break
        del stack[at:]

    # Beyond MAX_DEPTH elements are not opened; after one that is not displayed all is passed up to its own end tag.
    dead, depth = "", 0
    for kind, tag, raw in tokens:
        if depth:
            if tag == dead and kind != "text":
                depth += 1 if kind == "open" else -1
        elif kind == "text":
            if stack[-1].tag not in ("table", "tr", "tbody", "thead", "tfoot") or tag.strip(SPACE):
                stack[-1].children.append(html.unescape(tag) if "&" in tag else tag)
        elif kind == "close":
            if tag == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag not in ("html", "body"):
                walls = WALLS - {tag} if tag in ("table", "td", "th", "caption", "template") else WALLS
                if tag in ("tr", "thead", "tbody", "tfoot"):
                    walls = frozenset({"table", "template", "body"})
                elif tag == "table":
                    walls = frozenset({"template", "body"})
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag in walls:
                        break
        elif tag != "html":
            if tag in BLOCKS and any(x.tag == "p" for x in stack[-4:]):
                close({"p"}, WALLS | {"button", "object"})
            if tag in HEADING and stack[-1].tag in HEADING:
                stack.pop()
            if tag in ENDS:
                close(*ENDS[tag])
            if tag in ("td", "th") and stack[-1].tag != "tr" and any(x.tag == "table" for x in stack):
                stack.append(_put(stack, Node("tr")))
            if tag not in GONE and stack[-1].tag == "head":
                stack.pop()
            node = _put(stack, Node(tag, raw))
            if tag in RAW:
                own = tokens.raw(tag)
                if not node.hidden:
                    node.children.append(html.unescape(own))
            elif tag not in VOID and not (raw.endswith("/") and (tag in FOREIGN or any(x.tag in FOREIGN for x in stack))):
                if len(stack) < MAX_DEPTH:
                    stack.append(node)
                elif node.hidden or node.sight is False:
                    node.hidden, dead, depth = True, tag, 1
    return root


def _put(stack: list[Node], node: Node) -> Node:
    stack[-1].children.append(node)
    return node


class _Lines:
    """Collects lines; runs of white space are one space, and empty lines are asked for, not doubled."""

    def __init__(self):
        self.done: list[str] = []
        self.now: list[str] = []
        self.blank = False
        self.lead = ""

    def text(self, s: str) -> None:
        if self.now and s[0] in SPACE and not self.now[-1].endswith(" "):
            self.now.append(" ")
        words = s.split(None) if s.isascii() else re.split("[ \t\n\r\f]+", s.strip(SPACE))
        body = " ".join(words)
        if body:
            self.now.append(body)
            if s[-1] in SPACE:
                self.now.append(" ")

    def line(self, force: bool = False) -> None:
        body = "".join(self.now).rstrip(" ")
        if body or force:
            if self.blank and self.done:
                self.done.append("")
            self.blank = False
            self.done.append((self.lead + body).rstrip(" "))
            if self.lead.strip():
                self.lead = " " * len(self.lead)
        self.now = []

    def space(self) -> None:
        self.line()
        self.blank = True


def _render(node: Node, out: _Lines, seen: bool = True, drawing: bool = False) -> None:
    """``seen``: text is visible; ``drawing``: inside svg, where only text elements show theirs."""
    for x in node.children:
        if x.__class__ is str:
            if not seen or drawing:
                continue
            if x.strip(SPACE):
                out.text(x)
            elif out.now and not out.now[-1].endswith(" "):
                out.now.append(" ")
            continue
        if x.hidden:
            continue
        tag, own = x.tag, seen if x.sight is None else x.sight
        if drawing or tag == "svg":
            inside = tag not in ("text", "foreignobject")
            for again in (True, False):
                if not inside and out.now and not out.now[-1].endswith(" "):
                    out.now.append(" ")
                if again:
                    _render(x, out, own, inside)
        elif tag == "br":
            out.line(force=own)
        elif tag == "img":
            alt = attributes(x.attrs).get("alt", "")
            if own and alt.strip(SPACE):
                out.text(alt)
        elif tag == "input":
            value = attributes(x.attrs)
            if own and value.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email") and value.get("value", "").strip(SPACE):
                out.text(value["value"])
        elif tag == "hr":
            out.space()
        elif tag == "pre":
            out.space()
            text = _plain(x, own)
            if text.strip():
                for s in text.strip("\n").split("\n"):
                    out.now = [s]
                    out.line(force=True)
            out.space()
        elif tag == "table":
            out.space()
            for s in _table(x, own):
                out.now = [s]
                out.line()
            out.space()
        elif tag in ("ul", "ol", "menu"):
            inner = node.tag == "li"
            out.line() if inner else out.space()
            _list(x, out, own)
            out.line() if inner else out.space()
        elif tag in BLOCKS:
            out.space() if tag in SPACED else out.line()
            lead = out.lead
            if tag in ("blockquote", "dd"):
                out.lead = lead + "  "
            _render(x, out, own)
            if tag in ("blockquote", "dd"):
                out.line()
                out.lead = lead
            out.space() if tag in SPACED else out.line()
        else:
            _render(x, out, own)


def _list(node: Node, out: _Lines, seen: bool) -> None:
    try:
        number = int(attributes(node.attrs).get("start", "1")) if node.tag == "ol" and node.attrs else 1
    except ValueError:
        number = 1
    lead = out.lead if not out.lead.strip() else " " * len(out.lead)
    for x in node.children:
        if x.__class__ is str:
            if seen and x.strip(SPACE):
                out.text(x)
            continue
        if x.hidden:
            continue
        if x.tag == "li":
            out.line()
            out.lead = lead + (f"{number}. " if node.tag == "ol" else "- ")
            number += 1
            _render(x, out, seen if x.sight is None else x.sight)
            out.line()
            out.lead = lead
        else:
            holder = Node("div")
            holder.children.append(x)
            _render(holder, out, seen)
    out.lead = lead


def _plain(node: Node, seen: bool) -> str:
    parts = []
    for x in node.children:
        if x.__class__ is str:
            parts.append(x if seen else "")
        elif x.tag == "br":
            parts.append("\n")
        elif not x.hidden:
            parts.append(_plain(x, seen if x.sight is None else x.sight))
    return "".join(parts)


def _rows(node: Node, seen: bool) -> Iterator[tuple[Node, bool]]:
    """Rows and captions of a table, with whether their text is visible."""
    for x in node.children:
        if x.__class__ is str:
            if x.strip(SPACE):
                row = Node("caption")
                row.children.append(x)
                yield row, seen
        elif not x.hidden:
            own = seen if x.sight is None else x.sight
            if x.tag in ("tr", "caption"):
                yield x, own
            elif x.tag in ("thead", "tbody", "tfoot", "colgroup"):
                yield from _rows(x, own)
            else:
                row = Node("tr")
                row.children.append(x)
                yield row, seen


def _inside(node: Node, seen: bool) -> list[str]:
    out = _Lines()
    _render(node, out, seen)
    out.line()
    return [s for s in out.done if s]


def _table(node: Node, seen: bool) -> list[str]:
    """Lines of a table: cells side by side, each in its column, which is as wide as its widest cell; columns without text take no room."""
    grid: list[list[str] | dict[int, list[str]]] = []
    open_: list[tuple[int, int, int]] = []  # (first column, end, end row) of what cells above still span
    for number, (row, shown) in enumerate(_rows(node, seen)):
        if row.tag == "caption":
            grid.append(_inside(row, shown))
            continue
        cells: dict[int, list[str]] = {}
        open_ = [x for x in open_ if x[2] > number]
        column, beside, spans = 0, 0, []
        for x in row.children:
            if x.__class__ is str:
                if not (shown and x.strip(SPACE)):
                    continue
                lines, wide, tall = [" ".join(x.split())], 1, 1
            elif x.hidden:
                continue
            else:
                lines, wide, tall = _inside(x, shown if x.sight is None else x.sight), span_of(x, "colspan", COLSPAN), span_of(x, "rowspan", ROWSPAN)
            while beside < len(open_) and open_[beside][0] <= column:
                column = max(column, open_[beside][1])
                beside += 1
            if lines:
                cells[column] = lines
            if tall > 1:
                spans.append((column, column + wide, number + tall))
            column += wide
        if spans:
            merged: list[tuple[int, int, int]] = []
            for x in sorted(open_ + spans):
                if merged and merged[-1][1] == x[0] and merged[-1][2] == x[2]:
                    merged[-1] = (merged[-1][0], *x[1:])
                else:
                    merged.append(x)
            open_ = merged
        grid.append(cells)
    width: dict[int, int] = {}
    for r in grid:
        if isinstance(r, dict):
            for i, c in r.items():
                width[i] = max([width.get(i, 0), *map(len, c)])
    columns = sorted(width)
    out: list[str] = []
    for r in grid:
        if isinstance(r, list):
            out += r
            continue
        last = max(r, default=-1)
        for k in range(max([0, *map(len, r.values())])):
            out.append("  ".join((r[i][k] if i in r and k < len(r[i]) else "").ljust(width[i]) for i in columns if i <= last).rstrip(" "))
    return out


def render(source: str) -> str:
    """All visible text of an HTML page."""
    out = _Lines()
    _render(build(source), out)
    out.line()
    return "\n".join(out.done)


def visible_text(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_chars) of every page."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "html"):
                texts = [render(x.decode("utf-8", "replace")) for x in as_bytes(part.column("html"))]
                yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "text", "n_chars"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, text string, n_chars long")
