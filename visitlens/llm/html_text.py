"""Visible text of web pages, laid out as a reader sees it.

A tree is built with the end tags that HTML lets authors leave out, and rendered block by block: paragraphs apart,
list items marked and indented, table cells in columns of equal width, preformatted text as it is. What a browser
doesn't show (scripts, styles, hidden elements, the head) is left out; nothing else is.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Collection, Iterator
from heapq import merge
from html import unescape
from itertools import accumulate
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of elements by their HTML meaning.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("head script style template noscript title meta link iframe noembed noframes datalist object audio video canvas".split())
#: Unseen inside an element of the key's kind.
UNSEEN_IN = {"svg": set("title desc defs metadata".split()), "math": {"annotation", "annotation-xml"}}
APART = set("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset address form xmp".split())
BLOCK = APART | set(
    "html body div section article aside header footer main nav li dt dd tr td th thead tbody tfoot caption figcaption details summary option legend center dir menu search hgroup".split()
)
#: An element of the key's kind that is still open ends when one of these starts, unless one of the last set stands between.
ENDS = {
    "p": (APART | set("div section article aside header footer main nav details center menu dir".split()), {"button", "td", "th", "table", "object"}),
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": (set("td th tr tbody thead tfoot".split()), {"table"}),
    "th": (set("td th tr tbody thead tfoot".split()), {"table"}),
    "tr": (set("tr tbody thead tfoot".split()), {"table"}),
    "thead": (set("tbody tfoot thead".split()), {"table"}),
    "tbody": (set("tbody tfoot thead".split()), {"table"}),
    "tfoot": (set("tbody tfoot thead".split()), {"table"}),
    "caption": (set("tr td th tbody thead tfoot".split()), {"table"}),
    "option": ({"option", "optgroup"}, {"select"}),
    "head": ({"body"}, set()),
}
#: What may stand in a head; any other element, and any text, ends it.
IN_HEAD = set("title meta link base script style noscript template".split())
#: Elements nested deeper hang on the element at this depth.
DEPTH = 150

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
#: One attribute: name, and value in double quotes, in single quotes or without. It stops at the > or at a quote that never closes.
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(=?[^\s/>=]++|=)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)?))?)?""")
#: At-rules of a style sheet, and selectors of a tag, classes and an id.
_AT_RULE = re.compile(r"@[^{};]*+(?:;|\{(?:[^{}]*+\{[^{}]*+\})*+[^{}]*+\})")
_SIMPLE = re.compile(r"\s*([a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)\s*")
_BLANKS = re.compile(r"[ \t\n\f\r]+")


def number(attributes: dict[str, str], name: str, least: int = 1, most: int = 1000) -> int:
    found = re.match(r"\s*(\d{1,6})", attributes.get(name, ""))
    return min(most, max(least, int(found[1]))) if found else least


def parsed(text: str) -> dict[str, str]:
    """Names and values of a tag's attributes; the first of a name counts."""
    out: dict[str, str] = {}
    for found in _ATTRIBUTE.finditer(text):
        if found[1]:
            out.setdefault(found[1].lower(), unescape(found[2] or found[3] or found[4] or ""))
    return out


def hidden_by(style: str) -> bool:
    """Whether the declarations of a style attribute hide its element; the last of a property counts, important ones first."""
    found: dict[str, tuple[bool, str]] = {}
    for part in re.sub(r"/\*.*?\*/", "", style, flags=re.S).lower().split(";"):
        name, _, value = part.partition(":")
        value, mark, _ = value.partition("!")
        name, important = name.strip(), bool(mark)
        if important >= found.get(name, (False, ""))[0]:
            found[name] = important, value.strip()
    return found.get("display", (0, ""))[1] == "none" or found.get("visibility", (0, ""))[1] in ("hidden", "collapse")


class Node:
    __slots__ = ("tag", "attributes", "children", "off")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes, self.children = tag, parsed(attributes) if attributes else {}, []
        self.off = False


def tag_end(html: str, at: int) -> int:
    """Place of the > that ends a tag, past quoted values; one whose quote never closes, or
    that has no such >, ends at its first."""
    first = html.find(">", at)
    if first < 0 or "=" not in html[at:first]:
        return first
    while at < len(html):
        found = _ATTRIBUTE.match(html, at)
        at = found.end()
        if html.startswith(">", at):
            return at
        if html.startswith(('"', "'"), at) and found[2] is None and found[3] is None:
            return first
    return first


def tree(html: str) -> Node:
    """The elements and texts of a page."""
    root = Node("html")
    stack, at, n = [root], 0, len(html)

    def close(kinds: set[str] | str, barriers: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in kinds:
                del stack[i:]
                return
            if stack[i].tag in barriers:
                return

    def text(found: str) -> None:
        if stack[-1].tag == "head" and _BLANKS.sub("", found):
            stack.pop()
        stack[-1].children.append(found)

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text(unescape(html[at:lt]))
        if lt == n:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        name = _NAME.match(html, lt + 1)
        if not name:
            if html[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                text("<")
                at = lt + 1
            continue
        end = tag_end(html, name.end())
        tag, at = name[1].lower(), n if end < 0 else end + 1
        if end < 0:
            break
        if html[lt + 1] == "/":
            if tag in ("br", "p") and tag not in {x.tag for x in stack}:
                if stack[-1].tag == "head":
                    stack.pop()
                stack[-1].children.append(Node(tag))
            elif tag not in ("html", "body"):
                close({tag}, {"table", "td", "th"} - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else set())
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            stack.pop()
        for open_tag, (starts, barriers) in ENDS.items():
            if tag in starts:
                close({open_tag}, barriers)
        node = Node(tag, html[name.end() : end])
        stack[-1].children.append(node)
        if html[end - 1] == "/" and (tag in UNSEEN_IN or any(x.tag in UNSEEN_IN for x in stack)):
            continue
        if tag in RAW:
            found = re.compile(f"</{re.escape(tag)}", re.I).search(html, at)
            stop = found.start() if found else n
            node.children.append(html[at:stop] if tag in ("xmp", "style", "script") else unescape(html[at:stop]))
            after = html.find(">", stop)
            at = n if after < 0 else after + 1
        elif tag not in VOID and len(stack) < DEPTH:
            stack.append(node)
    return root


def seen(node: Node) -> bool:
    if node.tag in UNSEEN or node.off or node.tag == "dialog" and "open" not in node.attributes:
        return False
    own = node.attributes
    return not own or not ("hidden" in own or "style" in own and hidden_by(own["style"]) or node.tag == "input" and own.get("type", "").strip().lower() == "hidden")


def render(node: Node, kept: bool = False) -> list[str | None]:
    """Lines of an element's content; None stands for a gap of one blank line."""
    lines: list[str | None] = []
    row: list[str] = []
    count = number(node.attributes, "start", 0) if node.tag == "ol" and "start" in node.attributes else 1

    def flush() -> None:
        text = "".join(row)
        row.clear()
        if kept:
            lines.extend(text.split("\n") if text else [])
        else:
            lines.extend(x for x in (_BLANKS.sub(" ", part).strip(" ") for part in text.split("\0")) if x)

    def walk(children: list, unseen: Collection[str] = ()) -> None:
        nonlocal count
        for child in children:
            if isinstance(child, str):
                row.append(child if kept else child.replace("\0", ""))
            elif not seen(child) or child.tag in unseen:
                continue
            elif child.tag == "br":
                row.append("\n" if kept else "\0")
            elif child.tag == "select":
                groups = [x for x in child.children if isinstance(x, Node)]
                options = [y for x in groups for y in (x.children if x.tag == "optgroup" else [x]) if isinstance(y, Node) and y.tag == "option"]
                chosen = next((x for x in options if "selected" in x.attributes), options[0] if options else None)
                if chosen and ("multiple" in child.attributes or number(child.attributes, "size") > 1):
                    walk(options)
                else:
                    walk(chosen.children if chosen else child.children)
            elif child.tag == "details" and "open" not in child.attributes:
                flush()
                walk([x for x in child.children if isinstance(x, Node) and x.tag == "summary"])
            elif child.tag in BLOCK:
                flush()
                block = table(child) if child.tag == "table" else render(child, kept or child.tag in ("pre", "xmp"))
                if child.tag == "li":
                    if "value" in child.attributes:
                        count = number(child.attributes, "value", 0, 999_999)
                    mark = f"{count}. " if node.tag == "ol" else "- "
                    count += 1
                    block = indented(block, mark)
                elif child.tag in ("dd", "blockquote"):
                    block = indented(block, "    ")
                lines.extend([None, *block, None] if child.tag in APART else block)
            elif child.tag in UNSEEN_IN or unseen:
                apart = " " if child.tag == "text" else ""
                row.append(apart)
                walk(child.children, UNSEEN_IN.get(child.tag, unseen))
                row.append(apart)
            else:
                walk(child.children)

    walk(node.children)
    flush()
    return lines


def tidy(lines: list[str | None]) -> list[str]:
    """One blank line for a gap, none at the ends."""
    out: list[str] = []
    gap = False
    for line in lines:
        if line is None:
            gap = True
        else:
            if gap and out:
                out.append("")
            out.append(line)
            gap = False
    return out


def indented(lines: list[str | None], mark: str) -> list[str]:
    own = tidy(lines)
    return [(mark if i == 0 else " " * len(mark)) + x if x or i == 0 else x for i, x in enumerate(own)] if own else []


def breadth(text: str) -> int:
    """Columns that a text takes: two for a wide character, none for a mark that sits on another."""
    if text.isascii():
        return len(text)
    return sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in text)


def table(node: Node) -> list[str | None]:
    """Rows of a table with its cells in columns; spans over rows and columns keep their places."""
    rows: list[Node] = []
    above: list[str | None] = []
    todo = [*reversed(node.children)]
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            above.extend(x for x in [_BLANKS.sub(" ", child).strip()] if x)
        elif not seen(child):
            continue
        elif child.tag == "tr":
            rows.append(child)
        elif child.tag in ("thead", "tbody", "tfoot"):
            todo.extend(reversed(child.children))
        else:
            part = Node("div")
            part.children.append(child)
            above.extend(render(part))
    parts: list[list[Node]] = []
    for row in rows:
        stray = Node("td")
        own = []
        for child in row.children:
            if isinstance(child, Node) and child.tag in ("td", "th"):
                own.append(child)
            elif isinstance(child, Node) or child.strip():
                stray.children.append(child)
        parts.append(([stray] if stray.children else []) + own)
    # A span over more columns than any row has cells changes nothing.
    most = max(map(len, parts), default=0)
    #: Columns that cells of earlier rows still hold: begin, end, and the row from which they are free.
    held: list[tuple[int, int, int]] = []
    cells: list[list[tuple[int, list[str]]]] = []
    widths: dict[int, int] = {}
    for r, row_cells in enumerate(parts):
        held = [x for x in held if x[2] > r]
        column, at, placed, new = 0, 0, [], []
        for cell in row_cells:
            while at < len(held) and held[at][0] <= column:
                column = max(column, held[at][1])
                at += 1
            across, down = number(cell.attributes, "colspan"), number(cell.attributes, "rowspan")
            lines = tidy(render(cell)) if seen(cell) else []
            placed.append((column, lines))
            if across == 1:
                widths[column] = max(widths.get(column, 0), *map(breadth, lines), 0)
            end = column + min(across, most)
            if down > 1:
                if new and new[-1][1] == column and new[-1][2] == r + down:
                    new[-1] = (new[-1][0], end, r + down)
                else:
                    new.append((column, end, r + down))
            column = end
        held = [*merge(held, new)]
        cells.append(placed)
    known = sorted(widths)
    sums = [0, *accumulate(widths[c] + 2 for c in known)]
    out: list[str | None] = [*above]
    for own in cells:
        for i in range(max((len(lines) for _, lines in own), default=0)):
            text, place = "", 0
            for column, lines in own:
                begin = sums[bisect_left(known, column)]
                if begin > place:
                    text, place = text + " " * (begin - place), begin
                piece = lines[i] if i < len(lines) else ""
                gap = "  " if text and place > begin else ""
                text, place = text + gap + piece, place + len(gap) + breadth(piece)
            out.append(text.rstrip())
    return out


def hide_by_rules(root: Node) -> None:
    """Marks elements that a rule of the page's own style sheets hides by tag, class or id; other selectors are left out."""
    sheets, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "style":
            sheets += [x for x in node.children if isinstance(x, str)]
        todo += [x for x in node.children if isinstance(x, Node)]
    # By one thing that a selector asks for: what it asks for.
    rules: dict[str, list[tuple[str, set[str]]]] = defaultdict(list)
    for sheet in sheets:
        # What stands in an at-rule depends on the device.
        for rule in _AT_RULE.sub("", re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)).split("}"):
            selectors, _, body = rule.partition("{")
            if hidden_by(body):
                for found in map(_SIMPLE.fullmatch, selectors.split(",")):
                    if found and (found[1] or found[2]):
                        marks = re.findall(r"[.#][\w-]+", found[2])
                        tag = (found[1] or "").lower()
                        rules[marks[0] if marks else tag].append((tag, set(marks)))
    todo = [root] if rules else []
    while todo:
        node = todo.pop()
        own = {"." + c for c in node.attributes.get("class", "").split()} | {"#" + node.attributes.get("id", "").strip()}
        node.off = any(tag in ("", node.tag) and marks <= own for mark in (node.tag, *own) for tag, marks in rules.get(mark, ()))
        todo += [x for x in node.children if isinstance(x, Node)]


def visible_text(html: str) -> str:
    root = tree(html)
    hide_by_rules(root)
    return "\n".join(tidy(render(root)))


def extracted(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with the visible text of each page and its length.

    A null or empty page has the empty text; broken markup is read as far as it goes; repeated rows are rows of
    their own; columns other than these three are left out; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(x.as_py() or "") for x in batch.column(2)]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), lengths], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
