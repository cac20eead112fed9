"""Layout-aware text of HTML pages.

A tree builder closes and opens implied tags; a renderer walks the tree without
recursion and lays out what is visible: blocks on lines of their own, list items
behind markers, preformatted text as it stands, and table cells in aligned
columns.  Hidden is what its tag, its attributes or a plain rule of a style sheet
(for a tag, a class or an id) hide.  A page is one row; memory is bounded by the
largest page, and time grows in proportion to its length whatever its tags.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: elements by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object datalist audio video canvas rp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table pre blockquote figure fieldset hr xmp".split())
#: What may stand in a head; any other opening tag ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
CLOSES_P = BLOCK - frozenset("body html legend optgroup option summary tbody td tfoot th thead tr caption li dd dt".split())
LISTS, CELLS, SECTIONS = frozenset("ul ol menu dir".split()), frozenset("td th".split()), frozenset("thead tbody tfoot".split())
#: An opening tag closes the nearest of the first set, unless one of the second stands before it.
IMPLIED_END = {
    "li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": (SECTIONS | {"caption"}, {"table"}), "tbody": (SECTIONS | {"caption"}, {"table"}), "tfoot": (SECTIONS | {"caption"}, {"table"}), "body": ({"head"}, {"body"}),
}
#: A quote opens a value only after "=" and if it is closed; any other is a character like the rest.
_NAME = r"""(?:=[^ \t\n\r\f/>=]*+|[^ \t\n\r\f/>=]++)"""
_EQUALS = r"""[ \t\n\r\f]*+=[ \t\n\r\f]*+"""
TAG = re.compile(rf"""<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|{_NAME}(?:{_EQUALS}(?:"[^"]*+"|'[^']*+'|[^ \t\n\r\f>]++)?+)?+)*+)>""")
ATTRIBUTE = re.compile(rf"""({_NAME})(?:{_EQUALS}(?:"([^"]*+)"|'([^']*+)'|([^ \t\n\r\f>]++))?+)?+""")
#: For a page with many quotes that hide the end of their tag: there they mean nothing.
PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
#: Tags that do not end on a page, each of which is sought to the end, before quotes lose their meaning.
OPEN_TAGS = 8
#: Lists, cells and quotes nested deeper than this are laid out like plain blocks.
DEPTH = 40
#: Elements nested deeper than this, other than hidden ones, hold nothing: what follows stands beside them.
STACK = 512
RAW_END = {name: re.compile(rf"</{name}(?=[ \t\n\r\f/>])", re.IGNORECASE | re.ASCII) for name in RAW}
COMMENT_END = re.compile(r"--!?>")
RULE = re.compile(r"([^{}]*)([{}])")
#: A compound selector without attributes and pseudo-classes; another one matches nothing.
COMPOUND = re.compile(r"([a-z][a-z0-9-]*|\*)?((?:[.#][a-z0-9_-]+)*)")
#: Media that a page is read on; a query with conditions is passed over.
MEDIA = frozenset(("", "all", "screen", "only screen", "only all"))
SPACE = re.compile(r"[ \t\n\r\f]+")
GAP = "  "
#: Lines, columns spanned and rows spanned; 0 rows reach to the end of the group.
Cell = tuple[list[str], int, int]


class Node:
    __slots__ = ("attributes", "children", "parent", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None = None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []


def _attributes(text: str) -> dict[str, str]:
    if not text.strip():
        return {}
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) with kind text, open or close; comments and declarations are left out."""
    at, size, last, open_tags = 0, len(page), page.rfind(">"), 0
    while at < size:
        to = page.find("<", at)
        if to < 0:
            yield "text", html.unescape(page[at:]), ""
            return
        if to > at:
            yield "text", html.unescape(page[at:to]), ""
        if page.startswith("<!--", to):
            if page.startswith((">", "->"), to + 4):
                at = page.index(">", to) + 1
            else:
                found = COMMENT_END.search(page, to + 4)
                at = found.end() if found else size
        elif page[to + 1 : to + 2] in ("!", "?"):
            end = page.find(">", to)
            at = size if end < 0 else end + 1
        elif to < last and (m := (TAG if open_tags < OPEN_TAGS else PLAIN_TAG).match(page, to)):
            name, at = m[2].lower(), m.end()
            yield "close" if m[1] else "open", name, m[3]
            if not m[1] and name in RAW:
                found = RAW_END[name].search(page, at)
                end = found.start() if found else size
                text = page[at:end]
                yield "text", html.unescape(text) if name in ("textarea", "title") else text, ""
                at = end
        else:
            open_tags += to < last and page[to + 1 : to + 2].isalpha()
            yield "text", "<", ""
            at = to + 1


def tree(page: str) -> Node:
    """The page's elements, with implied tags."""
    root = Node("#root", {})
    stack = [root]
    opened: dict[str, int] = {}

    def push(tag: str, attributes: dict[str, str]) -> None:
        node = Node(tag, attributes, stack[-1])
        stack[-1].children.append(node)
        if tag not in VOID and (len(stack) < STACK or tag in HIDDEN or tag in RAW):
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1

    def pop() -> None:
        opened[stack.pop().tag] -= 1

    def close(names: set[str] | frozenset[str], border: set[str] | frozenset[str]) -> bool:
        """Closes the nearest of names with all it holds, unless a border stands before it."""
        if not any(opened.get(n) for n in names):
            return False
        depth = len(stack) - 1
        while depth and stack[depth].tag not in names:
            if stack[depth].tag in border:
                return False
            depth -= 1
        while len(stack) > depth:
            pop()
        return True

    for kind, name, more in tokens(page):
        if stack[-1].tag == "head" and (name.strip(" \t\n\r\f") if kind == "text" else name not in IN_HEAD if kind == "open" else name == "br"):
            pop()
        if kind == "text":
            stack[-1].children.append(name)
        elif kind == "open":
            if name in CLOSES_P:
                close({"p"}, CELLS | {"table", "button", "object"})
            if name in IMPLIED_END:
                close(*IMPLIED_END[name])
            if name in SECTIONS | {"tr"} and name != "caption":
                close(CELLS | {"caption"}, {"table"})
                if name == "tr":
                    close({"tr"}, {"table"})
                elif name in SECTIONS:
                    close({"tr"}, {"table"})
            if name in CELLS and opened.get("table") and stack[-1].tag in SECTIONS | {"table"}:
                push("tr", {})
            push(name, _attributes(more))
        elif name == "br":
            push("br", {})
        elif name == "p" and not opened.get("p"):
            push("p", {})
            pop()
        elif name not in VOID:
            border = frozenset() if name in ("table", "body", "html") else CELLS | {"table"} if name not in CELLS | SECTIONS | {"tr"} else {"table"}
            close({name}, border - {name})
    return root


def declared(style: str) -> dict[str, tuple[bool, bool]]:
    """Of some declarations (important, shown) of display and visibility: what comes last, an important one first."""
    out: dict[str, tuple[bool, bool]] = {}
    for part in style.lower().split(";"):
        name, colon, value = part.partition(":")
        name, words = name.strip(), value.replace("!", " !").split()
        if colon and words and name in ("display", "visibility"):
            important = "".join(words[1:]).endswith("!important")
            shown = words[0] != "none" if name == "display" else words[0] not in ("hidden", "collapse")
            if important or not out.get(name, (False,))[0]:
                out[name] = important, shown
    return out


#: A compound selector: tag, ids and classes.
Compound = tuple[str, frozenset[str], frozenset[str]]


def _selector(text: str) -> list[tuple[str, Compound]] | None:
    """The compounds of a selector, the last one first, each with how the one before it is related: " " or ">"."""
    out: list[tuple[str, Compound]] = []
    relation = " "
    for part in text.replace(">", " > ").split():
        if part == ">":
            relation = ">"
            continue
        own = COMPOUND.fullmatch(part)
        if not own or not own[0]:
            return None
        names = re.findall(r"[.#][^.#]+", own[2])
        out.append((relation, ("" if own[1] in (None, "*") else own[1], frozenset(n[1:] for n in names if n[0] == "#"), frozenset(n[1:] for n in names if n[0] == "."))))
        relation = " "
    return out[::-1] or None


class Sheets:
    """What a page's style sheets say about display and visibility, by the last compound of a selector."""

    def __init__(self) -> None:
        self.by: dict[tuple[str, str], list[tuple[list[tuple[str, Compound]], tuple[int, int, int, int], dict[str, tuple[bool, bool]]]]] = {}
        self.count = 0

    def add(self, sheet: str) -> None:
        """Adds a sheet; comments are blanks, unknown at-rules are passed over with all they hold."""
        open_: list[tuple[bool, str]] = []
        for m in RULE.finditer(re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet.lower(), flags=re.DOTALL)):
            if m[2] == "{":
                head = m[1].rpartition(";")[2].strip()
                applies = all(a for a, _ in open_)
                if head.startswith("@"):
                    name, _, query = head.partition(" ")
                    open_.append((applies and (name == "@layer" or name == "@media" and any(" ".join(q.split()) in MEDIA for q in query.split(","))), ""))
                else:
                    open_.append((applies, head))
            elif open_:
                applies, selectors = open_.pop()
                if applies and selectors and (own := declared(m[1])):
                    for text in selectors.split(","):
                        if parts := _selector(text):
                            self._add(parts, own)

    def _add(self, parts: list[tuple[str, Compound]], own: dict[str, tuple[bool, bool]]) -> None:
        self.count += 1
        weight = (sum(len(c[1]) for _, c in parts), sum(len(c[2]) for _, c in parts), sum(bool(c[0]) for _, c in parts), self.count)
        tag, ids, classes = parts[0][1]
        key = ("#", min(ids)) if ids else (".", min(classes)) if classes else ("", tag)
        self.by.setdefault(key, []).append((parts, weight, own))

    def of(self, node: Node) -> dict[str, bool]:
        """Whether the sheets show a node, for display and visibility, where they say so."""
        if not self.by:
            return {}
        ids, classes = _names(node)
        best: dict[str, tuple[bool, tuple[int, int, int, int], bool]] = {}
        for key in (("", ""), ("", node.tag), *(("#", i) for i in ids), *((".", c) for c in classes)):
            for parts, weight, own in self.by.get(key, ()):
                if _matches(parts, 0, node):
                    for name, (important, shown) in own.items():
                        best[name] = max(best.get(name, (False, (-1,) * 4, True)), (important, weight, shown))
        return {name: shown for name, (_, _, shown) in best.items()}


def _names(node: Node) -> tuple[frozenset[str], frozenset[str]]:
    a = node.attributes
    return frozenset([a["id"].strip().lower()] if "id" in a else ()), frozenset(a["class"].lower().split() if "class" in a else ())


def _matches(parts: list[tuple[str, Compound]], i: int, node: Node) -> bool:
    """Whether the compounds from i on hold for a node and its ancestors."""
    tag, ids, classes = parts[i][1]
    own = _names(node) if ids or classes else ((), ())
    if tag and tag != node.tag or ids and not ids <= own[0] or classes and not classes <= own[1]:
        return False
    if i + 1 == len(parts):
        return True
    above = node.parent
    while above is not None and above.tag != "#root":
        if _matches(parts, i + 1, above):
            return True
        if parts[i][0] == ">":
            return False
        above = above.parent
    return False


def visible(node: Node, sheets: Sheets, inherited: bool) -> bool | None:
    """Whether a node's own text shows, where its parent's does or does not; None if neither it nor what it holds is displayed."""
    a = node.attributes
    if node.tag in HIDDEN or "hidden" in a or node.tag == "dialog" and "open" not in a:
        return None
    said = sheets.of(node)
    if "style" in a:
        said |= {name: shown for name, (_, shown) in declared(a["style"]).items()}
    return said.get("visibility", inherited) if said.get("display", True) else None


def wide(text: str) -> int:
    """Columns that a text takes: two for each wide character, none for a mark that combines."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines of one block context."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = self.gap = False

    def text(self, text: str, pre: bool) -> None:
        if pre:
            first, *more = text.replace("\r\n", "\n").split("\n")
            self.parts.append(first)
            for line in more:
                self.newline()
                self.parts.append(line)
            return
        inner = SPACE.sub(" ", text)
        if inner.strip(" ") == "":
            self.space |= bool(inner)
            return
        if (self.space or inner[0] == " ") and self.parts:
            self.parts.append(" ")
        self.parts.append(inner.strip(" "))
        self.space = inner[-1] == " "

    def newline(self) -> None:
        self._lay("".join(self.parts))
        self.parts, self.space = [], False

    def _lay(self, line: str) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        self.lines.append(line)

    def block(self, spaced: bool) -> None:
        if self.parts:
            self.newline()
        self.space = False
        self.gap |= spaced

    def add(self, lines: list[str]) -> None:
        for line in lines:
            self._lay(line)

    def done(self) -> list[str]:
        self.block(False)
        out = [line.rstrip() for line in self.lines]
        while out and not out[-1]:
            out.pop()
        start = next((i for i, line in enumerate(out) if line), len(out))
        return out[start:]


def _placed(table: list[list[Cell] | None]) -> list[list[tuple[int, list[str], int]]]:
    """Rows of (column, lines, columns spanned): a cell stands right of those before it and of those that reach down to its row."""
    groups: list[list[list[Cell]]] = [[]]
    for row in table:
        if row is None:
            groups.append([])
        else:
            groups[-1].append(row)
    out = []
    for rows in groups:
        until: dict[int, int] = {}
        for i, row in enumerate(rows):
            at, places = 0, []
            for lines, span, down in row:
                while until.get(at, 0) > i:
                    at += 1
                places.append((at, lines, span))
                if down != 1:
                    until |= dict.fromkeys(range(at, at + span), i + down if down else len(rows))
                at += span
            out.append(places)
    return out


def _columns(table: list[list[Cell] | None]) -> list[str]:
    """Rows as aligned text; None stands between groups of rows, which no cell reaches across."""
    rows = [r for r in _placed(table) if any(any(lines) for _, lines, _ in r)]
    width: list[int] = []
    for row in rows:
        for at, lines, span in row:
            width += [0] * (at + span - len(width))
            if span == 1:
                width[at] = max(width[at], *map(wide, lines), 0)
    out = []
    for row in rows:
        height = max((len(lines) for _, lines, _ in row), default=0)
        for i in range(height):
            last, parts = 0, []
            for at, lines, span in row:
                parts += [" " * w for w in width[last:at]]
                room = sum(width[at : at + span]) + len(GAP) * (span - 1)
                line = lines[i] if i < len(lines) else ""
                parts.append(line + " " * (room - wide(line)))
                last = at + span
            out.append(GAP.join(parts).rstrip())
    return out


def _number(text: str, default: int, most: int = 1000) -> int:
    """A count attribute; the format itself bounds a span at 1000 columns and 65534 rows."""
    return min(int(text), most) if text.isascii() and text.isdigit() and len(text) < 10 else default


def _place(text: str, default: int) -> int:
    """A list item's number, which may be negative."""
    text = text.strip()
    return int(text) if re.fullmatch(r"-?[0-9]{1,9}", text) else default


def _sheets(root: Node) -> Sheets:
    out = Sheets()
    todo: list[Node | str] = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, Node):
            if node.tag == "style" and any(" ".join(q.split()) in MEDIA for q in node.attributes.get("media", "").lower().split(",")):
                out.add("".join(c for c in node.children if isinstance(c, str)))
            todo += reversed(node.children)
    return out


def render(page: str | None) -> str:
    """The visible text of a page; "" for null."""
    flows = [Flow()]
    tables: list[list[list[Cell] | None]] = []
    lists: list[tuple[bool, list[int], int]] = []
    pre = 0
    root = tree(page or "")
    sheets = _sheets(root) if page and "<style" in page.lower() else Sheets()
    # own is of a node that is left: whether it has a flow; of one that is entered: whether its parent's text shows
    todo: list[tuple[bool, Node | str, bool]] = [(True, root, True)]
    while todo:
        enter, node, own = todo.pop()
        if isinstance(node, str):
            if own:
                flows[-1].text(node, pre > 0)
            continue
        tag = node.tag
        spaced = tag in SPACED and not (tag in LISTS and len(lists) > (0 if enter else 1))
        if enter:
            shows = visible(node, sheets, own)
            if shows is None:
                continue
            own = (tag in ("li", "dd", "blockquote", "table", "caption") or tag in CELLS) and len(flows) <= DEPTH
            todo.append((False, node, own))
            todo += [(True, c, shows) for c in reversed(node.children)]
            if tag == "br":
                if shows:
                    flows[-1].newline()
            elif tag in BLOCK and (tag not in CELLS or not own):
                flows[-1].block(spaced)
            if tag in ("pre", "xmp", "textarea"):
                pre += 1
            if tag == "table" and own:
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in SECTIONS and tables:
                tables[-1].append(None)
            elif tag in LISTS:
                down = tag == "ol" and "reversed" in node.attributes
                first = sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if down else 1
                lists.append((tag == "ol", [_place(node.attributes.get("start", ""), first)], -1 if down else 1))
            if own:
                flows.append(Flow())
            continue
        if tag in ("pre", "xmp", "textarea"):
            pre -= 1
        if own:
            lines = flows.pop().done()
            if tag in CELLS and tables:
                if not tables[-1] or tables[-1][-1] is None:
                    tables[-1].append([])
                tables[-1][-1].append((lines or [""], max(1, _number(node.attributes.get("colspan", ""), 1)), _number(node.attributes.get("rowspan", ""), 1, 65534)))
            elif tag == "table":
                flows[-1].block(True)
                flows[-1].add(lines + _columns(tables.pop()))
            else:
                mark = ""
                if tag == "li":
                    ordered, count, step = lists[-1] if lists else (False, [1], 1)
                    count[0] = _place(node.attributes.get("value", ""), count[0])
                    mark = f"{count[0]}. " if ordered else "- "
                    count[0] += step
                elif tag in ("dd", "blockquote"):
                    mark = "  "
                flows[-1].block(False)
                flows[-1].add([(mark if i == 0 else " " * len(mark) if line else "") + line for i, line in enumerate(lines)])
        if tag in SECTIONS and tables:
            tables[-1].append(None)
        if tag in LISTS:
            lists.pop()
        if tag in BLOCK and (tag not in CELLS or not own):
            flows[-1].block(spaced)
    return "\n".join(flows[0].done())


def html_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, text, n_chars, n_lines) of each row's page.

    A null or empty page gives an empty text.  Rows that repeat an id are each
    rendered from their own page, null ids stay, and an empty table gives no
    rows.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(cell.as_py()) for cell in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array([t.count("\n") + bool(t) for t in texts], pa.int64())], ["id", "text", "n_chars", "n_lines"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string, n_chars long, n_lines long").withColumnRenamed("id", id_col)
