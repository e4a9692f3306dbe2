"""HTML to text by layout: a tree with implied tags, visibility rules, then rendering of everything visible.

The tokenizer is one pass over the source; the builder supplies tags that HTML lets authors leave out (ends of
``p``, ``li``, ``dt``, ``dd``, ``option`` and table parts, starts of ``tbody`` and ``tr``) and ignores end tags that
close nothing; places of open elements are indexed by tag, so a page takes time in proportion to its length. Hidden
are: elements without rendering (``script``, ``style``, ``template``, ...), hidden inputs, closed dialogs, closed details
but for their summary, and what the ``hidden`` attribute, style attributes and the page's own style sheets hide by
``display`` (with all below) or ``visibility`` (below it may be shown again), by specificity and order. Of style
sheets, rules with simple selectors (tag, .class, #id and their compounds) count, within ``@media`` if it holds for a
screen ``SCREEN`` pixels wide. Blocks stand on lines of their own, paragraphs and headings between blank lines; list
items keep bullets, numbers and depth, ``pre`` its white space. Table cells are rendered like pages, wrapped at
``CELL`` characters and padded to their columns; a longer word has a line of its own.

Defined cases: null and empty pages give empty text; broken markup is text or is skipped as browsers do, and numbers
beyond HTML's limits are clamped; nesting of any depth is handled without recursion, and tables more than ``TABLES``
levels deep are laid out as blocks; ``ht_*`` columns that the pages already have are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftwarden.llm.common import prepare, slices, strings

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("script style template head title meta link base iframe noembed noframes noscript object audio video canvas datalist rp desc metadata defs annotation annotation-xml".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset listing".split())
LISTS = frozenset("ul ol menu dir".split())
#: A start tag of the key ends open elements of the first set, looked for up to an element of the second.
IMPLIED_ENDS = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "table": ({"table"}, {"td", "th", "caption"}),
    "body": ({"head"}, {"html"}),
}
ENDS_P = BLOCKS - frozenset("body html option optgroup td th tr tbody thead tfoot caption legend".split())
SCOPE = frozenset("table td th caption template html".split())
SECTIONS = frozenset("tbody thead tfoot".split())
PREFORMATTED = frozenset("pre listing textarea xmp".split())
OTHER_MEDIA = frozenset("print speech aural braille embossed handheld projection tty tv".split())
#: HTML's own limits of numbers in attributes.
COLSPAN, ROWSPAN, ORDINAL = 1000, 65534, (1 << 31) - 1

SCREEN = 1280
CELL = 80
TABLES = 8
INDENTED = 32  # levels of lists beyond this one are indented no further
PADDING = 50  # a table is not aligned if that took so many times its text

_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([!?])|(/?[a-zA-Z]))")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
_NUMBER = re.compile(r"[ \t\n\r\f]*([+-]?)0*([0-9]+)")
_ZEROS, _FAR = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_STYLE_TOKEN = re.compile(r"[{};]|\"[^\"]*\"|'[^']*'")
_COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")
_WIDTH = re.compile(r"(min|max)-width\s*:\s*([0-9]+(?:\.[0-9]*)?)(px|em|rem)")


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def unescaped(text: str) -> str:
    """Character references replaced; numbers of any length are read."""
    if "&#" in text:
        text = _FAR.sub("�", _ZEROS.sub("&#", text))
    return entities.unescape(text)


def number(source: str | None, default: int, low: int, high: int) -> int:
    """The integer that an attribute begins with, clamped."""
    m = _NUMBER.match(source or "")
    if not m:
        return default
    value = int(m[2]) if len(m[2]) < 12 else ORDINAL
    return min(max(-value if m[1] == "-" else value, low), high)


def attributes_of(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if source.strip(" \t\n/"):
        for name, a, b, c in _ATTRIBUTE.findall(source):
            value = a or b or c
            out.setdefault(name.lower(), unescaped(value) if "&" in value else value)
    return out


class Builder:
    """The tree under construction: open elements, and for each tag the places where it is open."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.open = [self.root]
        self.places: dict[str, list[int]] = {"html": [0]}

    def push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def cut(self, size: int) -> None:
        while len(self.open) > size:
            self.places[self.open.pop().tag].pop()

    def innermost(self, tags: set[str] | frozenset[str]) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def close(self, tags: set[str] | frozenset[str], within: set[str] | frozenset[str]) -> bool:
        """Close the innermost open element of ``tags`` unless one of ``within`` lies inside."""
        at = self.innermost(tags)
        if at < 1 or self.innermost(within) > at:
            return False
        self.cut(at)
        return True

    def start(self, node: Node) -> None:
        tag = node.tag
        if tag in ENDS_P:
            self.close({"p"}, SCOPE)
        if tag in IMPLIED_ENDS:
            closed, within = IMPLIED_ENDS[tag]
            while self.close(closed, within):
                pass
        if tag == "tr" and self.open[-1].tag == "table":
            self.push(Node("tbody"))
        elif tag in ("td", "th"):
            if self.open[-1].tag == "table":
                self.push(Node("tbody"))
            if self.open[-1].tag in SECTIONS:
                self.push(Node("tr"))
        self.push(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br"))
        elif not self.close({tag}, frozenset() if tag in SCOPE or tag == "tr" or tag in SECTIONS else SCOPE) and tag == "p":
            self.open[-1].children.append(Node("p"))


def parse(source: str) -> tuple[Node, list[str], str]:
    """The tree, the page's style sheets and its title."""
    tree, styles, title = Builder(), [], ""
    at, n = 0, len(source)
    while at < n:
        m = _TAG.search(source, at)
        if not m:
            tree.open[-1].children.append(unescaped(source[at:]))
            break
        if m.start() > at:
            tree.open[-1].children.append(unescaped(source[at : m.start()]))
        at = m.end()
        if m[1]:
            end = source.find("-->", at - 2)
            at = n if end < 0 else end + 3
            continue
        if m[5] or m[6]:  # declarations; tags whose quotes never close end at the next >
            end = source.find(">", at)
            at = n if end < 0 else end + 1
            continue
        tag = m[3].lower()
        if m[2]:
            tree.end(tag)
            continue
        node = Node(tag, attributes_of(m[4]))
        tree.start(node)
        if tag in VOID:
            tree.cut(len(tree.open) - 1)
        elif tag in RAW:
            end = _ENDS[tag].search(source, at)
            inner = source[at : end.start() if end else n]
            at = end.end() if end else n
            if tag == "style":
                styles.append(inner)
            elif tag == "title" and any(x.tag == "svg" for x in tree.open[-64:]):
                pass  # a drawing's own title, which is not shown
            elif tag == "title" and not title:
                title = _SPACE.sub(" ", unescaped(inner)).strip()
            elif tag in ("textarea", "xmp"):
                node.children.append(unescaped(inner) if tag == "textarea" else inner)
            tree.cut(len(tree.open) - 1)
    return tree.root, styles, title


def declared(body: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) of the declarations that decide on visibility."""
    out = []
    for part in body.split(";"):
        name, _, value = part.partition(":")
        name = name.strip().lower()
        if name in ("display", "visibility"):
            value, _, important = value.lower().partition("!")
            out.append((name, value.strip(), "important" in important))
    return out


def on_screen(condition: str) -> bool:
    """Whether a media condition holds for a screen ``SCREEN`` pixels wide; features not known here do not hold."""
    for item in condition.lower().split(","):
        words = item.split()
        negated = words[:1] == ["not"]
        kind = next((w for w in words[words[:1] in (["not"], ["only"]) :][:1] if not w.startswith("(")), "all")
        holds = kind not in OTHER_MEDIA
        for feature in re.findall(r"\(([^()]*)\)", item):
            m = _WIDTH.fullmatch(feature.strip())
            size = float(m[2]) * (1 if m[3] == "px" else 16) if m else 0
            holds = holds and m is not None and (size <= SCREEN if m[1] == "min" else size >= SCREEN)
        if holds != negated:
            return True
    return False


def style_rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold on a screen, in one pass."""
    css = _COMMENT.sub(" ", sheet)
    blocks: list[tuple[str, bool, str]] = []  # kind, whether it holds, selectors
    begin = 0
    holds = True
    for m in _STYLE_TOKEN.finditer(css):
        token = m[0]
        if token == "{":
            head = css[begin : m.start()].strip()
            if blocks and blocks[-1][0] == "rule" or head.startswith("@") and not head.lower().startswith(("@media", "@supports", "@layer")):
                blocks.append(("other", holds, ""))
                holds = False
            elif head.startswith("@"):
                blocks.append(("group", holds, ""))
                holds = holds and (not head.lower().startswith("@media") or on_screen(head[6:]))
            else:
                blocks.append(("rule", holds, head))
            begin = m.end()
        elif token == "}":
            if blocks:
                kind, before, head = blocks.pop()
                if kind == "rule" and holds:
                    yield head, css[begin : m.start()]
                holds = before
            begin = m.end()
        elif token == ";" and not (blocks and blocks[-1][0] == "rule"):
            begin = m.end()
    if blocks and blocks[-1][0] == "rule" and holds:
        yield blocks[-1][2], css[begin:]


class Styles:
    """What the page's style sheets say about being seen."""

    def __init__(self, sheets: list[str]):
        #: By a tag, .class or #id, of a rule's the one that the fewest rules name: (tag, ids, classes, property) with the
        #: rank and value of the rule that wins.
        self.rules: dict[str, dict[tuple, tuple]] = {}
        winners: dict[tuple, tuple] = {}
        order = 0
        for sheet in sheets:
            for selectors, body in style_rules(sheet):
                if not (said := declared(body)):
                    continue
                for selector in selectors.split(","):
                    m = _COMPOUND.fullmatch(selector.strip())
                    if not m or not m[0]:
                        continue
                    tag = "" if m[1] in (None, "*") else m[1].lower()
                    parts = re.findall(r"[.#][\w-]+", m[2])
                    ids, classes = frozenset(p[1:] for p in parts if p[0] == "#"), frozenset(p[1:] for p in parts if p[0] == ".")
                    order += 1
                    for name, value, important in said:
                        rank = (important, 0, (len(ids), len(classes), bool(tag)), order)
                        if rank >= winners.get((tag, ids, classes, name), (rank,))[0]:
                            winners[tag, ids, classes, name] = (rank, value)
        named = {key: [*("#" + i for i in key[1]), *("." + c for c in key[2])] or [key[0] or "*"] for key in winners}
        uses = Counter(part for parts in named.values() for part in parts)
        for key, parts in named.items():
            self.rules.setdefault(min(parts, key=lambda p: (uses[p], p)), {})[key] = winners[key]

    def seen(self, node: Node, visible: bool) -> bool | None:
        """None if the element is not displayed, else whether its text is visible; ``visible`` is its parent's."""
        tag, a = node.tag, node.attributes
        if tag in UNSEEN or (tag == "dialog" and "open" not in a) or (tag == "input" and a.get("type", "").lower() == "hidden"):
            return None
        if not a and not self.rules:
            return visible
        best = {"display": ((False, -1), "none")} if "hidden" in a else {}
        if self.rules:
            own, classes = a.get("id", ""), a.get("class", "").split()
            for key in ("*", tag, *(["#" + own] if own else []), *("." + c for c in dict.fromkeys(classes))):
                for (needed, ids, held, name), found in self.rules.get(key, {}).items():
                    if (not needed or needed == tag) and ids <= {own} and held.issubset(classes) and (name not in best or found[0] >= best[name][0]):
                        best[name] = found
        if "style" in a:
            for name, value, important in declared(a["style"]):
                rank = (important, 1)
                if name not in best or rank >= best[name][0]:
                    best[name] = (rank, value)
        if "display" in best and best["display"][1] == "none":
            return None
        shown = best.get("visibility", (None, "inherit"))[1]
        return False if shown in ("hidden", "collapse") else True if shown in ("visible", "initial") else visible


class Page:
    """Lines of output with pending white space: ``gap`` line breaks are due before the next text."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.gap = 0
        self.space = False
        self.prefix: str | None = None
        self.indent = ""
        self.lists: list[list] = []  # whether numbered, the next number
        self.pre = 0

    def broken(self, lines: int) -> None:
        self.gap = max(self.gap, lines)
        self.space = False

    def put(self, text: str, pre: bool = False) -> None:
        if not pre:
            lead = text[:1] in " \t\n\r\f"
            words = _SPACE.sub(" ", text).strip(" ")
            if not words:
                self.space = self.space or bool(text)
                return
            tail = text[-1] in " \t\n\r\f"
        else:
            lead, words, tail = False, text, False
        if self.gap or self.prefix is not None or not self.out:
            if self.out:
                self.out.append("\n" * max(self.gap, 1))
            self.out.append(self.indent if self.prefix is None else self.prefix)
            self.gap, self.prefix = 0, None
        elif self.space or lead:
            self.out.append(" ")
        self.out.append(words)
        self.space = tail

    def text(self) -> str:
        lines = [x.rstrip(" \t") for x in "".join(self.out).split("\n")]
        return "\n".join(lines).strip("\n")


class Cells:
    """A table's cells by row and first column; ``rest`` holds what stands before the rows: stray content, captions."""

    def __init__(self, table: Node, styles: Styles, visible: bool):
        self.rest: list[tuple] = []
        self.cells: list[tuple[int, int, Node, bool]] = []
        self.lines: dict[tuple[int, int], list[str]] = {}
        taken: list[tuple[int, int, int]] = []  # columns from, to and the row at which they are free again
        rows, captions = 0, []
        todo = [(c, visible) for c in reversed(table.children)]
        while todo:
            x, seen = todo.pop()
            if isinstance(x, str):
                self.rest.append((x, seen))
                continue
            if x.tag in ("colgroup", "col"):
                continue
            if x.tag == "caption":
                captions.append((x, seen))
            elif x.tag not in SECTIONS and x.tag != "tr":
                self.rest.append((x, seen))
            elif (shown := styles.seen(x, seen)) is not None:
                if x.tag in SECTIONS:
                    todo.extend((c, shown) for c in reversed(x.children))
                else:
                    taken = self._row(x, rows, shown, styles, [t for t in taken if t[2] > rows])
                    rows += 1
        self.rest = [r for r in self.rest if not isinstance(r[0], str) or r[0].strip()] + captions
        self.rows = rows

    def _row(self, row: Node, number_: int, visible: bool, styles: Styles, taken: list) -> list:
        column, k, new = 0, 0, []
        for cell in row.children:
            if isinstance(cell, str) or cell.tag not in ("td", "th"):
                if not isinstance(cell, str) or cell.strip():
                    self.rest.append((cell, visible))
                continue
            if styles.seen(cell, visible) is None:
                continue
            while k < len(taken) and taken[k][0] <= column:
                column = max(column, taken[k][1])
                k += 1
            self.cells.append((number_, column, cell, visible))
            wide, high = number(cell.attributes.get("colspan"), 1, 1, COLSPAN), number(cell.attributes.get("rowspan"), 1, 1, ROWSPAN)
            if high > 1:
                new.append((column, column + wide, number_ + high))
            column += wide
        joined: list[tuple[int, int, int]] = []
        for a, b, free in sorted(taken + new):
            if joined and joined[-1][2] == free and joined[-1][1] >= a:
                joined[-1] = (joined[-1][0], max(b, joined[-1][1]), free)
            else:
                joined.append((a, b, free))
        return joined

    def text(self) -> list[str]:
        """Lines with every column's cells below each other; columns that no cell begins in take no room."""
        columns = sorted({c for _, c, _, _ in self.cells})
        place = {c: k for k, c in enumerate(columns)}
        width, rows = [0] * len(columns), [[] for _ in range(self.rows)]
        for (r, c), lines in self.lines.items():
            rows[r].append((place[c], lines))
            width[place[c]] = max([width[place[c]], *(len(x) for x in lines if len(x) <= CELL)])
        begin = [0]
        for w in width:
            begin.append(begin[-1] + w + 2)
        text = sum(len(x) for lines in self.lines.values() for x in lines)
        padding = sum(begin[max(k for k, _ in cells)] * max(len(lines) for _, lines in cells) for cells in rows if cells)
        if padding > PADDING * (text + 1000):
            begin = [0] * len(begin)
        out = []
        for cells in rows:
            for i in range(max((len(lines) for _, lines in cells), default=0)):
                line = ""
                for k, lines in sorted(cells, key=lambda x: x[0]):
                    if i < len(lines) and lines[i]:
                        if begin[k] and len(line) > begin[k] - 2:  # a word too long for its column
                            out.append(line)
                            line = ""
                        line = (line.ljust(begin[k]) if begin[k] or not line else line + "  ") + lines[i]
                out.append(line.rstrip())
        return out


def wrapped(text: str) -> list[str]:
    """Lines of at most ``CELL`` characters, or of one word."""
    out = []
    for line in text.split("\n"):
        if len(line) <= CELL or "  " in line.strip():  # laid out already
            out.append(line)
            continue
        size, held = len(line) - len(line.lstrip(" ")), []
        indent = " " * min(size, CELL // 2)
        used = len(indent)
        for word in line.split():
            if held and used + len(word) + 1 > CELL:
                out.append(indent + " ".join(held))
                held, used = [], len(indent)
            held.append(word)
            used += len(word) + 1
        out.append(indent + " ".join(held))
    return out


LEAVE, CELL_BEGIN, CELL_DONE, TABLE_DONE = range(4)


def render(root: Node, styles: Styles) -> str:
    pages = [Page()]
    todo: list[tuple] = [(root, True, None)]  # node or text, whether its parent is visible; or what is to end
    while todo:
        x, visible, ending = todo.pop()
        page = pages[-1]
        if ending == CELL_BEGIN:
            pages.append(Page())
            continue
        if ending == CELL_DONE:
            cells, at = x
            if text := pages.pop().text():
                cells.lines[at] = wrapped(text)
            continue
        if ending == TABLE_DONE:
            page.broken(1)
            for line in x.text():
                if line:
                    page.put(line, True)
                    page.broken(1)
            page.broken(2)
            continue
        if isinstance(x, str):
            if visible:
                page.put(x, page.pre > 0)
            continue
        tag, lists = x.tag, page.lists
        if ending == LEAVE:
            if tag in LISTS:
                lists.pop()
                page.indent = "  " * min(len(lists), INDENTED)
            elif tag in PREFORMATTED:
                page.pre -= 1
            if tag == "li":
                page.prefix = None
            page.broken(2 if tag in SPACED and not (tag in LISTS and lists) else 1)
            continue
        visible = styles.seen(x, visible)
        if visible is None:
            continue
        if tag == "br":
            if page.gap and page.out:
                page.gap = min(page.gap + 1, 2)
            page.broken(1)
        elif tag == "hr":
            page.broken(2)
        elif tag == "img":
            if visible:
                page.put(x.attributes.get("alt", ""))
        elif tag == "table" and len(pages) <= TABLES:
            cells = Cells(x, styles, visible)
            page.broken(2)
            todo.append((cells, visible, TABLE_DONE))
            for row, column, cell, seen in reversed(cells.cells):
                todo.append(((cells, (row, column)), seen, CELL_DONE))
                todo.append((cell, seen, None))
                todo.append((None, seen, CELL_BEGIN))
            todo += [(c, seen, None) for c, seen in reversed(cells.rest)]
        elif tag in BLOCKS or tag in PREFORMATTED:
            page.broken(2 if tag in SPACED and not (tag in LISTS and lists) else 1)
            if tag in LISTS:
                lists.append([tag == "ol", number(x.attributes.get("start"), 1, -ORDINAL, ORDINAL)])
                page.indent = "  " * min(len(lists), INDENTED)
            elif tag == "li":
                own = lists[-1] if lists else [False, 1]
                own[1] = number(x.attributes.get("value"), own[1], -ORDINAL, ORDINAL)
                if visible:
                    page.prefix = "  " * min(max(len(lists) - 1, 0), INDENTED) + (f"{own[1]}. " if own[0] else "- ")
                own[1] += 1
            elif tag in PREFORMATTED:
                page.pre += 1
            todo.append((x, visible, LEAVE))
            children = x.children
            if tag == "details" and "open" not in x.attributes:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            todo += [(c, visible, None) for c in reversed(children)]
        else:
            todo += [(c, visible, None) for c in reversed(x.children)]
    return pages[0].text()


def to_text(source: str) -> tuple[str, str]:
    """Rendered text and title."""
    root, sheets, title = parse(source)
    return render(root, Styles(sheets)), title


RESULT = T.StructType([T.StructField("ht_text", T.StringType()), T.StructField("ht_title", T.StringType())])


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` (its columns ``keep``) with ``ht_text`` and ``ht_title``."""
    prepare(pages.sparkSession)
    keep = [c for c in (keep or pages.columns) if c.lower() not in RESULT.names]
    rows = pages.select(*dict.fromkeys([*keep, html]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = strings(b[html])
            for s, e in slices(col):
                found = [to_text(x) for x in col[s:e].to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b[c].slice(s, e - s) for c in keep), *(pa.array([x[k] for x in found], pa.string()) for k in (0, 1))], [*keep, *RESULT.names])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), *RESULT.fields]))
