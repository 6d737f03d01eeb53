"""HTML extraction by layout-aware rendering.

A tree builder supplies the tags that authors leave out; visibility rules, from attributes, inline styles and simple style
sheets, say what is shown; a renderer writes all visible text with block spacing, list markers and aligned table cells.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import pieces

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE_RAW = frozenset("textarea title".split())
IN_HEAD = frozenset("base basefont bgsound link meta script style template title".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt listing main menu nav ol p plaintext pre search section summary table ul xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
TABLE_PARTS = frozenset("caption colgroup col tbody tfoot thead tr td th".split())
#: Blocks set off by a blank line, and blocks on lines of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote pre listing xmp plaintext figure table hr".split())
BLOCKS = SPACED | frozenset("address article aside body caption center details dialog div dd dt fieldset figcaption footer form header hgroup html legend li main nav optgroup search section summary tbody tfoot thead tr td th option".split())
LISTS = frozenset("ul ol menu dir".split())
#: Never rendered, whatever their style says.
NEVER = frozenset("area base basefont datalist head link meta noembed noframes param rp script style template title audio video canvas iframe object source track".split())
BUTTONS = frozenset("submit button reset".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: Blanks that the cells of a page's tables may take to be aligned: so many, and so many for each character of its source.
LEAST_BLANKS, MOST_BLANKS = 1 << 16, 4
#: Places of the grid that cells of a table may span: so many, and so many for each cell.
LEAST_SPANNED, MOST_SPANNED = 4096, 64
#: Elements nest no deeper; what lies below goes into the element at this depth, as in browsers.
DEPTH = 200

_MARKUP = re.compile(r"<(?=[a-zA-Z/!?])")
_START = re.compile(r"<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE = re.compile(r"<([a-zA-Z][^\s/>]*+)([^>]*+)>")
_END = re.compile(r"</([a-zA-Z][^\s/>]*+)[^>]*+>")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")
_BLANK = re.compile(r"[ \t\n\r\f]+")
_BRACE = re.compile(r"[{}]")
_SIMPLE = re.compile(r"(?:([a-zA-Z][\w-]*)|\*)?((?:[.#][\w-]+)*)$")
_COMBINED = re.compile(r"\s*>\s*|\s+")


class Node:
    __slots__ = ("attrs", "children", "names", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.parent, self.names = tag, attrs, [], None, None


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if text and not text.isspace():
        for name, value in _ATTR.findall(text):
            if value[:1] in "\"'" and value:
                value = value[1:-1]
            out.setdefault(name.lower(), entities.unescape(value) if "&" in value else value)
    return out


class Tree:
    """Builds the element tree; ``root`` is the html element, ``css`` the text of its style sheets."""

    def __init__(self, source: str):
        self.root = Node("html", {})
        self.stack = [self.root]
        self.css: list[str] = []
        self.title = ""
        self.body: Node | None = None
        self._read(source)
        stack = [self.root]
        while stack:
            node = stack.pop()
            for x in node.children:
                if isinstance(x, Node):
                    x.parent = node
                    stack.append(x)

    def _read(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            found = _MARKUP.search(s, at)
            if not found:
                self._text(s[at:])
                return
            lt = found.start()
            if lt > at:
                self._text(s[at:lt])
            after = s[lt + 1 : lt + 2]
            if after not in "/!?":
                m = _START.match(s, lt) or _LOOSE.match(s, lt)
                if not m:
                    return  # an unfinished tag at the end is dropped
                at = m.end()
                tag = m[1].lower()
                attrs = _attributes(m[2])
                if tag in RAW or tag in ESCAPABLE_RAW or tag == "plaintext":
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(s, at) if tag != "plaintext" else None
                    body = s[at : end.start()] if end else s[at:]
                    at = s.find(">", end.end()) + 1 or n if end else n
                    self._start(tag, attrs)
                    self._raw(tag, body)
                    self._end(tag)
                else:
                    self._start(tag, attrs)
                continue
            if after == "/":
                m = _END.match(s, lt)
                if m:
                    self._end(m[1].lower())
                    at = m.end()
                    continue
                gt = s.find(">", lt)
                if gt < 0:
                    self._text(s[lt:]) if lt + 2 >= n else None
                    return
                at = gt + 1
            elif s.startswith("<!--", lt):
                if s.startswith((">", "->"), lt + 4):
                    at = s.find(">", lt + 4) + 1
                    continue
                end = s.find("-->", lt + 4)
                at = end + 3 if end >= 0 else n
            else:
                gt = s.find(">", lt)
                at = gt + 1 if gt >= 0 else n

    def _raw(self, tag: str, body: str) -> None:
        if tag == "style":
            self.css.append(body)
        elif tag == "title":
            self.title = self.title or _BLANK.sub(" ", entities.unescape(body)).strip()
        elif tag in ("textarea", "xmp", "plaintext"):
            body = body.removeprefix("\r\n").removeprefix("\n")
            self.stack[-1].children.append(entities.unescape(body) if tag == "textarea" else body)

    def _text(self, s: str) -> None:
        blank = not s.strip(" \t\n\r\f")
        if not blank:
            self._leave_head()
        if "&" in s:
            s = entities.unescape(s)
        top = self.stack[-1]
        if top.tag in ("table", "tbody", "thead", "tfoot", "tr", "colgroup"):
            if not blank:
                self._foster(s)
        elif top.tag not in ("html", "head") or not blank:
            top.children.append(s)

    def _foster(self, child: Node | str) -> Node:
        """Misplaced content of a table goes before it."""
        i = max(i for i, x in enumerate(self.stack) if x.tag == "table")
        parent, table = self.stack[i - 1], self.stack[i]
        at = next((k for k in range(len(parent.children) - 1, -1, -1) if parent.children[k] is table), len(parent.children))
        parent.children.insert(at, child)
        return parent

    def _leave_head(self) -> None:
        if self.stack[-1].tag == "head":
            self.stack.pop()
        if self.body is None:
            self.body = Node("body", {})
            self.root.children.append(self.body)
            self.stack = [self.root, self.body]

    def _open(self, tag: str, within: frozenset[str] = SCOPE) -> int:
        """The place of the nearest open ``tag`` that no element of ``within`` hides, else 0."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                return i
            if self.stack[i].tag in within:
                return 0
        return 0

    def _close(self, tag: str, within: frozenset[str] = SCOPE) -> bool:
        i = self._open(tag, within)
        if i:
            del self.stack[i:]
        return bool(i)

    def _back_to(self, tags: tuple[str, ...]) -> None:
        while len(self.stack) > 2 and self.stack[-1].tag not in tags:
            self.stack.pop()

    def _push(self, node: Node) -> None:
        self.stack[-1].children.append(node)
        if len(self.stack) < DEPTH:
            self.stack.append(node)

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "html":
            self.root.attrs = attrs | self.root.attrs
            return
        if tag == "head":
            if self.body is None and self.stack[-1] is self.root:
                self._push(Node("head", attrs))
            return
        if tag == "body":
            had = self.body is not None
            self._leave_head()
            self.body.attrs = self.body.attrs | attrs if had else attrs
            return
        if self.body is None:
            if tag in IN_HEAD:
                if self.stack[-1] is self.root:
                    self._push(Node("head", {}))
            else:
                self._leave_head()
        node = Node(tag, attrs)
        top = self.stack[-1].tag
        if tag in TABLE_PARTS and self._open("table", frozenset(("template",))):
            self._table_part(node)
            return
        if tag in TABLE_PARTS:
            return  # outside of a table these tags have no meaning
        if top in ("table", "tbody", "thead", "tfoot", "tr") and tag not in ("script", "style", "template", "form"):
            if tag == "table":
                self._close("table", frozenset())
            else:
                self._foster(node)
                if tag not in VOID and len(self.stack) < DEPTH:
                    self.stack.append(node)
                return
        if tag in CLOSES_P:
            self._close("p", SCOPE | {"button"})
        if tag == "li":
            self._close("li", SCOPE | LISTS)
        elif tag in ("dt", "dd"):
            self._close("dt", SCOPE | {"dl"}) or self._close("dd", SCOPE | {"dl"})
        elif tag in HEADINGS and top in HEADINGS:
            self.stack.pop()
        elif tag in ("option", "optgroup"):
            self._close("option", SCOPE | {"select"})
            if tag == "optgroup":
                self._close("optgroup", SCOPE | {"select"})
        elif tag in ("a", "button", "nobr"):
            self._close(tag)
        elif tag in ("rt", "rp"):
            self._close("rt", SCOPE | {"ruby"}) or self._close("rp", SCOPE | {"ruby"})
        elif tag == "select" and self._close("select"):
            return
        if tag in VOID:
            self.stack[-1].children.append(node)
        else:
            self._push(node)

    def _table_part(self, node: Node) -> None:
        tag = node.tag
        if tag in ("td", "th"):
            self._back_to(("tr", "tbody", "thead", "tfoot", "table"))
            if self.stack[-1].tag == "table":
                self._push(Node("tbody", {}))
            if self.stack[-1].tag != "tr":
                self._push(Node("tr", {}))
        elif tag == "tr":
            self._back_to(("tbody", "thead", "tfoot", "table"))
            if self.stack[-1].tag == "table":
                self._push(Node("tbody", {}))
        elif tag == "col":
            self._back_to(("colgroup", "table"))
            return
        else:
            self._back_to(("table",))
        self._push(node)

    def _end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "head":
            if self.stack[-1].tag == "head":
                self.stack.pop()
            return
        if tag == "br":
            self._start("br", {})
        elif tag == "p" and not self._open("p", SCOPE | {"button"}):
            self._start("p", {})
            self._close("p")
        elif tag in HEADINGS:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in HEADINGS:
                    del self.stack[i:]
                    return
                if self.stack[i].tag in SCOPE:
                    return
        elif tag == "table":
            self._close("table", frozenset(("template",)))
        elif tag in ("tr", "tbody", "thead", "tfoot", "td", "th", "caption"):
            self._close(tag, frozenset(("table", "template")))
        elif tag == "li":
            self._close("li", SCOPE | LISTS)
        elif tag in FORMATTING:
            i = self._open(tag)
            if i and any(x.tag in BLOCKS for x in self.stack[i + 1 :]):
                del self.stack[i]  # blocks that were opened inside go on
            elif i:
                del self.stack[i:]
        else:
            self._close(tag, SCOPE if tag in BLOCKS else SCOPE | BLOCKS)


def _declared(style: str) -> dict[str, tuple[bool, str]]:
    """Of each property whether it is important, and its value; the last one counts, but for important ones before it."""
    out: dict[str, tuple[bool, str]] = {}
    for part in style.split(";"):
        name, _, value = part.partition(":")
        if value:
            bare = value.strip().lower()
            important = bare.endswith("important") and bare[:-9].rstrip().endswith("!")
            if important:
                bare = bare[:-9].rstrip()[:-1].rstrip()
            name = name.strip().lower()
            if important or not out.get(name, (False, ""))[0]:
                out[name] = important, bare
    return out


def _for_screens(head: str) -> bool:
    """Whether a block of rules holds on any screen, whatever its size."""
    if not head.lstrip().lower().startswith("@media"):
        return False
    kinds = (re.sub(r"^only\s+", "", x.strip().lower()) for x in head.strip()[6:].split(","))
    return any(k in ("", "screen", "all") for k in kinds)


def _rules(sheet: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations, in one pass. Blocks for screens and all media are looked into; what other at-rules hold
    depends on more and is left out."""
    head, last, skip = None, 0, 0
    for m in _BRACE.finditer(sheet):
        if m[0] == "{":
            if skip:
                skip += 1
                continue
            head, last = sheet[last : m.start()].rpartition(";")[2], m.end()
            if head.lstrip().startswith("@"):
                skip = 0 if _for_screens(head) else 1
                head = None
        elif skip:
            skip -= 1
            last = m.end()
        else:
            if head is not None:
                yield head, sheet[last : m.start()]
            head, last = None, m.end()


class Visibility:
    """What simple selectors of style sheets, attributes and inline styles say of an element. As in browsers, important
    declarations count most, then inline ones, then ids, classes and tags in the selector, then the later one."""

    def __init__(self, sheets: list[str]):
        #: rules by one name that an element must have: a class, an id, a tag, or none
        self.rules: dict[str, list[tuple[list[Compound], tuple, dict[str, tuple[bool, str]]]]] = {}
        self.combined = False
        order = 0
        for sheet in sheets:
            if "none" not in sheet and "hidden" not in sheet and "collapse" not in sheet:
                continue
            for selectors, body in _rules(_without_comments(sheet)):
                said = {k: v for k, v in _declared(body).items() if k in ("display", "visibility")}
                for sel in selectors.split(",") if said else ():
                    chain = _chain(sel.strip())
                    if chain:
                        order += 1
                        names = [x for _, need, _ in chain for x in need]
                        ids = sum(x[0] == "#" for x in names)
                        rank = (0, ids, len(names) - ids, sum(bool(tag) for tag, _, _ in chain), order)
                        tag, need, _ = chain[-1]
                        self.combined |= len(chain) > 1
                        self.rules.setdefault(min(need) if need else tag or "*", []).append((chain, rank, said))
        #: what rules said of elements with the same tag, class and id; where selectors look at ancestors, it isn't kept
        self.known: dict[tuple, dict[str, tuple[tuple, str]]] = {}
        self.answers: dict[tuple[int, int], bool] = {}

    def of(self, node: Node, inherited: bool) -> tuple[bool, bool]:
        """Whether the element takes part in the layout, and whether its own text is seen."""
        if node.tag in NEVER:
            return False, False
        a, said = node.attrs, {}
        if self.rules:
            key = node.tag, a.get("class"), a.get("id")
            if self.combined or key not in self.known:
                names = _names(node)
                for k in (node.tag, "*", *names):
                    for chain, rank, what in self.rules.get(k, ()):
                        if _fits(chain[-1], node, names) and (len(chain) == 1 or self.above(chain, node)):
                            _cascade(said, what, rank)
                if not self.combined:
                    self.known[key] = said
            said = dict(said if self.combined else self.known[key])
        if "style" in a:
            _cascade(said, _declared(a["style"]), (1,))
        display = said["display"][1] if "display" in said else "none" if "hidden" in a and a["hidden"].lower() != "until-found" else ""
        shown = display != "none" and not (node.tag == "dialog" and "open" not in a) and not (node.tag == "input" and a.get("type", "").lower() == "hidden")
        return shown, _seen(said["visibility"][1] if "visibility" in said else None, inherited)


    def above(self, chain: list[Compound], node: Node) -> bool:
        """Whether ancestors fit the compounds before the last; siblings share the answer. All places are followed at once, so
        it takes the chain's length times the depth."""
        key = id(chain), id(node.parent)
        if key not in self.answers:
            ancestors = []
            while node.parent is not None:
                node = node.parent
                ancestors.append(node)
            fit = {-1}
            for i in range(len(chain) - 2, -1, -1):
                places = (k + 1 for k in fit) if chain[i + 1][2] else range(min(fit) + 1, len(ancestors))
                fit = {k for k in places if k < len(ancestors) and _fits(chain[i], ancestors[k], _names(ancestors[k]))}
                if not fit:
                    break
            self.answers[key] = bool(fit)
        return self.answers[key]


#: A tag or none, classes and ids that are needed, and whether what stands before must be the parent.
Compound = tuple[str, frozenset[str], bool]


def _chain(selector: str) -> list[Compound]:
    """The compounds of a selector of tags, classes and ids below one another; empty if it has anything else."""
    out, at, child = [], 0, False
    while selector:
        m = _COMBINED.search(selector, at)
        part = _SIMPLE.match(selector[at : m.start()] if m else selector[at:])
        if not part or not part[0]:
            return []
        out.append(((part[1] or "").lower(), frozenset(re.findall(r"[.#][\w-]+", part[2])), child))
        if not m:
            break
        at, child = m.end(), ">" in m[0]
    return out


def _names(node: Node) -> set[str]:
    """Classes and ids of an element as selectors write them."""
    if node.names is None:
        node.names = _named(node.attrs)
    return node.names


def _named(a: dict[str, str]) -> set[str]:
    return ({f".{c}" for c in a.get("class", "").split()} | ({f"#{a['id']}"} if "id" in a else set())) if a else set()


def _fits(compound: Compound, node: Node, names: set[str]) -> bool:
    return compound[0] in ("", node.tag) and names.issuperset(compound[1])


def _cascade(said: dict[str, tuple[tuple, str]], what: dict[str, tuple[bool, str]], rank: tuple) -> None:
    for name, (important, value) in what.items():
        if name not in said or (important, rank) >= said[name][0]:
            said[name] = (important, rank), value


def _without_comments(sheet: str) -> str:
    out, at = [], 0
    while (i := sheet.find("/*", at)) >= 0:
        out.append(sheet[at:i])
        j = sheet.find("*/", i + 2)
        at = len(sheet) if j < 0 else j + 2
    return "".join([*out, sheet[at:]])


def _seen(visibility: str | None, inherited: bool) -> bool:
    return inherited if visibility in (None, "inherit") else visibility not in ("hidden", "collapse")


def width(s: str) -> int:
    """Columns of a terminal."""
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Page:
    """Lines of text in the making."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line = ""
        self.space = False
        self.gap = 0  # blank lines asked for before the next text
        self.indents: list[str] = []
        self.marker = ""

    def _begin(self) -> None:
        if self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0
        if self.marker:
            self.line = "".join(self.indents[:-1]) + self.marker
            self.marker = ""
        else:
            self.line = "".join(self.indents)
        self.fresh = False
        self.started = True

    started = False

    def text(self, s: str) -> None:
        words = _BLANK.sub(" ", s)
        if words.startswith(" "):
            self.space, words = True, words[1:]
        tail = words.endswith(" ")
        words = words.rstrip(" ")
        if words:
            if not self.started:
                self._begin()
                self.space = False
            self.line += (" " if self.space else "") + words
            self.space = False
        self.space |= tail

    def exact(self, s: str) -> None:
        for i, part in enumerate(s.replace("\r\n", "\n").split("\n")):
            if i:
                self.newline()
            if part:
                if not self.started:
                    self._begin()
                self.line += part.expandtabs(8)

    def newline(self) -> None:
        if not self.started:
            self._begin()
        self._flush()

    def _flush(self) -> None:
        self.lines.append(self.line.rstrip(" "))
        self.line, self.started, self.space = "", False, False

    def block(self, gap: int) -> None:
        """Ends the line; the next text starts ``gap`` lines further down at least."""
        if self.started:
            self._flush()
        self.space = False
        if not self.marker:
            self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        if self.started:
            self._flush()
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        while self.lines and not self.lines[0].strip():
            self.lines.pop(0)
        return [x.replace("\xa0", " ") for x in self.lines]


class Renderer:
    def __init__(self, tree: Tree, scripting: bool = False, blanks: int = 1 << 20):
        #: ``blanks`` may be written to align cells; tables that would take more are written without
        self.rules, self.scripting, self.blanks = Visibility(tree.css), scripting, blanks

    def render(self, node: Node) -> list[str]:
        page = Page()
        shown, seen = self.rules.of(node, True)
        if shown:
            self.children(node, page, seen, False)
        return page.done()

    def children(self, node: Node, page: Page, seen: bool, pre: bool) -> None:
        for x in node.children:
            if isinstance(x, str):
                if seen:
                    page.exact(x) if pre else page.text(x)
            else:
                self.element(x, page, seen, pre)

    def element(self, node: Node, page: Page, seen: bool, pre: bool) -> None:
        shown, seen = self.rules.of(node, seen)
        tag = node.tag
        if not shown or (tag == "noscript" and self.scripting):
            return
        if tag == "br":
            page.newline()
        elif tag == "hr":
            page.block(2)
            page.text("-" * 8)
            page.block(2)
        elif tag == "input":
            if seen and node.attrs.get("type", "").lower() in BUTTONS and node.attrs.get("value"):
                page.text(node.attrs["value"])
        elif tag == "q":
            page.text("“") if seen else None
            self.children(node, page, seen, pre)
            page.text("”") if seen else None
        elif tag == "select":
            self.select(node, page, seen)
        elif tag in LISTS:
            self.list(node, page, seen)
        elif tag == "table":
            self.table(node, page, seen)
        elif tag == "details" and "open" not in node.attrs:
            page.block(1)
            first = next((x for x in node.children if isinstance(x, Node) and x.tag == "summary"), None)
            if first:
                self.element(first, page, seen, pre)
            page.block(1)
        elif tag in BLOCKS:
            gap = 2 if tag in SPACED else 1
            page.block(gap)
            deeper = {"blockquote": "  ", "dd": "    "}.get(tag)
            if deeper:
                page.indents.append(deeper)
            if tag in ("pre", "listing") and node.children and isinstance(node.children[0], str):
                node.children[0] = node.children[0].removeprefix("\r\n").removeprefix("\n")  # no part of the content
            self.children(node, page, seen, pre or tag in ("pre", "listing", "xmp", "plaintext"))
            page.block(gap)
            if deeper:
                page.indents.pop()
        else:
            self.children(node, page, seen, pre or tag == "textarea")

    def select(self, node: Node, page: Page, seen: bool) -> None:
        options, stack = [], list(reversed(node.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                if x.tag == "option":
                    options.append(x)
                else:
                    stack += reversed(x.children)
        many = "multiple" in node.attrs or node.attrs.get("size", "1") not in ("", "0", "1")
        chosen = options if many else ([x for x in options if "selected" in x.attrs] or options)[-1:] if any("selected" in x.attrs for x in options) else options[: None if many else 1]
        for x in chosen:
            page.text(" ")
            self.element_inline(x, page, seen)
            page.text(" ")

    def element_inline(self, node: Node, page: Page, seen: bool) -> None:
        shown, seen = self.rules.of(node, seen)
        if shown:
            self.children(node, page, seen, False)

    def list(self, node: Node, page: Page, seen: bool) -> None:
        gap = 1 if page.indents else 2
        page.block(gap)
        number = int(node.attrs["start"]) if re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")) else 1
        step = 1
        if node.tag == "ol" and "reversed" in node.attrs:
            step = -1
            if "start" not in node.attrs:
                number = sum(isinstance(x, Node) and x.tag == "li" for x in node.children)
        for x in node.children:
            if isinstance(x, str):
                page.text(x) if seen else None
                continue
            if x.tag != "li":
                self.element(x, page, seen, False)
                continue
            shown, own = self.rules.of(x, seen)
            if not shown:
                continue
            if re.fullmatch(r"-?\d{1,9}", x.attrs.get("value", "")):
                number = int(x.attrs["value"])
            marker = f"{_ordinal(number, node.attrs.get('type', '1'))}. " if node.tag == "ol" else "- "
            number += step
            page.block(1)
            page.indents.append(" " * len(marker))
            page.marker = marker
            self.children(x, page, own, False)
            page.marker = ""
            page.block(1)
            page.indents.pop()
        page.block(gap)

    def table(self, node: Node, page: Page, seen: bool) -> None:
        page.block(2)
        rows: dict[str, list[tuple[Node, bool]]] = {"thead": [], "tbody": [], "tfoot": []}
        for part in node.children:
            if isinstance(part, str):
                continue
            shown, own = self.rules.of(part, seen)
            if not shown:
                continue
            if part.tag == "caption":
                self.children(part, page, own, False)
                page.block(1)
            elif part.tag in rows:
                rows[part.tag] += [(x, own) for x in part.children if isinstance(x, Node) and x.tag == "tr"]
        found: list[list[tuple[list[str], int, int]]] = []
        for row, own in [*rows["thead"], *rows["tbody"], *rows["tfoot"]]:
            shown, own = self.rules.of(row, own)
            if not shown:
                continue
            cells = []
            for x in row.children:
                if not isinstance(x, Node) or x.tag not in ("td", "th"):
                    continue
                shown, mine = self.rules.of(x, own)
                if shown:
                    inner = Page()
                    self.children(x, inner, mine, False)
                    cells.append((inner.done(), _span(x.attrs.get("colspan"), 1000), _span(x.attrs.get("rowspan"), 65534)))
            found.append(cells)
        self.grid(found, page)
        page.block(2)

    def grid(self, rows: list[list[tuple[list[str], int, int]]], page: Page) -> None:
        if all(len(cells) <= 1 for cells in rows):  # one column: plain blocks
            for cells in rows:
                for lines, _, _ in cells:
                    page.block(1)
                    page.exact("\n".join(lines))
                    page.block(1)
            return
        columns = self.columns(rows)
        for i, cells in enumerate(rows):
            starts = columns[i] if columns else [0] * len(cells)
            for k in range(max((len(lines) for lines, _, _ in cells), default=0)):
                parts, used = [], 0
                for (lines, _, _), start in zip(cells, starts, strict=True):
                    if k < len(lines) and lines[k]:
                        parts.append(" " * (start - used if columns else 2 * bool(parts)) + lines[k])
                        used = start + width(lines[k])
                line = "".join(parts)
                page.block(1)
                if line.strip():
                    page.exact(line)
        page.block(1)

    def columns(self, rows: list[list[tuple[list[str], int, int]]]) -> list[list[int]] | None:
        """Where each cell begins, in characters; None if cells span or alignment takes more than the page's share.

        A column in which no cell begins has no width.
        """
        cells = sum(map(len, rows))
        area = sum(across * min(down, len(rows) - i) for i, row in enumerate(rows) for _, across, down in row)
        if area > LEAST_SPANNED + MOST_SPANNED * cells:
            return None
        places: list[list[int]] = []
        held: dict[int, int] = {}  # columns that a cell from above still takes, and for how many rows
        for row in rows:
            col, at = 0, []
            for _, across, down in row:
                while held.get(col):
                    col += 1
                at.append(col)
                for c in range(col, col + across):
                    held[c] = down
                col += across
            held = {c: n - 1 for c, n in held.items() if n > 1}
            places.append(at)
        begun = sorted({c for at in places for c in at})
        wide = dict.fromkeys(begun, 0)
        most = [[max(map(width, lines), default=0) for lines, _, _ in row] for row in rows]
        for at, row, w in zip(places, rows, most, strict=True):
            for c, (_, across, _), n in zip(at, row, w, strict=True):
                if across == 1:
                    wide[c] = max(wide[c], n)
        for at, row, w in zip(places, rows, most, strict=True):
            for c, (_, across, _), n in zip(at, row, w, strict=True):
                if across > 1:  # a spanning cell widens the last of its columns if need be
                    first, last = bisect_left(begun, c), bisect_left(begun, c + across) - 1
                    rest = n - sum(wide[k] + 2 for k in begun[first:last])
                    wide[begun[last]] = max(wide[begun[last]], rest, 0)
        start, x = {}, 0
        for c in begun:
            start[c] = x
            x += wide[c] + 2
        blanks = sum(start[at[-1]] * max(len(lines) for lines, _, _ in row) for at, row in zip(places, rows, strict=True) if row)
        if blanks > self.blanks:
            return None
        self.blanks -= blanks
        return [[start[c] for c in at] for at in places]


def _span(value: str | None, most: int) -> int:
    return min(most, int(value)) or 1 if value and value.isascii() and value.isdigit() and len(value) < 9 else 1


def _ordinal(n: int, kind: str) -> str:
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(ord(kind) + r) + out
        return out
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for v, s in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            while n >= v:
                out, n = out + s, n - v
        return out if kind == "i" else out.upper()
    return str(n)


def render(source: str | None, scripting: bool = False) -> tuple[str, str]:
    """The title and the visible text."""
    if not source:
        return "", ""
    tree = Tree(source)
    body = tree.body
    return tree.title, "\n".join(Renderer(tree, scripting, LEAST_BLANKS + MOST_BLANKS * len(source)).render(body)) if body else ""


def extract(pages: DataFrame, scripting: bool = False) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``page_id, url, title, text, n_chars``, a row per input row.

    ``scripting`` hides noscript elements. A null or empty page has an empty title and text. Broken markup is repaired
    as browsers do it in the main; unfinished tags at the end are dropped. Elements nest 200 deep, with deeper content
    kept at that depth. Other columns are not looked at. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 128):
                title, text = zip(*(render(x, scripting) for x in part.column("html").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(title, pa.string()), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "title", "text", "n_chars"])

    out = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, title string, text string, n_chars long"
    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, out)
