"""HTML to blocks: a small tree builder and a walk by element kind.

The builder repairs what the HTML standard repairs in common pages: implied ends
of paragraphs, items and cells, raw-text elements, void elements, and formatting
elements that stay open across blocks.  Styles come from tags and from style
attributes (weight, slant, fixed pitch, capitals, hidden); style sheets aren't read.
"""

from __future__ import annotations

import functools
import html as references
import re
from collections.abc import Callable
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.operators.runs import merged, trim_runs
from docloom.operators.textblocks import S, exploded

#: Element kinds.
SKIPPED = frozenset("script style noscript template iframe head button input select textarea canvas video audio".split())
CONTAINERS = frozenset("div section article main header footer aside nav body form details summary figure".split())
INLINE = frozenset("strong b em i code kbd samp a br span small sub sup mark u s abbr time img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title iframe noscript xmp".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
SCOPES = frozenset("td th caption table html button object marquee applet".split())
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)>""")
BARE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>", re.S)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH, SPACES = frozenset(["p"]), re.compile(f"{S}+")
CLOSED = re.compile(r"&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

NAMES = ["ord", "kind", "level", "ordered", "index", "depth", "text", "lang", "src", "runs", "header", "rows"]
RUN_TYPE = pa.list_(pa.struct([("text", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_()), ("code", pa.bool_()), ("href", pa.string())]))
TYPES = [pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), RUN_TYPE, pa.list_(pa.string()), pa.list_(pa.list_(pa.string()))]
SCHEMA = (
    "ord int, kind string, level int, ordered boolean, index int, depth int, text string, lang string, src string, "
    "runs array<struct<text:string,bold:boolean,italic:boolean,code:boolean,href:string>>, header array<string>, rows array<array<string>>"
)


class Element:
    __slots__ = ("tag", "attrs", "nodes", "open")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.nodes, self.open = tag, attrs, [], False

    @property
    def children(self) -> list[Element]:
        return [n for n in self.nodes if isinstance(n, Element)]

    def descend(self):
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack += reversed(e.children)

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack += reversed(n.nodes)
        return "".join(out)


class Builder:
    """Open elements with the places of each tag, so that no search runs down the stack."""

    def __init__(self):
        self.root = Element("html", {})
        self.body = Element("body", {})
        self.root.nodes.append(self.body)
        self.stack = [self.root, self.body]
        self.places: dict[str, list[int]] = {}
        self.formats: list[Element | None] = []  # None marks a cell's border

    def push(self, e: Element) -> None:
        self.places.setdefault(e.tag, []).append(len(self.stack))
        self.stack.append(e)
        e.open = True

    def pop(self) -> Element:
        e = self.stack.pop()
        self.places[e.tag].pop()
        e.open = False
        return e

    def last(self, tags) -> int:
        """The topmost open element of the tags, 0 for none."""
        found = 0
        for t in tags:
            places = self.places.get(t)
            if places and places[-1] > found:
                found = places[-1]
        return found

    def cut(self, k: int) -> None:
        """Closes the open elements from place k on; a cell takes its border with it."""
        cells = 0
        while len(self.stack) > k:
            cells += self.pop().tag in ("td", "th")
        while cells and self.formats:
            cells -= self.formats.pop() is None

    def close_to(self, tags: frozenset, limits: frozenset) -> None:
        """Tags and limits have nothing in common."""
        k = self.last(tags)
        if k and k > self.last(limits):
            self.cut(k)

    def reopen(self) -> None:
        """Formatting elements that a block's end closed open again."""
        begin = len(self.formats)
        if not begin:
            return
        while begin and self.formats[begin - 1] is not None and not self.formats[begin - 1].open:
            begin -= 1
        for k in range(begin, len(self.formats)):
            again = Element(self.formats[k].tag, self.formats[k].attrs)
            self.stack[-1].nodes.append(again)
            self.push(again)
            self.formats[k] = again

    def text(self, value: str) -> None:
        if value.strip(" \t\n\f\r"):
            self.reopen()
        if self.stack[-1].tag not in ("table", "tr", "tbody", "thead", "tfoot") or value.strip():
            self.stack[-1].nodes.append(value)

    def format(self, e: Element) -> None:
        """Of equal formatting elements the last three stay in the list, as in browsers."""
        alike = []
        for k in range(len(self.formats) - 1, max(-1, len(self.formats) - 64), -1):
            if self.formats[k] is None:
                break
            if self.formats[k].tag == e.tag and self.formats[k].attrs == e.attrs:
                alike.append(k)
        if len(alike) >= 3:
            del self.formats[alike[2]]
        self.formats.append(e)

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag in ("html", "head", "body"):
            if tag == "body":
                self.body.attrs = attrs | self.body.attrs
            return
        if tag in CLOSES_P:
            self.close_to(PARAGRAPH, SCOPES)
        if tag in IMPLIED:
            self.close_to(*IMPLIED[tag])
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.pop()
        if tag in ("td", "th"):
            if self.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                self.start("tr", {}, False)
            self.formats.append(None)
        elif tag == "tr" and self.stack[-1].tag == "table":
            self.start("tbody", {}, False)
        if tag == "a" and any(f is not None and f.tag == "a" for f in self.formats):
            self.end("a")
        if tag in FORMATTING or tag in INLINE:
            self.reopen()
        e = Element(tag, attrs)
        self.stack[-1].nodes.append(e)
        if tag in VOID or (closed and tag in ("svg", "path")):
            return
        self.push(e)
        if tag in FORMATTING:
            self.format(e)

    def end(self, tag: str) -> None:
        if tag == "p" and not self.places.get("p"):
            self.start("p", {}, False)
        if tag in ("html", "body", "head"):
            return
        if tag in FORMATTING:
            for k in range(len(self.formats) - 1, -1, -1):
                if self.formats[k] is None:
                    break
                if self.formats[k].tag == tag:
                    gone = self.formats.pop(k)
                    if gone.open:
                        while self.pop() is not gone:
                            pass
                    return
            return
        k = self.last([tag])
        if k:
            limits = frozenset(["table"]) if tag in ("table", "tbody", "thead", "tfoot", "tr") else SCOPES
            if k > self.last(limits - {tag}):
                self.cut(k)


def unescape_closed(text: str) -> str:
    """Character references that end in a semicolon; browsers also read some that don't, like &amp at a text's cut end."""
    return CLOSED.sub(lambda m: references.unescape(m[0]) if m[1][0] == "#" or f"{m[1]};" in html5 else m[0], text)


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def tags_of(page: str):
    """(text before, tag match or None, place behind) of all tags and other markup, in linear time.

    The caller may send a place to go on from.  A < that opens nothing is text; where every
    > behind is quoted, quotes hide none from there on.
    """
    at, last, quotes, begin = 0, page.rfind(">"), True, 0
    while True:
        lt = page.find("<", at) if at <= last else -1
        if lt < 0 or lt > last:
            yield page[begin:], None, len(page)
            return
        m = (TAG if quotes else BARE_TAG).match(page, lt)
        other = None if m else OTHER.match(page, lt)
        if not m and not other:
            if quotes and BARE_TAG.match(page, lt):
                quotes, at = False, lt
            else:
                at = lt + 1
            continue
        stop = (m or other).end()
        asked = yield page[begin:lt], m, stop
        begin = at = stop if asked is None else asked


def build(page: str, unescape: Callable[[str], str] = references.unescape) -> Element:
    """The body element of a page; unescape reads the character references of its texts."""
    tree, in_head, tags, asked = Builder(), False, tags_of(page), None
    while True:
        try:
            plain, m, at = tags.send(asked)
        except StopIteration:
            return tree.body
        asked = None
        if plain and not in_head:
            tree.text(unescape(plain))
        if not m:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "head":
            in_head = not closing
        elif in_head and not closing and tag not in RAW_TEXT and tag not in ("meta", "link", "base", "template"):
            in_head = False
        if closing:
            tree.end(tag)
            continue
        if tag in RAW_TEXT:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            content, asked = page[at : close.start() if close else len(page)], close.end() if close else len(page)
            if not in_head:
                tree.start(tag, attributes(m[3]), False)
                tree.stack[-1].nodes.append(content)
                tree.pop()
        elif not in_head or tag not in ("meta", "link", "base"):
            tree.start(tag, attributes(m[3]), m[3].endswith("/"))


def collapse(text: str) -> str:
    return SPACES.sub(" ", text)


def declared(e: Element) -> dict[str, str]:
    """Declarations of an element's style attribute."""
    parts = (d.partition(":") for d in e.attrs.get("style", "").split(";"))
    return {k.strip().lower(): v.strip().lower() for k, _, v in parts if v}


def is_hidden(e: Element) -> bool:
    style = declared(e) if "style" in e.attrs else {}
    return "hidden" in e.attrs or style.get("display") == "none" or style.get("visibility") == "hidden"


def styled(e: Element, style: dict) -> dict:
    """A run's style inside an element: by its tag, then by its style attribute (weight, slant, family, case)."""
    if e.tag in ("strong", "b"):
        style = style | {"bold": True}
    elif e.tag in ("em", "i"):
        style = style | {"italic": True}
    elif e.tag in ("code", "kbd", "samp"):
        style = style | {"code": True}
    elif e.tag == "a" and re.match("(?i)https?://", e.attrs.get("href", "")):
        style = style | {"href": e.attrs["href"]}
    if "style" not in e.attrs:
        return style
    css = declared(e)
    weight = css.get("font-weight", "")
    if weight:
        style = style | {"bold": weight in ("bold", "bolder") or (weight.isdigit() and int(weight) >= 600)}
    if "font-style" in css:
        style = style | {"italic": css["font-style"] in ("italic", "oblique")}
    if re.search("mono|courier|consolas|menlo", css.get("font-family", "")):
        style = style | {"code": True}
    if "text-transform" in css:
        style = style | {"upper": css["text-transform"] == "uppercase"}
    return style


def inline_runs(e: Element) -> list[dict]:
    """Runs of an element's inline content; nested lists are left out."""
    none = {"bold": False, "italic": False, "code": False, "href": None}
    out: list[dict] = []
    stack: list[tuple] = [(n, styled(e, none)) for n in reversed(e.nodes)]
    while stack:
        n, style = stack.pop()
        if isinstance(n, str):
            text = collapse(n)
            if "upper" in style:
                out.append({k: v for k, v in style.items() if k != "upper"} | {"text": text.upper() if style["upper"] else text})
            else:
                out.append(style | {"text": text})
        elif n.tag == "br":
            out.append({"text": " "} | none)
        elif n.tag not in ("ul", "ol") and n.tag not in SKIPPED and not is_hidden(n):
            inner = styled(n, style)
            stack += [(c, inner) for c in reversed(n.nodes)]
    return merged(out)


def block(kind: str, runs=None, text=None, level=None, ordered=None, index=None, depth=None, lang=None, src=None, header=None, rows=None) -> tuple:
    return kind, level, ordered, index, depth, "".join(r["text"] for r in runs) if runs is not None else text, lang, src, runs, header, rows


def with_runs(kind: str, e: Element, **more) -> list[tuple]:
    runs = trim_runs(inline_runs(e))  # merged, and so they stay
    return [block(kind, runs, **more)] if any(r["text"].strip() for r in runs) else []


def table(e: Element) -> list[tuple]:
    """Header and rows: the first row of a head, or a first row with header cells."""
    head = [r for s in e.children if s.tag == "thead" for r in s.children if r.tag == "tr"]
    body = [r for s in e.children for r in (s.children if s.tag == "tbody" else [s] if s.tag == "tr" else []) if r.tag == "tr"]
    every = head + body
    if not every:
        return []
    cells = lambda row: [collapse(c.text()).strip() for c in row.children if c.tag in ("td", "th")]
    first = head[0] if head else every[0] if any(c.tag == "th" for c in every[0].children) else None
    header = cells(first) if first is not None else []
    rows = [c for r in every if r is not first and any(c := cells(r))]
    return [block("table", header=header, rows=rows)] if header or rows else []


def image(e: Element, caption: str | None = None) -> list[tuple]:
    return [block("image", text=caption, src=e.attrs.get("src"))]


def walk(body: Element) -> list[tuple]:
    """Blocks in page order; elements wait on a stack with their list depth, blocks as they are."""
    out: list[tuple] = []
    waiting: list[tuple] = [(body, 0)]
    while waiting:
        e, depth = waiting.pop()
        if not isinstance(e, Element):
            out += e
            continue
        found, inner = own_blocks(e, depth)
        out += found
        waiting += reversed(inner)
    return out


def own_blocks(e: Element, depth: int) -> tuple[list[tuple], list[tuple]]:
    """An element's blocks, and what follows: (element or blocks, depth)."""
    if e.tag in SKIPPED or is_hidden(e):
        return [], []
    if e.tag in HEADINGS:
        return with_runs("heading", e, level=min(3, int(e.tag[1]))), []
    if e.tag in ("p", "blockquote"):
        return with_runs("paragraph" if e.tag == "p" else "blockquote", e), []
    if e.tag == "pre":
        code = next((x for x in e.descend() if x.tag == "code"), None)
        lang = re.search(r"language-(\w+)", code.attrs.get("class", "")) if code else None
        text = e.text().strip("\n")
        return [block("code", text=text, lang=lang[1] if lang else None)] if text.strip() else [], []
    if e.tag in ("ul", "ol"):
        given = re.fullmatch(r"\s*(-?\d{1,9})\s*", e.attrs.get("start", "1"))
        start, inner = (int(given[1]) if given else 1) or 1, []
        for k, li in enumerate(c for c in e.children if c.tag == "li"):
            inner.append((with_runs("listItem", li, ordered=e.tag == "ol", index=start + k, depth=depth), depth))
            inner += [(nested, depth + 1) for nested in li.children if nested.tag in ("ul", "ol")]
        return [], inner
    if e.tag == "table":
        return table(e), []
    if e.tag == "hr":
        return [block("hr")], []
    if e.tag == "img":
        return image(e), []
    if e.tag == "figure":
        img = next((c for c in e.children if c.tag == "img"), None)
        caption = next((collapse(c.text()).strip() for c in e.children if c.tag == "figcaption"), "")
        if img is not None:
            return image(img, caption or None), []
    if e.tag in CONTAINERS:
        if e.tag != "body" and all(c.tag in INLINE for c in e.descend() if c is not e):
            return with_runs("paragraph", e) + [b for c in e.descend() if c.tag == "img" for b in image(c)], []
        inner = [(c, depth) for c in e.children]
        loose = collapse(" ".join(n for n in e.nodes if isinstance(n, str))).strip()
        if loose:
            inner.append(([block("paragraph", [{"text": loose, "bold": False, "italic": False, "code": False, "href": None}])], depth))
        return [], inner
    return with_runs("paragraph", e), []


def parse_html(page: str, closed_references: bool = False) -> list[tuple]:
    return walk(build(page, unescape_closed if closed_references else references.unescape))


def html_to_blocks(df: DataFrame, id_col: str = "page_id", html_col: str = "html", closed_references: bool = False) -> DataFrame:
    """Blocks of pages.  closed_references: texts have only those character references that end in a
    semicolon; browsers, and this by default, also read the old ones without."""
    parse = functools.partial(parse_html, closed_references=closed_references)
    return exploded(df, id_col, html_col, parse, SCHEMA, NAMES, TYPES)
