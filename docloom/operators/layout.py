"""Blocks to pages: wrapping, page breaks, tables and code, as rows of drawn pieces.

A document's blocks are laid out one after the other, as every block's place
depends on the space the one before has left; documents are independent groups.
The result names pages, positions, faces and texts, and a writer turns it into a file.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.fonts import MONO, SCRIPT_FONTS, face_of, is_registered, register_metrics, text_width, words_and_spaces
from docloom.functions.geometry import A4
from docloom.functions.text import CP1252_EXTRA
from docloom.operators.grouped import map_groups
from docloom.operators.textblocks import LAST_PLAIN

#: Sizes, ratios and gaps of the layout.
MARGIN, BODY, RATIO = 72.0, 11.0, 1.5
HEADINGS = {1: (23.0, 20.0), 2: (17.0, 17.0), 3: (13.0, 13.0)}
CODE_SIZE, CODE_RATIO, CODE_PAD = 9.5, 1.4, 6.0
TABLE_SIZE, TABLE_RATIO, CELL_PAD, LEAST_COLUMN = 9.5, 1.35, 4.0, 40.0
GAPS = {"heading": 6.0, "paragraph": 8.0, "splitRow": 2.0, "listItem": 4.0, "blockquote": 8.0, "code": 8.0, "table": 10.0, "image": 10.0, "hr": 10.0}
INDENT, CAPTION = 18.0, 16.0
CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f]")
UNSHOWN = re.compile(rf"[^\x20-\x7e\xa0-\xff{CP1252_EXTRA}]")
SCRIPTS = re.compile("[\u0600-\u06ff\u0750-\u077f\u0900-\u097f]")


@dataclass
class Piece:
    text: str
    face: str
    size: float
    href: str | None = None

    @property
    def width(self) -> float:
        return text_width(self.text, self.face, self.size)


@dataclass
class Layout:
    width: float = A4[0]
    height: float = A4[1]
    margin: float = MARGIN
    page: int = 0
    drawn: list[tuple] = field(default_factory=list)
    fallback: str | None = None  # the face of words that code page 1252 can't show
    degrade: bool = False  # no such face: their characters become question marks

    def __post_init__(self):
        self.y = self.height - self.margin

    @property
    def room(self) -> float:
        return self.y - self.margin

    @property
    def content(self) -> float:
        return self.width - 2 * self.margin

    def turn(self) -> None:
        self.page += 1
        self.y = self.height - self.margin

    def need(self, h: float) -> None:
        if self.room < h:
            self.turn()

    def gap(self, h: float) -> None:
        if self.y < self.height - self.margin - 0.01:
            self.y = max(self.y - h, self.margin)

    def put(self, kind: str, x: float, y: float, w: float = 0.0, h: float = 0.0, text: str | None = None, face: str | None = None, size: float | None = None, href: str | None = None, page: int | None = None) -> None:
        self.drawn.append((self.page if page is None else page, kind, round(x, 6), round(y, 6), round(w, 6), round(h, 6), text, face, size, href))

    def line(self, pieces: list[Piece], x: float, w: float, h: float, size: float, align: str = "left") -> None:
        """One line of pieces at the cursor."""
        self.need(h)
        self.y -= h
        used = sum(p.width for p in pieces)
        x += {"left": 0.0, "center": (w - used) / 2, "right": w - used}.get(align, 0.0)
        self.pieces(pieces, x, self.y + (h - size) / 2)

    def pieces(self, pieces: list[Piece], x: float, baseline: float) -> None:
        for p in pieces:
            if p.text.strip():
                self.put("text", x, baseline, p.width, p.size, p.text, p.face, p.size, p.href)
                if p.href:
                    self.put("underline", x, baseline - 1.5, p.width, 0.5)
                    self.put("link", x, baseline - 2, p.width, p.size + 3, href=p.href)
            x += p.width


def wrapped(runs: list[dict], limit: float, size: float, bold: bool = False) -> list[list[Piece]]:
    """Greedy lines of pieces no wider than `limit`; one line at least."""
    lines: list[list[Piece]] = [[]]
    used = 0.0
    limit += 1e-6  # sums of widths in another order differ by as much

    def end() -> None:
        nonlocal used
        while lines[-1] and not lines[-1][-1].text.strip():
            lines[-1].pop()
        lines.append([])
        used = 0.0

    def add(text: str, face: str, href: str | None) -> None:
        nonlocal used
        last = lines[-1][-1] if lines[-1] else None
        if last and last.face == face and last.href == href:
            last.text += text
        else:
            lines[-1].append(Piece(text, face, size, href))
        used += text_width(text, face, size)

    for run in runs:
        face, href = run.get("face") or face_of(bold or run.get("bold"), run.get("italic"), run.get("code")), run.get("href")
        for token in words_and_spaces(run["text"]):
            blank, w = token.isspace(), text_width(token, face, size)
            if blank and not lines[-1]:
                continue
            if not blank and used + w > limit and any(p.text.strip() for p in lines[-1]):
                end()
            if blank or w <= limit:
                add(token, face, href)
                continue
            part = ""
            for c in token:  # wider than a line
                if part and text_width(part + c, face, size) > limit:
                    add(part, face, href)
                    end()
                    part = ""
                part += c
            add(part, face, href)
    if lines[-1]:
        end()
    return lines[:-1] or [[]]


def inline(text: str) -> str:
    return re.sub(r"\r?\n", " ", CONTROL.sub("", text))


def shown(text: str, page: Layout) -> str:
    """Without control characters; what can't be shown as question marks, one a UTF-16 unit."""
    text = inline(text)
    return UNSHOWN.sub(lambda m: "?" * (1 + (m[0] > LAST_PLAIN)), text) if page.degrade else text


def faced(run: dict, page: Layout) -> list[dict]:
    """A run, with the words that need the fallback face apart."""
    text = shown(run.get("text") or "", page)
    if not page.fallback or not UNSHOWN.search(text):
        return [run | {"text": text}]
    return [run | {"text": token} | ({"face": page.fallback} if UNSHOWN.search(token) else {}) for token in words_and_spaces(text)]


def block_text(b: dict) -> str:
    """All text of a block: runs, both sides of a split row, code, cells, a caption."""
    if b["kind"] == "table":
        cells = [*(b.get("header") if b.get("header") is not None else []), *(c for r in (b.get("rows") if b.get("rows") is not None else []) for c in r)]
        return " ".join(cells)
    if b["kind"] == "splitRow":
        return " ".join(r["text"] for side in ("left", "right") for r in b[side])
    if b.get("runs") is not None and b["kind"] not in ("code", "image"):
        return " ".join(r["text"] for r in b["runs"])
    return b.get("text") or ""


def fonts_for(blocks: list[dict], page: Layout) -> None:
    """Standard faces where they show all; else the script's face for single words, if it has metrics here."""
    text = CONTROL.sub("", " ".join(map(block_text, blocks)))
    if UNSHOWN.search(text.replace("\n", " ").replace("\t", " ")):
        first = SCRIPTS.search(text)
        face = SCRIPT_FONTS["latin" if not first else "devanagari" if "\u0900" <= first[0] <= "\u097f" else "arabic"]
        page.fallback, page.degrade = (face, False) if is_registered(face) else (None, True)


def flow(page: Layout, runs: list[dict], x: float, w: float, size: float, ratio: float = RATIO, bold: bool = False, align: str = "left") -> None:
    for line in wrapped([r for run in runs for r in faced(run, page)], w, size, bold):
        page.line(line, x, w, size * ratio, size, align)


def code_lines(text: str, limit: int) -> list[str]:
    """Lines of at most `limit` characters; tabs count two blanks."""
    return [line[k : k + limit] for line in text.replace("\t", "  ").split("\n") for k in range(0, max(1, len(line)), limit)]


def code_limit(content: float) -> int:
    return max(8, int((content - 2 * CODE_PAD) // text_width("M", MONO, CODE_SIZE)))


def code(page: Layout, text: str) -> None:
    text = "\n".join(shown(line, page) for line in text.replace("\t", "  ").split("\n"))
    h, lines = CODE_SIZE * CODE_RATIO, code_lines(text, code_limit(page.content))
    while lines:
        page.need(h + 2 * CODE_PAD)
        fit = max(1, int((page.room - 2 * CODE_PAD) // h))
        part, lines = lines[:fit], lines[fit:]
        box = len(part) * h + 2 * CODE_PAD
        page.put("box", page.margin, page.y - box, page.content, box)
        for k, line in enumerate(part):
            if line:
                y = page.y - CODE_PAD - (k + 1) * h + (h - CODE_SIZE) / 2
                page.put("text", page.margin + CODE_PAD, y, text_width(line, MONO, CODE_SIZE), CODE_SIZE, line, MONO, CODE_SIZE)
        page.y -= box
        if lines:
            page.turn()


def column_widths(natural: list[float], content: float, hints: list[float] | None = None) -> list[float]:
    """Widths of a table's columns from those of their contents, or from hints in pixels."""
    if hints and len(hints) == len(natural) and any(h > 0 for h in hints):
        total = sum(hints)
        return [h / total * min(content, total * 0.75) for h in hints]
    widths = [w + 2 * CELL_PAD for w in natural]
    if (total := sum(widths)) <= content:
        return widths
    widths = [max(LEAST_COLUMN, w * content / total) for w in widths]
    over = sum(widths) - content
    wide = sum(w for w in widths if w > LEAST_COLUMN)
    return [w - over * w / wide if over > 0 and w > LEAST_COLUMN else w for w in widths]


def table(page: Layout, header: list[str], rows: list[list[str]], hints: list[float] | None = None, borderless: bool = False) -> None:
    n = max([len(header), *map(len, rows)], default=0)
    if not n:
        return
    every = [list(r) + [""] * (n - len(r)) for r in [header, *rows]]
    measure = lambda t, bold: text_width(t, face_of(bold, False, False), TABLE_SIZE)
    widths = column_widths([max(measure(r[c], k == 0) for k, r in enumerate(every)) for c in range(n)], page.content, hints)
    h, pad = TABLE_SIZE * TABLE_RATIO, 1.0 if borderless else CELL_PAD

    def draw(cells: list[str], bold: bool, again: bool) -> None:
        lines = [wrapped(faced({"text": t}, page), max(20.0, w - 2 * pad), TABLE_SIZE, bold) for t, w in zip(cells, widths, strict=True)]
        row_h = max(map(len, lines)) * h + 2 * pad
        if page.room < row_h:
            page.turn()
            if again:
                draw(every[0], True, False)
        x = page.margin
        for w, cell in zip(widths, lines, strict=True):
            if not borderless:
                page.put("cell", x, page.y - row_h, w, row_h)
            for k, line in enumerate(cell):
                page.pieces(line, x + pad, page.y - pad - (k + 1) * h + (h - TABLE_SIZE) / 2)
            x += w
        page.y -= row_h

    titled = any(t.strip() for t in header)
    if titled:
        draw(every[0], True, False)
    for r in every[1:]:
        draw(r, False, titled and not borderless)


def split_row(page: Layout, left: list[dict], right: list[dict], size: float) -> None:
    h = size * RATIO
    left, right = ([r for run in side for r in faced(run, page)] for side in (left, right))
    aside = wrapped(right, page.content, size)[0]
    right_w = sum(p.width for p in aside)
    lines = wrapped(left, max(60.0, page.content - right_w - 8), size)
    page.need(h)
    page.pieces(aside, page.width - page.margin - right_w, page.y - h + (h - size) / 2)
    for line in lines:
        page.line(line, page.margin, page.content, h, size)


def image(page: Layout, w: float, h: float, caption: str | None, src: str | None) -> None:
    below = CAPTION if caption else 0.0
    scale = min(1.0, page.content / w, (page.height - 2 * page.margin - below) / h)
    w, h = w * scale, h * scale
    page.need(h + below)
    page.y -= h
    page.put("image", page.margin + (page.content - w) / 2, page.y, w, h, href=src)
    if caption:
        page.line(wrapped(faced({"text": caption, "italic": True}, page), page.content, 9.0)[0], page.margin, page.content, CAPTION, 9.0, "center")


def place(page: Layout, b: dict) -> None:
    """Lays out one block."""
    kind, style = b["kind"], b.get("style") or {}
    runs = b.get("runs") or [{"text": b.get("text") or ""}]
    size = style.get("sizePt") or BODY
    align, ratio = style.get("align") or "left", style.get("lineHeight") or RATIO
    if kind != "heading" and style.get("spaceBefore"):
        page.gap(style["spaceBefore"])
    if kind == "heading":
        size, before = HEADINGS[int(b["level"])]
        size, before = style.get("sizePt") or size, style.get("spaceBefore") or before
        if page.room < before + size * RATIO + 2 * BODY * RATIO:
            page.turn()
        else:
            page.gap(before)
        flow(page, runs, page.margin, page.content, size, ratio, True, align)
        if style.get("rule"):
            page.y -= 1.5
            page.put("rule", page.margin, page.y, page.content, 0.8)
    elif kind == "paragraph":
        flow(page, runs, page.margin, page.content, size, ratio, False, align)
    elif kind == "listItem":
        inset, h = INDENT * (1 + int(b.get("depth") or 0)), size * ratio
        page.need(h)
        marker = f"{int(b['index'])}." if b.get("ordered") else "•"
        page.put("text", page.margin + inset - 14, page.y - h + (h - size) / 2, text_width(marker, "Helvetica", size), size, marker, "Helvetica", size)
        flow(page, runs, page.margin + inset, page.content - inset, size, ratio, False, align)
    elif kind == "blockquote":
        page.need(size * RATIO)
        start, top = page.page, page.y
        flow(page, runs, page.margin + 12, page.content - 12, size, ratio, False, align)
        top = top if page.page == start else page.height - page.margin
        page.put("bar", page.margin, page.y, 3.0, max(top - page.y, size * RATIO))
    elif kind == "code":
        code(page, b.get("text") or "")
    elif kind == "table":
        table(page, list(b.get("header") if b.get("header") is not None else []), [list(r) for r in (b.get("rows") if b.get("rows") is not None else [])], b.get("colWidths"), bool(b.get("borderless")))
    elif kind == "splitRow":
        split_row(page, b["left"], b["right"], size)
    elif kind == "image" and b.get("w") and b.get("h"):
        image(page, b["w"], b["h"], b.get("text"), b.get("src"))
    elif kind == "hr":
        page.gap(GAPS["hr"])
        page.need(1.0)
        page.put("rule", page.margin, page.y, page.content, 0.5)
    page.gap(style.get("spaceAfter") or GAPS.get(kind, 0.0))


def typeset(blocks: list[dict], size: tuple[float, float] = A4, margin: float = MARGIN) -> Layout:
    page = Layout(*size, margin)
    fonts_for(blocks, page)
    for b in blocks:
        place(page, b)
    return page


DRAWN = ["page_no", "what", "x", "y", "w", "h", "text", "face", "size", "href"]


def typeset_blocks(blocks: DataFrame, id_col: str = "doc_id", size: tuple[float, float] = A4, margin: float = MARGIN, metrics: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """Drawn pieces (draw_no, page_no, what, x, y, w, h, text, face, size, href) of each document.
    metrics: widths by character of further faces; they travel to the workers with the task."""
    def rows(found: list[dict]) -> list[tuple]:
        for face, widths in (metrics or {}).items():
            register_metrics(face, widths)
        return [(k, *d) for k, d in enumerate(typeset(found, size, margin).drawn)]

    schema = "draw_no int, page_no int, what string, x double, y double, w double, h double, text string, face string, size double, href string"
    number, word = pa.float64(), pa.string()
    types = [pa.int32(), pa.int32(), word, number, number, number, number, word, word, number, word]
    return map_groups(blocks, [id_col], ["ord"], rows, schema, ["draw_no", *DRAWN], types)


# column forms for monospaced text -------------------------------------------


def code_chunks(text: Column, limit: int) -> Column:
    """Lines of code cut into pieces of `limit` characters, as an array."""
    lines = F.split(F.regexp_replace(text, "\t", "  "), "\n", -1)
    starts = lambda x: F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.char_length(x) - 1) / limit).cast("int"))
    return F.flatten(F.transform(lines, lambda x: F.transform(starts(x), lambda k: F.substring(x, k * limit + 1, F.lit(limit)))))


def document_text(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All text of a document's blocks (runs, code, cells and captions), in order, and whether
    code page 1252 can show it."""
    from docloom.functions.text import has_non_winansi

    has = lambda c: c in blocks.columns
    cells = [F.coalesce(F.col(c), F.array().cast("array<string>")) if c == "header" else F.coalesce(F.flatten(c), F.array().cast("array<string>")) for c in ("header", "rows") if has(c)]
    plain = F.coalesce("text", F.lit(""))
    text = F.when(F.col("kind") == "table", F.array_join(F.concat(*cells), " ")).otherwise(plain) if cells else plain
    ordered = F.array_sort(F.collect_list(F.struct("ord", text.alias("t"))))
    joined = blocks.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("text"))
    return joined.withColumn("standard_fonts", ~has_non_winansi(one_line(F.col("text"))))


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"[\r\n\t]", " ")

