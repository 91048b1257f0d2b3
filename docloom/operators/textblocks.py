"""Plain text to blocks: headings, paragraphs, list items, quotes, code and rules.

One pass over the lines of each text; the state (open paragraph, indents of open
lists) is small, so texts are parsed in Arrow batches without any shuffle.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space of the ECMAScript standard, line shapes, limits.
JS_SPACE = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
S = f"[{JS_SPACE}]"
SETEXT_1, SETEXT_2 = re.compile(rf"{S}*={{3,}}{S}*\Z"), re.compile(rf"{S}*-{{3,}}{S}*\Z")
RULE = re.compile(rf"{S}*(?:-{{3,}}|\*{{3,}}|_{{3,}}){S}*\Z")
QUOTE = re.compile(rf"{S}*>{S}?(.*)\Z")
BULLET = re.compile(rf"({S}*)[-*+•·‣]{S}+(.*)\Z")
ORDERED = re.compile(rf"({S}*)(?:\(([0-9]{{1,3}})\)|([0-9]{{1,3}})[.)]){S}+(.*)\Z")
CODE = re.compile(r"(?: {4,}|\t)(.*)\Z")
SPACES, SMALL, NO_LETTER = re.compile(f"{S}+"), re.compile("[a-z]"), re.compile("[^A-Za-z]+")
CAPS_LIMIT, CAPS_LENGTH, LABEL_LENGTH, LABEL_WORDS, DEEPEST = 0.6, 80, 60, 8, 3

LAST_PLAIN = chr(0xFFFF)

BLOCK_SCHEMA = "ord int, kind string, level int, ordered boolean, index int, depth int, text string"
BLOCK_FIELDS = ["ord", "kind", "level", "ordered", "index", "depth", "text"]
BLOCK_TYPES = [pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) if text.isascii() else len(text) + sum(c > LAST_PLAIN for c in text)


def tidy(text: str) -> str:
    return SPACES.sub(" ", text).strip(" ")


def caps_heading(line: str) -> bool:
    t = line.strip(JS_SPACE)
    return 2 <= units(t) <= CAPS_LENGTH and t[-1] not in ".!?" and not SMALL.search(t) and len(NO_LETTER.sub("", t)) >= 2


def label_heading(line: str) -> bool:
    t = line.strip(JS_SPACE)
    return t.endswith(":") and units(t) <= LABEL_LENGTH and t.count(":") == 1 and len(re.split(f"{S}+", t)) <= LABEL_WORDS


def block(kind: str, text: str | None = None, level=None, ordered=None, index=None, depth=None) -> tuple:
    return kind, level, ordered, index, depth, text


class Lists:
    """Indents of the open lists; an indent seen before keeps its depth."""

    def __init__(self):
        self.indents: list[int] = []

    def depth(self, indent: int) -> int:
        if indent in self.indents:
            return min(self.indents.index(indent), DEEPEST)
        while self.indents and self.indents[-1] > indent:
            self.indents.pop()
        if not self.indents or self.indents[-1] < indent:
            self.indents.append(indent)
        return min(len(self.indents) - 1, DEEPEST)


def code_block(lines: list[str], at: int) -> tuple[str, int]:
    """Indented lines from `at`; one blank line between two of them belongs to the block."""
    out = []
    while at < len(lines):
        if m := CODE.match(lines[at]):
            out.append(m[1])
            at += 1
        elif not lines[at].strip(JS_SPACE) and at + 1 < len(lines) and CODE.match(lines[at + 1]):
            out.append("")
            at += 1
        else:
            break
    return "\n".join(out).rstrip(JS_SPACE), at


def parse_text(text: str) -> list[tuple]:
    """Blocks (kind, level, ordered, index, depth, text) of a plain text."""
    lines = re.sub(r"\r\n?", "\n", text).split("\n")
    bare = [x.strip(JS_SPACE) for x in lines]
    heads = [bool(t) and caps_heading(t) for t in bare]
    written = sum(map(bool, bare))
    caps = bool(written) and sum(heads) / written <= CAPS_LIMIT
    blocks: list[tuple] = []
    paragraph: list[str] = []
    lists = Lists()

    def close(nesting: bool) -> None:
        if paragraph and (joined := tidy(" ".join(paragraph))):
            blocks.append(block("paragraph", joined))
        paragraph.clear()
        if nesting:
            lists.indents.clear()

    at = 0
    while at < len(lines):
        line, trimmed, head = lines[at], bare[at], heads[at]
        following = lines[at + 1] if at + 1 < len(lines) else ""
        at += 1
        first = trimmed[:1]  # a shape is only tried where the line begins as it does
        if not trimmed:
            close(True)
        elif "===" in following and SETEXT_1.match(following):
            close(True)
            blocks.append(block("heading", trimmed, level=1))
            at += 1
        elif "---" in following and not RULE.match(line) and SETEXT_2.match(following):
            close(True)
            blocks.append(block("heading", trimmed, level=2))
            at += 1
        elif first in "-*_" and RULE.match(line):
            close(True)
            blocks.append(block("hr"))
        elif first == ">" and (m := QUOTE.match(line)):
            close(True)
            body = [m[1]]
            while at < len(lines) and (m := QUOTE.match(lines[at])):
                body.append(m[1])
                at += 1
            if joined := tidy(" ".join(body)):
                blocks.append(block("blockquote", joined))
        elif first in "-*+•·‣" and (m := BULLET.match(line)):
            close(False)
            blocks.append(block("listItem", m[2].strip(JS_SPACE), ordered=False, index=0, depth=lists.depth(units(m[1]))))
        elif first in "(0123456789" and (m := ORDERED.match(line)):
            close(False)
            blocks.append(block("listItem", m[4].strip(JS_SPACE), ordered=True, index=int(m[2] or m[3]), depth=lists.depth(units(m[1]))))
        elif not paragraph and line[0] in " \t" and CODE.match(line):
            code, at = code_block(lines, at - 1)
            close(True)
            if code.strip(JS_SPACE):
                blocks.append(block("code", code))
        elif caps and head:
            close(True)
            blocks.append(block("heading", trimmed, level=2))
        elif not paragraph and label_heading(line):
            close(True)
            blocks.append(block("heading", trimmed, level=3))
        else:
            paragraph.append(trimmed)
    close(True)
    return blocks


def exploded(df: DataFrame, id_col: str, value_col: str, parse, schema: str, names: list[str], types: list) -> DataFrame:
    """Rows of parse(value), numbered from 0 in `ord`, behind each row's id."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for k, value in enumerate(batch.column("value").to_pylist()):
                found = parse(value) if value is not None else []
                at += [k] * len(found)
                rows += [(n, *row) for n, row in enumerate(found)]
                if len(rows) > 20_000:
                    yield made(batch, at, rows)
                    at, rows = [], []
            if rows:
                yield made(batch, at, rows)

    def made(batch, at, rows):
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *columns], ["id", *names])

    chosen = df.select(F.col(id_col).alias("id"), F.col(value_col).alias("value"))
    return chosen.mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def text_to_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ord, kind, level, ordered, index, depth, text; null texts have no block."""
    return exploded(df, id_col, text_col, parse_text, BLOCK_SCHEMA, BLOCK_FIELDS, BLOCK_TYPES)
