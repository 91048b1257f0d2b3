"""Markdown to blocks: a documented subset of the GitHub flavour.

Blocks: ATX and setext headings, paragraphs, fenced and indented code, quotes,
bulleted and numbered lists with nesting, pipe tables, rules, raw HTML (tags
stripped).  Inline: emphasis by * and _, code spans, links, autolinks, images,
strikethrough, backslash escapes, hard breaks, character references of Markdown.
Quotes, lists and inline styles nest MOST_NESTED deep; what lies deeper is plain text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.operators.runs import merged
from docloom.operators.textblocks import exploded, tidy

FENCE = re.compile(r" {0,3}(`{3,}|~{3,})\s*([^\s`]*)[^`]*\Z")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\Z")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\Z")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*\Z")
ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])([ \t]+|\Z)(.*)\Z")
QUOTE = re.compile(r" {0,3}>[ ]?(.*)\Z")
DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\Z")
HTML = re.compile(r" {0,3}<(?:[A-Za-z][^>]*|/[A-Za-z][^>]*|!--.*)>?")
INLINE = re.compile(
    r"\\([!-/:-@\[-`{-~])|(`+)(.+?)(?<!`)\2(?!`)|(!?)\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\(\s*<?([^)\s>]*)>?(?:\s+[\"'(].*?[\"')])?\s*\)|<(https?://[^>\s]+)>"
    r"|(\*\*\*|___)(?=\S)(.+?)(?<=\S)\8|(\*\*|__)(?=\S)(.+?)(?<=\S)\10|([*_])(?=\S)(.+?)(?<=\S)\12|~~(?=\S)(.+?)(?<=\S)~~|(  +\n|\\\n)",
    re.S,
)
INDENTS = "    ", "\t"
MOST_NESTED = 64
REFERENCES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))

NAMES = ["ord", "kind", "level", "ordered", "index", "depth", "text", "lang", "runs", "header", "rows"]
RUN_TYPE = pa.list_(pa.struct([("text", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_()), ("code", pa.bool_()), ("href", pa.string())]))
TYPES = [pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.string(), RUN_TYPE, pa.list_(pa.string()), pa.list_(pa.list_(pa.string()))]
SCHEMA = (
    "ord int, kind string, level int, ordered boolean, index int, depth int, text string, lang string, "
    "runs array<struct<text:string,bold:boolean,italic:boolean,code:boolean,href:string>>, header array<string>, rows array<array<string>>"
)


def unescaped(text: str) -> str:
    if "&" not in text:
        return text
    for name, sign in REFERENCES:
        text = text.replace(name, sign)
    return text


def inline_runs(text: str, style: dict | None = None, nested: int = 0) -> list[dict]:
    """Styled runs of a stretch of Markdown."""
    style = style or {"bold": False, "italic": False, "code": False, "href": None}
    if nested > MOST_NESTED:
        return [{"text": unescaped(text.replace("\n", " "))} | style]
    out: list[dict] = []
    at = 0

    def add(t: str, **more) -> None:
        out.append({"text": t} | style | more)

    for m in INLINE.finditer(text):
        plain = text[at : m.start()]
        at = m.end()
        if plain:
            add(unescaped(plain.replace("\n", " ")))
        if m[1]:
            add(m[1])
        elif m[2]:
            add(m[3].replace("\n", " ").strip() or m[3], code=True)
        elif m[4] == "!":
            add(f"[{m[5]}]", italic=True)
        elif m[5] is not None:
            out += inline_runs(m[5], style | {"href": m[6] or None}, nested + 1)
        elif m[7]:
            add(m[7], href=m[7])
        elif m[8]:
            out += inline_runs(m[9], style | {"bold": True, "italic": True}, nested + 1)
        elif m[10]:
            out += inline_runs(m[11], style | {"bold": True}, nested + 1)
        elif m[12]:
            out += inline_runs(m[13], style | {"italic": True}, nested + 1)
        elif m[14] is not None:
            out += inline_runs(m[14], style, nested + 1)
        else:
            add(" ")
    if at < len(text):
        add(unescaped(text[at:].replace("\n", " ")))
    return out


def plain(runs: list[dict]) -> str:
    return "".join(r["text"] for r in runs)


def block(kind: str, runs=None, text=None, level=None, ordered=None, index=None, depth=None, lang=None, header=None, rows=None) -> tuple:
    runs = merged(runs) if runs is not None else None
    return kind, level, ordered, index, depth, plain(runs) if runs is not None else text, lang, runs, header, rows


def cells(line: str) -> list[str]:
    parts = re.split(r"(?<!\\)\|", line.strip())
    parts = parts[1:] if parts and not parts[0].strip() and line.strip().startswith("|") else parts
    parts = parts[:-1] if parts and not parts[-1].strip() and line.strip().endswith("|") else parts
    return [plain(inline_runs(p.strip().replace("\\|", "|"))) for p in parts]


def parse(lines: list[str], depth: int = 0, nested: int = 0) -> list[tuple]:
    out: list[tuple] = []
    if nested > MOST_NESTED:
        text = tidy("\n".join(lines))
        return [block("paragraph", [{"text": text, "bold": False, "italic": False, "code": False, "href": None}])] if text else []
    at = 0
    while at < len(lines):
        line = lines[at]
        if not line.strip():
            at += 1
        elif ("```" in line or "~~~" in line) and (m := FENCE.match(line)):
            stop = at + 1
            close = re.compile(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*\Z")
            while stop < len(lines) and not close.match(lines[stop]):
                stop += 1
            out.append(block("code", text="\n".join(lines[at + 1 : stop]), lang=m[2] or None))
            at = stop + 1
        elif line.startswith(INDENTS):
            stop = at
            while stop < len(lines) and (lines[stop].startswith(INDENTS) or not lines[stop].strip()):
                stop += 1
            out.append(block("code", text=re.sub(r"(?m)^(?: {4}|\t)", "", "\n".join(lines[at:stop])).rstrip("\n ")))
            at = stop
        elif "#" in line and (m := ATX.match(line)):
            out.append(block("heading", inline_runs(m[2] or ""), level=min(3, len(m[1]))))
            at += 1
        elif RULE.match(line):
            out.append(block("hr"))
            at += 1
        elif ">" in line and QUOTE.match(line):
            stop = at
            while stop < len(lines) and (QUOTE.match(lines[stop]) or (lines[stop].strip() and not starts_block(lines, stop))):
                stop += 1
            inner = parse([m[1] if (m := QUOTE.match(x)) else x for x in lines[at:stop]], nested=nested + 1)
            runs: list[dict] = []
            for b in inner:
                if b[7] is not None:
                    runs += ([{"text": " "}] if runs else []) + b[7]
            if runs:
                out.append(block("blockquote", runs))
            at = stop
        elif ITEM.match(line) and (depth or not RULE.match(line)):
            found, at = parse_list(lines, at, depth, nested)
            out += found
        elif "|" in line and at + 1 < len(lines) and DELIMITER.match(lines[at + 1]) and len(cells(line)) == len(cells(lines[at + 1])):
            header, stop, rows = cells(line), at + 2, []
            while stop < len(lines) and lines[stop].strip() and not starts_block(lines, stop):
                row = cells(lines[stop])
                rows.append((row + [""] * len(header))[: len(header)])
                stop += 1
            out.append(block("table", header=header, rows=rows))
            at = stop
        elif HTML.match(line):
            stop = at
            while stop < len(lines) and lines[stop].strip():
                stop += 1
            if text := tidy(re.sub("<[^>]+>", " ", "\n".join(lines[at:stop]))):
                out.append(block("paragraph", [{"text": text, "bold": False, "italic": False, "code": False, "href": None}]))
            at = stop
        else:
            stop, level = at + 1, 0
            while stop < len(lines) and lines[stop].strip():
                if m := SETEXT.match(lines[stop]):
                    level = 1 if m[1][0] == "=" else 2
                    break
                if starts_block(lines, stop):
                    break
                stop += 1
            runs = inline_runs("\n".join(x.strip(" \t") if k == stop - at - 1 else x.lstrip(" \t") for k, x in enumerate(lines[at:stop])))
            out.append(block("heading", runs, level=level) if level else block("paragraph", runs))
            at = stop + bool(level)
    return out


def starts_block(lines: list[str], at: int) -> bool:
    line = lines[at]
    if line.lstrip(" ")[:1].isalpha():  # no mark begins with a letter
        return False
    m = ITEM.match(line)
    return bool(ATX.match(line) or FENCE.match(line) or RULE.match(line) or QUOTE.match(line) or (m and m[4] and (not m[2][0].isdigit() or int(m[2][:-1]) == 1)))


def parse_list(lines: list[str], at: int, depth: int, nested: int = 0) -> tuple[list[tuple], int]:
    """Items of one list; nested lists follow the item that holds them."""
    first = ITEM.match(lines[at])
    ordered = first[2][0].isdigit()
    start, mark = int(first[2][:-1]) if ordered else 1, first[2][-1]
    out: list[tuple] = []
    number = 0
    while at < len(lines) and (m := ITEM.match(lines[at])) and m[2][-1] == mark and m[2][0].isdigit() == ordered and not RULE.match(lines[at]):
        inset = len(m[1]) + len(m[2]) + (len(m[3]) if 0 < len(m[3]) <= 4 else 1)
        own, at = [m[4]], at + 1
        while at < len(lines):
            line = lines[at]
            if not line.strip():
                if at + 1 < len(lines) and re.match(rf" {{{min(inset, 2)},}}\S", lines[at + 1]) and not (ITEM.match(lines[at + 1]) and len(lines[at + 1]) - len(lines[at + 1].lstrip()) < inset):
                    own.append("")
                    at += 1
                    continue
                break
            indent = len(line) - len(line.lstrip(" "))
            if indent >= inset or (indent >= 2 and ITEM.match(line.lstrip(" "))):
                own.append(line[min(indent, inset) :])
            elif ITEM.match(line) or starts_block(lines, at) or not own[-1].strip():
                break
            else:
                own.append(line)
            at += 1
        while at < len(lines) and not lines[at].strip() and at + 1 < len(lines) and (n := ITEM.match(lines[at + 1])) and n[2][-1] == mark:
            at += 1
        runs: list[dict] = []
        behind = []
        for b in parse(own, depth + 1, nested + 1):
            if b[0] == "listItem":
                behind.append(b)
            elif b[7] is not None and not behind:
                runs += ([{"text": " "}] if runs else []) + b[7]
            else:
                behind.append(b)
        out.append(block("listItem", runs, ordered=ordered, index=start + number, depth=depth))
        out += behind
        number += 1
    return out, at


def parse_markdown(text: str) -> list[tuple]:
    return parse(re.sub(r"\r\n?", "\n", text).split("\n"))


def markdown_to_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks with styled runs, and header and rows of tables."""
    return exploded(df, id_col, text_col, parse_markdown, SCHEMA, NAMES, TYPES)
