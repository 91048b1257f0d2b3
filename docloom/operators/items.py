"""Positioned text: lines, tables, headings and paragraphs from items with coordinates.

items: keys (document and page, or a segment), item_no, str, x, y, w, h, and for
reconstruction font_size and bold; y grows upwards.  A page is one group; lines
anchor on their first item, which a window can't express, so the grouping of a
page's items runs in Arrow batches of whole pages: the functions of one page below say what
is done, and `pages` does it for thousands of pages at once.  Statistics, classification and
band joins are plain DataFrame operations.
"""

from __future__ import annotations

import functools
import math
import re
from itertools import pairwise
from statistics import median

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.geometry import half_points
from docloom.functions.text import is_bullet, units
from docloom.operators.grouped import map_groups
from docloom.operators.textblocks import JS_SPACE, LAST_PLAIN, S, tidy

#: Tolerances and ratios of the layout rules.
DEFAULT_H, LINE_TOLERANCE, SPACE_GAP, SPACE_LEAST = 10.0, 0.5, 0.2, 1.0
X_LEAST, X_SHARE, RUN_LINES, TABLE_COLUMNS, MATCHES, UNMATCHED = 4.0, 0.6, 3, 2, 2, 1
NEAR_Y, BASELINE, WORD_GAP, BACKWARD = 0.5, 0.4, 0.25, 0.5
H1, H2, H2_BOLD, HEADING_CHARS = 1.5, 1.15, 1.05, 120
PARAGRAPH_GAP, SIZE_TOLERANCE, MARGIN_FILL, BULLET_INDENT = 1.6, 0.2, 0.85, 0.5
BULLET_MARKS = r"[•\-–▪◦·*]|[0-9]{1,3}[.)]"
BULLET = re.compile(rf"(?:{BULLET_MARKS}){S}+")
SENTENCE_END = re.compile(r"""[.!?:;]["')\]]?\Z""")
BOLD_NAME = r"(?i)bold|black|heavy|semibold|demibold"


def effective_height(h: Column) -> Column:
    return F.when(h > 0, h).otherwise(DEFAULT_H)


def upper_median(values: Column) -> Column:
    """The element at floor(n / 2) of the sorted values of a group."""
    ordered = F.sort_array(F.collect_list(values))
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def x_tolerances(items: DataFrame, keys: list[str]) -> DataFrame:
    """Column tolerance of each page: a share of the upper median height, with a least value."""
    shown = items.where(~F.col("str").rlike(rf"^[{JS_SPACE}]*\z"))
    return shown.groupBy(*keys).agg(F.greatest(F.lit(X_LEAST), X_SHARE * upper_median(effective_height(F.col("h")))).alias("x_tol"))


def x_clusters(starts: DataFrame, keys: list[str], tol: str = "x_tol") -> DataFrame:
    """Chained clusters of x starts (line_no, x): a gap above the tolerance opens a new one;
    clusters on at least two lines and half of all stay, as (cluster, center, n_lines)."""
    from docloom.operators import pages

    return pages.map_clusters(starts, keys, tol)


def nearest_column(items: DataFrame, centers: DataFrame, keys: list[str]) -> DataFrame:
    """Each item with the column (in order of centers) whose center is nearest; ties go left.
    Both sides meet on the page's key; a page has few columns."""
    packed = centers.groupBy(*keys).agg(F.array_sort(F.collect_list("center")).alias("columns"))
    best = F.array_min(F.transform("columns", lambda c, k: F.struct(F.abs(c - F.col("x")).alias("d"), k.alias("k"))))["k"]
    return items.join(packed, keys).withColumn("col_no", best).drop("columns")


def line_font_sizes(items: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mode of the half-point font sizes of each line, ties to the leftmost,
    and whether more than half of its characters are bold."""
    chars = units(F.regexp_replace(F.regexp_replace(F.col("str"), rf"^[{JS_SPACE}]+", ""), rf"[{JS_SPACE}]+\z", ""))
    rows = items.withColumn("chars", chars).withColumn("size", half_points(F.col("font_size"))).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("x", "item_no")))
    by_size = rows.groupBy(*keys, "size").agg(F.sum("chars").alias("chars"), F.min("place").alias("first"), F.sum(F.when(F.col("bold"), F.col("chars")).otherwise(0)).alias("bold_chars"))
    return by_size.groupBy(*keys).agg(
        F.max_by("size", F.struct("chars", -F.col("first"))).alias("font_size"),
        F.coalesce(F.try_divide(F.sum("bold_chars"), F.sum("chars")) > 0.5, F.lit(False)).alias("bold"),
    )


def classify_line(text: Column, font_size: Column, bold: Column, page_median: Column) -> Column:
    ratio = F.try_divide(font_size, page_median)
    short = (page_median > 0) & (units(text) <= HEADING_CHARS)
    return (
        F.when(is_bullet(text), "bullet")
        .when(short & (ratio >= H1), "heading1")
        .when(short & (ratio >= H2), "heading2")
        .when(short & (ratio >= H2_BOLD) & bold, "heading2")
        .otherwise("paragraph")
    )


def outside_bands(items: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose y lies in no band (y_top, y_bottom, both inclusive) of their page."""
    b = bands.select(*[F.col(k).alias(f"b_{k}") for k in keys], "y_top", "y_bottom")
    same = functools.reduce(lambda x, y: x & y, [F.col(k) == F.col(f"b_{k}") for k in keys])
    return items.join(b, same & (F.col("y") <= F.col("y_top")) & (F.col("y") >= F.col("y_bottom")), "left_anti")


def page_parts(items: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """Segment of each item between the page's bands from the top: the number of bands at or above it."""
    packed = bands.groupBy(*keys).agg(F.collect_list("y_top").alias("tops"))
    joined = outside_bands(items, bands, keys).join(packed, keys, "left")
    return joined.withColumn("segment", F.size(F.filter(F.coalesce("tops", F.array().cast("array<double>")), lambda t: t >= F.col("y")))).drop("tops")


# one page's items, in memory ------------------------------------------------


def effective(h: float | None) -> float:
    return h if h and h > 0 else DEFAULT_H


def visual_lines(items: list[dict]) -> list[dict]:
    """Lines from top to bottom; an item joins the line whose first item it is level with."""
    shown = [i for i in items if i["str"].strip(JS_SPACE)]
    lines: list[dict] = []
    for item in sorted(shown, key=lambda i: (-i["y"], i["x"])):
        h = effective(item["h"])
        if lines and abs(lines[-1]["y"] - item["y"]) <= LINE_TOLERANCE * max(lines[-1]["h"], h):
            lines[-1]["items"].append(item)
            lines[-1]["h"] = max(lines[-1]["h"], h)
        else:
            lines.append({"y": item["y"], "h": h, "items": [item]})
    for line in lines:
        line["items"].sort(key=lambda i: i["x"])
    return lines


def joined_items(items: list[dict]) -> str:
    """Texts in a row, with a blank where the gap to the item before is wide."""
    parts = [items[0]["str"]] if items else []
    for left, right in pairwise(items):
        wide = max(SPACE_LEAST, SPACE_GAP * max(effective(left["h"]), effective(right["h"])))
        parts += [" "] * (right["x"] - left["x"] - left["w"] > wide) + [right["str"]]
    return tidy("".join(parts))


def matched(a: list[float], b: list[float], tol: float) -> int:
    """Greedy one-to-one matches of two ascending lists within a tolerance."""
    i = j = n = 0
    while i < len(a) and j < len(b):
        if abs(a[i] - b[j]) <= tol:
            i, j, n = i + 1, j + 1, n + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    return n


def compatible(a: list[float], b: list[float], tol: float) -> bool:
    n = matched(a, b, tol)
    return n >= MATCHES and len(a) - n <= UNMATCHED and len(b) - n <= UNMATCHED


def table_of(lines: list[dict], tol: float) -> dict | None:
    starts = sorted((i["x"], k) for k, line in enumerate(lines) for i in line["items"])
    clusters: list[list[tuple[float, int]]] = []
    for x, k in starts:
        if clusters and x - clusters[-1][-1][0] <= tol:
            clusters[-1].append((x, k))
        else:
            clusters.append([(x, k)])
    least = max(2, math.ceil(len(lines) / 2))
    centers = [sum(x for x, _ in c) / len(c) for c in clusters if len({k for _, k in c}) >= least]
    if len(centers) < TABLE_COLUMNS:
        return None
    rows = []
    for line in lines:
        cells: list[list[dict]] = [[] for _ in centers]
        for item in line["items"]:
            cells[min(range(len(centers)), key=lambda c: (abs(centers[c] - item["x"]), c))].append(item)
        rows.append([joined_items(c) for c in cells])
    return {"rows": rows, "y_top": lines[0]["y"] + lines[0]["h"], "y_bottom": lines[-1]["y"] - lines[-1]["h"]}


def tables_of(items: list[dict]) -> list[dict]:
    """Tables on a page: runs of three lines or more whose starts agree from line to line."""
    lines = visual_lines(items)
    if len(lines) < RUN_LINES:
        return []
    heights = sorted(effective(i["h"]) for line in lines for i in line["items"])
    tol = max(X_LEAST, X_SHARE * heights[len(heights) // 2])
    xs = [[i["x"] for i in line["items"]] for line in lines]
    found, at = [], 0
    while at < len(lines):
        stop = at + 1
        while stop < len(lines) and compatible(xs[stop - 1], xs[stop], tol):
            stop += 1
        if stop - at >= RUN_LINES and (table := table_of(lines[at:stop], tol)):
            found.append(table)
        at = stop
    return found


def reconstruct_lines(items: list[dict]) -> list[dict]:
    """Lines with text, extent, font size and weight."""
    shown = [i for i in items if i["str"].strip(JS_SPACE)]
    # y decides from half a point on, else x; not transitive, so sorted by comparison
    near = lambda a, b: (b["y"] > a["y"]) - (b["y"] < a["y"]) if abs(a["y"] - b["y"]) > NEAR_Y else (a["x"] > b["x"]) - (a["x"] < b["x"])
    groups: list[list[dict]] = []
    anchor = 0.0
    for item in sorted(shown, key=functools.cmp_to_key(near)):
        if groups and abs(item["y"] - anchor) <= BASELINE * max(item["font_size"], groups[-1][0]["font_size"]):
            groups[-1].append(item)
        else:
            groups.append([item])
            anchor = item["y"]
    return [line for g in groups if (line := line_of(g))["text"]]


def line_of(group: list[dict]) -> dict:
    ordered = sorted(group, key=lambda i: i["x"])
    parts: list[str] = []
    end = ordered[0]["x"]
    sizes: dict[float, int] = {}
    chars = bold = 0
    for item in ordered:
        gap = (item["x"] - end) / item["font_size"] if item["font_size"] else 0.0
        parts += [" "] * bool(parts and not -BACKWARD <= gap <= WORD_GAP) + [item["str"]]
        end = max(end, item["x"] + item["w"]) if len(parts) > 1 else item["x"] + item["w"]
        n = sum(1 + (c > LAST_PLAIN) for c in item["str"].strip(JS_SPACE))
        size = math.floor(item["font_size"] * 2 + 0.5) / 2
        sizes[size] = sizes.get(size, 0) + n
        chars += n
        bold += n if item.get("bold") else 0
    return {"text": tidy("".join(parts)), "y": ordered[0]["y"], "min_x": ordered[0]["x"], "max_x": end, "font_size": max(sizes, key=sizes.get), "bold": chars > 0 and bold / chars > 0.5}


def kind_of(line: dict, middle: float) -> str:
    if BULLET.match(line["text"]):
        return "bullet"
    if middle > 0 and len(line["text"]) <= HEADING_CHARS:
        ratio = line["font_size"] / middle
        if ratio >= H1:
            return "heading1"
        if ratio >= H2 or (ratio >= H2_BOLD and line["bold"]):
            return "heading2"
    return "paragraph"


def continues(block_kind: str, kind: str, before: dict, anchor: float, line: dict, left: float, right: float) -> bool:
    gap = before["y"] - line["y"]
    if not 0 < gap <= PARAGRAPH_GAP * before["font_size"] or abs(line["font_size"] - before["font_size"]) > SIZE_TOLERANCE * before["font_size"]:
        return False
    if block_kind.startswith("heading") and kind == block_kind:
        return True
    if kind != "paragraph" or block_kind.startswith("heading"):
        return False
    if SENTENCE_END.search(before["text"]) and (before["max_x"] - left) / max(1.0, right - left) < MARGIN_FILL:
        return False
    return block_kind == "paragraph" or line["min_x"] >= anchor + BULLET_INDENT * line["font_size"]


def blocks_of(items: list[dict]) -> list[tuple[str, str]]:
    """(kind, text) of the blocks of one segment."""
    lines = reconstruct_lines(items)
    if not lines:
        return []
    middle = median(x["font_size"] for x in lines)
    left, right = min(x["min_x"] for x in lines), max(x["max_x"] for x in lines)
    out: list[list[str]] = []
    before, anchor = None, 0.0
    for line in lines:
        kind = kind_of(line, middle)
        text = BULLET.sub("", line["text"], count=1) if kind == "bullet" else line["text"]
        if out and continues(out[-1][0], kind, before, anchor, line, left, right):
            if re.search(r"[A-Za-z]-\Z", out[-1][1]) and re.match("[a-z]", text):
                out[-1][1] = out[-1][1][:-1] + text
            else:
                out[-1][1] += " " + text
        else:
            out.append([kind, text])
            anchor = line["min_x"]
        before = line
    return [(k, t) for k, t in out]


def per_page(items: DataFrame, keys: list[str], f, schema: str, columns: list[str], fast: str | None = None, prose: bool = False) -> DataFrame:
    """Rows of f(items of a page as dicts, in item_no order); fast names the function of `pages` that does
    the same for many pages at once, prose says that it needs sizes and weights."""
    kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]
    if fast:
        from docloom.operators import pages

        return pages.map_pages(items, keys, getattr(pages, fast), f, schema, columns, types, prose)
    return map_groups(items, keys, ["item_no"], f, schema, columns, types)


def line_rows(page: list[dict]) -> list[tuple]:
    return [(k, x["y"], x["h"], len(x["items"]), joined_items(x["items"])) for k, x in enumerate(visual_lines(page))]


def group_lines(items: DataFrame, keys: list[str]) -> DataFrame:
    """line_no, y, h, n_items, text of each visual line of a page."""
    return per_page(items, keys, line_rows, "line_no int, y double, h double, n_items int, text string", ["line_no", "y", "h", "n_items", "text"], "group_lines")


def sheet_lines(page: list[dict]) -> list[str]:
    """Texts of a page's lines that have any."""
    return [text for line in visual_lines(page) if (text := joined_items(line["items"]))]


def lines_to_rows(items: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with text, numbered anew: what a sheet shows where no table is found."""
    return per_page(items, keys, lambda page: list(enumerate(sheet_lines(page))), "row_no int, text string", ["row_no", "text"], "lines_to_rows")


def table_rows(page: list[dict]) -> list[tuple]:
    return [(t, r, c, text, table["y_top"], table["y_bottom"]) for t, table in enumerate(tables_of(page)) for r, row in enumerate(table["rows"]) for c, text in enumerate(row)]


def detect_tables(items: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of all tables: table_no, row_no, col_no, text, y_top, y_bottom."""
    names = ["table_no", "row_no", "col_no", "text", "y_top", "y_bottom"]
    return per_page(items, keys, table_rows, "table_no int, row_no int, col_no int, text string, y_top double, y_bottom double", names, "detect_tables")


def block_rows(page: list[dict]) -> list[tuple]:
    return [(k, *b) for k, b in enumerate(blocks_of(page))]


def reconstruct_blocks(items: DataFrame, keys: list[str]) -> DataFrame:
    """ord, kind, text of the blocks of each segment."""
    return per_page(items, keys, block_rows, "ord int, kind string, text string", ["ord", "kind", "text"], "reconstruct_blocks", prose=True)


def parts_of(page: list[dict]) -> list[tuple]:
    """(part, row_no, col_no, kind, text): tables, and the blocks of the segments around them, from the top."""
    tables = sorted(tables_of(page), key=lambda t: -t["y_top"])
    segments: list[list[dict]] = [[] for _ in range(len(tables) + 1)]
    for item in page:
        if not any(t["y_bottom"] <= item["y"] <= t["y_top"] for t in tables):
            segments[sum(t["y_top"] >= item["y"] for t in tables)].append(item)
    out = [(2 * k + 1, r, c, "cell", text) for k, t in enumerate(tables) for r, row in enumerate(t["rows"]) for c, text in enumerate(row)]
    return out + [(2 * k, n, 0, kind, text) for k, segment in enumerate(segments) for n, (kind, text) in enumerate(blocks_of(segment))]


def word_parts(items: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """A document's parts in reading order: tables (cells joined) and blocks between them,
    and a note for pages without text."""
    names = ["part", "row_no", "col_no", "kind", "text"]
    found = per_page(items, keys, parts_of, "part int, row_no int, col_no int, kind string, text string", names)
    scanned = pages.select(*keys).join(items.select(*keys).distinct(), keys, "left_anti")
    zero = [F.lit(0).alias(c) for c in names[:3]]
    return found.unionByName(scanned.select(*keys, *zero, F.lit("note").alias("kind"), F.lit(SCANNED_PAGE_NOTE).alias("text")))


def sheets_of(page: list[dict]) -> list[tuple]:
    """(name, row_no, col_no, text) of a page's tables, or of its lines where it has none."""
    tables = tables_of(page)
    cells = [(f"Table {t}", r, c, text) for t, table in enumerate(tables, 1) for r, row in enumerate(table["rows"]) for c, text in enumerate(row)]
    return cells or [("text", r, 0, text) for r, text in enumerate(sheet_lines(page))]


def sheet_cells(items: DataFrame, doc: str, page: str) -> DataFrame:
    """Cells of the sheets of a workbook: one sheet for each table, or one of text lines
    for a page without tables; numbers apart from texts."""
    from docloom.functions.text import cell_number

    found = per_page(items, [doc, page], sheets_of, "what string, row_no int, col_no int, text string", ["what", "row_no", "col_no", "text"], "sheet_cells")
    sheet = F.concat(F.lit("Page "), F.col(page).cast("string"), F.lit(" "), F.col("what"))
    return found.select(doc, page, sheet.alias("sheet"), "row_no", "col_no", "text", cell_number("text").alias("number"))


#: Fixed value: what stands for a page without text.
SCANNED_PAGE_NOTE = "[This page appears to be a scanned image — run OCR first for text.]"
