"""Positioned text of many pages at once: what `items` does for one page, over columns of whole pages.

A chunk holds the rows of whole pages.  What follows from row to row (a line's first item, a block's last
line) goes by steps: step k takes row k of every page that has one, so that a chunk costs as many steps as its
longest page has rows.  Results are those of the functions of one page in `items`; a chunk's pages
that these columns can't express (null or unordered values) go through them one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from docloom.operators.items import (
    BACKWARD, BASELINE, BULLET_INDENT, BULLET_MARKS, DEFAULT_H, H1, H2, H2_BOLD, HEADING_CHARS, LINE_TOLERANCE, MARGIN_FILL, MATCHES, NEAR_Y, PARAGRAPH_GAP, RUN_LINES, SIZE_TOLERANCE, SPACE_GAP, SPACE_LEAST, TABLE_COLUMNS, UNMATCHED, WORD_GAP, X_LEAST, X_SHARE,
)
from docloom.operators.textblocks import JS_SPACE, S, tidy

#: Rows of a chunk, at least; a page is never cut.
CHUNK_ROWS = 50_000
SHOWN, WIDE_CHARACTER = f"[^{JS_SPACE}]", r"[\x{10000}-\x{10ffff}]"
UNTIDY = rf"^{S}|{S}\z|{S}{S}|[{JS_SPACE.replace(' ', '')}]"
KINDS = pa.array(["paragraph", "heading1", "heading2", "bullet"])
PARAGRAPH, HEADING1, HEADING2, BULLETED = range(4)


def starts_of(ids: np.ndarray) -> np.ndarray:
    """Where each run of equal ids begins."""
    return np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)


def counts_of(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def steps(counts: np.ndarray):
    """The groups, longest first, and (k, number of groups with a row k) for each k."""
    order = np.argsort(-counts, kind="stable")
    most = int(counts.max()) if len(counts) else 0
    having = np.searchsorted(-counts[order], -np.arange(most), side="left")
    return order, zip(range(most), having.tolist(), strict=True)


def joined(texts: pa.Array, blank: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The texts of each stretch of offsets in one, with a blank before where `blank` says so."""
    if blank.any():
        texts = pc.if_else(pa.array(blank), pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar("")), texts)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), texts), "")


def tidied(texts: pa.Array) -> pa.Array:
    odd = pc.match_substring_regex(texts, UNTIDY)
    if not pc.any(odd).as_py():
        return texts
    return pa.array([tidy(t) if o else t for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)], pa.string())


def flags(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)


class Items:
    """Items with text of a chunk: page (ascending) and columns, in the order of the chunk."""

    def __init__(self, page: np.ndarray, columns: dict[str, pa.Array]):
        number = lambda c: columns[c].cast(pa.float64()).to_numpy(zero_copy_only=False)
        shown = flags(columns["str"], SHOWN)
        self.page, self.text = page[shown], columns["str"].filter(pa.array(shown))
        self.x, self.y, self.w, h = (number(c)[shown] for c in "xywh")
        with np.errstate(invalid="ignore"):
            self.h = np.where(h > 0, h, DEFAULT_H)
        if "font_size" in columns:
            self.size = number("font_size")[shown]
            self.bold = pc.fill_null(columns["bold"], False).to_numpy(zero_copy_only=False)[shown]


class Lines:
    """Visual lines of a chunk's pages, and their items from left to right."""

    def __init__(self, i: Items):
        order = np.lexsort((i.x, -i.y, i.page))
        page, y, h = i.page[order], i.y[order], i.h[order]
        starts = starts_of(page)
        longest, each = steps(counts_of(starts, len(page)))
        begin, new = starts[longest], np.zeros(len(page), bool)
        line_y, line_h = np.zeros(len(begin)), np.zeros(len(begin))
        for k, n in each:
            at = begin[:n] + k
            high = np.maximum(line_h[:n], h[at])
            same = np.abs(line_y[:n] - y[at]) <= LINE_TOLERANCE * high if k else np.zeros(n, bool)
            new[at] = ~same
            line_y[:n] = np.where(same, line_y[:n], y[at])
            line_h[:n] = np.where(same, high, h[at])
        line = np.cumsum(new) - 1
        self.starts = np.flatnonzero(new)
        self.n, self.counts = len(self.starts), counts_of(self.starts, len(page))
        self.page, self.y = page[self.starts], y[self.starts]
        self.h = np.maximum.reduceat(h, self.starts) if self.n else h
        first = np.flatnonzero(np.concatenate([[True], self.page[1:] != self.page[:-1]])) if self.n else self.starts
        self.of_page = counts_of(first, self.n)  # lines of each page that has some
        self.number = np.arange(self.n) - np.repeat(first, self.of_page)
        self.line = line
        order = order[np.lexsort((i.x[order], line))]
        self.x, self.w, self.item_h, self.text = i.x[order], i.w[order], i.h[order], i.text.take(pa.array(order))

    def texts(self) -> pa.Array:
        return self.join(np.arange(len(self.x)), self.line, np.append(self.starts, len(self.x)))

    def join(self, rows: np.ndarray, cell: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of cells: rows of items, their cells (ascending), and where each cell's rows begin."""
        x, w, h = self.x[rows], self.w[rows], self.item_h[rows]
        blank = np.zeros(len(rows), bool)
        wide = np.maximum(SPACE_LEAST, SPACE_GAP * np.maximum(h[:-1], h[1:]))
        blank[1:] = (cell[1:] == cell[:-1]) & (x[1:] - x[:-1] - w[:-1] > wide)
        return tidied(joined(self.text.take(pa.array(rows)), blank, offsets))


def group_lines(i: Items) -> tuple:
    v = Lines(i)
    return v.page, v.number, v.y, v.h, v.counts, v.texts()


def lines_to_rows(i: Items) -> tuple:
    v = Lines(i)
    return v.page, v.number, v.texts()


def compatible(v: Lines, tol: np.ndarray) -> np.ndarray:
    """Whether each line's starts agree with those of the line before on its page."""
    later = np.flatnonzero(v.number > 0)
    a, a_end, b, b_end, t = v.starts[later - 1], v.starts[later], v.starts[later], v.starts[later] + v.counts[later], tol[later]
    n, open_ = np.zeros(len(later), np.int64), np.arange(len(later))
    a, b = a.copy(), b.copy()
    while len(open_):
        xa, xb = v.x[a[open_]], v.x[b[open_]]
        same = np.abs(xa - xb) <= t[open_]
        n[open_] += same
        a[open_] += same | (xa < xb)
        b[open_] += same | ~(xa < xb)
        open_ = open_[(a[open_] < a_end[open_]) & (b[open_] < b_end[open_])]
    out = np.zeros(v.n, bool)
    out[later] = (n >= MATCHES) & (v.counts[later - 1] - n <= UNMATCHED) & (v.counts[later] - n <= UNMATCHED)
    return out


def tables(i: Items, v: Lines) -> tuple:
    """Cells of all tables: page, table_no, row_no, col_no, text, y_top, y_bottom."""
    if not v.n:
        none = np.zeros(0, np.int64)
        return none, none, none, none, pa.array([], pa.string()), np.zeros(0), np.zeros(0)
    heights = i.h[np.lexsort((i.h, i.page))]
    starts = starts_of(i.page)
    middle = heights[starts + counts_of(starts, len(i.page)) // 2]
    tol = np.repeat(np.maximum(X_LEAST, X_SHARE * middle), v.of_page)  # by line
    run = np.cumsum(~compatible(v, tol)) - 1
    run_lines = np.bincount(run)
    item_run = run[v.line]
    # clusters of the starts of each run that is long enough
    inside = np.flatnonzero(run_lines[item_run] >= RUN_LINES)
    s = inside[np.lexsort((v.line[inside], v.x[inside], item_run[inside]))]
    sx, s_run, s_line = v.x[s], item_run[s], v.line[s]
    new = np.ones(len(s), bool)
    new[1:] = (s_run[1:] != s_run[:-1]) | (sx[1:] - sx[:-1] > tol[s_line[1:]])
    cluster, c_starts = np.cumsum(new) - 1, np.flatnonzero(new)
    n_clusters = len(c_starts)
    by_line = np.lexsort((s_line, cluster))
    distinct = np.ones(len(s), bool)
    distinct[1:] = (cluster[by_line][1:] != cluster[by_line][:-1]) | (s_line[by_line][1:] != s_line[by_line][:-1])
    n_lines = np.bincount(cluster[by_line][distinct], minlength=n_clusters)
    c_run = s_run[c_starts]
    sums = np.add.reduceat(sx.astype(np.longdouble), c_starts) if n_clusters else np.zeros(0)
    centers = (sums.astype(float)) / counts_of(c_starts, len(s))
    kept = n_lines >= np.maximum(2, -(-run_lines[c_run] // 2))
    centers, c_run = centers[kept], c_run[kept]
    columns = np.bincount(c_run, minlength=len(run_lines))
    columns[columns < TABLE_COLUMNS] = 0
    first_center = np.searchsorted(c_run, np.arange(len(run_lines)))
    # the nearest center of each item, the left one of two
    inside = inside[columns[item_run[inside]] > 0]
    own = item_run[inside]
    best, col = np.full(len(inside), np.inf), np.zeros(len(inside), np.int64)
    for c in range(int(columns.max(initial=0))):
        some = np.flatnonzero(columns[own] > c)
        d = np.abs(centers[first_center[own[some]] + c] - v.x[inside[some]])
        better = some[d < best[some]]
        best[some] = np.minimum(best[some], d)
        col[better] = c
    # cells of the lines of tables
    width = columns[run]
    base = np.cumsum(width) - width
    cell = base[v.line[inside]] + col
    order = np.argsort(cell, kind="stable")
    total = int(width.sum())
    offsets = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=total))])
    line = np.repeat(np.arange(v.n), width)
    r = run[line]
    run_start = starts_of(run)
    run_end = run_start + run_lines - 1
    table_runs = np.flatnonzero(columns)
    t_page = v.page[run_start[table_runs]]
    t_first = starts_of(t_page)
    number = np.zeros(len(run_lines), np.int64)
    number[table_runs] = np.arange(len(table_runs)) - np.repeat(t_first, counts_of(t_first, len(t_page)))
    top, bottom = v.y[run_start] + v.h[run_start], v.y[run_end] - v.h[run_end]
    return v.page[line], number[r], line - run_start[r], np.arange(total) - base[line], v.join(inside[order], cell[order], offsets), top[r], bottom[r]


def detect_tables(i: Items) -> tuple:
    return tables(i, Lines(i))


def sheet_cells(i: Items) -> tuple:
    """Cells of tables, and lines of the pages that have none."""
    v = Lines(i)
    page, table, row, col, text, _, _ = tables(i, v)
    bare = np.flatnonzero(~np.isin(v.page, page))
    names = pa.array(["text", *(f"Table {t + 1}" for t in range(int(table.max(initial=-1)) + 1))])
    what = names.take(pa.array(np.concatenate([table + 1, np.zeros(len(bare), np.int64)])))
    texts = pa.concat_arrays([text, v.texts().take(pa.array(bare))])
    return np.concatenate([page, v.page[bare]]), what, np.concatenate([row, v.number[bare]]), np.concatenate([col, np.zeros(len(bare), np.int64)]), texts


def level_rows(page: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of items whose y lie within NEAR_Y of each other, by item; and the pages where these aren't
    apart, so that `near` is no order."""
    order = np.lexsort((-y, page))
    sy, sp = y[order], page[order]
    new = np.ones(len(order), bool)
    new[1:] = (sp[1:] != sp[:-1]) | (sy[:-1] - sy[1:] > NEAR_Y)
    starts = np.flatnonzero(new)
    ends = starts + counts_of(starts, len(order)) - 1
    row = np.empty(len(order), np.int64)
    row[order] = np.cumsum(new) - 1
    return row, np.unique(sp[starts[sy[starts] - sy[ends] > NEAR_Y]])


class Prose:
    """Lines of prose of a chunk's pages, as reconstruct_lines and line_of make them."""

    def __init__(self, i: Items):
        row, _ = level_rows(i.page, i.y)
        order = np.lexsort((i.x, row))
        page, y, size = i.page[order], i.y[order], i.size[order]
        starts = starts_of(page)
        longest, each = steps(counts_of(starts, len(page)))
        begin, new = starts[longest], np.zeros(len(page), bool)
        anchor, first_size = np.zeros(len(begin)), np.zeros(len(begin))
        for k, n in each:
            at = begin[:n] + k
            same = np.abs(y[at] - anchor[:n]) <= BASELINE * np.maximum(size[at], first_size[:n]) if k else np.zeros(n, bool)
            new[at] = ~same
            anchor[:n] = np.where(same, anchor[:n], y[at])
            first_size[:n] = np.where(same, first_size[:n], size[at])
        line, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        order = order[np.lexsort((i.x[order], line))]
        x, w, size, bold, text = i.x[order], i.w[order], i.size[order], i.bold[order], i.text.take(pa.array(order))
        counts, n_items = counts_of(starts, len(order)), len(order)
        # where a line's text has reached, and the gaps behind it
        longest, each = steps(counts)
        begin, end, blank = starts[longest], np.zeros(len(starts)), np.zeros(n_items, bool)
        for k, n in each:
            at = begin[:n] + k
            reach = x[at] + w[at]
            if k:
                gap = np.divide(x[at] - end[:n], size[at], out=np.zeros(n), where=size[at] != 0)
                blank[at] = ~((gap >= -BACKWARD) & (gap <= WORD_GAP))
                reach = np.maximum(end[:n], reach)
            end[:n] = reach
        self.max_x = np.empty(len(starts))
        self.max_x[longest] = end
        self.text = tidied(joined(text, blank, np.append(starts, n_items)))
        self.page, self.y, self.min_x, self.n = i.page[order][starts], i.y[order][starts], x[starts], len(starts)
        # the size of most characters, of two the one further left; the share of bold ones
        bare = pc.utf8_trim(text, JS_SPACE)
        chars = pc.utf8_length(bare).to_numpy(zero_copy_only=False).astype(np.int64)
        if (pc.binary_length(bare).to_numpy(zero_copy_only=False) != chars).any():
            chars = chars + pc.count_substring_regex(bare, WIDE_CHARACTER).to_numpy(zero_copy_only=False)
        half = np.floor(size * 2 + 0.5) / 2
        by = np.lexsort((half, line))
        fresh = np.ones(n_items, bool)
        fresh[1:] = (line[by][1:] != line[by][:-1]) | (half[by][1:] != half[by][:-1])
        group = np.flatnonzero(fresh)
        amount = np.add.reduceat(chars[by], group) if n_items else chars
        place = np.minimum.reduceat(by, group) if n_items else by
        g_line, g_half = line[by][group], half[by][group]
        best = np.lexsort((place, -amount, g_line))
        self.size = g_half[best][starts_of(g_line[best])]
        total = np.add.reduceat(chars, starts) if n_items else chars
        self.bold = (np.add.reduceat(chars * bold, starts) / np.maximum(total, 1) > 0.5) if n_items else np.zeros(0, bool)


def reconstruct_blocks(i: Items) -> tuple:
    p = Prose(i)
    if not p.n:
        none = np.zeros(0, np.int64)
        return none, none, KINDS.slice(0, 0), pa.array([], pa.string())
    starts = starts_of(p.page)
    counts = counts_of(starts, p.n)
    sizes = p.size[np.lexsort((p.size, p.page))]
    low, high = sizes[starts + (counts - 1) // 2], sizes[starts + counts // 2]
    middle = np.repeat(np.where(counts % 2, high, (low + high) / 2), counts)
    left, right = np.repeat(np.minimum.reduceat(p.min_x, starts), counts), np.repeat(np.maximum.reduceat(p.max_x, starts), counts)
    # kinds of lines
    ratio = np.divide(p.size, middle, out=np.zeros(p.n), where=middle != 0)
    short = (middle > 0) & (pc.utf8_length(p.text).to_numpy(zero_copy_only=False) <= HEADING_CHARS)
    bullet = flags(p.text, rf"^(?:{BULLET_MARKS}){S}+")
    second = (ratio >= H2) | ((ratio >= H2_BOLD) & p.bold)
    kind = np.where(bullet, BULLETED, np.where(short & (ratio >= H1), HEADING1, np.where(short & second, HEADING2, PARAGRAPH)))
    text = pc.if_else(pa.array(bullet), pc.replace_substring_regex(p.text, rf"^(?:{BULLET_MARKS}){S}+", "", max_replacements=1), p.text) if bullet.any() else p.text
    # whether a line may go on from the one before, whatever block that is in
    near, done = np.zeros(p.n, bool), np.zeros(p.n, bool)
    gap = p.y[:-1] - p.y[1:]
    near[1:] = (gap > 0) & (gap <= PARAGRAPH_GAP * p.size[:-1]) & (np.abs(p.size[1:] - p.size[:-1]) <= SIZE_TOLERANCE * p.size[:-1])
    done[1:] = (flags(p.text, r"""[.!?:;]["')\]]?\z""") & ((p.max_x - left) / np.maximum(1.0, right - left) < MARGIN_FILL))[:-1]
    longest, each = steps(counts)
    begin, goes_on = starts[longest], np.zeros(p.n, bool)
    block, anchor = np.zeros(len(begin), np.int64), np.zeros(len(begin))
    for k, n in each:
        at = begin[:n] + k
        b, own = block[:n], kind[at]
        heading = (b == HEADING1) | (b == HEADING2)
        inner = (own == PARAGRAPH) & ~heading & ~done[at] & ((b == PARAGRAPH) | (p.min_x[at] >= anchor[:n] + BULLET_INDENT * p.size[at]))
        on = near[at] & ((heading & (own == b)) | inner) if k else np.zeros(n, bool)
        goes_on[at] = on
        block[:n] = np.where(on, b, own)
        anchor[:n] = np.where(on, anchor[:n], p.min_x[at])
    # a hyphen between letters goes with the break; other lines join by a blank
    broken = np.zeros(p.n, bool)
    broken[1:] = goes_on[1:] & flags(text, r"[A-Za-z]-\z")[:-1] & flags(text, "^[a-z]")[1:]
    if broken.any():
        text = pc.if_else(pa.array(np.append(broken[1:], False)), pc.utf8_slice_codeunits(text, 0, -1), text)
    first = np.flatnonzero(~goes_on)
    page = p.page[first]
    b_starts = starts_of(page)
    number = np.arange(len(first)) - np.repeat(b_starts, counts_of(b_starts, len(first)))
    return page, number, KINDS.take(pa.array(kind[first])), joined(text, goes_on & ~broken, np.append(first, p.n))


def odd_pages(page: np.ndarray, columns: dict[str, pa.Array], prose: bool) -> np.ndarray:
    """Pages with nulls or numbers without order in what is compared, or without an order of items."""
    bad = columns["str"].is_null().to_numpy(zero_copy_only=False)
    for c in ("x", "y", "w", "font_size") if prose else ("x", "y", "w"):
        bad = bad | ~np.isfinite(pc.fill_null(columns[c].cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False))
    found = np.unique(page[bad])
    if prose:
        rest = ~np.isin(page, found)
        _, mixed = level_rows(page[rest], pc.fill_null(columns["y"].cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)[rest])
        found = np.union1d(found, mixed)
    return found


def whole_pages(batches, keys: list[str], least: int = CHUNK_ROWS):
    """Chunks of whole pages, and where these begin: more than `least` rows are looked through, and after a page
    longer than that, as many rows as there were."""
    held: list[pa.RecordBatch] = []
    fresh = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        fresh += batch.num_rows
        if fresh > max(least, held[0].num_rows if len(held) > 1 else 0):
            chunk, starts = paged(held, keys)
            held, fresh = [chunk.slice(int(starts[-1]))], 0  # the last page may go on
            if len(starts) > 1:
                yield chunk.slice(0, int(starts[-1])), starts[:-1]
    if held:
        yield paged(held, keys)


def paged(batches: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.RecordBatch, np.ndarray]:
    chunk = pa.concat_batches(batches)
    codes = [chunk.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in keys]
    return chunk, np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in codes], axis=0)]))


def map_pages(df: DataFrame, keys: list[str], fast, slow, schema: str, names: list[str], types: list[pa.DataType], prose: bool) -> DataFrame:
    """Keys and rows of each page: fast(items of many pages), or slow(items of a page as dicts) for odd pages."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    own = ["item_no", "str", *"xywh", *(["font_size", "bold"] if prose else [])]

    def made(chunk: pa.RecordBatch, starts: np.ndarray, page: np.ndarray, columns) -> pa.RecordBatch:
        first = pa.array(starts[page], pa.int64())
        arrays = [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays([*(chunk.column(k).take(first) for k in keys), *arrays], [*keys, *names])

    def results(chunk: pa.RecordBatch, starts: np.ndarray):
        page = np.repeat(np.arange(len(starts)), counts_of(starts, chunk.num_rows))
        columns = {c: chunk.column(c) for c in own}
        columns["str"] = columns["str"].cast(pa.string())
        odd = odd_pages(page, columns, prose)
        if len(odd):
            rows, at = [], []
            for p in odd.tolist():
                stop = starts[p + 1] if p + 1 < len(starts) else chunk.num_rows
                found = slow(chunk.slice(starts[p], stop - starts[p]).to_pylist())
                rows += found
                at += [p] * len(found)
            if rows:
                yield made(chunk, starts, np.array(at), list(zip(*rows, strict=True)))
            rest = ~np.isin(page, odd)
            page, columns = page[rest], {c: v.filter(pa.array(rest)) for c, v in columns.items()}
        at, *found = fast(Items(page, columns))
        if len(at):
            yield made(chunk, starts, at, found)

    def run(batches):
        for chunk, starts in whole_pages(batches, keys):
            yield from results(chunk, starts)

    chosen = df.select(*keys, *own)
    return chosen.repartition(*keys).sortWithinPartitions(*keys, "item_no").mapInArrow(run, f"{kinds}, {schema}")


def distinct_counts(group: np.ndarray, n: int, codes: np.ndarray) -> np.ndarray:
    """How many different codes each of n groups (ascending) has; codes below 0 don't count."""
    order = np.lexsort((codes, group))
    g, c = group[order], codes[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    return np.bincount(g[new & (c >= 0)], minlength=n)


def clusters(page: np.ndarray, n_pages: int, x: pa.Array, tol: pa.Array, line: pa.Array) -> tuple:
    """Page, cluster, n_lines and center of the clusters that stay, of starts in the order of x."""
    known = pc.and_(x.is_valid(), tol.is_valid()).to_numpy(zero_copy_only=False)
    value, limit = (pc.fill_null(c.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False) for c in (x, tol))
    code = pc.fill_null(line.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    there = x.is_valid().to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore"):
        gap = value[1:] - value[:-1]
        wide = (gap > limit[1:]) | (np.isnan(gap) & ~np.isnan(limit[1:]))  # no number is beyond all numbers
    new = np.ones(len(page), bool)
    new[1:] = (page[1:] != page[:-1]) | (wide & known[1:] & there[:-1])
    cluster, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    own = page[starts]
    n_lines, lines = distinct_counts(cluster, len(starts), code), distinct_counts(page, n_pages, code)
    kept = np.flatnonzero(n_lines >= np.maximum(2, -(-lines[own] // 2)))
    with np.errstate(invalid="ignore"):
        center = (np.add.reduceat(value.astype(np.longdouble), starts) / np.add.reduceat(there, starts, dtype=np.int64)).astype(float)
    first = starts_of(own)
    number = np.arange(len(starts)) - np.repeat(first, counts_of(first, len(starts)))
    empty = np.add.reduceat(there, starts, dtype=np.int64)[kept] == 0
    return own[kept], number[kept], n_lines[kept], pa.array(center[kept], pa.float64(), mask=empty)


def map_clusters(starts: DataFrame, keys: list[str], tol: str) -> DataFrame:
    """Clusters of the starts of each page whose keys are known: one sort by page and x, then one pass."""
    kinds = ", ".join(f"{k} {starts.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for chunk, begins in whole_pages(batches, keys):
            page = np.repeat(np.arange(len(begins)), counts_of(begins, chunk.num_rows))
            at, number, n_lines, center = clusters(page, len(begins), chunk.column("x"), chunk.column(tol), chunk.column("line_no"))
            if len(at):
                first = pa.array(begins[at], pa.int64())
                yield pa.RecordBatch.from_arrays([*(chunk.column(k).take(first) for k in keys), pa.array(number, pa.int64()), pa.array(n_lines, pa.int64()), center], [*keys, "cluster", "n_lines", "center"])

    chosen = starts.select(*keys, "line_no", "x", tol).dropna(subset=keys)
    return chosen.repartition(*keys).sortWithinPartitions(*keys, "x").mapInArrow(run, f"{kinds}, cluster long, n_lines long, center double")
