from docloom.operators import items as I


def table_item(n, text, x, y, h=10.0):
    return {"item_no": n, "str": text, "x": float(x), "y": float(y), "w": 6.0 * len(text), "h": h, "font_size": h, "bold": False}


CELLS = [["Stop", "Line", "Min"], ["Quay", "7", "12"], ["Mill", "31", "4"], ["Park", "7", "19"]]
GRID = [table_item(10 * r + c, text, 80 + 110 * c + (r + c) % 3, 512 - 17 * r + 0.4 * c) for r, row in enumerate(CELLS) for c, text in enumerate(row)]


def test_one_table():
    (table,) = I.tables_of(GRID)
    assert table["rows"] == CELLS
    assert table["y_top"] > 512 and table["y_bottom"] < 512 - 3 * 17


def test_two_tables_and_cells_that_are_missing():
    lower = [table_item(100 + 10 * r + c, f"{r}{c}", 200 + 70 * c, 300 - 15 * r) for r in range(3) for c in range(4) if (r, c) != (1, 2)]
    first, second = I.tables_of([*GRID, table_item(90, "a line between", 80, 400), *lower])
    assert first["rows"] == CELLS
    assert second["rows"] == [["00", "01", "02", "03"], ["10", "11", "", "13"], ["20", "21", "22", "23"]]


def test_no_table_in_prose():
    lines = ["Snow had fallen since dawn, and", "nobody had come up the lane;", "the dog slept by the stove."]
    assert I.tables_of([table_item(k, text, 60, 640 - 14 * k) for k, text in enumerate(lines)]) == []
    assert I.tables_of(GRID[:6]) == []  # two lines are no table


def test_matching_is_one_to_one():
    assert I.matched([1.0, 2.0, 3.0], [1.4, 1.5, 3.2], 0.6) == 3
    assert not I.compatible([1.0, 50.0, 90.0, 120.0], [1.0, 50.0], 4.0)


def prose(text, x, y, w, size=10.0, bold=False):
    return {"item_no": 0, "str": text, "x": float(x), "y": float(y), "w": float(w), "h": size, "font_size": size, "bold": bold}


def test_overlapping_items_stay_apart():
    (block,) = I.blocks_of([prose("under the old", 120, 333, 90), prose("harbour wall", 118, 333, 80)])
    assert block[1].split() in ("under the old harbour wall".split(), "harbour wall under the old".split())


def test_split_words_join():
    assert I.blocks_of([prose("light", 60, 222, 25), prose("house", 85.7, 223, 28), prose("keeper", 118, 222, 30)]) == [("paragraph", "lighthouse keeper")]


def test_paragraphs_headings_bullets():
    items = [prose("Title", 50, 760, 60, 20.0), prose("a line that goes on and ex-", 50, 700, 400), prose("tends here", 50, 688, 100), prose("• point", 50, 660, 50), prose("goes on", 62, 648, 50), prose("new one.", 50, 636, 60)]
    assert I.blocks_of(items) == [("heading1", "Title"), ("paragraph", "a line that goes on and extends here"), ("bullet", "point goes on"), ("paragraph", "new one.")]


def test_parts_and_sheets(spark):
    rows = [(1, 1, *[i[k] for k in ("item_no", "str", "x", "y", "w", "h", "font_size", "bold")]) for i in [*GRID, table_item(90, "above", 50, 740) | {"w": 400.0}, table_item(91, "below.", 50, 400)]]
    schema = "doc int, page_no int, item_no int, str string, x double, y double, w double, h double, font_size double, bold boolean"
    items = spark.createDataFrame(rows, schema)
    pages = spark.createDataFrame([(1, 1), (1, 2)], "doc int, page_no int")
    parts = sorted((r["page_no"], r["part"], r["row_no"], r["col_no"], r["kind"], r["text"]) for r in I.word_parts(items, pages, ["doc", "page_no"]).collect())
    assert parts[0] == (1, 0, 0, 0, "paragraph", "above") and parts[1][4] == "cell" and parts[-2] == (1, 2, 0, 0, "paragraph", "below.")
    assert parts[-1][4:] == ("note", I.SCANNED_PAGE_NOTE)
    cells = I.sheet_cells(items, "doc", "page_no").collect()
    assert {r["sheet"] for r in cells} == {"Page 1 Table 1"} and sorted(r["number"] for r in cells if r["number"] is not None) == [4.0, 7.0, 7.0, 12.0, 19.0, 31.0]
