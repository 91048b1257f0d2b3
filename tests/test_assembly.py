import io
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions.geometry import A4
from docloom.operators import session as S
from docloom.sources import assembly, conversions, pdf, writers

SOURCES = "session_id string, source_id string, source_no int, name string, kind string, mime string, page_count int, content binary"


def file_of(*texts):
    """A PDF with a page for each text."""
    shown = lambda t: [{"what": "text", "x": 72.0, "y": 700.0, "w": 50.0, "h": 11.0, "text": t, "face": "Helvetica", "size": 11.0, "href": None}]
    return writers.pdf_file([shown(t) for t in texts], A4)


def png(samples, color, depth=8, palette=b"", clear=b""):
    height, width = samples.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in samples)
    parts = [(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0)), (b"PLTE", palette), (b"tRNS", clear), (b"IDAT", zlib.compress(raw)), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts if d or k == b"IEND")


JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x1e\x00\x28\x03" + bytes(9) + b"\xff\xd9"


@pytest.fixture(scope="module")
def sources(spark):
    image = png(np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3), 2)
    rows = [("s", "a", 0, "a.pdf", "pdf", "application/pdf", 3, file_of("one", "two", "three")), ("s", "b", 1, "b.png", "image", "image/png", 1, image), ("s", "c", 2, "c.pdf", "pdf", None, 2, file_of("four", "five"))]
    rows += [("t", "d", 0, "d.jpg", "image", "image/jpeg", 1, JPEG), ("u", "e", 0, "e.pdf", "pdf", "application/pdf", 1, b"no pdf"), ("v", "f", 0, "f.pdf", "pdf", "application/pdf", 1, file_of("x").replace(b"/Info", b"/Encrypt 9 0 R /Info"))]
    return spark.createDataFrame(rows, SOURCES)


def built(plan, sources, sessions=None):
    return {r["session_id"]: r for r in assembly.build_pdfs(plan, sources, sessions).collect()}


def shown(data):
    return [[t[0] for t in page[3]] for page in pdf.read(bytes(data))[2]]


def test_pages_of_several_sources(spark, sources):
    pages = S.source_pages(sources)
    pages = S.rotate_pages(pages, pages.where("page_id = 'p-a-1'").select("session_id", "page_id"), 90)
    pages = S.rotate_pages(pages, pages.where("page_id IN ('p-a-1', 'p-b-0')").select("session_id", "page_id"), 180)
    at = spark.createDataFrame([("s", 0, "blank", )], "session_id string, index int, page_id string")
    pages = S.remove_pages(S.insert_blank_pages(pages, at, (100.0, 50.0)), pages.where("page_id = 'p-a-2'").select("session_id", "page_id"))
    found = built(S.export_plan(pages, sources), sources)
    assert (found["s"]["n_pages"], found["s"]["error"]) == (6, None)
    assert shown(found["s"]["data"]) == [[], ["one"], ["two"], [], ["four"], ["five"]]
    status, _, read = pdf.read(bytes(found["s"]["data"]))
    assert status == "ok" and [p[2] for p in read] == [0, 0, 270, 180, 0, 0]
    assert [(round(p[0], 2), round(p[1], 2)) for p in read] == [(100.0, 50.0), (595.28, 841.89), (595.28, 841.89), (3.0, 2.0), (595.28, 841.89), (595.28, 841.89)]
    assert [(p[0], p[1]) for p in pdf.read(bytes(found["t"]["data"]))[2]] == [(40.0, 30.0)]
    assert found["u"]["data"] is None and "corrupted" in found["u"]["error"]
    assert found["v"]["data"] is None and "password" in found["v"]["error"]


def test_a_page_twice_and_a_file_again(spark, sources):
    pages = S.source_pages(sources.where("session_id = 's'"))
    ids = pages.where("page_id = 'p-c-1'").select("session_id", "page_id")
    twice = S.duplicate_pages(S.duplicate_pages(pages, ids), ids)
    names = [r["page_id"] for r in twice.orderBy("pos").collect()]
    assert len(set(names)) == len(names) == 8 and {"p-c-1", "p-c-1-copy", "p-c-1-copy-2"} < set(names)
    once = built(S.export_plan(twice, sources), sources)["s"]["data"]
    assert shown(once)[-3:] == [["five"]] * 3
    again = spark.createDataFrame([("w", "z", 0, "z.pdf", "pdf", "application/pdf", 8, bytes(once))], SOURCES)
    assert shown(built(S.export_plan(S.source_pages(again), again), again)["w"]["data"]) == shown(once)


def test_nothing_left(spark, sources):
    pages = S.source_pages(sources.where("session_id IN ('s', 't')"))
    left = S.remove_pages(pages, pages.where("session_id = 't'").select("session_id", "page_id"))
    found = built(S.export_plan(left, sources), sources, pages.select("session_id"))
    assert found["t"]["error"] == S.NOTHING_LEFT and found["t"]["data"] is None and found["s"]["error"] is None
    # a blank page goes into a session without pages, too
    at = spark.createDataFrame([("t", 5, "only")], "session_id string, index int, page_id string")
    assert [tuple(r) for r in S.insert_blank_pages(left, at).where("session_id = 't'").select("page_id", "pos").collect()] == [("only", 0)]


@pytest.mark.parametrize("color, channels", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_samples(color, channels):
    given = np.random.default_rng(color).integers(0, 256, (5, 4, channels), np.uint8)
    width, height, samples, alpha = assembly.png_pixels(png(given, color))
    assert (width, height) == (4, 5)
    assert np.array_equal(samples, given[..., : channels - (color >= 4)])
    assert (alpha is None) == (color < 4) and (alpha is None or np.array_equal(alpha, given[..., -1]))


def test_png_palettes_and_bits():
    rows = np.packbits(np.array([[0, 0, 0, 1, 1, 0, 1, 1], [1, 1, 1, 0, 0, 1, 0, 0]], np.uint8), axis=1)  # places of two bits
    palette = bytes([9, 9, 9, 10, 20, 30, 40, 50, 60, 70, 80, 90])
    body = png(rows.reshape(2, 1, 1), 3, 2, palette, b"\x07")
    body = body[:16] + struct.pack(">I", 4) + body[20:]  # four pixels in a byte
    width, _, samples, alpha = assembly.png_pixels(body)
    assert width == 4 and samples[0].tolist() == [[9, 9, 9], [10, 20, 30], [40, 50, 60], [70, 80, 90]] and alpha[0].tolist() == [7, 255, 255, 255]


def test_sheets_stand_in_page_order(spark):
    rows = [(1, f"Page {n} {what}", 0, 0, f"cell {n}", None) for n in (10, 2, 1) for what in ("Table 1", "Table 12", "Table 2")]
    cells = spark.createDataFrame(rows, "doc_id int, sheet string, row_no int, col_no int, text string, number double")
    files = spark.createDataFrame([(1,), (2,)], "doc_id int")
    made = {r["doc_id"]: r for r in writers.write_workbooks(cells, files=files).collect()}
    book = zipfile.ZipFile(io.BytesIO(made[1]["data"])).read("xl/workbook.xml").decode()
    names = [x.split('"')[0] for x in book.split('<sheet name="')[1:]]
    assert names == [f"Page {n} Table {t}" for n in (1, 2, 10) for t in (1, 2, 12)]
    assert (made[2]["data"], made[2]["error"]) == (None, writers.NO_TEXT)


def table_file():
    piece = lambda t, x, y: {"what": "text", "x": x, "y": y, "w": 30.0, "h": 10.0, "text": t, "face": "Courier", "size": 10.0, "href": None}
    grid = [piece(t, 72.0 + 120 * c, 600.0 - 20 * r) for r, row in enumerate([["Item", "Count"], ["Rope", "14"], ["Sail", "3"]]) for c, t in enumerate(row)]
    return writers.pdf_file([[piece("Stock of the boat house", 72.0, 700.0), *grid], [piece("A second page", 72.0, 700.0)], []], A4)


def test_conversions(spark):
    rows = [(1, table_file()), (2, b"broken"), (3, file_of("x").replace(b"/Info", b"/Encrypt 9 0 R /Info")), (4, writers.pdf_file([[]], A4))]
    sources = spark.createDataFrame(rows, "doc_id long, content binary")
    books = {r["doc_id"]: r for r in conversions.pdf_to_excel(sources).collect()}
    assert (books[1]["tables_found"], books[1]["used_fallback"], books[1]["error"]) == (1, True, None)
    files = zipfile.ZipFile(io.BytesIO(books[1]["data"]))
    assert "Rope" in files.read("xl/worksheets/sheet1.xml").decode() and "<v>14.0</v>" in files.read("xl/worksheets/sheet1.xml").decode()
    assert 'name="Page 1 Table 1"' in files.read("xl/workbook.xml").decode() and 'name="Page 2 text"' in files.read("xl/workbook.xml").decode()
    assert "corrupted" in books[2]["error"] and "password" in books[3]["error"] and books[4]["error"] == writers.NO_TEXT
    words = {r["doc_id"]: r for r in conversions.pdf_to_word(sources).collect()}
    body = zipfile.ZipFile(io.BytesIO(words[1]["data"])).read("word/document.xml").decode()
    assert body.index("Stock of the boat house") < body.index("Rope") < body.index("A second page") < body.index("scanned image")
    assert words[1]["scanned_pages"] == 1 and words[4]["scanned_pages"] == 1 and words[2]["data"] is None and words[3]["data"] is None
    assert len(words) == len(books) == 4


def test_appearances(spark):
    from docloom.operators import objects as O

    rows = [(1, "a", "text", None, None, None, False, "Zoë"), (1, "b", "text", None, None, None, False, "\u0645"), (2, "c", "text", None, None, None, False, "漢"), (3, "d", "checkbox", None, False, None, False, "true")]
    fields = spark.createDataFrame([r[:7] for r in rows], "doc_id int, name string, field_type string, value_str string, value_bool boolean, options array<string>, read_only boolean")
    values = spark.createDataFrame([(r[0], r[1], r[7]) for r in rows], "doc_id int, name string, value string")
    found = {r["name"]: (r["face"], r["need_appearances"]) for r in O.appearance(O.fill_form(fields, values)).collect()}
    assert found["a"] == ("Helvetica", False) and found["b"][0].startswith("NotoNaskh") and found["d"] == (None, False)
    assert all(r["need_appearances"] for r in O.appearance(O.fill_form(fields, values, flatten=False)).collect())


def test_images_must_inflate_to_their_samples(spark):
    from docloom.operators import objects as O

    row = lambda ref, inflated: (1, ref, ["FlateDecode"], 400, 300, 8, "DeviceRGB", None, False, False, False, False, None, None, 90_000, inflated)
    schema = "doc_id int, ref string, filters array<string>, width int, height int, bpc int, cs_family string, icc_n int, image_mask boolean, has_decode boolean, has_decode_parms boolean, has_external boolean, smask_ref string, mask_ref string, n_bytes long, inflated_bytes long"
    images = spark.createDataFrame([row("good", 360_000), row("short", 359_999), row("broken", None)], schema)
    assert {r["ref"]: r["eligible"] for r in O.recompressible(images).collect()} == {"good": True, "short": False, "broken": False}
    assert O.recompressible(images.drop("inflated_bytes")).where(F.col("eligible")).count() == 3
