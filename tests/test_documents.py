import io
import re
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from docloom import plugins
from docloom.functions.geometry import A4
from docloom.operators import layout as L
from docloom.operators import objects as O
from docloom.operators import raster as R
from docloom.operators import session as S
from docloom.operators.markdown import NAMES, markdown_to_blocks, parse_markdown
from docloom.operators.runs import merged, trim_runs
from docloom.sources import files, writers


def blocks(md):
    return [dict(zip(NAMES[1:], b, strict=True)) for b in parse_markdown(md)]


def test_assembly(spark):
    sources = spark.createDataFrame([("s", "a", 0, "a.pdf", "pdf", "application/pdf", 3), ("s", "b", 1, "b.jpg", "image", None, 1), ("s", "c", 2, "c", "pdf", "application/pdf", 2)], "session_id string, source_id string, source_no int, name string, kind string, mime string, page_count int")
    pages = S.source_pages(sources)
    assert pages.count() == 6
    ids = lambda n: pages.where(F.col("pos").isin(n)).select("session_id", "page_id")
    assert S.remove_pages(pages, ids([0, 4])).count() == 4
    turned = S.rotate_pages(S.rotate_pages(pages, ids([0]), 90), ids([0]), 90)
    assert turned.orderBy("pos").first()["rotation"] == 180
    twice = [r["page_id"] for r in S.duplicate_pages(pages, ids([0])).orderBy("pos").collect()]
    assert twice[:3] == ["p-a-0", "p-a-0-copy", "p-a-1"] and len(twice) == 7
    at = spark.createDataFrame([("s", 99, "x")], "session_id string, index int, page_id string")
    last = S.insert_blank_pages(pages, at).orderBy(F.desc("pos")).first()
    assert (last["page_id"], last["pos"], last["blank_w"]) == ("x", 6, A4[0])
    plan = S.export_plan(S.insert_blank_pages(pages, at), sources.where("source_id != 'c'")).orderBy("out_pos").collect()
    assert [r["action"] for r in plan] == ["copy"] * 3 + ["embed_jpg", "blank"]


def test_unique_names(spark):
    rows = spark.createDataFrame([(0, 0, "a.txt"), (0, 1, "a.txt"), (0, 2, "a.txt"), (0, 3, "b"), (0, 4, "b")], "g int, pos int, name string")
    assert [r["unique_name"] for r in S.unique_names(rows, "g", "pos").orderBy("pos").collect()] == ["a.txt", "a (2).txt", "a (3).txt", "b", "b (2)"]


def test_runs():
    none = {"bold": False, "italic": False, "code": False, "href": None}
    assert [r["text"] for r in merged([{"text": "a"} | none, {"text": ""} | none, {"text": "b"}, {"text": "c", "bold": True}])] == ["ab", "c"]
    assert [r["text"] for r in trim_runs([{"text": "  "}, {"text": " a"}, {"text": "b "}, {"text": " "}])] == ["a", "b"]


def test_layout_breaks_pages_and_fits():
    page = L.typeset(blocks("# Head\n\n" + "word " * 3000 + "\n\n" + "x" * 300 + "\n\n- a\n\n" + "| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 90))
    texts = [d for d in page.drawn if d[1] == "text"]
    assert page.page >= 5
    assert all(d[2] >= L.MARGIN and d[2] + d[4] <= A4[0] - L.MARGIN + 0.01 and L.MARGIN - 0.01 <= d[3] <= A4[1] - L.MARGIN for d in texts)
    heads = [d for d in texts if d[6] == "a" and d[7] == "Helvetica-Bold"]
    assert len(heads) == len({d[0] for d in heads}) >= 2  # the header stands on each page of the table
    assert sum(d[6].count("word") for d in texts) == 3000


def test_wrapping():
    lines = L.wrapped([{"text": "aaaa bbbb  cccc", "code": True}], 6 * 9, 10)
    assert ["".join(p.text for p in x).rstrip() for x in lines] == ["aaaa bbbb", "cccc"]
    assert ["".join(p.text for p in x) for x in L.wrapped([{"text": "a" * 20, "code": True}], 6 * 9, 10)] == ["a" * 9, "a" * 9, "aa"]
    assert L.wrapped([{"text": " "}], 50, 10) == [[]]
    assert L.column_widths([10.0, 10.0], 100.0) == [18.0, 18.0]
    assert sum(L.column_widths([500.0, 10.0, 500.0], 400.0)) == pytest.approx(400.0)


def test_files(spark):
    df = spark.createDataFrame([(1, "# T\n\nhello (world) [x](http://a)"), (2, "- a")], "doc_id long, text string")
    pdfs = {r["doc_id"]: bytes(r["data"]) for r in writers.write_pdfs(L.typeset_blocks(markdown_to_blocks(df)), A4).collect()}
    assert pdfs[1].startswith(b"%PDF-1.4") and pdfs[1].rstrip().endswith(b"%%EOF")
    start = int(re.search(rb"startxref\n(\d+)", pdfs[1])[1])
    assert pdfs[1][start : start + 4] == b"xref"
    streams = b"".join(zlib.decompress(x) for x in re.findall(rb"stream\n(.*?)\nendstream", pdfs[1], re.S))
    assert rb"\(world\)" in streams
    book = zipfile.ZipFile(io.BytesIO(writers.workbook([("A & B", [[("x<", None), ("2", 2.0)]])])))
    assert "<v>2.0</v>" in book.read("xl/worksheets/sheet1.xml").decode() and "x&lt;" in book.read("xl/worksheets/sheet1.xml").decode()
    with pytest.raises(ValueError):
        writers.workbook([])
    word = zipfile.ZipFile(io.BytesIO(writers.word_document([[("heading1", "T"), ("table", [["a"], ["b"]])], [("note", "n")]])))
    assert word.testzip() is None and "Heading1" in word.read("word/document.xml").decode()


def test_bundle_and_sources(spark, tmp_path):
    rows = spark.createDataFrame([("g", 0, "a.txt", b"1"), ("g", 1, "a.txt", b"2"), ("h", 0, "b", b"3")], "k string, pos int, name string, data binary")
    out = {r["k"]: (r["name"], bytes(r["data"])) for r in writers.bundle(rows, "k").collect()}
    assert out["h"] == ("b", b"3")
    assert zipfile.ZipFile(io.BytesIO(out["g"][1])).namelist() == ["a.txt", "a (2).txt"]
    (tmp_path / "x.bin").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "y.png").write_bytes(b"\x89PNG")
    assert {r["name"]: r["kind"] for r in files.binary_sources(spark, str(tmp_path)).collect()} == {"x.bin": "pdf", "y.png": "image"}
    raw = spark.createDataFrame([(1, 1, 0, "a", [1.0, 0.0, 3.0, 4.0, 7.0, 8.0], 2.0, 0.0, "ABlackFont"), (1, 1, 1, None, [1.0] * 6, 0.0, 0.0, "x")], "doc_id int, page_no int, item_no int, str string, transform array<double>, w double, h double, font_name string")
    (item,) = files.text_items(raw).collect()
    assert (item["x"], item["y"], item["font_size"], item["h"], item["bold"]) == (7.0, 8.0, 5.0, 5.0, True)


def test_forms(spark):
    fields = spark.createDataFrame([(1, "t", "text", "o", None, None, False), (1, "c", "checkbox", None, False, None, False), (1, "r", "radio", "a", None, ["a", "b"], False), (1, "d", "dropdown", "a", None, ["a"], False), (1, "q", "text", "o", None, None, True)], "doc_id int, name string, field_type string, value_str string, value_bool boolean, options array<string>, read_only boolean")
    values = spark.createDataFrame([(1, "t", "n"), (1, "c", "true"), (1, "r", "z"), (1, "d", "own"), (1, "q", "n"), (1, "none", "n")], "doc_id int, name string, value string")
    out = {r["name"]: (r["value_str"], r["value_bool"], r["touched"]) for r in O.fill_form(fields, values).collect()}
    assert out == {"t": ("n", None, True), "c": (None, True, True), "r": ("a", None, False), "d": ("own", None, True), "q": ("o", None, False)}


def test_words(spark):
    schema = "doc_id int, page_no int, blocks array<struct<paragraphs:array<struct<lines:array<struct<words:array<struct<text:string,x0:double>>>>>>>>"
    tree = [([([([("a", 1.0), ("b", 2.0)],), (None,)],), (None,)],), (None,)]
    words = O.flattened_words(spark.createDataFrame([(1, 1, tree), (1, 2, None)], schema))
    assert [(r["word_no"], r["text"]) for r in words.orderBy("word_no").collect()] == [(0, "a"), (1, "b")]
    text = O.recognised_text(spark.createDataFrame([(1, 1, " a "), (1, 2, "b"), (2, 1, "c ")], "doc_id int, page_no int, text string"))
    assert {r["doc_id"]: r["text"] for r in text.collect()} == {1: "──── Page 1 ────\na\n\n──── Page 2 ────\nb", 2: "c"}


def test_raster_forms_agree(spark):
    import numpy as np

    rgb = np.full((40, 60, 3), 250, np.uint8)
    for x in range(60):
        for y in (10, 20, 30):
            rgb[min(39, int(y + x * np.tan(np.radians(3.0)) + 0.5)), x] = 10
    assert R.skew_of(rgb) == pytest.approx(3.0, abs=0.5)
    assert R.skew_of(np.full((5, 5, 3), 9, np.uint8)) == 0.0
    pixels = spark.createDataFrame([(1, x, y, *map(int, rgb[y, x])) for y in range(40) for x in range(60)], "img_id int, x int, y int, r int, g int, b int")
    assert R.estimated_skew(pixels).first()["angle"] == R.skew_of(rgb)
    level = {(r["x"], r["y"]): r["r"] for r in R.auto_levels(pixels).collect()}
    assert np.array_equal(R.levelled(rgb)[..., 0], np.array([[level[x, y] for x in range(60)] for y in range(40)]))
    images = spark.createDataFrame([(1, 60, 40, bytes(rgb.tobytes()))], "img_id int, width int, height int, pixels binary")
    out = R.clean_images(images, grayscale=True).first()
    assert out["angle"] == R.skew_of(rgb) and len(out["pixels"]) == 60 * 40 * 3


def test_plugins():
    assert not plugins.is_configured("parser")
    with pytest.raises(plugins.EngineNotConfiguredError, match="set_parser"):
        plugins.hook("parser")
    plugins.set_parser(lambda data: len(data))
    assert plugins.hook("parser")(b"abc") == 3
    plugins.set_parser(None)
    plugins.set_output_listener(lambda name, size: 1 / 0)
    plugins.notify("x", 1)
    plugins.set_output_listener(None)


def test_stream(spark, tmp_path, sf_dir):
    from docloom.operators.textblocks import text_to_blocks
    from docloom.streaming.blocks import read_text_stream, write_stream

    source = tmp_path / "in"
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.parquet(str(source))
    write_stream(read_text_stream(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "ck"), text_to_blocks).awaitTermination(120)
    batch = text_to_blocks(spark.read.parquet(str(source)))
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count() > 0
