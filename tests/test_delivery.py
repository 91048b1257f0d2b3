import threading
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import fonts
from docloom.functions.geometry import A4
from docloom.operators import images as M
from docloom.operators import layout as L
from docloom.operators import objects as O
from docloom.operators import session as S
from docloom.operators.html import parse_html
from docloom.sources import assembly, delivery, pdf, writers

from .test_assembly import JPEG, file_of, png, shown


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_empty_session(spark):
    sources, pages = S.empty_session(spark)
    assert sources.collect() == pages.collect() == [] and pages.columns == S.PAGE_COLUMNS
    at = spark.createDataFrame([("s", 3, "b")], "session_id string, index int, page_id string")
    assert S.insert_blank_pages(pages, at).count() == 1


def test_image_kinds_and_origins(spark):
    found = lambda data: one(spark, M.image_kind(F.col("c")), c=data)
    assert found(b"\x89PNG\r") == "png" and found(b"\xff\xd8\xff") == "jpg"
    assert found(b"\x89PNG") is None and found(b"\xff\xd8") is None and found(b"GIF89a") is None
    same = lambda src: one(spark, M.same_origin(F.col("s"), F.lit("https://Fen.example:8080/a/b?c")), s=src)
    assert [same(x) for x in ("x.png", "/y", "//fen.example:8080/z", "data:image/png;base64,AA", "HTTPS://fen.example:8080/q")] == [True] * 5
    assert [same(x) for x in ("https://fen.example/x", "http://fen.example:8080/x", "//other.example/z", "mailto:a@b")] == [False] * 4


def test_page_images(spark):
    images = spark.createDataFrame([(1, "http://a.example/p", s) for s in ("a.png", "b.gif", "http://b.example/c.png", "gone.png", "", None)], "page_id int, page_url string, src string")
    contents = spark.createDataFrame([("a.png", b"\x89PNG\r\n"), ("b.gif", b"GIF89a"), ("http://b.example/c.png", b"\x89PNG\r\n")], "src string, content binary")
    found = M.page_images(images, contents)
    assert {r["src"]: r["kind"] for r in found.collect()} == {"a.png": "png", "b.gif": None, "http://b.example/c.png": None, "gone.png": None}
    assert M.skipped_images(found).first()["skipped_images"] == 3


def test_render_size(spark):
    size = lambda w, h, turn: tuple(one(spark, M.render_size(F.col("w"), F.col("h"), 300, turn), w=w, h=h))
    assert size(600.0, 400.0, 0) == (0.5, 300, 200) and size(600.0, 400.0, 90) == (0.5, 200, 300)
    assert size(595.28, 841.89, 0)[1:] == (213, 300)


@pytest.mark.parametrize("color, channels", [("gray", 1), ("rgb", 3)])
def test_raw_samples(color, channels):
    data = bytes(range(6 * channels))
    rgba = M.raw_to_rgba(data, 3, 2, color)
    assert rgba.shape == (2, 3, 4) and (rgba[..., 3] == 255).all()
    assert rgba[1, 0, :3].tolist() == ([3, 3, 3] if channels == 1 else [9, 10, 11])
    assert M.raw_to_rgba(data[:-1], 3, 2, color) is None and M.raw_to_rgba(data, 0, 2, color) is None
    assert np.array_equal(assembly.png_pixels(M.png_bytes(rgba))[2], rgba[..., :3])


def test_recoding(spark):
    samples = bytes(np.random.default_rng(1).integers(0, 256, 400 * 300 * 3, np.uint8))
    flate = zlib.compress(samples)
    row = lambda ref, data, filters=("FlateDecode",): (1, ref, list(filters), 400, 300, 8, "DeviceRGB", None, False, False, False, False, None, None, len(data), data)
    schema = "doc_id int, ref string, filters array<string>, width int, height int, bpc int, cs_family string, icc_n int, image_mask boolean, has_decode boolean, has_decode_parms boolean, has_external boolean, smask_ref string, mask_ref string, n_bytes long, data binary"
    rows = [row("raw", flate), row("short", zlib.compress(samples[:-3])), row("jpeg", b"J" * 30_000, ["DCTDecode"]), row("fault", b"F" * 30_000, ["DCTDecode"]), row("large", b"L" * 30_000, ["DCTDecode"])]

    def recode(data, kind, raw, longest, quality):
        assert (longest, quality) == (1600, 0.72)
        if data[:1] == b"F":
            raise RuntimeError("no codec")
        if kind == "raw":
            assert raw == (400, 300, "rgb") and data == samples
            return b"r" * 1000, 400, 300
        return (b"j" * 2000 if data[:1] == b"J" else b"l" * 40_000), 400, 300

    found = {r["ref"]: r for r in M.recode_images(spark.createDataFrame(rows, schema), recode).collect()}
    assert {k: r["replaced"] for k, r in found.items()} == {"raw": True, "short": False, "jpeg": True, "fault": False, "large": False}
    assert bytes(found["raw"]["out_data"]) == b"r" * 1000 and found["raw"]["out_filter"] == "DCTDecode" and found["short"]["out_data"] is None
    assert {k: r["out_bytes"] for k, r in found.items()} == {"raw": 1000, "short": len(rows[1][-1]), "jpeg": 2000, "fault": 30_000, "large": 30_000}


def test_files_are_saved_and_heard_of(spark, tmp_path):
    files = spark.createDataFrame([("a.pdf", b"one"), ("b.pdf", b"three"), (None, b"x"), ("c.pdf", None)], "name string, data binary")
    heard = []

    def listen(name, size):
        heard.append((name, size))
        raise RuntimeError("ignored")

    assert delivery.save_files(files, f"file://{tmp_path}/out", listen) == 2
    assert sorted(heard) == [("a.pdf", 3), ("b.pdf", 5)]
    assert sorted((f.name, f.read_bytes()) for f in (tmp_path / "out").iterdir()) == [("a.pdf", b"one"), ("b.pdf", b"three")]


def test_progress_and_cancelling(spark):
    seen_rows, seen = delivery.watched(spark.range(70), "pages")
    assert seen_rows.count() == 70 and seen.get["rows"] == 70
    failed = []

    def work():
        import time

        with delivery.tagged(spark, "long-job"):
            try:
                spark.range(4).repartition(4).mapInPandas(lambda it: (time.sleep(9) or x for x in it), "id long").count()
            except Exception as e:  # noqa: BLE001
                failed.append(str(e))

    thread = threading.Thread(target=work)
    thread.start()
    for _ in range(100):
        delivery.cancel(spark, "long-job")
        thread.join(0.2)
        if not thread.is_alive():
            break
    assert failed and not thread.is_alive()


def test_searchable_pages(spark):
    placed = spark.createDataFrame([(1, 1, "hidden"), (1, 2, "below"), (1, 2, "\u6f22"), (2, 1, "photo")], "doc_id int, page_no int, text string").withColumns({"x": F.lit(10.0), "y": F.lit(20.0), "font_size": F.lit(8.0)})
    sources = spark.createDataFrame([(1, file_of("seen", "too"), "copy"), (2, JPEG, "embed_jpg"), (3, b"no", "copy")], "doc_id int, content binary, action string")
    found = {r["doc_id"]: r for r in assembly.searchable_pdfs(sources, placed).collect()}
    assert shown(found[1]["data"]) == [["seen", "hidden"], ["too", "below"]] and found[1]["skipped_words"] == 1
    assert shown(found[2]["data"]) == [["photo"]] and b"3 Tr" in pdf.Document(bytes(found[2]["data"])).data
    assert found[3]["data"] is None and "corrupted" in found[3]["error"]


def test_compressed_files():
    out, doc = assembly.Assembly(), pdf.Document(file_of("first", "second"))
    known = {}
    for page in doc.pages():
        out.copy(doc, page, 0, known)
    packed = out.file(compressed=True)
    assert b"ObjStm" in packed and b"trailer" not in packed
    assert shown(packed) == [["first"], ["second"]]


FORM = b"""%PDF-1.4
1 0 obj << /Type /Catalog /Pages 2 0 R /AcroForm << /Fields [4 0 R 5 0 R 6 0 R 9 0 R 10 0 R] >> >> endobj
2 0 obj << /Kids [3 0 R] >> endobj 3 0 obj << /Type /Page /MediaBox [0 0 9 9] >> endobj
4 0 obj << /T (address) /FT /Tx /Kids [7 0 R 8 0 R] >> endobj
7 0 obj << /T (street) /V (Mill Lane) >> endobj 8 0 obj << /T <FEFF0074006F0077006E> /V <FEFF00DC> /Ff 1 >> endobj
5 0 obj << /T (news) /FT /Btn /V /Yes /AS /Yes /AP << /N << /Yes 3 0 R /Off 3 0 R >> >> >> endobj
6 0 obj << /T (size) /FT /Ch /Ff 131072 /Opt [(S) [(m) (Medium)]] /V (S) >> endobj
9 0 obj << /T (way) /FT /Btn /Ff 32768 /V /north /Kids [11 0 R 12 0 R] >> endobj
11 0 obj << /AP << /N << /north 3 0 R >> >> >> endobj 12 0 obj << /AP << /N << /south 3 0 R /Off 3 0 R >> >> >> endobj
10 0 obj << /T (go) /FT /Btn /Ff 65536 >> endobj"""


def test_fields_of_files(spark):
    fields = pdf.pdf_fields(spark.createDataFrame([(1, FORM), (2, b"no"), (3, None)], "doc_id int, content binary"))
    found = {r["name"]: r for r in O.described_fields(fields).collect()}
    assert {k: (r["type"], r["value_str"], r["value_bool"], r["options"], r["read_only"]) for k, r in found.items()} == {
        "address.street": ("text", "Mill Lane", None, None, False), "address.town": ("text", "\u00dc", None, None, True), "news": ("checkbox", None, True, None, False),
        "size": ("dropdown", "S", None, ["S", "Medium"], False), "way": ("radio", "north", None, ["north", "south"], False), "go": ("other", "", None, None, False),
    }


def test_faces_of_words():
    block = {"kind": "paragraph", "runs": [{"text": "plain \u0645\u0631 \U0001f600 end", "href": "http://x.example"}]}
    texts = [(d[6], d[7]) for d in L.typeset([block]).drawn if d[1] == "text"]
    assert texts == [("plain ?? ?? end", "Helvetica")]
    fonts.register_metrics("NotoNaskhArabic-Regular", {"\u0645": 500, "\u0631": 400})
    try:
        drawn = L.typeset([block]).drawn
        assert [(d[6], d[7]) for d in drawn if d[1] == "text"][1] == ("\u0645\u0631", "NotoNaskhArabic-Regular")
    finally:
        fonts._metrics.clear()
    assert sum(d[1] == "underline" for d in drawn) == sum(d[1] == "link" for d in drawn) > 0
    assert fonts.text_width("\u00e9", "Helvetica", 10) == fonts.text_width("e", "Helvetica", 10)
    assert fonts.text_width("abc", "Helvetica-Bold", 10) == pytest.approx((556 + 611 + 556) / 100)


def test_text_of_documents(spark):
    rows = [(1, 0, "paragraph", "a", None, None), (1, 1, "table", None, ["h"], [["c", "d"]]), (1, 2, "image", "cap", None, None), (2, 0, "code", "\u2192\n", None, None)]
    blocks = spark.createDataFrame(rows, "doc_id int, ord int, kind string, text string, header array<string>, rows array<array<string>>")
    assert {r["doc_id"]: (r["text"], r["standard_fonts"]) for r in L.document_text(blocks).collect()} == {1: ("a h c d cap", True), 2: ("\u2192\n", False)}


def test_style_attributes():
    (b,) = parse_html("<p><span style='font-weight:700'>a</span><b style='font-weight: normal'>b</b><span style='font-style:italic; font-family: Courier New, monospace'>c</span><i style='text-transform: uppercase'>d</i><span style='display:none'>e</span></p>")
    assert [(r["text"], r["bold"], r["italic"], r["code"]) for r in b[8]] == [("a", True, False, False), ("b", False, False, False), ("c", False, True, True), ("D", False, True, False)]
    assert parse_html("<div style='display: none'><p>x</div><p>y") [0][5] == "y"


def test_configured_hooks_are_used(spark, tmp_path):
    from docloom import plugins

    class Reader:
        def recognise(self, raster, width, height):
            return [{"text": raster.decode(), "x0": 1, "y0": 2, "x1": width, "y1": height}]

        def close(self):
            (tmp_path / "closed").touch()

    rasters = spark.createDataFrame([(1, 1, b"word", 30, 40), (1, 2, None, 30, 40)], "doc_id int, page_no int, raster binary, width int, height int").coalesce(1)
    with pytest.raises(plugins.EngineNotConfiguredError, match="set_recogniser_factory"):
        M.recognised_words(rasters)
    heard = []
    try:
        plugins.set_recogniser_factory(Reader)
        plugins.set_parser(lambda data, known, tries: ("ok", None, [(1.0, 2.0, 0, [("own", [1.0] * 6, 3.0, 4.0, "F")], 0)]))
        plugins.set_output_listener(lambda name, size: heard.append((name, size)))
        assert [tuple(r) for r in M.recognised_words(rasters).collect()] == [(1, 1, 0, "word", 1.0, 2.0, 30.0, 40.0, 30, 40)] and (tmp_path / "closed").exists()
        source = spark.createDataFrame([(1, b"anything")], "doc_id int, content binary")
        assert pdf.pdf_pages(source, "doc_id").first()["width"] == 1.0 and pdf.pdf_text_layer(source).first()["str"] == "own"
        assert delivery.save_files(spark.createDataFrame([("n", b"12")], "name string, data binary"), str(tmp_path)) == 1 and heard == [("n", 2)]
    finally:
        plugins.set_recogniser_factory(None)
        plugins.set_parser(None)
        plugins.set_output_listener(None)
