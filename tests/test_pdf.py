from docloom.functions.geometry import A4
from docloom.operators.items import blocks_of, tables_of
from docloom.operators.layout import typeset_blocks
from docloom.operators.markdown import markdown_to_blocks
from docloom.sources import files, pdf, writers

MD = "# A title\n\n" + "Some (body) copy that is long enough to fill more than a single line of the page, so that it wraps on. " * 2 + "\n\n| Name | Qty |\n|---|---|\n| Apple | 2 |\n| Pear | 5 |\n"


def test_round_trip_from_markdown(spark):
    docs = spark.createDataFrame([(7, MD)], "doc_id long, text string")
    made = writers.write_pdfs(typeset_blocks(markdown_to_blocks(docs)), A4).selectExpr("doc_id", "data AS content")
    page = pdf.pdf_pages(made, "doc_id").first()
    assert (page["page_no"], page["status"], round(page["width"], 2)) == (1, "ok", 595.28)
    items = [r.asDict() for r in files.text_items(pdf.pdf_text_layer(made)).orderBy("item_no").collect()]
    blocks = blocks_of(items)
    assert blocks[0] == ("heading1", "A title")
    assert blocks[1][1].startswith("Some (body) copy") and blocks[1][1].endswith("wraps on.")
    assert tables_of(items)[0]["rows"] == [["Name", "Qty"], ["Apple", "2"], ["Pear", "5"]]


def test_status():
    good = writers.pdf_file([[]], A4)
    assert pdf.read(good)[0] == "ok"
    assert pdf.read(good.replace(b"/Info", b"/Encrypt 1 0 R /Info"))[0] == "encrypted"
    assert pdf.read(b"nothing")[0] == "corrupt" and pdf.read(None)[0] == "corrupt"


def test_syntax():
    found = list(pdf.objects_in(rb"<< /A#42 [1 -2.5 (a\(b\)\051\n) <4142>] /R 3 0 R >> true BT"))
    assert found[0] == {"AB": [1, -2.5, b"a(b))\n", b"AB"], "R": 3} and found[1] is True and found[2] == b"BT"


def test_text_operators():
    page = b"BT /F1 10 Tf 12 TL 1 0 0 1 50 700 Tm (one) Tj T* [(t) -500 (wo)] TJ 0 -30 Td (three) ' ET"
    import zlib

    body = zlib.compress(page)
    out = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids [3 0 R] /MediaBox [0 0 200 800] /Rotate 90 >> endobj "
    out += b"3 0 obj << /Type /Page /Contents 4 0 R /Resources << /Font << /F1 << /BaseFont /Courier >> >> >> >> endobj 4 0 obj << /Filter /FlateDecode /Length %d >> stream\n" % len(body) + body + b"\nendstream endobj"
    status, _, ((w, h, rotation, texts, faults),) = pdf.read(out)
    assert (status, w, h, rotation, faults) == ("ok", 200.0, 800.0, 90, 0)
    assert [(t[0], t[1][4], t[1][5]) for t in texts] == [("one", 50.0, 700.0), ("t", 50.0, 688.0), ("wo", 61.0, 688.0), ("three", 50.0, 646.0)]


def document(page, objects=(), extra=b""):
    """A file of one page; objects are numbered from 4, the first being the page's contents."""
    out = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids [3 0 R] >> endobj 3 0 obj << /Type /Page /Contents 4 0 R " + page + b" >> endobj "
    for number, (head, data) in enumerate(objects, 4):
        out += b"%d 0 obj << %s /Length %d >> stream\n" % (number, head, len(data)) + data + b"\nendstream endobj "
    return out + extra


FONT = b"/Resources << /Font << /F1 << /BaseFont /Courier >> >> /XObject << /X1 5 0 R >> >>"
TEXT = b"BT /F1 10 Tf 1 0 0 1 5 6 Tm (hi) Tj ET"


def texts(data):
    return [(t[0], t[1][4:]) for t in pdf.read(data)[2][0][3]]


def test_filters_and_forms():
    import base64
    import zlib

    packed = zlib.compress(TEXT)
    for head, data in ((b"/Filter [/AHx /FlateDecode]", packed.hex().encode() + b">"), (b"/Filter [/ASCII85Decode /Fl]", base64.a85encode(packed) + b"~>"), (b"/Filter /RL", bytes((len(TEXT) - 1,)) + TEXT + b"\x80"), (b"", TEXT)):
        assert texts(document(FONT, [(head, data)])) == [("hi", [5.0, 6.0])]
    form = [(b"", b"q 2 0 0 2 10 20 cm /X1 Do Q"), (b"/Subtype /Form /Matrix [1 0 0 1 1 1]", TEXT)]
    assert texts(document(FONT, form)) == [("hi", [22.0, 34.0])]
    status, _, ((*_, found, faults),) = pdf.read(document(FONT, [(b"", b"/X1 Do " + TEXT), (b"/Subtype /Form", b"/X1 Do")]))
    assert (status, len(found), faults) == ("ok", 1, 1)  # a form that holds itself ends


def test_broken_files_are_rows(spark):
    good = document(FONT + b" /MediaBox [0 0 50 60]", [(b"", TEXT)])
    rows = [("box", good.replace(b"[0 0 50 60]", b"[0 0]")), ("filter", document(FONT, [(b"/Filter /JBIG2Decode", TEXT)])), ("flate", document(FONT, [(b"/Filter /FlateDecode", b"nothing")])), ("none", None), ("good", good)]
    rows += [(f"cut{k}", good[:k]) for k in range(0, len(good), 7)] + [(f"bad{k}", good[:k] + b"<<[(" + good[k + 4 :]) for k in range(0, len(good), 11)]
    found = {r["source_id"]: r for r in pdf.pdf_pages(spark.createDataFrame(rows, "source_id string, content binary")).collect()}
    assert len(found) == len(rows)
    assert (found["box"]["status"], found["box"]["width"], found["box"]["height"]) == ("ok", 612.0, 792.0)
    assert found["filter"]["status"] == found["flate"]["status"] == "partial" and found["none"]["status"] == "corrupt"
    assert (found["good"]["status"], found["good"]["width"]) == ("ok", 50.0)
