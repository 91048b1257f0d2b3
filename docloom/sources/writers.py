"""Files out: workbooks, word-processing documents, archives and PDF, from tables.

Each file is one group of rows; its bytes are made where the group is and come
back as a column, so that any Spark sink can store them.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.fonts import MONO

STAMP = (1980, 1, 1, 0, 0, 0)
XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Parts of the Office Open XML packages.
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
NO_TEXT = "No selectable text — this looks like a scanned PDF. Run OCR first."


def archive(files: list[tuple[str, bytes | str]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files:
            z.writestr(zipfile.ZipInfo(name, STAMP), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def content_types(parts: dict[str, str]) -> str:
    each = "".join(f'<Override PartName="{p}" ContentType="{t}"/>' for p, t in parts.items())
    return f'{XML}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{each}</Types>'


def relations(targets: list[tuple[str, str]]) -> str:
    each = "".join(f'<Relationship Id="rId{k}" Type="{OFFICE}/{kind}" Target="{to}"/>' for k, (kind, to) in enumerate(targets, 1))
    return f'{XML}<Relationships xmlns="{PACKAGE}/relationships">{each}</Relationships>'


def column_letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook(sheets: list[tuple[str, list[list[tuple[str, float | None]]]]]) -> bytes:
    """An .xlsx file of named sheets; cells are (text, number or None)."""
    if not sheets:
        raise ValueError(NO_TEXT)
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files = [
        ("[Content_Types].xml", content_types({"/xl/workbook.xml": f"{kind}.sheet.main+xml"} | {f"/xl/worksheets/sheet{k}.xml": f"{kind}.worksheet+xml" for k in range(1, len(sheets) + 1)})),
        ("_rels/.rels", relations([("officeDocument", "xl/workbook.xml")])),
        ("xl/_rels/workbook.xml.rels", relations([("worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(sheets) + 1)])),
        ("xl/workbook.xml", f'{XML}<workbook xmlns="{SHEET}" xmlns:r="{OFFICE}"><sheets>' + "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>"),
    ]
    for k, (_, rows) in enumerate(sheets, 1):
        body = ""
        for r, row in enumerate(rows, 1):
            cells = "".join(f'<c r="{column_letters(c)}{r}"><v>{v!r}</v></c>' if v is not None else f'<c r="{column_letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(t)}</t></is></c>' for c, (t, v) in enumerate(row))
            body += f'<row r="{r}">{cells}</row>'
        files.append((f"xl/worksheets/sheet{k}.xml", f'{XML}<worksheet xmlns="{SHEET}"><sheetData>{body}</sheetData></worksheet>'))
    return archive(files)


def word_document(pages: list[list[tuple]]) -> bytes:
    """A .docx file with a section for each page; parts are (kind, text) or ("table", rows)."""
    def paragraph(text: str, style: str = "", bold: bool = False, italic: bool = False) -> str:
        look = f"<w:rPr>{'<w:b/>' * bold}{'<w:i/>' * italic}</w:rPr>" if bold or italic else ""
        head = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f'<w:p>{head}<w:r>{look}<w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    def table(rows: list[list[str]]) -> str:
        body = "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c, bold=r == 0)}</w:tc>" for c in row) + "</w:tr>" for r, row in enumerate(rows))
        return f'<w:tbl><w:tblPr><w:tblW w:w="5000" w:type="pct"/></w:tblPr>{body}</w:tbl><w:p/>'

    styles = {"heading1": "Heading1", "heading2": "Heading2", "bullet": "ListBullet"}
    body = ""
    for k, parts in enumerate(pages):
        body += "".join(table(p[1]) if p[0] == "table" else paragraph(p[1], styles.get(p[0], ""), italic=p[0] == "note") for p in parts)
        body += "<w:p><w:pPr><w:sectPr/></w:pPr></w:p>" if k + 1 < len(pages) else "<w:sectPr/>"
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    style = "".join(f'<w:style w:type="paragraph" w:styleId="{s}"><w:name w:val="{n}"/></w:style>' for s, n in (("Heading1", "heading 1"), ("Heading2", "heading 2"), ("ListBullet", "List Bullet")))
    return archive([
        ("[Content_Types].xml", content_types({"/word/document.xml": f"{main}.document.main+xml", "/word/styles.xml": f"{main}.styles+xml"})),
        ("_rels/.rels", relations([("officeDocument", "word/document.xml")])),
        ("word/_rels/document.xml.rels", relations([("styles", "styles.xml")])),
        ("word/styles.xml", f'{XML}<w:styles xmlns:w="{WORD}">{style}</w:styles>'),
        ("word/document.xml", f'{XML}<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>'),
    ])


def pdf_text(text: str) -> bytes:
    return b"(" + text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def pdf_file(pages: list[list[dict]], size: tuple[float, float], title: str = "", producer: str = "docloom") -> bytes:
    """A PDF of drawn pieces (what, x, y, w, h, text, face, size, href) by page."""
    faces = list(dict.fromkeys(["Helvetica", MONO, *(d["face"] for p in pages for d in p if d["face"])]))
    objects: list[bytes] = []

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    catalog, tree = add(b""), add(b"")
    fonts = {f: add(f"<< /Type /Font /Subtype /Type1 /BaseFont /{f} /Encoding /WinAnsiEncoding >>".encode()) for f in faces}
    names = {f: f"F{k}" for k, f in enumerate(faces)}
    resources = add(("<< /Font << " + " ".join(f"/{names[f]} {n} 0 R" for f, n in fonts.items()) + " >> >>").encode())
    kids = []
    for pieces in pages:
        out, links = [], []
        for d in pieces:
            if d["what"] == "text":
                out.append(f"BT /{names[d['face']]} {d['size']:.4g} Tf 1 0 0 1 {d['x']:.4f} {d['y']:.4f} Tm ".encode() + pdf_text(d["text"]) + b" Tj ET")
            elif d["what"] == "link":
                uri = pdf_text(d["href"]).decode("latin-1")
                links.append(add(f"<< /Type /Annot /Subtype /Link /Border [0 0 0] /Rect [{d['x']:.3f} {d['y']:.3f} {d['x'] + d['w']:.3f} {d['y'] + d['h']:.3f}] /A << /S /URI /URI {uri} >> >>".encode("latin-1")))
            elif d["what"] in ("rule", "bar", "box", "cell", "underline"):
                fill = "S" if d["what"] == "cell" else "f"
                out.append(f"q 0.8 g 0.75 G 0.5 w {d['x']:.3f} {d['y']:.3f} {d['w']:.3f} {d['h']:.3f} re {fill} Q".encode())
        data = zlib.compress(b"\n".join(out))
        stream = add(f"<< /Length {len(data)} /Filter /FlateDecode >>\nstream\n".encode() + data + b"\nendstream")
        notes = f" /Annots [{' '.join(f'{n} 0 R' for n in links)}]" if links else ""
        kids.append(add(f"<< /Type /Page /Parent {tree} 0 R /MediaBox [0 0 {size[0]:.2f} {size[1]:.2f}] /Resources {resources} 0 R /Contents {stream} 0 R{notes} >>".encode()))
    objects[catalog - 1] = f"<< /Type /Catalog /Pages {tree} 0 R >>".encode()
    objects[tree - 1] = f"<< /Type /Pages /Kids [{' '.join(f'{k} 0 R' for k in kids)}] /Count {len(kids)} >>".encode()
    info = add(b"<< /Producer " + pdf_text(producer) + (b" /Title " + pdf_text(title) if title else b"") + b" >>")
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{k} 0 obj\n".encode() + body + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    out += f"trailer\n<< /Size {len(objects) + 1} /Root {catalog} 0 R /Info {info} 0 R >>\nstartxref\n{start}\n%%EOF\n".encode()
    return bytes(out)


def per_file(rows: DataFrame, key: str, make, suffix: str) -> DataFrame:
    """(key, name, data): make(pandas rows of a key) as a file of each key."""
    kind = rows.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        value = pdf[key].iloc[0]
        return pd.DataFrame({key: [value], "name": [f"{value}{suffix}"], "data": [make(pdf.astype(object).where(pdf.notna(), None))]})

    return rows.groupBy(key).applyInPandas(run, f"{key} {kind}, name string, data binary")


def page_order(sheet: str) -> list:
    """Sorts numbers in a sheet's name by value, so that page 10 comes behind page 2."""
    return [(int(x), "") if x.isdigit() else (-1, x) for x in re.split(r"(\d+)", sheet) if x]


def write_workbooks(cells: DataFrame, key: str = "doc_id", files: DataFrame | None = None) -> DataFrame:
    """Workbooks from sheet, row_no, col_no, text, number: key, name, data and error.
    files: the keys of all files; those without cells come back without data and with an error."""
    def make(pdf: pd.DataFrame) -> bytes:
        sheets = []
        for name, sheet in sorted(pdf.groupby("sheet"), key=lambda x: page_order(x[0])):
            rows: dict[int, dict[int, tuple]] = {}
            for r in sheet.itertuples():
                rows.setdefault(r.row_no, {})[r.col_no] = (r.text or "", None if r.number is None else float(r.number))
            sheets.append((name, [[row.get(c, ("", None)) for c in range(max(row) + 1)] for _, row in sorted(rows.items())]))
        return workbook(sheets)

    made = per_file(cells, key, make, ".xlsx").withColumn("error", F.lit(None).cast("string"))
    if files is None:
        return made
    empty = files.select(key).distinct().join(cells.select(key).distinct(), key, "left_anti")
    return made.unionByName(empty.select(key, F.lit(None).cast("string").alias("name"), F.lit(None).cast("binary").alias("data"), F.lit(NO_TEXT).alias("error")))


def write_pdfs(drawn: DataFrame, size: tuple[float, float], key: str = "doc_id") -> DataFrame:
    """PDF files from drawn pieces with draw_no and page_no."""
    def make(pdf: pd.DataFrame) -> bytes:
        pages: list[list[dict]] = [[] for _ in range(int(pdf.page_no.max()) + 1)]
        for d in pdf.sort_values("draw_no").to_dict("records"):
            pages[int(d["page_no"])].append(d)
        return pdf_file(pages, size)

    return per_file(drawn, key, make, ".pdf")


def write_word_documents(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Word-processing documents from page_no, part, row_no, col_no, kind and text."""
    def make(pdf: pd.DataFrame) -> bytes:
        pages = []
        for _, page in pdf.groupby("page_no", sort=True):
            found: list[tuple] = []
            for _, part in page.groupby("part", sort=True):
                if part.kind.iloc[0] == "cell":
                    found.append(("table", [list(r.sort_values("col_no").text) for _, r in part.groupby("row_no", sort=True)]))
                else:
                    found += [(r.kind, r.text) for r in part.sort_values("row_no").itertuples()]
            pages.append(found)
        return word_document(pages)

    return per_file(parts, key, make, ".docx")


def bundle(files: DataFrame, key: str) -> DataFrame:
    """One file as it is, two and more as an archive with distinct names: (key, name, data)."""
    from docloom.operators.session import unique_names

    named = unique_names(files, key, "pos")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        one = len(pdf) == 1
        data = pdf.data.iloc[0] if one else archive(list(zip(pdf.unique_name, map(bytes, pdf.data), strict=True)))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "name": [pdf.unique_name.iloc[0] if one else f"{pdf[key].iloc[0]}.zip"], "data": [data]})

    return named.groupBy(key).applyInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, name string, data binary")
