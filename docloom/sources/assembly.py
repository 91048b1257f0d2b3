"""Assembled PDF files: pages copied from source files, images over whole pages, blank pages.

The plan of a session (operators.session.export_plan) and the contents of its sources
meet by session, and one file is one task's work; a source is parsed once a session.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import CORRUPT, ENCRYPTED
from docloom.operators.session import NOTHING_LEFT
from docloom.sources.pdf import FAULTS, WRONG_PASSWORD, Document, Name, PdfError, Ref, Word, page_box, unfiltered
from docloom.sources.security import Handler, new_handler

A4 = (595.28, 841.89)
#: Keys of a page that stay with its copy; the rest of a document hangs on others.
PAGE_KEYS = ("MediaBox", "CropBox", "BleedBox", "TrimBox", "ArtBox", "Resources", "Contents", "Rotate", "Annots", "Group", "UserUnit")


OVER = "FOver"
FACE = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}


class Made(Ref):
    """A reference to an object of the new file."""


def written(value, number) -> bytes:
    """PDF syntax of a value; number(ref) gives a reference's number in the new file."""
    if isinstance(value, Ref):
        return b"%d 0 R" % number(value)
    if isinstance(value, Name):
        return b"/" + b"".join(bytes((c,)) if 33 <= c < 127 and c not in b"#()<>[]{}/%" else b"#%02X" % c for c in value.encode("latin-1"))
    if isinstance(value, Word):
        return bytes(value)
    if isinstance(value, bytes):
        return b"<" + value.hex().encode() + b">"
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        return f"{value:.6f}".rstrip("0").rstrip(".").encode()
    if isinstance(value, list):
        return b"[" + b" ".join(written(v, number) for v in value) + b"]"
    return b"<< " + b" ".join(written(Name(k), number) + b" " + written(v, number) for k, v in value.items()) + b" >>"


def rewritten(doc: Document, handler: Handler | None = None) -> bytes:
    """All objects of a document anew, under their numbers; closed by the handler where one is given."""
    numbers = sorted(n for n in {*doc.places, *doc.known} if n != doc.security)
    kept = [(n, doc.value(n)) for n in numbers]
    kept = [(n, v) for n, v in kept if v is not None and not (isinstance(v, dict) and v.get("Type") in ("ObjStm", "XRef"))]
    root = next((n for n, v in kept if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
    if root is None:
        raise PdfError("no catalog")

    def closed(value, n: int):
        if isinstance(value, Word) or handler is None:
            return value
        if isinstance(value, bytes):
            return handler.encrypt(value, n)
        if isinstance(value, list):
            return [closed(v, n) for v in value]
        return {k: closed(v, n) for k, v in value.items()} if isinstance(value, dict) else value

    out, places = bytearray(b"%PDF-1.6\n%\xe2\xe3\xcf\xd3\n"), {}

    def put(n: int, body: bytes) -> None:
        places[n] = len(out)
        out.extend(b"%d 0 obj\n" % n + body + b"\nendobj\n")

    for n, value in kept:
        data = doc.raw(n) if n in doc.places else None
        if data is None:
            put(n, written(closed(value, n), int))
        else:
            data = handler.encrypt(data, n) if handler else data
            put(n, written(closed(value, n) | {"Length": len(data)}, int) + b"\nstream\n" + data + b"\nendstream")
    last = max(places) + 1
    trailer = {"Root": Ref(root)}
    if isinstance(doc.trailer.get("Info"), Ref) and int(doc.trailer["Info"]) in places:
        trailer["Info"] = doc.trailer["Info"]
    if handler:
        filters = {"StdCF": {"CFM": Name("AESV2"), "AuthEvent": Name("DocOpen"), "Length": 16}}
        head = {"Filter": Name("Standard"), "V": 4, "R": 4, "Length": 128, "CF": filters, "StmF": Name("StdCF"), "StrF": Name("StdCF"), "O": handler.owner, "U": handler.user, "P": handler.permissions}
        put(last, written(head, int))
        trailer |= {"Encrypt": Ref(last), "ID": [handler.file_id, handler.file_id]}
        last += 1
    start = len(out)
    lines = b"".join(b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 65535 f \n" for n in range(last))
    return bytes(out + b"xref\n0 %d\n" % last + lines + b"trailer\n" + written(trailer | {"Size": last}, int) + b"\nstartxref\n%d\n%%%%EOF\n" % start)


def protected(data: bytes, user: str, owner: str | None = None, current: str | None = None) -> bytes:
    """The file under a password (the owner's is the user's by default), without permissions."""
    doc = Document(data, current)
    if doc.encrypted:
        raise PdfError(ENCRYPTED)
    return rewritten(doc, new_handler(user, owner, hashlib.md5(data, usedforsecurity=False).digest()))


def unlocked(data: bytes, password: str) -> bytes:
    doc = Document(data, password)
    if doc.encrypted:
        raise PdfError(WRONG_PASSWORD)
    return rewritten(doc)


def per_source(sources: DataFrame, key: str, content: str, f) -> DataFrame:
    """key, data, error: f(row as a dict) of each file."""
    kind = sources.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                try:
                    data, error = f(row), None
                except FAULTS as e:
                    data, error = None, str(e) if str(e) in (ENCRYPTED, WRONG_PASSWORD) else CORRUPT
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(k, 1), pa.array([data], pa.binary()), pa.array([error], pa.string())], [key, "data", "error"])

    return sources.mapInArrow(run, f"{key} {kind}, data binary, error string")


def protect_pdfs(sources: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """Files under new passwords: sources has user_password and may have owner_password and password (the present one)."""
    return per_source(sources, key, content, lambda r: protected(r[content] or b"", r["user_password"], r.get("owner_password"), r.get("password")))


def unlock_pdfs(sources: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """Files without their password (column password)."""
    return per_source(sources, key, content, lambda r: unlocked(r[content] or b"", r["password"]))


class Assembly:
    """The objects of a file in the making."""

    def __init__(self):
        self.objects: list[bytes] = [b"", b""]  # the catalogue and the page tree
        self.pages: list[int] = []

    def add(self, body: bytes = b"") -> int:
        self.objects.append(body)
        return len(self.objects)

    def stream(self, head: dict, data: bytes, number=int) -> int:
        return self.add(written({**head, "Length": len(data)}, number) + b"\nstream\n" + data + b"\nendstream")

    def page(self, body: dict, number=int) -> None:
        self.pages.append(self.add(written({"Type": Name("Page"), "Parent": Ref(2)} | body, number)))

    def blank(self, width: float, height: float, rotation: int) -> None:
        self.page({"MediaBox": [0, 0, width, height]} | ({"Rotate": rotation} if rotation else {}))

    def copy(self, doc: Document, page: dict, rotation: int, known: dict[int, int], over: bytes = b"") -> None:
        """A page with all that it needs; known: numbers of objects copied from this source;
        over: operators that are shown after the page's own, in the face OVER."""
        todo: list[int] = []

        def number(ref: Ref) -> int:
            if int(ref) not in known:
                known[int(ref)] = self.add()
                todo.append(int(ref))
            return known[int(ref)]

        body = {k: page[k] for k in PAGE_KEYS if k in page} | {"MediaBox": page_box(doc, page)}
        old = doc.get(page, "Rotate", 0)
        turn = ((int(old) if isinstance(old, (int, float)) else 0) + rotation) % 360
        own = {k: v for k, v in body.items() if k != "Rotate"} | ({"Rotate": turn} if turn else {})
        fresh = lambda ref: int(ref) if isinstance(ref, Made) else number(ref)
        if over:
            resources = doc.get(page, "Resources", {})
            faces = doc.get(resources, "Font", {}) | {OVER: FACE}
            before = doc.resolve(page.get("Contents"))
            before = before if isinstance(before, list) else [page["Contents"]] if "Contents" in page else []
            parts = [Made(self.stream({}, b"q")), *before, Made(self.stream({}, b"Q")), Made(self.stream({}, over))]
            own |= {"Resources": resources | {"Font": faces}, "Contents": parts}
        self.page(own, fresh)
        while todo:
            ref = todo.pop()
            value, data = doc.value(ref), doc.raw(ref)
            if isinstance(value, dict):  # annotations point back to pages and parents, which stay behind
                value = {k: v for k, v in value.items() if k not in ("Parent", "P", "Dest", "Popup", "StructParent") and not (k == "A" and doc.get(doc.resolve(v), "S") == "GoTo")}
                if value.get("Type") in ("Page", "Pages", "Catalog"):
                    value = None
            body = written(value if data is None else value | {"Length": len(data)}, number)
            self.objects[known[ref] - 1] = body if data is None else body + b"\nstream\n" + data + b"\nendstream"

    def image(self, head: dict, data: bytes, width: int, height: int, rotation: int, alpha: bytes | None = None, over: bytes = b"") -> None:
        kind = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": height}
        if alpha is not None:
            mask = {"ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8, "Filter": Name("FlateDecode")}
            head = head | {"SMask": Ref(self.stream(kind | mask, zlib.compress(alpha)))}
        image = self.stream(kind | head, data)
        contents = self.stream({}, b"q %d 0 0 %d 0 0 cm /Im0 Do Q " % (width, height) + over)
        self.page({"MediaBox": [0, 0, width, height], "Resources": {"XObject": {"Im0": Ref(image)}, "Font": {OVER: FACE}}, "Contents": Ref(contents)} | ({"Rotate": rotation} if rotation else {}))

    def file(self, compressed: bool = False) -> bytes:
        """The whole file; compressed: objects without streams share one, as newer readers take it."""
        self.objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
        self.objects[1] = b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % p for p in self.pages) + b"] /Count %d >>" % len(self.pages)
        out, places = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), []
        if compressed:
            return self.compressed(out)
        for k, body in enumerate(self.objects, 1):
            places.append(len(out))
            out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
        return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(places) + 1, start))


    def compressed(self, out: bytearray) -> bytes:
        inside = [k for k, body in enumerate(self.objects, 1) if b"stream\n" not in body]
        at, heads, bodies = 0, [], []
        for k in inside:
            heads.append(b"%d %d" % (k, at))
            bodies.append(self.objects[k - 1])
            at += len(bodies[-1]) + 1
        head = b" ".join(heads) + b" "
        data = zlib.compress(head + b"\n".join(bodies))
        packed = self.stream({"Type": Name("ObjStm"), "N": len(inside), "First": len(head), "Filter": Name("FlateDecode")}, data)
        rows = {k: (2, packed, n) for n, k in enumerate(inside)}
        for k, body in enumerate(self.objects, 1):
            if k not in rows:
                rows[k] = (1, len(out), 0)
                out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
        last, start = len(self.objects) + 1, len(out)
        rows[last] = (1, start, 0)
        table = struct.pack(">BIH", 0, 0, 65535) + b"".join(struct.pack(">BIH", *rows[k]) for k in range(1, last + 1))
        data = zlib.compress(table)
        head = {"Type": Name("XRef"), "Size": last + 1, "W": [1, 4, 2], "Root": Ref(1), "Filter": Name("FlateDecode"), "Length": len(data)}
        out += b"%d 0 obj\n" % last + written(head, int) + b"\nstream\n" + data + b"\nendstream\nendobj\n"
        return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def jpeg_size(data: bytes) -> tuple[int, int, int]:
    """Width, height and number of components, from the frame header."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width, n = struct.unpack_from(">HHB", data, at + 5)
            return width, height, n
        else:
            at += 2 if mark == 1 or 0xD0 <= mark <= 0xD8 else 2 + struct.unpack_from(">H", data, at + 2)[0]
    raise PdfError("no JPEG frame")


def png_pixels(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray | None]:
    """Width, height, 8-bit samples (height, width, 1 or 3) and alpha of a PNG file without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise PdfError("no PNG file")
    at, parts = 8, {}
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        parts[kind] = parts.get(kind, b"") + data[at + 8 : at + 8 + size]
        at += size + 12
    width, height, depth, color, _, _, interlaced = struct.unpack_from(">IIBBBBB", parts.get(b"IHDR", b""))
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if interlaced or not channels or depth not in (1, 2, 4, 8, 16) or not width or not height:
        raise PdfError("a PNG layout that isn't read")
    row = (width * channels * depth + 7) // 8
    flat = unfiltered(zlib.decompressobj().decompress(parts.get(b"IDAT", b""), (row + 1) * height), row, max(1, channels * depth // 8))
    rows = np.frombuffer(flat, np.uint8).reshape(height, row)
    if depth == 16:
        values = rows.reshape(height, width, channels, 2)[..., 0]
    elif depth == 8:
        values = rows.reshape(height, width, channels)
    else:
        bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(height, width, depth)
        values = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2, keepdims=True).astype(np.uint8)
        values = values if color == 3 else (values.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    if color == 3:
        table = np.frombuffer(parts.get(b"PLTE", b""), np.uint8).reshape(-1, 3)
        clear = np.frombuffer(parts.get(b"tRNS", b"").ljust(len(table), b"\xff"), np.uint8)
        place = np.minimum(values[..., 0], len(table) - 1)
        return width, height, table[place], clear[place] if b"tRNS" in parts else None
    return (width, height, values[..., :-1], values[..., -1]) if color in (4, 6) else (width, height, values, None)


def embed(out: Assembly, action: str, data: bytes, rotation: int, over: bytes = b"") -> None:
    if action == "embed_jpg":
        width, height, n = jpeg_size(data)
        space = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}.get(n, "DeviceRGB")
        out.image({"ColorSpace": Name(space), "BitsPerComponent": 8, "Filter": Name("DCTDecode")}, data, width, height, rotation, over=over)
        return
    width, height, samples, alpha = png_pixels(data)
    head = {"ColorSpace": Name("DeviceGray" if samples.shape[2] == 1 else "DeviceRGB"), "BitsPerComponent": 8, "Filter": Name("FlateDecode")}
    out.image(head, zlib.compress(samples.tobytes()), width, height, rotation, None if alpha is None else alpha.tobytes(), over)


def assembled(plan: list[dict], contents: dict[str, bytes]) -> tuple[bytes | None, int, str | None]:
    """The file of a plan's rows in order, its number of pages, and what is wrong."""
    out, docs = Assembly(), {}
    if not plan:
        return None, 0, NOTHING_LEFT
    for row in plan:
        try:
            if row["action"] == "blank":
                width, height = (A4[k] if pd.isna(row[c]) else float(row[c]) for k, c in enumerate(("blank_w", "blank_h")))
                out.blank(width, height, int(row["rotation"]))
                continue
            data = contents.get(row["source_id"])
            if data is None:
                return None, 0, CORRUPT
            if row["action"] != "copy":
                embed(out, row["action"], data, int(row["rotation"]))
                continue
            if row["source_id"] not in docs:
                doc = Document(data)
                if doc.encrypted:
                    return None, 0, ENCRYPTED
                docs[row["source_id"]] = doc, doc.pages(), {}
            doc, pages, known = docs[row["source_id"]]
            out.copy(doc, pages[int(row["source_index"])], int(row["rotation"]), known)
        except FAULTS:
            return None, 0, CORRUPT
    return out.file(), len(out.pages), None


def invisible(words: list[dict]) -> tuple[bytes, int]:
    """Operators that put words on a page without showing them, and how many no face can write."""
    out, skipped = [], 0
    for w in words:
        try:
            text = w["text"].encode("cp1252").hex()
        except UnicodeEncodeError:
            skipped += 1
            continue
        out.append(f"BT 3 Tr /{OVER} {w['font_size']:.3f} Tf 1 0 0 1 {w['x']:.3f} {w['y']:.3f} Tm <{text}> Tj ET")
    return "\n".join(out).encode(), skipped


def searchable_pdfs(sources: DataFrame, words: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, data, n_pages, skipped_words, error): each file with its recognised words, unseen, over its pages.

    sources: key, content, and optionally action (copy, embed_png or embed_jpg; copy by default).
    words: rows of objects.placed_words() with key and page_no (from 1).  Words that the face's code
    page can't write are skipped and counted.
    """
    kind = sources.schema[key].dataType.simpleString()
    action = F.col("action") if "action" in sources.columns else F.lit("copy")
    files = sources.select(F.col(key).alias("key"), "content", action.alias("action"))
    placed = words.select(F.col(key).alias("key"), "page_no", "text", "x", "y", "font_size")

    def run(of, files: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = []
        pages = {n: page.to_dict("records") for n, page in found.groupby("page_no")}
        for content, what in zip(files.content, files.action, strict=True):
            out, skipped = Assembly(), 0
            try:
                if what != "copy":
                    over, skipped = invisible(pages.get(1, []))
                    embed(out, what, bytes(content), 0, over)
                else:
                    doc, known = Document(bytes(content)), {}
                    if doc.encrypted:
                        raise PdfError(ENCRYPTED)
                    for n, page in enumerate(doc.pages(), 1):
                        over, missed = invisible(pages.get(n, []))
                        out.copy(doc, page, 0, known, over)
                        skipped += missed
                rows.append((of[0], out.file(), len(out.pages), skipped, None))
            except FAULTS as e:
                rows.append((of[0], None, 0, 0, ENCRYPTED if str(e) == ENCRYPTED else CORRUPT))
        return pd.DataFrame(rows, columns=["key", "data", "n_pages", "skipped_words", "error"])

    schema = f"key {kind}, data binary, n_pages int, skipped_words int, error string"
    return files.groupBy("key").cogroup(placed.groupBy("key")).applyInPandas(run, schema).withColumnRenamed("key", key)


def build_pdfs(plan: DataFrame, sources: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """(session_id, data, n_pages, error) for each session of a plan.

    plan: rows of export_plan() without own rotations (a copied page's own rotation is read from
    its file).  sources: session_id, source_id, content.  sessions: session_id of sessions that
    may have no page left; these get an error.
    """
    def run(key, rows: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        order = rows.sort_values("out_pos").to_dict("records")
        data, n, error = assembled(order, {i: bytes(c) for i, c in zip(files.source_id, files.content, strict=True) if c is not None})
        return pd.DataFrame({"session_id": [key[0]], "data": [data], "n_pages": [n], "error": [error]})

    kind = plan.schema["session_id"].dataType.simpleString()
    schema = f"session_id {kind}, data binary, n_pages int, error string"
    wanted = plan.where("source_id IS NOT NULL").select(F.col("session_id").alias("in_session"), F.col("source_id").alias("in_source")).distinct()
    own = sources.select(*[F.col(c).alias(c) for c in ("session_id", "source_id", "content")])  # attributes apart from those of a plan made of them
    used = own.join(wanted, (F.col("session_id") == F.col("in_session")) & (F.col("source_id") == F.col("in_source")), "left_semi")
    built = plan.groupBy("session_id").cogroup(used.groupBy("session_id")).applyInPandas(run, schema)
    if sessions is None:
        return built
    planned = plan.select(F.col("session_id").alias("in_session")).distinct()
    empty = sessions.select("session_id").distinct().join(planned, F.col("session_id") == F.col("in_session"), "left_anti")
    return built.unionByName(empty.select("session_id", F.lit(None).cast("binary").alias("data"), F.lit(0).alias("n_pages"), F.lit(NOTHING_LEFT).alias("error")))
