"""TIFF columns: image directories walked, strips and tiles decoded, one row per page.

The reader takes both byte orders and 64-bit files, strips and tiles, chunky and
planar samples of 1 to 32 bits, no compression, PackBits, LZW and deflate, and
undoes horizontal differencing and the floating-point predictor.  The writer
makes multi-page files of 8-bit gray samples in strips; its pages take deflate,
PackBits and LZW in turn.

Defined results: null bytes give no page; a broken file (any of FAULTS) gives the
pages before the fault and one row with `error`; a directory that was seen before ends the
walk; null ids are kept; repeated rows give repeated pages; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import give_back, map_slices

WIDTH, PAGE_ROWS, STRIP_ROWS = 192, 64, 32
#: Fixed values of the format: bytes per value of the field types; tags; compression schemes.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TYPE_CODE = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
T_WIDTH, T_HEIGHT, T_BITS, T_COMPRESSION, T_PHOTOMETRIC, T_FILL = 256, 257, 258, 259, 262, 266
T_STRIPS, T_SAMPLES, T_ROWS, T_STRIP_BYTES, T_PLANAR, T_PREDICTOR = 273, 277, 278, 279, 284, 317
T_TILE_W, T_TILE_H, T_TILES, T_TILE_BYTES, T_FORMAT = 322, 323, 324, 325, 339
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Schemes of the pages that are written, in turn; deflate and LZW reach at most about 1 : 1400.
SCHEMES, MOST_EXPANDED = (DEFLATE, PACKBITS, LZW), 4096


class TiffError(ValueError):
    """A file that can't be read as TIFF, or a part of the format that isn't supported."""


#: What a broken file can raise; each becomes a row.
FAULTS = (ValueError, TypeError, ArithmeticError, LookupError, struct.error, MemoryError)


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: bytes = field(repr=False, default=b"")


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        stop = at
        while stop < len(data) and stop - at < 128 and not (stop + 2 < len(data) and data[stop] == data[stop + 1] == data[stop + 2]):
            stop += 1
        out += bytes((stop - at - 1,)) + data[at:stop]
        at = stop
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    table: list[bytes] = []
    out, bits, width, buffer, last = bytearray(), 0, 9, 0, b""
    for byte in data:
        buffer = buffer << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = buffer >> bits
        buffer &= (1 << bits) - 1
        if code == 256:
            table, width, last = [bytes((k,)) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257 or len(out) >= size:
            break
        if not table:
            raise TiffError("LZW data without a clear code")
        if not last:
            if code > 255:
                raise TiffError("LZW code out of range")
            last = table[code]
            out += last
            continue
        if code > len(table):
            raise TiffError("LZW code out of range")
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        table.append(last + entry[:1])
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:  # codes widen one early
            width += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, buffer, bits = bytearray(), 0, 0

    def emit(code: int, width: int) -> None:
        nonlocal buffer, bits
        buffer, bits = buffer << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(buffer >> bits)
            buffer &= (1 << bits) - 1

    fresh = {bytes((k,)): k for k in range(256)}
    table, next_code, width, held = dict(fresh), 258, 9, b""
    emit(256, 9)
    for k in range(len(data)):
        grown = held + data[k : k + 1]
        if grown in table:
            held = grown
            continue
        emit(table[held], width)
        table[grown] = next_code
        next_code += 1
        if next_code == 4095:
            emit(256, width)
            table, next_code, width = dict(fresh), 258, 9
        elif next_code + 1 > 1 << width:
            width += 1
        held = data[k : k + 1]
    if held:
        emit(table[held], width)
        next_code += 1
        if next_code + 1 > 1 << width and width < 12:
            width += 1
    emit(257, width)
    if bits:
        out.append(buffer << (8 - bits) & 255)
    return bytes(out)


def decoded(data: bytes, scheme: int, size: int) -> bytes:
    if scheme == PLAIN:
        out = data[:size]
    elif scheme == PACKBITS:
        out = unpack_bits(data, size)
    elif scheme == LZW:
        out = lzw_decode(data, size)
    elif scheme in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    else:
        raise TiffError(f"compression {scheme} isn't supported")
    if len(out) < size:
        raise TiffError("too little data")
    return out[:size]


def encoded(data: bytes, scheme: int) -> bytes:
    return {PLAIN: bytes, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1)}[scheme](data)


def unpredicted(raw: bytes, rows: int, width: int, samples: int, bits: int, predictor: int, order: str) -> bytes:
    """Undoes the predictor of rows x width x samples values."""
    if predictor == 1 or not rows:
        return raw
    if predictor == 2 and bits in (8, 16, 32):
        kind = np.dtype(f"{order}u{bits // 8}")
        values = np.frombuffer(raw, kind).reshape(rows, width, samples)
        return np.add.accumulate(values, axis=1, dtype=kind.newbyteorder("=")).astype(kind).tobytes()
    if predictor == 3 and bits in (16, 32, 64):
        flat = np.add.accumulate(np.frombuffer(raw, np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, bits // 8, -1)
        big = np.ascontiguousarray(flat.transpose(0, 2, 1))
        return (big if order == ">" else big[:, :, ::-1]).tobytes()
    raise TiffError(f"predictor {predictor} isn't supported for {bits} bits")


class Reader:
    def __init__(self, data: bytes):
        self.data = data
        if data[:2] not in (b"II", b"MM"):
            raise TiffError("no byte-order mark")
        self.order = "<" if data[:2] == b"II" else ">"
        self.big = self.take("H", 2) == 43
        if not self.big and self.take("H", 2) != 42:
            raise TiffError("no TIFF version")
        self.first = self.take("Q", 8) if self.big else self.take("I", 4)

    def take(self, code: str, at: int) -> int:
        try:
            return struct.unpack_from(self.order + code, self.data, at)[0]
        except struct.error as e:
            raise TiffError("a value lies outside the file") from e

    def directory(self, at: int) -> tuple[dict[int, tuple], int]:
        """Fields of the directory at an offset, and the offset of the next one."""
        head, entry, inline = (8, 20, 8) if self.big else (2, 12, 4)
        n = self.take("Q" if self.big else "H", at)
        fields = {}
        for k in range(n):
            here = at + head + k * entry
            tag, kind = self.take("H", here), self.take("H", here + 2)
            count = self.take("Q" if self.big else "I", here + 4)
            spot = here + (12 if self.big else 8)
            size = TYPE_BYTES.get(kind, 0) * count
            if not size or kind not in TYPE_CODE:
                continue
            if size > inline:
                spot = self.take("Q" if self.big else "I", spot)
            if spot + size > len(self.data):
                raise TiffError("a field lies outside the file")
            fields[tag] = struct.unpack_from(f"{self.order}{count}{TYPE_CODE[kind]}", self.data, spot)
        return fields, self.take("Q" if self.big else "I", at + head + n * entry)

    def pages(self):
        at, seen, number = self.first, set(), 0
        while at and at not in seen:
            seen.add(at)
            fields, at = self.directory(at)
            yield self.page(fields, number)
            number += 1

    def page(self, f: dict[int, tuple], number: int) -> Page:
        one = lambda tag, default=None: f[tag][0] if tag in f else default
        plain = (T_WIDTH, T_HEIGHT, T_BITS, T_COMPRESSION, T_FILL, T_STRIPS, T_SAMPLES, T_ROWS, T_STRIP_BYTES, T_PLANAR, T_PREDICTOR, T_TILE_W, T_TILE_H, T_TILES, T_TILE_BYTES)
        if any(not isinstance(x, int) or x < 0 for tag in plain for x in f.get(tag, ())):
            raise TiffError("a field that isn't a whole number")
        width, height, samples = one(T_WIDTH), one(T_HEIGHT), one(T_SAMPLES, 1)
        if not width or not height or not samples:
            raise TiffError("a page without size")
        bits, scheme, predictor = one(T_BITS, 1), one(T_COMPRESSION, PLAIN), one(T_PREDICTOR, 1)
        if len(set(f.get(T_BITS, (1,)))) > 1 or not 1 <= bits <= 64:
            raise TiffError("samples of different or unknown widths")
        planes = samples if one(T_PLANAR, 1) == 2 else 1
        per_pixel = samples // planes
        row_bytes = lambda w: (w * per_pixel * bits + 7) // 8
        tiled = T_TILES in f
        starts, sizes = f.get(T_TILES if tiled else T_STRIPS), f.get(T_TILE_BYTES if tiled else T_STRIP_BYTES)
        if not starts or not sizes or len(starts) != len(sizes):
            raise TiffError("a page without data")
        tw, th = (one(T_TILE_W), one(T_TILE_H)) if tiled else (width, min(one(T_ROWS, height), height))
        if not tw or not th:
            raise TiffError("parts without size")
        across, down = -(-width // tw), -(-height // th)
        if len(starts) < across * down * planes:
            raise TiffError("too few parts")
        if bits % 8 and tiled and tw * per_pixel * bits % 8:
            raise TiffError("tiles of broken bytes")
        most = sum(sizes) * MOST_EXPANDED
        if planes * height * row_bytes(width) > most:  # no scheme makes so much of so little
            raise TiffError("too little data")
        image = np.zeros((planes, height, row_bytes(width)), np.uint8)
        for k in range(across * down * planes):
            plane, rest = divmod(k, across * down)
            ty, tx = divmod(rest, across)
            rows = th if tiled else min(th, height - ty * th)
            if starts[k] + sizes[k] > len(self.data):
                raise TiffError("a part lies outside the file")
            raw = self.data[starts[k] : starts[k] + sizes[k]]
            if one(T_FILL, 1) == 2:
                raw = bytes(int(f"{b:08b}"[::-1], 2) for b in raw)
            raw = decoded(raw, scheme, rows * row_bytes(tw))
            part = np.frombuffer(unpredicted(raw, rows, tw, per_pixel, bits, predictor, self.order), np.uint8).reshape(rows, -1)
            x0 = tx * row_bytes(tw)
            used = image[plane, ty * th : ty * th + rows, x0 : x0 + part.shape[1]]
            used[:] = part[: used.shape[0], : used.shape[1]]
        if planes > 1 and bits % 8 == 0:  # samples of one pixel side by side
            image = image.reshape(planes, height, width, bits // 8).transpose(1, 2, 0, 3)
        elif planes > 1:
            each = np.unpackbits(image, axis=2)[:, :, : width * bits].reshape(planes, height, width, bits)
            image = np.packbits(each.transpose(1, 2, 0, 3).reshape(height, -1), axis=1)
        return Page(number, width, height, samples, bits, scheme, predictor, image.tobytes())


def read_pages(data: bytes):
    return Reader(data).pages()


def write_gray(payload: bytes, width: int = WIDTH, page_rows: int = PAGE_ROWS, schemes: tuple[int, ...] = SCHEMES, predictor: int = 2, strip_rows: int = STRIP_ROWS) -> bytes:
    """A little-endian file of 8-bit gray pages that hold `payload` row by row; pages take the schemes in turn."""
    if not payload or len(payload) % width:
        raise TiffError(f"the payload must be a positive multiple of {width} bytes")
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = bytearray(b"II" + struct.pack("<HI", 42, 0))
    link = 4  # where the next directory's offset goes
    for top in range(0, len(image), page_rows):
        page, scheme = image[top : top + page_rows], schemes[top // page_rows % len(schemes)]
        starts, sizes = [], []
        for y in range(0, len(page), strip_rows):
            strip = page[y : y + strip_rows]
            if predictor == 2:
                strip = np.concatenate([strip[:, :1], np.diff(strip, axis=1)], axis=1)
            data = encoded(strip.tobytes(), scheme)
            starts.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        n, lists = len(starts), len(out)
        if n > 1:
            out += struct.pack(f"<{2 * n}I", *starts, *sizes)
        struct.pack_into("<I", out, link, len(out))
        fields = [
            (T_WIDTH, 4, 1, width), (T_HEIGHT, 4, 1, len(page)), (T_BITS, 3, 1, 8), (T_COMPRESSION, 3, 1, scheme), (T_PHOTOMETRIC, 3, 1, 1),
            (T_STRIPS, 4, n, lists if n > 1 else starts[0]), (T_SAMPLES, 3, 1, 1), (T_ROWS, 4, 1, strip_rows),
            (T_STRIP_BYTES, 4, n, lists + 4 * n if n > 1 else sizes[0]), (T_PREDICTOR, 3, 1, predictor),
        ]
        out += struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *x) for x in fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def padded(text: str, unit: int = WIDTH) -> tuple[bytes, int]:
    """The text's UTF-8 bytes with spaces up to a positive multiple of `unit`, and their number before."""
    raw = text.encode()
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b" "), len(raw)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as a TIFF file; null texts count as empty."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        each = [padded(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([n for _, n in each], pa.int64()), pa.array([write_gray(p) for p, _ in each], pa.binary())], ["id", "n_bytes", "media"])

    return map_slices(rows, run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def tiff_pages(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page: id, page, width, height, samples, bits, compression, predictor, pixels, error."""
    kind = df.schema[id_col].dataType.simpleString()
    names = ["page", "width", "height", "samples", "bits", "compression", "predictor"]
    schema = pa.schema([("at", pa.int64()), *((n, pa.int32()) for n in names), ("pixels", pa.binary()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # a file at a time: a page may be large
                data, rows = batch.column("media")[k].as_py(), []
                try:
                    for p in read_pages(data) if data is not None else ():
                        rows.append((k, p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.pixels, None))
                except FAULTS as e:
                    rows.append((k, len(rows), *[None] * 7, str(e) or type(e).__name__))
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(columns[0]), *columns[1:]], ["id", *schema.names[1:]])

    out = f"id {kind}, " + ", ".join(f"{n} int" for n in names) + ", pixels binary, error string"
    return df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, out).withColumnRenamed("id", id_col)


def feature_of(image: np.ndarray) -> str:
    """Average hash on 8 x 8 cells, mean and deviation of the samples."""
    rows, columns = image.shape
    ys = [(k * rows // 8, max(k * rows // 8 + 1, (k + 1) * rows // 8)) for k in range(8)]
    cells = np.array([image[a:b].reshape(b - a, 8, columns // 8).mean((0, 2)) for a, b in ys])
    bits = (cells > cells.mean()).ravel()
    return f"{int(''.join('01'[int(b)] for b in bits), 2):016x}-{image.mean():.4f}-{image.std():.4f}"


DIGESTS = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "n_pages": "long"}


def digests(n: int, media: bytes) -> tuple:
    """Values of DIGESTS for a stored text of n bytes: its payload is read back from the file's pages."""
    pages = list(read_pages(media))
    payload = b"".join(p.pixels for p in pages)
    image = np.frombuffer(payload, np.uint8).reshape(-1, pages[0].width)
    return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(image), len(pages)


def map_digests(df: DataFrame, each) -> DataFrame:
    """id and DIGESTS of rows (id, ...); each(batch, k) gives those of row k, so that one file is held at a time."""
    types = [pa.int64() if t == "long" else pa.string() for t in DIGESTS.values()]

    def run(batches):
        for batch in batches:
            rows = [each(batch, k) for k in range(batch.num_rows)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], ["id", *DIGESTS])
            give_back()

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} {t}" for c, t in DIGESTS.items()))


def media_digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, media) to digests of the payload read back from each file's pages."""
    rows = df.select(F.col(id_col).alias("id"), "n_bytes", "media")
    return map_digests(rows, lambda batch, k: digests(batch.column("n_bytes")[k].as_py(), batch.column("media")[k].as_py())).withColumnRenamed("id", id_col)


def stored_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """media_digests(store_texts(df)) in one pass: each text is stored and read back in the same worker,
    so that a task has one worker and no batch of files."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def each(batch: pa.RecordBatch, k: int) -> tuple:
        payload, n = padded(batch.column("text")[k].as_py())
        return digests(n, write_gray(payload))

    return map_digests(rows, each).withColumnRenamed("id", id_col)


def op2_tiff(spark, sf_dir: str) -> DataFrame:
    return stored_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def tiff_payloads(spark, sf_dir: str) -> DataFrame:
    """What SQL can state of op2: sizes and digest of the payload that is read back."""
    return op2_tiff(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


PAYLOAD_SQL = """
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(text || repeat(' ', (m - n)::INT)) AS payload_sha256
FROM (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, ''))::BIGINT AS n, (greatest(1, (strlen(coalesce(text, '')) + 191) // 192) * 192)::BIGINT AS m FROM documents) x
"""
