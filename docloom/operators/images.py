"""Images of pages: what can be embedded, what is left out, and rendered sizes."""

from __future__ import annotations

import io
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import plugins
from docloom.operators.objects import PRESETS, recompressed, recompressible


def image_kind(content: Column) -> Column:
    """png or jpg by a file's first bytes, null for others."""
    first = F.hex(F.substring(content, 1, 4))
    return F.when((F.length(content) > 4) & (first == "89504E47"), "png").when((F.length(content) > 2) & first.startswith("FFD8"), "jpg")


def origin(url: Column) -> Column:
    """Scheme, host and port of an absolute address, null for others."""
    found = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    return F.nullif(found, F.lit(""))


def same_origin(src: Column, page_url: Column) -> Column:
    """Whether an image may be fetched: its own data, a relative address, or one of the page's origin."""
    src = F.trim(src)
    scheme = F.lower(F.regexp_extract(src, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    to_host = F.concat(F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), src)
    absolute = F.when(src.startswith("//"), origin(to_host)).otherwise(origin(src))
    return F.coalesce(F.when(scheme == "data", True).when((scheme != "") | src.startswith("//"), absolute == origin(page_url)).otherwise(True), F.lit(False))


def page_images(images: DataFrame, contents: DataFrame) -> DataFrame:
    """Images of blocks with `kind` (png, jpg), `content` and `skipped`.

    images: page_id, page_url, src, and further columns; contents: src, content.  An image
    without an address is no image; one of another origin, without content, or of another
    format is skipped (a recoder may make it a PNG before).
    """
    given = images.where(F.coalesce(F.col("src"), F.lit("")) != "").join(contents.select("src", "content"), "src", "left")
    kind = F.when(same_origin(F.col("src"), F.col("page_url")), image_kind(F.col("content")))
    return given.withColumn("kind", kind).withColumn("skipped", F.col("kind").isNull())


def skipped_images(images: DataFrame) -> DataFrame:
    return images.groupBy("page_id").agg(F.count_if("skipped").alias("skipped_images"))


def render_size(width: Column, height: Column, target: Column | float, rotation: Column | int = 0) -> Column:
    """Scale, and pixels of a page whose longer side becomes `target`, as a struct; quarter turns swap the sides."""
    turned = F.pmod(F.lit(rotation) if isinstance(rotation, int) else rotation, F.lit(180)) == 90
    scale = (F.lit(float(target)) if isinstance(target, (int, float)) else target) / F.greatest(width, height)
    w, h = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
    return F.struct(scale.alias("scale"), F.ceil(w * scale).cast("int").alias("width"), F.ceil(h * scale).cast("int").alias("height"))


def raw_to_rgba(data: bytes, width: int, height: int, color: str) -> np.ndarray | None:
    """Rows of gray or rgb samples as opaque RGBA; None where there are too few."""
    channels = 3 if color == "rgb" else 1
    if width < 1 or height < 1 or len(data) < width * height * channels:
        return None
    samples = np.frombuffer(data, np.uint8, width * height * channels).reshape(height, width, channels)
    out = np.full((height, width, 4), 255, np.uint8)
    out[..., :3] = samples
    return out


def inflated(data: bytes) -> bytes | None:
    try:
        return zlib.decompressobj().decompress(data)
    except zlib.error:
        return None


def recode_images(images: DataFrame, recode: Callable | None = None, preset: str = "balanced") -> DataFrame:
    """Image objects with what recompressed() says and `out_data`, the stream that replaces the old, if any.

    images: the columns of recompressible() and `data`.  recode(data, kind, raw, longest, quality)
    runs where the data is: kind is jpeg with a whole file, or raw with samples and raw =
    (width, height, color); by default it is the configured recoder.  It gives (bytes, width, height) or None.  Faults of one image
    leave it as it is.
    """
    longest, quality = PRESETS[preset]
    flate = F.col("filters").getItem(0) == "FlateDecode"

    def sizes(batches):
        for batch in batches:
            found = [None if d is None else inflated(d.as_py()) for d in batch.column("data")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else len(x) for x in found], pa.int64())], [*batch.schema.names, "inflated_bytes"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in images.schema)
    known = recompressible(images.mapInArrow(sizes, f"{schema}, inflated_bytes long"))
    wanted = known.select("*", F.when(F.col("eligible"), F.when(flate, "raw").otherwise("jpeg")).alias("as_"), F.col("color.kind").alias("color_"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema)

    def run(batches):
        for batch in batches:
            out = []
            for data, kind, color, w, h in zip(*(batch.column(c).to_pylist() for c in ("data", "as_", "color_", "width", "height")), strict=True):
                made = None
                if kind:
                    try:
                        made = recode(inflated(data), kind, (w, h, color), longest, quality) if kind == "raw" else recode(data, kind, None, longest, quality)
                    except Exception:  # noqa: BLE001  an outside codec: whatever it raises, the image stays
                        made = None
                out.append(made)
            columns = [pa.array([None if m is None else bytes(m[0]) for m in out], pa.binary()), pa.array([None if m is None else len(m[0]) for m in out], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "new_data", "new_bytes"])

    done = recompressed(wanted.mapInArrow(run, f"{schema}, new_data binary, new_bytes long"), preset)
    return done.withColumn("out_data", F.when(F.col("replaced"), F.col("new_data"))).drop("new_data", "as_", "color_")


def recognised_words(rasters: DataFrame, factory: Callable | None = None) -> DataFrame:
    """Words of page images: doc_id, page_no, word_no, text, x0, y0, x1, y1, canvas_w, canvas_h.

    rasters: doc_id, page_no, raster, width, height.  factory() makes a recogniser once a task (by
    default the configured one), which is closed at its end, also after a fault.
    """
    factory = factory or plugins.hook("recogniser")
    kind = rasters.schema["doc_id"].dataType.simpleString()
    names = ["word_no", "text", "x0", "y0", "x1", "y1", "canvas_w", "canvas_h"]
    types = [pa.int32(), pa.string(), *[pa.float64()] * 4, pa.int32(), pa.int32()]

    def run(batches):
        recogniser = None
        try:
            for batch in batches:
                recogniser = recogniser or factory()
                for k in range(batch.num_rows):
                    raster, w, h = (batch.column(c)[k].as_py() for c in ("raster", "width", "height"))
                    found = recogniser.recognise(raster, w, h) if raster is not None else []
                    rows = [(n, x["text"], *(float(x[c]) for c in ("x0", "y0", "x1", "y1")), w, h) for n, x in enumerate(found)]
                    if rows:
                        at = pa.array([k] * len(rows))
                        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("page_no").cast(pa.int32()).take(at), *columns], ["doc_id", "page_no", *names])
        finally:
            if recogniser is not None:
                recogniser.close()

    schema = f"doc_id {kind}, page_no int, word_no int, text string, x0 double, y0 double, x1 double, y1 double, canvas_w int, canvas_h int"
    return rasters.select("doc_id", "page_no", "raster", "width", "height").mapInArrow(run, schema)


def png_bytes(rgba: np.ndarray) -> bytes:
    """A PNG file of RGBA samples: what a recoder may start from."""
    height, width = rgba.shape[:2]
    body = zlib.compress(b"".join(b"\0" + row.tobytes() for row in rgba))
    out = io.BytesIO(b"\x89PNG\r\n\x1a\n")
    out.seek(0, 2)
    for kind, data in ((b"IHDR", width.to_bytes(4, "big") + height.to_bytes(4, "big") + b"\x08\x06\0\0\0"), (b"IDAT", body), (b"IEND", b"")):
        out.write(len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big"))
    return out.getvalue()
