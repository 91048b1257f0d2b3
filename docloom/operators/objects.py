"""Form fields, image objects and optical-recognition words as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.fonts import ocr_font
from docloom.functions.geometry import clamp, fit_scale, fitted, progress
from docloom.functions.text import trim

#: Recompression presets and floors, size warning, word sizes, stage windows.
PRESETS = {"high": (2048, 0.82), "balanced": (1600, 0.72), "extreme": (1100, 0.58)}
LEAST_PIXELS, LEAST_BYTES, WARN_BYTES = 320 * 320, 24 * 1024, 100 * 1024 * 1024
WORD_SIZE = (4.0, 60.0)
STAGES = {"render": (0.0, 0.1), "cleanup": (0.1, 0.05), "ocr": (0.15, 0.8), "build": (0.95, 0.05)}


def described_fields(fields: DataFrame) -> DataFrame:
    """doc_id, name, type, value_str, value_bool, options, read_only from raw fields
    (field_type, text_value, checked, selected array, options, read_only)."""
    kind = F.when(F.col("field_type").isin("text", "checkbox", "radio"), F.col("field_type")).when(F.col("field_type").isin("dropdown", "optionlist"), "dropdown").otherwise("other")
    first = F.coalesce(F.get("selected", F.lit(0)), F.lit(""))
    value = F.when(kind == "text", F.coalesce("text_value", F.lit(""))).when(kind.isin("dropdown", "radio"), first).when(kind == "other", "")
    return fields.select(
        "doc_id", "name", kind.alias("type"), value.alias("value_str"),
        F.when(kind == "checkbox", F.coalesce("checked", F.lit(False))).alias("value_bool"),
        F.when(kind.isin("dropdown", "radio"), F.col("options")).alias("options"), "read_only",
    )


def fill_form(fields: DataFrame, values: DataFrame, flatten: bool = True) -> DataFrame:
    """Fields with their new values; `touched` where one was set and needs a new appearance.

    fields: doc_id, name, field_type, value_str, value_bool, options, read_only.
    Read-only and unknown names stay; a checkbox is on for `true` alone; an empty
    choice leaves a field as it is; radios and option lists take their options only.
    """
    joined = fields.join(values.select("doc_id", "name", F.col("value").alias("new")), ["doc_id", "name"], "left")
    kind, new = F.col("field_type"), F.col("new")
    given = new.isNotNull() & ~F.col("read_only")
    choice = kind.isin("dropdown", "optionlist", "radio") & (new != "")
    allowed = choice & ((kind == "dropdown") | F.coalesce(F.array_contains("options", new), F.lit(False)))
    touched = F.coalesce(given & (kind.isin("text", "checkbox") | allowed), F.lit(False))
    return joined.select(
        "doc_id", "name", "field_type",
        F.when(touched & (kind != "checkbox"), new).otherwise(F.col("value_str")).alias("value_str"),
        F.when(touched & (kind == "checkbox"), new == "true").otherwise(F.col("value_bool")).alias("value_bool"),
        touched.alias("touched"), F.lit(flatten).alias("flattened"),
    )


def appearance(fields: DataFrame) -> DataFrame:
    """The face that draws each touched text: the form's own, a script's, or none; need_appearances
    where a touched text of the document has none, or where the form stays a form."""
    from docloom.functions.fonts import SCRIPT_FONTS
    from docloom.functions.text import detect_script, has_non_winansi

    text = F.coalesce("value_str", F.lit(""))
    face = F.when(~has_non_winansi(text), "Helvetica").otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in SCRIPT_FONTS.items() for x in kv]), detect_script(text)))
    whole = F.col("touched") & (F.col("field_type") != "checkbox")
    drawn = fields.withColumn("face", F.when(whole, face))
    missing = drawn.groupBy("doc_id").agg(F.bool_or(whole & F.col("face").isNull()).alias("missing"))
    return drawn.join(missing, "doc_id").withColumn("need_appearances", F.coalesce("missing", F.lit(False)) | ~F.col("flattened")).drop("missing")


def color_class(family: Column, icc_n: Column) -> Column:
    """rgb, gray, cmyk or other; and whether it is a device space, as a struct."""
    device = F.coalesce(family.isin("DeviceRGB", "DeviceGray"), F.lit(False))
    icc = family == "ICCBased"
    kind = (
        F.when(family.isin("DeviceRGB", "CalRGB") | (icc & (icc_n == 3)), "rgb")
        .when(family.isin("DeviceGray", "CalGray") | (icc & (icc_n == 1)), "gray")
        .when((family == "DeviceCMYK") | (icc & (icc_n == 4)), "cmyk")
        .otherwise("other")
    )
    return F.struct(kind.alias("kind"), device.alias("device"))


def recompressible(images: DataFrame) -> DataFrame:
    """Image objects with `eligible`: no mask of another image, one plain filter, large
    enough, and of a layout that can be rebuilt sample by sample.  Where the table has
    `inflated_bytes`, a Flate image must inflate to just its samples (null: it doesn't inflate)."""
    masks = images.select("doc_id", F.explode(F.array("smask_ref", "mask_ref")).alias("ref")).where("ref is not null").distinct()
    flagged = images.join(masks.withColumn("is_mask", F.lit(True)), ["doc_id", "ref"], "left")
    color = color_class(F.col("cs_family"), F.col("icc_n"))
    flagged = flagged.withColumn("color", color).withColumn("filter", F.when(F.size("filters") == 1, F.get("filters", F.lit(0))))
    known = F.col("color.kind").isin("rgb", "gray")
    jpeg = (F.col("filter") == "DCTDecode") & known & ~F.col("has_decode")
    flate = (F.col("filter") == "FlateDecode") & known & F.col("color.device") & ~F.col("has_decode") & ~F.col("has_decode_parms") & (F.col("bpc") == 8)
    if "inflated_bytes" in images.columns:
        flate = flate & (F.col("inflated_bytes") == F.col("width").cast("long") * F.col("height") * F.when(F.col("color.kind") == "rgb", 3).otherwise(1))
    large = (F.col("width") > 0) & (F.col("height") > 0) & (F.col("width").cast("long") * F.col("height") > LEAST_PIXELS) & (F.col("n_bytes") >= LEAST_BYTES)
    fine = F.col("is_mask").isNull() & ~F.col("image_mask") & ~F.col("has_external") & large & (jpeg | flate)
    return flagged.withColumn("eligible", F.coalesce(fine, F.lit(False))).drop("is_mask")


def recompressed(images: DataFrame, preset: str = "balanced", new_bytes: str = "new_bytes") -> DataFrame:
    """Eligible objects with the size they get and whether the new stream replaces the old:
    only where it is smaller.  new_bytes: the recoder's result, null where it failed."""
    longest, quality = PRESETS[preset]
    scale = fit_scale(F.col("width"), F.col("height"), float(longest))
    taken = F.coalesce(F.col("eligible") & (F.col(new_bytes) < F.col("n_bytes")), F.lit(False))
    return images.select(
        "*", taken.alias("replaced"), F.lit(quality).alias("quality"),
        F.when(taken, fitted(F.col("width"), scale)).otherwise(F.col("width")).alias("out_width"),
        F.when(taken, fitted(F.col("height"), scale)).otherwise(F.col("height")).alias("out_height"),
        F.when(taken, F.lit("DCTDecode")).otherwise(F.col("filter")).alias("out_filter"),
        F.when(taken, F.lit("DeviceRGB")).otherwise(F.col("cs_family")).alias("out_cs"),
        F.when(taken, F.col(new_bytes)).otherwise(F.col("n_bytes")).alias("out_bytes"),
    )


def compress_summary(images: DataFrame, sizes: DataFrame) -> DataFrame:
    """Counts of each document, its new size and whether the original is kept (sizes: doc_id, n_bytes)."""
    per_doc = images.groupBy("doc_id").agg(F.count_if("replaced").alias("n_replaced"), F.count_if(~F.col("replaced")).alias("n_skipped"), F.sum(F.col("n_bytes") - F.col("out_bytes")).alias("saved"))
    joined = sizes.join(per_doc, "doc_id", "left")
    out = F.col("n_bytes") - F.coalesce("saved", F.lit(0))
    return joined.select("doc_id", F.coalesce("n_replaced", F.lit(0)).alias("n_replaced"), F.coalesce("n_skipped", F.lit(0)).alias("n_skipped"), "n_bytes", F.least(out, F.col("n_bytes")).alias("out_bytes"), (out >= F.col("n_bytes")).alias("used_original"))


def flattened_words(pages: DataFrame, tree: str = "blocks") -> DataFrame:
    """Words of a recognition tree (blocks, paragraphs, lines, words; any level may be null)."""
    kind = pages.schema[tree].dataType
    word = kind.elementType["paragraphs"].dataType.elementType["lines"].dataType.elementType["words"].dataType
    paragraphs = F.flatten(F.transform(F.coalesce(F.col(tree), F.array().cast(kind.simpleString())), lambda b: F.coalesce(b["paragraphs"], F.array().cast(kind.elementType["paragraphs"].dataType.simpleString()))))
    lines = F.flatten(F.transform(paragraphs, lambda p: F.coalesce(p["lines"], F.array().cast(kind.elementType["paragraphs"].dataType.elementType["lines"].dataType.simpleString()))))
    words = F.flatten(F.transform(lines, lambda x: F.coalesce(x["words"], F.array().cast(word.simpleString()))))
    rest = [c for c in pages.columns if c != tree]
    return pages.select(*rest, F.posexplode(words).alias("word_no", "word")).select(*rest, "word_no", "word.*")


def placed_words(words: DataFrame) -> DataFrame:
    """Invisible words on their page: pixels to points, y turned upwards, size within limits.
    words: text, x0, y0, x1, y1, canvas_w, canvas_h, page_w, page_h."""
    fx, fy = F.col("page_w") / F.col("canvas_w"), F.col("page_h") / F.col("canvas_h")
    size = clamp((F.col("y1") - F.col("y0")) * fy, *WORD_SIZE)
    return words.where(trim("text") != "").withColumns({"x": F.col("x0") * fx, "y": F.col("page_h") - F.col("y1") * fy, "font_size": size, "face": ocr_font(F.col("text"))})


def recognition_progress(events: DataFrame) -> DataFrame:
    """Per cent for events of page_no (from 0), pages, stage and part."""
    pct = None
    for stage, (start, span) in STAGES.items():
        here = progress(F.col("page_no"), F.col("pages"), start, span, F.col("part"))
        pct = F.when(F.col("stage") == stage, here) if pct is None else pct.when(F.col("stage") == stage, here)
    return events.withColumn("pct", pct)


def recognised_text(pages: DataFrame) -> DataFrame:
    """Text of each document from doc_id, page_no (from 1) and text, pages apart by a blank line."""
    title = F.concat(F.lit("──── Page "), F.col("page_no").cast("string"), F.lit(" ────\n"))
    ordered = F.array_sort(F.collect_list(F.struct("page_no", trim("text").alias("plain"), F.concat(title, trim("text")).alias("titled"))))
    packed = pages.groupBy("doc_id").agg(ordered.alias("p"))
    many = F.array_join(F.transform("p", lambda x: x["titled"]), "\n\n")
    return packed.select("doc_id", F.when(F.size("p") > 1, many).otherwise(F.get("p", F.lit(0))["plain"]).alias("text"))


def oversized(sources: DataFrame, content: str = "content") -> DataFrame:
    return sources.where(F.length(content) > WARN_BYTES)
