"""Page-list algebra: sources and ordered pages of documents under assembly.

pages: session_id, pos, page_id, source_id, source_index, rotation, blank_w, blank_h.
sources: session_id, source_id, name, kind, mime, page_count, and optionally content.
Edits rewrite the page list; contents are only touched on export.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.geometry import A4, rotated

PAGE_COLUMNS = ["session_id", "pos", "page_id", "source_id", "source_index", "rotation", "blank_w", "blank_h"]
COPY = r"\A(.*)-copy(?:-(\d+))?\z"
NOTHING_LEFT = "Nothing to export — every page was removed."


PAGES = "session_id string, pos int, page_id string, source_id string, source_index int, rotation int, blank_w double, blank_h double"
SOURCES = "session_id string, source_id string, source_no int, name string, kind string, mime string, page_count int, content binary"


def empty_session(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Sources and pages of nothing yet."""
    return spark.createDataFrame([], SOURCES), spark.createDataFrame([], PAGES)


def sniffed(content: Column, name: Column, mime: Column) -> DataFrame | Column:
    """Struct of kind, mime and name that a file gets from its type, first bytes and name."""
    magic = (F.length(content) > 4) & (F.hex(F.substring(content, 1, 4)) == "25504446")
    is_pdf = F.when(mime.isNotNull() & (mime != ""), mime == "application/pdf").otherwise(F.coalesce(magic, F.lit(False)) | F.coalesce(name.rlike(r"(?i)\.pdf\z"), F.lit(False)))
    return F.struct(
        F.when(is_pdf, "pdf").otherwise("image").alias("kind"),
        F.coalesce(F.nullif(mime, F.lit("")), F.when(is_pdf, "application/pdf").otherwise("application/octet-stream")).alias("mime"),
        F.coalesce(F.nullif(name, F.lit("")), F.when(is_pdf, "document.pdf").otherwise("image")).alias("name"),
    )


def source_pages(sources: DataFrame) -> DataFrame:
    """One page for each page of each source, images having one, in source order (source_no)."""
    pages = sources.select("session_id", "source_id", "source_no", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.col("page_count")) - 1)).alias("source_index"))
    pos = F.row_number().over(Window.partitionBy("session_id").orderBy("source_no", "source_index")) - 1
    return pages.select(
        "session_id",
        pos.alias("pos"),
        F.concat(F.lit("p-"), F.col("source_id"), F.lit("-"), F.col("source_index").cast("string")).alias("page_id"),
        "source_id",
        "source_index",
        F.lit(0).alias("rotation"),
        F.lit(None).cast("double").alias("blank_w"),
        F.lit(None).cast("double").alias("blank_h"),
    )


def renumbered(pages: DataFrame, *order: Column) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("session_id").orderBy(*order)) - 1
    return pages.withColumn("pos", pos).select(*PAGE_COLUMNS)


def remove_pages(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """Pages without those of `ids` (session_id, page_id)."""
    return renumbered(pages.join(ids, ["session_id", "page_id"], "left_anti"), F.col("pos"))


def rotate_pages(pages: DataFrame, ids: DataFrame, delta: int) -> DataFrame:
    marked = pages.join(ids.select("session_id", "page_id").distinct().withColumn("hit", F.lit(True)), ["session_id", "page_id"], "left")
    return marked.withColumn("rotation", F.when(F.col("hit"), rotated(F.col("rotation"), delta)).otherwise(F.col("rotation"))).select(*PAGE_COLUMNS)


def duplicate_pages(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """A copy of each page of `ids` right behind it; unknown ids do nothing.  The first copy of a
    page p is p-copy, further ones p-copy-2 and so on, so that no id repeats."""
    made = pages.select("session_id", F.regexp_extract("page_id", COPY, 1).alias("page_id"), F.coalesce(F.nullif(F.regexp_extract("page_id", COPY, 2), F.lit("")).cast("int"), F.lit(1)).alias("nth"))
    made = made.where("page_id != ''").groupBy("session_id", "page_id").agg(F.max("nth").alias("nth"))
    wanted = ids.select("session_id", "page_id").distinct().join(made, ["session_id", "page_id"], "left")
    suffix = F.when(F.col("nth").isNull(), "-copy").otherwise(F.concat(F.lit("-copy-"), (F.col("nth") + 1).cast("string")))
    copies = pages.join(wanted, ["session_id", "page_id"]).withColumn("page_id", F.concat("page_id", suffix)).withColumn("tie", F.lit(1)).drop("nth")
    return renumbered(pages.withColumn("tie", F.lit(0)).unionByName(copies), F.col("pos"), F.col("tie"))


def insert_blank_pages(pages: DataFrame, at: DataFrame, size: tuple[float, float] = A4) -> DataFrame:
    """A blank page before place `index` of each row of `at` (session_id, index, page_id), clamped
    to the list; a session without pages gets it as its first."""
    counts = pages.groupBy("session_id").agg(F.count("*").alias("n"))
    blank = at.join(counts, "session_id", "left").select(
        "session_id",
        F.greatest(F.lit(0), F.least("index", F.coalesce("n", F.lit(0)))).cast("int").alias("pos"),
        "page_id",
        F.lit(None).cast("string").alias("source_id"),
        F.lit(0).alias("source_index"),
        F.lit(0).alias("rotation"),
        F.lit(size[0]).alias("blank_w"),
        F.lit(size[1]).alias("blank_h"),
        F.lit(0).alias("tie"),
    )
    return renumbered(pages.withColumn("tie", F.lit(1)).unionByName(blank), F.col("pos"), F.col("tie"), F.col("page_id"))


def merge_sessions(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pages of the second list behind those of the first."""
    both = first.withColumn("tie", F.lit(0)).unionByName(second.withColumn("tie", F.lit(1)))
    return renumbered(both, F.col("tie"), F.col("pos"))


def extract_pages(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pages whose 1-based number is in `ranges` (session_id, page_numbers array)."""
    joined = pages.join(ranges, "session_id").where(F.array_contains("page_numbers", (F.col("pos") + 1).cast("int")))
    return renumbered(joined, F.col("pos"))


def export_plan(pages: DataFrame, sources: DataFrame, own_rotation: DataFrame | None = None) -> DataFrame:
    """What export writes, in order: blank pages, copied pages with their final rotation,
    and images over the whole page; pages whose source is missing are left out."""
    joined = pages.join(sources.select("session_id", "source_id", "name", "kind", "mime"), ["session_id", "source_id"], "left")
    if own_rotation is not None:
        joined = joined.join(own_rotation.withColumnRenamed("rotation", "own"), ["session_id", "source_id", "source_index"], "left")
    else:
        joined = joined.withColumn("own", F.lit(0))
    jpeg = F.coalesce(F.col("mime").rlike(r"(?i)/jpe?g\z"), F.lit(False)) | F.coalesce(F.col("name").rlike(r"(?i)\.jpe?g\z"), F.lit(False))
    action = F.when(F.col("source_id").isNull(), "blank").when(F.col("kind") == "pdf", "copy").when(jpeg, "embed_jpg").otherwise("embed_png")
    kept = joined.where(F.col("source_id").isNull() | F.col("kind").isNotNull()).withColumn("action", action)
    out_pos = F.row_number().over(Window.partitionBy("session_id").orderBy("pos")) - 1
    return kept.select(
        "session_id", out_pos.alias("out_pos"), "page_id", "action", "source_id", "source_index",
        F.when(F.col("action") == "copy", rotated(F.coalesce("own", F.lit(0)), F.col("rotation"))).otherwise(F.col("rotation")).alias("rotation"),
        "blank_w", "blank_h",
    )


def page_number_stamps(pages: DataFrame, text_width, style: str = "n-of-total", position: str = "bottom-center", start_at: int = 1, size: float = 10.0, margin: float = 24.0, skip_first: bool = False) -> DataFrame:
    """Text, x and y of each page's number; pages has session_id, pos, width, height.

    text_width: Column of text and size to a Column of points.
    """
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("pos")) + (start_at - 1)
    last = F.count("*").over(Window.partitionBy("session_id")) + (start_at - 1)
    rows = pages.withColumn("number", number).withColumn("last", last)
    text = F.col("number").cast("string") if style == "n" else F.concat_ws(" / ", F.col("number").cast("string"), F.col("last").cast("string"))
    rows = rows.withColumn("stamp", text).withColumn("stamp_w", text_width(F.col("stamp"), size))
    x = F.lit(margin) if position.endswith("-left") else F.col("width") - margin - F.col("stamp_w") if position.endswith("-right") else (F.col("width") - F.col("stamp_w")) / 2
    y = F.col("height") - margin - size if position.startswith("top") else F.lit(margin)
    rows = rows.where(F.col("number") > start_at) if skip_first else rows
    return rows.select("session_id", "pos", "stamp", x.cast("double").alias("x"), y.cast("double").alias("y"))


def unique_names(files: DataFrame, group: str, order: str, name: str = "name") -> DataFrame:
    """Adds unique_name: later files of a name in a group get a number."""
    from docloom.functions.text import numbered_name

    nth = F.row_number().over(Window.partitionBy(group, name).orderBy(order))
    return files.withColumn("nth", nth).withColumn("unique_name", numbered_name(name, F.col("nth"))).drop("nth")
