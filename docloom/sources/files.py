"""Files in: binary files with sniffed kinds, and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import trim
from docloom.operators.session import sniffed


def binary_sources(spark: SparkSession, path: str, session_id: str = "s", glob: str = "*") -> DataFrame:
    """sources rows of all files under a path; contents stay in a column of their own."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select(F.lit(session_id).alias("session_id"), F.sha2("path", 256).alias("source_id"), "content", sniffed(F.col("content"), name, F.lit(None).cast("string")).alias("s"))
    return found.select("session_id", "source_id", "s.name", "s.kind", "s.mime", "content")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of all text files under a path."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))


def text_items(raw: DataFrame, fonts: DataFrame | None = None, keep_blank: bool = True) -> DataFrame:
    """Positioned items from a text layer: doc_id, page_no, item_no, str, transform (six numbers),
    w, h and font_name; marked content has no str.  fonts: font_name, real_name."""
    bold = r"(?i)bold|black|heavy|semibold|demibold"
    rows = raw.where(F.col("str").isNotNull())
    rows = rows if keep_blank else rows.where(trim("str") != "")
    t = lambda k: F.get("transform", F.lit(k))
    size = F.coalesce(F.nullif(F.hypot(t(2), t(3)), F.lit(0.0)), F.nullif("h", F.lit(0.0)), F.lit(12.0))
    real = F.lit(None).cast("string")
    if fonts is not None:
        rows = rows.join(fonts.select("font_name", "real_name").dropDuplicates(["font_name"]), "font_name", "left")
        real = F.col("real_name")
    is_bold = F.coalesce(F.col("font_name").rlike(bold), F.lit(False)) | F.coalesce(real.rlike(bold), F.lit(False))
    return rows.select("doc_id", "page_no", "item_no", "str", t(4).alias("x"), t(5).alias("y"), F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce(F.nullif("h", F.lit(0.0)), size).alias("h"), size.alias("font_size"), is_bold.alias("bold"))
