"""Whole conversions: PDF sources to workbooks and word-processing documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.items import sheet_cells, word_parts
from docloom.sources.files import text_items
from docloom.sources.pdf import pdf_pages, pdf_text_layer
from docloom.sources.writers import write_word_documents, write_workbooks


def faulty(pages: DataFrame, key: str) -> DataFrame:
    """key and message of files that can't be read at all."""
    return pages.where("page_no = 0").select(key, F.col("message").alias("error"))


def failed(found: DataFrame, key: str) -> DataFrame:
    return found.select(key, F.lit(None).cast("string").alias("name"), F.lit(None).cast("binary").alias("data"), "error")


def pdf_to_excel(sources: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """A workbook of each file: key, name, data, error, tables_found, used_fallback.

    Each table is a sheet; a page without tables is a sheet of its lines.  Encrypted,
    broken and scanned files have an error instead of data.
    """
    pages = pdf_pages(sources, key, content)
    items = text_items(pdf_text_layer(sources, key, content).withColumnRenamed(key, "doc_id"), keep_blank=False)
    cells = sheet_cells(items, "doc_id", "page_no").withColumnRenamed("doc_id", key)
    readable = pages.where("page_no > 0").select(key).distinct()
    books = write_workbooks(cells, key, readable).unionByName(failed(faulty(pages, key), key))
    fallback = F.col("sheet").endswith(" text")
    counts = cells.groupBy(key).agg(F.count_distinct(F.when(~fallback, F.col("sheet"))).cast("int").alias("tables_found"), F.bool_or(fallback).alias("used_fallback"))
    return books.join(counts, key, "left").fillna({"tables_found": 0, "used_fallback": False})


def pdf_to_word(sources: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """A word-processing document of each file: key, name, data, error, scanned_pages.
    A page without text has a note in its place."""
    pages = pdf_pages(sources, key, content)
    good = pages.where("page_no > 0").select(F.col(key).alias("doc_id"), "page_no")
    items = text_items(pdf_text_layer(sources, key, content).withColumnRenamed(key, "doc_id"))
    parts = word_parts(items, good, ["doc_id", "page_no"]).withColumnRenamed("doc_id", key)
    made = write_word_documents(parts, key).withColumn("error", F.lit(None).cast("string"))
    scanned = parts.where("kind = 'note'").groupBy(key).agg(F.count("*").cast("int").alias("scanned_pages"))
    return made.unionByName(failed(faulty(pages, key), key)).join(scanned, key, "left").fillna({"scanned_pages": 0})
