"""Styled runs: neighbours of one style merge, by gaps and islands over (block, ord)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STYLE = ["bold", "italic", "code", "href", "color"]


def merge_runs(runs: DataFrame, keys: list[str], order: str = "run_ord") -> DataFrame:
    """Drops empty runs and joins neighbours of equal style; missing flags count as false."""
    flags = {c: F.coalesce(c, F.lit(False)) for c in STYLE[:3]}
    rows = runs.where(F.col("text") != "").withColumns(flags)
    w = Window.partitionBy(*keys).orderBy(order)
    style = F.struct(*STYLE)
    before = F.lag(style).over(w)
    starts = F.when(before.isNull() | ~style.eqNullSafe(before), 1).otherwise(0)
    islands = rows.withColumn("starts", starts).withColumn("island", F.sum("starts").over(w) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda x: x["t"]), "")
    return islands.groupBy(*keys, F.col("island").cast("int").alias(order), *STYLE).agg(text.alias("text")).select(*keys, order, "text", *STYLE)


def trim_runs(runs: list[dict]) -> list[dict]:
    """Without white space at the outer ends, and without runs that are empty then."""
    out = [dict(r) for r in runs]
    while out and not (text := out[0]["text"].lstrip()):
        out.pop(0)
    if out:
        out[0]["text"] = text
    while out and not (text := out[-1]["text"].rstrip()):
        out.pop()
    if out:
        out[-1]["text"] = text
    return out


def merged(runs: list[dict]) -> list[dict]:
    """merge_runs for the runs of one block in memory."""
    out: list[dict] = []
    before = None
    for r in runs:
        if not r["text"]:
            continue
        style = bool(r.get("bold")), bool(r.get("italic")), bool(r.get("code")), r.get("href"), r.get("color")
        if style == before:
            out[-1]["text"] += r["text"]
        else:
            out.append(dict(r))
            before = style
    return out
