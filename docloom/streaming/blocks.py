"""The per-document transforms over streams: they hold no state between rows, so a
file or table stream runs them unchanged in append mode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_text_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)


def write_stream(rows: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], once: bool = True) -> StreamingQuery:
    """Writes transform(rows) to parquet files; `once` takes what is there and ends."""
    writer = transform(rows).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
