"""Delivery: files into a folder, with a listener that hears of each, and jobs that can be cancelled."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docloom import plugins


def save_files(files: DataFrame, folder: str, listen: Callable[[str, int], None] | None = None) -> int:
    """Writes `data` of every row as `name` under a folder that driver and executors share, each under
    another name first; returns their number.  listen(name, size), by default the configured listener,
    hears of each file; its faults don't count."""
    listen = listen or plugins.notify

    def run(batches):
        fs, at = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        fs.create_dir(at, recursive=True)
        for batch in batches:
            names, sizes = batch.column("name").to_pylist(), []
            for k, name in enumerate(names):
                own = f"{at}/_{uuid.uuid4().hex}"
                with fs.open_output_stream(own) as out:
                    out.write(batch.column("data")[k].as_buffer())
                fs.move(own, f"{at}/{name}")
                sizes.append(len(batch.column("data")[k].as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "size"])

    saved, n = files.where("name IS NOT NULL AND data IS NOT NULL").select("name", "data").mapInArrow(run, "name string, size long"), 0
    for row in saved.toLocalIterator():  # names and sizes alone, a partition at a time
        n += 1
        with contextlib.suppress(Exception):
            listen(row["name"], row["size"])
    return n


def watched(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The table, and an observation whose `get` says how many rows went by once an action is over."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


@contextlib.contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started inside can be stopped by cancel(spark, tag) from another thread."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)
