"""Shared pieces of the training-data operators: ragged words, checkpoints, samples.

Texts travel as Arrow strings.  A batch is cut into slices of a bounded number of
bytes, a slice is split into words once, and every per-word computation runs on
the slice's distinct words only.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES, BROADCAST_ROWS = 8 << 20, 1_000_000


def tokenizer_path(name: str) -> str:
    """Path of a public vocabulary file; imported late as only queries need it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_array(column) -> pa.StringArray:
    """An Arrow column as plain strings; null texts become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive runs of rows of about `limit` text bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def split_words(texts: pa.StringArray, ascii_only: bool = False) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """Codes of all words (white-space runs separate), document offsets, distinct words.

    Leading and trailing white space gives no word; an empty text has none.
    ascii_only: only space, tab, line feed, vertical tab, form feed and carriage return separate.
    """
    lists = pc.ascii_split_whitespace(texts) if ascii_only else pc.utf8_split_whitespace(texts)
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(offsets) else lists.values
    offsets = offsets - (offsets[0] if len(offsets) else 0)
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary
    empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # the split leaves empty strings at the ends of a text
        keep = ~empty[codes] if len(codes) else np.zeros(0, bool)
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
        remap = np.cumsum(~empty) - 1
        codes = remap[codes]
        words = words.filter(pa.array(~empty))
    return codes, offsets, words


def ragged_gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length-1 of every element, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]] along axis 0 (0 for empty segments)."""
    shape = (len(offsets) - 1, *values.shape[1:])
    out = np.zeros(shape, values.dtype)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0)
    return out


def map_slices(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text", after: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow over slices of bounded size; `after` follows a task's last slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                out = f(part)
                if out is not None:
                    yield out
        if after:
            after()

    return df.mapInArrow(run, schema)


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local master without one gets a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="docloom-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: lineage ends here, and a
    lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes what stored() wrote for these; no result may still read them."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def give_back() -> None:
    """Returns what this process has freed to the system; allocators keep it otherwise, beside a JVM or a later stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone
    if trim:
        trim(0)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Batches of at most n rows to Python workers, for stages that start and end inside: rows are wide there."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(n, int(before)) if int(before) > 0 else n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of a long or two, to be broadcast where it has at most `most` rows; otherwise joined as it is."""
    return F.broadcast(df) if df.count() <= most else df


def unit_hash(column: Column, seed: int = 0) -> Column:
    """A value in [0, 1) that depends on the column alone."""
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def crc_mod(column: Column, m: int) -> Column:
    """crc32 of the column as text, modulo m; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(m))


@functools.lru_cache(maxsize=2)
def library_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
