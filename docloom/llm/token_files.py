"""Token-id files: flat unsigned integers plus 64-bit document offsets.

A data set is a folder of shards in ascending order of document id.  Shard k has
  ids-k.bin   its ids, unsigned 16-bit where the vocabulary allows, else 32-bit,
  docs-k.idx  64-bit unsigned offsets into the data set's ids, one per document
              and one at the end; the shard's base comes from prefix sums,
  names-k.arrow  the document ids (Arrow file).
Texts are encoded where they are read; packed ids, not texts, are then dealt by ranges
of (id, hash of the text) into shards of about SHARD_BYTES.  The ranges come from the
sizes of about SAMPLE_ROWS rows; they decide where a shard ends, not what is in it.
Files are written under a name of their own and moved into place, so that a task
that runs again leaves the same files.  The folder is in the shared storage that
spark.checkpoint.dir names; local files are memory-mapped when read.

Defined results: null texts count as empty (the end id alone); null ids come
first; equal ids stand in the order of their texts' hashes and may lie in several
shards; an empty table gives an empty data set; further columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.chunk_ids import ChunkEncoder
from docloom.llm.common import checkpoint_dir, give_back, library_tokenizer, slices, text_array, tokenizer_path, unit_hash

SHARD_BYTES, SAMPLE_ROWS = 64 << 20, 50_000


def storage(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def put(path: str, name: str, parts) -> None:
    """Writes the buffers to path/name: first under another name, then moved."""
    fs, at = storage(path)
    own = f"{at}/_{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
    fs.move(own, f"{at}/{name}")


def mapped(path: str, name: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where it is local, else read."""
    fs, at = storage(path)
    file = f"{at}/{name}"
    if not fs.get_file_info(file).size:
        return np.zeros(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(file, dtype, "r")
    with fs.open_input_file(file) as source:
        return np.frombuffer(source.read(), dtype)


def names_of(path: str, shard: int) -> pa.Array:
    fs, at = storage(path)
    with fs.open_input_file(f"{at}/names-{shard:06d}.arrow") as source:
        table = pa.ipc.open_file(source).read_all()
    return table.column(0).combine_chunks() if table.num_rows else pa.array([], table.schema.field(0).type)


def range_ends(rows: DataFrame, shard_bytes: int) -> list[tuple]:
    """Greatest keys (has id, id, hash) of all shards but the last."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 2
    total, n = rows.agg(F.sum(size), F.count("*")).first()
    n_shards = max(-(-(total or 0) // shard_bytes), min(rows.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // (1 << 20))), 1)
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    drawn = rows.where(unit_hash(F.struct("id", "hash"), 3) < share).select("id", "hash", size.alias("size"))
    sample = sorted(((r["id"] is not None, r["id"], r["hash"]), r["size"]) for r in drawn.groupBy("id", "hash").agg(F.sum("size").alias("size")).collect())
    ends, held, whole = [], 0, sum(x for _, x in sample)
    for key, x in sample:
        held += x
        if len(ends) + 1 < n_shards and held * n_shards >= whole * (len(ends) + 1):
            ends.append(key)
    return ends


def packed_ids(rows: DataFrame, vocabulary: str, dtype: str, end_id: int, ends: list[tuple]) -> DataFrame:
    """(id, hash, text) to (shard, id, hash, ids as bytes); the end id stands last."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        encoder = ChunkEncoder(vocabulary)
        for batch in batches:
            for part in slices(batch):
                ids, offsets = encoder.encode(text_array(part.column("text")))
                stops = np.cumsum(np.diff(offsets) + 1)
                out = np.full(len(ids) + len(stops), end_id, dtype)
                spot = np.ones(len(out), bool)
                spot[stops - 1] = False
                out[spot] = ids
                at = pa.py_buffer((np.append(0, stops) * out.itemsize).astype("<i8"))
                long = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stops), [None, at, pa.py_buffer(out)])
                keys = zip(part.column("id").to_pylist(), part.column("hash").to_pylist(), strict=True)
                shard = [bisect.bisect_left(ends, (i is not None, i, h)) for i, h in keys]
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), part.column("id"), part.column("hash"), long.cast(pa.binary())], ["shard", "id", "hash", "ids"])
        encoder = ids = out = at = long = None  # the worker waits for later stages
        give_back()

    return rows.mapInArrow(run, f"shard long, id {kind}, hash long, ids binary")


def write_token_files(df: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, shard_bytes: int = SHARD_BYTES) -> dict:
    """Encodes every row and writes the shards; returns the data set's description."""
    spark = df.sparkSession
    dtype = "<u2" if max(end_id, *library_tokenizer(vocabulary).get_vocab().values()) < 1 << 16 else "<u4"
    kind = df.schema[id_col].dataType.simpleString()
    fs, at = storage(path)
    fs.create_dir(at, recursive=True)
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    ends = range_ends(rows, shard_bytes)
    packed = packed_ids(rows, vocabulary, dtype, end_id, ends)
    ordered = packed.repartition(len(ends) + 1, "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "hash")
    width = np.dtype(dtype).itemsize

    def write(batches):
        """Shards come one after the other; a shard's file is open while its rows come."""
        shard, name, out, sizes, names = None, "", None, [], []

        def close() -> pa.RecordBatch:
            out.close()
            fs.move(f"{at}/{name}", f"{at}/ids-{shard:06d}.bin")
            table, sink = pa.table({"id": pa.chunked_array(names)}), pa.BufferOutputStream()
            with pa.ipc.new_file(sink, table.schema) as file:
                file.write_table(table)
            put(path, f"names-{shard:06d}.arrow", [sink.getvalue()])
            every = np.concatenate(sizes)
            put(path, f"sizes-{shard:06d}.bin", [every.astype("<u8").tobytes()])
            sizes.clear()
            names.clear()
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([len(every)]), pa.array([int(every.sum())])], ["shard", "n_docs", "n_tokens"])

        fs, at = storage(path)
        for batch in batches:
            of = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b <= a:
                    continue
                if of[a] != shard:
                    if out:
                        yield close()
                    shard, name = int(of[a]), f"_ids-{int(of[a]):06d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(f"{at}/{name}")
                ids = batch.column("ids").slice(a, b - a)
                names.append(batch.column("id").slice(a, b - a))
                sizes.append(pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // width)
                for x in ids:
                    out.write(x.as_buffer())
        if out:
            yield close()

    done = sorted(ordered.mapInArrow(write, "shard long, n_docs long, n_tokens long").collect())  # one row a shard
    bases, base = {}, 0
    for shard, _, tokens in done:
        bases[shard] = base
        base += tokens
    about = {"dtype": dtype, "id_type": kind, "shards": [[s, d, t, bases[s]] for s, d, t in done], "n_tokens": base}

    def index(batches):
        for batch in batches:
            for shard, first in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), strict=True):
                sizes = mapped(path, f"sizes-{shard:06d}.bin", "<u8")
                ends = np.concatenate([np.zeros(1, "<u8"), np.cumsum(sizes, dtype="<u8")]) + np.uint64(first)
                put(path, f"docs-{shard:06d}.idx", [ends.astype("<u8").tobytes()])
            yield pa.RecordBatch.from_arrays([batch.column("shard")], ["shard"])

    shards(spark, about).mapInArrow(index, "shard long").count()
    put(path, "about.json", [json.dumps(about).encode()])
    return about


def shards(spark: SparkSession, about: dict) -> DataFrame:
    rows = [(s, b) for s, _, _, b in about["shards"]] or [(0, 0)][:0]
    return spark.createDataFrame(rows, "shard long, base long").repartition(max(1, len(rows)), "shard")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a data set: id, start, n_tokens, ids_crc32, from the files."""
    fs, at = storage(path)
    with fs.open_input_file(f"{at}/about.json") as source:
        about = json.loads(source.read())
    dtype = about["dtype"]

    def run(batches):
        for batch in batches:
            for shard, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), strict=True):
                ids, ends = mapped(path, f"ids-{shard:06d}.bin", dtype), mapped(path, f"docs-{shard:06d}.idx", "<u8").astype(np.int64)
                names = names_of(path, shard)
                for a in range(0, len(names), 5000):
                    b = min(a + 5000, len(names))
                    crc = [zlib.crc32(ids[x - base : y - base].astype("<u4").tobytes()) for x, y in zip(ends[a:b].tolist(), ends[a + 1 : b + 1].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([names.slice(a, b - a), pa.array(ends[a:b]), pa.array(np.diff(ends[a : b + 1])), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return shards(spark, about).mapInArrow(run, f"id {about['id_type']}, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = f"{checkpoint_dir(spark)}/docloom/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer_path("word_bpe_49k.json"))
    return read_token_files(spark, path).withColumnRenamed("id", "doc_id")
