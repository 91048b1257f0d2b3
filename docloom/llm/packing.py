"""Packing token sequences by minimum bin slack.

Documents are cut at multiples of the window; whole windows stand alone.  The
remaining lengths form a bounded histogram (one count per length under the
window).  For each new window the longest length left is the seed, and a bitset
subset-sum programme over the other lengths left finds the multiset that fills
the rest closest to capacity; backtracking gives its counts, and the pattern is
used as often as the histogram allows.  Every use lowers some length below the
number the pattern needs of it, at most window / length, so the number of
patterns is at most the sum of that over all lengths (about 18,000 for 2048),
whatever the number of documents.

Pieces of one length are interchangeable: each gets a rank among its length
from (task, rank in task) with prefix sums over tasks, and the rank gives
its window and offset.  No group of equal lengths meets in one task.

Defined results: null texts count as empty; ids may be null or repeat, a row is
one document; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.chunk_ids import ChunkEncoder
from docloom.llm.common import give_back, slices, stored, text_array, tokenizer_path

WINDOW = 2048


def best_fill(capacity: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset out of `counts` (length: number) with the greatest sum within
    `capacity`, as length: number.  Bit s of `seen[k]` says that the first k items
    can sum to s; binary splitting keeps the items few."""
    items: list[tuple[int, int]] = []
    full = (1 << (capacity + 1)) - 1
    reach, seen = 1, [1]
    for length in sorted((x for x in counts if x <= capacity and counts[x]), reverse=True):
        left, size = min(counts[length], capacity // length), 1
        while left:
            take = min(size, left)
            left -= take
            size *= 2
            grown = (reach | reach << (take * length)) & full
            if grown != reach:
                items.append((length, take))
                seen.append(grown)
                reach = grown
        if reach >> capacity & 1:
            break
    rest, chosen = reach.bit_length() - 1, {}
    for k in range(len(items) - 1, -1, -1):
        length, take = items[k]
        if not seen[k] >> rest & 1:
            rest -= take * length
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def patterns_of(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(uses, length: number) until the histogram is empty."""
    left = {k: int(v) for k, v in histogram.items() if v and 0 < k < window}
    out = []
    while left:
        seed = max(left)
        left[seed] -= 1
        inside = best_fill(window - seed, left)
        left[seed] += 1
        inside[seed] = inside.get(seed, 0) + 1
        uses = min(left[k] // n for k, n in inside.items())
        for k, n in inside.items():
            left[k] -= n * uses
            if not left[k]:
                del left[k]
        out.append((uses, inside))
    return out


class Slots:
    """For each length the ranks' runs: first rank, pattern's first window, offset."""

    def __init__(self, patterns: list[tuple[int, dict[int, int]]], first_window: int):
        runs: dict[int, list[tuple[int, int, int]]] = {}
        used: dict[int, int] = {}
        window = first_window
        for uses, inside in patterns:
            at = 0
            for length in sorted(inside, reverse=True):
                for _ in range(inside[length]):
                    rank = used.get(length, 0)
                    runs.setdefault(length, []).append((rank, window, at))
                    used[length] = rank + uses
                    at += length
            window += uses
        self.windows = window
        self.runs = {k: np.array(v, np.int64) for k, v in runs.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        window, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k in np.unique(length):
            at = np.flatnonzero(length == k)
            run = self.runs[int(k)]
            which = np.searchsorted(run[:, 0], rank[at], "right") - 1
            window[at] = run[which, 1] + rank[at] - run[which, 0]
            offset[at] = run[which, 2]
        return window, offset


def token_pieces(df: DataFrame, path: str, id_col: str, text_col: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Pieces of every row's ids (with the end id): start, length, crc32 of the ids,
    the row's number of ids, and (task, rank in task) among pieces of that length."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        encoder, ranks, task = ChunkEncoder(path), np.zeros(window + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch):
                ids, offsets = encoder.encode(text_array(part.column("text")))
                sizes = np.diff(offsets) + 1
                n = (sizes + window - 1) // window
                doc = np.repeat(np.arange(len(sizes)), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * window
                length = np.minimum(window, sizes[doc] - start)
                crc = np.zeros(len(doc), np.int64)
                last = np.array([end_id], "<u4").tobytes()
                flat = memoryview(ids.astype("<u4").tobytes())
                for k, (a, m, d) in enumerate(zip((offsets[doc] + start).tolist(), length.tolist(), doc.tolist(), strict=True)):
                    stop = min(a + m, int(offsets[d + 1]))
                    value = zlib.crc32(flat[4 * a : 4 * stop])
                    crc[k] = zlib.crc32(last, value) if stop - a < m else value
                order = np.argsort(length, kind="stable")
                kinds, first, count = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.repeat(first, count) + ranks[length[order]]
                ranks[kinds] += count
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(doc)), *map(pa.array, (start, length, crc, sizes[doc], np.full(len(doc), task, np.int64), rank))],
                    ["id", "start", "length", "ids_crc32", "doc_tokens", "task", "task_rank"],
                )
        encoder = ids = flat = None  # the worker waits for later stages
        give_back()

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, task long, task_rank long"
    return rows.mapInArrow(run, schema)


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (length, task, task_rank)."""
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    base = counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # window rows at most
    slots = Slots(patterns_of(histogram, window), histogram.get(window, 0))
    ranked = pieces.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("task_rank"))

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = rank.copy(), np.zeros(len(rank), np.int64)
            part = np.flatnonzero(length < window)
            sequence[part], offset[part] = slots.place(length[part], rank[part])
            names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kind = pieces.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def packed_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = stored(token_pieces(df, path, id_col, text_col, window=window), "pieces")
    return pack(pieces, window).withColumnRenamed("id", id_col)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed_documents(docs, tokenizer_path("word_bpe_49k.json"))
