"""Token counts by rank-synchronous array merging.

Distinct pre-tokens of a slice are held as one ragged array of symbol ids.  Each
round looks up the rank of every adjacent pair, takes each sequence's lowest rank,
applies that pair everywhere in its sequence at once (left to right where
occurrences overlap) and drops the merged-away symbols; sequences without a
mergeable pair leave with their number of surviving symbols.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a null id is
kept; repeated rows give repeated results; an empty table gives an empty one;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.chunk_ids import CACHE_BYTES, CACHE_CHUNKS, LETTERS, SIMPLE, pattern_of, pre_tokens
from docloom.llm.common import library_tokenizer, map_slices, ragged_gather, segment_sum, split_words, text_array, tokenizer_path

NO_RANK = np.int64(1 << 40)


class MergeTable:
    """Pair ranks of a vocabulary file and the merging of many sequences at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.width = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        rank_order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[rank_order], rank_order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        letter = {b: c for b, c in LETTERS.items() if b != 10} | {10: LETTERS_OF_LINE_FEED}
        self.first = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letter[b] + suffix] for b in range(256)], np.int64)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_RANK)

    def survivors(self, pieces: list[str]) -> np.ndarray:
        """Number of symbols left of each pre-token (none for an empty one)."""
        coded = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        result = np.minimum(sizes, 1)
        live = np.flatnonzero(sizes > 1)
        raw = np.frombuffer(b"".join(coded), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.first[raw]
        full = ends[sizes > 0] - 1
        symbols[full] = self.last[raw[full]]
        starts, lengths = (ends - sizes)[live], sizes[live]
        symbols = symbols[ragged_gather(starts, lengths)]
        while len(live):
            begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            rank = np.full(len(symbols), NO_RANK)
            rank[:-1] = self.rank_of(symbols[:-1], symbols[1:])
            rank[begin + lengths - 1] = NO_RANK
            least = np.minimum.reduceat(rank, begin)
            done = least == NO_RANK
            result[live[done]] = lengths[done]
            owner = np.repeat(np.arange(len(live)), lengths)
            hit = (rank == least[owner]) & ~done[owner]
            at = np.flatnonzero(hit)
            if len(at):  # in a run of overlapping occurrences every second one counts
                new_run = np.ones(len(at), bool)
                new_run[1:] = at[1:] != at[:-1] + 1
                run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            keep = ~done[owner]
            symbols[at] = self.made[rank[at]]
            keep[at + 1] = False
            lengths = lengths - np.bincount(owner[at], minlength=len(live))
            live, lengths, symbols = live[~done], lengths[~done], symbols[keep]
        return result


LETTERS_OF_LINE_FEED = chr(0x100 + 10)  # byte 10 is the eleventh byte without a letter of its own


@functools.lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


class TokenCounter:
    """Counts tokens of slices of texts; keeps at most about CACHE_CHUNKS chunks of CACHE_BYTES between slices."""

    def __init__(self, path: str):
        self.path, self.chunks, self.pieces, self.held = path, {}, {}, 0

    def cut(self, chunk: str) -> tuple[list[str], int]:
        """Pre-tokens of any chunk, and how many special strings stand in it."""
        parts = merge_table(self.path).special.split(chunk)
        normal = library_tokenizer(self.path).normalizer
        return [x for p in parts if p for x in pattern_of(self.path).findall(normal.normalize_str(p)) if x != "\n"], len(parts) - 1

    def _learn(self, fresh: list[str]) -> None:
        simple = [x for x in fresh if SIMPLE.fullmatch(x) and "<|" not in x]
        pieces, offsets = pre_tokens(self.path, simple) if simple else ([], np.zeros(1, np.int64))
        known = set(simple) if len(simple) < len(fresh) else None
        others = [x for x in fresh if x not in known] if known is not None else []
        cuts = [self.cut(x) for x in others]
        every = [*pieces, *(p for c, _ in cuts for p in c)]
        new = list(dict.fromkeys(x for x in every if x not in self.pieces))
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            self.pieces.update(zip(part, merge_table(self.path).survivors(part).tolist(), strict=True))
        sizes = np.fromiter(map(self.pieces.__getitem__, every), np.int64, len(every))
        offsets = np.concatenate([offsets, offsets[-1] + np.cumsum([len(c) for c, _ in cuts], dtype=np.int64)])
        totals = segment_sum(sizes, offsets)
        totals[len(simple) :] += np.array([s for _, s in cuts], np.int64)
        self.chunks.update(zip([*simple, *others], totals.tolist(), strict=True))

    def count(self, texts: pa.StringArray) -> np.ndarray:
        codes, offsets, words = split_words(texts, ascii_only=True)
        if len(self.chunks) + len(words) > CACHE_CHUNKS or self.held + words.nbytes > CACHE_BYTES:
            self.chunks, self.pieces, self.held = {}, {}, 0
        chunks = words.to_pylist()
        fresh = [x for x in chunks if x not in self.chunks]
        self.held += sum(map(len, fresh))
        self._learn(fresh)
        sizes = np.fromiter(map(self.chunks.__getitem__, chunks), np.int64, len(chunks))
        return segment_sum(sizes[codes] if len(codes) else np.zeros(0, np.int64), offsets)


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    state: dict = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_array(batch.column("text"))
        counter = state.setdefault("counter", TokenCounter(path))
        n = counter.count(texts)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n), pa.array(n > limit)],
            ["id", "n_bytes", "n_tokens", "over_limit"],
        )

    return map_slices(rows, run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, tokenizer_path("word_bpe_49k.json"))
