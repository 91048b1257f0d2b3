import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.types import LongType, StructField, StructType

from docloom.llm import packing as P
from docloom.llm.chunk_ids import SIMPLE, ChunkEncoder, Store, cut, pre_tokens
from docloom.llm.common import library_tokenizer
from docloom.llm.token_counts import TokenCounter, token_counts
from docloom.llm.token_files import packed_ids, read_token_files, write_token_files

from .conftest import ODD_TEXTS


def ids_of(tokens, text):
    return library_tokenizer(tokens).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("text", [t or "" for t in ODD_TEXTS])
def test_ids_and_counts_equal_the_library(tokens, text):
    ids, offsets = ChunkEncoder(tokens).encode(pa.array([text, text]))
    want = ids_of(tokens, text)
    assert list(ids[: offsets[1]]) == want == list(ids[offsets[1] :])
    assert TokenCounter(tokens).count(pa.array([text]))[0] == len(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abAB z'sé1<|>.\ń漢­ß"), max_size=30), min_size=1, max_size=5))
def test_any_text(texts):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    want = [ids_of(path, t) for t in texts]
    ids, offsets = ChunkEncoder(path).encode(pa.array(texts))
    assert [list(ids[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)] == want
    assert TokenCounter(path).count(pa.array(texts)).tolist() == [len(w) for w in want]


LATIN = "".join(chr(c) for c in range(0x21, 0x100) if SIMPLE.fullmatch(chr(c)))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(LATIN + "'" * 60 + "'sStTrReEvVmMlLdD" * 8 + "<|0½ÀÞ×漢\x7f"), min_size=1, max_size=12), min_size=1, max_size=8))
def test_cut_follows_the_pattern(words):
    import public_tokenizers

    pieces, offsets, whole = cut(pa.array(["x", *words]).slice(1))
    assert whole.tolist() == [not SIMPLE.fullmatch(w) or "<|" in w for w in words]
    for k, w in enumerate(words):
        want = [w] if whole[k] else pre_tokens(public_tokenizers.path("word_bpe_49k.json"), [w])[0]
        assert pieces.slice(offsets[k], offsets[k + 1] - offsets[k]).to_pylist() == want


def test_pre_tokens_are_learned_once(tokens, monkeypatch):
    """Spellings of few words with other signs and cases around them cost and keep no more than the words."""
    words = [f"{c}{w}{a}{b}" for w in ("alpha", "BETA", "Gamma") for c in "(['*" for a in ".,;:" for b in ")]'*"]
    encoder, learned = ChunkEncoder(tokens), []
    monkeypatch.setattr(ChunkEncoder, "_learn", lambda self, new, f=ChunkEncoder._learn: (learned.extend(new), f(self, new)))
    for _ in range(2):
        ids, offsets = encoder.encode(pa.array([" ".join(words)] * 2))
        assert list(ids[: offsets[1]]) == ids_of(tokens, " ".join(words))
    assert len(learned) == len(set(learned)) == sum(len(x.known) for x in vars(encoder).values() if isinstance(x, Store))
    assert {x for x in learned if x.isalpha()} == {"alpha", "beta", "gamma"}


def test_calls_of_any_size_and_full_stores(tokens, monkeypatch, prose):
    from docloom.llm import chunk_ids

    texts = [prose(50, k) + " 漢字 <|endoftext|>x it's" for k in range(8)]
    want = [ids_of(tokens, t) for t in texts]
    for calls, chars, kept in ((1, 1, 1), (7, 20, 40), (20_000, 1 << 20, 10**6)):
        monkeypatch.setattr(chunk_ids, "CALL_PIECES", calls)
        monkeypatch.setattr(chunk_ids, "CALL_CHARS", chars)
        monkeypatch.setattr(chunk_ids, "CACHE_CHUNKS", kept)
        encoder = ChunkEncoder(tokens)
        assert [list(encoder.encode(pa.array([t]))[0]) for t in texts] == want


def test_other_vocabularies_go_through_the_library_whole(tokens, tmp_path):
    text = open(tokens, encoding="utf-8").read()
    assert text.count("'ve|'m|'ll|'d|") == 1
    (tmp_path / "other.json").write_text(text.replace("'ve|'m|'ll|'d|", "'ve|'m|'d|"), encoding="utf-8")
    texts, path = ["we'll see it's 12 Äpfel", "", "漢字 a"], str(tmp_path / "other.json")
    ids, offsets = ChunkEncoder(path).encode(pa.array(texts))
    assert [list(ids[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)] == [ids_of(path, t) for t in texts]


def test_count_rows(spark, odd, empty, tokens):
    rows = token_counts(odd, tokens).collect()
    assert len(rows) == len(ODD_TEXTS)
    assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == sorted((len((t or "").encode()), n := len(ids_of(tokens, t)), n > 2048) for t in ODD_TEXTS)
    assert token_counts(empty, tokens).collect() == []


def test_token_files(spark, odd, empty, tokens, tmp_path):
    about = write_token_files(odd, f"file://{tmp_path}/set", tokens)
    rows = sorted(read_token_files(spark, f"file://{tmp_path}/set").collect(), key=lambda r: r["start"])
    assert [r["id"] for r in rows] == sorted((r["doc_id"] for r in odd.collect()), key=lambda x: (x is not None, x))
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1]]
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((len(i) + 1, crc([*i, 1])) for i in (ids_of(tokens, t) for t in ODD_TEXTS))
    flat = np.concatenate([np.fromfile(f, "<u2") for f in sorted((tmp_path / "set").glob("ids-*.bin"))])
    assert len(flat) == about["n_tokens"] == sum(r["n_tokens"] for r in rows)
    write_token_files(empty, f"file://{tmp_path}/none", tokens)
    assert read_token_files(spark, f"file://{tmp_path}/none").collect() == []


def test_token_files_learn_pre_tokens_once(tokens, monkeypatch):
    """A task that packs ids asks the model for each pre-token once, over all its batches and spellings."""
    texts = [f"{a}field{b} {a}HILL{b} Cloud{b}" for a in "(['*" for b in ".,;:)]"]
    learned, batch = [], pa.record_batch([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], ["id", "hash", "text"])
    monkeypatch.setattr(ChunkEncoder, "_learn", lambda self, new, f=ChunkEncoder._learn: (learned.extend(new), f(self, new)))

    class Rows:
        schema = StructType([StructField("id", LongType())])

        def mapInArrow(self, run, schema):
            return run([batch, batch])

    out = [x for b in packed_ids(Rows(), tokens, "<u2", 1, []) for x in b.column("ids").to_pylist()]
    assert [np.frombuffer(x, "<u2").tolist() for x in out] == [[*ids_of(tokens, t), 1] for t in texts] * 2
    assert {x for x in learned if x.isalpha()} == {"field", "hill", "cloud"} and len(learned) == len(set(learned)) <= 3 + 10


def test_packing_rows(spark, odd, empty, tokens):
    rows = P.packed_documents(odd, tokens, window=64).collect()
    total = sum(len(ids_of(tokens, t)) + 1 for t in ODD_TEXTS)
    assert sum(r["length"] for r in rows) == total
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(by) == list(range(len(by)))
    assert len(by) <= -(-total // 64) + 2
    long = ids_of(tokens, "word " * 5000) + [1]
    own = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_tokens"] == len(long))
    assert own == [(k, len(long[k : k + 64]), crc(long[k : k + 64])) for k in range(0, len(long), 64)]
    assert P.packed_documents(empty, tokens).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.dictionaries(st.integers(1, 60), st.integers(1, 5), max_size=6))
def test_best_fill_is_best(capacity, counts):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= capacity}
    chosen = P.best_fill(capacity, counts)
    assert sum(k * n for k, n in chosen.items()) == max(sums)
    assert all(n <= counts[k] for k, n in chosen.items())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 1000), max_size=20))
def test_slots_hold_each_piece_once(histogram):
    patterns = P.patterns_of(histogram, 64)
    used = {}
    for uses, inside in patterns:
        assert sum(k * n for k, n in inside.items()) <= 64
        for k, n in inside.items():
            used[k] = used.get(k, 0) + n * uses
    assert used == histogram
    slots, seen = P.Slots(patterns, 7), set()
    for length, n in histogram.items():
        window, offset = slots.place(np.full(n, length), np.arange(n))
        for w, o in zip(window.tolist(), offset.tolist(), strict=True):
            seen |= {(w, o + k) for k in range(length)}
    assert len(seen) == sum(k * n for k, n in histogram.items())


def test_shards_of_any_size(spark, tokens, tmp_path, prose):
    """Many shards, equal and null ids in several of them, one order over all."""
    rows = [(None if k % 4 == 0 else k // 8, prose(5 + k % 40, k)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for n, size in (("many", 2000), ("one", 1 << 30)):
        about = write_token_files(df, f"file://{tmp_path}/{n}", tokens, shard_bytes=size)
        found = sorted(read_token_files(spark, f"file://{tmp_path}/{n}").collect(), key=lambda r: r["start"])
        assert [r["id"] for r in found] == sorted((k for k, _ in rows), key=lambda x: (x is not None, x))
        assert [r["start"] for r in found] == [0, *np.cumsum([r["n_tokens"] for r in found])[:-1]]
        assert (len(about["shards"]) > 10) == (n == "many")
        assert sorted((r["n_tokens"], r["ids_crc32"]) for r in found) == sorted((len(i) + 1, crc([*i, 1])) for i in (ids_of(tokens, t) for _, t in rows))
