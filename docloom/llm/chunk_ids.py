"""Whole-text token ids through the tokenizers library, once per distinct pre-token.

The vocabulary drops white space, so the ids of a text are the ids of its
white-space-separated chunks in order.  Chunks of ASCII and Latin-1 characters, on
which normalising is lower-casing alone, are cut into pre-tokens here, a slice's
distinct chunks at once over their bytes; a pre-token goes through the library's
model once per task and is then looked up.  All other chunks, and all chunks of
a vocabulary with another pattern, go through the library whole.  `tests/llm`
compares with the library on whole texts and with the pattern on chunks.
"""

from __future__ import annotations

import functools
import itertools
import json

import numpy as np
import pyarrow as pa
import regex

from docloom.llm.common import library_tokenizer, ragged_gather, split_words

CACHE_CHUNKS, CACHE_BYTES = 800_000, 64 << 20
SIMPLE = regex.compile(r"[!-~¡-ÿ]+")
#: The pattern that cut() follows, and how much goes through the library in one call.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CALL_PIECES, CALL_CHARS = 20_000, 1 << 20
LETTER, DIGIT, OTHER, STRANGE = range(4)


@functools.lru_cache(maxsize=2)
def pattern_of(path: str) -> regex.Pattern:
    """The pre-token pattern of the vocabulary file, with line ends as separators."""
    with open(path, encoding="utf-8") as file:
        steps = json.load(file)["pre_tokenizer"]["pretokenizers"]
    return regex.compile(steps[0]["pattern"]["Regex"] + r"|\n")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(0x100 + k) for k, b in enumerate(others)} | {b: chr(b) for b in plain}


LETTERS = byte_letters() | {10: "\n"}


@functools.lru_cache(maxsize=2)
def model_tokenizer(path: str):
    """The library's model alone, over pre-tokens in byte letters with white space between them."""
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer(library_tokenizer(path).model)
    tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return tokenizer


@functools.lru_cache(maxsize=2)
def last_ids(path: str) -> np.ndarray | None:
    """Which ids end a pre-token; none where the pattern is another one or ids don't tell."""
    suffix, vocabulary = library_tokenizer(path).model.end_of_word_suffix, library_tokenizer(path).get_vocab(with_added_tokens=False)
    letters = byte_letters().values()
    if pattern_of(path).pattern != PATTERN + r"|\n" or not suffix or not all(x in vocabulary and x + suffix in vocabulary for x in letters):
        return None
    last = np.zeros(max(vocabulary.values()) + 1, bool)
    last[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True
    return last


def pre_tokens(path: str, chunks: list[str]) -> tuple[list[str], np.ndarray]:
    """Pre-tokens of simple chunks and len(chunks) + 1 offsets."""
    found = pattern_of(path).findall("\n".join(chunks).lower())
    breaks = np.array([x == "\n" for x in found], bool)
    at = np.flatnonzero(breaks)
    offsets = np.concatenate([[0], at - np.arange(len(at)), [len(found) - len(at)]])
    return [x for x in found if x != "\n"], offsets


def kind_of(character: str) -> int:
    if not SIMPLE.fullmatch(character):
        return STRANGE
    return LETTER if regex.match(r"\p{L}", character) else DIGIT if regex.match(r"\p{N}", character) else OTHER


KINDS = np.array([kind_of(chr(c)) for c in range(256)], np.uint8)
BYTE_KINDS = np.where(np.arange(256) < 128, KINDS, STRANGE).astype(np.uint8)


def cut(words: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Pre-tokens of all (non-empty) words in lower case, len(words) + 1 offsets, and which words
    are not simple or hold "<|": those stay whole and as they are."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]]
    at -= at[0]
    n = len(data)
    low, first = np.zeros(n + 4, np.uint8), np.zeros(n + 4, bool)  # with room to look ahead
    low[:n], first[at] = data, True
    kinds = BYTE_KINDS[low]
    lead = np.flatnonzero((data & 0xFE) == 0xC2)
    after = low[lead + 1]
    kinds[lead] = kinds[lead + 1] = KINDS[(data[lead] & 3) << 6 | after & 0x3F]
    low[:n] += (((data - np.uint8(65)) < 26) * 32).astype(np.uint8)
    low[lead + 1] += ((data[lead] == 0xC3) & (after < 0x9F) & (after != 0x97)).astype(np.uint8) * np.uint8(32)
    starts = first.copy()
    starts[1:n] |= (kinds[1:n] != kinds[: n - 1]) | (kinds[1:n] == DIGIT)
    starts[:n] &= (data & 0xC0) != 0x80
    mark = np.flatnonzero((data == 39) & starts[:n])
    mark = mark[(kinds[mark + 1] == LETTER) & ~first[mark + 1]]  # an apostrophe alone before letters
    a, b = low[mark + 1], low[mark + 2]
    one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
    two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~first[mark + 2]
    starts[mark[one | two] + 1] = False
    starts[mark[one] + 2] = True
    starts[mark[two] + 3] = True
    whole = np.zeros(len(words), bool)
    for spots in (np.flatnonzero(kinds[:n] == STRANGE), np.flatnonzero((data == ord("<")) & (low[1 : n + 1] == ord("|")) & ~first[1 : n + 1])):
        whole[np.searchsorted(at, spots, "right") - 1] = True
    if whole.any():
        of = np.repeat(whole, np.diff(at))
        starts[:n] &= first[:n] | ~of
        low[:n][of] = data[of]
    ends = np.flatnonzero(starts[: n + 1])
    pieces = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(low[:n]))
    return pieces, np.searchsorted(ends, at), whole


class Store:
    """Keys with their id runs in one flat array."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.ends = np.zeros(1 << 16, np.int64)

    def add(self, keys: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        n = len(self.known)
        while n + len(keys) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(keys)] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        self.known.update(zip(keys, range(n, n + len(keys)), strict=True))

    def gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self.ends[place]
        lengths = self.ends[place + 1] - starts
        return self.flat[ragged_gather(starts, lengths)], lengths


class ChunkEncoder:
    """Encodes slices of texts; keeps at most about CACHE_CHUNKS pre-tokens of CACHE_BYTES between slices."""

    def __init__(self, path: str):
        self.path, self.pieces, self.held = path, Store(), 0

    def _learn(self, pieces: list[str]) -> None:
        """Pre-tokens through the model, many in one call; the last id of each tells where it ends."""
        call = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))) // CALL_CHARS + np.arange(len(pieces)) // CALL_PIECES
        cuts = [0, *(np.flatnonzero(np.diff(call)) + 1).tolist(), len(pieces)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = pieces[a:b]
            spelled = "\n".join(part).encode().decode("latin-1").translate(LETTERS)
            (done,) = model_tokenizer(self.path).encode_batch_fast([spelled], add_special_tokens=False)
            ids = np.array(done.ids, np.uint32)
            self.pieces.add(part, ids, np.diff(np.flatnonzero(last_ids(self.path)[ids]), prepend=-1))

    def _learn_whole(self, chunks: list[str]) -> None:
        for at in range(0, len(chunks), CALL_PIECES):
            part = chunks[at : at + CALL_PIECES]
            ids = [e.ids for e in library_tokenizer(self.path).encode_batch_fast(part, add_special_tokens=False)]
            lengths = np.array([len(x) for x in ids], np.int64)
            self.pieces.add(part, np.array([i for x in ids for i in x], np.uint32), lengths)

    def _ids_of(self, words: pa.StringArray) -> pa.ListArray:
        """Ids of each of some distinct words."""
        if last_ids(self.path) is None:
            pieces, offsets, whole = words, np.arange(len(words) + 1), np.ones(len(words), bool)
        else:
            pieces, offsets, whole = cut(words)
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        if len(self.pieces.known) + len(coded.dictionary) > CACHE_CHUNKS or self.held + coded.dictionary.nbytes > CACHE_BYTES:
            self.pieces, self.held = Store(), 0
        known, names = self.pieces.known, coded.dictionary.to_pylist()
        place = np.fromiter(map(known.get, names, itertools.repeat(-1)), np.int64, len(names))
        kept = np.zeros(len(names), bool)
        kept[codes] = np.repeat(whole, np.diff(offsets))  # a whole chunk is no pre-token of another one
        for learn, fresh in ((self._learn, ~kept & (place < 0)), (self._learn_whole, kept & (place < 0))):
            if fresh.any():
                at = np.flatnonzero(fresh)
                new = [names[k] for k in at.tolist()]
                place[at] = np.arange(len(known), len(known) + len(new))
                learn(new)
                self.held += sum(map(len, new))
        ids, lengths = self.pieces.gather(place[codes])
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and len(texts) + 1 offsets."""
        codes, offsets, words = split_words(texts, ascii_only=True)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        runs = self._ids_of(words).take(pa.array(codes))
        starts = np.asarray(runs.offsets).astype(np.int64)
        flat = runs.values.to_numpy(zero_copy_only=False)
        return flat[starts[0] : starts[-1]], (starts - starts[0])[offsets]
