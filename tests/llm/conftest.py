import random

import pytest

WORDS = [f"{a}{b}{c}" for a in ("ba", "ke", "mo", "ti", "ru", "za") for b in ("lo", "ni", "sa", "ve") for c in ("n", "r", "s", "ta", "mi")]


@pytest.fixture(scope="session")
def prose():
    """prose(n, seed): n words, the same for the same seed."""

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def tokens():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


ODD_TEXTS = [
    None, "", "   ", "a", "\n\n", "don't I'LL we've 123", "<|endoftext|>x  y<|startoftext|>b", "e ́a 한", "x\x1cy\x1dz\x00", "a b　c﻿​d", "aaaaaaaaa aaaa", "İstanbul ΣΑΣ ﬁ",
    "!!!!!!!???----====", "\U0001f916\U0001f916ab!!!??", "a" * 3000 + "b" * 500, "word " * 5000, "repeated row", "repeated row",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and long texts, repeated rows, and columns of clashing names."""
    rows = [(None if k == 5 else k // 2, t, "x", k, 1.5) for k, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, length int, score double")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
