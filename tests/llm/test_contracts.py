"""Every opN_ query over whole tables: columns, types, and values by brute force."""

import hashlib
import html
import re
import zlib
from math import ceil

import numpy as np
import pytest

from docloom.llm import entries

from .test_corpus import brute_links
from .test_learned import brute_statistics


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def encoded(documents, tokens):
    from docloom.llm.common import library_tokenizer

    return {d["doc_id"]: library_tokenizer(tokens).encode(d["text"] or "", add_special_tokens=False).ids for d in documents}


def answer(spark, sf_dir, name, kinds):
    """Rows of a query whose first columns are `kinds`."""
    found = entries.QUERIES[name](spark, sf_dir)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema).startswith(kinds)
    return [r.asDict(recursive=True) for r in found.collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def remainder(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


def test_op1(spark, sf_dir, documents):
    rows = answer(spark, sf_dir, "op1_toxicity", "doc_id bigint, held_out boolean, score double, predicted int")
    assert sorted(r["doc_id"] for r in rows) == sorted(d["doc_id"] for d in documents)
    text = {d["doc_id"]: d["text"] or "" for d in documents}
    for r in rows:
        assert r["held_out"] == (remainder(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        for s in r["spans"]:
            words = text[r["doc_id"]][s["start"] : s["end"]]
            assert words and words == words.strip() and 0.5 <= s["probability"] <= 1
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    wrong = [r["doc_id"] for r in rows if r["held_out"] and toxic.get(r["doc_id"]) is not None and r["predicted"] != toxic[r["doc_id"]]]
    assert len(wrong) <= 2


def test_op2(spark, sf_dir, documents):
    rows = answer(spark, sf_dir, "op2_tiff", "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    want = {}
    for d in documents:
        raw = (d["text"] or "").encode()
        full = raw + b" " * (max(1, ceil(len(raw) / 192)) * 192 - len(raw))
        want[d["doc_id"]] = (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
    assert {r["doc_id"]: (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows} == want and len(rows) == len(want)
    assert len({(r["payload_sha256"], r["media_bytes"], r["media_sha256"], r["feature"]) for r in rows}) == len({r["payload_sha256"] for r in rows})


def test_op3(spark, sf_dir, encoded):
    rows = answer(spark, sf_dir, "op3_token_files", "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    at, want = 0, []
    for k in sorted(encoded):
        ids = [*encoded[k], 1]
        want.append((k, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want


def test_op4(spark, sf_dir, documents):
    kinds = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"
    rows = {r["doc_id"]: r for r in answer(spark, sf_dir, "op4_quality_rules", kinds)}
    assert len(rows) == len(documents)
    for d in documents:
        r, base = rows[d["doc_id"]], brute_statistics(d["text"])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base
        assert r["base_failed"] == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert not (r["base_failed"] and r["kept"])


def test_op5(spark, sf_dir, documents):
    rows = {r["doc_id"]: r for r in answer(spark, sf_dir, "op5_language_id", "doc_id bigint, held_out boolean, lang_pred string, score double")}
    assert len(rows) == len(documents)
    wrong = 0
    for d in documents:
        r = rows[d["doc_id"]]
        assert r["held_out"] == (remainder(d["doc_id"], 4) == 2) and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in d["text"] or ""):
            assert r["lang_pred"] == "und"
        elif r["held_out"]:
            wrong += d["lang"] is not None and r["lang_pred"] != d["lang"]
    assert wrong <= 2


def test_op6(spark, sf_dir, documents):
    rows = answer(spark, sf_dir, "op6_jaccard_join", "doc_id bigint, class_id bigint, copy_id bigint, n_links bigint, n_texts bigint")
    assert {r["doc_id"]: (r["class_id"], r["copy_id"], r["n_links"], r["n_texts"]) for r in rows} == brute_links([(d["doc_id"], d["text"]) for d in documents])


def test_op7(spark, sf_dir):
    rows = answer(spark, sf_dir, "op7_style_tree", "page_id bigint, url string, text string, n_chars bigint")
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        page = pages[r["page_id"]]
        body = page["html"][page["html"].index("<article>") : page["html"].index("</article>")]
        text = " ".join(html.unescape(re.sub("</?b>", "", re.sub("<(?!/?b>)[^>]*>", " ", body))).split())
        assert (r["url"], r["text"], r["n_chars"]) == (page["url"], text, len(text))


def test_op8(spark, sf_dir):
    answer(spark, sf_dir, "op8_mixing", "doc_id bigint, source string, n_tokens bigint, epoch bigint, block bigint, block_key bigint, place_key bigint, weight double")


@pytest.mark.parametrize("name", entries.ORACLE_SQL)
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = con.execute(entries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    rows = entries.QUERIES[name](spark, sf_dir)
    assert sorted(rows.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in rows.collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_op9(spark, sf_dir, encoded):
    kinds = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    rows = answer(spark, sf_dir, "op9_packing", kinds)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["doc_tokens"] == len(encoded[r["doc_id"]]) + 1
    assert set(pieces) == set(encoded)
    for k, found in pieces.items():
        ids, at = [*encoded[k], 1], 0
        for start, length, value in sorted(found):
            assert start == at and value == crc(ids[start : start + length])
            at += length
        assert at == len(ids)
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(len(x) + 1 for x in encoded.values())
    assert len(sequences) <= ceil(total / 2048) + 1


def test_op10(spark, sf_dir, documents, encoded):
    rows = answer(spark, sf_dir, "op10_token_counts", "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
    want = {d["doc_id"]: (len((d["text"] or "").encode()), len(encoded[d["doc_id"]]), len(encoded[d["doc_id"]]) > 2048) for d in documents}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows} == want and len(rows) == len(want)
