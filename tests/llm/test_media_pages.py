import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import style_tree as H
from docloom.llm import tiff as T

from .conftest import ODD_TEXTS


@pytest.mark.parametrize("scheme", [T.PLAIN, T.PACKBITS, T.LZW, T.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("rows", [1, 7, 300])
def test_round_trip(scheme, predictor, rows):
    payload = (b"hello hello aaaaaaaaaaaaa" * 4000)[: 96 * rows] + os.urandom(192 * rows - 96 * rows)
    pages = list(T.read_pages(T.write_gray(payload, page_rows=100, schemes=(scheme,), predictor=predictor, strip_rows=33)))
    assert b"".join(p.pixels for p in pages) == payload and len(pages) == -(-rows // 100)


def test_known_codes():
    assert T.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])).hex() == "8001e0408044" + T.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])).hex()[12:]
    assert T.unpack_bits(bytes.fromhex("FEAA02 80002A FDAA 03 80002A22 F7AA".replace(" ", "")), 24).hex() == "aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10
    for n in (0, 1, 2, 600, 9000):
        data = bytes(random.Random(n).choices(b"abcd", k=n))
        assert T.lzw_decode(T.lzw_encode(data), n) == data == T.unpack_bits(T.pack_bits(data), n)


CODES = {3: "H", 4: "I", 11: "f", 16: "Q"}


def tiff(fields, data, order=">", big=False):
    """A file of one directory whose parts come first; long values stand behind the directory."""
    head, count, value, room = (16, "Q", "Q", 8) if big else (8, "I", "I", 4)
    mark = b"MM" if order == ">" else b"II"
    start = struct.pack(order + "HHHQ", 43, 8, 0, head + len(data)) if big else struct.pack(order + "HI", 42, head + len(data))
    out = mark + start + data + struct.pack(order + ("Q" if big else "H"), len(fields))
    behind, at = b"", len(out) + len(fields) * (20 if big else 12) + (8 if big else 4)
    for tag, kind, values in fields:
        raw = struct.pack(f"{order}{len(values)}{CODES[kind]}", *values)
        if len(raw) > room:
            raw, behind = struct.pack(order + value, at + len(behind)), behind + raw
        out += struct.pack(order + "HH" + count, tag, kind, len(values)) + raw.ljust(room, b"\0")
    return out + b"\0" * (8 if big else 4) + behind


def page_of(fields, data, **how):
    return next(iter(T.read_pages(tiff(fields, data, **how)))).pixels


def fields_of(width, height, bits, at, sizes, samples=1, scheme=1, planar=1, predictor=1, fill=1, rows=None):
    out = [(256, 4, [width]), (257, 4, [height]), (258, 3, [bits] * samples), (259, 3, [scheme]), (266, 3, [fill]), (273, 4, at), (277, 3, [samples]), (278, 4, [rows or height]), (279, 4, sizes)]
    return [*out, (284, 3, [planar]), (317, 3, [predictor])]


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiles_of_wide_samples(order):
    image = np.arange(16 * 16, dtype=f"{order}u2").reshape(16, 16) * 200
    coded = np.diff(image.astype(np.int64), axis=1, prepend=0).astype("i4").astype(f"{order}u2")
    data = zlib.compress(coded.tobytes())
    base = [(256, 4, [10]), (257, 4, [12]), (258, 3, [16]), (259, 3, [8]), (277, 3, [1]), (317, 3, [2])]
    found = page_of([*base, (322, 4, [16]), (323, 4, [16]), (324, 4, [8]), (325, 4, [len(data)])], data, order=order)
    assert np.array_equal(np.frombuffer(found, f"{order}u2").reshape(12, 10), image[:12, :10])


def test_planes_big_files_and_bit_order():
    r = np.random.default_rng(1)
    image = r.integers(0, 256, (5, 7, 3), np.uint8)
    planes = image.transpose(2, 0, 1).tobytes()
    for big in (False, True):
        head = 16 if big else 8
        assert page_of(fields_of(7, 5, 8, [head, head + 35, head + 70], [35] * 3, 3, planar=2), planes, big=big) == image.tobytes()
    # samples of one bit in three planes become neighbours
    bits = r.integers(0, 2, (4, 10, 3), np.uint8)
    data = b"".join(np.packbits(bits[:, :, k], axis=1).tobytes() for k in range(3))
    assert page_of(fields_of(10, 4, 1, [8, 16, 24], [8] * 3, 3, planar=2), data) == np.packbits(bits.reshape(4, 30), axis=1).tobytes()
    turned = bytes(int(f"{b:08b}"[::-1], 2) for b in planes[:35])
    assert page_of(fields_of(7, 5, 8, [8], [35], fill=2), turned) == planes[:35]
    assert page_of(fields_of(7, 5, 8, [8, 22], [14, 21], rows=2, scheme=1)[:0] + fields_of(7, 5, 8, [8, 22, 36], [14, 14, 7], rows=2), planes[:35]) == planes[:35]


@pytest.mark.parametrize("order", ["<", ">"])
def test_floating_point_predictor(order):
    image = np.random.default_rng(2).normal(size=(3, 6)).astype(f"{order}f4")
    big = image.astype(">f4").view(np.uint8).reshape(3, 6, 4).transpose(0, 2, 1).reshape(3, 24)
    data = np.diff(big.astype(np.int16), axis=1, prepend=np.zeros((3, 1), np.int16)).astype(np.uint8).tobytes()
    assert page_of(fields_of(6, 3, 32, [8], [len(data)], predictor=3), data, order=order) == image.tobytes()


HOSTILE = [
    tiff([(256, 11, [4.0]), *fields_of(4, 4, 8, [8], [16])[1:]], b"x" * 16),
    tiff([*fields_of(4, 4, 8, [8], [16], planar=2)[:6], (277, 3, [0]), *fields_of(4, 4, 8, [8], [16], planar=2)[7:]], b"x" * 16),
    tiff(fields_of(1 << 31, 1 << 31, 8, [8], [16]), b"x" * 16), tiff(fields_of(4, 4, 0, [8], [16]), b"x" * 16), tiff(fields_of(4, 4, 8, [1 << 31], [16]), b"x" * 16),
    tiff([(256, 16, [1 << 62]), (257, 16, [1 << 62]), *fields_of(4, 4, 8, [16], [16])[2:]], b"x" * 16, big=True), tiff(fields_of(4, 4, 8, [8], [16], scheme=7), b"x" * 16),
    tiff(fields_of(4, 4, 8, [8], [16], predictor=9), b"x" * 16), b"", b"II", b"II*\0", b"MM\0+\0\x08\0\0" + b"\xff" * 30,
]


def test_hostile_files_are_rows(spark):
    rows = [(k, x) for k, x in enumerate(HOSTILE)]
    found = T.tiff_pages(spark.createDataFrame(rows, "doc_id int, media binary")).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(len(HOSTILE))) and all(r["error"] for r in found)


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_mutated_files(data):
    file = bytearray(T.write_gray(b"some text here, some there  " * 192, page_rows=10, strip_rows=5))
    for _ in range(data.draw(st.integers(1, 6))):
        file[data.draw(st.integers(0, len(file) - 1))] = data.draw(st.integers(0, 255))
    try:
        list(T.read_pages(bytes(file)))
    except T.FAULTS:
        pass


def test_faults(spark):
    good = T.write_gray(b"x" * 192 * 10, page_rows=5)
    rows = [(1, good), (2, b"no tiff"), (3, None), (4, good[:30]), (5, good[: len(good) - 6]), (1, good)]
    found = T.tiff_pages(spark.createDataFrame(rows, "doc_id int, media binary")).collect()
    pages = sorted((r["doc_id"], r["page"], r["height"]) for r in found if r["error"] is None)
    assert pages[:4] == [(1, 0, 5), (1, 0, 5), (1, 1, 5), (1, 1, 5)]
    assert {r["doc_id"] for r in found if r["error"]} == {2, 4, 5}


def test_digests(spark, odd, empty):
    rows = T.media_digests(T.store_texts(odd)).collect()
    assert len(rows) == len(ODD_TEXTS)
    want = {}
    for t in ODD_TEXTS:
        raw = (t or "").encode()
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.setdefault((len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])), 0)
    assert {(r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows} == set(want)
    assert len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in rows}) == len({r["payload_sha256"] for r in rows})
    assert T.media_digests(T.store_texts(empty)).collect() == []


PAGE = "<html><head><title>t</title></head><body class='sidebar-page'><header><h1>Site</h1></header><nav><a href=/>home</a></nav><div class='cookie-notice'>accept</div><article><h1>{t}</h1><p>{p} &amp; so<br>on<p>two</p><form><label>mail</label></form><div class='x'>{c}</div></article><div class='b7'>{b}</div><aside>s</aside><section id='comments'><p>first!</p></section><script>'</p>'</script><footer>f</footer>"


def test_main_text(spark, prose):
    rows = [(k, f"http://a.example/{k}", PAGE.format(t=prose(4, k), p=prose(20, 100 + k), c=prose(9, 200 + k), b="buy now " + prose(3, k % 2))) for k in range(40)]
    rows += [(100, None, None), (101, "http://b.example/", ""), (102, "x", "<p>only <b>one"), (0, *rows[0][1:])]
    out = H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["page_id"] < 100:
            k = r["page_id"]
            assert r["text"] == f"{prose(4, k)} {prose(20, 100 + k)} & so on two {prose(9, 200 + k)}"
        assert r["n_chars"] == len(r["text"])
    text = {r["page_id"]: r["text"] for r in out}
    assert (text[100], text[101], text[102]) == ("", "", "only one")


def plain_low(rows):
    """The style tree by its definition, one page at a time: the unimportant (host, node)."""
    import math
    from collections import Counter, defaultdict
    from urllib.parse import urlparse

    stats = defaultdict(lambda: {"words": Counter(), "styles": Counter(), "m": 0, "s": 0.0, "k": 0.0, "l": 0.0, "parent": 0, "prior": 0.0})
    for host, page in dict.fromkeys((urlparse(u).netloc, p) for _, u, p in rows):
        nodes, found = H.blocks(page)
        own, chars, linked = defaultdict(list), Counter(), Counter()
        for node, text, n in found:
            own[node.key] += text.split()
            chars[node.key] += len(text)
            linked[node.key] += n
        for node in nodes:
            if not node.hidden:
                at = stats[host, node.key]
                at["styles"][H.style_of(node)] += 1
                at["parent"], at["prior"] = node.parent.key if node.parent else 0, node.prior()
        for key, words in own.items():
            at, others = stats[host, key], {w for k, ws in own.items() if k != key for w in ws}
            at["words"].update(set(words))
            at["m"] += 1
            at["s"] += len(words) / sum(map(len, own.values()))
            at["k"] += len(set(words) & others) / len(set(words))
            at["l"] += min(1, linked[key] / chars[key])
    for at in stats.values():
        n, m = sum(at["styles"].values()), at["m"]
        at["P"] = max(0, -sum(x / n * math.log(x / n) for x in at["styles"].values()) / math.log(H.STYLES))
        if m:
            c = 1 - sum(math.log(x) for x in at["words"].values()) / len(at["words"]) / math.log(m) if m > 1 else 1.0
            at["I"] = c * (1 - at["l"] / m) * math.sqrt(1 - (1 - at["s"] / m) * (1 - at["k"] / m))
    low = set()
    for (host, key), at in stats.items():
        if at["m"]:
            same = [x for (_, k), x in stats.items() if k == key and x["m"]]
            mean = lambda c: sum(x["m"] * x[c] for x in same) / sum(x["m"] for x in same)
            lean = lambda c: (at["m"] * at[c] + H.LEAN * mean(c)) / (at["m"] + H.LEAN)
            p = min(0.99, max(0.01, lean("I")))
            shown = min(1, max(lean("P"), stats[host, at["parent"]]["P"] if (host, at["parent"]) in stats else 0))
            if math.log(p / (1 - p)) + H.PRESENTED * (shown - 0.25) + at["prior"] < math.log(H.LOW / (1 - H.LOW)):
                low.add((host, key))
    return low


def site_pages(prose, n, hosts=3):
    """Pages with menus, adverts, footers and prose, none of them named."""
    vocabulary = prose(60, 9000).split()
    some = lambda k, r: " ".join(random.Random(r).sample(vocabulary, k))
    page = "<html><body><div><ul>{m}</ul></div><div class=q1>{ad}</div><section><h2>{t}</h2>{ps}<table><tr><td>{c}</td></tr></table></section><div class=q2>{f}</div></body></html>"
    rows = []
    for k in range(n):
        ps = "".join(f"<p>{prose(30 + 7 * (k % 5), 50 * k + j)} w{k}x{j}</p>" for j in range(1 + k % 4))
        menu = "".join(f"<li><a href=/{w}>{w}</a></li>" for w in some(5, k).split())
        rows.append((k, f"http://h{k % hosts}.example/{k}", page.format(m=menu, ad=some(4, 100 + k), t=prose(40, 50 * k)[:40], ps=ps, c=f"cell{k} {prose(12, 50 * k)}", f="all rights " + some(4, 200 + k))))
    return rows


def test_the_tree_against_its_definition(spark, prose):
    rows = site_pages(prose, 40)
    df = spark.createDataFrame([*rows, *rows[:5]], "page_id long, url string, html string")
    low = plain_low(rows)
    sites = {r["url"]: r["site"] for r in H.with_site(df, "url").collect()}
    expected = {k: H.main_text(page, {key for host, key in low if f"http://{host}/" in url}) for k, url, page in rows}
    site_of = {url.split("/")[2]: sites[url] for _, url, _ in rows}
    found = {(r["site"], r["node"] % (1 << 64)) for r in H.unimportant_nodes(H.with_site(df, "url")).collect()}
    assert found == {(site_of[host], key) for host, key in low}
    out = H.extract_main_text(df).collect()
    assert len(out) == 45
    assert all(r["text"] == expected[r["page_id"]] for r in out)


def test_the_tree_decides(spark, prose):
    """No block is named: menus, adverts and footers leave by the tree alone, and stay without it."""
    rows = site_pages(prose, 400, 2)
    out = {r["page_id"]: r["text"] for r in H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, _, page in rows:
        body = page[page.index("<h2>") : page.index("</section>")]
        assert out[k] == " ".join(__import__("re").sub("<[^>]*>", " ", body).split())
        assert len(H.main_text(page, frozenset())) > len(out[k])


def test_broadcast_and_stream_agree(spark, prose):
    rows = [*site_pages(prose, 60), (100, None, None), (101, "http://b.example/", ""), (0, "http://h0.example/0", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, other = (sorted(tuple(r) for r in H.extract_main_text(df, broadcast_nodes=n).fillna("null", ["url"]).collect()) for n in (10**6, -1))
    assert one == other and len(one) == len(rows)


@pytest.mark.parametrize(("page", "text"), [
    ('<form id="aspnetForm"><article><p>the body of it</p></article></form>', "the body of it"),
    ("<article><section id='discussion'><p>what we found</p></section></article>", "what we found"),
    ("<article><div class='related-work'><p>others found</p></div></article>", "others found"),
    ("<object><p>fallback", "fallback"), ("<noscript><p>a</noscript><p>b", "b"), ("<p>a < b <3 c", "a < b <3 c"), ("<p title='>'>x</p>", "x"), ("a<!-- <p>b", "a"),
    ("<p>1<p hidden>2<p style='display: none'>3<p>4", "1 4"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a b c"), ("<p>&lt;b&gt; &amp;amp;&nbsp;z", "<b> &amp; z"), ("x</p></div>y", "x y"),
])
def test_blocks(page, text):
    assert H.main_text(page, frozenset()) == text


@pytest.mark.parametrize("page", [
    '<a "' * 250_000, '<p x="' * 170_000, "<div>" * 100_000 + "</p>" * 100_000, "<li><ul>" + "<div>" * 50_000 + "<li></li>" * 50_000, '<a x=">" ' * 100_000, "<!" * 300_000, "<!-- " * 200_000,
    "<" * 500_000, "</" * 300_000, "<a '\"'" * 100_000, "<select>" * 100_000 + "x", "&" * 300_000, "<p>" * 100_000 + "<b>" * 100_000, "<td>" * 60_000,
])
def test_hostile_pages_take_linear_time(page):
    import time

    begin = time.time()
    H.main_text(page, frozenset())
    assert time.time() - begin < 10


def test_deep_pages(spark):
    deep = "<div>" * 5000 + "<p>bottom of it" + "</div>" * 5000
    assert [r["text"] for r in H.extract_main_text(spark.createDataFrame([(1, "u", deep)], "page_id long, url string, html string")).collect()] == ["bottom of it"]


def test_no_pages(spark):
    assert H.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_copies_are_no_template(spark, prose):
    page = lambda k: f"<html><body><div class='x'><p>{prose(20, k)}</p></div><div class='y'>same on all</div></body></html>"
    rows = [(k, "http://copies.example/", page(0)) for k in range(300)] + [(1000 + k, "http://copies.example/", page(k)) for k in range(1, 12)]
    rows += [(2000 + k, f"http://mirror{k}.example/", page(500)) for k in range(100)]
    out = {r["page_id"]: r["text"] for r in H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == len(rows)
    for k in (*range(300), *range(1001, 1012)):
        assert out[k] == prose(20, k - 1000 if k > 1000 else 0)
    for k in range(2000, 2100):
        assert prose(20, 500) in out[k]


@pytest.mark.parametrize("m", [100, 100_000])
def test_one_layout_on_small_and_large_hosts(spark, m):
    import math

    names = [c.split()[0] for c in H.SUMS.split(", ")]
    node = lambda key, share, words, each: dict(zip(names, (1, key, 0, 0.0, float(m), share * m, 0.1 * m, 0.0, words, words * math.log(each), m, m * math.log(m / 4)), strict=True))
    # prose draws on ever new words, a menu on 300 and a notice on 10
    rows = [node(1, 0.8, 30 * m, 2), node(2, 0.05, 300, max(1, 6 * m / 300)), node(3, 0.15, 10, m)]
    sums = spark.createDataFrame(rows, H.SUMS)
    assert {r["node"] for r in H.low_nodes(H.importances(sums)).collect()} == {2, 3}


def test_words_alone_do_not_drop_articles(spark, prose):
    wraps = ["<div id='content-sidebar-wrap'>{}</div>", "<div class='layout has-sidebar'>{}</div>", "<div class='page with-header'>{}</div>", "<main class='social'>{}</main>"]
    inner = ["<article class='post comments-open'><p>{a}</p></article>", "<article><p>{a}</p><div class='social-history'>{b}</div></article>", "<h1>{a}</h1><p>{b}</p>", "<p>{a}</p><p>{b}</p>"]
    side = "<div class='ad'>{}</div><div class='sidebar'><p>{}</p></div><section id='comments'><article class='comment'><p>{}</p></article></section>"
    rows = []
    for k in range(64):
        a, b = prose(60, k), prose(12, 100 + k)
        page = wraps[k % 4].format(inner[k // 4 % 4].format(a=a, b=b)) + side.format(prose(5, 200 + k), "same links", prose(5, 300 + k))
        rows.append((k, "http://w.example/", f"<html><body>{page}</body></html>", a if k // 4 % 4 == 0 else f"{a} {b}"))
    found = H.extract_main_text(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in found} == {r[0]: r[3] for r in rows}


def test_texts_are_stored_and_read_back_in_one_worker(spark):
    from docloom.llm import tiff

    df = spark.createDataFrame([(1, "a"), (2, None), (None, "b" * 20_000), (3, ""), (1, "é€ " * 300), (4, "\U0001f600")], "doc_id long, text string")
    once, twice = tiff.stored_digests(df), tiff.media_digests(tiff.store_texts(df))
    assert once.schema == twice.schema
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)
    plan = tiff.op2_tiff(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
