import pytest

from docloom.functions.geometry import A4
from docloom.functions.text import CORRUPT, ENCRYPTED
from docloom.sources import assembly, pdf, security, writers

KEY, PLAIN, CLOSED = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff"), "69c4e0d86a7b0430d8cdb78070b4c55a"


def test_ciphers_by_published_examples():
    assert security.aes_encrypt(KEY, PLAIN, bytes(16))[16:32].hex() == CLOSED
    assert security.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 1000])
def test_round_trips(n):
    data = bytes(k * 7 % 256 for k in range(n))
    assert security.aes_decrypt(KEY, security.aes_encrypt(KEY, data)) == data
    assert security.rc4(KEY, security.rc4(KEY, data)) == data


def file_of(text):
    return writers.pdf_file([[{"what": "text", "x": 72.0, "y": 700.0, "w": 50.0, "h": 11.0, "text": text, "face": "Helvetica", "size": 11.0, "href": None}]], A4, title="A (title)")


def shown(read):
    return [[t[0] for t in page[3]] for page in read[2]]


def test_passwords(spark):
    plain = file_of("a secret")
    rows = [(1, plain, "kite", None, None), (2, plain, "kite", "owl", None), (3, b"broken", "kite", None, None)]
    made = {r["doc_id"]: r for r in assembly.protect_pdfs(spark.createDataFrame(rows, "doc_id int, content binary, user_password string, owner_password string, password string")).collect()}
    assert made[3]["error"] == CORRUPT
    one, two = bytes(made[1]["data"]), bytes(made[2]["data"])
    assert b"secret" not in one and b"title" not in one and pdf.read(one)[:2] == ("encrypted", ENCRYPTED)
    assert shown(pdf.read(one, "kite")) == shown(pdf.read(two, "owl")) == shown(pdf.read(two, "kite")) == [["a secret"]]
    # a known password, then up to three tries; a null try means that nobody gave one
    assert pdf.read(one, "x")[0] == "encrypted"
    assert pdf.read(one, "x", [])[1] == pdf.WRONG_PASSWORD
    assert pdf.read(one, None, ["a", "b", "kite"])[0] == "ok"
    assert pdf.read(one, None, ["a", "b", "c", "kite"])[1] == pdf.WRONG_PASSWORD
    assert pdf.read(one, None, ["a", None, "kite"])[0] == "cancelled"
    table = spark.createDataFrame([(1, one, "kite", None), (2, one, None, ["q"]), (3, one, None, None)], "source_id int, content binary, password string, tries array<string>")
    assert {r["source_id"]: (r["page_no"], r["status"], r["message"]) for r in pdf.pdf_pages(table).collect()} == {1: (1, "ok", None), 2: (0, "encrypted", pdf.WRONG_PASSWORD), 3: (0, "encrypted", ENCRYPTED)}
    back = {r["doc_id"]: r for r in assembly.unlock_pdfs(spark.createDataFrame([(1, two, "owl"), (2, two, "no"), (3, plain, "any")], "doc_id int, content binary, password string")).collect()}
    assert shown(pdf.read(bytes(back[1]["data"]))) == shown(pdf.read(bytes(back[3]["data"]))) == [["a secret"]]
    assert back[2]["error"] == pdf.WRONG_PASSWORD
    assert b"A (title)" in pdf.Document(bytes(back[1]["data"])).value(int(pdf.Document(bytes(back[1]["data"])).trailer["Info"])).values()


@pytest.mark.parametrize("revision, length", [(2, 5), (3, 16)])
def test_older_files_open(revision, length):
    doc = pdf.Document(file_of("old words"))
    handler = security.Handler(revision, length, b"", b"", -44, b"0123456789abcdef", False)
    own = handler.owner_key("boss")
    handler.owner = security.rc4(own, security.padded("me")) if revision == 2 else security.repeated_rc4(own, security.padded("me"), range(20))
    handler.key = handler.key_of(security.padded("me"))
    handler.user = handler.user_entry(handler.key)
    data = assembly.rewritten(doc, handler)
    data = data.replace(b"/V 4 /R 4 /Length 128", b"/V %d /R %d /Length %d" % (1 if revision == 2 else 2, revision, 8 * length))
    assert pdf.read(data)[0] == "encrypted"
    assert shown(pdf.read(data, "me")) == shown(pdf.read(data, "boss")) == [["old words"]]
