import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.operators.html import parse_html
from docloom.operators.markdown import parse_markdown
from docloom.operators.textblocks import parse_text, text_to_blocks


def kinds(blocks):
    return [b[0] for b in blocks]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("* oak\n* elm\n• ash\n+ fir", ["listItem"] * 4), ("Rain fell on the hills\nall night, and the river\nrose by a foot.", ["paragraph"]), ("OPENING HOURS\n\nNine to five.", ["heading", "paragraph"]),
        ("NO ENTRY\nKEEP THE DOOR SHUT\nRING TWICE", ["paragraph"]), ("We met at noon.", ["paragraph"]), ("> so she said", ["blockquote"]), ("one\n\n---\n\ntwo\n\n___", ["paragraph", "hr", "paragraph", "hr"]),
        ("    while True: pass", ["code"]), ("What to bring:\nboots", ["heading", "paragraph"]), ("A: b: c", ["paragraph"]), ("1. once\n\n    x = 1\n\n> y", ["listItem", "code", "blockquote"]), ("", []), ("\n \n", []),
    ],
)
def test_text_kinds(text, expected):
    assert kinds(parse_text(text)) == expected


def test_text_details():
    assert parse_text("Rain fell on the hills\nall night, and the river\nrose by a foot.")[0][5] == "Rain fell on the hills all night, and the river rose by a foot."
    assert [b[3] for b in parse_text("4. mix\n(5) bake\n6) cool")] == [4, 5, 6]
    assert [b[4] for b in parse_text("* box\n  * lid\n  * key\n* bag")] == [0, 1, 1, 0]
    assert [b[4] for b in parse_text("- a\n    - b\n  - c")] == [0, 1, 1]
    assert parse_text("    while ready:\n    go()")[0][5] == "while ready:\ngo()"
    assert kinds(parse_text("    a\n\n    b\n\n\n    c")) == ["code", "code"]
    assert parse_text("Field notes\n===========")[0][:2] == ("heading", 1)
    assert parse_text("* pond\n---")[0] == ("heading", 2, None, None, None, "* pond")
    assert parse_text("> first half\n> second half")[0][5] == "first half second half"
    assert parse_text("a\r\nb\rc")[0][5] == "a b c"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab A:.-*>#=1)\t \n"), max_size=60))
def test_text_never_fails_and_keeps_letters(text):
    blocks = parse_text(text)
    assert all(b[5] or b[0] in ("hr", "listItem") for b in blocks)
    assert sum(c == "b" for c in text) == sum((b[5] or "").count("b") for b in blocks)


def test_markdown():
    blocks = parse_markdown("# T *x*\n\npara **bold `c`** [l](http://a) ~~d~~\nnext\n\n- a\n- b\n  - c\n\n3. x\n4. y\n\n> q\n> r\n\n| a | b |\n|---|---|\n| 1 |\n\n```py\ncode\n```\n---\nTitle\n===\n<div>raw</div>")
    assert kinds(blocks) == ["heading", "paragraph", *["listItem"] * 5, "blockquote", "table", "code", "hr", "heading", "paragraph"]
    runs = blocks[1][7]
    assert [(r["text"], r["bold"], r["code"], r["href"]) for r in runs][:4] == [("para ", False, False, None), ("bold ", True, False, None), ("c", True, True, None), (" ", False, False, None)]
    assert [(b[2], b[3], b[4]) for b in blocks[2:7]] == [(False, 1, 0), (False, 2, 0), (False, 1, 1), (True, 3, 0), (True, 4, 0)]
    assert blocks[8][8:] == (["a", "b"], [["1", ""]])
    assert blocks[9][5:7] == ("code", "py")
    assert parse_markdown("> - a\n> ```\n> x\n> ```")[0][5] == "a"
    assert parse_markdown("![pic](x.png) &amp;lt;")[0][5] == "[pic] <"


def test_html():
    page = "<body><h5>T</h5><p>a&amp;b <b>c<p>d</b> e<ul start=0><li>x<ul><li>y</ul><li> <li>z</ul><pre><code class='language-js'>\nq\n</code></pre><table><thead><tr><th>h<tbody><tr><td>1<tr><td> </table><hr><figure><img src=i.png><figcaption> cap </figcaption></figure><div>in <i>line</i></div>loose<script>var a='<p>no</p>'</script>"
    blocks = parse_html(page)
    assert kinds(blocks) == ["heading", "paragraph", "paragraph", "listItem", "listItem", "listItem", "code", "table", "hr", "image", "paragraph", "paragraph"]
    assert blocks[0][1] == 3
    assert [(r["text"], r["bold"]) for r in blocks[2][8]] == [("d", True), (" e", False)]
    assert [(b[3], b[4], b[5]) for b in blocks[3:6]] == [(1, 0, "x"), (1, 1, "y"), (3, 0, "z")]
    assert blocks[6][5:7] == ("q", "js")
    assert blocks[7][9:] == (["h"], [["1"]])
    assert blocks[9][5] == "cap" and blocks[9][7] == "i.png"
    assert blocks[11][5] == "loose"


def test_html_reopens_formatting():
    blocks = parse_html("<div><p><b>one<br><p>two</div><footer>three</footer>")
    assert [[(r["text"], r["bold"]) for r in b[8]] for b in blocks] == [[("one", True)], [("two", True)], [("three", True)]]


def test_blocks_of_rows(spark):
    df = spark.createDataFrame([(1, "a\n\nb"), (2, None), (3, ""), (1, "a\n\nb")], "doc_id long, text string")
    rows = sorted((r["doc_id"], r["ord"], r["text"]) for r in text_to_blocks(df).collect())
    assert rows == [(1, 0, "a"), (1, 0, "a"), (1, 1, "b"), (1, 1, "b")]


@pytest.mark.parametrize("page", ["<div>" * 30_000 + "x", "<ul><li>" * 3000 + "x", '<a "' * 50_000, '<p x="' * 50_000, "<p>" * 5000 + "<b>" * 5000 + "<p>x" * 500, "<table><tr><td>" * 1000 + "x", "<!" * 50_000, '<i title=">" ' * 20_000])
def test_hostile_html_is_read_in_time(page):
    import time

    began = time.time()
    blocks = parse_html(page)
    assert time.time() - began < 10
    assert "x" not in page or "x" in str(blocks)


@pytest.mark.parametrize("text", [">" * 3000 + " x", "- " * 2000 + "x", "**a _b " * 200 + "x" + " b_ a**" * 200, "> - " * 500 + "x"])
def test_deep_markdown_keeps_its_text(text):
    assert "x" in "".join(b[5] or "" for b in parse_markdown(text))


def test_titles_that_are_cut_within_a_reference():
    page = "<body><h1>x &lt; y &#39;&amp;amp;&amp</h1>"
    assert parse_html(page)[0][5] == "x < y '&amp;&"  # as browsers read it
    assert parse_html(page, closed_references=True)[0][5] == "x < y '&amp;&amp"
    assert parse_html("<p>&ampx; &unknown; &</p>", closed_references=True)[0][5] == "&ampx; &unknown; &"


def test_html_headings_equal_their_sql_where_titles_are_cut(spark, tmp_path):
    import duckdb

    from docloom.plans import catalog

    pages = [(1, "<html><body><h1> a &amp; b&amp</h1><p>t</p></body></html>"), (2, "<html><body><h1>&quot;q&quot; &lt;</h1></body></html>")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted(tuple(r) for r in catalog.QUERIES["html_headings"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert found == sorted(c.sql(catalog.ORACLE_SQL["html_headings"]).fetchall()) == [(1, "a & b&amp"), (2, '"q" <')]
