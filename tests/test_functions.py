import pytest
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "spec, n, pages, error",
    [
        ("17", 40, [17], None), ("12-14", 40, [12, 13, 14], None), ("38-", 40, [38, 39, 40], None), ("-2", 40, [1, 2], None), ("-", 3, [1, 2, 3], None),
        ("9;6-8,9,,7", 9, [6, 7, 8, 9], None), (" 2 - 4 ; 3", 6, [2, 3, 4], None), ("6-6", 6, [6], None), ("007", 8, [7], None), ("-\u00a05", 6, [1, 2, 3, 4, 5], None),
        ("20-13", 25, None, '"20-13" is backwards — put the smaller page first.'), ("26", 25, None, 'This PDF only has 25 pages — "26" is out of range.'),
        ("2", 1, None, 'This PDF only has 1 page — "2" is out of range.'), ("30-4", 25, None, 'This PDF only has 25 pages — "30-4" is out of range.'),
        ("99999999999999999999", 25, None, 'This PDF only has 25 pages — "99999999999999999999" is out of range.'), ("3-99999999999999999999", 25, None, 'This PDF only has 25 pages — "3-99999999999999999999" is out of range.'),
        ("all", 25, None, '"all" isn\'t a page or range — use numbers like "3" or "2-5".'), ("4 6", 25, None, '"4 6" isn\'t a page or range — use numbers like "3" or "2-5".'),
        (";,", 25, None, T.EMPTY_RANGE), ("  ", 25, None, T.EMPTY_RANGE), ("0-3", 25, None, T.BELOW_ONE), ("3, x, 0", 25, None, '"x" isn\'t a page or range — use numbers like "3" or "2-5".'),
    ],
)
def test_page_ranges(spark, spec, n, pages, error):
    row = spark.createDataFrame([(spec, n)], "s string, n int").select(T.page_ranges("s", "n").alias("p"), T.page_range_error("s", "n").alias("e")).first()
    assert (row["p"], row["e"]) == (pages, error)


def test_strings(spark):
    s = F.col("s")
    assert one(spark, T.trim("s"), s="\xa0\t x y﻿ ") == "x y"
    assert one(spark, T.tidy("s"), s=" a \nb ") == "a b"
    assert one(spark, T.units("s"), s="a\U0001f600") == 3
    assert one(spark, T.strip_ext("s"), s="x.tar.gz") == "x.tar"
    assert one(spark, T.suffixed_name("s", "-1"), s="x.PDF") == "x-1.pdf"
    assert one(spark, T.detect_script("s"), s="x ह ا") == "devanagari"
    assert one(spark, T.needed_fonts(F.array(F.lit("a"), F.lit("ا"), F.lit("b")))) == ["latin", "arabic"]
    assert one(spark, T.css_color("s"), s="rgba(255, 0, 16, 0.5)") == "#ff0010"
    assert one(spark, T.css_color("s"), s="rgba(255, 0, 16, 0.4)") is None
    assert one(spark, T.css_color("s"), s="red") is None
    assert one(spark, T.unescape_markdown("s"), s="&amp;lt;&#39;") == "<'"
    assert one(spark, T.clean_degraded("s"), s="a\x01→\U0001f600\n•") == "a??? •"
    assert one(spark, T.cell_number("s"), s=" 007 ") == 7.0
    assert one(spark, T.cell_number("s"), s="1,234") is None
    assert one(spark, T.join_lines(F.lit("exam-"), F.lit("ple"))) == "example"
    assert one(spark, T.join_lines(F.lit("exam-"), F.lit("Ple"))) == "exam- Ple"
    assert one(spark, T.ends_sentence(s), s='Yes!"') is True
    assert one(spark, T.is_caps_heading("s"), s="GOODS RETURNED") is True
    assert one(spark, T.is_caps_heading("s"), s="SEE BELOW.") is False
    assert one(spark, T.is_label_heading("s"), s="Open points:") is True
    assert one(spark, T.is_encrypted_error(F.lit("E"), s), s="no Password given") is True
    assert one(spark, T.friendly_error(F.lit("corrupt"), F.lit(None).cast("string"))) == T.CORRUPT
    assert one(spark, T.friendly_error(F.lit("cancelled"), s), s="x") == ""
    assert one(spark, T.language_of_class(s), s="hl language-py") == "py"


def test_geometry(spark):
    assert one(spark, G.rotated(F.lit(0), -90)) == 270
    assert one(spark, G.half_points(F.lit(10.25))) == 10.5
    assert one(spark, G.half_up(F.lit(-2.5))) == -2
    assert one(spark, G.stretched(F.lit(10), F.lit(0), F.lit(204))) == 12
    assert one(spark, G.luma(F.lit(255), F.lit(255), F.lit(255))) == 255
    assert one(spark, G.progress(F.lit(1), F.lit(2), 0.1, 0.05, F.lit(9.0))) == 58
