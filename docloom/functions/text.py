"""String functions over columns; no Python runs on the executors.

White space follows the ECMAScript class (with no-break spaces and the byte-order
mark), and line ends are matched with \\z, as Java's $ stops before a last line feed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the ECMAScript standard; characters of code page 1252.
SPACE = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
CP1252_EXTRA = "ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™"
NOT_WINANSI = rf"[^\x20-\x7e\x{{a0}}-\x{{ff}}{CP1252_EXTRA}]"
CONTROL = r"[\x00-\x08\x0b-\x1f\x7f]"
BULLET = rf"^(?:[•\-–▪◦·*]|\d{{1,3}}[.)])[{SPACE}]+"

#: Messages that users see.
EMPTY_RANGE = 'Enter at least one page or range, like "1-3, 5".'
BELOW_ONE = "Page numbers start at 1."
ENCRYPTED = "This PDF is password-protected."
WRONG_PASSWORD = "Wrong password — this PDF stays locked."
CORRUPT = "This file couldn't be read as a PDF — it may be corrupted."
CANCELLED = "Cancelled."
UNKNOWN_ERROR = "Something went wrong while processing the PDF."


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), rf"^[{SPACE}]+", ""), rf"[{SPACE}]+\z", "")


def collapse(c: Column | str) -> Column:
    """Each run of white space as one blank."""
    return F.regexp_replace(col(c), rf"[{SPACE}]+", " ")


def tidy(c: Column | str) -> Column:
    return F.trim(collapse(c))


def is_blank(c: Column | str) -> Column:
    return ~col(c).rlike(rf"[^{SPACE}]")


def units(c: Column | str) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.char_length(col(c)) + F.char_length(F.regexp_replace(col(c), r"[^\x{10000}-\x{10ffff}]", ""))


def strip_ext(name: Column | str) -> Column:
    return F.regexp_replace(col(name), r"(?i)\.[a-z0-9]+\z", "")


def suffixed_name(name: Column | str, suffix: str, ext: str = "pdf") -> Column:
    return F.concat(strip_ext(name), F.lit(f"{suffix}.{ext}"))


def numbered_name(name: Column | str, nth: Column) -> Column:
    """The nth file of a name: the second becomes `base (2).ext`."""
    name = col(name)
    base, ext = F.regexp_extract(name, r"(?s)^(.+)(\.[^.]*)\z", 1), F.regexp_extract(name, r"(?s)^(.+)(\.[^.]*)\z", 2)
    mark = F.concat(F.lit(" ("), nth.cast("string"), F.lit(")"))
    return F.when(nth <= 1, name).when(base != "", F.concat(base, mark, ext)).otherwise(F.concat(name, mark))


def detect_script(text: Column | str) -> Column:
    """devanagari or arabic by the first character of either, else latin."""
    found = F.regexp_extract(col(text), r"[\x{600}-\x{6ff}\x{750}-\x{77f}\x{900}-\x{97f}]", 0)
    return F.when(found.rlike(r"[\x{900}-\x{97f}]"), "devanagari").when(found != "", "arabic").otherwise("latin")


def needed_fonts(texts: Column) -> Column:
    """Distinct scripts of an array of texts, in order of appearance."""
    return F.array_distinct(F.transform(texts, detect_script))


def css_color(value: Column | str) -> Column:
    """rgb() and rgba() as #rrggbb; null for others and for alpha below one half."""
    value = col(value)
    pattern = r"^rgba?\((\d+),\s*(\d+),\s*(\d+)(?:,\s*([\d.]+))?\)"
    part = lambda k: F.regexp_extract(value, pattern, k)
    channel = lambda k: F.lower(F.lpad(F.hex(part(k).cast("long")), 2, "0"))
    alpha = F.nullif(part(4), F.lit("")).try_cast("double")
    return F.when(part(1) == "", F.lit(None)).when(alpha < 0.5, F.lit(None)).otherwise(F.concat(F.lit("#"), channel(1), channel(2), channel(3)))


def hex_channels(value: Column | str) -> Column:
    """#rrggbb as a struct of red, green, blue between 0 and 1; null for others."""
    value = col(value)
    channel = lambda at: F.conv(F.substring(value, at, 2), 16, 10).cast("double") / 255.0
    return F.when(value.rlike(r"(?i)^#[0-9a-f]{6}\z"), F.struct(channel(2).alias("r"), channel(4).alias("g"), channel(6).alias("b")))


def unescape_markdown(text: Column | str) -> Column:
    """Ampersands first, so that a doubly escaped sign is unescaped twice."""
    out = col(text)
    for name, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def strip_tags(text: Column | str) -> Column:
    return tidy(F.regexp_replace(col(text), "<[^>]+>", " "))


def has_non_winansi(text: Column | str) -> Column:
    return col(text).rlike(NOT_WINANSI)


def strip_control(text: Column | str) -> Column:
    return F.regexp_replace(col(text), CONTROL, "")


def clean_inline(text: Column | str) -> Column:
    return F.regexp_replace(strip_control(text), r"\r?\n", " ")


def clean_degraded(text: Column | str) -> Column:
    """What code page 1252 can't show becomes a question mark for each UTF-16 unit."""
    wide = F.regexp_replace(clean_inline(text), r"[\x{10000}-\x{10ffff}]", "??")
    return F.regexp_replace(wide, NOT_WINANSI, "?")


def is_encrypted_error(name: Column | str, message: Column | str) -> Column:
    return F.concat_ws(" ", col(name), col(message)).rlike("(?i)encrypt|password")


def friendly_error(kind: Column | str, message: Column | str) -> Column:
    """kind: encrypted, corrupt, cancelled or other."""
    kind, message = col(kind), F.nullif(col(message), F.lit(""))
    return (
        F.when(kind == "cancelled", "")
        .when(kind == "encrypted", F.coalesce(message, F.lit(ENCRYPTED)))
        .when(kind == "corrupt", F.coalesce(message, F.lit(CORRUPT)))
        .otherwise(F.coalesce(message, F.lit(UNKNOWN_ERROR)))
    )


def cell_number(text: Column | str) -> Column:
    """The number that a table cell holds, or null."""
    return F.when(trim(text).rlike(r"^-?\d+(\.\d+)?\z"), trim(text).try_cast("double"))


def join_lines(before: Column | str, after: Column | str) -> Column:
    """Joins two lines of prose; a hyphen between letters is a break, not a sign."""
    before, after = col(before), col(after)
    hyphen = before.rlike(r"[A-Za-z]-\z") & after.rlike(r"^[a-z]")
    return F.when(hyphen, F.concat(F.substring(before, F.lit(1), F.char_length(before) - 1), after)).otherwise(F.concat(before, F.lit(" "), after))


def is_bullet(text: Column | str) -> Column:
    return col(text).rlike(BULLET)


def strip_bullet(text: Column | str) -> Column:
    return F.regexp_replace(col(text), BULLET, "")


def ends_sentence(text: Column | str) -> Column:
    return col(text).rlike(r"""[.!?:;]["')\]]?\z""")


def language_of_class(value: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(value), r"language-(\w+)", 1), F.lit(""))


def is_caps_heading(line: Column | str) -> Column:
    """2 to 80 characters, two ASCII letters or more, all upper case, no sentence end."""
    t = trim(line)
    letters = F.regexp_replace(t, "[^A-Za-z]", "")
    return units(t).between(2, 80) & ~t.rlike(r"[.!?]\z") & (F.length(letters) >= 2) & (letters == F.upper(letters))


def is_label_heading(line: Column | str) -> Column:
    """A short line that ends in its only colon."""
    t = trim(line)
    words = F.size(F.split(t, rf"[{SPACE}]+"))
    return t.rlike(r":\z") & (units(t) <= 60) & (words <= 8) & (F.char_length(F.regexp_replace(t, "[^:]", "")) == 1)


def page_range_error(spec: Column | str, pages: Column | str) -> Column:
    """Null for a good range expression, else what is wrong with its first bad part."""
    return _ranges(spec, pages)["error"]


def page_ranges(spec: Column | str, pages: Column | str) -> Column:
    """Sorted distinct page numbers of an expression like `1-3, 5`; null for a bad one."""
    return _ranges(spec, pages)["pages"]


def _ranges(spec: Column | str, pages: Column | str) -> Column:
    n = col(pages).cast("int")
    parts = F.filter(F.transform(F.split(trim(spec), "[,;]+"), lambda t: trim(t)), lambda t: t != "")

    def parsed(t: Column) -> Column:
        single, both = rf"^(\d+)\z", rf"^(\d+)?[{SPACE}]*-[{SPACE}]*(\d+)?\z"
        given = lambda p, k: F.nullif(F.regexp_extract(t, p, k), F.lit(""))
        number = lambda p, k: F.when(given(p, k).isNotNull(), F.coalesce(given(p, k).try_cast("long"), F.lit((1 << 63) - 1)))  # noqa: E731  a longer number is out of any range
        is_single = t.rlike(single)
        low = F.when(is_single, number(single, 1)).otherwise(F.coalesce(number(both, 1), F.lit(1)))
        high = F.when(is_single, number(single, 1)).otherwise(F.coalesce(number(both, 2), n.cast("long")))
        quoted = F.concat(F.lit('"'), t, F.lit('"'))
        error = (
            F.when(~is_single & ~t.rlike(both), F.concat(quoted, F.lit(" isn't a page or range — use numbers like \"3\" or \"2-5\".")))
            .when((low < 1) | (high < 1), BELOW_ONE)
            .when((low > n) | (high > n), F.concat(F.lit("This PDF only has "), n.cast("string"), F.when(n == 1, " page").otherwise(" pages"), F.lit(" — "), quoted, F.lit(" is out of range.")))
            .when(low > high, F.concat(quoted, F.lit(" is backwards — put the smaller page first.")))
        )
        return F.struct(low.alias("low"), high.alias("high"), error.alias("error"))

    tokens = F.transform(parts, parsed)
    error = F.when(F.size(parts) == 0, EMPTY_RANGE).otherwise(F.get(F.filter(F.transform(tokens, lambda x: x["error"]), lambda e: e.isNotNull()), F.lit(0)))
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(tokens, lambda x: x["error"].isNull()), lambda x: F.sequence(x["low"], x["high"]).cast("array<int>")))))
    return F.struct(F.when(error.isNull(), numbers).alias("pages"), error.alias("error"))
