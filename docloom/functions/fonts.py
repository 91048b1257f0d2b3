"""Font faces, glyph widths and script fonts.

Widths of the fixed-pitch face are exact (600 units).  The sans faces carry the
advance widths of the standard fonts for printable ASCII and for accented letters;
other characters take MEAN_WIDTH.  Further metrics can be registered by name.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Advance widths of the standard sans face for U+0020 to U+007E, in 1/1000 em.
SANS = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]
#: The same of the bold face.
SANS_BOLD = [
    278, 333, 474, 556, 556, 889, 722, 238, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 333, 333, 584, 584, 584, 611,
    975, 722, 722, 722, 722, 667, 611, 778, 722, 278, 556, 722, 611, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 333, 278, 333, 584, 556,
    333, 556, 611, 556, 611, 556, 333, 611, 611, 278, 278, 556, 278, 889, 611, 611, 611, 611, 389, 556, 333, 611, 556, 778, 556, 556, 500, 389, 280, 389, 584,
]
MONO_WIDTH, MEAN_WIDTH = 600, 556
SCRIPT_FONTS = {"latin": "NotoSans-Regular", "arabic": "NotoNaskhArabic-Regular", "devanagari": "NotoSansDevanagari-Regular"}
FACES = {(False, False): "Helvetica", (True, False): "Helvetica-Bold", (False, True): "Helvetica-Oblique", (True, True): "Helvetica-BoldOblique"}
MONO = "Courier"

_metrics: dict[str, dict[str, int]] = {}


def register_metrics(face: str, widths: dict[str, int]) -> None:
    """Widths in 1/1000 em by character for a face; registering again replaces them."""
    _metrics[face] = dict(widths)


def face_of(bold: bool, italic: bool, code: bool) -> str:
    return MONO if code else FACES[bool(bold), bool(italic)]


def text_width(text: str, face: str, size: float) -> float:
    if face == MONO:
        return len(text) * MONO_WIDTH * size / 1000
    own = _metrics.get(face)
    if own:
        return sum(own.get(c, MEAN_WIDTH) for c in text) * size / 1000
    widths = SANS_BOLD if "Bold" in face else SANS
    return sum(glyph_width(c, widths) for c in text) * size / 1000


def glyph_width(c: str, widths: list[int]) -> int:
    """Accented letters are as wide as their base."""
    base = c if c < "\x7f" else unicodedata.normalize("NFD", c)[0]
    return widths[ord(base) - 32] if 32 <= ord(base) < 127 else MEAN_WIDTH


def is_registered(face: str) -> bool:
    return face in _metrics


def mono_width(text: Column, size: float) -> Column:
    return F.char_length(text) * F.lit(MONO_WIDTH * size / 1000)


def digits_width(text: Column, size: float) -> Column:
    """Width in the sans face of texts of digits, blanks and slashes, as page numbers are."""
    digits = F.char_length(F.regexp_replace(text, "[^0-9]", ""))
    return (digits * SANS[16] + (F.char_length(text) - digits) * SANS[0]) * F.lit(size) / 1000


def ocr_font(text: Column) -> Column:
    """The face that an invisible word gets."""
    from docloom.functions.text import detect_script

    script = detect_script(text)
    other = F.when(script == "arabic", SCRIPT_FONTS["arabic"]).otherwise(SCRIPT_FONTS["devanagari"])
    return F.when(script != "latin", other).when(text.rlike(r"[^\x{0}-\x{ff}]"), SCRIPT_FONTS["latin"]).otherwise("Helvetica")


def words_and_spaces(text: str) -> list[str]:
    return re.findall(r"\s+|\S+", text)
