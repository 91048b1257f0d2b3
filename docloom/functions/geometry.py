"""Numbers and geometry over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Page sizes in points, points per pixel, deskew search.
A4 = (595.28, 841.89)
LETTER = (612.0, 792.0)
POINTS_PER_PIXEL = 0.75
SKEW_LIMIT, SKEW_STEP = 5.0, 0.25


def rotated(rotation: Column, delta: Column | int) -> Column:
    return F.pmod(rotation + delta, F.lit(360)).cast("int")


def half_up(x: Column) -> Column:
    """Rounds to a whole number, halves upwards."""
    return F.floor(x + 0.5)


def half_points(size: Column) -> Column:
    return half_up(size * 2) / 2


def hundredths(x: Column) -> Column:
    return half_up(x * 100) / 100


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def fit_scale(width: Column, height: Column, longest: Column | float) -> Column:
    return F.least(F.lit(1.0), (F.lit(longest) if isinstance(longest, (int, float)) else longest) / F.greatest(width, height))


def fitted(side: Column, scale: Column) -> Column:
    return F.greatest(F.lit(1), half_up(side * scale)).cast("int")


def progress(page: Column, pages: Column, start: float, span: float, part: Column) -> Column:
    """Per cent done when `part` of a stage of page number `page` (from 0) is over."""
    return F.least(F.lit(100), half_up((page + start + span * clamp(part, 0.0, 1.0)) / pages * 100)).cast("int")


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright((77 * r + 151 * g + 28 * b).cast("int"), 8)


def stretched(v: Column, low: Column, high: Column) -> Column:
    """Linear stretch of a level into 0..255, halves to even."""
    return clamp(F.bround((v - low) * 255.0 / (high - low)), 0.0, 255.0).cast("int")


def shear_row(x: Column, y: Column, angle: Column, width: Column) -> Column:
    shift = F.ceil(width * F.tan(F.radians(F.lit(SKEW_LIMIT)))) + 2
    return F.floor(y - x * F.tan(F.radians(angle)) + shift + 0.5)
