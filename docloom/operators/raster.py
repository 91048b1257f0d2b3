"""Raster clean-up: skew, levels and gray, over pixel rows and over whole images.

The pixel form (img_id, x, y, r, g, b) is plain DataFrame code; the image form keeps
each raster as bytes and works in Arrow batches with numpy, one image at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.geometry import SKEW_LIMIT, SKEW_STEP, luma, shear_row, stretched

#: Ink threshold, clip share, least gain of a skew, analysis width.
INK, CLIP, GAIN, ANALYSIS_WIDTH = 0.85, 0.01, 1.02, 700


def gray_pixels(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("gray", luma(F.col("r"), F.col("g"), F.col("b")))


def gray_histogram(pixels: DataFrame) -> DataFrame:
    return gray_pixels(pixels).groupBy("img_id", "gray").agg(F.count("*").alias("n"))


def level_bounds(pixels: DataFrame) -> DataFrame:
    """Lowest and highest gray with more than the clip share of pixels at or beyond it."""
    hist = gray_histogram(pixels)
    total = F.sum("n").over(Window.partitionBy("img_id"))
    up, down = Window.partitionBy("img_id").orderBy("gray"), Window.partitionBy("img_id").orderBy(F.desc("gray"))
    summed = hist.select("img_id", "gray", (F.sum("n").over(up) > total * CLIP).alias("low_ok"), (F.sum("n").over(down) > total * CLIP).alias("high_ok"))
    return summed.groupBy("img_id").agg(F.min(F.when(F.col("low_ok"), F.col("gray"))).alias("low"), F.max(F.when(F.col("high_ok"), F.col("gray"))).alias("high"))


def auto_levels(pixels: DataFrame) -> DataFrame:
    """Channels stretched between the bounds; an image without contrast stays as it is."""
    joined = pixels.join(level_bounds(pixels), "img_id")
    wide = F.col("high") > F.col("low")
    return joined.select("img_id", "x", "y", *[F.when(wide, stretched(F.col(c), F.col("low"), F.when(wide, F.col("high")).otherwise(F.col("low") + 1))).otherwise(F.col(c)).cast("int").alias(c) for c in "rgb"])


def ink_pixels(pixels: DataFrame) -> DataFrame:
    gray = gray_pixels(pixels)
    mean = gray.groupBy("img_id").agg(F.avg("gray").alias("mean"))
    return gray.join(mean, "img_id").where(F.col("gray") < F.col("mean") * INK).select("img_id", "x", "y")


def skew_profile(pixels: DataFrame) -> DataFrame:
    """Variance of the ink per sheared row at each candidate angle; empty rows count."""
    size = pixels.groupBy("img_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    steps = int(round(2 * SKEW_LIMIT / SKEW_STEP))
    angles = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: k * SKEW_STEP - SKEW_LIMIT)
    sheared = ink_pixels(pixels).join(size, "img_id").withColumn("angle", F.explode(angles))
    rows = sheared.withColumn("row", shear_row(F.col("x"), F.col("y"), F.col("angle"), F.col("w")))
    counts = rows.groupBy("img_id", "angle", "row").agg(F.count("*").alias("c"), F.first("w").alias("w"), F.first("h").alias("h"))
    n_rows = F.first("h") + 2 * (F.ceil(F.first("w") * F.tan(F.radians(F.lit(SKEW_LIMIT)))) + 2)
    return counts.groupBy("img_id", "angle").agg((F.sum(F.col("c") * F.col("c")) / n_rows - F.pow(F.sum("c") / n_rows, 2)).alias("variance"))


def estimated_skew(pixels: DataFrame) -> DataFrame:
    """Angle of the greatest variance; smaller angles win ties, and zero stays unless the gain is clear."""
    profile = skew_profile(pixels)
    best = profile.groupBy("img_id").agg(F.max_by("angle", F.struct("variance", -F.abs("angle"), -F.col("angle"))).alias("angle"), F.max("variance").alias("top"), F.max(F.when(F.col("angle") == 0, F.col("variance"))).alias("zero"))
    chosen = best.select("img_id", F.when(F.col("top") >= F.col("zero") * GAIN, F.col("angle")).otherwise(0.0).alias("angle"))
    every = pixels.select("img_id").distinct()
    return every.join(chosen, "img_id", "left").withColumn("angle", F.coalesce("angle", F.lit(0.0)))


# whole images ----------------------------------------------------------------


def luma_of(rgb: np.ndarray) -> np.ndarray:
    v = rgb.astype(np.uint32)
    return (77 * v[..., 0] + 151 * v[..., 1] + 28 * v[..., 2]) >> 8


def skew_of(rgb: np.ndarray) -> float:
    step = max(1, -(-rgb.shape[1] // ANALYSIS_WIDTH))
    gray = luma_of(rgb[::step, ::step])
    ys, xs = np.nonzero(gray < gray.mean() * INK)
    h, w = gray.shape
    if not 0 < len(ys) < gray.size:
        return 0.0
    shift = int(np.ceil(w * np.tan(np.radians(SKEW_LIMIT)))) + 2
    found = []
    for k in range(int(round(2 * SKEW_LIMIT / SKEW_STEP)) + 1):
        angle = k * SKEW_STEP - SKEW_LIMIT
        rows = np.floor(ys - xs * np.tan(np.radians(angle)) + shift + 0.5).astype(np.int64)
        found.append((np.bincount(np.clip(rows, 0, h + 2 * shift - 1), minlength=h + 2 * shift).var(), -abs(angle), -angle, angle))
    zero = next(v for v, _, _, a in found if a == 0)
    best = max(found)
    return best[3] if best[0] >= zero * GAIN else 0.0


def levelled(rgb: np.ndarray) -> np.ndarray:
    hist = np.bincount(luma_of(rgb).ravel(), minlength=256)
    clip = rgb.shape[0] * rgb.shape[1] * CLIP
    low = int(np.argmax(np.cumsum(hist) > clip))
    high = 255 - int(np.argmax(np.cumsum(hist[::-1]) > clip))
    if high <= low:
        return rgb
    table = np.clip(np.rint((np.arange(256) - low) * 255.0 / (high - low)), 0, 255).astype(np.uint8)
    return table[rgb]


def straightened(rgb: np.ndarray, angle: float) -> np.ndarray:
    """Turned by minus the angle about the middle onto white, to the nearest sample."""
    h, w = rgb.shape[:2]
    a = np.radians(angle)
    y, x = np.mgrid[0:h, 0:w]
    dx, dy = x - (w - 1) / 2, y - (h - 1) / 2
    sx = np.rint(dx * np.cos(a) - dy * np.sin(a) + (w - 1) / 2).astype(int)
    sy = np.rint(dx * np.sin(a) + dy * np.cos(a) + (h - 1) / 2).astype(int)
    ok = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full_like(rgb, 255)
    out[ok] = rgb[sy[ok], sx[ok]]
    return out


def cleaned(rgb: np.ndarray, deskew: bool, enhance: bool, grayscale: bool) -> tuple[np.ndarray, float]:
    angle = skew_of(rgb) if deskew else 0.0
    if angle:
        rgb = straightened(rgb, angle)
    if enhance:
        rgb = levelled(rgb)
    if grayscale:
        rgb = np.repeat(luma_of(rgb).astype(np.uint8)[..., None], 3, axis=2)
    return rgb, angle


def clean_images(images: DataFrame, deskew: bool = True, enhance: bool = True, grayscale: bool = False) -> DataFrame:
    """img_id, width, height, pixels (RGB bytes), angle of images (img_id, width, height, pixels)."""
    kind = images.schema["img_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                w, h = batch.column("width")[k].as_py(), batch.column("height")[k].as_py()
                rgb = np.frombuffer(batch.column("pixels")[k].as_py(), np.uint8).reshape(h, w, 3)
                out, angle = cleaned(rgb, deskew, enhance, grayscale)
                yield pa.RecordBatch.from_arrays([batch.column("img_id").slice(k, 1), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([out.tobytes()], pa.binary()), pa.array([float(angle)])], ["img_id", "width", "height", "pixels", "angle"])

    return images.select("img_id", "width", "height", "pixels").mapInArrow(run, f"img_id {kind}, width int, height int, pixels binary, angle double")
