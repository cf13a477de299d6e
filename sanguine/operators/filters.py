"""Predicates over pixels, landmarks, signals and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A

SKIN_CLASSES = (1, 10)  # skin and nose of the face parsing


def visible(landmarks: DataFrame, limit: float = 0.5) -> DataFrame:
    """Landmarks whose visibility and presence, where given, reach the limit."""
    return landmarks.filter((F.coalesce("visibility", F.lit(1.0)) >= limit) & (F.coalesce("presence", F.lit(1.0)) >= limit))


def colour_gate(low: float = 55, high: float = 200, r: str = "r", g: str = "g", b: str = "b") -> Column:
    """False where all channels are at or below low, or all at or above high."""
    return ~((F.greatest(r, g, b) <= low) | (F.least(r, g, b) >= high))


def estimator_gate(windows: DataFrame, low: float = 75, high: float = 230) -> DataFrame:
    """Windows of estimators without a frame that has all channels below low or all above high (strictly). May be empty: callers count."""
    frames = F.arrays_zip("r", "g", "b")
    out = F.exists(frames, lambda x: (F.greatest(x["r"], x["g"], x["b"]) < low) | (F.least(x["r"], x["g"], x["b"]) > high))
    return windows.filter(~out)


def skin_classes(pixels: DataFrame, column: str = "parsing") -> DataFrame:
    return pixels.filter(F.col(column).isin(*SKIN_CLASSES))


def bounding_box(pixels: DataFrame, keys: tuple[str, ...] = ("video_id", "frame_idx")) -> DataFrame:
    """(keys, y0, y1, x0, x1) of the pixels that aren't black; -1 where there are none."""
    lit = F.greatest("r", "g", "b") > 0
    pick = lambda f, c: F.coalesce(f(F.when(lit, F.col(c))), F.lit(-1)).cast("int")
    return pixels.groupBy(*keys).agg(pick(F.min, "y").alias("y0"), pick(F.max, "y").alias("y1"), pick(F.min, "x").alias("x0"), pick(F.max, "x").alias("x1"))


def cropped(pixels: DataFrame, keys: tuple[str, ...] = ("video_id", "frame_idx"), inclusive: bool = True) -> DataFrame:
    """Pixels inside their frame's box, placed from its corner; without `inclusive` the last row and column go."""
    box = bounding_box(pixels, keys)
    end = 0 if inclusive else -1
    inside = F.col("y").between(F.col("y0"), F.col("y1") + end) & F.col("x").between(F.col("x0"), F.col("x1") + end)
    return pixels.join(box, list(keys)).filter(inside).withColumn("y", F.col("y") - F.col("y0")).withColumn("x", F.col("x") - F.col("x0")).drop("y0", "y1", "x0", "x1")


def valid_bvp(bvps: DataFrame, column: str = "bvp") -> DataFrame:
    """Signals without NaN or NULL."""
    return bvps.filter(~A.has_nan(F.col(column)))


def band(freqs: Column, low: float = 0.65, high: float = 4.0) -> Column:
    """low < f < high, in single precision."""
    f = freqs.cast("float")
    return (f > F.lit(low).cast("float")) & (f < F.lit(high).cast("float"))


def first_frames(frames: DataFrame, most: int) -> DataFrame:
    """The first `most` frames; 0 for all. Reaches the scan as a pushed filter."""
    return frames.filter(F.col("frame_idx") < most) if most else frames


def without_outliers(rows: DataFrame, columns: list[str], factor: float = 3.5) -> DataFrame:
    """Rows whose columns all lie within `factor` interquartile ranges of the quartiles; one row of quartiles is broadcast."""
    q = rows.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(f"__{c}") for c in columns])
    keep = F.lit(True)
    for c in columns:
        lo, hi = F.get(F.col(f"__{c}"), F.lit(0)), F.get(F.col(f"__{c}"), F.lit(1))
        keep = keep & F.col(c).between(lo - factor * (hi - lo), hi + factor * (hi - lo))
    return rows.crossJoin(F.broadcast(q)).filter(keep).drop(*[f"__{c}" for c in columns])


def quarantined(rows: DataFrame, parsed: str, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(readable rows, count of unreadable ones by key): nothing is dropped silently."""
    return rows.filter(F.col(parsed).isNotNull()), rows.filter(F.col(parsed).isNull()).groupBy(*keys).agg(F.count("*").alias("unreadable"))
