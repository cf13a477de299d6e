"""From pixels and landmarks to colour traces, and the interface of the image stage ahead of it."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import batches
from .filters import colour_gate


class SkinExtractor(Protocol):
    """A pluggable stage that turns decoded frames into skin pixels and landmarks; models aren't part of this package."""

    def pixels(self, frames: DataFrame) -> DataFrame: ...

    def landmarks(self, frames: DataFrame) -> DataFrame: ...


def to_rgb(pixels: DataFrame) -> DataFrame:
    """Frames decoded as (b, g, r) in columns c0, c1, c2."""
    return pixels.select("*", F.col("c2").alias("r"), F.col("c1").alias("g"), F.col("c0").alias("b")).drop("c0", "c1", "c2")


def to_pixels(landmarks: DataFrame, width: int, height: int) -> DataFrame:
    """Normalised places as pixel places (y, x), inside the image only."""
    inside = F.col("x").between(0.0, 1.0) & F.col("y").between(0.0, 1.0)
    place = lambda c, n: F.floor(F.least(F.col(c) * n, F.lit(float(n - 1)))).cast("int").alias(c)
    return landmarks.filter(inside).select(*[c for c in landmarks.columns if c not in "xy"], place("y", height), place("x", width))


def selected(landmarks: DataFrame, regions: DataFrame, region: str) -> DataFrame:
    """Landmarks of a named region; the dimension has at most the face mesh's 468 rows, so it is broadcast."""
    return landmarks.join(F.broadcast(regions.filter(F.col("region") == region).select("ldmk_id").distinct()), "ldmk_id")


def holistic(pixels: DataFrame, low: float = 55, high: float = 200, keys: tuple[str, ...] = ("video_id", "frame_idx")) -> DataFrame:
    """Mean colour of the pixels that pass the gate; a frame without any has zeros."""
    good = colour_gate(low, high)
    return pixels.groupBy(*keys).agg(*[F.coalesce(F.avg(F.when(good, F.col(c))), F.lit(0.0)).alias(c) for c in "rgb"])


def patches(pixels: DataFrame, landmarks: DataFrame, side: float = 30, statistic: str = "mean", low: float = 55, high: float = 200, half_open: bool | None = None) -> DataFrame:
    """Mean or median colour of the gated pixels in a rectangle round each landmark; zeros where there are fewer than two.

    landmarks may have columns w and h for rectangles of their own. Means take closed rectangles, medians half-open ones.
    The pixels meet the landmarks of their frame on a grid of cells as large as the largest rectangle, so the join is on
    keys: a landmark goes to the few cells its rectangle touches.
    """
    half_open = statistic == "median" if half_open is None else half_open
    w, h = (F.col(c) if c in landmarks.columns else F.lit(side) for c in "wh")
    cell = max(8, int(side))
    box = landmarks.select("video_id", "frame_idx", "ldmk_id", *[F.floor(F.col(c) - F.floor(n / 2)).cast("int").alias(f"{c}0") for c, n in (("y", h), ("x", w))], *[F.floor(F.col(c) + F.floor(n / 2) - int(half_open)).cast("int").alias(f"{c}1") for c, n in (("y", h), ("x", w))])
    cells = lambda c: F.sequence(F.floor(F.greatest(F.col(f"{c}0"), F.lit(0)) / cell), F.floor(F.greatest(F.col(f"{c}1"), F.lit(0)) / cell))
    box = box.withColumn("cy", F.explode(cells("y"))).withColumn("cx", F.explode(cells("x")))
    at = pixels.filter(colour_gate(low, high)).withColumn("cy", F.floor(F.col("y") / cell)).withColumn("cx", F.floor(F.col("x") / cell))
    met = at.join(box, ["video_id", "frame_idx", "cy", "cx"]).filter(F.col("y").between(F.col("y0"), F.col("y1")) & F.col("x").between(F.col("x0"), F.col("x1")))
    of = F.median if statistic == "median" else F.avg
    got = met.groupBy("video_id", "frame_idx", "ldmk_id").agg(F.count("*").alias("__n"), *[of(c).alias(c) for c in "rgb"])
    every = landmarks.select("video_id", "frame_idx", "ldmk_id").distinct().join(got, ["video_id", "frame_idx", "ldmk_id"], "left")
    return every.select("video_id", "frame_idx", F.col("ldmk_id").alias("estimator_id"), *[F.when(F.col("__n") > 1, F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in "rgb"])


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull (counter-clockwise) by monotone chain."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts)

    def chain(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def inside_hull(polygon: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    if len(polygon) < 3:
        return np.zeros(len(y), bool)
    out = np.ones(len(y), bool)
    for (ay, ax), (by, bx) in zip(polygon, np.roll(polygon, -1, 0), strict=True):
        out &= (by - ay) * (x - ax) - (bx - ax) * (y - ay) >= 0
    return out


def _edges(points: list) -> list[tuple[float, ...]]:
    """Sides (ay, ax, by, bx) of the points' hull; none of fewer than three corners, and none with a place that is missing."""
    corners = hull(np.array([(np.nan if p["y"] is None else p["y"], np.nan if p["x"] is None else p["x"]) for p in points], float).reshape(-1, 2))
    if len(corners) < 3 or np.isnan(corners).any():
        return []
    return [(*map(float, a), *map(float, b)) for a, b in zip(corners, np.roll(corners, -1, 0), strict=True)]


def hull_mask(pixels: DataFrame, landmarks: DataFrame, face: list[int], holes: dict[str, list[int]]) -> DataFrame:
    """Pixels inside the face's hull and outside the holes' (eyes, mouth). A feature with three points or fewer is skipped.

    Hulls are made once a frame from its landmarks; pixels meet them in a join and are tested by built-in functions.
    """
    features = [face, *holes.values()]
    points = F.collect_list(F.struct("ldmk_id", "y", "x"))
    frames = landmarks.groupBy("video_id", "frame_idx").agg(points.alias("__points"))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in landmarks.select("video_id", "frame_idx").schema)

    def run(parts):
        known: dict = {}  # frames with the same places have the same hulls
        for b in batches.pieces(parts):
            out = []
            for row in b.column("__points").to_pylist():
                name = tuple(sorted(((p["ldmk_id"], p["y"], p["x"]) for p in row), key=str))
                if name not in known:
                    if len(known) >= batches.ROWS:
                        known.clear()
                    sides = []
                    for k, ids in enumerate(features):
                        own = [p for p in row if p["ldmk_id"] in ids]
                        there = len({p["ldmk_id"] for p in own})
                        sides.append(_edges(own) if not k or there > 3 else [])
                    known[name] = [[dict(zip(("ay", "ax", "by", "bx"), e, strict=True)) for e in s] for s in sides]
                out.append(known[name])
            side = pa.struct([(n, pa.float64()) for n in ("ay", "ax", "by", "bx")])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.list_(side)))], names=["video_id", "frame_idx", "__hulls"])

    hulls = frames.mapInArrow(run, f"{keys}, __hulls array<array<struct<ay:double,ax:double,by:double,bx:double>>>")
    y, x = F.col("y").cast("double"), F.col("x").cast("double")

    def inside(k: int):
        sides = F.get("__hulls", F.lit(k))
        left = lambda e: (e["by"] - e["ay"]) * (x - e["ax"]) - (e["bx"] - e["ax"]) * (y - e["ay"])
        return (F.size(sides) > 0) & F.forall(sides, lambda e: (left(e) >= 0) & ~F.isnan(left(e)))

    rows = pixels.join(hulls, ["video_id", "frame_idx"]).filter(inside(0))
    for k in range(1, len(features)):
        rows = rows.filter(~inside(k))
    return rows.select(*pixels.columns)


def pixel_correlations(pixels: DataFrame) -> DataFrame:
    """(video_id, frame_idx, c array of 9): mean outer product of the pixels without a zero channel."""
    lit = pixels.filter("r <> 0 AND g <> 0 AND b <> 0")
    return lit.groupBy("video_id", "frame_idx").agg(F.array(*[F.avg(F.col(p).cast("double") * F.col(q)) for p in "rgb" for q in "rgb"]).alias("c"))


def motion_input(frames: np.ndarray, dim: int = 36) -> np.ndarray:
    """Six-channel input of a motion/appearance network from frames (time, height, width, 3) in [0, 1]: centre crop, area
    resize, normalised differences over their deviation, standardised frames. The last difference row is zero."""
    n, h, w, _ = frames.shape
    lo = max(0, w // 2 - h // 2)
    crop = frames[:, :, lo : lo + h]

    def shares(size):
        edges = np.linspace(0, size, dim + 1)
        k = np.arange(size)
        return np.clip(np.minimum(edges[1:, None], k + 1) - np.maximum(edges[:-1, None], k), 0, None) / (size / dim)

    small = np.clip(np.einsum("ih,jw,nhwc->nijc", shares(crop.shape[1]), shares(crop.shape[2]), crop), 1 / 255, 1)
    diff = np.zeros((max(0, n - 1), dim, dim, 3))
    diff[:-1] = ((small[1:] - small[:-1]) / (small[1:] + small[:-1]))[: n - 2]
    if diff.std() > 0:
        diff /= diff.std()
    still = (small - small.mean()) / (small.std() or 1)
    return np.concatenate((diff, still[: n - 1]), 3)
