"""Frames as tensors: rows (video_id, frame_idx, arrays), the stages around a network that brings its own weights.

A tensor is an array in row-major order, channels last. Frames of a video are numbered without gaps. What needs a frame's neighbours deals
videos out in blocks of frames, each with the one frame before and after it, so no task has a whole video to work on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A

KEYS = ("video_id", "frame_idx")


def _overlap(c: Column, size: Column, dim: int) -> Column:
    """(cell, weight) structs of the cells of dim that pixel c of size lies in; weights are shares of a cell."""
    lo, hi = c * F.lit(float(dim)) / size, (c + 1) * F.lit(float(dim)) / size
    cells = F.sequence(F.floor(lo).cast("int"), F.greatest(F.ceil(hi) - 1, F.floor(lo)).cast("int"))
    return F.transform(cells, lambda k: F.struct(k.alias("at"), F.greatest(F.least(hi, k + F.lit(1.0)) - F.greatest(lo, k.cast("double")), F.lit(0.0)).alias("w")))


def resized(pixels: DataFrame, width: int, height: int, dim: int = 36, lower: float = 1 / 255) -> DataFrame:
    """(video_id, frame_idx, x array of dim * dim * 3) of pixels (video_id, frame_idx, y, x, r, g, b) with values in [0, 1].

    The middle square is taken and made dim x dim by area: a cell is the mean of the pixels it covers, as far as it covers them. Values are
    kept in [lower, 1]. Pixels that a frame has no row for are black. Sums are combined before they are shuffled; a frame's cells are the only group.
    """
    left = max(0, width // 2 - height // 2)
    side = min(height, width - left)
    at = pixels.filter((F.col("x") >= left) & (F.col("x") < left + side) & (F.col("y") >= 0) & (F.col("y") < height))
    at = at.select(*KEYS, *[F.col(c).cast("double").alias(c) for c in "rgb"], F.explode(_overlap(F.col("y"), F.lit(float(height)), dim)).alias("i"), F.col("x"))
    at = at.select(*KEYS, *"rgb", "i", F.explode(_overlap(F.col("x") - left, F.lit(float(side)), dim)).alias("j"))
    parts = at.select(*KEYS, (F.col("i.at") * dim + F.col("j.at")).alias("k"), *[(F.col("i.w") * F.col("j.w") * F.col(c)).alias(c) for c in "rgb"])
    every = pixels.select(*KEYS).distinct().select(*KEYS, F.explode(F.sequence(F.lit(0), F.lit(dim * dim - 1))).alias("k"), *[F.lit(0.0).alias(c) for c in "rgb"])
    cells = parts.unionByName(every).groupBy(*KEYS, "k").agg(*[F.least(F.greatest(F.sum(c), F.lit(float(lower))), F.lit(1.0)).alias(c) for c in "rgb"])
    rows = cells.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("k", *"rgb"))).alias("cells"))
    return rows.select(*KEYS, F.flatten(F.transform("cells", lambda s: F.array(s["r"], s["g"], s["b"]))).alias("x"))


def with_neighbours(frames: DataFrame, column: str = "x", block: int = 256) -> DataFrame:
    """frames with `before` and `after`, the column's values in the frames before and after, NULL at a video's ends; and `block`.

    A frame at a block's border is sent to the neighbouring block, too; so windows are over blocks, and all but one in `block` frames move once.
    """
    at = F.floor(F.col("frame_idx") / block)
    near = F.array_distinct(F.array(at, F.floor((F.col("frame_idx") - 1) / block), F.floor((F.col("frame_idx") + 1) / block)))
    halo = frames.withColumn("block", F.explode(near)).withColumn("__own", F.col("block") == at)
    own = Window.partitionBy("video_id", "block").orderBy("frame_idx")
    return halo.withColumn("before", F.lag(column).over(own)).withColumn("after", F.lead(column).over(own)).filter("__own").drop("__own")


def _moments(column: str) -> list[Column]:
    m = A.mean(F.col(column))
    return [m.alias(f"{column}_mean"), A.let(m, lambda v: A.mean(F.transform(column, lambda x: (x - v) * (x - v)))).alias(f"{column}_var")]


def _standard(rows: DataFrame, parts: dict[str, bool]) -> DataFrame:
    """rows with the columns over their video's deviation, less the mean where True. Two levels: a frame's mean and variance, then the video's of these; joined back by block.

    All arrays of a column have one length, so a video's variance is its frames' mean variance and the variance of their means. A constant column is only centred.
    """
    told = rows.select("video_id", "block", *[m for c in parts for m in _moments(c)])
    whole = told.groupBy("video_id").agg(*[a for c in parts for a in (F.avg(f"{c}_mean").alias(f"{c}_m"), F.sqrt(F.avg(f"{c}_var") + F.var_pop(f"{c}_mean")).alias(f"{c}_s"))])
    stats = rows.select("video_id", "block").distinct().join(whole, "video_id")
    scale = lambda c: F.when(F.col(f"{c}_s") > 0, F.col(f"{c}_s")).otherwise(F.lit(1.0))
    out = rows.join(stats, ["video_id", "block"])

    def scaled(c: str, centred: bool) -> Column:
        return F.transform(c, lambda x: (x - F.col(f"{c}_m") if centred else x) / scale(c))

    return out.withColumns({c: scaled(c, centred) for c, centred in parts.items()}).drop(*[f"{c}_{k}" for c in parts for k in "ms"])


def motion_input(tensors: DataFrame, parity: bool = False, block: int = 256) -> DataFrame:
    """(video_id, frame_idx, motion, still): the input of a motion and appearance network from frames (video_id, frame_idx, x).

    motion: (next - this) / (next + this), over the deviation of all of a video's; zeros where there is no next frame. still: the frame
    less the video's mean, over its deviation. One row a frame. parity: the last frame has no row, and the one before it
    has zeros for motion, which count in the deviation, as the older routine leaves them.
    """
    rows = with_neighbours(tensors, "x", block)
    nothing = F.transform("x", lambda v: F.lit(0.0))
    after = F.col("after")
    change = F.when(after.isNull(), nothing).otherwise(F.zip_with("x", after, lambda a, b: F.coalesce(F.try_divide(b - a, b + a), F.lit(0.0))))
    rows = rows.select(*KEYS, "block", change.alias("motion"), F.col("x").alias("still"), after.isNull().alias("last"))
    if not parity:
        return _standard(rows, {"motion": False, "still": True}).select(*KEYS, "motion", "still")
    ends = rows.filter("last").select("video_id", (F.col("frame_idx") - 1).alias("frame_idx"), F.lit(True).alias("late"))
    rows = rows.join(ends, list(KEYS), "left").withColumn("motion", F.when(F.col("late"), F.transform("motion", lambda v: F.lit(0.0))).otherwise(F.col("motion")))
    still = _standard(rows.drop("late"), {"still": True}).select(*KEYS, "still")
    motion = _standard(rows.filter("NOT last"), {"motion": False}).select(*KEYS, "motion")
    return motion.join(still, list(KEYS))


def temporal_shift(frames: DataFrame, channels: int, column: str = "x", fold: int = 3, depth: int | None = None, block: int = 256) -> DataFrame:
    """frames with the first channels // fold channels taken from the frame after, the next ones from the frame before, the rest left. Zeros where there is no such frame.

    depth: frames are shifted within clips of so many frames each, from frame 0 on; None: along the whole video, over the blocks' borders.
    """
    part = channels // fold
    rows = with_neighbours(frames, column, block)
    inside = lambda k: F.lit(True) if depth is None else F.pmod(F.col("frame_idx"), F.lit(depth)) != k
    near = lambda c, ok: F.when(ok & F.col(c).isNotNull(), F.col(c)).otherwise(F.transform(column, lambda v: F.lit(0.0)))
    three = F.struct(F.col(column).alias("own"), near("after", inside((depth or 0) - 1)).alias("after"), near("before", inside(0)).alias("before"))
    shifted = A.let(three, lambda t: F.transform(t["own"], lambda v, k: F.when(k % channels < part, F.get(t["after"], k)).when(k % channels < 2 * part, F.get(t["before"], k)).otherwise(v)))
    return rows.withColumn(column, shifted).drop("block", "before", "after")


def attention_mask(x: Column, channels: int) -> Column:
    """Each channel over its sum, times half the number of places: its mean becomes a half. NULL elements where a channel sums to 0."""
    sums = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: A.total(F.filter(x, lambda v, k: k % channels == c)))
    places = F.size(x) / channels
    return A.let(sums, lambda s: F.transform(x, lambda v, k: F.try_divide(v * places * 0.5, F.get(s, k % channels))))


def predicted(frames: DataFrame, model: Callable[..., np.ndarray], columns: tuple[str, ...] = ("x",), batch: int = 128, block: int = 4096, shape: tuple[int, ...] | None = None) -> DataFrame:
    """(video_id, frame_idx, y) of a model over frames: model(arrays of `columns`, up to `batch` rows each) gives a number a row.

    Frames come in order of video and number and meet the model in batches that are filled across Arrow's own; the last batch of a task has
    what is left, so every frame comes out once. Work is dealt by blocks of `block` frames, and a batch never has frames of two videos. shape: of a row's tensor.
    """
    names, types = [*KEYS, *columns], {f.name: f.dataType.simpleString() for f in frames.schema}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def told(rows):
            stacked = [np.array([r[2 + k] for r in rows], float).reshape(len(rows), *(shape or (-1,))) for k in range(len(columns))]
            y = np.asarray(model(*stacked), float).reshape(-1)
            if len(y) != len(rows):
                raise ValueError(f"the model gave {len(y)} numbers for {len(rows)} frames")
            return pa.record_batch([pa.array([r[0] for r in rows], kinds[0]), pa.array([r[1] for r in rows], kinds[1]), pa.array(y)], [*KEYS, "y"])

        kinds = None
        for part in parts:
            kinds = [part.schema.field(c).type for c in KEYS]
            for row in zip(*(part.column(c).to_numpy(zero_copy_only=False) if c in columns else part.column(c).to_pylist() for c in names), strict=True):
                if held and (len(held) == batch or held[-1][0] != row[0]):
                    yield told(held)
                    held = []
                held.append(row)
        if held:
            yield told(held)

    dealt = frames.select(*names).repartition("video_id", F.floor(F.col("frame_idx") / block)).sortWithinPartitions(*KEYS)
    return dealt.mapInArrow(run, f"video_id {types['video_id']}, frame_idx {types['frame_idx']}, y double")


def standardised(predictions: DataFrame) -> DataFrame:
    """predictions (video_id, frame_idx, y) with y less its video's mean, over its sample deviation."""
    whole = predictions.groupBy("video_id").agg(F.avg("y").alias("__m"), F.stddev_samp("y").alias("__s"))
    return predictions.join(whole, "video_id").withColumn("y", F.try_divide(F.col("y") - F.col("__m"), F.col("__s"))).drop("__m", "__s")
