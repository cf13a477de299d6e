"""Sliding windows over frames, and the small window functions around them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def n_windows(frames: Column, fps: float, size: float, stride: float, keep_short: bool = False) -> Column:
    """Windows that N frames make; with keep_short the quotient is cut towards zero, so a slightly short signal has one."""
    q = (frames - size * fps) / (stride * fps)
    return F.greatest((F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)) if keep_short else F.floor(q)) + 1, F.lit(0)).cast("int")


def frame_windows(frames: DataFrame, fps: float, size: float = 8.0, stride: float = 1.0, keys: tuple[str, ...] = ("video_id",), keep_short: bool = False) -> DataFrame:
    """frames with a row for each window a frame lies in: win_idx, win_pos (place in the window), t_center.

    Window i starts at frame floor(i x stride x fps) and has ceil(size x fps) frames. The windows are generated from the
    frame's side, so no range join is planned; only the frame count of each key is joined in.
    """
    step, width = stride * fps, math.ceil(size * fps)
    counts = frames.groupBy(*keys).agg((F.max("frame_idx") + 1).alias("__n")).withColumn("__n", n_windows(F.col("__n"), fps, size, stride, keep_short))
    first = F.greatest(F.floor((F.col("frame_idx") - width) / step).cast("int"), F.lit(0))
    last = F.least(F.floor((F.col("frame_idx") + 1) / step).cast("int"), F.col("__n") - 1)
    start = F.floor(F.col("win_idx") * F.lit(float(step)))
    return (
        frames.join(counts, list(keys))
        .filter(first <= last)
        .withColumn("win_idx", F.explode(F.sequence(first, last)))
        .withColumn("win_pos", (F.col("frame_idx") - start).cast("int"))
        .filter(F.col("win_pos").between(0, width - 1))
        .withColumn("t_center", F.lit(size / 2) + F.lit(stride) * F.col("win_idx"))
        .drop("__n")
    )


#: Windows of a block: its frames, and one window more, are shuffled and held together.
BLOCK = 32


def _blocks(frames: DataFrame, step: float, width: int, keys: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """(keys, __block, __rows): the frames of each BLOCK windows in order. A frame that windows of two blocks have goes to both."""
    span = BLOCK * step
    at, back, on = F.floor(F.col("frame_idx") / span), math.ceil(width / span), math.ceil(1 / span)
    first = lambda k: F.floor(k * F.lit(float(span)))
    end = lambda k: F.floor((k * BLOCK + (BLOCK - 1)) * F.lit(float(step))) + width
    # a frame's blocks are neighbours, so they are counted, not tried one by one: a lambda for each frame costs more than its shuffle
    low, high = F.greatest(at - back, F.lit(0)), F.greatest(at + on, F.lit(0))
    past = sum(((low + d <= high) & (end(low + d) <= F.col("frame_idx"))).cast("int") for d in range(back + on + 1))
    ahead = sum(((high - d >= low) & (first(high - d) > F.col("frame_idx"))).cast("int") for d in range(back + on + 1))
    dealt = frames.select(*keys, "frame_idx", *values, (low + past).alias("__low"), (high - ahead).alias("__high")).filter("__low <= __high")
    dealt = dealt.select(*keys, "frame_idx", *values, F.explode(F.sequence("__low", "__high")).alias("__block"))
    return dealt.groupBy(*keys, "__block").agg(F.sort_array(F.collect_list(F.struct("frame_idx", *values))).alias("__rows"))


def _counted(frames: DataFrame, fps: float, size: float, stride: float, keys: tuple[str, ...], values: tuple[str, ...], keep_short: bool) -> tuple[DataFrame, DataFrame]:
    """(blocks, counts): counted on the blocks, so that both read one shuffle and the frames are numbered once."""
    dealt = _blocks(frames, stride * fps, math.ceil(size * fps), keys, values)
    counts = dealt.groupBy(*keys).agg((F.max(F.element_at("__rows", -1)["frame_idx"]) + 1).alias("__n"))
    return dealt, counts.withColumn("__n", n_windows(F.col("__n"), fps, size, stride, keep_short))


def window_times(frames: DataFrame, fps: float, size: float = 8.0, stride: float = 1.0, keys: tuple[str, ...] = ("video_id", "estimator_id"), values: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """(keys, win_idx, t_center) of all windows, also of those without frames; from the same shuffle as window_arrays of these values."""
    counts = _counted(frames, fps, size, stride, keys, values, False)[1]
    rows = counts.filter("__n > 0").select(*keys, F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("win_idx"))
    return rows.withColumn("t_center", F.lit(size / 2) + F.lit(stride) * F.col("win_idx"))


def window_arrays(frames: DataFrame, fps: float, size: float = 8.0, stride: float = 1.0, keys: tuple[str, ...] = ("video_id", "estimator_id"), values: tuple[str, ...] = ("r", "g", "b"), keep_short: bool = False, beside: DataFrame | None = None) -> DataFrame:
    """A row for each (keys, window) with an array of each value column in frame order. A group is a block of windows, never a whole video.

    Frames are shuffled about once (a quarter more for windows of eight strides), not once for each window; windows are cut from their block.
    beside: (some of the keys, win_idx, a number), one row a window, whose number each window gets, NULL without one. It is joined to the
    blocks, which weigh a sixth of their windows.
    """
    step, width = stride * fps, math.ceil(size * fps)
    dealt, counts = _counted(frames, fps, size, stride, keys, values, keep_short)
    blocks = dealt.join(counts, list(keys))
    more = []
    if beside is not None:
        *on, index, name = beside.columns
        own = beside.select(*on, F.floor(F.col(index) / BLOCK).alias("__block"), F.struct(index, name).alias("__x"))
        blocks = blocks.join(own.groupBy(*on, "__block").agg(F.map_from_entries(F.collect_list("__x")).alias("__beside")), [*on, "__block"], "left")
        more = [F.try_element_at("__beside", F.col("win_idx")).alias(name)]
    low, high = F.col("__block") * BLOCK, F.least((F.col("__block") + 1) * BLOCK, F.col("__n")) - 1
    # negative or missing numbers of windows give no row
    each = F.explode(F.when(low <= high, F.sequence(low, high))).alias("win_idx")
    rows = blocks.select(*keys, "__rows", *(["__beside"] if more else []), each).withColumn("win_idx", F.col("win_idx").cast("int")).withColumn("__start", F.floor(F.col("win_idx") * F.lit(float(step))))
    head, last = F.get("__rows", F.lit(0))["frame_idx"], F.element_at("__rows", -1)["frame_idx"]
    from_ = F.col("__start") - head
    whole = (last - head + 1 == F.size("__rows")) & (from_ >= 0)
    cut = F.when(whole, F.slice("__rows", (F.greatest(from_, F.lit(0)) + 1).cast("int"), F.lit(width))).otherwise(F.filter("__rows", lambda x: x["frame_idx"].between(F.col("__start"), F.col("__start") + (width - 1))))
    rows = rows.select(*keys, "win_idx", (F.lit(size / 2) + F.lit(stride) * F.col("win_idx")).alias("t_center"), *more, cut.alias("__rows")).filter(F.size("__rows") > 0)
    return rows.select(*keys, "win_idx", "t_center", *([name] if more else []), *[F.col(f"__rows.{v}").alias(v) for v in values])


def sample_rate(times: DataFrame, keys: tuple[str, ...], time: str = "t") -> DataFrame:
    """(keys, rate): round(1 / mean difference of successive distinct times); times in seconds."""
    distinct = times.select(*keys, time).distinct()
    gaps = distinct.withColumn("__gap", F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(time)))
    return gaps.groupBy(*keys).agg(F.round(F.try_divide(F.lit(1.0), F.avg("__gap"))).alias("rate"))


def frame_difference(frames: DataFrame, keys: tuple[str, ...], value: str, order: str = "frame_idx") -> DataFrame:
    """(x' - x) / (x' + x) against the next frame; NULL for the last and where the sum is 0."""
    after = F.lead(value).over(Window.partitionBy(*keys).orderBy(order))
    return frames.withColumn("diff", F.try_divide(after - F.col(value), after + F.col(value)))


def cumulative(frames: DataFrame, keys: tuple[str, ...], value: str, order: str = "frame_idx") -> DataFrame:
    return frames.withColumn("cumulative", F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
