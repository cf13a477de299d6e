"""From decoded frames to traces and landmark tracks: the image stage, masks, frame limit and patches of a specification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extraction, filters
from .config import JobSpec, SpecError
from .pipeline import run, written

#: Landmarks from forehead to nose that motion is read from, unless others are named; fixed values.
MOTION_LANDMARKS = (10, 151, 6, 197, 5, 4)
#: Outlines whose hulls bound the skin, as landmark numbers: the face, and the holes in it by name.
Outlines = tuple[list[int], dict[str, list[int]]]


def limited(frames: DataFrame, fps: float, spec: JobSpec) -> DataFrame:
    """Frames of the first tot_sec seconds where the specification has such a limit above 0, else all."""
    seconds = spec.extra.get("tot_sec") or 0
    return frames.filter(F.col("frame_idx") < int(seconds * fps)) if seconds > 0 else frames


def skin(frames: DataFrame, extractor: extraction.SkinExtractor, spec: JobSpec, outlines: Outlines | None = None) -> tuple[DataFrame, DataFrame]:
    """(skin pixels, visible landmarks) of frames, both written once.

    skin_extractor `faceparsing` keeps the pixels whose column `parsing` is a skin class; `convexhull` those in the face's
    hull and outside the holes of `outlines`; without either the extractor's pixels are skin already.
    """
    kind = spec.extra.get("skin_extractor")
    landmarks = extractor.landmarks(frames)
    if {"visibility", "presence"} <= set(landmarks.columns):
        landmarks = filters.visible(landmarks)
    landmarks = written(landmarks)
    pixels = extractor.pixels(frames)
    if kind == "faceparsing":
        pixels = filters.skin_classes(pixels)
    elif kind == "convexhull":
        if outlines is None:
            raise SpecError("skin_extractor convexhull needs the outlines of face and holes")
        pixels = extraction.hull_mask(pixels, landmarks, *outlines)
    elif kind is not None:
        raise SpecError(f"skin_extractor {kind}: convexhull or faceparsing")
    return written(pixels), landmarks


def chosen(landmarks: DataFrame, spec: JobSpec) -> DataFrame:
    """The landmarks of landmarks_list, or all where it is not given."""
    names = spec.extra.get("landmarks_list")
    if not names:
        return landmarks
    if not all(isinstance(k, int) for k in names):
        raise SpecError("landmarks_list: numbers of landmarks")
    return landmarks.filter(F.col("ldmk_id").isin(*names))


def traces(frames: DataFrame, pixels: DataFrame, landmarks: DataFrame, spec: JobSpec, statistic: str = "mean") -> DataFrame:
    """(video_id, estimator_id, frame_idx, r, g, b): whole skin as estimator 0, or a patch of patch_size round each chosen landmark.

    A frame without skin has zeros, so that frame numbers have no gaps.
    """
    if spec.approach == "patches":
        side = spec.extra.get("patch_size") or 30
        got = extraction.patches(pixels, chosen(landmarks, spec), side, statistic, spec.skin_low, spec.skin_high)
        return got.select("video_id", "estimator_id", "frame_idx", "r", "g", "b")
    got = frames.select("video_id", "frame_idx").join(extraction.holistic(pixels, spec.skin_low, spec.skin_high), ["video_id", "frame_idx"], "left")
    return got.select("video_id", F.lit(0).alias("estimator_id"), "frame_idx", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "rgb"])


def tracks(pixels: DataFrame, landmarks: DataFrame, names: tuple[int, ...] = MOTION_LANDMARKS) -> DataFrame:
    """(video_id, axis, landmark, frame_idx, value): places x and y of the named landmarks, and as z the width of the skin's box."""
    own = landmarks.filter(F.col("ldmk_id").isin(*names))
    axis = F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("value")) for c in "xy"]))
    flat = own.select("video_id", F.col("ldmk_id").cast("int").alias("landmark"), "frame_idx", axis.alias("s")).select("video_id", "s.axis", "landmark", "frame_idx", "s.value")
    depth = filters.bounding_box(pixels).select("video_id", F.lit("z").alias("axis"), F.lit(-1).alias("landmark"), "frame_idx", (F.col("x1") - F.col("x0")).cast("double").alias("value"))
    return flat.unionByName(depth)


def run_videos(frames: DataFrame, extractor: extraction.SkinExtractor, truth: DataFrame, fps: float, spec: JobSpec, outlines: Outlines | None = None, statistic: str = "mean") -> DataFrame:
    """Frames (video_id, frame_idx, and what the extractor reads) to result rows, as `pipeline.run` gives them."""
    if spec.videos is not None:
        frames = frames.filter(F.col("video_id").isin(*spec.videos))
    frames = limited(frames, fps, spec)
    pixels, landmarks = skin(frames, extractor, spec, outlines)
    rgb = written(traces(frames, pixels, landmarks, spec, statistic))
    moving = tracks(pixels, landmarks) if spec.estimate == "clustering" and spec.movement_thrs else None
    return run(rgb, truth, fps, spec, moving)
