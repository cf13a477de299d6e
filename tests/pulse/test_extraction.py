import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from sanguine.plans import extraction as plan
from sanguine.plans.config import SpecError, parse
from sanguine.queries import SPEC

from .test_dsp import skin as colours

SIDE = 12
CORNERS = {1: (1, 1), 2: (1, 10), 3: (10, 10), 4: (10, 1), 5: (4, 4), 6: (4, 7), 7: (7, 7), 8: (7, 4)}
OUTLINES = ([1, 2, 3, 4], {"mouth": [5, 6, 7, 8]})


class Painted:
    """A 12 x 12 face whose colour is the frame's; the corners and the mouth are another colour."""

    def pixels(self, frames):
        at = F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)))
        px = frames.withColumn("k", at).withColumn("y", (F.col("k") / SIDE).cast("int")).withColumn("x", F.col("k") % SIDE)
        face = F.col("y").between(1, 10) & F.col("x").between(1, 10) & ~(F.col("y").between(4, 7) & F.col("x").between(4, 7))
        return px.select("video_id", "frame_idx", "y", "x", *[F.when(face, F.col(c)).otherwise(F.lit(200.0)).alias(c) for c in "rgb"], F.when(face, 1).otherwise(0).alias("parsing"))

    def landmarks(self, frames):
        at = F.explode(F.array(*[F.struct(F.lit(k).alias("ldmk_id"), F.lit(y).alias("y"), F.lit(x).alias("x")) for k, (y, x) in CORNERS.items()]))
        return frames.select("video_id", "frame_idx", at.alias("s")).select("video_id", "frame_idx", "s.*")


def frames(spark, seconds=10.0):
    x = colours(1.2, 30.0, seconds, 1)[0]
    return spark.createDataFrame([("v", k, *map(float, x[:, k])) for k in range(x.shape[1])], "video_id string, frame_idx int, r double, g double, b double")


@pytest.mark.parametrize("kind", ["convexhull", "faceparsing"])
def test_whole_skin_is_the_faces_colour(spark, kind):
    f = plan.limited(frames(spark), 30.0, dataclasses.replace(parse(SPEC), extra={"tot_sec": 1}))
    assert f.count() == 30
    spec = dataclasses.replace(parse(SPEC), skin_low=1.0, skin_high=254.0, extra={"skin_extractor": kind})
    pixels, landmarks = plan.skin(f, Painted(), spec, OUTLINES)
    assert pixels.count() == 30 * (100 - 16)
    got = plan.traces(f, pixels, landmarks, spec).orderBy("frame_idx").collect()
    want = f.orderBy("frame_idx").collect()
    assert np.allclose([(r.r, r.g, r.b) for r in got], [(r.r, r.g, r.b) for r in want]) and {r.estimator_id for r in got} == {0}
    blank = plan.traces(f, pixels.filter("frame_idx <> 3"), landmarks, spec).filter("frame_idx = 3").first()
    assert (blank.r, blank.g, blank.b) == (0.0, 0.0, 0.0)


def test_patches_and_tracks(spark):
    f = frames(spark, 0.2)
    spec = dataclasses.replace(parse(SPEC), approach="patches", skin_low=1.0, skin_high=254.0, extra={"skin_extractor": "faceparsing", "landmarks_list": [1, 3], "patch_size": 4})
    pixels, landmarks = plan.skin(f, Painted(), spec)
    got = plan.traces(f, pixels, landmarks, spec).collect()
    want = {r.frame_idx: r.g for r in f.collect()}
    assert len(got) == 12 and {r.estimator_id for r in got} == {1, 3} and all(r.g == pytest.approx(want[r.frame_idx]) for r in got)
    moved = plan.tracks(pixels, landmarks, (5, 6)).filter("frame_idx = 0").collect()
    assert sorted((r.axis, r.landmark, r.value) for r in moved) == [("x", 5, 4.0), ("x", 6, 7.0), ("y", 5, 4.0), ("y", 6, 4.0), ("z", -1, 9.0)]
    with pytest.raises(SpecError):
        plan.skin(f, Painted(), dataclasses.replace(spec, extra={"skin_extractor": "other"}))
    with pytest.raises(SpecError):
        plan.skin(f, Painted(), dataclasses.replace(spec, extra={"skin_extractor": "convexhull"}))


def test_videos_to_errors(spark):
    truth = spark.createDataFrame([("v", float(t), 72.0) for t in range(10)], "video_id string, t double, bpm double")
    spec = dataclasses.replace(parse(SPEC), skin_low=1.0, skin_high=254.0, extra={"skin_extractor": "faceparsing"})
    got = plan.run_videos(frames(spark), Painted(), truth, 30.0, spec).collect()
    assert sorted(r.method for r in got) == ["CHROM", "LGI", "POS"] and all(r.MAE < 2 for r in got)
