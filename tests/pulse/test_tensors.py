import numpy as np
import pytest
from pyspark.sql import functions as F

from sanguine.functions import dsp
from sanguine.operators import extraction, pulse, tensors


def pixel_rows(spark, videos):
    rows = [(v, k, y, x, *map(float, f[y, x])) for v, frames in videos.items() for k, f in enumerate(frames) for y in range(f.shape[0]) for x in range(f.shape[1])]
    return spark.createDataFrame(rows, "video_id string, frame_idx int, y int, x int, r double, g double, b double").repartition(5)


def by_frame(df, *columns):
    return {(r.video_id, r.frame_idx): [np.array(r[c]) for c in columns] for r in df.collect()}


@pytest.mark.parametrize(("height", "width", "dim"), [(10, 16, 4), (6, 6, 6), (3, 5, 4)])
def test_frame_stack_equals_the_whole_video_routine(spark, height, width, dim):
    rng = np.random.default_rng(4)
    videos = {"a": rng.random((7, height, width, 3)), "b": rng.random((2, height, width, 3)) / 50}
    small = tensors.resized(pixel_rows(spark, videos), width, height, dim)
    got = by_frame(tensors.motion_input(small, parity=True, block=2), "motion", "still")
    assert len(got) == 6 + 1
    for v, frames in videos.items():
        want = extraction.motion_input(frames, dim)
        for k in range(len(frames) - 1):
            assert np.allclose(np.concatenate([p.reshape(dim, dim, 3) for p in got[v, k]], 2), want[k], atol=1e-9), (v, k)


def test_every_frame_has_a_row(spark):
    videos = {"a": np.random.default_rng(1).random((9, 4, 4, 3)), "one": np.full((1, 4, 4, 3), 0.5)}
    small = tensors.resized(pixel_rows(spark, videos), 4, 4, 2)
    got = by_frame(tensors.motion_input(small, block=4), "motion", "still")
    assert len(got) == 10
    x = np.stack([v for _, v in sorted((k[1], p[0]) for k, p in by_frame(small, "x").items() if k[0] == "a")])
    d = np.concatenate(((x[1:] - x[:-1]) / (x[1:] + x[:-1]), np.zeros((1, 12))))
    assert np.allclose(np.stack([got["a", k][0] for k in range(9)]), d / d.std())
    assert np.allclose(np.stack([got["a", k][1] for k in range(9)]), (x - x.mean()) / x.std())
    assert not got["one", 0][0].any() and np.allclose(got["one", 0][1], 0)
    assert tensors.motion_input(small.limit(0)).collect() == []


def test_missing_pixels_are_black_and_clipped(spark):
    rows = spark.createDataFrame([("a", 0, 0, 0, 4.0, 0.0, -1.0), ("a", 0, 9, 0, 1.0, 1.0, 1.0)], "video_id string, frame_idx int, y int, x int, r double, g double, b double")
    (r,) = tensors.resized(rows, 2, 2, 2).collect()
    assert r.x == [1.0, *[1 / 255] * 11]


@pytest.mark.parametrize("block", [1, 2, 100])
def test_shift_goes_over_block_borders(spark, block):
    x = np.arange(2 * 5 * 8.0).reshape(2, 5, 8) + 1
    df = spark.createDataFrame([(v, k, x[v, k].tolist(), "z") for v in range(2) for k in range(5)], "video_id int, frame_idx long, x array<double>, block string").drop("block")
    for depth in (None, 2):
        got = by_frame(tensors.temporal_shift(df, 4, depth=depth, block=block), "x")
        for v in range(2):
            for k in range(5):
                want = x[v, k].reshape(2, 4).copy()
                want[:, 0] = x[v, k + 1].reshape(2, 4)[:, 0] if k < 4 and (depth is None or k % depth != depth - 1) else 0
                want[:, 1] = x[v, k - 1].reshape(2, 4)[:, 1] if k > 0 and (depth is None or k % depth) else 0
                assert np.array_equal(got[v, k][0], want.ravel()), (depth, v, k)


def test_attention_mask(spark):
    df = spark.createDataFrame([([1.0, 0.0, 3.0, 0.0],), ([],), (None,)], "x array<double>")
    got = [r.m for r in df.select(tensors.attention_mask(F.col("x"), 2).alias("m")).collect()]
    assert got == [[0.25, None, 0.75, None], [], None]


def test_batches_are_full_and_no_frame_is_lost(spark):
    rows = [(v, k, [float(1000 * v + k), 1.0]) for v, n in ((1, 23), (2, 1), (3, 8)) for k in range(n)]
    df = spark.createDataFrame(rows, "video_id int, frame_idx int, x array<double>").repartition(7)

    def model(x):
        assert len(x) <= 4 and x.shape[1:] == (1, 2) and len(set(x[:, 0, 0] // 1000)) == 1
        assert list(x[:, 0, 0]) == sorted(x[:, 0, 0])
        return x[:, 0, 0] + len(x) / 10

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {(r.video_id, r.frame_idx): r.y for r in tensors.predicted(df, model, batch=4, block=10, shape=(1, 2)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: int(y) for k, y in got.items()} == {(v, k): int(x[0]) for v, k, x in rows}
    # at most one batch of each block isn't full
    sizes = [round(got[1, k] % 1 * 10) for k in range(23)]
    assert all(sizes[k : k + 10].count(4) >= 8 for k in (0, 10)) and max(sizes) == 4
    assert tensors.predicted(df.limit(0), model).collect() == []
    with pytest.raises(Exception, match="the model gave 1 numbers"):
        tensors.predicted(df, lambda x: x[:1, 0]).collect()


def test_notch_takes_out_its_centre_alone(spark):
    fps, t = 30.0, np.arange(3000) / 30.0
    rows = [(k, float(hz), np.sin(2 * np.pi * hz * t).tolist()) for k, hz in enumerate((0.8, 1.5, 3.0))]
    df = spark.createDataFrame([(k, c, x) for k, hz, x in rows for c in (hz, hz * 1.4)], "k int, centre double, bvp array<double>").union(spark.createDataFrame([(9, None, rows[0][2]), (9, 99.0, rows[0][2])], "k int, centre double, bvp array<double>"))
    freqs = [0.8, 1.5, 3.0]
    out = pulse.notched(df, fps).withColumn("gain", pulse.notch_response(F.col("centre"), freqs, fps)).collect()
    for r in out:
        if r.k == 9:
            assert r.bvp == rows[0][2]
            continue
        late = np.array(r.bvp[2000:])
        assert np.sqrt(2 * (late**2).mean()) == pytest.approx(r.gain[r.k], abs=0.01)
        assert r.gain[r.k] < 1e-9 if r.centre == freqs[r.k] else r.gain[r.k] > 0.98
    b, a = dsp.notch(np.array([2.0]), 10, fps)
    edge = np.exp(-2j * np.pi * (2.0 + 0.1) / fps * np.arange(3))
    assert abs((b[0] @ edge) / (a[0] @ edge)) == pytest.approx(np.sqrt(0.5), abs=0.02)


def test_motion_notch(spark):
    t = np.arange(300) / 30.0
    rows = [("v", 0, axis, (np.sin(2 * np.pi * 1.6 * t) * (k + 1) + 0.05 * np.sin(2 * np.pi * 3 * t)).tolist()) for axis in "yxz" for k in range(1 if axis == "z" else 4)]
    got = pulse.motion_filter(spark.createDataFrame(rows, "video_id string, win_idx int, axis string, track array<double>"), 30.0, notch_q=10.0).collect()
    hz = pulse.band_freqs(30.0) / 60
    assert {r.axis for r in got} == set("xyz")
    for r in got:
        assert abs(hz[int(np.argmin(r.atten))] - 1.6) < 0.1 and min(r.atten) < 0.05 and np.array(r.atten)[np.abs(hz - 3) < 0.1].min() > 0.98 and r.energy > 0
