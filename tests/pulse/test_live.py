"""Recordings, image sequences and live chains against whole batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sanguine.functions import dsp
from sanguine.operators import pulse
from sanguine.plans import pipeline
from sanguine.plans.config import Step, MethodSpec
from sanguine.sources import bdf, frames, signals
from sanguine.streaming import realtime

from .test_dsp import skin


def test_recordings_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    long = [rng.integers(-(2**23), 2**23, 1000) for _ in range(35)]
    marks = np.full(1000, 0xFF0000)
    marks[[100, 101, 350, 351]] |= 7  # two events of two samples
    marks[[512, 513]] |= 9  # the third begins with a record
    marks[600] |= 9
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x_emotion.bdf").write_bytes(bdf.encoded([*long, marks], 256, 0.5, (-100.0, 100.0)) + b"cut")
    (tmp_path / "a" / "few_emotion.bdf").write_bytes(bdf.encoded([*long, marks % 1], 256, 0.5))
    (tmp_path / "a" / "thin_emotion.bdf").write_bytes(bdf.encoded([*long[:5], marks], 256, 0.5))
    (tmp_path / "a" / "text_emotion.bdf").write_bytes(b"not at all")
    (tmp_path / "a" / "none_emotion.bdf").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1].split("_")[0]: r for r in signals.read_signals(spark, "MAHNOB", str(tmp_path)).collect()}
    want = (long[33][512:896] + 2**23) / (2**24 - 1) * 200 - 100
    assert got["x"].fs == 256 and got["x"].error is None and np.allclose(got["x"].signal, want)
    assert {k: (r.error, r.signal) for k, r in got.items() if k != "x"} == {"few": ("fewer than 3 events", None), "thin": ("no such channel", None), "text": ("not a BDF recording", None)}  # Spark reads no empty files
    first = bdf.read_recordings(spark, str(tmp_path), "x_*", channel=0, event=1).first()
    assert np.allclose(first.signal, (long[0][100:896] + 2**23) / (2**24 - 1) * 200 - 100)


def write_video(folder, images, start=1):
    folder.mkdir(exist_ok=True)
    for k, x in enumerate(images, start):
        (folder / f"frame_{k}.ppm").write_bytes(b"P6\n# made\n%d %d\n255\n" % (x.shape[1], x.shape[0]) + x.tobytes())


def test_image_frames(spark, tmp_path):
    rng = np.random.default_rng(3)
    images = rng.integers(0, 256, (12, 4, 6, 3), dtype=np.uint8)
    write_video(tmp_path / "v", images)
    (tmp_path / "v" / "frame_bad.ppm").write_bytes(b"P6 1 1 255\n..")
    (tmp_path / "v" / "frame_99.ppm").write_bytes(b"P3 1 1 255\n0 0 0")
    rows = frames.colours(frames.read_frames(spark, str(tmp_path), 25.0)).collect()
    good = {r.frame_idx: (r.r, r.g, r.b) for r in rows if r.error is None}
    assert good == {k + 1: pytest.approx(tuple(x.reshape(-1, 3).mean(0))) for k, x in enumerate(images)}
    assert sorted((r.frame_idx or 0, r.error) for r in rows if r.error) == [(0, "ValueError: no number in the name"), (99, "ValueError: not a binary PGM or PPM image of 8 bits")]
    assert frames.to_width(images[0], 3).shape == (2, 3, 3) and np.array_equal(frames.to_width(images[0], 6), images[0])
    gray = frames.pnm(b"P5 2 1 255\n\x05\x07")
    assert gray.tolist() == [[[5] * 3, [7] * 3]]
    halves = frames.colours(frames.read_frames(spark, str(tmp_path), pattern="frame_1.ppm"), measure=lambda x: np.stack([x[:2].reshape(-1, 3).mean(0), x[2:].reshape(-1, 3).mean(0)]), width=6)
    assert {r.estimator_id for r in halves.collect()} == {0, 1}


def drained(spark, df, place, name, sink="memory"):
    q = df.writeStream.format(sink).queryName(name).option("checkpointLocation", str(place)).outputMode("append").trigger(availableNow=True)
    q.start().awaitTermination()


def test_a_stream_of_images_ends_and_goes_on_after_a_restart(spark, tmp_path):
    rgb = skin(1.2, 10.0, 20.0, 1)[0]
    images = np.clip(np.round(rgb.T[:, None, None, :] * np.ones((1, 2, 2, 1))), 0, 255).astype(np.uint8)
    root = tmp_path / "in"
    root.mkdir()
    live = realtime.Live(fps=10.0, window=6.0, stride=1.0, method="GREEN", filter_signal=False)

    def run():
        files = frames.stream_frames(spark, str(root), 10.0, at_once=37)
        rates = realtime.rates(frames.colours(files).filter("error IS NULL"), live)
        rates.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    write_video(root / "v", images[:90], 0)
    run()
    write_video(root / "v", images[90:], 90)
    (root / "v" / "END").write_bytes(b"end\n")
    run()
    got = sorted((r.frame_idx, r.bpm) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    x = images[:, 0, 0, 1].astype(float)
    want = []
    for a in range(0, len(x) - 59, 10):
        f, p = dsp.welch(x[None, a : a + 60], 10.0, live.min_hz, live.max_hz)
        want.append((a + 59, float(f[p.argmax()])))
    # the last batch brings all that is left and the end: what was whole by then is out
    assert got == [w for w in want if w in got] and len(got) >= len(want) - 4 and len({g[0] for g in got}) == len(got)


def test_live_chain_equals_batch(spark, tmp_path):
    fps, n = 30.0, 4
    x = skin(1.3, fps, 14.0, n)
    x[3, :, 100] = 10.0  # the fourth estimator has a dark frame
    rows = [("v", e, k, *map(float, x[e, :, k])) for e in range(n) for k in range(x.shape[2])]
    df = spark.createDataFrame(rows, "video_id string, estimator_id int, frame_idx int, r double, g double, b double")
    chain = realtime.Live(fps=fps, window=6.0, stride=1.0, gate=(55.0, 230.0), pre=(("detrend", {"detLambda": 10}), ("zeromean", {})), method="GREEN", post=(("BPfilter", {"minHz": 0.7, "maxHz": 3.0, "fps": "adaptive", "order": 4}),), min_hz=0.7, max_hz=3.0)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drained(spark, realtime.rates(df.sparkSession.readStream.schema(df.schema).parquet(str(tmp_path / "in")), chain), tmp_path / "cp", "chain")
    got = {r.frame_idx: r.bpm for r in spark.table("chain").collect()}
    spec = MethodSpec("GREEN", pre=(Step("detrend", {"detLambda": 10}), Step("zeromean", {})), post=(Step("BPfilter", {"minHz": 0.7, "maxHz": 3.0, "fps": "adaptive", "order": 4}),))
    bvps = pipeline.signals(pipeline.windowed(df, fps, 6.0, 1.0), fps, spec, (55.0, 230.0))
    rates = pulse.rates(pulse.psd(bvps, fps, 0.7, 3.0), pulse.band_freqs(fps, 0.7, 3.0))
    want = {r.win_idx * 30 + 179: r.bpm for r in pulse.median_rates(rates).collect()}
    assert got == pytest.approx(want) and len(got) == 9
    assert bvps.filter("win_idx = 0").count() == n - 1 and stream.isStreaming
    with pytest.raises(ValueError, match="no such filter"):
        realtime.kernel("nothing", fps)


def test_idle_and_ended_videos_lose_their_state(spark, tmp_path):
    row = lambda v, k, last=False: (v, 0, k, 1.0 * k, 2.0, 3.0, last)
    schema = "video_id string, estimator_id int, frame_idx int, r double, g double, b double, last boolean"
    live = realtime.Live(fps=1.0, window=60.0, idle="1 second")
    place = str(tmp_path / "in")
    spark.createDataFrame([row("a", k) for k in range(5)] + [row("b", k) for k in range(5)] + [("b", None, None, None, None, None, True)], schema).coalesce(1).write.parquet(place)
    stream = spark.readStream.schema(schema).parquet(place)
    q = realtime.rates(stream, live).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="1 second").start()
    try:
        import time

        deadline, rows = time.time() + 90, []
        while time.time() < deadline:
            rows.append(sum(s["numRowsTotal"] for s in (q.lastProgress or {"stateOperators": []})["stateOperators"]))
            if 1 in rows and rows[-1] == 0:
                break
            time.sleep(0.3)
    finally:
        q.stop()
    assert 1 in rows and 2 not in rows and rows[-1] == 0, rows  # b ended at once, a after a second


def test_causal_filter_in_order_and_across_restarts(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2, 300))
    b, a = dsp.butter_bandpass(0.8, 4.0, 30.0, 2)
    rows = [(v, 0, k, float(x[v, k])) for v in range(2) for k in range(300)]
    rng.shuffle(rows)
    rows = [(int(v), int(e), int(k), float(y)) for v, e, k, y in rows]
    schema = "video_id int, estimator_id int, frame_idx int, value double"
    for part in range(3):
        spark.createDataFrame(rows[part * 200 : part * 200 + 200] + rows[:10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = realtime.causal(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), b, a)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("video_id", "frame_idx").collect()
    assert [(r.video_id, r.frame_idx) for r in got] == [(v, k) for v in range(2) for k in range(300)]
    assert np.allclose([r.value for r in got], dsp.lfilter(b, a, x).ravel())
    assert out.isStreaming and F is not None
