import dataclasses
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sanguine.functions import bvp
from sanguine.operators import align, extraction, filters, pulse, windows
from sanguine.plans import pipeline
from sanguine.plans.config import SpecError, parse
from sanguine.queries import QUERIES, SPEC
from sanguine.sources import signals, sinks
from sanguine.streaming import realtime

from .test_dsp import skin


def traces(spark, hz=1.2, seconds=20.0, n=2, video="v"):
    x = skin(hz, 30.0, seconds, n)
    rows = [(video, e, k, *map(float, x[e, :, k])) for e in range(n) for k in range(x.shape[2])]
    return spark.createDataFrame(rows, "video_id string, estimator_id int, frame_idx int, r double, g double, b double")


@pytest.mark.parametrize("n,size,stride,fps", [(300, 8, 1, 30.0), (241, 8, 1, 30.0), (239, 8, 1, 30.0), (500, 3, 0.5, 29.97), (100, 2.5, 0.7, 12.5)])
def test_windows(spark, n, size, stride, fps):
    df = spark.range(n).selectExpr("1 video_id", "CAST(id AS INT) frame_idx")
    got = windows.frame_windows(df, fps, size, stride).groupBy("win_idx", "t_center").agg(F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b"), F.count("*").alias("n")).orderBy("win_idx").collect()
    want = [(i, int(i * stride * fps), min(n - 1, int(i * stride * fps) + int(np.ceil(size * fps)) - 1)) for i in range(max(0, int(np.floor((n - size * fps) / (stride * fps))) + 1))]
    assert [(r.win_idx, r.a, r.b) for r in got] == want
    assert [r.t_center for r in got] == pytest.approx([size / 2 + stride * w[0] for w in want])


def test_native_methods_equal_numpy(spark):
    wins = windows.window_arrays(traces(spark), 30.0)
    for name in pulse.NATIVE:
        a, b = ({(r.estimator_id, r.win_idx): r.bvp for r in pulse.to_bvp(wins, name, 30.0, native=k).collect()} for k in (True, False))
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a), name


def test_pos_windows_equal_overlap_add(spark):
    df = traces(spark, n=1)
    got = pulse.pos_by_windows(df, 30.0, ("video_id",)).orderBy("frame_idx").collect()
    assert np.allclose([r.h for r in got], bvp.pos(skin(1.2, 30.0, 20.0, 1), 30.0)[0], atol=1e-6)


def test_end_to_end_pulse(spark):
    df = traces(spark)
    spec = parse(SPEC)
    truth = spark.createDataFrame([("v", float(t), 72.0 + 0.001 * t) for t in range(4, 17)], "video_id string, t double, bpm double")
    got = pipeline.run(df, truth, 30.0, spec).collect()
    assert {r.method for r in got} == {"CHROM", "POS", "LGI"} and all(r.MAE < 2 and r.SNR > 0 for r in got)
    for estimate in ("median", "clustering"):
        es = pipeline.estimates(pipeline.signals(pipeline.windowed(traces(spark, n=4), 30.0), 30.0, spec.methods[0]), 30.0, estimate).collect()
        assert es and all(abs(r.bpm - 72) < 2 for r in es)


def test_flat_signals_and_gates_drop(spark):
    flat = spark.createDataFrame([("f", 0, k, 100.0, 100.0, 100.0) for k in range(300)] + [("d", 0, k, 1.0 if k == 50 else 100.0 + k % 5, 1.0 if k == 50 else 90.0 + k % 3, 1.0 if k == 50 else 80.0 + k % 2) for k in range(300)], "video_id string, estimator_id int, frame_idx int, r double, g double, b double")
    wins = windows.window_arrays(flat, 30.0)
    assert {r.video_id for r in pulse.to_bvp(wins, "CHROM", 30.0).collect()} == {"d"}
    assert {(r.video_id, r.win_idx) for r in filters.estimator_gate(wins).collect()} == {("f", 0), ("f", 1), ("f", 2), ("d", 2)} and filters.estimator_gate(wins).filter("video_id = 'd' AND win_idx < 2").count() == 0
    with pytest.raises(ValueError):
        pulse.united(pulse.to_bvp(wins, "GREEN", 30.0), pulse.to_bvp(wins, "CHROM", 30.0))


def test_nearest_ties_take_the_earlier(spark):
    es = spark.createDataFrame([("v", 1.5, 70.0), ("v", 9.0, 71.0), ("w", 1.0, 60.0), ("v", 0.0, 1.0)], "video_id string, t double, bpm double")
    gt = spark.createDataFrame([("v", 1.0, 80.0), ("v", 2.0, 90.0), ("v", 2.0, 95.0)], "video_id string, t double, bpm double")
    for f in (align.nearest, align.nearest_small):
        got = {(r.video_id, r.t): r.bpm_gt for r in f(es, gt).collect()}
        assert got == {("v", 1.5): 80.0, ("v", 9.0): 90.0, ("w", 1.0): None, ("v", 0.0): 80.0}


def test_hull_mask(spark):
    px = spark.createDataFrame([("v", 0, y, x, 100, 100, 100) for y in range(12) for x in range(12)], "video_id string, frame_idx int, y int, x int, r int, g int, b int")
    corners = [(1, 1, 1), (2, 1, 10), (3, 10, 10), (4, 10, 1), (5, 4, 4), (6, 4, 7), (7, 7, 7), (8, 7, 4)]
    ld = spark.createDataFrame([("v", 0, *c) for c in corners], "video_id string, frame_idx int, ldmk_id int, y int, x int")
    full = extraction.hull_mask(px, ld, [1, 2, 3, 4], {"mouth": [5, 6, 7, 8], "eye": [99, 98]})
    assert full.count() == 100 - 16


def test_sources(spark, tmp_path):
    ms = [0, 40, 80, 120, 160]
    files = {
        "pure/a/01.json": json.dumps({"/FullPackage": [{"Value": {"waveform": k}} for k in (5, 6, 7)]}),
        "pure/b/02.json": "{broken",
        "ubfc1/a/gt.xmp": "\n".join(f"{t},70,0,{k}" for k, t in enumerate(ms)),
        "ubfc2/a/ground_truth.txt": "1 2 3 4 5\n70 70 70 70 70\n0.00 0.04 0.08 0.12 0.16\n",
        "ubfc_phys/a/bvp_s1.csv": "1\n2\n3\n",
        "v4v/a/BP.txt": "1.5\n2.5\n",
        "vicar_ppg/a/x.csv": "ms,trace\n" + "\n".join(f"{t},{k}" for k, t in enumerate(ms)),
        "vipl_hr_v1/a/wave.csv": "No,Wave\n1,9\n2,8\n",
        "lgi_ppgi/a/cms50_x.xml": "<r><p><value1>1</value1><value2>3</value2></p><p><value2>4</value2></p></r>",
        "lgi_ppgi/a/cv_camera_sensor_timer_stream_handler.xml": "<r><p><value1>33.0</value1></p></r>",
        "ecg_fitness/a/c920.csv": "1,0\n2,4\n",
        "ecg_fitness/a/viatom.csv": "t,ecg,hr\n" + "\n".join(f"{t},{k},0" for k, t in enumerate(ms)),
    }
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    want = {"ubfc1": (25.0, [0, 1, 2, 3, 4]), "ubfc2": (25.0, [1, 2, 3, 4, 5]), "ubfc_phys": (64.0, [1, 2, 3]), "v4v": (1000.0, [1.5, 2.5]), "vicar_ppg": (25.0, [0, 1, 2, 3, 4]), "vipl_hr_v1": (50.0, [9, 8]), "lgi_ppgi": (60.0, [3, 4]), "ecg_fitness": (125.0, [0, 1, 2, 3, 4])}
    for name, (fs, x) in want.items():
        (r,) = signals.read_signals(spark, name, str(tmp_path / name)).collect()
        assert (r.fs, r.signal, r.error) == (fs, [float(v) for v in x], None), name
    pure = signals.read_signals(spark, "PURE", str(tmp_path / "pure")).collect()
    assert sorted(r.error is None for r in pure) == [False, True]
    with pytest.raises(ImportError):
        signals.connector("nothing")
    assert signals.connector("LGI-PPGI") == signals.CONNECTORS["lgi_ppgi"]
    cut = signals.without_lead(signals.read_signals(spark, "ubfc1", str(tmp_path / "ubfc1")).withColumn("lead_s", F.lit(0.08))).first()
    assert cut.signal == [2.0, 3.0, 4.0]
    late = signals.without_lead(signals.read_signals(spark, "ubfc1", str(tmp_path / "ubfc1")).withColumn("lead_s", F.lit(-1.0))).first()
    assert late.signal is None and late.error
    for k in ("x", "y"):
        (tmp_path / f"v/{k}").mkdir(parents=True)
        (tmp_path / f"v/{k}/{'z' if k == 'x' else 'a'}.avi").write_text("x")
        (tmp_path / f"v/{k}/gt.xmp").write_text("0,70,0,1")
    pairs = signals.dataset(spark, "ubfc1", str(tmp_path / "v"), str(tmp_path / "v")).collect()
    assert len(pairs) == 2 and all(r.video_path.rsplit("/", 1)[0] == r.sig_path.rsplit("/", 1)[0] for r in pairs)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("d1", "CHROM", 1.0), ("d2", "POS", 2.0)], "dataset string, method string, MAE double")
    for _ in range(2):
        sinks.save_results(df, str(tmp_path / "r"))
    assert sorted(map(tuple, sinks.load_results(spark, str(tmp_path / "r")).select("dataset", "method", "MAE").collect())) == [("d1", "CHROM", 1.0), ("d2", "POS", 2.0)]


def test_specs():
    spec = parse(SPEC)
    assert [m.name for m in spec.methods] == ["CHROM", "POS", "LGI"] and spec.methods[0].post[0].params["order"] == 6
    assert parse(SPEC.replace("estimate = holistic", "type = clustering")).estimate == "clustering"
    for bad in (SPEC.replace("stride = 1", "strode = 1"), SPEC.replace("[BPM]", "[BPMX]"), SPEC.replace("'BPfilter']", "'nofilter']"), SPEC.replace("params = {'minHz'", "path = 'x.py'\nparams = {'minHz'")):
        with pytest.raises(SpecError):
            parse(bad)


def test_stream_equals_batch(spark, tmp_path):
    frames = traces(spark, seconds=12.0)
    live = realtime.Live(fps=30.0, window=6.0, stride=1.0, filter_signal=False)
    for k in range(3):
        frames.filter((F.col("frame_idx") >= 120 * k) & (F.col("frame_idx") < 120 * (k + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = realtime.rates(stream, live).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    got = {r.frame_idx: r.bpm for r in spark.table("live").collect()}
    wins = windows.window_arrays(frames, 30.0, 6.0, 1.0)
    freqs = pulse.band_freqs(30.0, 0.7, 3.0)
    batch = pulse.median_rates(pulse.rates(pulse.psd(pulse.to_bvp(wins, "CHROM", 30.0), 30.0, 0.7, 3.0), freqs)).collect()
    assert len(batch) == 7 and got == pytest.approx({30 * r.win_idx + 179: r.bpm for r in batch})


def test_motion_input():
    x = extraction.motion_input(np.random.default_rng(0).random((5, 40, 60, 3)))
    assert x.shape == (4, 36, 36, 6) and (x[3, :, :, :3] == 0).all()


def test_queries_stay_without_the_corpus_package():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[2] / "sanguine"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text().replace("parallel", ""), p


def test_motion_filter_dips_at_the_motion(spark):
    t = np.arange(240) / 30.0
    rows = [("v", k, axis, (np.sin(2 * np.pi * 1.5 * t + j) + 0.01 * j).tolist()) for k in range(2) for axis in "yxz" for j in range(4 if axis != "z" else 1)]
    got = pulse.motion_filter(spark.createDataFrame(rows, "video_id string, win_idx int, axis string, track array<double>"), 30.0).collect()
    freqs = pulse.band_freqs(30.0)
    assert len(got) == 6
    for r in got:
        assert abs(freqs[int(np.argmin(r.atten))] - 90) < 2 and r.energy > 0, r.axis


def test_natural_places_of_all_rows(spark):
    names = [f"run{k % 3}/img{k}.png" for k in range(500)] + ["run10/img2.png", "run10/img10.png", "none", "run10/img2.png"]
    rows = spark.createDataFrame([(n,) for n in reversed(names)], "path string").repartition(7)
    got = [(r.place, r.path) for r in signals.natural_places(rows, "path").collect()]
    order = sorted(names, key=lambda n: (re.sub(r"\d+\D*$", "", n), int((re.search(r"(\d+)\D*$", n) or [0, -1])[1]), n))
    assert sorted(got) == list(enumerate(order, 1))
    assert signals.natural_places(rows.limit(0), "path").collect() == []


def test_natural_order_keeps_every_customer(spark):
    sf = "/root/testdata/sf0.001"
    names = sorted(r.c_name for r in spark.read.parquet(f"{sf}/customer.parquet").collect())  # numbers of equal length
    got = {q: sorted((r.place, r.c_name) for r in QUERIES[q](spark, sf).collect()) for q in ("T04_natural_order", "T04_natural_order_all")}
    assert got == {"T04_natural_order": list(enumerate(names, 1)), "T04_natural_order_all": list(enumerate(names, 1))} and len(names) > 50


def test_signals_are_cut_to_the_video(spark, tmp_path):
    xml = "<r>" + "".join(f"<p><value2>{k}</value2></p>" for k in range(60)) + "</r>"
    frames = lambda ms: f"<r><p><value1>0</value1></p><p><value1>{ms}</value1></p></r>"
    files = {f"lgi/{k}/cms50_x.xml": xml for k in "abcd"}
    files |= {f"lgi/{k}/cv_camera_sensor_timer_stream_handler.xml": x for k, x in (("a", frames(900.7)), ("b", frames(2000)), ("c", "<broken"))}
    files["ecg/a/viatom.csv"] = "t,ecg,hr\n" + "\n".join(f"{40 * k},{k},0" for k in range(9))
    files["ecg/a/c920.csv"] = "0,2\n1,4\n2,6\n"
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path.split("/")[-2]: r for r in signals.read_signals(spark, "LGI_PPGI", str(tmp_path / "lgi")).collect()}
    assert got["a"].signal == [float(k) for k in range(6, 60)] and got["a"].error is None
    assert all(got[k].signal is None and got[k].error for k in "bcd") and "no cv_camera" in got["d"].error
    assert signals.read_signals(spark, "ecg_fitness", str(tmp_path / "ecg")).first().signal == [2.0, 3.0, 4.0, 5.0, 6.0]


def test_registered_methods_reach_the_tasks(spark):
    wins = windows.window_arrays(traces(spark, seconds=9.0), 30.0)
    bvp.register("halves", lambda x, fps: np.stack([x[:, 0] / fps, x[:, 1] / fps], 1).reshape(-1, x.shape[2]), by_fps=True)
    try:
        got = pulse.to_bvp(wins, "cpu_halves", 30.0).collect()
    finally:
        del bvp.METHODS["HALVES"]
    given = {(r.estimator_id, r.win_idx): (r.r, r.g) for r in wins.collect()}
    assert len(got) == 2 * len(given) and {r.method for r in got} == {"HALVES"}
    assert all(np.allclose(np.array(r.bvp) * 30, given[r.estimator_id, r.win_idx][r.output]) for r in got)


def test_motion_reaches_the_clustering(spark):
    rgb = traces(spark, 1.2, 12.0, 6)
    rows = [("v", axis, j, k, float(np.sin(2 * np.pi * 1.2 * k / 30 + j))) for axis in "xyz" for j in range(4 if axis != "z" else 1) for k in range(360)]
    tracks = spark.createDataFrame(rows, "video_id string, axis string, landmark int, frame_idx int, value double")
    truth = spark.createDataFrame([("v", float(t), 72.0) for t in range(12)], "video_id string, t double, bpm double")
    spec = dataclasses.replace(parse(SPEC), videos=None, window=8.0, stride=1.0, approach="holistic", estimate="clustering", movement_thrs=None)
    spec = dataclasses.replace(spec, methods=tuple(m for m in spec.methods if m.name.upper().endswith("CHROM"))[:1] or spec.methods[:1])
    got = [pipeline.run(rgb, truth, 30.0, dataclasses.replace(spec, movement_thrs=thrs), tracks).first().MAE for thrs in (None, (1e9,) * 3, (-1.0,) * 3)]
    assert got[0] == got[1] < 3 < got[2]


def test_stream_joined_late(spark, tmp_path):
    frames = traces(spark, seconds=9.0).filter("frame_idx >= 70")
    frames.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = realtime.rates(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in")), realtime.Live(filter_signal=False)).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    assert [r.frame_idx for r in spark.table("late").orderBy("frame_idx").collect()] == [269]


@pytest.mark.parametrize("n,size,stride,fps", [(300, 8, 1, 30.0), (239, 8, 1, 30.0), (2500, 3, 0.5, 29.97), (700, 2.5, 0.7, 12.5), (3, 8, 1, 30.0)])
def test_window_arrays_equal_frame_windows(spark, n, size, stride, fps):
    df = spark.range(n).selectExpr("id % 2 video_id", "CAST(id DIV 2 AS INT) frame_idx", "id * 1.5 g", "'x' other").filter("frame_idx % 50 <> 7 OR video_id = 0").repartition(5)
    for keep in (False, True):
        got = windows.window_arrays(df, fps, size, stride, ("video_id",), ("g",), keep).collect()
        want = windows.frame_windows(df, fps, size, stride, ("video_id",), keep).groupBy("video_id", "win_idx", "t_center").agg(F.array_sort(F.collect_list(F.struct("win_pos", "g"))).alias("x")).collect()
        assert sorted((r.video_id, r.win_idx, r.t_center, r.g) for r in got) == sorted((r.video_id, r.win_idx, r.t_center, [x.g for x in r.x]) for r in want)
        assert not got or all(isinstance(r.win_idx, int) for r in got)
