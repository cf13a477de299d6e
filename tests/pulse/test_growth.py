"""Steps whose cost a row must not follow what lies around it, or what leaves a task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sanguine import queries
from sanguine.functions import batches, bvp, dsp
from sanguine.operators import align, metrics, pulse, windows
from sanguine.plans import pipeline
from sanguine.plans.config import parse

from .test_size import SF, plan


def test_frames_find_their_blocks_without_lambdas(spark):
    assert "lambdafunction" not in plan(queries.wins(spark, SF)).split("Generate explode(sequence(__low")[1]


@pytest.mark.parametrize("fps,size,stride", [(10.0, 8.0, 1.0), (29.97, 3.0, 0.5), (12.5, 2.5, 0.7), (7.0, 40.0, 0.5), (1.0, 3.0, 0.01)])
def test_frames_lie_in_all_their_blocks(spark, fps, size, stride):
    step, width = stride * fps, int(np.ceil(size * fps))
    frames = spark.range(900).selectExpr("1 video_id", "CAST(id AS INT) frame_idx")
    got = {(r.block, x.frame_idx) for r in windows._blocks(frames, step, width, ("video_id",), ()).selectExpr("__block block", "__rows").collect() for x in r[1]}
    span = windows.BLOCK * step
    first, end = (lambda k: np.floor(k * span)), (lambda k: np.floor((k * windows.BLOCK + windows.BLOCK - 1) * step) + width)
    assert got == {(k, f) for f in range(900) for k in range(int(900 / span) + 2) if first(k) <= f < end(k)}


def test_nearest_passes_a_keys_rows_once_each_way(spark):
    rng = np.random.default_rng(8)
    es = spark.createDataFrame([(int(v), float(t), float(k)) for k, (v, t) in enumerate(rng.integers(0, 40, (300, 2)) * [0, 1] + rng.integers(0, 3, (300, 1)) * [1, 0])], "video_id int, t double, bpm double")
    gt = spark.createDataFrame([(int(v), float(t), float(b)) for v, t, b in rng.integers(0, 40, (60, 3)) * [0, 1, 1] + rng.integers(0, 2, (60, 1)) * [1, 0, 0]], "video_id int, t double, bpm double")
    got = align.nearest(es, gt)
    assert "unboundedfollowing" not in plan(got)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, align.nearest_small(es, gt).select(got.columns).collect()), key=str)


def test_pos_by_moments_equals_the_windows():
    x = np.random.default_rng(9).normal(100, 3, (60, 3, 80))
    x[7] = 5.0
    x[8, :, 20:50] = 0.0
    x[9, 1, 30:60] = 90.0
    x[10, 2, 0] = np.nan
    x[11] = 100 + 1e-7 * x[11]
    x[12, 0, 40] = np.nan
    got, want = bvp.pos(x, 10.0), bvp._overlap_added(x, 16, 1e-9)
    assert np.allclose(got, want, rtol=1e-7, atol=1e-8, equal_nan=True) and np.isfinite(got[10]).all() and np.isnan(got[12]).any()
    assert bvp._by_moments(x, 16, 1e-9)[1].sum() >= 50


def test_windows_of_several_lengths_and_outputs():
    x = np.random.default_rng(10).normal(100, 3, (5, 3, 80))
    lengths = [80, 70, 80, 70, 80]
    cols = [batches.lists(5, [(np.array([k]), x[k : k + 1, c, :n]) for k, n in enumerate(lengths)]) for c in range(3)]
    x[2, 1, 3] = np.nan
    of, output, made = pulse._signals_of(lambda b: b[:, :2].reshape(-1, b.shape[2]), *cols)
    assert of.tolist() == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4] and output.tolist() == [0, 1] * 5
    assert all(np.allclose(v, x[k // 2, k % 2, : lengths[k // 2]]) for k, v in enumerate(made.to_pylist()) if k // 2 != 2)


def test_one_pass_equals_the_written_signals(spark):
    df = queries.rgb(spark, SF)
    truth, spec = pulse.truth_rates(queries._whole(spark, SF)), parse(queries.SPEC)
    got, want = ({(r.video_id, r.method): [r[c] for c in ("RMSE", "MAE", "MAX", "PCC", "CCC", "SNR")] for r in f(df, truth, 10.0, spec).collect()} for f in (pipeline.run, pipeline.run_by_signals))
    assert got.keys() == want.keys() and want and all(np.allclose(np.array(got[k], float), np.array(want[k], float), atol=1e-6, equal_nan=True) for k in want)


def test_spectra_stay_in_their_task(spark):
    assert "array<double>" not in pulse.psd_rates(pulse.to_bvp(queries.wins(spark, SF), "CHROM", 10.0).select("win_idx", "bvp"), 10.0)._jdf.schema().simpleString()
    rows = spark.createDataFrame([(0, np.sin(np.arange(80.0)).tolist()), (1, None), (2, [1.0] * 80)], "id int, bvp array<double>")
    freqs = pulse.band_freqs(10.0)
    got, want = ({r.id: r.bpm for r in x.collect()} for x in (pulse.psd_rates(rows, 10.0), pulse.rates(pulse.psd(rows, 10.0), freqs)))
    assert got == want and got[1] is None


@pytest.mark.parametrize("n,fs", [(600, 50.0), (61, 10.0), (2000, 125.0)])
def test_peaks_by_few_passes_equal_the_plain_way(n, fs):
    x = np.random.default_rng(n).normal(0, 1, n).round(1)
    y = dsp.bandpass(x[None], fs, 5.0, min(15.0, 0.45 * fs), 2)[0] if 0.45 * fs > 5 else x
    energy = np.convolve(np.gradient(y) ** 2, np.ones(max(1, int(0.15 * fs))), "same")
    reach, gap = int(2 * fs), int(0.3 * fs)
    around = np.lib.stride_tricks.sliding_window_view(np.pad(energy, reach, constant_values=-np.inf), 2 * reach + 1)
    assert (dsp._running_max(energy, reach) == around.max(1)).all()
    out, free = [], np.ones(n, bool)
    for k in (order := np.argsort(-energy, kind="stable"))[~(energy[order] < 0.3 * around.max(1)[order])]:
        if free[k]:
            free[max(0, k - gap) : k + gap + 1] = False
            out.append(int(k))
    assert dsp._apart(energy, np.flatnonzero(~(energy < 0.3 * around.max(1))), gap) == out


def test_signals_of_many_lengths_are_filtered_together():
    rng = np.random.default_rng(11)
    xs = [rng.normal(0, 1, n) for n in (600, 601, 64, 580, 130, 16)]
    xs[3][5] = np.nan
    b, a = dsp.butter_bandpass(5.0, 15.0, 50.0, 2)
    for got, x in zip(dsp.filtfilt_many(b, a, xs), xs, strict=True):
        assert np.allclose(got, dsp._filtfilt(b, a, x[None])[0], atol=1e-9, equal_nan=True)
    with pytest.raises(ValueError):
        dsp.filtfilt_many(b, a, [xs[0], xs[0][:15]])


def test_shapes_of_united_methods_are_checked_from_the_rows_shuffle(spark):
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("united"))
    wins = queries.wins(spark, SF)
    spark.sparkContext.setJobGroup("united", "")
    rows = pulse.united_methods(wins, ["GREEN", "OMIT"], 10.0)
    assert not jobs() and rows.collect() and "ReusedExchange" in plan(rows)
    black = spark.createDataFrame([(1, 0, 0, 4.0, [0.0, 1.0], [0.0, 1.0], [0.0, 1.0])], "video_id int, estimator_id int, win_idx int, t_center double, r array<double>, g array<double>, b array<double>")
    with pytest.raises(Exception, match="the methods differ"):
        pulse.united_methods(black, ["GREEN", "OMIT"], 10.0).collect()
