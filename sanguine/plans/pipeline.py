"""From traces to rates to errors: the plans that string the operators together."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dsp
from ..operators import align, filters, metrics, pulse, windows
from .config import JobSpec, MethodSpec


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset (tests) one in the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that what is read more than once is worked out once."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/signals-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def windowed(rgb: DataFrame, fps: float, window: float = 8.0, stride: float = 1.0) -> DataFrame:
    """rgb_signal (video_id, estimator_id, frame_idx, r, g, b) as windows of arrays: one shuffle serves all methods."""
    return windows.window_arrays(rgb, fps, window, stride)


def signals(wins: DataFrame, fps: float, method: MethodSpec, gate: tuple[float, float] | None = None) -> DataFrame:
    """Pulse signals of one method: colour gate, filters before, method, filters after."""
    rows = filters.estimator_gate(wins, *gate) if gate else wins
    for step in method.pre:
        rows = pulse.apply_filter(rows, step.name, fps, step.params)
    bvps = pulse.to_bvp(rows, method.name, fps, method.params.get("component", "second_comp"))
    for step in method.post:
        bvps = pulse.apply_filter(bvps, step.name, fps, step.params, ("bvp",))
    return filters.valid_bvp(bvps.filter("bvp IS NOT NULL"))


def estimates(bvps: DataFrame, fps: float, estimate: str = "holistic", min_hz: float = 0.65, max_hz: float = 4.0, motion: DataFrame | None = None, thresholds: dict[str, float] | None = None, overlap: float = 0.8) -> DataFrame:
    """(video_id, method, win_idx, t, bpm, mad) of windowed signals."""
    if estimate == "clustering":
        spectra = pulse.psd(bvps, fps, min_hz, max_hz, overlap=overlap)
        if motion is not None and thresholds:
            spectra = pulse.attenuated(spectra, motion, thresholds)
        return pulse.clustered_rates(spectra, pulse.band_freqs(fps, min_hz, max_hz)).select("video_id", "method", "win_idx", F.col("t_center").alias("t"), "bpm", F.lit(None).cast("double").alias("mad"))
    return pulse.median_rates(pulse.psd_rates(bvps, fps, min_hz, max_hz, overlap)).select("video_id", "method", "win_idx", F.col("t_center").alias("t"), "bpm", "mad")


def window_motion(tracks: DataFrame, fps: float, spec: JobSpec) -> DataFrame:
    """(video_id, win_idx, axis, atten, energy) of landmark tracks, in the windows and the band of the specification."""
    if spec.videos is not None:
        tracks = tracks.filter(F.col("video_id").isin(*spec.videos))
    wins = windows.window_arrays(tracks, fps, spec.window, spec.stride, ("video_id", "axis", "landmark"), ("value",))
    moved = pulse.motion_filter(wins.select("video_id", "win_idx", "axis", F.col("value").alias("track")), fps, spec.min_hz, spec.max_hz)
    return written(moved)


def run(rgb: DataFrame, truth: DataFrame, fps: float, spec: JobSpec, tracks: DataFrame | None = None) -> DataFrame:
    """Videos x methods -> metrics, as result rows (method, dataset, video_id, RMSE, MAE, MAX, PCC, CCC, SNR).

    truth: (video_id, t, bpm). Windows are made once and get their true rates before the methods, so one pass over them gives all
    methods' rates and signal-to-noise ratios; only these numbers are written to the shared folder, since errors and SNR read them.
    Clustering, and filters that are column functions, go by `run_by_signals`.

    tracks: (video_id, axis in x, y, z, landmark, frame_idx, value), the landmarks' places. With them and movement_thrs in the
    specification, clustering attenuates the spectra of windows whose motion is over an axis's threshold.
    """
    if spec.videos is not None:
        rgb = rgb.filter(F.col("video_id").isin(*spec.videos))
    chains = [pulse.chain(m.name, fps, m.params.get("component", "second_comp"), *([(s.name, s.params) for s in own] for own in (m.pre, m.post))) for m in spec.methods]
    if spec.estimate == "clustering" or None in chains:
        return run_by_signals(rgb, truth, fps, spec, tracks)
    times = windows.window_times(rgb, fps, spec.window, spec.stride).select("video_id", "win_idx", F.col("t_center").alias("t"), F.lit(None).cast("double").alias("bpm")).distinct()
    true = align.nearest(times, truth).select("video_id", "win_idx", "bpm_gt")
    wins = windows.window_arrays(rgb, fps, spec.window, spec.stride, beside=true)
    if spec.approach == "patches":
        wins = filters.estimator_gate(wins, spec.rgb_low, spec.rgb_high)
    freqs, decibels = pulse.band_freqs(fps, spec.min_hz, spec.max_hz), metrics.snr_of(fps)
    numbers = {
        "bpm": lambda x, _: pulse.strongest(dsp.welch(x, fps, spec.min_hz, spec.max_hz)[1], freqs),
        "snr": lambda x, column: decibels(x, column("bpm_gt").cast("double").to_numpy(zero_copy_only=False)),
    }
    got = written(pulse.measured(wins, chains, fps, numbers))
    es = pulse.median_rates(got, ("video_id", "method", "win_idx", "t_center", "bpm_gt"))
    errors = metrics.errors(es.withColumn("diff", F.col("bpm_gt") - F.col("bpm")))
    return errors.join(metrics.mean_snr(got), ["video_id", "method"], "left").withColumn("dataset", F.lit(spec.dataset))


def run_by_signals(rgb: DataFrame, truth: DataFrame, fps: float, spec: JobSpec, tracks: DataFrame | None = None) -> DataFrame:
    """run for any estimate and filters: each method adds a projection of the windows, and all methods' estimates meet the truth in one alignment.

    Signals and aligned rates are written to the shared folder, since rates, errors and SNR all read them.
    """
    wins = windowed(rgb, fps, spec.window, spec.stride)
    gate = (spec.rgb_low, spec.rgb_high) if spec.approach == "patches" else None
    bvps = None
    for m in spec.methods:
        own = signals(wins, fps, m, gate).select("video_id", "estimator_id", "output", "win_idx", "t_center", "method", "bvp")
        bvps = own if bvps is None else bvps.unionByName(own)
    bvps = written(bvps)
    motion = None
    if spec.estimate == "clustering" and spec.movement_thrs and tracks is not None:
        motion = window_motion(tracks, fps, spec)
    es = estimates(bvps, fps, spec.estimate, spec.min_hz, spec.max_hz, motion, spec.thresholds)
    aligned = written(align.nearest(es, truth))
    errors = metrics.errors(aligned)
    at = aligned.select("video_id", "method", "win_idx", "bpm_gt")
    loud = metrics.snr(bvps, at.groupBy("video_id", "win_idx").agg(F.first("bpm_gt").alias("bpm_gt")), fps)
    return errors.join(loud, ["video_id", "method"], "left").withColumn("dataset", F.lit(spec.dataset))
