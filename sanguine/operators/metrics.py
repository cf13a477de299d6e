"""Error metrics of aligned series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batches, dsp


def rmse(d: str = "diff") -> Column:
    return F.sqrt(F.avg(F.col(d) * F.col(d)))


def mae(d: str = "diff") -> Column:
    return F.avg(F.abs(d))


def max_error(d: str = "diff") -> Column:
    return F.max(F.abs(d))


def pearson(x: str, y: str) -> Column:
    """NULL for a constant series."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def concordance(x: str, y: str) -> Column:
    """Lin's coefficient with population moments; NULL for a constant series."""
    both = 2 * F.covar_pop(x, y)
    return F.when(F.stddev_pop(x) * F.stddev_pop(y) > 0, F.try_divide(both, F.var_pop(x) + F.var_pop(y) + F.pow(F.avg(x) - F.avg(y), 2)))


def errors(aligned: DataFrame, keys: tuple[str, ...] = ("video_id", "method"), es: str = "bpm", gt: str = "bpm_gt") -> DataFrame:
    """(keys, RMSE, MAE, MAX, PCC, CCC) in one aggregation of aligned rows."""
    return aligned.groupBy(*keys).agg(rmse().alias("RMSE"), mae().alias("MAE"), max_error().alias("MAX"), pearson(gt, es).alias("PCC"), concordance(gt, es).alias("CCC"))


def snr_of(fps: float, tolerance: float = 12.0):
    """A function of signals (rows, time) and their true rates (rows): 10 log10 of the power around the rate and its double over the rest."""
    nfft = int(np.ceil(120 * fps / 2 / 0.5))
    freqs = dsp.welch(np.zeros((1, 64)), fps, nfft=nfft)[0]
    return lambda x, rate: dsp.snr_db(dsp.welch(x, fps, nfft=nfft)[1], freqs, rate[:, None], tolerance)


def mean_snr(rows: DataFrame, keys: tuple[str, ...] = ("video_id", "method"), value: str = "snr") -> DataFrame:
    """(keys, SNR): mean over windows of the estimators' median."""
    return rows.groupBy(*keys, "win_idx").agg(F.median(value).alias("__m")).groupBy(*keys).agg(F.avg("__m").alias("SNR"))


def snr(bvps: DataFrame, truth: DataFrame | None, fps: float, keys: tuple[str, ...] = ("video_id", "method"), tolerance: float = 12.0) -> DataFrame:
    """(keys, SNR): mean over windows of the estimators' median of 10 log10 of the power around the true rate and its double over the rest.

    truth: (video_id, win_idx, bpm_gt), the true rate of each window; align it by time or by position beforehand. None: bvps have bpm_gt.
    """
    decibels = snr_of(fps, tolerance)
    names = [*keys, "win_idx"]

    def run(parts):
        for b in batches.pieces(parts):
            out, rate = np.full(b.num_rows, np.nan), b.column("bpm_gt").cast(pa.float64()).to_numpy(zero_copy_only=False)
            for at, x in batches.blocks(b.column("bvp")):
                out[at] = decibels(x, rate[at])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, from_pandas=True)], names=[*names, "__snr"])

    known = bvps if truth is None else bvps.join(truth.select("video_id", "win_idx", "bpm_gt"), ["video_id", "win_idx"])
    types = {f.name: f.dataType.simpleString() for f in known.schema}
    rows = known.select(*names, "bvp", "bpm_gt").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names) + ", __snr double")
    return mean_snr(rows, keys, "__snr")


def psnr(a: str, b: str) -> Column:
    """10 log10 of 1 over the mean square difference, for values in [0, 1]; NULL for equal series."""
    d = F.col(a) - F.col(b)
    return 10 * F.log10(F.try_divide(F.lit(1.0), F.avg(d * d)))


def summary(results: DataFrame, metrics: list[str], by: str = "method") -> DataFrame:
    """(by, metric, mean, sd, median) of each metric."""
    rows = results.select(by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select(by, "x.*")
    return rows.groupBy(by, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.median("value").alias("median"))
