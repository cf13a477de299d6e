"""Comparison of methods over datasets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Smaller is better for these; larger for all others.
ASCENDING = ("MAE", "RMSE", "MAX")
#: Critical values of the two-tailed Nemenyi test at 0.05 for 2 to 10 methods (Demsar, 2006, table 5); fixed values.
Q_05 = (1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164)


def chosen(results: DataFrame, methods: list[str] | None, metric: str) -> DataFrame:
    """(dataset, method, value) with a value; device prefixes are stripped from the names."""
    name = F.regexp_replace("method", "^(?i)(cupy_|cpu_|torch_)", "")
    rows = results.select("dataset", name.alias("method"), F.col(metric).cast("double").alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return rows.filter(F.col("method").isin(*methods)) if methods else rows


def common_methods(results: DataFrame) -> DataFrame:
    """Methods that every dataset has, in order."""
    n = results.agg(F.count_distinct("dataset").alias("n"))
    return results.groupBy("method").agg(F.count_distinct("dataset").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("method").orderBy("method")


def repeated_names(results: DataFrame) -> DataFrame:
    """(dataset, method, n) that occur for more than one configuration of a video."""
    return results.groupBy("dataset", "videoIdx", "method").agg(F.count("*").alias("n")).filter("n > 1")


def medians(rows: DataFrame, by: tuple[str, ...] = ("dataset", "method")) -> DataFrame:
    """(by, median, iqr)."""
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy(*by).agg(q.alias("q")).select(*by, F.get("q", F.lit(1)).alias("median"), (F.get("q", F.lit(2)) - F.get("q", F.lit(0))).alias("iqr"))


def pivoted(rows: DataFrame, methods: list[str]) -> DataFrame:
    """Dataset by method matrix of medians."""
    return rows.groupBy("dataset").pivot("method", methods).agg(F.median("value"))


def details(results: DataFrame, metric: str) -> DataFrame:
    """(dataset, video, method, value): the metric's mean by video and method, device prefixes stripped."""
    name = F.regexp_replace("method", "^(?i)(cupy_|cpu_|torch_)", "")
    return results.groupBy("dataset", F.col("videoIdx").alias("video"), name.alias("method")).agg(F.avg(F.col(metric).cast("double")).alias("value"))


def frame_timing(frames: DataFrame, key: str = "video_id", t: str = "t", last: int = 100) -> DataFrame:
    """(key, mean, median, high, low) of the gaps between successive times, over a key's last `last` frames."""
    own = Window.partitionBy(key)
    gaps = frames.select(key, t).withColumn("__gap", F.col(t) - F.lag(t).over(own.orderBy(t))).withColumn("__k", F.row_number().over(own.orderBy(F.desc(t))))
    return gaps.filter(F.col("__k") <= last).groupBy(key).agg(F.avg("__gap").alias("mean"), F.median("__gap").alias("median"), F.max("__gap").alias("high"), F.min("__gap").alias("low"))


def values_by_method(rows: DataFrame) -> DataFrame:
    return rows.groupBy("method").agg(F.sort_array(F.collect_list("value")).alias("values"))


def box_plot(rows: DataFrame) -> DataFrame:
    """(method, q0, q1, q2, q3, q4)."""
    q = F.percentile("value", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return rows.groupBy("method").agg(q.alias("q")).select("method", *[F.get("q", F.lit(k)).alias(f"q{k}") for k in range(5)])


def average_ranks(rows: DataFrame, metric: str) -> DataFrame:
    """(method, avg_rank, n): ranks of the methods' medians within each dataset, equal ones averaged, then averaged over datasets."""
    med = rows.groupBy("dataset", "method").agg(F.median("value").alias("m"))
    order = F.col("m").asc() if metric in ASCENDING else F.col("m").desc()
    same = Window.partitionBy("dataset", "m")
    ranked = med.withColumn("r", F.rank().over(Window.partitionBy("dataset").orderBy(order))).withColumn("r", F.col("r") + (F.count("*").over(same) - 1) / 2)
    return ranked.groupBy("method").agg(F.avg("r").alias("avg_rank"), F.count("*").alias("n"))


def chi2_tail(x: float, dof: int) -> float:
    """Probability of a chi-square value of x or more, from its finite sums for whole degrees of freedom."""
    if x <= 0:
        return 1.0
    h = x / 2
    if dof % 2 == 0:
        term, out = math.exp(-h), 0.0
        for k in range(dof // 2):
            out += term
            term *= h / (k + 1)
        return out
    out, term = math.erfc(math.sqrt(h)), math.exp(-h) * math.sqrt(h) / math.gamma(1.5)
    for k in range(dof // 2):
        out += term
        term *= h / (k + 1.5)
    return out


def range_tail(q: float, k: int) -> float:
    """Probability that k standard normal values lie q or more apart (the studentised range, endless degrees of freedom)."""
    z = np.linspace(-9.0, 9.0, 3601)
    below = lambda x: 0.5 * np.array([math.erfc(-v / math.sqrt(2)) for v in x])
    inside = k * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (below(z) - below(z - q)) ** (k - 1)
    return float(min(1.0, max(0.0, 1 - np.trapezoid(inside, z))))


def _tail(function):
    return F.pandas_udf(lambda x, k: pd.Series([function(float(a), int(b)) for a, b in zip(x, k, strict=True)], dtype=float), "double")


def friedman(ranks: DataFrame) -> DataFrame:
    """One row (k, n, chi2, f, p): Friedman's statistic of complete ranks, Iman and Davenport's correction (NULL where it has no
    value) and the probability of chi2 or more with k - 1 degrees of freedom."""
    s = ranks.agg(F.count("*").alias("k"), F.max("n").alias("n"), F.sum(F.col("avg_rank") * F.col("avg_rank")).alias("r2"))
    chi2 = 12 * F.col("n") / (F.col("k") * (F.col("k") + 1)) * (F.col("r2") - F.col("k") * (F.col("k") + 1) * (F.col("k") + 1) / 4)
    out = s.select("k", "n", chi2.alias("chi2")).withColumn("f", F.try_divide((F.col("n") - 1) * F.col("chi2"), F.col("n") * (F.col("k") - 1) - F.col("chi2")))
    return out.withColumn("p", _tail(chi2_tail)("chi2", F.col("k") - 1))


def _critical(k: int) -> float:
    """The table's value up to 10 methods, beyond them the range's own 5 % point over the root of 2, by bisection."""
    if k <= len(Q_05) + 1:
        return Q_05[k - 2]
    lo, hi = 0.0, 20.0
    while hi - lo > 1e-6:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if range_tail(mid, k) > 0.05 else (lo, mid)
    return hi / math.sqrt(2)


def critical_difference(k: int, n: int) -> float:
    """Nemenyi's at 0.05."""
    return _critical(k) * math.sqrt(k * (k + 1) / (6 * n))


def nemenyi_pairs(ranks: DataFrame) -> DataFrame:
    """(a, b, gap, differ, p) for each pair of methods, of any number of them: whether their average ranks part by more than the
    critical difference at 0.05, and the probability of such a gap. A handful of rows, joined by inequality."""
    own = ranks.agg(F.count("*").alias("k"), F.max("n").alias("__n")).withColumn("__se", F.sqrt(F.col("k") * (F.col("k") + 1) / (6 * F.col("__n"))))
    limit = F.pandas_udf(lambda k: k.map(lambda v: _critical(int(v)) if v > 1 else None).astype(float), "double")
    own = own.select("k", "__se", (limit("k") * F.col("__se")).alias("__cd"))
    a, b = (ranks.select(F.col("method").alias(x), F.col("avg_rank").alias(f"r{x}")) for x in "ab")
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b")).crossJoin(F.broadcast(own)).withColumn("gap", F.abs(F.col("ra") - F.col("rb")))
    return pairs.select("a", "b", "gap", (F.col("gap") > F.col("__cd")).alias("differ"), _tail(range_tail)(F.col("gap") / F.col("__se") * math.sqrt(2), "k").alias("p"))
