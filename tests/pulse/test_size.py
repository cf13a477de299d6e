"""What is held at once, and how work is dealt, doesn't follow the size of the input."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from sanguine import queries
from sanguine.functions import batches, bvp, circle, dsp
from sanguine.operators import align, extraction, pulse
from sanguine.sources import signals

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_numpy_gets_few_rows_at_once(spark):
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "array(CAST(id AS DOUBLE), 1D) x")
    got = pulse.ArrayFunction(lambda x: np.full((len(x), 1), float(len(x)))).over(rows, {"n": "x"})
    assert got.selectExpr("max(n[0])").first()[0] <= batches.ROWS and got.count() == 3000


@pytest.mark.parametrize("made", [pulse.causal_bandpass(10.0, 0.8, 4.0), pulse.detrend(100.0, True)])
def test_a_tasks_memory_does_not_follow_its_rows(spark, made):
    def own_mb(x):
        made.function(x)
        return np.full((len(x), 1), next(int(line.split()[1]) for line in open("/proc/self/status") if line.startswith("RssAnon")) / 1024)

    rows = spark.range(0, 200_000, 1, 1).selectExpr("id", "transform(sequence(0, 79), k -> CAST((id * 7 + k * k) % 101 AS DOUBLE)) x")
    got = pulse.ArrayFunction(own_mb).over(rows, {"x": "x"}).groupBy((F.col("id") >= 20_000).alias("late")).agg(F.max(F.col("x")[0]).alias("mb"))
    peak = {r.late: r.mb for r in got.collect()}
    assert peak[True] < peak[False] + 40  # the later rows alone have 115 MB


def test_lengths_nulls_and_short_signals(spark):
    rows = spark.createDataFrame([(0, [1.0, None]), (1, None), (2, [3.0]), (3, []), (4, [5.0, 6.0])], "id int, x array<double>")

    def double(x):
        if not x.shape[1]:
            raise ValueError("too short")
        return 2 * x

    got = {r.id: r.x for r in pulse.ArrayFunction(double).over(rows, {"x": "x"}).collect()}
    assert got == {0: [2.0, None], 1: None, 2: [6.0], 3: None, 4: [10.0, 12.0]}


@pytest.mark.parametrize("order", [2, 6])
def test_filters_by_products_equal_filters_by_steps(order):
    b, a = dsp.butter_bandpass(0.65, 4.0, 10.0, order)
    x, z = np.random.default_rng(1).normal(40, 9, (5, 300)), np.random.default_rng(2).normal(0, 1, (5, len(a) - 1))
    for got, want in zip(dsp.lfilter_on(b, a, x, z), dsp._one_by_one(b, a, x, z), strict=True):
        assert np.abs(got - want).max() < 1e-8
    assert np.abs(dsp.filtfilt(b, a, x[:, :90]) - dsp._filtfilt(b, a, x[:, :90])).max() < 1e-8


def test_welch_equals_the_transform():
    x = np.random.default_rng(3).normal(0, 1, (4, 80))
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(80) / 80)
    f = (np.arange(1025) * 10.0 / 2048).astype(np.float32)
    want = 2 * np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * hann, 2048)) ** 2 / (10 * (hann**2).sum())
    assert np.allclose(dsp.welch(x, 10.0)[1], want[:, (f > 0.65) & (f < 4.0)], rtol=1e-9, atol=1e-12)


def test_mixtures_are_unmixed_together_as_alone():
    x = np.random.default_rng(4).laplace(0, 1, (40, 3, 80))
    assert np.allclose(bvp.ica(x, "all_comp"), np.concatenate([bvp.jade(s) @ s for s in x]), rtol=1e-9, atol=1e-9)


def test_clustering_holds_no_table_of_distances():
    power = np.random.default_rng(5).random((1500, 12)) ** 3
    power[7] = 0
    same = circle.angles(circle.cosine_distances(power[:200]), 6)
    assert np.allclose(circle.angles_of(power[:200], 6), same, atol=1e-6)
    tracemalloc.start()
    circle.estimate(power, np.arange(12.0), 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1500 * 1500 * 8 / 4


def test_plans_of_the_queries(spark):
    exchanges = lambda df: plan(df).count("Exchange hashpartitioning")
    windows = exchanges(queries.wins(spark, SF))
    for name in ("M16_motion_filter", "B04_pbv", "M07_M09_welch"):
        assert exchanges(queries.QUERIES[name](spark, SF)) == windows, name
    assert "CoGroup" not in plan(queries.f05(spark, SF)) and "FlatMapGroups" not in plan(queries.s19(spark, SF))
    assert "BatchEvalPython" in plan(queries.s10_files(spark, SF))


def test_frames_are_numbered_once_for_windows(spark):
    df = queries.wins(spark, SF)
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_one_folder_is_paired_by_many_tasks(spark):
    v = spark.range(3000).selectExpr("concat('d/v', id) path")
    s = spark.range(2000).selectExpr("concat('d/s', id) path")
    got = align.paired_files(v, s)
    per = [r.n for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(per) == 6_000_000 and max(per) < 6_000_000


def test_a_folders_files_are_sent_a_bounded_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(align, "SIDE", 4)
    v = spark.range(800).selectExpr("concat('d/v', id) path")
    s = spark.range(50).selectExpr("concat('d/s', id) path")
    sides = align._dealt(v.selectExpr("path", "'d' folder"), s.selectExpr("path", "'d' folder"), ("folder",), "path", "path")
    assert [x.count() for x in sides] == [800 * 4, 50 * 62]  # by blocks of 4 rows a side 800 x 13 and 50 x 200
    got = align.paired_files(v, s)
    assert got.count() == got.distinct().count() == 40_000
    assert "SortMergeJoin" in plan(got)


def test_pairs_of_a_window_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(align, "SIDE", 7)
    x = np.random.default_rng(7).normal(size=(40, 5)).round(3)
    x[3] = 0
    rows = spark.createDataFrame([(k % 2, k, v.tolist()) for k, v in enumerate(x)], "w int, estimator_id int, power array<double>")
    got = {(r.w, r.i, r.j): r.distance for r in align.cosine_pairs(rows, ("w",)).collect()}
    unit = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=x.any(1, keepdims=True))
    want = {(a % 2, a, b): 0.0 if a == b or 3 in (a, b) else max(1 - unit[a] @ unit[b], 0.0) for a in range(40) for b in range(40) if a % 2 == b % 2}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_windows_rows_are_sent_a_bounded_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(align, "SIDE", 4)
    rows = spark.range(800).selectExpr("id", "CAST(IF(id < 700, 1, 2) AS INT) w", "array(CAST(1 + id % 7 AS FLOAT), CAST(id % 5 AS FLOAT), 0.5F) x")
    met = align._met(rows, ("w",), "id").groupBy("w", "__i", "__j").agg(F.collect_set("id").alias("ids")).collect()
    assert sum(len(r.ids) for r in met) == 700 * 16 + 100 * 15  # by blocks of 4 rows a side 700 x 2 x 175 alone
    alone = {(r.w, r["__i"]): set(r.ids) for r in met if r["__i"] == r["__j"]}
    assert all(set(r.ids) == alone[r.w, r["__i"]] | alone[r.w, r["__j"]] for r in met) and len(met) == 16 * 17 / 2 + 15 * 16 / 2
    got = align.cosine_pairs(rows.withColumnRenamed("id", "estimator_id"), ("w",), vector="x")
    wide = align.cosine_pairs(rows.selectExpr("id estimator_id", "w", "CAST(x AS array<double>) x"), ("w",), vector="x")
    assert got.count() == got.select("w", "i", "j").distinct().count() == 700 * 700 + 100 * 100
    assert got.join(wide.withColumnRenamed("distance", "d"), ["w", "i", "j"]).filter("abs(distance - d) < 1e-12").count() == 500_000


def test_hulls_of_frames(spark):
    px = spark.createDataFrame([(1, 0, y, x) for y in range(6) for x in range(6)] + [(2, 0, 1, 1)], "video_id int, frame_idx int, y int, x int")
    at = {1: (0, 0), 2: (0, 5), 3: (5, 5), 4: (5, 0), 5: (2, 2), 6: (2, 3), 7: (3, 3), 8: (3, 2)}
    ld = spark.createDataFrame([(1, 0, k, *v) for k, v in at.items()], "video_id int, frame_idx int, ldmk_id int, y int, x int")
    got = {(r.y, r.x) for r in extraction.hull_mask(px, ld, [1, 2, 3, 4], {"mouth": [5, 6, 7, 8], "eye": [1, 2, 3]}).collect()}
    assert got == {(y, x) for y in range(6) for x in range(6)} - {(y, x) for y in (2, 3) for x in (2, 3)}


def test_unreadable_files_keep_their_rows(spark):
    raw = spark.createDataFrame([("a", b"5\n6\n"), ("b", b"x")], "path string, content binary")
    got = {r.path: (r.fs, r.signal, r.error is None) for r in signals.signals_of(raw, "UBFC_PHYS").collect()}
    assert got == {"a": (64.0, [5.0, 6.0], True), "b": (None, None, False)}
