import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from sanguine.functions import tails
from sanguine.operators import bayes, hypothesis


def test_tails_have_the_tables_values():
    assert tails.f_tail(3.0984, 3, 20) == pytest.approx(0.05, abs=1e-5)
    assert tails.f_tail(161.4476, 1, 1) == pytest.approx(0.05, abs=1e-6)
    assert tails.f_tail(0, 3, 4) == 1 and tails.f_tail(1e9, 2, 30) < 1e-30
    for q, k, dof in ((3.877, 3, 10), (3.151, 2, 10), (4.232, 5, 20), (3.858, 5, math.inf), (2.772, 2, math.inf), (17.97, 2, 1)):
        assert tails.studentised_tail(q, k, dof) == pytest.approx(0.05, abs=2e-4), (q, k, dof)
    assert tails.signed_rank_tail(0, 5) == pytest.approx(2 / 32)
    assert tails.signed_rank_tail(3, 6) == pytest.approx(2 * 5 / 64)
    assert tails.signed_rank_tail(52, 20) == pytest.approx(0.05, abs=2e-3)
    assert tails.signed_rank_tail(7.5, 5) == 1 and tails.signed_rank_tail(0, 0) == 1


def test_normal_quantile(spark):
    p = [1e-300, 1e-12, 0.001, 0.0749, 0.0751, 0.3, 0.5, 0.8, 0.925, 1 - 1e-9]
    rows = spark.createDataFrame([(x,) for x in [*p, 0.0, 1.0, None]], "p double").select("p", tails.normal_quantile(F.col("p")).alias("z")).collect()
    for r in rows:
        if r.p in (None, 0.0, 1.0):
            assert r.z is None
        else:
            assert r.z == pytest.approx(statistics.NormalDist().inv_cdf(r.p), rel=1e-12, abs=1e-12)


def frame(spark, sets):
    rows = [(s, f"b{i}", m, float(v)) for s, methods in sets.items() for m, values in methods.items() for i, v in enumerate(values)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "set string, block string, method string, value double").repartition(3)


@pytest.fixture(scope="module")
def sets():
    rng = np.random.default_rng(5)
    base = rng.normal(10, 1, 30)
    bell = np.array([statistics.NormalDist().inv_cdf((i + 0.5) / 30) for i in range(30)])
    return {
        "bells": {m: rng.permutation(bell) + k + base for k, m in enumerate("pqr")},
        "wide": {m: rng.permutation(bell) * (1 + 20 * k) for k, m in enumerate("pqr")},
        "skewed": {m: np.exp(2 * rng.permutation(bell)) + 3 * k for k, m in enumerate("pqr")},
        "two": {"p": rng.permutation(bell), "q": rng.permutation(bell) * 9 + 5},
        "two skewed": {"p": np.exp(3 * bell), "q": np.exp(3 * bell[::-1]) + 1},
        "tied": {"p": [1, 1, 2, 2, 3, 3], "q": [1, 2, 2, 3, 3, 9], "r": [1, 1, 2, 9, 9, 9]},
        "flat": {"p": [1] * 7, "q": [1] * 7, "r": [1] * 7},
        "few": {"p": [1, 2, 3], "q": [2, 3, 5], "r": [4, 5, 6]},
        "alone": {"p": [1, 2, 3]},
    }


def test_branches_follow_the_values(spark, sets):
    got = {r.set: r for r in hypothesis.omnibus(frame(spark, sets)).collect()}
    assert {s: r.test for s, r in got.items()} == {"bells": "anova", "wide": "friedman", "skewed": "friedman", "two": "anova", "two skewed": "wilcoxon", "tied": "friedman", "flat": "friedman", "few": "friedman", "alone": "none"}
    assert got["wide"].normal and not got["wide"].equal and not got["skewed"].normal
    # two methods: F is the square of the paired t
    d = np.array(sets["two"]["p"]) - np.array(sets["two"]["q"])
    assert got["two"].statistic == pytest.approx((d.mean() / (d.std(ddof=1) / math.sqrt(30))) ** 2)
    assert (got["two"].dof1, got["two"].dof2) == (1, 29)
    # repeated measures by hand
    x = np.array(list(sets["bells"].values()))
    rest = x - x.mean(0) - x.mean(1, keepdims=True) + x.mean()
    f = 30 * ((x.mean(1) - x.mean()) ** 2).sum() / 2 / ((rest**2).sum() / 58)
    assert got["bells"].statistic == pytest.approx(f) and got["bells"].p == pytest.approx(tails.f_tail(f, 2, 58)) and got["bells"].differ
    # ranks with ties by hand: 6 blocks, tie corrected
    x = np.array(list(sets["tied"].values()), float)
    rank = np.array([[(col < v).sum() + ((col == v).sum() + 1) / 2 for v in col] for col in x.T])
    ties = sum(((col == v).sum() ** 2 - 1) for col in x.T for v in col)
    chi2 = 12 * 6 / 12 * ((rank.mean(0) - 2) ** 2).sum() / (1 - ties / (6 * 3 * 8))
    assert got["tied"].statistic == pytest.approx(chi2) and got["tied"].p == pytest.approx(math.exp(-chi2 / 2))
    assert got["flat"].p is None and not got["flat"].differ and got["alone"].p is None
    d = np.array(sets["two skewed"]["q"]) - np.array(sets["two skewed"]["p"])
    order = np.abs(d).argsort().argsort() + 1
    assert got["two skewed"].statistic == min(order[d > 0].sum(), order[d < 0].sum())


def test_pairs(spark, sets):
    got = {(r.set, r.a, r.b): r for r in hypothesis.pairs(frame(spark, sets)).collect()}
    assert {k[0] for k in got} == {"bells", "wide", "skewed", "tied", "flat", "few"}
    assert len(got) == 18
    assert got["bells", "p", "r"].test == "tukey" and got["bells", "p", "r"].gap == pytest.approx(-2, abs=1e-9) and got["bells", "p", "r"].differ
    assert got["few", "p", "r"].test == "nemenyi" and got["few", "p", "r"].gap == -2
    assert got["few", "p", "r"].p == pytest.approx(tails.studentised_tail(2 / math.sqrt(12 / 36), 3, math.inf))
    assert got["flat", "p", "q"].gap == 0 and not got["flat", "p", "q"].differ


def test_cells_and_places(spark):
    rows = [("d1", 1, "cpu_A", 1.0), ("d1", 2, "A", 3.0), ("d1", 1, "B", 7.0), ("d2", 1, "A", None), ("d2", 1, "B", 1.0), ("d3", 1, "A", float("nan")), ("d3", 2, "A", 4.0), ("d3", 2, "torch_B", 6.0)]
    df = spark.createDataFrame(rows, "dataset string, videoIdx int, method string, MAE double").withColumn("PCC", F.col("MAE"))
    cells = hypothesis.cells(df, ("MAE", "PCC"))
    assert sorted(map(tuple, cells.filter("set = 'MAE'").collect())) == [("MAE", "d1", "A", 2.0), ("MAE", "d1", "B", 7.0), ("MAE", "d3", "A", 4.0), ("MAE", "d3", "B", 6.0)]
    place = {(r.set, r.method): r.place for r in hypothesis.best(cells).collect()}
    assert place == {("MAE", "A"): 1, ("MAE", "B"): 2, ("PCC", "A"): 2, ("PCC", "B"): 1}
    assert hypothesis.omnibus(cells.limit(0)).collect() == [] and hypothesis.pairs(cells.limit(0)).collect() == []


def posterior(z, rope, n=1500):
    """Exact for two differences: the prior's weight is t ** 2 for t uniform in the region below w1 = 1 - t ** 2."""
    z = np.array([0.0, *z])
    t, w1 = np.meshgrid((np.arange(n) + 0.5) / n, (np.arange(n) + 0.5) / n)
    keep = w1 < 1 - t**2
    w = np.stack((t**2, w1, 1 - t**2 - w1))[:, keep]
    sums = z[:, None] + z[None]
    part = lambda m: np.einsum("id,ij,jd->d", w, m.astype(float), w)
    below, above = part(sums < -2 * rope), part(sums > 2 * rope)
    best = np.stack((1 - below - above, below, above)).argmax(0)
    return [(best == k).mean() for k in (1, 0, 2)]


@pytest.mark.parametrize("z", [(1.0, -0.4), (1.0, 0.5), (-1.0, 0.05), (0.04, -0.02)])
def test_posterior_against_the_exact_one(spark, z):
    w = bayes.weights(bayes.seed_of(str(z)), np.arange(60_000), 2)
    s = bayes.shares(np.array([0.0, *z]), w, 0.1)
    won = np.bincount(np.array([1, 0, 2])[s[:, [1, 0, 2]].argmax(1)], minlength=3) / 60_000
    assert np.allclose(won, posterior(z, 0.1), atol=0.01)


def test_shares_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    for rope in (0.0, 0.25):
        z = np.round(rng.normal(size=40) * 8) / 8
        w = rng.gamma(1.0, size=(7, 40))
        p, sums = w / w.sum(1, keepdims=True), z[:, None] + z
        want = [np.einsum("di,ij,dj->d", p, m.astype(float), p) for m in (sums < -2 * rope, sums > 2 * rope)]
        got = bayes.shares(z, w, rope)
        assert np.allclose(got[:, 0], want[0]) and np.allclose(got[:, 2], want[1])


def test_weights_are_gamma_variates():
    for halves in (1, 2, 3, 5):
        w = bayes.weights(12345, np.arange(40_000), 3, halves)
        assert np.allclose(w.mean(0), [halves / 2, 1, 1, 1], atol=0.03) and np.allclose(w.var(0), [halves / 2, 1, 1, 1], atol=0.1)


def test_signed_rank_in_tasks(spark):
    cells = frame(spark, {"one": {"A": [1.0], "B": [0.0]}, "many": {"A": range(40), "B": [k + 5 + k % 3 for k in range(40)], "C": [k + 0.001 * (k % 2) for k in range(40)]}})
    got = {(r.set, r.a, r.b): r for r in bayes.signed_rank(cells, rope=0.1, draws=4000).collect()}
    assert len(got) == 4 and all(abs(r.p_smaller + r.p_equal + r.p_larger - 1) < 1e-12 for r in got.values())
    assert got["one", "A", "B"].p_larger == pytest.approx(math.sqrt(math.sqrt(0.5)), abs=0.02)  # one difference: Beta(1/2, 1)
    assert got["many", "A", "B"].decision == "smaller" and got["many", "A", "C"].decision == "equal"
    again = bayes.signed_rank(cells.repartition(1), rope=0.1, draws=4000, chunk=77).collect()
    assert {(r.set, r.a, r.b): r for r in again} == got
    matrix = {(r.set, r.method): r for r in bayes.decision_matrix(spark.createDataFrame(list(got.values())), ["A", "B", "C"]).collect()}
    assert matrix["many", "A"].B == "smaller" and matrix["many", "B"].A == "larger" and matrix["many", "A"].A is None
    assert bayes.signed_rank(cells.limit(0)).collect() == []
