"""Bayesian signed-rank comparison of methods: posterior shares of smaller, equivalent and larger, by seeded sampling in tasks.

The weights of a pair's differences, and of one prior difference of zero, follow a Dirichlet distribution. A draw of them gives
the Walsh averages (means of two differences, weighted by both weights) three shares: below, within and above the region of equivalence. The
posterior probability of each outcome is how often its share is the largest (Benavoli et al., 2014).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEP = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64 of counters, a value of [0, 2 ** 64) each."""
    z = x * np.uint64(_STEP)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def seed_of(text: str) -> int:
    """48 bits of a name's MD5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def weights(seed: int, draws: np.ndarray, n: int, prior_halves: int = 1) -> np.ndarray:
    """(draws, n + 1) gamma variates, the first of shape prior_halves / 2 and all others of shape 1; each follows from seed, draw and place alone.

    A variate of shape 1 is -ln u; one of shape 1 / 2 is half the square of a normal one, -ln u cos(2 pi v) ** 2.
    """
    wide = n + prior_halves + 2  # numbers that a draw takes
    at = np.uint64(seed) + draws.astype(np.uint64)[:, None] * np.uint64(wide) + np.arange(1, wide + 1, dtype=np.uint64)
    u = ((mixed(at) >> np.uint64(12)).astype(float) + 0.5) / 2.0**52
    e = -np.log(u)
    prior = e[:, n : n + prior_halves // 2].sum(1)
    if prior_halves % 2:
        prior = prior + e[:, -2] * np.cos(2 * np.pi * u[:, -1]) ** 2
    return np.concatenate((prior[:, None], e[:, :n]), 1)


def shares(z: np.ndarray, w: np.ndarray, rope: float) -> np.ndarray:
    """(draws, 3) shares of the pairs of the differences (z, the prior's first) by weights w: sums below -2 rope, between, above 2 rope. One sort and running sums, no pairs."""
    order = np.argsort(z, kind="stable")
    z, w = z[order], w[:, order] / w.sum(1, keepdims=True)
    upto = np.concatenate((np.zeros((len(w), 1)), np.cumsum(w, 1)), 1)
    below = (w * upto[:, np.searchsorted(z, -2 * rope - z, "left")]).sum(1)
    above = (w * (upto[:, -1:] - upto[:, np.searchsorted(z, 2 * rope - z, "right")])).sum(1)
    return np.stack((below, 1 - below - above, above), 1)


def differences(cells: DataFrame, rope: float = 0.1) -> DataFrame:
    """(set, a, b, z array, rope) for each two methods a < b: a's values less b's by block, in order; rope: that share of the two methods' pooled deviation."""
    spread = cells.groupBy("set", "method").agg(F.var_samp("value").alias("v"))
    a, b = (cells.join(spread, ["set", "method"]).select("set", "block", F.col("method").alias(x), F.col("value").alias(f"v{x}"), F.col("v").alias(f"s{x}")) for x in "ab")
    met = a.join(b, ["set", "block"]).filter("a < b").groupBy("set", "a", "b")
    width = F.lit(float(rope)) * F.sqrt((F.first("sa") + F.first("sb")) / 2)
    return met.agg(F.sort_array(F.collect_list(F.col("va") - F.col("vb"))).alias("z"), F.coalesce(width, F.lit(0.0)).alias("rope"))


def signed_rank(cells: DataFrame, rope: float = 0.1, draws: int = 5000, prior_halves: int = 1, sure: float = 0.95, seed: str = "", chunk: int = 500) -> DataFrame:
    """(set, a, b, n, rope, p_smaller, p_equal, p_larger, decision) for each two methods a < b of cells (set, block, method, value).

    p_smaller: the posterior probability that a's values are smaller; decision: the outcome whose probability reaches `sure`, else
    `inconclusive`. rope is a share of the pooled deviation, 0 for no region of equivalence. The prior has prior_halves / 2
    blocks' weight. A task draws `chunk` times for one pair and holds its differences, a number for each block; draws follow from (seed, set, a, b, number) alone,
    so a task that is run again draws the same. Of equal shares the first counts, in the order equal, smaller, larger.
    """
    pairs = differences(cells, rope)
    chunks = pairs.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(chunk))))
    types = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def run(parts):
        for pdf in parts:
            rows = []
            for s, a, b, z, r, first in zip(*(pdf[c] for c in ("set", "a", "b", "z", "rope", "first")), strict=True):
                n, at, won = len(z), np.arange(first, min(first + chunk, draws)), np.zeros(3, int)
                whole = np.concatenate(([0.0], np.asarray(z, float)))
                step = max(1, (1 << 21) // (n + 1))
                for k in range(0, len(at), step):
                    t = shares(whole, weights(seed_of(f"{seed}|{s}|{a}|{b}"), at[k : k + step], n, prior_halves), r)
                    won += np.bincount(np.array([1, 0, 2])[t[:, [1, 0, 2]].argmax(1)], minlength=3)
                rows.append((s, a, b, n, r, *map(int, won)))
            yield pd.DataFrame(rows, columns=["set", "a", "b", "n", "rope", "smaller", "equal", "larger"])

    spread = chunks.repartition("set", "a", "b", "first")
    counts = spread.mapInPandas(run, f"set string, a {types['a']}, b {types['b']}, n int, rope double, smaller long, equal long, larger long")
    p = {c: (F.sum(c) / F.lit(draws)).alias(f"p_{c}") for c in ("smaller", "equal", "larger")}
    out = counts.groupBy("set", "a", "b", "n", "rope").agg(*p.values())
    decision = F.when(F.col("p_smaller") >= sure, "smaller").when(F.col("p_equal") >= sure, "equal").when(F.col("p_larger") >= sure, "larger").otherwise("inconclusive")
    return out.withColumn("decision", decision)


def decision_matrix(compared: DataFrame, methods: list[str]) -> DataFrame:
    """(set, method, a column for each method): the decision seen from the row's method; NULL on the diagonal."""
    turned = F.when(F.col("decision") == "smaller", "larger").when(F.col("decision") == "larger", "smaller").otherwise(F.col("decision"))
    both = compared.select("set", F.col("a").alias("method"), F.col("b").alias("other"), "decision").unionByName(compared.select("set", F.col("b").alias("method"), F.col("a").alias("other"), turned.alias("decision")))
    return both.groupBy("set", "method").pivot("other", methods).agg(F.first("decision"))
