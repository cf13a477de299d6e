"""Pairs of texts that share shingles and are not similar."""

import numpy as np
from pyspark.sql import functions as F

from sanguine.llm import similar


def test_sample_follows_the_table():
    assert [similar.sampled(n) for n in (10, 4096, 5000, 800_000)] == [10, 4096, 4096, 100_000]


def test_folded_sketches_rule_out_no_similar_pair(spark):
    rng = np.random.default_rng(12)
    rows, want = [], []
    for k in range(200):
        a = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        cut = int(rng.integers(0, 120))
        b = np.unique(np.concatenate((a[cut:], rng.integers(0, 2**63, cut // 2, dtype=np.uint64)))) if k % 2 else np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        both = len(np.intersect1d(a, b))
        want.append(both / (len(a) + len(b) - both) >= 0.8)
        rows.append((k, len(a), len(b), *similar.folded(a).tolist(), *similar.folded(b).tolist()))
    others = [f"b{c}" for c in similar.FOLDED]
    df = spark.createDataFrame(rows, "k int, na int, nb int, " + ", ".join(f"{c} long" for c in (*similar.FOLDED, *others)))
    got = {r.k for r in df.filter(similar._alike(F.col("na"), F.col("nb"), similar.FOLDED, others, 0.8)).collect()}
    assert any(want) and {k for k, w in enumerate(want) if w} <= got and len([k for k in got if k % 2 == 0]) <= 2
