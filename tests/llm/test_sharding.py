import zlib
from collections import Counter

import numpy as np

from sanguine.llm.sharding import hypergeometric, matrix_row, shard_documents


def test_matrix_has_exact_margins():
    rows, cells = [5, 0, 17, 3, 9], np.array([12, 11, 11])
    sums = np.concatenate(([0], np.cumsum(rows)))
    m = np.array([matrix_row(sums, cells, p, 7) for p in range(5)])
    assert m.sum(1).tolist() == rows and m.sum(0).tolist() == cells.tolist() and (m >= 0).all()


def test_large_hypergeometric():
    rng = np.random.default_rng(1)
    n = [hypergeometric(rng, 3 * 10**9, 10**9, 10**6) for _ in range(50)]
    assert abs(np.mean(n) - 750_000) < 400 and 150 < np.std(n) < 900
    assert hypergeometric(rng, 2 * 10**9, 5, 2 * 10**9 + 5) == 2 * 10**9


def test_sizes_slots_and_uniformity(spark):
    texts = [None, "", "é", "a" * 100_000] + ["same"] * 97
    df = spark.createDataFrame([(None if k == 5 else k % 90, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, slot int").repartition(5)
    for cell_rows in (1 << 18, 4):
        got = shard_documents(df, cell_rows=cell_rows).collect()
        assert Counter(str(r.doc_id) for r in got) == Counter("None" if k == 5 else str(k % 90) for k in range(101))
        n = Counter(r.shard for r in got)
        assert sorted(n.values()) == [12] * 3 + [13] * 5
        for s in n:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
        assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
        assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert shard_documents(df.limit(0)).collect() == []


def test_every_place_is_likely(spark):
    df = spark.range(40).selectExpr("id doc_id", "'x' text").repartition(3)
    at = Counter()
    for seed in range(12):
        at.update(r.shard for r in shard_documents(df, seed=seed).filter("doc_id < 10").collect())
    assert len(at) == 8 and max(at.values()) < 35  # 120 draws over 8 shards
