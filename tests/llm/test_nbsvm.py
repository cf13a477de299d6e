import zlib

import numpy as np

from sanguine.llm.nbsvm import classify, features, fit


def test_features_are_indicators():
    f, bounds = features(["a b a b", "", None, "B b", "a b a b"])
    rows = [f[x:y].tolist() for x, y in zip(bounds, bounds[1:])]
    assert all(r and r == sorted(set(r)) for r in rows)
    assert rows[0] == rows[4] != rows[3] and rows[1] == rows[2]
    alone = features(["B b"])[0].tolist()
    assert alone == rows[3]


def test_separates_and_degenerates():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["good", "fine", "x", "y"] if k % 2 else ["bad", "junk", "x", "y"], 20)) for k in range(200)]
    f, b = features(texts)
    rows = [f[x:y] for x, y in zip(b, b[1:])]
    y = np.arange(200) % 2 == 1
    assert ((fit(rows, y).scores(texts) >= 0.5) == y).mean() > 0.97
    assert fit([], y[:0]).scores(["a", None]).tolist() == [0.5, 0.5]
    assert fit(rows, np.ones(200, bool)).scores(["a"])[0] > 0.9


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    poisoned = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1, 1 - quality, quality) AS quality")
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    rows = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = ([s for s, q in rows if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    again = {r.doc_id: r.score for r in classify(docs, poisoned).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())  # held-out labels are never read


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "", 0.1), (2, "a" * 100_000, 0.2), (2, "a", 0.3)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = classify(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "2", "None"] and {r.score for r in got} == {0.5}
    assert classify(docs.limit(0), labels).collect() == []
