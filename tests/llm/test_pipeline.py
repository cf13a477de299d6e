import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np

from sanguine.llm import pii
from sanguine.llm.tokens import Encoder, vocabulary

from .test_decontaminate import slow as slow_overlaps
from .test_quality import slow as slow_counts
from .test_similar import slow_classes

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(1).selectExpr("CAST(NULL AS BIGINT) doc_id", "CAST(NULL AS STRING) text", "lang", "source", "CAST(0 AS BIGINT) n_chars")
    docs = docs.unionByName(extra)
    before = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "pii", "packing"]
    kept = docs
    kept.write.parquet(str(tmp_path / "0"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES, 1):
        kept = stage(spark, spark.read.parquet(str(tmp_path / str(k - 1))), SF)
        kept.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k))).collect()
        if name != "packing":
            assert kept.columns == docs.columns
            now = {r.doc_id: r for r in after}
            assert len(now) == len(after)
        if name == "quality":
            for i, r in before.items():
                n = slow_counts(r.text)
                assert i not in now or not (n[0] < 10 or 100 * n[4] > 20 * n[0])
            assert 0.6 * len(before) < len(now) < len(before)
        elif name == "near_dedup":
            ids = sorted(before)
            label = slow_classes([before[i].text for i in ids])
            assert sorted(now) == sorted({ids[c] for c in label})
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            hit = {d for d, _ in slow_overlaps([(i, r.text) for i, r in before.items()], items)}
            assert sorted(now) == sorted(i for i in before if i not in hit)
        elif name == "pii":
            assert sorted(now) == sorted(before)
            for i, r in now.items():
                assert r.n_chars == len(r.text) and not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[a-z]", r.text)
                assert r.text == before[i].text or pii._TRIGGER.search(before[i].text)
        else:
            own = Encoder(vocabulary("word_bpe_49k.json"))
            pieces = {}
            for r in sorted(after, key=lambda r: r.start):
                pieces.setdefault(r.doc_id, []).append(r)
            for i, r in before.items():
                raw = own.ids(r.text) + (2).to_bytes(4, "little")
                for p in pieces[i]:
                    assert p.doc_tokens == len(raw) // 4 and p.ids_crc32 == zlib.crc32(raw[4 * p.start : 4 * (p.start + p.length)])
                assert sum(p.length for p in pieces[i]) == len(raw) // 4
            full = Counter()
            for r in after:
                full[r.sequence_id] += r.length
            assert sorted(full.values())[1:] == [4096] * (len(full) - 1) and np.all(np.diff(sorted(full)) == 1)
            return
        before = now


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
