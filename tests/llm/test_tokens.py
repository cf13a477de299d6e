import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sanguine.llm import packing, tokenfile
from sanguine.llm.tokens import Encoder, vocabulary

PARTS = ["a", "b", "The", "'s", " ", "  ", "\n", " \n", "\t", "é", "ÉÀ", "́", "\xa0", "　", "1", "23", "...", "<|endoftext|>", "İ", "ΑΣ", "ß", "\x85", "\x1c", "中文", "don't", "\r\n", "😀", "\x0b", "\0", "Word,", " next"]
TEXTS = ["<|endoftext|>", "a \n<|endoftext|> b", None, "", " ", "\n", "x" * 30_000, "same text here", "same text here", *["word " * 3000]]


@pytest.mark.parametrize("as_text", [True, False])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name, as_text):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    whole = Tokenizer.from_file(vocabulary(name))
    if as_text:
        whole.encode_special_tokens = True
    own = Encoder(vocabulary(name), special_is_text=as_text, most_pieces=500)
    for text, e in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.ids(text), "<u4").tolist() == e.ids, repr(text)


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 255, 256, 257, 5000):
        for high in (1, 2, 300, 1 << 16, 1 << 32):
            ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            ids[rng.random(n) < 0.03] = 0xFFFFFFFF
            s = tokenfile.Segment(tokenfile.encode(ids, [None, 5, -3], np.array([n, 0, 0])))
            assert (s.ids() == ids).all() and s.doc_ids == [None, 5, -3]
            lo, hi = sorted(rng.integers(0, n + 1, 2))
            assert (s.ids(int(lo), int(hi)) == ids[lo:hi]).all()


def slow_ids(name, text):
    whole = Tokenizer.from_file(vocabulary(name))
    return np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_token_files(spark):
    docs = [(None if k == 3 else k % 6, t, 0) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(docs, "doc_id long, text string, start int").repartition(3)
    name = "byte_bpe_50k.json"
    got = sorted(tokenfile.token_files(df, vocabulary(name)).collect(), key=lambda r: r.start)
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (doc_id, text, _) in zip(got, order, strict=True):
        ids = slow_ids(name, text)
        assert tuple(r) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokenfile.token_files(df.limit(0), vocabulary(name)).collect() == []
    small = tokenfile.write(df, vocabulary(name), segment_ids=10)
    assert small.count() > 3 and tokenfile.read(small).count() == len(docs)
    for r in small.collect():
        s = tokenfile.Segment(r.data)
        assert (r.segment, r.n_docs, r.n_ids, r.n_bytes) == (s.number, len(s.doc_ids), s.n, len(r.data))


def test_schedule_is_exact_and_even():
    for totals in ([100_000, 1, 30_000, 7, 999], [4096], [1, 1, 1], [4096 * 10, 4096 * 6]):
        plan = packing.Schedule(totals, window=64, segment=4)
        n = -(-sum(totals) // 64)
        used = np.zeros((n, 64), int)
        share = np.array(totals) / sum(totals)
        for s, total in enumerate(totals):
            x = 0
            while x < total:
                step = min(total - x, 37)
                for w, offset, length in plan.pieces(s, x, step):
                    used[w, offset : offset + length] += s + 1
                x += step
        flat = used.reshape(-1)
        assert (flat[: sum(totals)] > 0).all() and (flat[sum(totals) :] == 0).all() and np.bincount(flat)[1:].tolist() == totals
        for w in range(1, n):
            counts = np.bincount(flat[: w * 64], minlength=len(totals) + 1)[1:]
            assert (abs(counts - w * 64 * share) < 3).all()


def slow_round_robin(totals, window, weights=None):
    """Tokens of each queue by window: one deficit for each queue, carried from the first window to the last."""
    weights = weights or totals
    left, deficit, out = list(totals), [0.0] * len(totals), []
    while sum(left):
        size, quantum = min(window, sum(left)), [0.0] * len(totals)
        owed, room = size, [n - d for n, d in zip(left, deficit, strict=True)]
        while owed > 1e-9:  # a queue that runs dry leaves its share to the others
            live = [k for k in range(len(totals)) if room[k] > 1e-9]
            step = min([owed, *(room[k] * sum(weights[j] for j in live) / weights[k] for k in live)])
            for k in live:
                part = step * weights[k] / sum(weights[j] for j in live)
                quantum[k] += part
                room[k] -= part
            owed -= step
        credit = [d + q for d, q in zip(deficit, quantum, strict=True)]
        serve = [min(max(int(c + 1e-9), 0), n) for c, n in zip(credit, left, strict=True)]
        while sum(serve) != size:
            way = 1 if sum(serve) < size else -1
            can = [k for k in range(len(totals)) if 0 <= serve[k] + way <= left[k]]
            serve[max(can, key=lambda k: way * (credit[k] - serve[k]))] += way
        deficit = [c - s for c, s in zip(credit, serve, strict=True)]
        left = [n - s for n, s in zip(left, serve, strict=True)]
        out.append(serve)
    return out


@pytest.mark.parametrize("weights", [None, [1.0, 2.0, 5.0, 1.0]])
def test_schedule_follows_round_robin(weights):
    for totals in ([5000, 300, 7000, 41], [64 * 30, 64 * 60, 64, 64 * 3], [10, 2000, 1, 1]):
        want = np.array(slow_round_robin(totals, 64, weights))
        for segment in (256, 4, 1):
            plan = packing.Schedule(totals, window=64, segment=segment, weights=weights)
            got = np.zeros_like(want)
            for s, total in enumerate(totals):
                for w, _, length in plan.pieces(s, 0, total):
                    got[w, s] += length
            assert (got.sum(1) == want.sum(1)).all() and (got.sum(0) == totals).all()
            assert abs(got.cumsum(0) - want.cumsum(0)).max() <= 1
            live = want[: max(1, min(t // 64 for t in totals))]
            if weights is None:
                assert abs(got[: len(live)] - 64 * np.array(totals) / sum(totals)).max() < 2


def test_targets_fill_windows_until_a_queue_runs_dry():
    plan = packing.Schedule([6400, 6400, 640], window=64, segment=8, weights=[1, 3, 1e-9])
    got = np.zeros((210, 3), int)
    for s, total in enumerate((6400, 6400, 640)):
        for w, _, length in plan.pieces(s, 0, total):
            got[w, s] += length
    dry = 6400 // 48
    assert abs(got[:dry] - [16, 48, 0]).max() <= 1 and abs(got[dry + 1 : 199] - [64, 0, 0]).max() <= 1 and got[201:, 2].sum() >= 570


def test_many_queues():
    totals = list(range(1, 30_001))
    plan = packing.Schedule(totals, window=4096)
    assert plan.segment == 8 and sum(n for _, _, n in plan.pieces(29_999, 700, 40)) == 40
    rounds = plan.rounds(3)
    assert (np.diff(rounds.sum(1)) == 4096).all() and (np.diff(rounds, axis=0) >= 0).all()


def test_pack(spark):
    docs = [(None if k == 3 else k, t, None if k % 3 == 0 else f"src{k % 3}", 1) for k, t in enumerate(TEXTS * 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n int").repartition(3)
    name = "word_bpe_49k.json"
    for targets in (None, {"src1": 3, None: 1}):
        got = packing.pack(df, vocabulary(name), window=128, targets=targets, segment=3)
        rows = got.collect()
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append(r)
        total = sum(r.length for r in rows)
        assert sorted(by) == list(range(-(-total // 128)))
        for k, rs in by.items():
            at = 0
            for r in sorted(rs, key=lambda r: r.offset):
                assert r.offset == at and r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32
                at += r.length
            assert at == 128 or k == max(by)
        back = {}
        for r in sorted(rows, key=lambda r: r.start):
            back.setdefault(r.doc_id, []).append(r)
        for doc_id, text, *_ in docs:
            assert b"".join(r.ids for r in back[doc_id]) == slow_ids(name, text).tobytes()
            assert {r.doc_tokens for r in back[doc_id]} == {len(slow_ids(name, text))}
    assert packing.sequences(got, 128).count() == len(by)
    assert packing.pack(df.limit(0), vocabulary(name)).collect() == []
