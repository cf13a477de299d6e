import hashlib
from collections import Counter

import numpy as np

from sanguine.llm.suffix import _words_at, blocks, two_stage, without_repeats


def slow(texts, width):
    seen = Counter(t[k : k + width] for t in texts for k in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                gone[k + 1 : k + 1 + width] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[1:-1]])
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_two_stage_sorts_suffixes():
    rng = np.random.default_rng(1)
    for letters in (1, 2, 4, 200):
        body = rng.integers(1, letters + 1, 400, dtype=np.int64).astype(np.uint8)
        body[50:150] = body[200:300]
        n = len(body)
        t = np.concatenate((body, np.zeros(1, np.uint8), np.ones(1, np.uint8), np.zeros(n + 32, np.uint8)))
        members = np.ones(n + 1, bool)
        got = two_stage(t, members, n, _words_at(t))
        raw = t.tobytes()
        assert got.tolist() == sorted(range(n + 1), key=lambda k: raw[k:]), letters


def corpus(rng):
    line = lambda n, letters=26: bytes(rng.integers(97, 97 + letters, n).astype(np.uint8)).decode()
    shared = [line(n) for n in (199, 200, 201, 260, 900)]
    texts = [None, "", "short", "é" * 300, "a" * 700, "a" * 199, "a" * 200 + "b", "b" + "a" * 200, "ab" * 250, line(30_000)]
    for k in range(40):
        t = line(int(rng.integers(0, 900)))
        for _ in range(rng.integers(0, 3)):
            at = int(rng.integers(0, len(t) + 1))
            s = shared[rng.integers(0, len(shared))]
            t = t[:at] + s[: int(rng.integers(150, len(s) + 1))] + t[at:]
        texts.append(t)
    copy = line(500)
    texts += [copy, copy, copy, copy[:250] + "X" + copy[251:], line(400) + copy[100:350], line(100) + shared[4] + line(50) + shared[4]]
    return texts


def test_matches_brute_force(spark):
    texts = corpus(np.random.default_rng(6))
    ids = [None, *range(1, len(texts) - 1), 1]
    df = spark.createDataFrame([(i, t, k, 0) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], "doc_id long, text string, h long, kept int").repartition(3)
    want = sorted((str(i), *w) for i, w in zip(ids, slow([(t or "").encode() for t in texts], 200), strict=True))
    for most in (4096, 2, 1):
        got = without_repeats(df, most=most).drop("kept").collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert without_repeats(df.limit(0)).collect() == []


def test_blocks_hold_each_window_once_and_equal_ones_meet():
    rng = np.random.default_rng(3)
    passage = bytes(rng.integers(97, 123, 260).astype(np.uint8))
    for step in (13, 1):
        where = []
        for left, right in ((40, 60), (70, 20), (0, 0)):
            context = bytes(left) + passage[: 260 - right]
            n, d = len(context) - 199, left + 120  # the anchor is the passage's 120th byte
            seen = {}
            for k, size, place, h, c, part in blocks(context, n, d, step):
                assert part == context[k : k + size + 199] and place == d - k and size <= step
                seen |= {j: (h, context[j : j + 200]) for j in range(k, k + size)}
            assert sorted(seen) == list(range(n))
            where.append(seen.values())
        met: dict = {}
        for seen in where:
            for h, w in seen:
                met.setdefault(w, set()).add(h)
        assert all(len(x) == 1 for x in met.values()), step


def test_one_passage_in_many_surroundings(spark):
    rng = np.random.default_rng(8)
    line = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    passage = line(230)
    texts = [line(int(rng.integers(0, 120))) + passage[int(rng.integers(0, 40)) :] + line(int(rng.integers(0, 120))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = [(k, *w) for k, w in enumerate(slow([t.encode() for t in texts], 200))]
    got = without_repeats(df, most=20).drop("kept").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_contexts_are_told_apart_by_more_than_a_polynomial(spark):
    """These heads have one sum of bytes times powers of a known base modulo 2 ** 64, so a hash by it took the texts for equal."""
    tail = (
        "ramgnaqhoprhlhhojanr df jdkqnqgjjspqmsbphmnflrlcoqdfqmlpapbjtssm ffqhagrrhmqlsloirtamqeqrgnbplsrgqnplnlarrttkotah"
        " frsfcribccaoaihidtfljcffiqfi jokppdajmkngidiqgtnahamebfoqn"
    )
    texts = ["m" * 28 + tail, "mkkpmkjknkkknmokljjnnmmmolmm" + tail, "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in without_repeats(df).collect()} == {0: 0, 1: 0, 2: 0}
    assert [len(t) for t in texts] == [200, 200, 5]
