import re
from itertools import combinations

import numpy as np
import pytest

from sanguine.llm import decontaminate
from sanguine.llm.decontaminate import MASKS, SHORTEST, allowed, border_masks, decontaminated, item_classes, masks_for, overlaps


@pytest.mark.parametrize("n", range(1, 17))
def test_masks_are_lossless(n):
    k = allowed(n, 0.8)
    spots = [{s + o for o in mask} for mask in masks_for(n, 0.8) for s in range(n - mask[-1])]
    for differ in combinations(range(n), k):
        assert any(not spot & set(differ) for spot in spots), differ
    assert masks_for(16, 0.8) == MASKS


@pytest.mark.parametrize("words", range(11, 40))
def test_border_masks_are_lossless(words):
    masks = {*masks_for(words, 0.8), *border_masks(words, 0.8)}
    for n in range(SHORTEST, min(words, 16)):
        spots = [{s + o for o in mask} for mask in masks for s in range(n - mask[-1])]
        assert all(any(not spot & set(differ) for spot in spots) for differ in combinations(range(n), allowed(n, 0.8)))


def test_masks_are_spaced():
    for n in range(5, 17):
        assert all(any(b - a > 1 for a, b in zip(m, m[1:])) for m in masks_for(n, 0.8)), n


def words(text):
    return re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", (text or "").lower()).split(" ")


def slow(docs, items):
    """Every diagonal of every pair, by counting equal words."""
    out = set()
    coded: dict = {}
    code = lambda text: np.array([coded.setdefault(w, len(coded)) for w in words(text) if w], int)
    targets = [(i, code(t)) for i, t in items]
    for d, text in docs:
        a = code(text)
        for i, b in targets:
            m = min(len(b), 16)
            if not m or len(a) < m:
                continue
            equal = a[:, None] == b
            n = sum(equal[k : len(a) - m + 1 + k, k : len(b) - m + 1 + k].astype(int) for k in range(m))
            if (n >= m - allowed(m, 0.8)).any():
                out.add((d, i))
    return sorted(out, key=str)


@pytest.fixture(params=[16, 0])
def crowded(request, monkeypatch):
    """With 0 every seed that two classes have is taken for crowded."""
    monkeypatch.setattr(decontaminate, "CROWDED", request.param)


def test_overlaps_match_brute_force(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(40)] + ["Été", "THE", "of"]
    items = [(k, " ".join(rng.choice(vocabulary, n))) for k, n in enumerate([1, 2, 4, 5, 7, 9, 12, 14, 15, 16, 17, 25, 40, 40])] + [(98, None), (99, " ,. "), (None, "null id words are carried along here too")]
    docs = [(None, "null id words are carried along here too"), (1000, None), (1001, ""), (1002, "x" * 100_000)]
    for d in range(60):
        body = rng.choice(vocabulary, 30).tolist()
        item = items[rng.integers(4, 14)][1].split()
        lo = rng.integers(0, 3)
        part = item[lo : len(item) - rng.integers(0, 3)]
        for at in rng.integers(0, len(part), rng.integers(0, 5)):
            part[at] = "changed"
        at = rng.integers(0, 30)
        docs.append((d, ", ".join(body[:at] + [w.upper() for w in part] + body[at:])))
    docs.append(docs[-1])
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id long").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = overlaps(df, bench).collect()
    want = slow(docs, items)
    twice = sorted([*want, *[w for w in want if w[0] == 59]], key=str)
    assert {r.item_id: r.class_id for r in item_classes(bench).collect()} == {i: i for i, t in items if t and re.search("[a-z]", t)}
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == twice and all(r.item_id == r.class_id for r in got)
    assert all(r.similarity >= 0.8 and r.last_word >= r.first_word for r in got)
    left = decontaminated(df, bench)
    hit = {w[0] for w in want}
    assert left.columns == df.columns and sorted((r.doc_id for r in left.collect()), key=str) == sorted((d for d, _ in docs if d not in hit), key=str)
    assert overlaps(df.limit(0), bench).collect() == [] == overlaps(df, bench.limit(0)).collect()


def slow_borders(docs, items):
    """Like slow, and windows over a text's border by their words inside, ten at least."""
    out = set(slow(docs, items))
    split = lambda text: [w for w in words(text) if w]
    for d, text in docs:
        a = split(text)
        for i, item in items:
            b = split(item)
            m = min(len(b), 16)
            for diagonal in range(-len(b), len(a)):
                for at in range(diagonal, diagonal + len(b) - m + 1):
                    inside = range(max(at, 0), min(at + m, len(a)))
                    if 10 <= len(inside) < m and sum(a[k] == b[k - diagonal] for k in inside) >= len(inside) - allowed(len(inside), 0.8):
                        out.add((d, i))
    return sorted(out, key=str)


def test_borders_match_brute_force(spark, crowded):
    rng = np.random.default_rng(13)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocabulary, n))) for k, n in enumerate([9, 10, 11, 12, 13, 14, 15, 16, 20, 40])]
    docs = []
    for d in range(240):
        item = items[rng.integers(0, len(items))][1].split()
        n = min(len(item), int(rng.integers(8, 17)))
        lo = [0, len(item) - n, int(rng.integers(0, len(item) - n + 1))][d % 3]
        part = item[lo : lo + n]
        for at in rng.integers(0, n, rng.integers(0, 4)):
            part[at] = "changed"
        body = rng.choice(vocabulary, 30).tolist()
        docs.append((d, " ".join([[*body, *part], [*part, *body], part][d % 3])))
    want = slow_borders(docs, items)
    assert len(want) > len(slow(docs, items)) + 50
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = overlaps(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == want
    assert all(0.8 <= r.similarity <= 1 and 8 <= r.n_matched <= 16 for r in got)
    hit = {w[0] for w in want}
    assert sorted(r.doc_id for r in decontaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()) == [d for d, _ in docs if d not in hit]


def test_shared_passages(spark):
    """Items that share a passage are one class, and every class that a document overlaps is found."""
    rng = np.random.default_rng(21)
    vocabulary = [f"w{k}" for k in range(5000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    shared = [text(30), text(17), text(13)]
    items = [(k, " ".join([text(int(rng.integers(0, 9))), shared[k % 3], text(int(rng.integers(0, 9)))])) for k in range(30)] + [(100, shared[2]), (101, shared[2]), (102, None)]
    docs = [(d, " ".join([text(12), [*shared, items[d % 30][1], items[2][1], shared[2]][d % 6], text(12)])) for d in range(40)] + [(40, text(50))]
    of = {r.item_id: r.class_id for r in item_classes(spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {of[k] for k in range(0, 30, 3)} == {0} and {of[k] for k in range(1, 30, 3)} == {1} and of[100] == of[101] == 100
    pairs = slow_borders(docs, items)
    got = overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted({(d, of[i]) for d, i in pairs}) == sorted((r.doc_id, r.class_id) for r in got)
    assert all((r.doc_id, r.item_id) in set(pairs) and of[r.item_id] == r.class_id for r in got)


def test_common_line_stays_small(spark):
    """One line of 30 words in 512 documents and 2000 items: a row for each document, in seconds."""
    rng = np.random.default_rng(22)
    vocabulary = [f"w{k}" for k in range(5000)]
    line = " ".join(rng.choice(vocabulary, 30))
    docs = [(k, " ".join([*rng.choice(vocabulary, 20), line, *rng.choice(vocabulary, 20)])) for k in range(512)]
    items = [(k, " ".join([*rng.choice(vocabulary, 10), line, *rng.choice(vocabulary, 10)])) for k in range(2000)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = overlaps(df, bench).collect()
    assert sorted(r.doc_id for r in got) == list(range(512)) and {r.class_id for r in got} == {0}
    assert decontaminated(df, bench).count() == 0


@pytest.mark.parametrize("lead", [20])
def test_stems_bring_few_pairs_together(spark, monkeypatch, lead):
    """Texts and items with one stem of twelve words, and nothing else in common but three planted pairs."""
    rng = np.random.default_rng(23)
    vocabulary = [f"w{k}" for k in range(100_000)]
    stem = " ".join(rng.choice(vocabulary, 12))
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    met, whole = [], decontaminate._verified

    def counted(rows, *rest):
        rows = decontaminate.cut(rows)
        met.append(rows.count())
        return whole(rows, *rest)

    monkeypatch.setattr(decontaminate, "_verified", counted)
    n = 40
    items = [(k, " ".join([text(lead), stem, text(20)])) for k in range(n)]
    docs = [(k, " ".join([text(lead), stem, text(30)])) for k in range(n)]
    for k in range(3):
        item = items[k][1].split()
        item[lead + 14] = "changed"
        docs[k] = (k, " ".join([text(5), *item[lead : lead + 17], text(30)]))
    got = overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == slow_borders(docs, items)
    assert {(k, k) for k in range(3)} <= {(r.doc_id, r.item_id) for r in got}
    assert sum(met) < 40 * n, met


def test_items_with_a_common_window_keep_their_links(spark):
    """Two items that share sixteen words, and a copy of one: a text that holds both is linked to both, and the copies are one class."""
    common = " ".join(f"c{k}" for k in range(16))
    first, second = (f"{common} " + " ".join(f"{x}{k}" for k in range(20)) for x in "pq")
    bench = spark.createDataFrame([(1, first), (2, second), (3, first.upper())], "item_id long, text string")
    df = spark.createDataFrame([(10, f"{first} and {second}"), (11, second[len(common) :])], "doc_id long, text string")
    got = {(r.doc_id, r.class_id) for r in overlaps(df, bench, copies=True).collect()}
    assert got == {(10, 1), (10, 2), (11, 2)}
    assert {r.item_id: r.class_id for r in item_classes(bench, copies=True).collect()} == {1: 1, 2: 2, 3: 1}
