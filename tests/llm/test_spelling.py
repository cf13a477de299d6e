import random
import re
import zlib
from collections import Counter

import pytest

from sanguine.llm import spelling
from sanguine.llm.errata import one_edit


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def prefix(a: str, b: str) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("seed", range(40))
def test_errata_tries_find_each_pair_once(seed):
    rnd = random.Random(seed)
    length = rnd.randint(1, 7)
    letters = "abcdefgh"[: rnd.randint(1, 4)]
    words = sorted({"".join(rnd.choices(letters, k=length + rnd.randint(0, 1))) for _ in range(rnd.randint(1, 120))})
    rnd.shuffle(words)
    depth = rnd.randint(1, length + 1)
    got = Counter()
    for ids in one_edit(words, depth, length):
        assert len(ids) == len(set(ids)) > 1
        for i in range(len(ids)):
            for j in range(i):
                got[tuple(sorted((words[ids[i]], words[ids[j]])))] += 1
    want = {tuple(sorted((a, b))) for i, a in enumerate(words) for b in words[:i] if near(a, b) and min(len(a), len(b)) == length and prefix(a, b) < depth}
    assert set(got) == want
    assert all(n == 1 for n in got.values())


def slow(docs, least=5, times=3, ratio=2):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if k >= times and len(w) >= least}
    form, many = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        many[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], many[w], n[form[w]] if form[w] else None))
    return out


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(7)
    base = ["wander", "wonder", "wonders", "wounder", "straße", "STRASSE", "Àpropos", "àpropos", "aaaaaa", "aaaaa", "aaaaaaa", "banana", "bananna", "bannana"]
    near_base = {w[:k] + c + w[k + j :] for w in base for k in range(len(w)) for j in (0, 1) for c in ("", "a", "e", "ÿ")}
    pool = base * 8 + sorted(near_base)
    texts = [" ".join(rnd.choices(pool, k=200)) for _ in range(60)]
    texts += [None, "", " \n", "x" * 4000, "x" * 4000 + " " + "x" * 4001, "X" * 4000 + "1" + "x" * 4001, "x" * 4001, " ".join(["lone"] * 9 + ["Longer"] * 30000 + ["longer", "longest"] * 3)]
    return [*enumerate(texts), (3, texts[3]), (None, texts[4]), (None, texts[4])]


@pytest.mark.parametrize("most", [3, 20_000])
def test_variants_against_brute_force(spark, docs, most):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id long, text string, n int, word string, root int").repartition(5)
    out = spelling.variants(df, most=most)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = out.collect()
    got = {tuple(r) for r in rows}
    assert len(got) == len(rows)
    assert got == slow(docs)
    assert any(r.root != r.form for r in rows if r.form) and any(len(r.word) == 4000 for r in rows)


def test_parts_are_split_until_they_are_small(spark):
    words = spark.createDataFrame([(f"same{a}{b}{c}tail", 1) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"], "word string, n long")
    cut = spelling.parts(words, most=20)
    sizes = cut.groupBy("m", "lo", "hi", "ends").count()
    assert sizes.filter("count > 20 AND hi - lo > 1").count() == 0
    assert spelling.parts(words).groupBy("m", "lo", "hi", "ends").count().filter("count > 20").count() > 0
    got = {r.word: (r.n_near, r.near) for r in spelling.near_words(words, most=20).collect()}
    assert got == {r.word: (r.n_near, r.near) for r in spelling.near_words(words).collect()}
    assert len(got) == 512 and {n for n, _ in got.values()} == {21}


def test_plain_counts_and_empty(spark):
    df = spark.createDataFrame([(1, "Tests, tests! TESTS tests2tests"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in spelling.variants(df, one_in=0).collect()] == [("tests", None, "tests", 5, 0, None)]
    assert spelling.variants(df.limit(0)).collect() == []
    assert spelling.variants(df.filter("doc_id = 2")).collect() == []
