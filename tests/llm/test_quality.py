import re
from collections import Counter

import numpy as np

from sanguine.llm.quality import MEASURES, _part, judge, kept, labelled, learn, quality_rules

from ..conftest import SF

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    seen = Counter(grams)
    covered = {k + d for k, g in enumerate(grams) if seen[g] > 1 for d in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t", "one", "a b c d e", "a b c d e f a b c d e f", "a " * 9, "a " * 20_000, "x\ny\nx\n \n \nx", "é😀 #*$%&|<> " * 30, "\x0b a \x0c b\r\nc\x85d \xa0 e", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11", "long" * 50_000]


def test_base_counts(spark):
    docs = [(k if k != 4 else None, t, 1, "x") for k, t in enumerate(TEXTS)] + [(3, "one", 1, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_words int, m string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules(df, labels).collect()
    want = []
    for i, t, *_ in docs:
        n = slow(t)
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        want.append((i, *n, failed, not failed, 0))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert quality_rules(df.limit(0), labels).collect() == []


def test_native_plan(spark):
    df = judge(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), [])
    assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))


def test_learns_thresholds():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(MEASURES)))
    bad = (x[:, 3] > 0.8) | (x[:, 6] <= 0.1) & (x[:, 1] > 0.5)
    rules = learn(x, bad)
    hit = np.zeros(len(x), bool)
    for r in rules:
        hit |= r.holds(x)
    assert 1 < len(rules) < 24 and hit[bad].mean() > 0.9 and hit[~bad].mean() < 0.02
    assert learn(x, np.zeros(len(x), bool)) == [] == learn(x, np.ones(len(x), bool)) == learn(x[:0], bad[:0])


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet".replace("sf0.001", "sf0.01")) for t in ("documents", "labels"))
    rules = learn(*labelled(docs, labels.filter("doc_id % 3 > 0")))
    rows = judge(docs, rules).join(labels.filter("doc_id % 3 = 0").select("doc_id", "quality"), "doc_id").select("quality", "__q.kept").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert len(bad) > 10 and np.mean(bad) < 0.4 and np.mean(good) > 0.85


def test_list_does_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet".replace("sf0.001", "sf0.01")) for t in ("documents", "labels"))
    seen = []
    for n in (1, 4, 16, 64):
        rules = learn(*labelled(docs.repartition(n), labels.repartition(n)))
        seen.append((rules, sorted(r.doc_id for r in judge(docs.repartition(n), rules).filter("__q.kept").select("doc_id").collect())))
    assert seen[0][0] and all(s == seen[0] for s in seen)


def slow_learn(x, bad, keys, most_tests=4, thresholds=64, precision=0.97, least=3, most_misses=3):
    """Every test of every measure, counted row by row."""
    rows = list(zip(x.tolist(), bad.tolist(), keys.tolist(), strict=True))
    out, turn, misses = [], -1, 0
    while len(out) < 24 and misses < most_misses and 0 < sum(r[1] for r in rows) < len(rows):
        part = _part(np.array([r[2] for r in rows], np.uint64), turn := turn + 1)
        grow = inside = [r for r, g in zip(rows, part, strict=True) if g]
        prune = [r for r, g in zip(rows, part, strict=True) if not g]
        tests = []
        holds = lambda r, t: r[0][t[0]] > t[2] if t[1] else r[0][t[0]] <= t[2]
        while len(tests) < most_tests and 0 < sum(r[1] for r in inside) < len(inside):
            base = np.log2(np.mean([r[1] for r in inside]))
            best, found = 1e-9, None
            for k in range(len(MEASURES)):
                cuts = set()
                for kind in (True, False):
                    v = sorted(r[0][k] for r in inside if r[1] == kind)
                    cuts |= {v[int(q * (len(v) - 1) / thresholds)] for q in range(thresholds + 1)}
                for above in (False, True):
                    for c in sorted(cuts):
                        hit = [r[1] for r in inside if holds(r, (k, above, c))]
                        gain = sum(hit) * (np.log2(sum(hit) / len(hit)) - base) if any(hit) else 0
                        if gain > best + 1e-12:
                            best, found = gain, (k, above, c)
            if not found:
                break
            tests.append(found)
            inside = [r for r in inside if holds(r, found)]
        worths = []
        for n in range(1, len(tests) + 1):
            hit = [r[1] for r in prune if all(holds(r, t) for t in tests[:n])]
            worths.append((((2 * sum(hit) - len(hit)) / max(1, len(hit))), -n, sum(hit), len(hit)))
        _, n, p, total = max(worths, default=(0, 0, 0, 1))
        if p < least or p / total < precision:
            misses += 1
            continue
        misses = 0
        rule = tests[:-n]
        out.append(rule)
        rows = [r for r in rows if not all(holds(r, t) for t in rule)]
    return out


def test_learn_matches_exhaustive_search():
    rng = np.random.default_rng(4)
    for _ in range(3):
        x = np.round(rng.random((240, len(MEASURES))), 2)
        bad = (x[:, 3] > 0.8) | (x[:, 6] <= 0.2) & (x[:, 1] > 0.5)
        keys = rng.integers(0, 1 << 63, len(x), dtype=np.uint64)
        got = learn(x, bad, keys)
        want = slow_learn(x, bad, keys)
        assert got and [[(MEASURES.index(t.measure), t.above, t.threshold) for t in r.tests] for r in got] == want
        order = rng.permutation(len(x))
        assert learn(x[order], bad[order], keys[order]) == got


def test_kept_leaves_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l", 5, "y"), (2, "too short", 6, "z")], "doc_id long, text string, __q int, __q_ string")
    got = kept(df, [])
    assert got.columns == df.columns and [tuple(r)[2:] for r in got.collect()] == [(5, "y")]
