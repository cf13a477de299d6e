import numpy as np

from sanguine.llm.similar import one_of_each, similar_classes


def slow_set(text, width=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x or y else 1.0


def slow_classes(texts, similarity=0.8):
    sets = [slow_set(t) for t in texts]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and jaccard(sets[i], sets[j]) >= similarity:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def planted():
    """Texts and copies of them at similarities from under 0.8 to 0.95, and a group of near copies with a common passage."""
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(3000)]
    passage = rng.choice(words, 12).tolist()
    texts = [None, "", " \n", "one two", "One  two", "one two three", "a b c d e", "a b c d e f"]
    for k in range(40):
        base = rng.choice(words, rng.integers(20, 400)).tolist()
        if k % 2:
            base += passage
        texts.append(" ".join(base))
        for share in (0.005, 0.01, 0.015, 0.02, 0.025, 0.03):
            near = list(base)
            for place in rng.choice(len(near), max(1, round(share * len(near))), replace=False):
                near[place] = "changed"
            texts.append(" ".join(near))
        texts.append(" ".join(base[: round(0.82 * len(base))]))
    for _ in range(60):
        near = list(base)
        near[rng.integers(0, len(near))] = str(rng.integers(0, 10**6))
        texts.append(" ".join(near))
    return texts


def test_classes_match_all_pairs(spark):
    texts = planted()
    sets = [slow_set(t) for t in texts]
    between = [j for k in range(8, 8 + 40 * 8, 8) for i in range(k + 1, k + 8) if 0.8 <= (j := jaccard(sets[k], sets[i])) < 0.95]
    assert len(between) > 100 and sum(j < 0.9 for j in between) > 50
    rows = spark.createDataFrame(list(enumerate(texts)), "__uid long, text string")
    got = {r["__uid"]: r["__class"] for r in similar_classes(rows).collect()}
    first: dict = {}
    assert [first.setdefault(got[k], k) for k in range(len(texts))] == slow_classes(texts)


def test_one_of_each(spark):
    texts = planted()[:60]
    want = sorted({c for c in slow_classes(texts)})
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in one_of_each(docs).collect()) == want
    assert one_of_each(docs.limit(0)).collect() == []


def test_clashing_columns_and_ids(spark):
    texts = ["a b c d e f", "A b c d e f", None, "", "x y"]
    df = spark.createDataFrame([(i, t, k, "z") for k, (i, t) in enumerate(zip([None, 4, None, None, 4], texts, strict=True))], "doc_id long, text string, __uid int, __class string")
    got = one_of_each(df)
    assert got.columns == df.columns and sorted(r["__uid"] for r in got.collect()) in ([1, 2, 4], [1, 3, 4])


def test_form_letters_are_not_all_compared(spark, monkeypatch):
    """Texts of forty segments, each with a variant in one of twelve: most pairs are close to the bound, few texts are like many."""
    from sanguine.llm import similar

    rng = np.random.default_rng(5)
    segments = [[" ".join(rng.choice(5000, 8).astype(str)) for _ in range(2)] for _ in range(40)]
    texts = [" ".join(s[int(rng.random() < 0.08)] for s in segments) for _ in range(240)]
    compared, whole = [], similar._verified

    def counted(pairs, *rest):
        pairs = similar.cut(pairs.distinct())
        compared.append(pairs.count())
        return whole(pairs, *rest)

    monkeypatch.setattr(similar, "_verified", counted)
    got = {r["__uid"]: r["__class"] for r in similar_classes(spark.createDataFrame(list(enumerate(texts)), "__uid long, text string")).collect()}
    first: dict = {}
    assert [first.setdefault(got[k], k) for k in range(len(texts))] == slow_classes(texts)
    assert sum(compared) < 0.4 * 240 * 239 / 2 and compared[-1] < 0.12 * 240 * 239 / 2, compared
