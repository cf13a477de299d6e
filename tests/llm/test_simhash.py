import numpy as np
import xxhash

from sanguine.llm.simhash import Forest, _signed, blocks, fingerprint, joined, links, near_duplicates, trie_join, walk


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps, budget=4):
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(x) for x in range(len(fps))]


def clustered(rng, n):
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    keys = []
    for _ in range(n):
        x = int(rng.choice(centres))
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            x ^= 1 << int(b)
        keys.append(x)
    return sorted(set(keys))


def test_fingerprint():
    for t in ["", None, "one", "A b  C", "a b c d e", "ÉA x\ty\nz É É É É É", "a " * 5000, "\x1c\x85 x", " \n"]:
        assert fingerprint(None if t is None else t.encode()) == slow_fingerprint(t)


def test_trie_join_matches_all_pairs():
    rng = np.random.default_rng(3)
    keys = clustered(rng, 700)
    for chunk in (3, 50, 1 << 15):
        got = trie_join(np.array(keys, np.uint64), np.zeros(len(keys), int), 4, chunk=chunk)
        assert got.tolist() == slow_components(keys)


def test_walk_carries_differing_bits():
    """Two nodes that are apart: only links between them, counted with the bits that differ above."""
    rng = np.random.default_rng(9)
    a, b = (sorted({int(x) >> 8 | top << 56 for x in rng.integers(0, 1 << 12, 60, dtype=np.uint64) << np.uint64(8)}) for top in (0b0011, 0b0110))
    keys = np.array(a + b, np.uint64)
    one = lambda *x: tuple(np.array([v]) for v in x)
    forest = Forest(len(keys))
    assert walk(keys, one(0, len(a), len(a), len(keys)), 4, *one(8, 2), forest) > 50
    label = list(range(len(keys)))
    for i in range(len(a)):
        for j in range(len(a), len(keys)):
            if (int(keys[i]) ^ int(keys[j])).bit_count() <= 4:
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    assert forest.label.tolist() == label


def test_nodes_are_split_on_the_documents(spark):
    """At sf0.1 each of the tries is walked down well below its roots, and links come from leaves of one fingerprint only."""
    texts = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text")
    fps = np.array(sorted({fingerprint((r.text or "").encode()) for r in texts.collect()}), np.uint64)
    for first, width in blocks(4):
        key = np.sort(fps << np.uint64(first) | (fps >> np.uint64(64 - first) if first else np.uint64(0)))
        root = (key >> np.uint64(64 - width)).astype(np.int64)
        n = len(key)
        zero = np.zeros(n, np.int64)
        a, b, splits = joined([zero, root, zero, zero, zero, zero, key.view(np.int64)], 4)
        roots = np.unique(root, return_counts=True)[1]
        assert splits > 3 * (roots > 1).sum() and len(a)


def test_links_of_split_roots(spark):
    """Roots over `most` are walked as pairs of their descendants: the components stay those of all pairs."""
    keys = clustered(np.random.default_rng(12), 500)
    want = slow_components(keys)
    df = spark.createDataFrame([(_signed(k),) for k in keys], "fp long")
    for most in (1 << 18, 16, 2):
        label = list(range(len(keys)))
        place = {_signed(k): n for n, k in enumerate(keys)}
        for r in links(df, most=most).collect():
            x, y = sorted((label[place[r.a]], label[place[r.b]]))
            label = [x if v == y else v for v in label]
        assert label == want


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    texts = [None, "", " \n", "one two", "one two", "x" * 70000 + " y"]
    for _ in range(40):
        base = rng.choice(words, rng.integers(1, 300)).tolist()
        texts.append(" ".join(base))
        for _ in range(3):
            near = list(base)
            near[rng.integers(0, len(near))] = "changed"
            texts.append(" ".join(near))
    ids = [None, *range(1, len(texts) - 1), 1]  # a null id and a repeated one
    df = spark.createDataFrame(list(zip(ids, texts, texts, strict=True)), "doc_id long, text string, component_id string")
    for most in (4096, 4):
        got = near_duplicates(df, most=most).collect()
        fps = [slow_fingerprint(t) for t in texts]
        part = slow_components(fps)
        least = {c: min((i for i, p in zip(ids, part, strict=True) if p == c and i is not None), default=None) for c in part}
        want = sorted(((str(i), f"{f:016x}", least[c]) for i, f, c in zip(ids, fps, part, strict=True)), key=str)
        assert sorted(((str(r[0]), r[1], r[2]) for r in got), key=str) == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).collect() == []
