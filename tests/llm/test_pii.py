import hashlib
import itertools
import re

import numpy as np
import pytest

from sanguine.llm import pii
from sanguine.llm.bilstm_crf import Tagger


@pytest.fixture(scope="module")
def tagger():
    words = "the of and tion ing er with was that this here thou in left of version more at no all rest come point follows else stands before".split()
    rng = np.random.default_rng(1)
    sample = []
    for k in range(150):
        base = " ".join(rng.choice(words, 12))
        extra = [f"{k} items in 2024", "", f"call +44 (20) 555-01{k % 90 + 10} now", f"at 10.0.{k % 255}.7 ok", f"x{k}@mail.example.org"][k % 5]
        sample.append(f"{base[:30]} {extra} {base[30:]}"[: pii.SIZE])
    return pii.train(sample)


def test_gradients():
    g = Tagger(2, embed=3, hidden=4)
    g.p = {k: v.astype(np.float64) for k, v in g.p.items()}
    rng = np.random.default_rng(0)
    ids = rng.integers(1, 30, (3, 7))
    ids[1, 5:] = 0
    tags = np.array([[0, 1, 2, 0, 3, 4, 0], [1, 2, 0, 0, 0, 0, 0], [3, 0, 0, 0, 1, 2, 2]])
    _, grad = g.step(ids, tags)
    for k, p in g.p.items():
        at = (int(ids[0, 2]), 1) if k == "E" else (0, 1) if k == "T" else tuple(rng.integers(0, s) for s in p.shape)
        was = p[at]
        loss = []
        for d in (1e-3, -1e-3):
            p[at] = was + d
            loss.append(g.step(ids, tags)[0])
        p[at] = was
        assert abs((loss[0] - loss[1]) / 2e-3 - grad[k][at]) < 2e-4, k


def slow_base(text):
    out = []
    for kind, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = [True, max(map(int, m[0].split("."))) <= 255 if kind == 1 else True, 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15][kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans():
    rng = np.random.default_rng(2)
    parts = ["a", "b.c", "@", ".", "x@y.z", "@@", "1.2.3.4", "255.256.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (202) 555-0143", "+", "-", " ", "  ", "é", "00", "7", "%", "a@b", ".com", "\n", "+12345678", "0000.1.1.1"]
    for _ in range(3000):
        t = "".join(rng.choice(parts, rng.integers(0, 12)))
        assert pii.base_spans(t) == slow_base(t), repr(t)


def written_elsewhere(rng):
    """Personal data as people write it, in forms of this test's own."""
    pick = lambda *xs: xs[int(rng.integers(0, len(xs)))]
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    name, place = pick("maria", "j.smith", "Olga_K", "li-wei", "andré", "peter77", "t.o.m", "naïma"), pick("uni-bonn", "gmx", "posteo", "web2", "my.company", "ox")
    kind = int(rng.integers(0, 4))
    if kind == 0:
        return pick(f"{name}@{place}.se", f"{name}@{place}.info", f"{name}é@{place}.it", f"{name} @ {place}.ch", f"{name}[at]{place}.nl"), kind
    if kind == 1:
        a = [str(x) for x in rng.integers(1, 256, 4)]
        return pick(".".join(a), "[.]".join(a), " . ".join(a), ".".join(a) + "/24", ".".join(a)), kind
    if kind == 2:
        d = "4" + n(14)
        d += next(str(x) for x in range(10) if pii.luhn(d + str(x)))
        return pick(".", "/", " ", "  ", "-", "").join(d[k : k + 4] for k in range(0, 16, 4)), kind
    return pick(f"020 {n(4)} {n(4)}", f"07{n(3)} {n(6)}", f"(212) {n(3)}-{n(4)}", f"+44-20-{n(4)}-{n(4)}", f"+33 {n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"212.{n(3)}.{n(4)}", f"0049 30 {n(6)}", f"030/{n(3)}{n(4)}", f"+1 415 {n(3)} {n(4)}"), kind


def test_forms_never_trained_on_are_found_and_plain_text_is_left(tagger):
    rng = np.random.default_rng(77)
    texts, want = [], []
    for _ in range(400):
        v, kind = written_elsewhere(rng)
        head = "something else that stands before the point " * int(rng.integers(1, 9))
        texts.append(f"{head}and {v} follows here with the rest of it to come.")
        want.append((len(head) + 4, kind, len(head) + 4 + len(v)))
    found = [f[1] for f in pii._found(texts, tagger)]
    hit = [any(a < w[2] and w[0] < b for a, _, b in f) for w, f in zip(want, found, strict=True)]
    base = [any(a < w[2] and w[0] < b for a, _, b in pii.base_spans(t)) for t, w in zip(texts, want, strict=True)]
    right = sum(any(a < w[2] and w[0] < b for w in [w]) for w, f in zip(want, found, strict=True) for a, _, b in f)
    assert np.mean(hit) >= 0.9 > np.mean(base) + 0.2 and right / sum(map(len, found)) >= 0.95
    plain = ["In 1984 there were 12 of 300 left, 4.5 per cent.", "version 10.2 and 7 more at 9:30", "no digits at all " * 500]
    assert all(f[1] == [] for f in pii._found(plain, tagger))


def test_secrets_only_when_asked_for(tagger):
    text = 'and so on token = "59b79a44c83160ff605db5295c3f1b8f59a30bf7" of that'
    assert pii._found([text], tagger)[0][1] == []
    assert any(k == 4 for _, k, _ in pii._found([text], tagger, kinds=5)[0][1])


def slow_best(tagger, e):
    """The best path of one window's scores by trying all."""
    tr = tagger._transitions()
    best = None
    for path in itertools.product(range(tagger.tags), repeat=len(e)):
        if path[0] and path[0] % 2 == 0:
            continue
        score = sum(e[t, k] for t, k in enumerate(path)) + sum(tr[a, b] for a, b in zip(path, path[1:]))
        if best is None or score > best[0]:
            best = score, path
    return best


def test_viterbi_and_its_shortcut_match_all_paths():
    rng = np.random.default_rng(3)
    for turn in range(60):
        t = Tagger(2, embed=3, hidden=4, seed=turn)
        t.p["T"] = rng.normal(0, 1.5, t.p["T"].shape).astype(np.float32)
        e = rng.normal(0, 2, (5, 4, t.tags)).astype(np.float32)
        e[..., 0] += turn / 10
        paths = t.viterbi(e)
        may = t._may_tag(e)
        for w in range(4):
            score, path = slow_best(t, e[:, w])
            assert tuple(paths[w]) == path and (may[w] or not any(path))
            for _, a, end, lead in t.margins(e[:, [w]], paths[[w]]):
                rest = list(path)
                rest[a:end] = [0] * (end - a)
                tr = t._transitions()
                other = sum(e[i, w, k] for i, k in enumerate(rest)) + sum(tr[x, y] for x, y in zip(rest, rest[1:]))
                assert end == len(path) or path[end] % 2 == 1 or path[end] == 0
                assert abs(score - other - lead) < 1e-3


def test_emissions_are_the_scores():
    t, rng = Tagger(3, embed=5, hidden=6), np.random.default_rng(1)
    ids = rng.integers(1, 90, (7, 20))
    assert np.allclose(t.emissions(ids), t.scores(ids)[0], atol=1e-4)


class Stub:
    """Tags that follow from a window's own characters and places only."""

    least = 0.0

    def decode(self, ids, least):
        k = np.arange(ids.shape[1])
        return np.where(ids == 0, 0, (ids.astype(int) * 7 + k // 9 * 5 + ids[:, :1]) % 4 // 2 * ((ids + k // 9) % 3)).astype(np.int8)


def slow_tagged(text):
    """Each character by the window whose edge is farthest from it; an end of the text is no edge."""
    size, stride = pii.SIZE, pii.STRIDE
    starts = [0]
    while starts[-1] + size < len(text):
        starts.append(starts[-1] + stride)
    rows = []
    for s in starts:
        ids = np.zeros((1, size), np.uint8)
        part = pii.char_ids(text[s : s + size])
        ids[0, : len(part)] = part
        rows.append(Stub().decode(ids, 0.0)[0])
    tags = []
    for p in range(len(text)):
        best = max((min(p - s if s else 10**9, s + size - 1 - p if s != starts[-1] else 10**9), j) for j, s in enumerate(starts) if s <= p < s + size)
        tags.append(int(rows[best[1]][p - starts[best[1]]]))
    out, p = [], 0
    while p < len(tags):
        q = p + 1
        if tags[p]:
            while q < len(tags) and tags[q] and tags[q] % 2 == 0 and (tags[q] - 1) // 2 == (tags[p] - 1) // 2:
                q += 1
            out.append((p, (tags[p] - 1) // 2, q))
        p = q
    return out


def test_windows_are_reconciled_over_the_whole_text():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abc 12é."), n)) for n in (0, 1, 100, 287, 288, 289, 543, 544, 545, 1000, 2000)]
    assert pii.tagged(texts, Stub(), batch=3) == [slow_tagged(t) for t in texts]


def test_spans_over_window_edges(tagger):
    """The same text at any offset to the grid gives the base spans unchanged and only valid additions."""
    for shift in range(0, 70, 7):
        t = "w " * shift + "mail joe.doe@example.org or +1 (202) 555-0143 today"
        base, spans = pii._found([t], tagger)[0]
        assert set(base) <= set(spans) and len(base) == 2
        for a, _, b in set(spans) - set(base):
            assert not any(a < y and x < b for x, _, y in base)


def test_find_and_redact(spark, tagger):
    texts = [None, "", "é😀 joe@x.org 1.2.3.4", "joe@x.org", "x" * 200_000 + " 4111 1111 1111 1111", "joe@x.org"]
    df = spark.createDataFrame([(None if k == 3 else k % 5, t, "keep", k) for k, t in enumerate(texts)], "doc_id long, text string, spans string, n_ip int").repartition(2)
    got = sorted(pii.find_pii(df, tagger).collect(), key=str)
    assert [tuple(r)[1:5] for r in sorted(got, key=lambda r: (str(r.doc_id), r.n_ip))] == [(0, 0, 0, 0), (1, 0, 0, 0), (0, 0, 0, 0), (1, 1, 0, 0), (0, 0, 1, 0), (1, 0, 0, 0)]
    by = {r.doc_id: r for r in got}
    assert by[2].base_sha256 == hashlib.sha256(b"email:3:12,ip:13:20").hexdigest() and by[2].spans == "email:3:12,ip:13:20"
    assert by[1].spans == "" and by[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    red = pii.redact(df, tagger).collect()
    assert {r.n_ip: r.text for r in red}[2] == "é😀 <EMAIL> <IP>" and {r.n_ip: r.text for r in red}[0] is None and all(r.spans == "keep" for r in red)
    assert pii.find_pii(df.limit(0), tagger).collect() == []
