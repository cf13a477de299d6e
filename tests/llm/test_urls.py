from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sanguine.llm import urls
from sanguine.llm.urls import RULES, Flow, Rule

PAGES = [
    (1, "http://A.Good.example.net/en/1?x#y", '<a href="http://friend.org/x">f</a><a href=\'//friend.org/\'>again</a><a class=b href=https://Far.com?q>far</a>'),
    (2, "https://a.good.example.net/de/2", '<p>no link</p><a href="/own">own</a>'),
    (3, "http://friend.org/fr/2", '<A HREF="HTTP://next.io/p">n</A>'),
    (4, "http://friend.org", None),
    (5, "http://next.io/en", ""),
    (6, "http://bad.example.com/de/1", '<a href="http://friend.org/1">f</a>'),
    (7, "http://near-bad.io/", '<a href="http://bad.example.com/de/">b</a><a href="http://bad.example.com/fr/">b</a>'),
    (8, "http://bad.example.com/en/", "x" * 200_000 + '<a href="http://bad.example.com/">self</a>'),
    (9, "notexample.com/de/", "<a href='http://near-bad.io'>"),
    (10, None, None),
    (11, "http://notexample.com/de/?a", None),
    (12, "http://net", None),
    (13, "x://u@net:80/p/", None),
    (14, "http://alone.dev/", None),
    (14, "http://alone.dev/", None),
    (None, "http://m.org/fr/x://y", None),
]


def frame(spark):
    return spark.createDataFrame([(*p, "z", 0.5) for p in PAGES], "page_id long, url string, html string, host string, n double").repartition(3)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    tail = rest[cut:]
    return rest[:cut].lower(), tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]


def fits(host, path, rules):
    good = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(good, key=lambda r: (len(r.name), r.name), default=None)


def slow(pages, links, rules=RULES, flow=Flow()):
    rows = [(p, *parts(u)) for p, u, _ in pages]
    hit = [fits(h, x, rules) for _, h, x in rows]
    weights = Counter({(a, b): float(n) for (a, b), n in links.items()})
    names = {h for _, h, _ in rows if h} | {b for _, b in links}
    for name in names:
        labels = name.split(".")
        for k in range(len(labels) - 1):
            weights.setdefault(("kin", ".".join(labels[k:]), ".".join(labels[k + 1 :])), 1)
    edges = Counter()
    for key, w in weights.items():
        if key[0] == "kin":
            edges[key[1:]] += flow.kin
            edges[key[:0:-1]] += flow.kin
        else:
            edges[key] += w
    ranks = []
    for verdict, turn in (("allow", 0), ("block", 1)):
        seeds = Counter(h for (_, h, _), r in zip(rows, hit) if r and r.verdict == verdict and h)
        out = defaultdict(dict)
        for (a, b), w in edges.items():
            a, b = (b, a) if turn else (a, b)
            out[a][b] = w
        term, total = dict(seeds), Counter(seeds)
        for _ in range(flow.rounds):
            new = Counter()
            for a, s in term.items():
                for b, w in out[a].items():
                    new[b] += flow.damping * s * w / sum(out[a].values())
            total.update(new)
            term = new
        whole = sum(total.values()) or 1
        ranks.append({h: s / whole for h, s in total.items()})
    return rows, hit, [(ranks[0].get(h, 0.0), ranks[1].get(h, 0.0)) for _, h, _ in rows]


LINKS = {("a.good.example.net", "friend.org"): 1, ("a.good.example.net", "far.com"): 1, ("friend.org", "next.io"): 1, ("bad.example.com", "friend.org"): 1, ("near-bad.io", "bad.example.com"): 1}


@pytest.mark.parametrize("rules", [RULES, (*RULES, Rule("block", "friend.org", "/"), Rule("allow", "good.example.net", "/de/2"), Rule("allow", "", "/"), Rule("block", "friend.org", "/"))])
def test_against_brute_force(spark, rules):
    got = urls.judged(frame(spark), rules).collect()
    rows, hit, ranks = slow(PAGES, LINKS, rules)
    want = []
    for (p, h, x), r, (t, d) in zip(rows, hit, ranks):
        want.append((p, h, x, r.name if r else None, r.verdict if r else "block" if d > t + 1e-12 else "allow", round(t, 9), round(d, 9)))
    assert sorted(map(repr, want)) == sorted(repr((*r[:5], round(r.trust, 9), round(r.distrust, 9))) for r in got)


def test_links(spark):
    df = frame(spark)
    places = df.select(urls.host_of("url").alias("host"))
    found = {(r.src, r.dst): r.w for r in urls.host_edges(df, places, Flow(kin=0.0)).collect()}
    assert found == LINKS


def test_trust_reaches_linked_hosts_and_distrust_those_that_link(spark):
    got = {r.page_id: r for r in urls.judged(frame(spark)).collect()}
    assert got[5].verdict == "allow" and got[5].trust > got[5].distrust
    assert got[7].verdict == got[8].verdict == "block" and got[7].rule is None
    assert got[10].verdict == got[14].verdict == "allow" and got[10].host == got[10].path == ""
    assert got[12].rule is None and got[12].path == "" and got[13].host == "u@net:80"
    assert got[None].rule == "org/fr/" and got[None].path == "/fr/x://y"


def test_ranks_sum_to_one_and_hubs(spark):
    edges = [("hub", f"h{k}", 1.0) for k in range(3000)] + [(f"h{k}", "hub", 2.0) for k in range(1500)]
    df = spark.createDataFrame(edges, "src string, dst string, w double")
    seeds = spark.createDataFrame([("hub", 1, 0), ("h7", 0, 2), ("lost", 0, 0)], "host string, trusted long, blocked long")
    out = urls.propagated(df, seeds)
    s = out.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    assert abs(s.t - 1) < 1e-9 and abs(s.d - 1) < 1e-9
    none = urls.propagated(df, seeds.limit(0))
    assert none.collect() == []


def test_empty(spark):
    assert urls.judged(frame(spark).limit(0)).collect() == []
    assert {r.verdict for r in urls.judged(frame(spark), ()).collect()} == {"allow"}
