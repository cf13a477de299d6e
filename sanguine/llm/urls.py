"""URL filters: rules by host and path, and personalised PageRank of trust and distrust over a graph of hosts.

The graph has an edge from a host to each host its pages link to, as heavy as the pages that do, and edges between a host
and its parent domain. Trust flows along the edges from hosts with allowed pages, distrust against them from hosts with
blocked pages. Both are Neumann series of the rank's equation, y = seeds + damping x flow(y): scaled to a sum of one that is
the personalised PageRank whose dangling hosts return to the seeds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_key, cut, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Where a page links to: other places than its own host begin with a scheme or two slashes.
_LINK = r"""(?is)<a\s[^>]*?\bhref\s*=\s*["']?((?:https?:)?//[^"'\s>]*)"""


@dataclass(frozen=True)
class Rule:
    """Fits urls of `host` and its subdomains whose path starts with `path`."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Flow:
    """damping: the share of a host's rank that goes on; rounds: terms of the series (what they leave out is damping ** rounds
    of the whole); kin: weight of the edges between a host and its parent domain, beside a link's 1 for each page; limit: a host is blocked if
    distrust is over this share of trust and distrust."""

    damping: float = 0.85
    rounds: int = 24
    kin: float = 1.0
    limit: float = 0.5


RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: str | Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null and where there is no `://`."""
    return F.translate(F.regexp_extract(text_or_empty(url), _PARTS, 1), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for null and where there is no `://`."""
    return F.regexp_extract(text_or_empty(url), _PARTS, 2)


def domains(host: str | Column) -> Column:
    """A host and the domains above it: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels) - k + 1), "."))


def with_rules(places: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """places (host, path, ...) with `rule` and `ruled`, name and verdict of the longest rule that fits, else null.

    Of rules of one name the last is taken. Rules are looked up once a host, by its domains; then a host's own rules, longest
    first, are tried on each path. All rules may be one host's: policies of a few million rules fit, since they are
    joined by host, but those of a single host are one array.
    """
    spark = places.sparkSession
    last = {r.name: r for r in rules}
    table = spark.createDataFrame([(r.host, r.path, r.verdict, name, len(name)) for name, r in last.items()], "domain string, start string, verdict string, name string, n int")
    hosts = places.groupBy("host").agg(F.count("*").alias("n"))
    fits = hosts.select("host", F.explode(domains("host")).alias("domain")).join(table, "domain")
    own = fits.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("n", "name", "start", "verdict")), asc=False).alias("rules"))
    hit = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"])), F.lit(0))
    joined = by_key(places, hosts.join(own, "host"), "host", "n")
    return joined.withColumn("__hit", hit).withColumn("rule", F.col("__hit.name")).withColumn("ruled", F.col("__hit.verdict")).drop("rules", "__hit")


def host_edges(pages: DataFrame, places: DataFrame, flow: Flow = Flow()) -> DataFrame:
    """(src, dst, w): links between different hosts by the number of pages that make them, and both ways between each host, or domain of one, and the domain above it."""
    found = pages.select(host_of("url").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(text_or_empty("html"), F.lit(_LINK), F.lit(1)), lambda link: host_of(F.concat(F.lit("x:"), F.regexp_replace(link, "(?is)^https?:", "")))))).alias("dst"))
    links = found.filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    hosts = places.filter("host <> ''").select("host").distinct().unionByName(links.select(F.col("dst").alias("host"))).distinct()
    chain = hosts.select(F.explode(domains("host")).alias("src")).distinct().select("src", F.regexp_replace("src", r"^[^.]*\.?", "").alias("dst")).filter("src <> '' AND dst <> ''")
    kin = chain.unionByName(chain.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("w", F.lit(float(flow.kin)))
    return links.unionByName(kin).filter("w > 0").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _shares(edges: DataFrame) -> DataFrame:
    """(kind, src, dst, share): what part of src's rank goes to dst; kind 0 along the edges, 1 against them."""
    ways = edges.select(F.lit(0).alias("kind"), "src", "dst", "w").unionByName(edges.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    whole = ways.groupBy("kind", "src").agg(F.sum("w").alias("whole"))
    return ways.join(whole, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("whole")).alias("share"))


def propagated(edges: DataFrame, seeds: DataFrame, flow: Flow = Flow()) -> DataFrame:
    """(host, trust, distrust): the two ranks, each of sum one, for all hosts that any of it reaches.

    edges: (src, dst, w), each pair once; seeds: (host, trusted, blocked), weights of the seeds, each host once. Without
    trusted (blocked) seeds there is no trust (distrust). A round is one join by host and one sum that is combined before its
    shuffle; edges of a hub are split by Spark where they are skewed. The driver sees nothing but the rounds' number.
    """
    both = seeds.select("host", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("double").alias("s")) for k, c in enumerate(("trusted", "blocked"))])).alias("x")).select("x.kind", "host", "x.s").filter("s > 0")
    both = cut(both)
    shares, rank = cut(_shares(edges).withColumnRenamed("src", "host")), both
    for k in range(flow.rounds):
        moved = rank.join(shares, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.lit(flow.damping) * F.col("s") * F.col("share")).alias("s"))
        rank = both.unionByName(moved).groupBy("kind", "host").agg(F.sum("s").alias("s"))
        if k % 4 == 3:
            rank = cut(rank)
    rank = cut(rank)
    whole = F.broadcast(rank.groupBy("kind").agg(F.sum("s").alias("whole")))  # two rows
    scaled = rank.join(whole, "kind").withColumn("s", F.col("s") / F.col("whole"))
    part = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("s"))), F.lit(0.0))
    return scaled.groupBy("host").agg(part(0).alias("trust"), part(1).alias("distrust"))


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, flow: Flow = Flow()) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each row of pages (page_id, url, html).

    verdict: the longest fitting rule's, else the host's: block if its distrust is over flow.limit of both ranks (compared at
    twelve digits), allow otherwise. Hosts that neither rank reaches, among them the empty host of null urls and of urls without `://`,
    are allowed. Seeds are the hosts of pages that a rule allows or blocks, by the number of these pages; a host may be
    both. Ports and user names are parts of a host, as they stand. Rows stay rows: repeated pages, null ids and null html
    are kept; a page's links are read from its whole html. An empty table gives an empty table. Other columns are not read.
    """
    rows = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    places = cut(with_rules(rows, rules))
    of = lambda verdict: F.count(F.when(F.col("ruled") == verdict, 1))
    hosts = places.groupBy("host").agg(F.count("*").alias("n"), of("allow").alias("trusted"), of("block").alias("blocked"))
    ranks = propagated(host_edges(pages, places, flow), hosts.filter("host <> ''"), flow)
    known = hosts.select("host", "n").join(ranks, "host")
    out = by_key(places, known, "host", "n").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    bad = F.round(F.col("distrust") - F.lit(flow.limit) * (F.col("trust") + F.col("distrust")), 12) > 0
    verdict = F.coalesce("ruled", F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
