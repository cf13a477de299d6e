"""Near-duplicates at a Jaccard similarity of word shingles: SimHash links first, an exact set-similarity join for the rest.

SimHash fingerprints within a few bits are found by the trie join (`simhash`) and kept if the whole sets of shingles are
similar enough. At a similarity of 0.8 two 64-bit fingerprints differ in some ten bits, sixteen at times; with such a budget
the tries would prune nothing. So the links that are left are found by an exact join:

A set is the 64-bit hashes of a text's shingles. In any order of all shingles, two sets that are similar enough share one
of their first n - ceil(similarity * n) + 1 shingles; so these prefixes are joined and no pair is missed. Shingles that a
sample finds in several texts come last in the order, the most frequent at the end, which changes the cost, not the result. A candidate has to pass the
sizes, the shingle's places in both sets and a sketch of parities, all of which only rule out pairs that cannot be similar
enough, and then the comparison of the whole sets.

Large groups of near copies are linked in steps: SimHash's links and each shared shingle's texts with a central one first; then,
some rounds long, the texts outside a shingle's largest component with one text of another component, another one for
each shingle and round; at last the pairs that are still in different components. What the last step compares is the
texts that few others are similar to, times the texts they share a prefix's shingle with: it grows with the square of a
group only where the group's texts are like many and similar to none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, parallel, pieces, stored
from .components import components
from .simhash import _signed, links, majority, shingles

#: Texts of the sample that tells common shingles, at least, and one in so many of larger tables: a fixed number would let shingles of ever
#: more texts pass for rare, and the pairs of texts that share one grow as the square.
SAMPLE = 4096
ONE_IN = 8
#: Rounds in which texts of different components meet one by one before all such pairs do; changes the cost, not the result.
ROUNDS = 2
#: Pairs for each row that the last step may make without such rounds.
WORTH = 8
#: New links for each row that make another round worth while.
LINKED = 0.01
MOST_COMMON = 1 << 17


def shingle_set(text: bytes | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """Hashes of a text's different shingles, ascending; none for a text without words."""
    return distinct(shingles(text, width, seed))


def distinct(hashes: list[bytes]) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(hashes), np.uint64))


def sketch(s: np.ndarray) -> bytes:
    """Parities of the shingles' numbers by their low bits: two sketches differ in no more bits than their sets have different shingles.

    A sketch has two to four bits a shingle, 1024 at least; XOR of its halves is the sketch of half the size.
    """
    bits = max(1024, 1 << (2 * len(s)).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 != 0).tobytes()


def sketches_differ(x: bytes, y: bytes) -> int:
    p, q = (np.frombuffer(z, np.uint64) for z in sorted((x, y), key=len))
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def prefix(s: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The shingles of which a similar set shares at least one, in the order of all shingles: those that aren't common, then the common ones by their rank."""
    if not len(s):
        return s
    hashes, rank = common
    at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
    last = hashes[at] == s if len(hashes) else np.zeros(len(s), bool)
    tail = s[last][np.argsort(rank[at[last]], kind="stable")] if len(hashes) else s[:0]
    return np.concatenate((s[~last], tail))[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1]


def sampled(n: int) -> int:
    return min(n, max(SAMPLE, n // ONE_IN))


def _common(rows: DataFrame, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that three or more texts of a sample have, ascending, and their ranks, the rarest first."""

    def run(batches):
        for batch in batches:
            for b in pieces(batch, 0):
                found = [shingle_set(t, width, seed) for t in as_bytes(b.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    if (n := rows.count()) > SAMPLE:
        rows = rows.filter(F.xxhash64("__uid") < int(-(2**63) + sampled(n) / n * 2.0**64))
    found = rows.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 2")
    hashes = np.array([r["h"] for r in found.orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], len(order) - order


def _near(na, nb, at_a, at_b, similarity: float):
    """Whether sets of these sizes may be similar enough if the shingles at these places are the first that they share."""
    least = similarity / (1 + similarity) * (na + nb) - 1e-9
    return (F.least(na - at_a, nb - at_b) >= least) & (F.least(na, nb) >= similarity * F.greatest(na, nb) - 1e-9)


#: The 256 bits of the smallest sketch as columns, which a join's condition can compare.
FOLDED = ("s0", "s1", "s2", "s3")


def folded(s: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1 != 0).view(np.int64)


def _alike(na, nb, bits, others, similarity: float):
    """Whether the folded sketches allow the similarity: they differ in no more bits than the sets have different shingles."""
    differ = sum(F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(bits, others, strict=True))
    return differ <= (na + nb) * ((1 - similarity) / (1 + similarity)) + 1e-9


def _sketched(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of sets whose sketches allow the similarity."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                na, nb = (b.column(k).to_numpy() for k in (2, 3))
                differ = np.array([sketches_differ(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)])
                most = (na + nb) * ((1 - similarity) / (1 + similarity)) + 1e-9
                yield b.select(["a", "b"]).filter(pa.array(differ <= most))

    sides = [sets.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, rows: DataFrame, sets: DataFrame, similarity: float, width: int, seed: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def read(batches):
        for batch in batches:
            for b in pieces(batch, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, width, seed).tobytes() for t in as_bytes(b.column(1))], pa.binary())], names=["key", "set"])

    def run(batches):
        for batch in batches:
            for b in pieces(batch):
                good = []
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    good.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
                yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = cut(_sketched(pairs.distinct(), sets, similarity))
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(sets.select("key", "__uid"), "key"))  # of known size: broadcast if small
    whole = stored(rows.join(wanted, "__uid").select("key", "text").mapInArrow(read, "key long, set binary"))
    sides = [whole.select(F.col("key").alias(c), F.col("set").alias(f"s{c}")) for c in "ab"]
    return cut(pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"))


def _shared(sets: DataFrame) -> DataFrame:
    """(h, key, n, at): the places of shingles that the prefixes of two or more sets share."""

    def spread(batches):
        for batch in batches:
            for b in pieces(batch):
                found = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
                sizes = np.array([len(x) for x in found], np.int64)
                at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                key, n = (np.repeat(b.column(k).to_numpy(), sizes) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(key), pa.array(n), pa.array(at.astype(np.int32))], names=["h", "key", "n", "at"])

    def run(batches):
        """Rows whose shingle the row before or after has as well; one row is held back for the next batch."""
        held, joined = None, False
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if held is None else [held, b])
            h = t.column("h").to_numpy()
            same = h[1:] == h[:-1]
            keep = np.concatenate(([joined], same)) | np.concatenate((same, [False]))
            yield from t.slice(0, len(h) - 1).filter(pa.array(keep[:-1])).to_batches()
            held, joined = t.slice(len(h) - 1).combine_chunks().to_batches()[0], bool(keep[-1])
        if held is not None and joined:
            yield held

    schema = "h long, key long, n int, at int"
    rows = sets.select("key", "n", "prefix").mapInArrow(spread, schema)
    return rows.repartition(parallel(sets), "h").sortWithinPartitions("h").mapInArrow(run, schema)


def _with_central(shared: DataFrame) -> DataFrame:
    """shared with (b, nb, bt), up to two texts for each row: the central one of its shingle, and of the shingle's texts of like size.

    Central is the text with the fewest shingles ahead of the shared one, which are rarer ones: a text that others are
    copies of has none of its own. It is similar to copies that are not similar enough to each other.
    """
    sized = shared.withColumn("size", F.floor(F.log("n") / math.log(1.25)))
    central = F.min(F.struct(F.col("at").alias("bt"), F.col("key").alias("b"), F.col("n").alias("nb"))).alias("f")
    own = sized.groupBy("h", "size").agg(central)
    of_all = own.groupBy("h").agg(F.min("f").alias("f"))
    found = [sized.join(own, ["h", "size"]), sized.join(of_all, "h")]
    return found[0].select(*shared.columns, "f.*").unionByName(found[1].select(*shared.columns, "f.*"))


def _apart(shared: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of shared whose shingle has texts in several components, with each text's label and `large`, the shingle's most frequent; written once."""
    rows = _labelled(shared.select("h", "key", "n", "at"), edges)
    sizes = rows.groupBy("h", "label").agg(F.count("*").alias("size"))
    large = sizes.groupBy("h").agg(F.max_by("label", F.struct("size", "label")).alias("large"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    return stored(rows.join(large, "h"))


def _left(apart: DataFrame) -> tuple[int, int]:
    """(rows, pairs): how many rows there are, and how many pairs the last step would bring together for them."""
    sizes = apart.groupBy("h").agg(F.count("*").alias("all"), F.count(F.when(F.col("label") != F.col("large"), 1)).alias("rest"))
    got = sizes.agg(F.sum("all"), F.sum(F.col("all") * F.col("rest"))).first()
    return got[0] or 0, got[1] or 0


def _one_each(apart: DataFrame, turn: int) -> DataFrame:
    """apart, less the texts of the largest components, with (b, nb, bt): a text of the shingle's largest component and one of any, both by a hash of the turn."""
    order = F.xxhash64("h", "key", F.lit(turn))
    pick = F.min(F.struct(order.alias("order"), F.col("key").alias("b"), F.col("n").alias("nb"), F.col("at").alias("bt"), F.col("label").alias("lb"))).alias("f")
    rest = apart.filter("label != large")
    found = [rest.join(side.groupBy("h").agg(pick), "h").select(*apart.columns, "f.*") for side in (apart.filter("label = large"), apart)]
    return found[0].unionByName(found[1]).filter("label != lb")


def _labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    label = cut(components(edges))
    return rows.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))


def _simhash_pairs(sets: DataFrame, budget: int) -> DataFrame:
    """(a, b): sets whose fingerprints are equal, and a spanning forest of those whose fingerprints differ in `budget` bits at most."""
    first = cut(sets.groupBy("fp").agg(F.min("key").alias("first")))
    same = sets.join(first, "fp").filter("key != first").select("key", F.col("first").alias("b"))
    sides = [first.select(F.col("fp").alias(c), F.col("first").alias(f"k{c}")) for c in "ab"]
    near = links(first, budget).join(sides[0], "a").join(sides[1], "b").select(F.col("ka").alias("key"), F.col("kb").alias("b"))
    return same.unionByName(near)


def similar_classes(rows: DataFrame, similarity: float = 0.8, width: int = 5, seed: int = 42, budget: int = 4) -> DataFrame:
    """(__uid, __class) of rows (__uid, text): rows are of one class where links between similar texts lead from one to the other.

    A text of fewer than `width` words is one shingle; texts without words (null, empty, white space) are all alike, and
    like no other. Repeats of a shingle in a text count once. `similarity` is above 0.
    """
    common = _common(rows, width, seed)
    shared_common = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for batch in batches:
            for b in pieces(batch, 1):
                hashes = [shingles(t, width, seed) for t in as_bytes(b.column(1))]
                found = [distinct(h) for h in hashes]
                cols = [
                    pa.array([_signed(majority(h)) for h in hashes], pa.int64()),
                    pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in found], np.uint64).view(np.int64)),
                    pa.array([len(s) for s in found], pa.int32()),
                    pa.array([sketch(s) for s in found], pa.binary()),
                    pa.array([prefix(s, shared_common.value, similarity).tobytes() for s in found], pa.binary()),
                    *(pa.array(x) for x in np.array([folded(s) for s in found], np.int64).reshape(-1, 4).T.copy()),
                ]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["__uid", "fp", "key", "n", "sketch", "prefix", *FOLDED])

    every = stored(rows.select("__uid", "text").mapInArrow(run, "__uid long, fp long, key long, n int, sketch binary, prefix binary, " + ", ".join(f"{c} long" for c in FOLDED)))
    sets = every.join(every.groupBy("key").agg(F.min("__uid").alias("__uid")).select("__uid"), "__uid", "left_semi")  # one row of equal sets
    small = cut(sets.select("key", "__uid", "fp", "n", "sketch", *FOLDED))
    shared = stored(_shared(sets))

    near = _near(F.col("n"), F.col("nb"), F.col("at"), F.col("bt"), similarity)

    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b"))

    pairs = ordered(_simhash_pairs(small.select("key", "fp"), budget)).unionByName(ordered(_with_central(shared).filter((F.col("key") != F.col("b")) & near)))
    edges = _verified(pairs, rows, small, similarity, width, seed)
    apart = _apart(shared, edges)
    for turn in range(ROUNDS):
        texts, meetings = _left(apart)
        if meetings <= WORTH * texts:
            break
        found = _verified(ordered(_one_each(apart, turn).filter(near)), rows, small, similarity, width, seed)
        n = found.count()
        if n:
            edges = cut(edges.unionByName(found))
            apart = _apart(apart, edges)
        if n < LINKED * texts:  # texts that share shingles and are not similar
            break
    # of a shingle's texts, those in its largest component need to meet the others only; texts that share shingles and are not similar
    # meet within the join alone, by their folded sketches
    apart = apart.join(small.select("key", *FOLDED), "key")
    others = [f"b{c}" for c in FOLDED]
    other = apart.select("h", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("at").alias("bt"), F.col("label").alias("lb"), (F.col("label") == F.col("large")).alias("main"), *[F.col(c).alias(o) for c, o in zip(FOLDED, others, strict=True)])
    possible = near & _alike(F.col("n"), F.col("nb"), FOLDED, others, similarity)
    met = apart.filter("label != large").join(other, "h").filter((F.col("label") != F.col("lb")) & (F.col("main") | (F.col("key") < F.col("b"))) & possible)
    edges = edges.unionByName(_verified(ordered(met), rows, small, similarity, width, seed))
    return _labelled(every.select("__uid", "key"), edges).select("__uid", F.col("label").alias("__class"))


def one_of_each(docs: DataFrame, similarity: float = 0.8, width: int = 5, seed: int = 42) -> DataFrame:
    """docs with one row of each group of near-duplicates, the one with the smallest doc_id; all columns stay.

    Rows with null or repeated doc_ids count one by one: of equal ids the first row read stays, null ids only where the
    group has no other. Texts without words are one group. Columns of any name stay. An empty table gives an empty table.
    A text's shingles are hashed in one task: about 60 bytes a word. The rows are numbered in a table that is written first.
    """
    number = "__uid"
    while number in docs.columns:
        number += "_"
    rows = stored(docs.withColumn(number, F.monotonically_increasing_id()))
    ids = rows.select(F.col(number).alias("__uid"), "doc_id")
    classes = similar_classes(rows.select(F.col(number).alias("__uid"), F.col("text").cast("string").alias("text")), similarity, width, seed)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__uid"))
    kept = ids.join(classes, "__uid").groupBy("__class").agg(first.alias("x")).select(F.col("x.__uid").alias(number))
    return rows.join(kept, number, "left_semi").select(docs.columns)
