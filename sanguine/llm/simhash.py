"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a self-join of binary tries.

The join walks pairs of trie nodes together, bit by bit. A node is a run of sorted fingerprints that share a prefix; a pair
carries the number of bits in which the two prefixes differ, and is dropped as soon as this exceeds the budget. Two nodes
of one fingerprint each are a leaf: the bits that are left decide.

To spread the walk over tasks, the 64 bits are cut into budget + 1 blocks. Two fingerprints within the budget agree in a
block, so for each block there is one trie of all fingerprints, rotated to begin with the block, of which only the pairs
(node, same node) at the block's end are walked. Where such a node has more fingerprints than `most`, the pairs of its
descendants some levels below that are within the budget are each a task's group of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, by_key, cut, parallel, pieces
from .components import components

BITS = 64


def shingles(text: bytes | None, width: int, seed: int) -> list[bytes]:
    """XXH64 of all shingles, repeats included; of fewer than `width` words the only one; none for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_digest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    return [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """Majority of each bit over the XXH64 of all shingles, repeats included; 0 for a text without words."""
    return majority(shingles(text, width, seed))


def majority(hashes: list[bytes]) -> int:
    """The number whose bits are set in over half of the hashes; 0 of none."""
    if not hashes:
        return 0
    h = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(h[k : k + 4096], axis=1).sum(0, dtype=np.int64) for k in range(0, len(h), 4096))
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for each row; a null text has no words."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            for b in pieces(batch, 1):
                fps = [_signed(fingerprint(t, width, seed)) for t in as_bytes(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


def blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit from the left, width) of budget + 1 blocks, as even as can be."""
    edges = [BITS * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _left(x: Column, n: int) -> Column:
    """x rotated to the left."""
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, BITS - n)) if n else x


class Forest:
    """Union of links with numpy: labels are the smallest index of the component so far."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
        self.label = label


def walk(keys: np.ndarray, pairs: tuple, budget: int, depth: np.ndarray, differ: np.ndarray, forest: Forest, chunk: int = 1 << 15) -> int:
    """Adds to the forest the links between the keys of pairs of nodes; gives back how many pairs were split.

    pairs: arrays (first, end, first, end) of runs of ascending keys (uint64, distinct), a node with itself or two that are
    apart; depth: how many leading bits the keys of each node share, differ: in how many of these the two nodes differ.
    Memory holds a stack of chunks of pairs and a count of ones for each level, whatever the number of links.
    """
    ones: dict[int, np.ndarray] = {}
    stack = [(int(d), differ[depth == d], *(x[depth == d] for x in pairs)) for d in np.unique(depth)]
    splits = 0
    while stack:
        level, differ, *runs = stack.pop()
        if len(differ) > chunk:
            stack.append((level, differ[chunk:], *(x[chunk:] for x in runs)))
            differ, runs = differ[:chunk], [x[:chunk] for x in runs]
        alo, ahi, blo, bhi = runs
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            i, j = alo[leaf], blo[leaf]
            left = (keys[i] ^ keys[j]) << np.uint64(level) if level < BITS else np.zeros(len(i), np.uint64)
            hit = (i != j) & (differ[leaf] + np.bitwise_count(left) <= budget)
            forest.add(i[hit], j[hit])
            differ, alo, ahi, blo, bhi = (x[~leaf] for x in (differ, alo, ahi, blo, bhi))
        if not len(differ):
            continue
        if level not in ones:
            ones[level] = np.concatenate(([0], np.cumsum(keys >> np.uint64(BITS - 1 - level) & np.uint64(1), dtype=np.int32)))
        n = ones[level]
        amid, bmid = ahi - (n[ahi] - n[alo]), bhi - (n[bhi] - n[blo])
        splits += len(differ)
        other = alo != blo  # a node's pair with itself has its mixed children once
        out = [(differ, alo, amid, blo, bmid), (differ, amid, ahi, bmid, bhi), (differ + 1, alo, amid, bmid, bhi), (differ[other] + 1, amid[other], ahi[other], blo[other], bmid[other])]
        differ, alo, ahi, blo, bhi = (np.concatenate(x) for x in zip(*out, strict=True))
        live = (differ <= budget) & (ahi > alo) & (bhi > blo)
        stack.append((level + 1, *(x[live] for x in (differ, alo, ahi, blo, bhi))))
    return splits


def trie_join(keys: np.ndarray, groups: np.ndarray, budget: int, chunk: int = 1 << 15) -> np.ndarray:
    """Labels of the keys' components within groups; keys (uint64, distinct) ascend within a group and groups are contiguous."""
    forest = Forest(len(keys))
    if len(keys):
        starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
        ends = np.concatenate((starts[1:], [len(keys)]))
        none = np.zeros(len(starts), np.int64)
        walk(keys, (starts, ends, starts, ends), budget, none, none, forest, chunk)
    return forest.label


def joined(cols: list[np.ndarray], budget: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Links (a, b) that make up the components of whole groups (t, root, q, u, v, side, key), and how many pairs were split."""
    t, root, q, u, v, side, key = cols
    key = key.view(np.uint64)
    order = np.lexsort((key, side, v, u, root, t))
    t, root, q, u, v, side, key = (x[order] for x in (t, root, q, u, v, side, key))
    new, run = np.zeros(len(key), bool), np.zeros(len(key), bool)
    new[0] = run[0] = True
    for c in (t, root, u, v):
        new[1:] |= c[1:] != c[:-1]
    run[1:] = new[1:] | (side[1:] != side[:-1])
    lo = np.flatnonzero(run)
    hi = np.concatenate((lo[1:], [len(key)]))
    first = new[lo]
    second = np.concatenate((~first[1:], [False]))  # the run after is the group's other node
    mixed = np.flatnonzero(first & second)
    itself = np.flatnonzero(first & (u[lo] == v[lo]) & (hi - lo > 1))
    a, b = np.concatenate((itself, mixed)), np.concatenate((itself, mixed + 1))
    at = lo[a]
    widths = np.array([w for _, w in blocks(budget)])
    forest = Forest(len(key))
    splits = walk(key, (lo[a], hi[a], lo[b], hi[b]), budget, widths[t[at]] + q[at], np.bitwise_count(u[at] ^ v[at]).astype(np.int64), forest)
    far = np.flatnonzero(forest.label != np.arange(len(key)))
    back = np.array([x for x, _ in blocks(budget)], np.uint64)[t]
    fp = np.where(back > 0, key >> back | key << (np.uint64(BITS) - np.maximum(back, np.uint64(1))), key).view(np.int64)
    return fp[far], fp[forest.label[far]], splits


def links(fps: DataFrame, budget: int = 4, most: int = 1 << 18) -> DataFrame:
    """(a, b): a spanning forest of the links between different values of column fp (long) that differ in `budget` bits at most."""
    tries = [F.struct(F.lit(k).alias("t"), _left(F.col("fp"), first).alias("key"), F.shiftrightunsigned(_left(F.col("fp"), first), BITS - width).alias("root")) for k, (first, width) in enumerate(blocks(budget))]
    rows = fps.filter(F.col("fp").isNotNull()).select("fp").distinct().select(F.explode(F.array(*tries)).alias("x")).select("x.t", "x.key", "x.root")
    # a row for each root of two or more: (budget + 1) * 2 ** (64 / (budget + 1)) at most, 40,960 for a budget of 4
    sizes = rows.groupBy("t", "root").agg(F.count("*").alias("n")).filter("n > 1").select("t", "root", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / most))).cast("int").alias("q"))
    rows = rows.join(F.broadcast(sizes) if budget >= 4 else sizes, ["t", "root"])
    widths = F.element_at(F.array(*[F.lit(w) for _, w in blocks(budget)]), F.col("t") + 1)
    own = F.when(F.col("q") == 0, F.lit(0)).otherwise(F.expr(f"CAST(shiftrightunsigned(shiftleft(key, w), {BITS} - q) AS INT)"))
    rows = rows.withColumn("w", widths).withColumn("own", own)
    near = F.filter(F.sequence(F.lit(0), F.expr("shiftleft(1, q) - 1")), lambda v: F.bit_count(v.bitwiseXOR(F.col("own"))) <= budget)
    rows = rows.select("t", "root", "q", "own", "key", F.explode(near).alias("other")).select("t", "root", "q", F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v"), (F.col("own") > F.col("other")).cast("int").alias("side"), "key")
    rows = rows.withColumn("g", F.xxhash64("t", "root", "u", "v")).repartition(parallel(fps), "g").sortWithinPartitions("g")
    names = ("t", "root", "q", "u", "v", "side", "key")

    def run(batches):
        """Whole groups, as many at a time as make a large enough piece."""
        held: list[list[np.ndarray]] = []
        n = 0

        def out(cols):
            a, b, _ = joined(cols, budget)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            held.append([b.column(c).to_numpy() for c in ("g", *names)])
            n += b.num_rows
            if n > 1 << 18:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                end = int(np.searchsorted(whole[0], whole[0][-1], "left"))
                if end:
                    yield out([x[:end] for x in whole[1:]])
                held = [[x[end:] for x in whole]]
                n = len(whole[0]) - end
        if n:
            yield out([np.concatenate(x) for x in zip(*[h[1:] for h in held], strict=True)])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, budget: int = 4, width: int = 4, seed: int = 42, most: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    component_id: the smallest id that links reach, the own one included. Links are between fingerprints that differ in
    `budget` bits or fewer; equal fingerprints are linked, those of texts without words (null, empty, white space: 0) too.
    Null ids: the row keeps its fingerprint and component; they are never the smallest id; component_id is null if all
    ids of a component are. Repeated ids and rows: one row each. Other columns, whatever their names, are not read.
    An empty table gives an empty table. A text's shingles are hashed in one task: about 50 bytes a word.
    """
    rows = cut(fingerprints(docs, width, seed, id_col, text_col))
    least = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")))
    label = components(links(least, budget, most))
    classes = cut(least.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "size", F.coalesce("label", "fp").alias("label")))
    smallest = classes.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("members"))
    named = cut(by_key(classes, smallest, "label", "members").select("fp", "size", "component_id"))
    return by_key(rows, named, "fp", "size").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
