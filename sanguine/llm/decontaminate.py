"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of the words at a mask's chosen places; words at the other places may differ. Seeds of the benchmark
and of the documents are joined; around each hit all windows of `window` successive words (all of a shorter item's words)
are compared, and an item is found where at least `similarity` of them are equal. A window that reaches over the text's
first or last word counts by its words inside, if these are `SHORTEST` or more. The masks are lossless for that test: the
hits miss no such window, whichever words differ.

The documents are read once, whatever the benchmark's size: a bitmap of fixed size tells which of their seeds the benchmark
may have, and only these go into the join, with the words around them. Seeds with the same words around them, as copies
and common passages have, are compared once. Items that share a window of words are one class: a document's seed is
compared with one item of a class first, and with the others only if that one doesn't match; so a passage that many
items share doesn't multiply the pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, stored
from .components import components
from .words import mix, owners, word_hashes

WINDOW = 16
#: Lossless for 3 differing words of 16 or 15 and 2 of 14, as a test proves.
MASKS = ((0, 1, 4, 7, 8, 9), (0, 1, 5, 7, 8, 9), (0, 1, 2, 4, 6, 7))
MASKS_FROM = 14
#: Words inside the text that a window over its border needs.
SHORTEST = 10
#: Places of the bitmap for each of the benchmark's seeds, which sets two, and the bitmap's least and most bits (of its size): 8 MB and 128 MB.
SLOTS, BITMAP = 256, (26, 30)
#: Classes of items beyond which a seed counts as crowded; changes the cost, not the result.
CROWDED = 16


def allowed(n: int, similarity: float) -> int:
    """Words of n that may differ."""
    return n - math.ceil(similarity * n - 1e-9)


def comb(n: int, k: int) -> tuple[int, ...]:
    """Places k + 1 apart: of the k + 1 combs in n words one is left by any k differences."""
    return tuple(range(0, n // (k + 1) * (k + 1), k + 1))


def masks_for(words: int, similarity: float, window: int = WINDOW) -> tuple[tuple[int, ...], ...]:
    """Masks that an item of so many words needs: the fixed ones, or a comb."""
    m = min(words, window)
    if window == WINDOW and similarity >= 0.8 and m >= MASKS_FROM:
        return MASKS
    return (comb(m, allowed(m, similarity)),)


def border_masks(words: int, similarity: float, window: int = WINDOW) -> set[tuple[int, ...]]:
    """Combs for the shortened windows of an item of so many words, but for those that its own masks cover."""
    own = masks_for(words, similarity, window)
    sizes = [n for n in range(SHORTEST, min(words, window)) if not (own == MASKS and n >= MASKS_FROM)]
    most = max((allowed(n, similarity) for n in sizes), default=0)
    return {comb(sizes[0], most)} if sizes else set()


def seeds(h: np.ndarray, bounds: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, place of each seed's first word); seeds don't cross texts."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s = np.full(n, hash(mask) & 0xFFFFFFFF, np.uint64)
    for k, o in enumerate(mask):
        s += h[o : o + n] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF | 1)
    ends = np.repeat(bounds[1:], np.diff(bounds))[:n]
    at = np.flatnonzero(np.arange(n) + mask[-1] < ends)
    return mix(s[at]), at


def surroundings(h: np.ndarray, bounds: np.ndarray, own: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, before, after): the window - 1 words before each place and the window words from it on, 0 outside the text, and how many are inside."""
    lo, hi = bounds[:-1][own[at]], bounds[1:][own[at]]
    k = at[:, None] + np.arange(1 - window, window)
    inside = (k >= lo[:, None]) & (k < hi[:, None])
    words = np.where(inside, h[np.clip(k, 0, len(h) - 1)], np.uint64(0)) if len(h) else np.zeros((0, 2 * window - 1), np.uint64)
    return words, np.minimum(at - lo, window - 1), np.minimum(hi - at, window)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as a value."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def compared(doc: np.ndarray, before: np.ndarray, after: np.ndarray, item: np.ndarray, item_before: np.ndarray, item_after: np.ndarray, size: np.ndarray, similarity: float, window: int):
    """(found, first, end, matched, similarity) of seeds with these words around them in a text and in an item of `size` words.

    first and end: the outermost words of the windows found, counted from the seed's; matched and similarity: the best window's.
    """
    total = np.concatenate((np.zeros((len(doc), 1), np.int64), np.cumsum((doc == item) & (doc != 0), axis=1)), axis=1)
    m = np.minimum(size, window)
    need = np.array([n - allowed(n, similarity) for n in range(window + 1)])
    rows = np.arange(len(doc))
    first, end = np.full(len(doc), window), np.full(len(doc), -window)
    best, matched, sim = np.full(len(doc), -1.0), np.zeros(len(doc), np.int64), np.zeros(len(doc))
    for s in range(1 - window, 1):
        lo, hi = np.maximum(s, -before), np.minimum(s + m, after)
        n = np.maximum(hi - lo, 0)
        whole = (s >= -item_before) & (s + m <= item_after) & (s + m > 0) & ((n == m) | (n >= SHORTEST))
        equal = total[rows, np.clip(hi, lo, None) + window - 1] - total[rows, lo + window - 1]
        ok = whole & (equal >= need[n])
        first, end = np.where(ok, np.minimum(first, lo), first), np.where(ok, np.maximum(end, hi), end)
        score = np.where(ok, equal / np.maximum(n, 1) + n * 1e-6, -1)
        better = score > best
        best, matched = np.where(better, score, best), np.where(better, equal, matched)
        sim = np.where(better, equal / np.maximum(n, 1), sim)
    return best >= 0, first, end, matched, sim


_ITEM = "uid long, item_id long, size int, words binary"


def _items(benchmark: DataFrame) -> DataFrame:
    """(uid, item_id, size, words) of the items that have words, written once."""

    def run(batches):
        for batch in batches:
            for b in pieces(batch, 2):
                h, bounds = word_hashes(b.column(2).to_pylist())
                keep = np.flatnonzero(np.diff(bounds))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep)), pa.array(np.diff(bounds)[keep].astype(np.int32)), pa.array([h[bounds[k] : bounds[k + 1]].tobytes() for k in keep], pa.binary())],
                    names=["uid", "item_id", "size", "words"],
                )

    rows = benchmark.select(F.monotonically_increasing_id().alias("uid"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(run, _ITEM))


def _unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(words, bounds) of a batch of items."""
    sizes = b.column("size").to_numpy()
    return np.frombuffer(b"".join(b.column("words").to_pylist()), np.uint64), np.concatenate(([0], np.cumsum(sizes)))


def _copies(items: DataFrame) -> DataFrame:
    """(uid, label): items are of one class where all their words are equal."""
    rows = items.select("uid", F.sha2("words", 256).alias("t"))
    return rows.join(rows.groupBy("t").agg(F.min("uid").alias("label")), "t").select("uid", "label")


def _classes(items: DataFrame, window: int, copies: bool = False) -> DataFrame:
    """(uid, label): items are of one class where equal windows of words (all words of shorter items) lead from one to the other; only equal ones if `copies`."""
    if copies:
        return _copies(items)

    def run(batches):
        for batch in batches:
            for b in pieces(batch):
                h, bounds = _unpacked(b)
                out, of = [], []
                for k, uid in enumerate(b.column("uid").to_pylist()):
                    w = h[bounds[k] : bounds[k + 1]]
                    m = min(len(w), window)
                    out += [xxhash.xxh3_64_intdigest(w[j : j + m].tobytes(), m) for j in range(len(w) - m + 1)]
                    of += [uid] * (len(w) - m + 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(out, np.uint64).view(np.int64)), pa.array(of, pa.int64())], names=["w", "uid"])

    shared = stored(items.mapInArrow(run, "w long, uid long"))
    first = shared.groupBy("w").agg(F.min("uid").alias("b"), F.count("*").alias("n")).filter("n > 1")
    edges = shared.join(first, "w").filter("uid != b").select(F.col("uid").alias("a"), "b")
    return items.select("uid").join(components(edges).withColumnRenamed("node", "uid"), "uid", "left").select("uid", F.coalesce("label", "uid").alias("label"))


def item_classes(benchmark: DataFrame, window: int = WINDOW, copies: bool = False) -> DataFrame:
    """(item_id, class_id) of each item that has words; class_id is the smallest id of the items that share its windows, or its words if `copies` (null if all are null)."""
    items = _items(benchmark)
    return _named(items, cut(_classes(items, window, copies))).select("item_id", "class_id")


def _named(items: DataFrame, classes: DataFrame) -> DataFrame:
    rows = items.select("uid", "item_id").join(classes, "uid")
    return rows.join(rows.groupBy("label").agg(F.min("item_id").alias("class_id")), "label")


def _places(sizes: list[int], similarity: float, window: int) -> tuple[dict, dict]:
    """The sizes of items by the masks (and border masks) that they need."""
    inner: dict = {}
    border: dict = {}
    for n in sizes:
        for m in masks_for(n, similarity, window):
            inner.setdefault(m, set()).add(n)
        for m in border_masks(n, similarity, window):
            border.setdefault(m, set()).add(n)
    return inner, border


def _benchmark_seeds(items: DataFrame, classes: DataFrame, similarity: float, window: int) -> DataFrame:
    """(h, label, uid, item_id, at, size, before, after, words) of each place of each seed of the items, written once."""

    def run(batches):
        for batch in batches:
            for b in pieces(batch):
                h, bounds = _unpacked(b)
                own, sizes = owners(bounds), np.minimum(np.diff(bounds), window)
                for masks in _places(np.unique(sizes).tolist(), similarity, window):
                    for mask, wanted in masks.items():
                        s, at = seeds(h, bounds, mask)
                        keep = np.isin(sizes[own[at]], list(wanted))
                        s, at = s[keep], at[keep]
                        words, before, after = surroundings(h, bounds, own, at, window)
                        of = pa.array(own[at])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(s.view(np.int64)), *(b.column(c).take(of) for c in ("label", "uid", "item_id")), pa.array((at - bounds[own[at]]).astype(np.int32)), b.column("size").take(of), *(pa.array(x.astype(np.int32)) for x in (before, after)), _binary(words)],
                            names=["h", "label", "uid", "item_id", "at", "size", "before", "after", "words"],
                        )

    return stored(items.join(classes, "uid").mapInArrow(run, "h long, label long, uid long, item_id long, at int, size int, before int, after int, words binary").dropDuplicates(["h", "uid", "at"]))


def _hits(docs: DataFrame, seeds_of: DataFrame, items: DataFrame, similarity: float, window: int) -> DataFrame:
    """(key, place, c1, c2, h, before, after, words): the documents' seeds that the bitmap lets through; key is the text's SHA-256, c1 and c2 name the words around."""
    known = seeds_of.select("h").distinct().count()
    size = min(max((SLOTS * known).bit_length(), BITMAP[0]), BITMAP[1])
    slots = seeds_of.select(F.explode(F.array(F.shiftrightunsigned("h", 64 - size), F.col("h").bitwiseAND((1 << size) - 1))).alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(s % 64 AS INT))")).alias("bits"))
    bitmap = np.zeros(1 << (size - 6), np.int64)
    for r in slots.toLocalIterator():  # two rows a seed, or 2 ** 24
        bitmap[r["w"]] = r["bits"]
    sizes = [r["m"] for r in items.select(F.least("size", F.lit(window)).alias("m")).distinct().collect()]  # `window` at most
    inner, border = _places(sizes, similarity, window)
    shared = docs.sparkSession.sparkContext.broadcast((bitmap.view(np.uint64), list(inner), [m for m in border if m not in inner]))

    def run(batches):
        bits, every, edges = shared.value
        for batch in batches:
            for b in pieces(batch, 0):
                texts = b.column(0).to_pylist()
                h, bounds = word_hashes(texts)
                own = owners(bounds)
                found = []
                for mask in [*every, *edges]:
                    s, at = seeds(h, bounds, mask)
                    if mask in edges:  # shortened windows lie in a text's outermost words
                        edge = np.minimum(at - bounds[:-1][own[at]], bounds[1:][own[at]] - at - mask[-1] - 1) < window - 1
                        s, at = s[edge], at[edge]
                    for low in (False, True):
                        slot = s & np.uint64((1 << size) - 1) if low else s >> np.uint64(64 - size)
                        near = (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)) != 0
                        s, at = s[near], at[near]
                    found.append((s, at))
                s, at = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                if not len(s):
                    continue
                words, before, after = surroundings(h, bounds, own, at, window)
                keys = {k: hashlib.sha256((texts[k] or "").encode("utf-8", "surrogatepass")).hexdigest() for k in np.unique(own[at]).tolist()}
                names = [xxhash.xxh3_128_digest(w.tobytes(), int(x) & 0x7FFFFFFF) for w, x in zip(words, s, strict=True)]
                c = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[k] for k in own[at].tolist()]), pa.array(at - bounds[own[at]]), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(s.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (before, after)), _binary(words)],
                    names=["key", "place", "c1", "c2", "h", "before", "after", "words"],
                )

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key string, place long, c1 long, c2 long, h long, before int, after int, words binary")
    return stored(found.dropDuplicates(["key", "place", "h"]))


def _verified(rows: DataFrame, similarity: float, window: int) -> DataFrame:
    """(c1, c2, label, uid, item_id, at, first, end, matched, similarity) of the rows whose words around match."""
    columns = ("before", "after", "words", "ibefore", "iafter", "iwords", "size")
    names = ("c1", "c2", "label", "uid", "item_id", "at")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            before, after, words, ibefore, iafter, iwords, size = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) if c.endswith("words") else b.column(c).to_numpy() for c in columns)
            found, first, end, matched, sim = compared(words, before, after, iwords, ibefore, iafter, size, similarity, window)
            out = [*(b.column(c) for c in names), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(matched), pa.array(sim)]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "first", "end", "matched", "similarity"]).filter(pa.array(found))

    return rows.select(*names, *columns).mapInArrow(run, "c1 long, c2 long, label long, uid long, item_id long, at int, first int, end int, matched long, similarity double")


def _occurrence(seeds_of: DataFrame) -> DataFrame:
    return seeds_of.select("h", "label", "uid", "item_id", "at", "size", F.col("before").alias("ibefore"), F.col("after").alias("iafter"), F.col("words").alias("iwords"))


def _elements(rows: DataFrame, names: list[str], words: str, window: int) -> DataFrame:
    """(names, e): a hash for each word with its place around the seed, up to m - 1 words away; names hold m."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        for batch in batches:
            for b in pieces(batch, rows=4096):
                w = np.frombuffer(b"".join(b.column(words).to_pylist()), np.uint64).reshape(b.num_rows, -1)
                far = np.abs(np.arange(1 - window, window))
                row, k = np.nonzero((w != 0) & (far < b.column("m").to_numpy()[:, None]))
                e = mix(w[row, k] + np.uint64(0xD1B54A32D192ED03) * (k + 1).astype(np.uint64))  # as in _border_elements
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in names), pa.array(e.view(np.int64))], names=[*names, "e"])

    return rows.select(*dict.fromkeys([*names, "m", words])).mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in names) + ", e long")


def _border_elements(docs: DataFrame, window: int) -> DataFrame:
    """(d, h, n, e): the elements of the first n words of the texts whose border is within a window of the place, and of the last ones with -n."""

    def run(batches):
        for batch in batches:
            for b in pieces(batch, rows=4096):
                w = np.frombuffer(b"".join(b.column("words").to_pylist()), np.uint64).reshape(b.num_rows, -1)
                before, after = b.column("before").to_numpy()[:, None], b.column("after").to_numpy()[:, None]
                k = np.arange(1 - window, window)
                e = mix(w + np.uint64(0xD1B54A32D192ED03) * (k + window).astype(np.uint64))
                rows, ns, es = [], [], []
                for n in range(SHORTEST, window):
                    whole = before + after >= n
                    for sign, near, part in ((1, before < window - 1, (k >= -before) & (k < n - before)), (-1, after < window, (k < after) & (k >= after - n))):
                        row, at = np.nonzero(near & whole & part & (w != 0))
                        rows, ns, es = [*rows, row], [*ns, np.full(len(row), sign * n, np.int32)], [*es, e[row, at]]
                of = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([b.column("d").take(of), b.column("h").take(of), pa.array(np.concatenate(ns)), pa.array(np.concatenate(es).view(np.int64))], names=["d", "h", "n", "e"])

    near = docs.filter((F.col("before") < window - 1) | (F.col("after") < window))
    return near.select("d", "h", "before", "after", "words").mapInArrow(run, "d long, h long, n int, e long")


def _crowded_pairs(around: DataFrame, every: DataFrame, similarity: float, window: int) -> DataFrame:
    """Rows of around and every, joined, of crowded seeds: all that can match, and few others.

    Two places match where a window of m words has need(m) equal ones or more, all at most m - 1 words from the seed. So of the words
    around (each with its place) they share need(m); in any order they share one of the first, all but need(m) - 1 of each place's. The
    order is by how many items have the word at that place, so an exam's stem of fewer words comes last and joins nothing. A window that
    reaches over the text's border is the text's first (last) n words, of which need(n) are equal; for each n the rarest n - need(n) + 1 of
    them are looked up among the items' words. Items with the same words around are compared once.
    """
    need = F.array(*[F.lit(n - allowed(n, similarity)) for n in range(window + 1)])
    items = every.withColumn("m", F.least("size", F.lit(window)))
    items = items.groupBy("h", "label", "m", "ibefore", "iafter", "iwords").agg(F.min(F.struct("uid", "item_id", "at", "size")).alias("x"))
    items = stored(items.select("h", "label", "m", "ibefore", "iafter", "iwords", "x.*", F.monotonically_increasing_id().alias("o")))
    docs = stored(around.withColumn("d", F.monotonically_increasing_id()))

    def first(rows: DataFrame, key: list[str]) -> DataFrame:
        """(key, h, m, e) of the first words of each place."""
        every_word = rows.join(often, ["h", "m", "e"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
        held = every_word.groupBy(*key, "h", "m").agg(F.array_sort(F.collect_list(F.struct("k", "e"))).alias("es"))
        n = F.size("es") - F.get(need, F.col("m")) + 1
        return held.select(*key, "h", "m", F.explode(F.slice("es", 1, F.greatest(n, F.lit(0)))).alias("x")).filter("x.k > 0").select(*key, "h", "m", "x.e")

    words = stored(_elements(items, ["o", "h", "m"], "iwords", window))
    often = stored(words.groupBy("h", "m", "e").agg(F.count("*").alias("k")))
    around_m = docs.join(items.select("h", "m").distinct(), "h")
    inside = first(_elements(around_m, ["d", "h", "m"], "words", window), ["d"]).join(first(words, ["o"]), ["h", "m", "e"]).select("d", "o")

    by_word = words.select("o", "h", "e")
    rare = often.groupBy("h", "e").agg(F.sum("k").alias("k"))
    edges = _border_elements(docs, window).join(rare, ["h", "e"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    edges = edges.groupBy("d", "h", "n").agg(F.array_sort(F.collect_list(F.struct("k", "e"))).alias("es"))
    few = F.explode(F.slice("es", 1, F.abs("n") - F.get(need, F.abs("n")) + 1)).alias("x")
    border = edges.select("d", "h", few).filter("x.k > 0").select("d", "h", "x.e").distinct().join(by_word, ["h", "e"]).select("d", "o")

    met = inside.unionByName(border).distinct()
    return met.join(docs, "d").join(items.drop("h", "m"), "o").drop("d", "o")


def _matches(docs: DataFrame, items: DataFrame, classes: DataFrame, similarity: float, window: int, exists: bool) -> DataFrame:
    """(key, place, label, uid, item_id, at, first, end, matched, similarity) of the documents' seeds that match; only enough to know all such keys if `exists`."""
    seeds_of = _benchmark_seeds(items, classes, similarity, window)
    hits = _hits(docs, seeds_of, items, similarity, window)
    around = hits.dropDuplicates(["c1", "c2", "h"]).select("c1", "c2", "h", "before", "after", "words")
    every = _occurrence(seeds_of)
    crowded = stored(every.groupBy("h").agg(F.count_distinct("label").alias("k")).filter(F.col("k") > CROWDED).select("h"))
    known = None
    if not crowded.isEmpty():
        pairs = _crowded_pairs(around.join(crowded, "h", "left_semi"), every.join(crowded, "h", "left_semi"), similarity, window)
        known = cut(_verified(pairs, similarity, window))
        around, every = around.join(crowded, "h", "left_anti"), every.join(crowded, "h", "left_anti")
    head = every.groupBy("h", "label").agg(F.min(F.struct("uid", "at")).alias("x")).select("h", "label", F.col("x.uid").alias("uid"), F.col("x.at").alias("at"))
    first = every.join(head, ["h", "label", "uid", "at"])
    found = cut(_verified(around.join(first, "h"), similarity, window))
    found = found if known is None else found.unionByName(known)
    places = hits.select("key", "place", "c1", "c2")
    if exists:
        # documents that nothing has matched so far meet all items
        left = places.join(places.join(found.select("c1", "c2").distinct(), ["c1", "c2"]).select("key").distinct(), "key", "left_anti").select("c1", "c2").distinct()
        open_ = around.join(left, ["c1", "c2"]).join(head.select("h", "label"), "h")
    else:
        open_ = around.join(head.select("h", "label"), "h").join(found.select("c1", "c2", "label"), ["c1", "c2", "label"], "left_anti")
    others = every.join(head, ["h", "label", "uid", "at"], "left_anti")
    more = cut(_verified(open_.join(others, ["h", "label"]), similarity, window))
    return places.join(found.unionByName(more), ["c1", "c2"])


def _key() -> F.Column:
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)


def overlaps(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, window: int = WINDOW, copies: bool = False) -> DataFrame:
    """(doc_id, class_id, item_id, first_word, last_word, n_matched, similarity): a row for each document and class of items that overlap.

    copies: classes are of items with equal words only, so no link to another text is left out; by default items that share a
    window of words are one class, of which one is named. `item_classes` tells which items a class_id stands for; item_id is the one of them that was found in the document: of the
    items compared the one with the best window, the longest run and the smallest id. first_word and last_word are the
    outermost words of that run, n_matched and similarity those of its best window. Words are lower-cased and parted at
    white space and ASCII punctuation. Null texts have no words and overlap nothing, as do items without words; an item of
    fewer words than `window` has to be there whole (but for the allowed differences). A window over a text's border counts
    by its words inside, `SHORTEST` at least; so a text of fewer words overlaps only items that are as short. Null ids are
    carried; repeated rows give a row each, equal items are one class. An empty table on either side gives an empty table.
    Other columns are not read. A text's words are held by one task: about 100 bytes a word.
    """
    items = _items(benchmark)
    classes = cut(_classes(items, window, copies))
    rows = _matches(docs, items, classes, similarity, window, exists=False)
    runs = rows.withColumn("diagonal", F.col("place") - F.col("at")).groupBy("key", "label", "uid", "diagonal").agg(
        F.min(F.col("place") + F.col("first")).alias("first_word"), F.max(F.col("place") + F.col("end") - 1).alias("last_word"), F.max(F.struct("similarity", "matched")).alias("best"))
    order = F.struct((-F.col("best.similarity")).alias("s"), (-F.col("best.matched")).alias("m"), (F.col("first_word") - F.col("last_word")).alias("n"), "uid", "first_word", "last_word")
    best = runs.groupBy("key", "label").agg(F.min(order).alias("x"))
    names = _named(items, classes)
    found = cut(
        best.join(names.select("label", "class_id").distinct(), "label").withColumn("uid", F.col("x.uid")).join(names.select("uid", "item_id"), "uid")
        .select("key", "class_id", "item_id", F.col("x.first_word").alias("first_word"), F.col("x.last_word").alias("last_word"), (-F.col("x.m")).alias("n_matched"), (-F.col("x.s")).alias("similarity"))
    )
    small = found.count() <= 200_000
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"))
    return keyed.join(F.broadcast(found) if small else found, "key").drop("key")


def decontaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, window: int = WINDOW) -> DataFrame:
    """docs without the rows that overlap an item; all columns stay, whatever their names. Nulls and borders as in overlaps."""
    items = _items(benchmark)
    bad = cut(_matches(docs, items, cut(_classes(items, window)), similarity, window, exists=True).select(F.col("key").alias("k")).distinct())
    return docs.join(F.broadcast(bad) if bad.count() <= 200_000 else bad, _key() == bad["k"], "left_anti")
