"""Removal of repeated byte strings by suffix sorting.

A string of `width` bytes is repeated if it also starts elsewhere in the corpus. Repeats are found by sorting suffixes and
comparing neighbours; to do so over many tasks, equal strings have to meet in one of them:

 1. In each window of `width` bytes the k-gram with the smallest hash is the window's anchor. Equal windows have equal
    anchors at equal places, so all windows that one anchor answers for (its context, a run of window starts) need to be
    compared with contexts of the same k-gram only. K-grams that occur once have no repeats and are dropped.
 2. Equal contexts, as 128 bits of BLAKE2b tell them, are sorted once, with their number; so groups of copies cost no more than one of them.
 3. Contexts that share their k-gram come together in pieces of bounded size. A piece's suffixes are sorted in two stages:
    those smaller than their successors directly, all others are induced from them by one scan of the buckets. Windows
    whose common prefix with a neighbour reaches `width`, or whose context stands for several, are repeated.
 4. The repeated windows go back to all texts that have the context, and the bytes they cover are cut out.

A k-gram with more than `most` different contexts (a passage in many surroundings) is brought together by longer strings:
its contexts are split into blocks of windows with like places of the anchor, and the bytes that all windows of a block have
in common take the k-gram's place. Equal blocks are again one, with their number. Blocks shrink to single windows at last,
where the common bytes are the window itself and one context is left. So every window goes through the suffix sort.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, by_key, parallel, pieces, stored
from .words import _power, mix

WIDTH, GRAM = 200, 48


def _key(text: bytes) -> tuple[int, int]:
    """128 bits of a text's BLAKE2b, as two signed longs: equal texts are told from others by them."""
    d = _digest(text)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _digest(data: bytes, d: int = 0, n: int = 0) -> bytes:
    """What tells texts, and contexts with their anchor's place and number of windows, from others: nobody can make two of one digest."""
    return hashlib.blake2b(data, digest_size=16, salt=d.to_bytes(8, "big") + n.to_bytes(8, "big")).digest()


def anchors(texts: list[bytes], width: int = WIDTH, gram: int = GRAM):
    """Of each context: (text, first window's start in the text, number of windows, anchor's place in the first window, k-gram
    hash, context's digest), as arrays and a list of digests."""
    sizes = np.array([len(t) for t in texts], np.int64)
    whole = b"".join(texts)
    a = np.frombuffer(whole, np.uint8)
    n, span = len(a), width - gram + 1
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none, none, []
    power, inverse = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    h = mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    low = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    done = 1
    while done * 2 <= span:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    low = np.minimum(low[: n - width + 1], low[span - done : span - done + n - width + 1])
    starts = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - width + 1, 0)
    text = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = starts[text] + at
    anchor = (low[place] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))) if len(text) else none
    runs = np.diff(np.concatenate((new, [len(text)])))
    first, anchor = place[new], anchor[new]
    end = first + runs - 1 + width
    c = [_digest(whole[i:j], d, m) for i, j, d, m in zip(first.tolist(), end.tolist(), (anchor - first).tolist(), runs.tolist(), strict=True)]
    return text[new], at[new], runs, anchor - first, h[anchor].view(np.int64), c


def _words_at(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as big-endian integers; t ends in eight zeros or more."""
    n = len(t) - 8
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out |= t[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def _sorted_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """places by the `depth` bytes from them on; only ties are looked at further."""
    order = places[np.argsort(words[places], kind="stable")]
    group = np.zeros(len(order), np.int64)
    lo = np.arange(len(order))
    at = 0
    while len(lo):
        w = words[order[lo] + at]
        new = np.concatenate(([True], (w[1:] != w[:-1]) | (group[lo[1:]] != group[lo[:-1]]) | (lo[1:] != lo[:-1] + 1)))
        ids = np.cumsum(new) - 1
        size = np.bincount(ids)
        tied = size[ids] > 1
        at += 8
        if at >= depth:
            break
        lo, ids = lo[tied], ids[tied]
        group[lo] = ids
        again = np.lexsort((words[order[lo] + at], ids))
        order[lo] = order[lo][again]
    return order


def two_stage(t: np.ndarray, members: np.ndarray, depth: int, words: np.ndarray) -> np.ndarray:
    """Sorted places of the suffixes of t in `members` (a mask), by their first `depth` bytes at least.

    Every run of members has to end in a suffix that is smaller than its successor. Those are sorted directly; all other
    members are induced, bucket by bucket of their first byte, from the suffixes that follow them.
    """
    n = len(members)
    body = t[: n + 1].astype(np.int16)
    step = np.flatnonzero(body[:-1] != body[1:])
    after = np.searchsorted(step, np.arange(n))
    after = step[np.minimum(after, len(step) - 1)] if len(step) else np.zeros(n, np.int64)
    small = body[after] < body[after + 1]
    direct = _sorted_directly(np.flatnonzero(members & small), words, depth)
    induced = members & ~small
    bounds = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def scan(part: np.ndarray, c: int) -> np.ndarray:
        """Induces the members before those of part; gives back the ones that fall into bucket c itself."""
        before = part[part > 0] - 1
        before = before[induced[before]]
        first = t[before]
        own = before[first == c]
        rest, first = before[first != c], first[first != c]
        if len(rest):
            order = np.argsort(first, kind="stable")
            rest, first = rest[order], first[order]
            cuts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
            for a, b in zip(cuts, [*cuts[1:], len(rest)]):
                waiting[first[a]].append(rest[a:b])
        return own

    for c in range(256):
        queue = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        while len(queue):
            out.append(queue)
            queue = scan(queue, c)
        if bounds[c + 1] > bounds[c]:
            part = direct[bounds[c] : bounds[c + 1]]
            out.append(part)
            scan(part, c)
    return np.concatenate(out) if out else direct


def repeated(contexts: list[bytes], windows: np.ndarray, several: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each context a mask of its windows that are repeated; several marks contexts that stand for more than one."""
    if not contexts:
        return []
    sizes = np.array([len(c) for c in contexts], np.int64)
    raw = np.frombuffer(b"\xff".join([*contexts, b""]), np.uint8) + np.uint8(1)  # the separator becomes 0, the smallest
    n = len(raw)
    t = np.concatenate((raw, np.zeros(width + 16, np.uint8)))
    t[n] = 1  # the last separator, too, is smaller than its successor
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    owner = np.repeat(np.arange(len(contexts)), windows)
    place = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    body = t.astype(np.int16)
    step = np.flatnonzero(body[:n] != body[1 : n + 1])
    kind = body[step] < body[step + 1]
    after = np.searchsorted(step, np.arange(n))
    smaller = kind[np.minimum(after, len(step) - 1)]
    goal = np.flatnonzero(smaller)
    members = np.zeros(n, bool)
    members[place] = True
    last = starts + windows - 1
    stop = goal[np.searchsorted(goal, last)]
    extra = stop - last
    members[np.repeat(last, extra) + np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1] = True
    words = _words_at(t)
    order = two_stage(t, members, width, words)
    slot = np.full(n, -1, np.int64)
    slot[place] = np.arange(len(place))
    order = order[slot[order] >= 0]
    same = np.arange(len(order) - 1)
    for at in range(0, width, 8):  # neighbours whose common prefix reaches `width`
        if at + 8 <= width:
            same = same[words[order[same] + at] == words[order[same + 1] + at]]
        else:
            shift = np.uint64(8 * (at + 8 - width))
            same = same[words[order[same] + at] >> shift == words[order[same + 1] + at] >> shift]
    hit = several[owner].copy()
    hit[slot[order[same]]] = True
    hit[slot[order[same + 1]]] = True
    return np.split(hit, np.cumsum(windows)[:-1])


def _runs(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2])]


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def occurrences(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(h, c, k1, k2, at, copies): each context of each text; texts that repeat within a batch are taken once with `copies`.

    `at` holds the first window's start, the anchor's place in it (16 bits) and the number of windows (16 bits).
    """

    def run(batches):
        for batch in batches:
            for b in pieces(batch, 0, most_bytes=1 << 20):
                own: dict[bytes, int] = {}
                for t in as_bytes(b.column(0)):
                    if t and len(t) >= width:
                        own[t] = own.get(t, 0) + 1
                texts = list(own)
                keys = np.array([_key(t) for t in texts], np.int64).reshape(-1, 2)
                copies = np.array(list(own.values()), np.int64)
                text, first, n, place, h, c = anchors(texts, width, gram)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c, pa.binary()), *(pa.array(x) for x in (keys[text, 0], keys[text, 1], first << 32 | place << 16 | n, copies[text]))], names=["h", "c", "k1", "k2", "at", "copies"])

    return docs.select("text").mapInArrow(run, "h long, c binary, k1 long, k2 long, at long, copies long")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, z): texts under their keys, packed with zstandard for the way."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for b in pieces(batch, 1):
                texts = [t or b"" for t in as_bytes(b.column(1))]
                keys = [_key(t) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([squeeze.compress(t) for t in texts], pa.binary())], names=["doc_id", "k1", "k2", "z"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, k1 long, k2 long, z binary")


_CONTEXT = "h long, c binary, m long, n int, d int, hot boolean, context binary"


def _marked(rows: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """(rows with a flag `hot` where more than `most` of them share their h, whether there are any)."""
    hot = stored(rows.groupBy("h").agg(F.count("*").alias("size")).filter(F.col("size") > most).withColumn("hot", F.lit(True)))
    if hot.isEmpty():
        return rows.withColumn("hot", F.lit(False)), False
    return by_key(rows, hot, "h", "size").withColumn("hot", F.coalesce("hot", F.lit(False))), True


def _sorted_contexts(contexts: DataFrame, width: int) -> DataFrame:
    """(h, c, runs) of contexts whose k-grams have few enough: suffix sort of pieces with all contexts of a k-gram."""

    def judge(h: list, c: list, m: list, n: list, context: list) -> pa.RecordBatch:
        masks = repeated(context, np.array(n, np.int64), np.array(m) > 1, width)
        keep = [k for k, x in enumerate(masks) if x.any()]
        return pa.RecordBatch.from_arrays([pa.array([h[k] for k in keep], pa.int64()), pa.array([c[k] for k in keep], pa.binary()), pa.array([_runs(masks[k]) for k in keep], _RUNS)], names=["h", "c", "runs"])

    def sort(batches):
        """Whole groups of a k-gram, as many at a time as make a large enough piece."""
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("h", "c", "m", "n", "context")), strict=True):
                if size > 1 << 21 and row[0] != held[-1][0]:
                    yield judge(*map(list, zip(*held, strict=True)))
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield judge(*map(list, zip(*held, strict=True)))

    together = contexts.repartition(parallel(contexts), "h").sortWithinPartitions("h")
    return together.mapInArrow(sort, "h long, c binary, runs array<struct<a:int,b:int>>")


def blocks(context: bytes, n: int, d: int, step: int, width: int = WIDTH):
    """(first window, windows, anchor's place in the first, k-gram hash, context's digest, bytes) of each block of a context.

    The windows of a block have the anchor at places of the same `step`; `step - 1` bytes less than a window are common to all
    windows that can be in the block, in whatever context, and give the k-gram's hash.
    """
    for q in range(d // step, (d - n + 1) // step - 1, -1):
        first = max(0, d - q * step - step + 1)
        last = min(n - 1, d - q * step)
        part = context[first : last + width]
        common = context[d - q * step : d - q * step + width - step + 1]
        h = xxhash.xxh3_64_intdigest(common, step << 16 | q)
        yield first, last - first + 1, d - first, h - (h >> 63 << 64), _digest(part, d - first, last - first + 1), part


def _split(contexts: DataFrame, step: int, width: int) -> DataFrame:
    """(h, c, k, h2, c2, m, n, d, context): the blocks of each context, with the number k of their first window in it."""
    names = ["h", "c", "k", "h2", "c2", "m", "n", "d", "context"]
    types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches):
        for batch in batches:
            for b in pieces(batch, rows=256):
                out: list[tuple] = []
                for h, c, m, n, d, context in zip(*(b.column(x).to_pylist() for x in ("h", "c", "m", "n", "d", "context")), strict=True):
                    out += [(h, c, k, h2, c2, m, size, place, part) for k, size, place, h2, c2, part in blocks(context, n, d, step, width)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return contexts.mapInArrow(run, "h long, c binary, k int, h2 long, c2 binary, m long, n int, d int, context binary")


def _compared(contexts: DataFrame, hot: bool, steps: list[int], width: int, most: int) -> DataFrame:
    """(h, c, runs) of contexts with their flag `hot`; hot ones are split into blocks of steps[0] windows and compared as such."""
    few = _sorted_contexts(contexts.filter("NOT hot"), width)
    if not hot:
        return few
    parts = stored(_split(contexts.filter("hot"), steps[0], width))
    one = parts.groupBy("h2", "c2").agg(F.sum("m").alias("m"), F.count("*").alias("size"), F.first(F.struct("n", "d", "context")).alias("s"))
    one = stored(one.select(F.col("h2").alias("h"), F.col("c2").alias("c"), "m", "size", "s.*"))
    marked, more = _marked(one.drop("size"), most)
    runs = _compared(marked, more, steps[1:], width, most)
    runs = stored(runs.join(one.select("h", "c", "size"), ["h", "c"]).select(F.col("h").alias("h2"), F.col("c").alias("c2"), "runs", "size"))
    back = by_key(parts.select("h", "c", "k", "h2", "c2"), runs, ["h2", "c2"], "size").filter("runs IS NOT NULL")
    moved = F.transform("runs", lambda r: F.struct((r["a"] + F.col("k")).alias("a"), (r["b"] + F.col("k")).alias("b")))
    return few.unionByName(back.groupBy("h", "c").agg(F.flatten(F.collect_list(moved)).alias("runs")))


def repeated_contexts(texts: DataFrame, found: DataFrame, width: int = WIDTH, gram: int = GRAM, most: int = 4096) -> DataFrame:
    """(h, c, runs): of each context that has repeated windows the runs [a, b) of their numbers."""
    single = found.groupBy("h", "c").agg(F.sum("copies").alias("m"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("at").alias("at"))
    flagged, hot = _marked(stored(single), most)
    wanted = flagged.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "c", "m", "at", "hot")).alias("list"))
    fetched = texts.dropDuplicates(["k1", "k2"]).join(wanted, ["k1", "k2"]).select("z", "list")

    def fetch(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            size = 0
            for z, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = unpack.decompress(z) if z else b""
                for r in items:
                    first, d, n = r["at"] >> 32, r["at"] >> 16 & 0xFFFF, r["at"] & 0xFFFF
                    context = text[first : first + n - 1 + width]
                    size += len(context)
                    for col, x in zip(out, (r["h"], r["c"], r["m"], n, d, r["hot"], context), strict=True):
                        col.append(x)
                if size > 1 << 22:
                    yield _contexts(out)
                    out, size = [[] for _ in range(7)], 0
            yield _contexts(out)

    contexts = stored(fetched.mapInArrow(fetch, _CONTEXT))
    span = width - gram + 1
    return _compared(contexts, hot, [int(span**0.5) + 1, 1], width, most)


def _contexts(out: list[list]) -> pa.RecordBatch:
    types = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["h", "c", "m", "n", "d", "hot", "context"])


def _kept(text: bytes, ranges) -> tuple[int, int, bytes]:
    """(removed bytes, maximal removed runs, the rest) after the ranges (start, end) are cut out."""
    out, at, removed, spans, end = [], 0, 0, 0, -1
    for a, b in sorted(ranges or []):
        if a > end:
            out.append(text[at:a])
            spans += 1
        if b > at:
            removed += b - max(a, at)
            at = b
        end = max(end, b)
    return removed, spans, b"".join([*out, text[at:]])


def without_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, most: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of each document.

    Every byte is removed that a `width`-byte string covers which also starts anywhere else, in the same document too;
    strings don't cross documents and are judged on the input. Null texts are empty; texts shorter than `width` stay as
    they are; equal texts of `width` bytes or more vanish. Null and repeated doc_ids are kept as rows of their own. An
    empty table gives an empty table. Other columns are not read. A long text comes to a task alone and takes about eighty bytes
    of memory for each of its own; `most` bounds the pieces that are sorted and changes no result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = occurrences(rows, width, gram)
    # written first, so that the join has a shuffle of its own on either side and hot k-grams can be split
    repeated_grams = stored(every.groupBy("h").agg(F.sum("copies").alias("m")).filter("m > 1").select("h"))
    found = stored(every.join(repeated_grams, "h", "left_semi"))
    texts = keyed(rows)
    runs = repeated_contexts(texts, found, width, gram, most)
    first = F.shiftright("at", 32)
    spans = found.select("h", "c", "k1", "k2", first.cast("int").alias("first")).join(runs, ["h", "c"]).select("k1", "k2", F.explode(F.transform("runs", lambda r: F.struct((F.col("first") + r["a"]).alias("a"), (F.col("first") + r["b"] - 1 + width).alias("b")))).alias("s"))
    ranges = stored(spans.groupBy("k1", "k2").agg(F.collect_set("s").alias("ranges")))

    def cut(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for b in pieces(batch):
                texts = [unpack.decompress(z) if z else b"" for z in b.column(1).to_pylist()]
                out = [_kept(t, [(r["a"], r["b"]) for r in rs or []]) for t, rs in zip(texts, b.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([hashlib.sha256(o[2]).hexdigest() for o in out], pa.string()), pa.array([o[2] for o in out], pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    joined = texts.join(ranges, ["k1", "k2"], "left").select("doc_id", "z", "ranges")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
