"""Mixture-controlled packing: windows of a fixed number of tokens, each filled in the sources' target proportions.

Every source has a queue, the concatenation of its documents' tokens. Deficit round robin fills a window: each queue's
credit is its quantum (what its target share owes it in this window) plus the deficit it carries; it serves the credit's
whole tokens, and tokens that are still lacking come from the queues with the largest fractions left. What a queue was
owed and not served goes to the next window. Documents are cut freely, so all windows but the last are full.

Targets are the corpus's own shares, or weights by source; every token is packed once, so a queue that runs dry leaves its
share to the others in proportion. What all queues are owed after any number of windows has a closed form, so the deficits
at the border of a segment of windows are known without the rounds before it: owed less served, where queue s has by then
served the tokens whose virtual time (i + 1/2) / weight_s is smallest. Each task replays the rounds of just those segments
that its rows fall in, carrying the deficits over the border, and all tasks agree without talking to each other.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, stored
from .tokens import encoder


class Schedule:
    """Which window serves which token of each queue. A segment's windows x queues stay below 2 ** 18, whatever the number of queues."""

    def __init__(self, totals: list[int], window: int = 4096, segment: int = 256, weights: list[float] | None = None):
        self.totals, self.window = np.array(totals, np.int64), window
        self.weights = self.totals.astype(float) if weights is None else np.array(weights, float)
        queues = max(1, len(totals))
        self.segment = max(1, min(segment, (1 << 18) // queues))
        self.total = int(self.totals.sum())
        # the time at which each queue runs dry, and what all have served by then
        with np.errstate(divide="ignore"):
            dry = np.where(self.totals > 0, self.totals / self.weights, 0.0)
        order = np.argsort(dry, kind="stable")
        self._dry = dry[order]
        done = np.concatenate(([0], np.cumsum(self.totals[order])))
        rate = np.concatenate((np.cumsum(self.weights[order][::-1])[::-1], [0.0]))
        self._done, self._rate = done[:-1].astype(float), rate[:-1]
        self._by_then = self._done + self._dry * self._rate
        self.border, self.rounds = lru_cache(max(4, (1 << 22) // queues))(self._border), lru_cache(64)(self._rounds)

    def _time(self, tokens: int) -> float:
        """The virtual time at which so many tokens are owed."""
        if tokens >= self.total:
            return float(self._dry[-1])
        k = int(np.searchsorted(self._by_then, tokens))
        return float((tokens - self._done[k]) / self._rate[k])

    def _owed(self, tokens: int) -> np.ndarray:
        """What each queue is owed of the first `tokens` tokens."""
        return np.minimum(self.totals, self.weights * self._time(tokens))

    def _served(self, v: float) -> np.ndarray:
        return np.minimum(np.floor(v * self.weights + 0.5).astype(np.int64), self.totals)

    def _border(self, g: int) -> np.ndarray:
        """Tokens that each queue has served before segment g; sums to the segments' tokens exactly and never falls with g."""
        want = min(g * self.segment * self.window, self.total)
        if want == self.total:
            return self.totals.copy()
        lo, hi = 0.0, float(2 * self._dry[-1] + 1 / self.weights[self.totals > 0].min())
        while lo < (mid := (lo + hi) / 2) < hi:
            lo, hi = (mid, hi) if self._served(mid).sum() <= want else (lo, mid)
        out, more = self._served(lo), self._served(hi)
        lack = want - int(out.sum())
        for s in np.flatnonzero(more > out):
            step = min(lack, int(more[s] - out[s]))
            out[s] += step
            lack -= step
        return out

    def _rounds(self, g: int) -> np.ndarray:
        """Cumulated tokens of each queue at the start of each of the segment's windows, and at its end: (windows + 1, queues)."""
        first, last = self.border(g), self.border(g + 1)
        left = last - first
        n = -(-int(left.sum()) // self.window)
        begin = g * self.segment * self.window
        owed = self._owed(begin)
        deficit = owed - first
        out = np.empty((n + 1, len(first)), np.int64)
        out[0] = first
        for w in range(n - 1):
            before, owed = owed, self._owed(begin + (w + 1) * self.window)
            credit = deficit + (owed - before)
            serve = np.minimum(np.maximum(np.floor(credit), 0).astype(np.int64), left)
            while lack := self.window - int(serve.sum()):
                more = credit - serve
                if lack > 0:
                    can = np.flatnonzero(left > serve)
                    serve[can[np.argsort(-more[can], kind="stable")[:lack]]] += 1
                else:
                    can = np.flatnonzero(serve > 0)
                    serve[can[np.argsort(more[can], kind="stable")[:-lack]]] -= 1
            deficit = credit - serve
            left = left - serve
            out[w + 1] = out[w] + serve
        out[n] = last
        return out

    def pieces(self, s: int, x: int, n: int):
        """(window, offset in it, length) of tokens x to x + n of queue s."""
        end, size = x + n, self.segment * self.window
        v = x / self.weights[s]
        k = int(np.searchsorted(self._dry, v))
        owed = self.total if k == len(self._dry) else self._done[k] + v * self._rate[k]
        g = min(int(owed) // size, (self.total - 1) // size)
        while g and self.border(g)[s] > x:
            g -= 1
        while self.border(g + 1)[s] <= x:
            g += 1
        while x < end:
            starts = self.rounds(g)
            w = int(np.searchsorted(starts[:, s], x, "right")) - 1
            while x < end and w < len(starts) - 1:
                stop = min(end, int(starts[w + 1, s]))
                if stop > x:
                    before = int((starts[w + 1, :s] - starts[w, :s]).sum())
                    yield g * self.segment + w, before + x - int(starts[w, s]), stop - x
                    x = stop
                w += 1
            g += 1


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """(doc_id, queue, part, loc, n, ids): ids with the end id, as 16-bit integers where the vocabulary allows; loc counts its queue's tokens in its partition before it."""

    def run(batches):
        tok = encoder(vocabulary)
        narrow = tok.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        end = np.array([end_id], "<u4").tobytes()
        part, at = TaskContext.get().partitionId(), {}
        for batch in batches:
            for b in pieces(batch, 2, most_bytes=1 << 21):
                ids, loc, counts = [], [], []
                for q, x in zip(b.column(1).to_pylist(), tok.many(b.column(2).to_pylist()), strict=True):
                    x += end
                    n = len(x) // 4
                    loc.append(at.get(q, 0))
                    at[q] = loc[-1] + n
                    counts.append(n)
                    ids.append(np.frombuffer(x, "<u4").astype("<u2").tobytes() if narrow else x)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([part] * len(loc), pa.int32()), pa.array(loc, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "queue", "part", "loc", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("queue"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, queue string, part int, loc long, n long, ids binary")


def pack(docs: DataFrame, vocabulary: str, window: int = 4096, end_id: int = 2, targets: dict | None = None, segment: int = 256) -> DataFrame:
    """Pieces (doc_id, source_queue, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    Sequences are gapless from 0 and full but for the last, which a reader pads to `window`. targets: weights above 0 by
    source (None for a null one), in which windows are filled while their queues last; sources without a weight follow
    when those have run dry. Without targets each source has its share of the corpus. Null texts are empty and give the
    end id alone; a null source is a queue of its own; null and repeated doc_ids and rows are packed like others. An empty
    table makes an empty table. A text's ids are held whole by one task: about 30 bytes for a byte of text. ids: 32-bit
    little-endian. A total for each source reaches the driver; a window costs time in proportion to the number of sources.
    """
    rows = stored(tokenized(docs, vocabulary, end_id))
    spans = rows.groupBy("queue", "part").agg(F.max(F.col("loc") + F.col("n")).alias("span"))
    bases = spans.withColumn("base", F.sum("span").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("span")).select("queue", "part", "base")
    totals = {r["queue"]: int(r["n"]) for r in spans.groupBy("queue").agg(F.sum("span").alias("n")).collect()}
    names = sorted(totals)
    place = {q: k for k, q in enumerate(names)}
    sizes, weights = [totals[q] for q in names], None
    if targets is not None:
        named = {"" if s is None else f"s{s}": w for s, w in targets.items()}
        if any(not w > 0 for w in named.values()):
            raise ValueError("target weights have to be above 0")
        slow = min(named.values(), default=1.0) / (1e6 * max(1, sum(sizes)))
        weights = [named[q] if q in named else slow * n for q, n in zip(names, sizes, strict=True)]

    def run(batches):
        plan = Schedule(sizes, window, segment, weights)
        for batch in batches:
            for b in pieces(batch):
                out: list[list] = [[] for _ in range(9)]
                for doc_id, queue, base, loc, n, ids in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                    raw = ids if len(ids) == 4 * n else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                    start = 0
                    for w, offset, length in plan.pieces(place[queue], base + loc, n):
                        own = raw[4 * start : 4 * (start + length)]
                        for column, x in zip(out, (doc_id, queue, start, length, own, zlib.crc32(own), n, w, offset), strict=True):
                            column.append(x)
                        start += length
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "source_queue", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    few = spans.count() <= 200_000  # a row for each queue and input partition: broadcast while it is small, joined beyond
    joined = rows.join(F.broadcast(bases) if few else bases, ["queue", "part"]).select("doc_id", "queue", "base", "loc", "n", "ids")
    return joined.mapInArrow(run, "doc_id long, source_queue string, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def sequences(packed: DataFrame, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids array<int>) of `window` ids each: the pieces put together, the last sequence padded."""

    def whole(pdf):
        row = np.full(window, pad_id, np.int32)
        for offset, ids in zip(pdf["offset"], pdf["ids"], strict=True):
            x = np.frombuffer(ids, "<u4")
            row[offset : offset + len(x)] = x
        return pdf[["sequence_id"]].head(1).assign(ids=[row])

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(whole, "sequence_id long, ids array<int>")
